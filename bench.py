"""Benchmark: headline workloads at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
Each timed query runs to completion (an action over its whole result).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main():
    from pyspark.sql import functions as F

    from countmix.operators import fit as fitmod
    from countmix.operators import init, matrix, text
    from countmix.operators.select import select_model
    from countmix.plans import catalog as C
    from countmix.session import get_spark

    spark = get_spark(f"local[{CPUS}]", shuffle_partitions=int(CPUS) * 2)
    times, extra = {}, {}

    def timed(name, fn):
        t0 = time.time()
        out = fn()
        times[name] = round(time.time() - t0, 3)
        print(f"[bench] {name}: {times[name]}s", file=sys.stderr, flush=True)
        return out

    # warm the JVM and the Python workers once (not timed)
    spark.range(1000).selectExpr("sum(id)").collect()

    def count_matrix_and_meta():
        docs = C._docs(spark, SF_DIR)
        cm = matrix.build_count_matrix(docs, text.document_term_matrix(text.tokens(docs)))
        meta = matrix.meta_documents(cm.dtm, init.assign_from_labels(docs, "lang"))
        extra["N"], extra["V_full"] = cm.N, cm.V
        return meta.agg(F.count("*"), F.sum("cnt")).collect()

    timed("count_matrix_meta", count_matrix_and_meta)
    timed("top_terms_by_lang", lambda: C.top_terms_by_lang(spark, SF_DIR).collect())
    timed("ve_bound_lang_source", lambda: C.bound_icl_lang_source(spark, SF_DIR).collect())
    timed("batch_round_lang_source", lambda: C.batch_round_lang_source(spark, SF_DIR)
          .agg(F.count("*")).collect())

    docs, tdtm = C._term_dtm(spark, SF_DIR)
    cm = matrix.build_count_matrix(docs, tdtm, min_docs=C.MIN_DOCS)
    extra["V_fit"] = cm.V

    def batch_fit():
        res = fitmod.fit(cm, C.FIT_Q, C.FIT_K, "random", "lda", C.FIT_CONTROLS,
                         max_epochs=C.UNTIL_CONVERGED, nruns=2, mode="batch", seed=C.SEED)
        extra["batch_rounds"] = res.n_epochs
        # every run's own rounds: one trace row per round and one before the first
        extra["batch_rounds_all"] = res.trace.count() - len(res.run_bounds)
        extra["batch_bound"] = round(res.bound, 2)
        return res.assign.count()

    timed("batch_fit_q6_k4_2runs", batch_fit)
    if extra.get("batch_rounds_all"):
        extra["batch_docs_per_sec"] = round(cm.N * extra["batch_rounds_all"]
                                            / times["batch_fit_q6_k4_2runs"], 1)

    small = os.path.join(os.path.dirname(SF_DIR.rstrip("/")), "sf0.001")
    if os.path.isdir(small):   # exact sequential moves, of a smaller table
        timed("greedy_sf0.001", lambda: C.fit_greedy_documents(spark, small).count())

    def selection():
        sel = select_model(cm, [5, 6, 7], [3, 4, 5], "random", "lda", C.FIT_CONTROLS,
                           max_epochs=C.UNTIL_CONVERGED, nruns=3, mode="batch", seed=C.SEED)
        best = sel.grid.orderBy(F.desc("icl")).first()
        extra["selected"] = {"k": best.k, "q": best.q}
        return sel.grid.collect()

    timed("select_model_q5to7_k3to5_3runs", selection)

    total = round(sum(times.values()), 3)
    m = re.search(r"sf([0-9.]+)", SF_DIR)
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else SF_DIR,
                      "cpus": int(CPUS), **extra}))


if __name__ == "__main__":
    main()
