"""Work that a task holds in memory is dealt into parts of bounded size."""

import pytest
from pyspark.sql import functions as F

from countmix.operators import matrix, starts, text


@pytest.fixture()
def docs(spark):
    return spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("word"), F.concat(F.lit("own"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"))).alias("text"))


def sizes(df):
    return [n for n in df.select("doc_id").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()]


def test_texts_keep_their_parts(spark, docs):
    n = text.part_count(docs, part_bytes=200)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    assert n == max(spark.sparkContext.defaultParallelism, -(-total // 200))
    assert text.part_count(docs.limit(0)) == spark.sparkContext.defaultParallelism
    tdtm = text.document_term_matrix(text.tokens(text.dealt(docs, n)))
    assert len(sizes(tdtm)) == n and max(sizes(tdtm)) < 60     # small parts are not put together
    assert tdtm.count() == 800


def test_rows_and_weights_keep_their_parts(spark, docs):
    tdtm = text.document_term_matrix(text.tokens(docs))
    cm = matrix.build_count_matrix(docs, tdtm)
    rows = matrix.sparse_rows(cm.dtm, None, 50)
    assert len(sizes(rows)) == 50 and max(sizes(rows)) < 40
    assert {(r["doc_id"], tuple(r["terms"])) for r in rows.collect()} == {(r["doc_id"], tuple(r["terms"])) for r in cm.rows().collect()}
    w = starts.tfidf(cm.dtm, cm.N, cm.V, 50)
    assert len(sizes(w)) == 50
    assert sorted(map(tuple, w.collect())) == sorted(map(tuple, starts.tfidf(cm.dtm, cm.N, cm.V).collect()))


def test_iterations_leave_the_triplets_in_place(spark, docs):
    cm = matrix.build_count_matrix(docs, text.document_term_matrix(text.tokens(docs)))
    kept = starts._by_term(cm.dtm, cm.tasks())
    kept.count()
    resp = docs.select("doc_id", F.array(F.lit(0.5), F.lit(0.5)).alias("r"))
    size = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        # means by term: documents are sent to the tasks, nothing is shuffled
        means = starts.cluster_means(kept.withColumnRenamed("cnt", "w"), docs.select("doc_id", F.lit(1).alias("cluster")).localCheckpoint(), 2, cm.N)
        above = means._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
        assert "Exchange hashpartitioning" not in above
        theta, _ = starts.mixture_m_step(kept, resp, 2, cm.N, cm.V, 0.5)
        assert theta.count() == cm.V
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
        kept.unpersist()


def test_lda_blocks_fall_on_many_tasks(spark):
    from pyspark.sql import functions as F

    from countmix.operators import topics
    rows = spark.range(200, numPartitions=1).select(F.col("id").alias("doc_id"), F.array(F.lit(0), F.lit(1)).alias("terms"), F.array(F.lit(1.0), F.lit(2.0)).alias("cnts"))
    blocks, terms, n = topics._blocks(rows, 1)
    cores = spark.sparkContext.defaultParallelism
    assert n >= 3 * cores and blocks.select("block").distinct().count() >= 3 * cores
    assert blocks.select(F.sum(F.size("terms"))).first()[0] == 400
    mine = terms.withColumn("b", F.array(F.lit(0.5)))
    solved = topics._met(blocks, mine.toDF(*mine.columns), n).applyInPandas(lambda d, b: d[["block"]].head(1), "block int")
    assert solved.rdd.getNumPartitions() == n and solved.count() == blocks.select("block").distinct().count()
