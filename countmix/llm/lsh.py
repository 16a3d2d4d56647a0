"""Approximate nearest neighbours by multiprobe p-stable hashing.

Nearness is the largest inner product.  Vectors become points of Euclidean
space (one more coordinate makes all norms equal; queries are scaled to norm
one), where the nearest point has the largest product.  Each of ``tables``
tables hashes a point to a bucket of ``hashes`` cells ``floor((a.x + b) / w)`` with
Gaussian ``a``.  A query's own bucket is visited first, then perturbed buckets
in the order of their estimated success: the squared distances from the query's
projections to the bucket's cells, added up.  Visits stop at a budget that is
fitted on a bounded sample: the score within which a share ``target`` of the true
neighbours of sample queries lies in at least one table, but not before a block
has given as many candidates as are asked for.  Candidates of all tables merge and are reranked by exact products in double precision.

Equal vectors form a class that is indexed once; answers are expanded to its
smallest ids, as many as can matter.  Queries and index meet in blocks of
bounded size: each block of the index holds its part of every bucket, so a hot
bucket is spread over blocks; a block of queries ranks the buckets of a block
of the index, marks the members of those within the budget and scores them.

Edge cases: rows with a null id, and vectors that are null, empty, zero or hold
null or non-finite components take no part, nor do vectors of another length
than the most frequent one (the longer of two); ties go to the smaller id;
a row that repeats an id with an equal vector counts once; empty tables give an
empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators._util import ship
from .common import columns, saved

BLOCK_VECTORS = 8192
BLOCK_QUERIES = 4096


@dataclass
class Index:
    """Projections of all tables, cell width, budget and the largest norm."""

    a: np.ndarray  # tables x hashes x (dimensions + 1)
    b: np.ndarray  # tables x hashes
    width: float
    budget: float
    norm: float

    def project(self, x: np.ndarray) -> np.ndarray:
        """Tables x points x hashes, in cells."""
        return (np.einsum("tkd,nd->tnk", self.a, x) + self.b[:, None, :]) / self.width

    def points(self, v: np.ndarray) -> np.ndarray:
        v = v / self.norm
        rest = np.sqrt(np.maximum(0.0, 1.0 - np.einsum("nd,nd->n", v, v)))
        return np.concatenate([v, rest[:, None]], axis=1)

    @staticmethod
    def queries(q: np.ndarray) -> np.ndarray:
        q = q / np.linalg.norm(q, axis=1, keepdims=True)
        return np.concatenate([q, np.zeros((len(q), 1))], axis=1)


def bucket_scores(q: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Queries x buckets: squared distance (in cells) from the queries' projections
    to the buckets' cells; 0 is the own bucket."""
    out = np.zeros((len(q), len(buckets)))
    for j in range(q.shape[1]):
        low = buckets[None, :, j] - q[:, None, j]
        d = np.maximum(0.0, np.maximum(low, -low - 1.0))
        out += d * d
    return out


def fit_index(sample: np.ndarray, norm: float, k: int, tables: int, hashes: int, width: float, target: float, n_queries: int = 200, seed: int = 0) -> Index:
    """Draws the projections and fits the budget on the sample."""
    rng = np.random.default_rng(seed)
    index = Index(rng.standard_normal((tables, hashes, sample.shape[1] + 1)), rng.random((tables, hashes)) * width, width, math.inf, norm)
    if len(sample) < 2:
        return index
    asked = rng.permutation(len(sample))[:n_queries]
    q = sample[asked]
    s = q @ sample.T
    s[np.arange(len(asked)), asked] = -math.inf  # itself
    near = np.argsort(-s, axis=1, kind="stable")[:, :min(k, len(sample) - 1)]
    cells, proj = np.floor(index.project(index.points(sample))), index.project(index.queries(q))
    need = np.full(near.shape, math.inf)
    for t in range(tables):
        for i in range(len(q)):
            need[i] = np.minimum(need[i], bucket_scores(proj[t, i:i + 1], cells[t, near[i]])[0])
    index.budget = float(np.quantile(need, target))
    return index


def search_block(index: Index, q: np.ndarray, v: np.ndarray, k: int, part: int = 256):
    """For each query the positions and products of its nearest candidates among
    ``v`` (ties: the earlier position first)."""
    cells = np.floor(index.project(index.points(v))).astype(np.int64)
    members = [np.unique(c, axis=0, return_inverse=True) for c in cells]
    for lo in range(0, len(q), part):
        own = q[lo:lo + part]
        proj = index.project(index.queries(own))
        reached = np.full((len(own), len(v)), math.inf)
        for t, (buckets, of) in enumerate(members):
            np.minimum(reached, bucket_scores(proj[t], buckets)[:, of.ravel()], out=reached)
        least = min(k, len(v)) - 1  # visits go on until there are k candidates
        limit = np.maximum(index.budget, np.partition(reached, least, axis=1)[:, least])
        score = np.where(reached <= limit[:, None], own @ v.T, -math.inf)
        first = np.argsort(-score, axis=1, kind="stable")[:, :k]
        value = np.take_along_axis(score, first, axis=1)
        row, col = np.nonzero(value > -math.inf)
        yield lo + row, first[row, col], value[row, col]


def usable(vectors: DataFrame) -> DataFrame:
    """Rows ``vec_id, v`` (array of double) that take part."""
    v = F.transform("vector", lambda x: x.cast("double"))
    df = vectors.where("vec_id is not null and vector is not null").select("vec_id", v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    df = df.where(~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0)).withColumn("dims", F.size("v"))
    common = df.groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).first()
    return df.where(F.col("dims") == (common["dims"] if common else 0)).drop("dims")


def nearest(embeddings: DataFrame, is_query: Column, k: int = 20, tables: int = 4, hashes: int = 6, width: float = 0.8, target: float = 0.95, sample_rows: int = 10_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: of each row for which ``is_query`` (over
    ``vec_id``) holds, its ``k`` nearest other rows found, nearest first."""
    spark = embeddings.sparkSession
    ship(spark)
    rows = usable(columns(embeddings, vec_id=id_col, vector=vector_col))
    rows = saved(rows.select("vec_id", "v", F.xxhash64("v").alias("h1"), F.hash("v").alias("h2")).dropDuplicates(["vec_id", "h1", "h2"]), "vectors")
    # a class: equal vectors; the k + 1 smallest ids are all that an answer can need
    w = Window.partitionBy("h1", "h2").orderBy("vec_id")
    members = saved(rows.select("vec_id", "h1", "h2").withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1).drop("n"), "members")
    classes = members.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"))
    index_rows = saved(rows.join(classes, ["h1", "h2"]).where("vec_id = rep").select("rep", "v"), "classes")
    ids = rows.where(is_query).select("vec_id", "h1", "h2")
    query_ids = saved(ids.join(classes, ["h1", "h2"]).select(F.col("vec_id").alias("query_id"), "rep"), "queries")
    asked = saved(index_rows.join(query_ids.select("rep").distinct(), "rep", "left_semi"), "asked")
    schema = "query_id long, rank int, vec_id long, score double"
    n, n_asked = index_rows.count(), asked.count()
    if not n_asked:
        return spark.createDataFrame([], schema)
    norm = index_rows.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)))).first()[0]
    some = index_rows.orderBy(F.xxhash64("rep"), "rep").limit(sample_rows).toPandas()  # at most sample_rows
    index = spark.sparkContext.broadcast(fit_index(np.stack(some["v"].to_numpy()), norm, k, tables, hashes, width, target))
    v_blocks, q_blocks = math.ceil(n / BLOCK_VECTORS), math.ceil(n_asked / BLOCK_QUERIES)

    def dealt(df, own, n_own, other, n_other):
        df = df.withColumn(own, F.pmod(F.xxhash64("rep"), F.lit(n_own)).cast("int"))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))

    left, right = dealt(asked, "qb", q_blocks, "vb", v_blocks), dealt(index_rows, "vb", v_blocks, "qb", q_blocks)

    def meet(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(v):
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "rep": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        v = v.sort_values("rep")
        qi, vi = q["rep"].to_numpy(), v["rep"].to_numpy()
        out = list(search_block(index.value, np.stack(q["v"].to_numpy()), np.stack(v["v"].to_numpy()), k + 1))
        return pd.DataFrame({"q": qi[np.concatenate([o[0] for o in out])], "rep": vi[np.concatenate([o[1] for o in out])], "score": np.concatenate([o[2] for o in out])})

    found = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInPandas(meet, "q long, rep long, score double")
    best = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
    found = saved(found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n"), "found")
    # back from classes to rows
    of_class = members.join(classes, ["h1", "h2"]).select("rep", "vec_id")
    answers = (query_ids.withColumnRenamed("rep", "q").join(found, "q").join(of_class, "rep").where("vec_id <> query_id"))
    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return answers.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
