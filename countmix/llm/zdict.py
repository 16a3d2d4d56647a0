"""Toxicity by compression distance with zstandard dictionaries.

Two dictionaries are trained with zstandard's trainer: one on ordinary text,
one on what sets toxic text apart.  For the latter each toxic document of the
sample is reduced to the words that toxic text holds far more often than
ordinary text; a word counts once per distinct pair of neighbours and once per
document, so neither a passage that many copies share nor one odd document
weighs more than one.  Every whole text is cut into windows of
a few words, and each window is compressed twice: with the ordinary dictionary,
and with the toxic one before it as nearer history.  The bytes that the toxic
dictionary saves are the window's gain.  A logistic calibration, fitted on the
sample, turns a document's gains (the largest, the mean of the two largest, how
many reach a threshold and their share) into a probability.

The sample holds at most ``sample_docs`` labelled documents and ``sample_bytes`` of text per class
(one document at least), those with the least id hashes; it is the only thing gathered in one place.
Of an id with several texts the sample takes the one of the least hash.  Scoring
is one pass over all rows without a shuffle.

Edge cases: null or empty text has one empty window and the score of no gain;
labels that repeat an id count as toxic if any is; null labels are left out;
if a class has no sample the score is the share of toxic labels (0.5 without
labels); repeated rows are each scored.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, drop_folder, scratch, texts

WINDOW_WORDS = 8
ORDINARY_BYTES = 32_768
TOXIC_BYTES = 2_048
#: Bytes saved from which a window counts.
GAIN = 3
_EDGE = b".,;:!?\"'()"


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split()


def windows(text: bytes, n: int = WINDOW_WORDS) -> list[bytes]:
    w = tokens(text)
    return [b" " + b" ".join(w[i:i + n]) + b" " for i in range(0, len(w), n)] or [b""]


def support(docs: list[bytes]) -> Counter:
    """Per word: in how many distinct pairs of neighbours it stands, or in how
    many documents if those are fewer."""
    seen, holders = set(), Counter()
    for t in docs:
        w = [b"", *tokens(t), b""]
        seen.update(zip(w, w[1:], w[2:]))
        holders.update({x.strip(_EDGE) for x in w})
    pairs = Counter(x[1].strip(_EDGE) for x in seen)
    return Counter({w: min(k, holders[w]) for w, k in pairs.items()})


def telling_words(toxic: list[bytes], ordinary: list[bytes], z: float = 5.0, ratio: float = 8.0) -> set[bytes]:
    """Words of toxic text far over their share in ordinary text."""
    a, b = support(toxic), support(ordinary)
    na, nb = max(1, sum(a.values())), max(1, sum(b.values()))
    out = set()
    for w, k in a.items():
        if len(w) < 3 or k < 5:
            continue
        expected = (k + b[w]) * na / (na + nb)
        if (k - expected) / np.sqrt(expected * nb / (na + nb)) > z and k / na > ratio * (b[w] + 1) / nb:
            out.add(w)
    return out


def dictionary(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    """The content that zstandard's trainer picks; all of it where there is too
    little to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=d).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def compressor(content: bytes):
    params = zstandard.ZstdCompressionParameters.from_level(
        3, dict_size=len(content), source_size=64, min_match=4, strategy=zstandard.STRATEGY_BTOPT,
        write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    if not content:
        return zstandard.ZstdCompressor(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)


class Gains:
    """The features of texts under two dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.plain, self.both = compressor(ordinary).compress, compressor(ordinary + toxic).compress

    def features(self, text: bytes) -> list[float]:
        plain, both = self.plain, self.both
        g = np.array([len(plain(w)) - len(both(w)) for w in windows(text)], dtype=np.float64)
        top = np.sort(g)[-2:]
        n = float((g >= GAIN).sum())
        return [1.0, float(top[-1]), float(top.mean()), np.log1p(n), np.sqrt(n / len(g)), np.log1p(np.maximum(g - 1, 0).sum()), float(np.log(len(g)))]


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray | None
    share: float


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weighted logistic regression with a small ridge, by Newton steps."""
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(h, x.T @ (w * (y - p)) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return b


def fit(toxic: list[bytes], ordinary: list[bytes], n_toxic: int, n_ordinary: int) -> Model:
    """``n_toxic`` and ``n_ordinary``: how many labels the samples stand for."""
    share = n_toxic / (n_toxic + n_ordinary) if n_toxic + n_ordinary else 0.5
    if not toxic or not ordinary:
        return Model(b"", b"", None, share)
    words = telling_words(toxic, ordinary)
    told = []
    for t in toxic:
        some = [w for w in (w.strip(_EDGE) for w in tokens(t)) if w in words]
        if some:
            told.append(b" " + b" ".join(some) + b" ")
    plain = [w for t in ordinary for w in windows(t, 32) if w]
    model = Model(dictionary(plain, ORDINARY_BYTES, 64, 8), dictionary(told, TOXIC_BYTES, 32, 6), None, share)
    gains = Gains(model.ordinary, model.toxic)
    x = np.array([gains.features(t) for t in [*toxic, *ordinary]])
    y = np.repeat([1.0, 0.0], [len(toxic), len(ordinary)])
    w = np.repeat([n_toxic / len(toxic), n_ordinary / len(ordinary)], [len(toxic), len(ordinary)])
    model.weights = logistic(x, y, w * len(y) / w.sum())
    return model


def train(docs: DataFrame, labels: DataFrame, use: Column, sample_docs: int = 4000, sample_bytes: int = 128 << 20, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits on the labelled documents for which ``use`` (of the labels' ``doc_id``)
    holds."""
    marks = (columns(labels, doc_id="doc_id", toxic="toxic").where(use & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    n = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    least = [marks.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs) for k in (1, 0)]
    own = columns(docs, doc_id=id_col, text=F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    rows = own.join(F.broadcast(least[0].unionByName(least[1])), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    path = scratch(docs.sparkSession, "sample")
    rows.withColumn("h", F.xxhash64("doc_id")).withColumn("size", F.octet_length("text").cast("long")).write.parquet(path)
    rows, got = docs.sparkSession.read.parquet(path), {}
    for k in (1, 0):
        sizes = sorted(rows.where(F.col("toxic") == k).select("h", "size").collect())  # at most sample_docs
        total = np.cumsum([r["size"] for r in sizes])
        kept = max(1, int((total <= sample_bytes).sum())) if sizes else 0
        some = rows.where((F.col("toxic") == k) & (F.col("h") <= sizes[kept - 1]["h"])) if kept else rows.where("false")
        got[k] = [r["text"].encode("utf-8", "surrogatepass") for r in sorted(some.select("doc_id", "text").collect(), key=lambda r: r["doc_id"])]  # at most sample_bytes
    drop_folder(docs.sparkSession, path)
    return fit(got[1], got[0], n.get(1, 0), n.get(0, 0))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, predicted, gain`` of every row."""
    rows = texts(docs, id_col, text_col)
    rows = rows.select("doc_id", F.col("text").cast("binary").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        gains = Gains(m.ordinary, m.toxic) if m.weights is not None else None
        for b in batches:
            if gains is None:
                s, top = np.full(b.num_rows, m.share), np.zeros(b.num_rows)
            else:
                x = np.array([gains.features(t) for t in b.column("text").to_pylist()]).reshape(b.num_rows, -1)
                s, top = (1 / (1 + np.exp(-np.clip(x @ m.weights, -30, 30))), x[:, 1]) if b.num_rows else (np.zeros(0), np.zeros(0))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(top.astype(np.int64))], ["doc_id", "score", "predicted", "gain"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int, gain long")
