"""Quality classifier: perplexity under an interpolated modified Kneser-Ney
model of trusted text, against thresholds per language.

The model learns from all trusted documents, whose text is joined once to their
ids and kept for the two counting passes; thresholds rest on all of them too.

Symbols are characters: every character of the trusted text has its own, one more
stands for all that trusted text never holds, and a boundary pads a text's start and
ends it.  N-grams of order 4 are counted in each task, which gives its sums off past a
bounded number, and summed by ``groupBy``.  Everything that the score of an event rests on
lies with the character before it (the last of its context), so the n-grams are dealt
by that character into pieces of about a million; a task works out the
continuation counts, discounts, back-off weights and probabilities of a piece.  One piece
after another goes out as a broadcast and scores its events of every whole text, and the
parts of a text's score are added: small alphabets make one piece, many scripts make more.  A piece
holds at least all n-grams of one such character.  Learning shuffles the text once.

The discounts of each order are the modified Kneser-Ney ones of its counts of
counts.  A document's level is its mean negative log probability per event
(its characters and the end), over ``prior`` events of its language's mean
level besides its own, so that a few characters alone do not reject it.  The
threshold of a language is the ``quantile`` of the levels of its trusted
documents, to 1/4096, each under a model that has not seen it (documents
lie in two folds by their ids and are scored by the model of the other); languages with fewer than ``least`` of them share the
threshold of all trusted documents.

Edge cases: null text counts as empty, and an empty text is kept; a null language
is a language of its own; labels that repeat an id trust it only if all agree; without
trusted text every document is kept; repeated rows are each scored.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators._util import bounded_broadcast
from .common import saved, texts

ORDER = 4
BINS = 4096
#: Code points, surrogates too.
POINTS = 0x110000
#: N-grams of a piece of the model, and those a task holds while it counts.
PIECE = 1_000_000
#: Places of a table that finds n-grams at once (4 bytes each).
CELLS = 1 << 22
#: Characters counted or scored at once (about 150 bytes each).
PART = 1 << 18


def symbol_table(chars: list[str]) -> np.ndarray:
    """Symbol of each code point (those not in ``chars``: 1)."""
    lut = np.ones(POINTS, dtype=np.uint32)
    lut[[ord(c) for c in chars]] = np.arange(2, len(chars) + 2)
    return lut


def windows(batch: list[str], lut: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The context (three symbols as one number) and the symbol of every event of
    the texts, and where each text's begin."""
    size = np.array([len(t) for t in batch], dtype=np.int64)
    codes = np.frombuffer("".join(batch).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    pad = ORDER - 1
    full = np.zeros(int(size.sum()) + (pad + 1) * len(batch), dtype=np.int64)
    ends = np.cumsum(size)
    at = np.arange(len(codes)) + np.repeat((pad + 1) * np.arange(len(batch)) + pad, size)
    full[at] = lut[codes]
    n = max(0, len(full) - pad)
    context = np.zeros(n, dtype=np.int64)
    for i in range(pad):
        context = context * symbols + full[i:n + i]
    starts = np.append(0, ends[:-1] + (pad + 1) * np.arange(1, len(batch))) if len(batch) else np.zeros(0, np.int64)
    own = np.ones(n, dtype=bool)  # n-grams that end in the padding of the next text
    for i in range(1, pad + 1):
        own[starts[1:] - i] = False
    return context[own], full[pad:][own], starts - pad * np.arange(len(batch))


def events(batch: list[str], lut: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """``windows`` as one number each (for at most 55,108 symbols)."""
    context, last, starts = windows(batch, lut, symbols)
    return context * symbols + last, starts


def parts(batch: list[str]):
    """Runs of texts of about PART characters; a longer text is one run."""
    out, n = [], 0
    for t in batch:
        if out and n + len(t) > PART:
            yield out
            out, n = [], 0
        out.append(t)
        n += len(t)
    if out:
        yield out


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The modified Kneser-Ney discounts of an order with so many n-grams of count 1 to 4."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    some = lambda k, a, b: min(float(k), max(0.0, k - (k + 1) * y * b / a)) if a else 0.0
    return some(1, n1, n2), some(2, n2, n3), some(3, n3, n4)


def by_order(context: np.ndarray, last: np.ndarray, counts: np.ndarray, symbols: int) -> list[tuple]:
    """Orders 4 to 1 as ``context, last, counts, above``, sorted: raw counts (a column for each
    model), then continuation counts (distinct symbols before).  ``above`` is where each n-gram
    of the order above has its suffix."""
    out = []
    for order in range(ORDER, 0, -1):
        context = context % symbols ** (order - 1)
        at = np.lexsort((last, context))
        first = np.append(True, (np.diff(context[at]) != 0) | (np.diff(last[at]) != 0))
        above = np.empty(len(at), dtype=np.int64)
        above[at] = np.cumsum(first) - 1
        starts = np.flatnonzero(first)
        counts = np.add.reduceat(counts[at], starts, axis=0)
        context, last = context[at][starts], last[at][starts]
        out.append((context, last, counts, above))
        counts = (counts > 0).astype(np.int64)
    return out


def count_counts(counts: np.ndarray) -> np.ndarray:
    """How many n-grams have count 1 to 4 (rows), in each model (columns)."""
    return np.array([(counts == k).sum(axis=0) for k in (1, 2, 3, 4)])


def interpolate(context: np.ndarray, counts: np.ndarray, cut: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, ...]:
    """The contexts of an order, their back-off weights and its n-grams' probabilities,
    with discounts ``cut`` (a row for each model) and the probabilities of the suffixes."""
    starts = np.flatnonzero(np.append(True, np.diff(context) != 0))
    run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(context))))
    taken = np.select([counts == 1, counts == 2, counts >= 3], list(cut.T[:, None, :]), 0.0)
    total = np.add.reduceat(counts, starts, axis=0)
    left = np.add.reduceat(taken, starts, axis=0)
    with np.errstate(divide="ignore", invalid="ignore"):
        weight = np.where(total > 0, left / total, 1.0)
        own = np.where(total[run] > 0, (counts - taken) / total[run], 0.0)
    return context[starts], weight, own + weight[run] * lower


def unigrams(last: np.ndarray, counts: np.ndarray, cut: np.ndarray, symbols: int) -> np.ndarray:
    """The probability of every symbol by its continuation counts (a column for each model)."""
    lower = np.full(counts.shape, 1.0 / symbols)
    _, weight, p = interpolate(np.zeros(len(last), dtype=np.int64), counts, cut, lower)
    out = np.repeat(weight / symbols, symbols, axis=0)
    out[last] = p
    return out


def model_rows(orders: list[tuple], cuts: dict, singles: np.ndarray):
    """Of orders 2 to 4 ``order, contexts, weights, context, last, probabilities``, from
    the orders of ``by_order``, their discounts and the unigrams."""
    lower = singles[orders[-1][1]]
    for n in range(2, ORDER + 1):
        context, last, counts, _ = orders[ORDER - n]
        above = orders[ORDER - n + 1][3]
        contexts, weight, lower = interpolate(context, counts, cuts[n], lower[above])
        yield n, contexts, weight, context, last, lower


def logs(p: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(p, 1e-12)).astype(np.float32)


class Places:
    """Finds numbers below ``size`` among sorted ones: by a table of at most CELLS
    places, else by binary search."""

    def __init__(self, keys: np.ndarray, size: int):
        self.keys, self.table = keys, None
        if size <= CELLS:
            self.table = np.full(size, -1, dtype=np.int32)
            self.table[keys] = np.arange(len(keys), dtype=np.int32)

    def find(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each of ``some`` is, and whether it is there."""
        if self.table is not None:
            at = self.table[some]
            return at, at >= 0
        at = np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)
        return at, self.keys[at] == some


@dataclass
class Piece:
    """Log probabilities for the events of some characters: of the orders 4 to 2 sorted contexts with
    their back-off weights and sorted n-grams (place of the context, symbol) with theirs."""

    orders: list[tuple]
    singles: np.ndarray
    symbols: int

    def scorer(self):
        """A function of ``context, last``: the log probability of each event (a column
        for each model)."""
        v = self.symbols
        places = [(v ** (n - 1), Places(contexts, v ** (n - 1)), weight, Places(keys, len(contexts) * v), p) for n, contexts, weight, keys, p in self.orders]

        def score(context, last):
            out = np.zeros((len(context), self.singles.shape[1]), dtype=np.float32)
            left = None  # events not found yet: all
            for size, contexts, weight, keys, p in places:
                c, s = (context, last) if left is None else (context[left] % size, last[left])
                i, known = contexts.find(c)
                j, hit = keys.find(np.where(known, i, 0) * v + s)
                hit &= known
                rest = np.flatnonzero(~hit)
                if left is None:
                    out, left = p[np.where(hit, j, 0)], rest
                    out[rest] = 0
                else:
                    own = np.flatnonzero(hit)
                    out[left[own]] += p[j[own]]
                    left = left[rest]
                of = known[rest]
                out[left[of]] += weight[i[rest[of]]]
            out[left] += self.singles[last[left]]
            return out

        return score


def piece_of(rows: list[tuple], singles: np.ndarray, symbols: int) -> Piece:
    """A piece from rows as ``model_rows`` gives them, of logarithms and in any order."""
    orders = []
    for n, contexts, weight, context, last, p in sorted(rows, key=lambda r: -r[0]):
        at = np.argsort(contexts)
        contexts, weight = contexts[at], weight[at]
        keys = np.searchsorted(contexts, context) * symbols + last
        at = np.argsort(keys)
        orders.append((n, contexts, weight, keys[at], p[at]))
    return Piece(orders, singles, symbols)


def probabilities(keys: np.ndarray, counts: np.ndarray, symbols: int) -> np.ndarray:
    """Natural log probability of every possible n-gram's last symbol (float32), from
    the raw counts of the highest order (for few symbols)."""
    context, last = np.divmod(keys, symbols)
    orders = by_order(context, last, np.asarray(counts)[:, None], symbols)
    cuts = {ORDER - k: np.array([discounts(*count_counts(o[2])[:, 0])]) for k, o in enumerate(orders)}
    singles = unigrams(orders[-1][1], orders[-1][2], cuts[1], symbols)
    rows = [(n, c, logs(w), x, y, logs(p)) for n, c, w, x, y, p in model_rows(orders, cuts, singles)]
    return piece_of(rows, logs(singles), symbols).scorer()(*np.divmod(np.arange(symbols ** ORDER), symbols))[:, 0]


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids that every label of theirs trusts."""
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")


@dataclass
class Model:
    """``rows``: the pieces' n-grams and (``last`` -1) back-off weights of orders 2 to 4."""

    chars: list[str]
    rows: DataFrame
    piece: np.ndarray  # of each symbol before an event
    singles: np.ndarray  # columns: all trusted text, and what folds 0 and 1 are scored with

    def load(self, k: int) -> Piece:
        t = self.rows.where(F.col("piece") == k).drop("piece").toArrow()
        order, context, last = (t.column(c).to_numpy() for c in ("n", "context", "last"))
        value = np.stack([t.column(c).to_numpy() for c in ("p", "p0", "p1")], axis=1)
        some = []
        for n in range(2, ORDER + 1):
            w, g = (order == n) & (last < 0), (order == n) & (last >= 0)
            some.append((n, context[w], value[w], context[g], last[g], value[g]))
        return piece_of(some, self.singles, len(self.singles))


def count_windows(chars: list[str], symbols: int):
    """For ``mapInArrow`` over ``text, fold``: ``context, last, n0, n1``, the counts of
    n-grams in both folds."""
    names = ["context", "last", "n0", "n1"]

    def summed(tables):
        t = pa.concat_tables(tables).group_by(names[:2], use_threads=False).aggregate([("n0", "sum"), ("n1", "sum")])
        return t.select([*names[:2], "n0_sum", "n1_sum"]).rename_columns(names)

    def run(batches):
        lut, held, rows = symbol_table(chars), [], 0
        for b in batches:
            text, fold = b.column("text").to_pylist(), b.column("fold").to_pylist()
            for f in (0, 1):
                for part in parts([t for t, k in zip(text, fold, strict=True) if k == f]):
                    context, last, _ = windows(part, lut, symbols)
                    one, none = pa.array(np.ones(len(last), dtype=np.int64)), pa.array(np.zeros(len(last), dtype=np.int64))
                    held.append(summed([pa.table([context, last, none if f else one, one if f else none], names=names)]))
                    rows += len(held[-1])
                    if rows > PIECE:
                        held = [summed(held)]
                        rows = len(held[0])
                        if rows > PIECE // 2:
                            yield from held[0].to_batches()
                            held, rows = [], 0
        if held:
            yield from summed(held).to_batches()

    return run


def train(trusted: DataFrame, symbols: int | None = None) -> Model | None:
    """The models of ``trusted`` (``text, fold``); None if there is no text.  With a number
    of ``symbols`` only the most frequent characters have their own."""
    def count_chars(batches):
        total = np.zeros(POINTS, dtype=np.int64)
        for b in batches:
            for part in parts(b.column("text").to_pylist()):
                codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), dtype="<u4")
                total += np.bincount(codes, minlength=POINTS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["key", "n"])

    counts = trusted.select("text").mapInArrow(count_chars, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()  # a row per character
    counts = counts.sort_values(["n", "key"], ascending=[False, True])
    chars = [chr(k) for k in counts["key"].head(len(counts) if symbols is None else symbols - 2)]
    size = len(chars) + 2
    grams = saved(trusted.select("text", "fold").mapInArrow(count_windows(chars, size), "context long, last long, n0 long, n1 long").groupBy("context", "last").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "grams")
    sizes = grams.groupBy((F.col("context") % size).alias("before")).count().toPandas().sort_values("before")  # a row per character
    if not len(sizes):
        return None
    before = sizes["count"].cumsum() - sizes["count"]
    piece = np.full(size, -1)
    piece[sizes["before"]] = np.unique(before // PIECE, return_inverse=True)[1]
    if piece.max() > 0:
        known = grams.sparkSession.createDataFrame(pd.DataFrame({"before": sizes["before"], "piece": piece[sizes["before"]]}))
        grams = grams.withColumn("before", F.col("context") % size).join(bounded_broadcast(known, len(sizes)), "before")
    else:
        grams = grams.withColumn("piece", F.lit(0).cast("long"))

    def orders_of(pdf):
        n0, n1 = pdf["n0"].to_numpy(), pdf["n1"].to_numpy()  # each fold is scored with the other's counts
        return by_order(pdf["context"].to_numpy(), pdf["last"].to_numpy(), np.stack([n0 + n1, n1, n0], axis=1), size)

    def stats(pdf):
        orders = orders_of(pdf)
        out = [pd.DataFrame(np.column_stack([np.full(4, ORDER - k), np.arange(1, 5), count_counts(o[2])])) for k, o in enumerate(orders[:-1])]
        out.append(pd.DataFrame(np.column_stack([np.ones(len(orders[-1][1]), dtype=np.int64), orders[-1][1], orders[-1][2]])))
        return pd.concat(out).set_axis(["n", "key", "c", "c0", "c1"], axis=1)

    dealt = grams.select("piece", "context", "last", "n0", "n1").groupBy("piece")
    found = dealt.applyInPandas(stats, "n int, key long, c long, c0 long, c1 long").groupBy("n", "key").agg(*[F.sum(c).alias(c) for c in ("c", "c0", "c1")]).toPandas().sort_values(["n", "key"])
    table = lambda n: found.loc[found["n"] == n, ["c", "c0", "c1"]].to_numpy(dtype=np.int64)
    of = {1: count_counts(table(1)), **{n: table(n) for n in range(2, ORDER + 1)}}
    cuts = {n: np.array([discounts(*c) for c in t.T]) for n, t in of.items()}
    singles = unigrams(found.loc[found["n"] == 1, "key"].to_numpy(dtype=np.int64), table(1), cuts[1], size)

    def work(pdf):
        k = pdf["piece"].iloc[0]
        for n, contexts, weight, context, last, p in model_rows(orders_of(pdf), cuts, singles):
            for x, y, v in ((contexts, np.full(len(contexts), -1), logs(weight)), (context, last, logs(p))):
                yield pd.DataFrame({"piece": k, "n": n, "context": x, "last": y, "p": v[:, 0], "p0": v[:, 1], "p1": v[:, 2]})

    rows = saved(dealt.applyInPandas(lambda pdf: pd.concat(work(pdf)), "piece long, n int, context long, last long, p float, p0 float, p1 float"), "model")
    return Model(chars, rows, piece, logs(singles))


def levels(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` (``doc_id, mark, text, lang, fold``) as ``doc_id, mark, lang,
    n_events, nll, cross``: the negative log probability under the full model, and under the
    model of the other fold, which has not seen the document."""
    chars, piece, size = model.chars, model.piece, len(model.singles)
    count = int(piece.max()) + 1
    #: a character that trusted text never has before another: only unigrams count
    where = np.maximum(piece, 0)

    def scored(shared, k):
        def run(batches):
            lut, score = symbol_table(chars), shared.value.scorer()
            for b in batches:
                fold = np.array(b.column("fold").to_pylist(), dtype=np.int64)
                sums, sizes = [], []
                for part in parts(b.column("text").to_pylist()):
                    context, last, starts = windows(part, lut, size)
                    sizes.append(np.diff(np.append(starts, len(last))))
                    if count == 1:
                        p = score(context, last)
                    else:
                        p = np.zeros((len(last), 3), dtype=np.float32)
                        own = np.flatnonzero(where[context % size] == k)
                        p[own] = score(context[own], last[own])
                    sums.append(-np.add.reduceat(p, starts, axis=0, dtype=np.float64))
                if sums:
                    nll = np.concatenate(sums)
                    yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("mark"), b.column("lang"), pa.array(np.concatenate(sizes)), pa.array(nll[:, 0]), pa.array(nll[np.arange(len(nll)), 1 + fold])], ["doc_id", "mark", "lang", "n_events", "nll", "cross"])

        return rows.select("doc_id", "mark", "lang", "text", "fold").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, mark long, lang string, n_events long, nll double, cross double")

    send = rows.sparkSession.sparkContext.broadcast
    if count == 1:
        return scored(send(model.load(0)), 0)
    passes = []
    for k in range(count):
        shared = send(model.load(k))
        passes.append(saved(scored(shared, k), "passes"))
        shared.unpersist()
    # equal rows have equal parts: their sums are divided among them again
    out = functools.reduce(DataFrame.union, passes).groupBy("doc_id", "mark", "lang", "n_events").agg((F.count("*") / count).alias("rows"), F.sum("nll").alias("nll"), F.sum("cross").alias("cross"))
    out = out.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return out.select("doc_id", "mark", "lang", "n_events", (F.col("nll") / F.col("rows")).alias("nll"), (F.col("cross") / F.col("rows")).alias("cross"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.998, prior: float = 100.0, least: int = 200, symbols: int | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: ``doc_id, mark`` (a hash of the text), ``lang, n_events, perplexity``
    (per event, of the text alone), ``level``, ``threshold`` (as perplexities) and
    ``keep`` (0 or 1)."""
    fold = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int")
    rows = texts(docs, id_col, text_col, lang=F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(""))).withColumn("mark", F.xxhash64("text")).withColumn("fold", fold)
    good_ids = trusted_ids(labels.select("doc_id", "quality"))
    model = train(saved(rows.select("doc_id", "text", "fold").join(good_ids.hint("merge"), "doc_id", "left_semi").select("text", "fold"), "trusted", "zstd"), symbols)
    if model is None:
        return rows.select("doc_id", "mark", "lang", (F.length("text") + 1).cast("long").alias("n_events"), F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("level"), F.lit(None).cast("double").alias("threshold"), F.lit(1).alias("keep"))
    scored = saved(levels(rows, model), "levels")
    good = scored.join(good_ids, "doc_id", "left_semi")
    # per language: the mean level of trusted text, and a histogram of levels
    means = good.groupBy("lang").agg((F.sum("cross") / F.sum("n_events")).alias("mean"))
    mean_all = good.agg(F.sum("cross") / F.sum("n_events")).first()[0]
    level = lambda nll: (F.col(nll) + prior * F.coalesce("mean", F.lit(mean_all))) / (F.col("n_events") + prior)
    small = bounded_broadcast(means, means.count())  # a row per language
    bins = good.join(small, "lang", "left").select("lang", F.floor(level("cross") * BINS).alias("bin")).groupBy("lang", "bin").count().toPandas()  # languages x bins
    limits = thresholds(bins, quantile, least)
    shared = F.lit(limits.pop(None))
    known = pd.DataFrame({"lang": list(limits), "limit": list(limits.values())})
    table = small if not limits else small.join(docs.sparkSession.createDataFrame(known), "lang", "left")
    if not limits:
        table = table.withColumn("limit", F.lit(None).cast("double"))
    out = scored.join(bounded_broadcast(table, len(bins)), "lang", "left").withColumn("level", level("nll")).withColumn("limit", F.coalesce("limit", shared))
    return out.select("doc_id", "mark", "lang", "n_events", F.exp(F.col("nll") / F.col("n_events")).alias("perplexity"), F.exp("level").alias("level"), F.exp("limit").alias("threshold"), ((F.col("level") <= F.col("limit")) | (F.col("n_events") == 1)).cast("int").alias("keep"))


def thresholds(bins: pd.DataFrame, quantile: float, least: int) -> dict:
    """The upper edge of the bin that holds the quantile: of each language with
    enough trusted documents, and (None) of all."""
    def edge(part: pd.DataFrame) -> float:
        part = part.groupby("bin")["count"].sum().sort_index()
        k = int((part.cumsum() >= math.ceil(quantile * part.sum())).to_numpy().argmax())
        return (part.index[k] + 1) / BINS

    out: dict = {None: edge(bins)}
    for lang, part in bins.groupby("lang"):
        if part["count"].sum() >= least:
            out[lang] = edge(part)
    return out


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``documents`` rows that the classifier keeps (a row goes with its text:
    rows that repeat an id are told apart)."""
    bad = classify(docs, labels, **options).where("keep = 0").select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark")).distinct()
    same = docs["doc_id"].eqNullSafe(bad["__id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == bad["__mark"])
    return docs.join(bad, same, "left_anti")
