"""Language-model scoring with a hierarchical Pitman-Yor model.

Tokens are the lower-cased words of a text and one end.  A token is drawn in
the restaurant of its context, the word before it (the end of a text stands for
the start of the next).  All context restaurants share one parent, the unigram
restaurant, in which each known word has one table and whose base measure is
diffuse: the mass it keeps for new tables is the probability of a word never
seen.  So in context ``u``

    p(w | u) = (c_uw - d t_uw) / (a + c_u) + (a + d T_u) / (a + c_u) p(w)
    p(w)     = (T_w - d' ) / (a' + T)          p(new) = (a' + d' V) / (a' + T)

with ``c`` customers and ``t`` tables (``T`` their sums).  Gibbs sampling seats the
customers: a customer leaves (its table closes with the probability, a ratio of
generalised Stirling numbers, that it sat alone) and sits down again, at an old
table or a new one that sends a customer to the parent.  Pairs of context and
word with more than ``EXACT`` customers are reseated as a whole, in blocks of
customers over which the probability of a new table is held; so are, for a word
of many contexts, blocks of its pairs.  A sweep visits all words; the tables per
context and in all of the sweep before are held while it runs.  Predictive
probabilities are averaged over the sweeps after the burn-in.

On the cluster: words are dealt by hash into parts, as many as the text's size
asks for.  One pass codes the documents in chunks of bounded size.  The parts
number their words, the chunks count their pairs by these numbers, and the counts
of a part's words meet in one row.  A pair with one customer has one table, so a
sweep carries only pairs with more.  The tables of a context are spread over the
parts of the words that follow it: each part sends what it has to the part of the
context's own word, which adds it up and answers.  At the end the parts answer the
chunks with what their words need, and each chunk scores its documents.  Nothing
but sums over all contexts goes through the driver.

Edge cases: null text counts as empty (one token, the end); a null id is not
held out; repeated rows are each learned from and scored; without training
text every token is new and has probability 1.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import block_count, drop_folder, release_shuffles, saved, scratch, stored, texts

EXACT = 32
#: Contexts of a word that are reseated one by one; later ones in blocks, of one for so
#: many before them.
CONTEXTS = 8
#: Tokens of a chunk, and bytes of text for each part of the words.
CHUNK_TOKENS = 4_000_000
PART_BYTES = 24 << 20
#: Documents in a row of a chunk.
ROW_DOCS = 1000
#: The end of a text stands as the empty word.
END = b""


# --- arrays of numbers as one compressed value


def narrow(a: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 on in the narrowest type that holds them."""
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))


def shut(*arrays: np.ndarray) -> bytes:
    arrays = [narrow(a) for a in arrays]
    head = json.dumps([[a.dtype.str, len(a)] for a in arrays]).encode()
    return zstandard.compress(len(head).to_bytes(4, "little") + head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), 3)


def opened(value) -> list[np.ndarray]:
    raw = zstandard.decompress(bytes(value))
    at = 4 + int.from_bytes(raw[:4], "little")
    out = []
    for kind, n in json.loads(raw[4:at]):
        dtype = np.dtype(kind)
        out.append(np.frombuffer(raw, dtype=dtype, count=n, offset=at))
        at += n * dtype.itemsize
    return out


def shut_words(words: list[bytes]) -> bytes:
    return zstandard.compress(b"\n".join(words), 3)  # words hold no white space


def opened_words(value) -> list[bytes]:
    return zstandard.decompress(bytes(value)).split(b"\n")


def spans(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``n`` positions from each of ``starts``, one after another."""
    return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of ``keys`` in order and the place of each key's value, as
    ``np.unique`` with its inverse, in half the memory."""
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(keys), dtype=bool)
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    keys = keys[new]
    rank = np.cumsum(new, dtype=np.int32)
    rank -= 1
    of = np.empty(len(new), dtype=np.int32)
    of[order] = rank
    return keys, of


# --- coding, numbering and counting


class Chunk:
    """Documents coded with the chunk's own word numbers."""

    def __init__(self):
        self.ids: dict[bytes, int] = {END: 0}
        self.docs: list[tuple] = []
        self.n = 0

    def add(self, doc_id, held: bool, text: bytes) -> None:
        words = text.lower().split()
        ids = self.ids
        for w in set(words).difference(ids):
            ids[w] = len(ids)
        code = np.fromiter(map(ids.__getitem__, words), dtype=np.int32, count=len(words))
        self.docs.append((doc_id, held, np.append(code, np.int32(0))))
        self.n += len(code) + 1


CODED = "chunk long, doc_ids array<{id}>, held array<boolean>, codes binary, part int, words binary, ids binary"
_CODED_NAMES = [f.split(" ")[0] for f in CODED.split(", ")]


def coded(rows: DataFrame, chunk_tokens: int, parts: int) -> DataFrame:
    """Rows of documents (``codes``) and rows of words (``part``) of each chunk."""
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        task, k, chunk, arrow = TaskContext.get().partitionId(), 0, Chunk(), None
        for b in batches:
            arrow = arrow or b.column("doc_id").type
            for doc_id, held, text in zip(b.column("doc_id").to_pylist(), b.column("held_out").to_pylist(), b.column("text").to_pylist()):
                chunk.add(doc_id, held, text)
                if chunk.n >= chunk_tokens:
                    yield from written(task << 24 | k, chunk, arrow)
                    k, chunk = k + 1, Chunk()
        if chunk.docs:
            yield from written(task << 24 | k, chunk, arrow)

    def row(number, arrow, doc_ids=None, held=None, codes=None, part=None, words=None, ids=None):
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([doc_ids], pa.list_(arrow)), pa.array([held], pa.list_(pa.bool_())), pa.array([codes], pa.binary()), pa.array([part], pa.int32()), pa.array([words], pa.binary()), pa.array([ids], pa.binary())], _CODED_NAMES)

    def written(number, chunk, arrow):
        for lo in range(0, len(chunk.docs), ROW_DOCS):
            some = chunk.docs[lo:lo + ROW_DOCS]
            yield row(number, arrow, [d[0] for d in some], [d[1] for d in some], shut(np.array([len(d[2]) for d in some]), np.concatenate([d[2] for d in some])))
        by_id = list(chunk.ids)
        part_of = np.fromiter((xxhash.xxh32_intdigest(w, 1) % parts for w in by_id), dtype=np.int64, count=len(by_id))
        order = np.argsort(part_of, kind="stable")
        cuts = np.searchsorted(part_of[order], np.arange(parts + 1))
        for part in np.unique(part_of).tolist():
            own = sorted(order[cuts[part]:cuts[part + 1]].tolist(), key=by_id.__getitem__)
            yield row(number, arrow, part=part, words=shut_words([by_id[i] for i in own]), ids=shut(np.array(own)))

    return rows.mapInArrow(run, CODED.format(id=id_type))


def numbered(words: DataFrame) -> DataFrame:
    """Per chunk and part the chunk's and the part's numbers of its words.  A part
    numbers its words in their order, so no draw depends on how chunks arrive."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        some = [opened_words(b) for b in rows["words"]]
        number = {w: i for i, w in enumerate(sorted(set().union(*some)))}
        own = [np.fromiter(map(number.__getitem__, x), dtype=np.int64, count=len(x)) for x in some]
        return pd.DataFrame({"chunk": rows["chunk"], "part": rows["part"], "ids": [shut(*opened(i), x) for i, x in zip(rows["ids"], own)]})

    return words.groupBy("part").applyInPandas(run, "chunk long, part int, ids binary")


def token_pairs(codes, ids: np.ndarray):
    """The tokens of rows of ``codes`` by the place of their word in ``ids``, the pairs
    they make with the token before (word, context) in order, each token's pair, and
    the sizes of the documents."""
    place = np.empty(len(ids), dtype=np.int32)
    place[ids] = np.arange(len(ids))
    read = [opened(x) for x in codes]
    sizes = np.concatenate([x[0] for x in read]).astype(np.int64)
    word = np.concatenate([place[x[1]] for x in read])
    del read
    key = word.astype(np.int64)
    key *= len(ids)
    # the token before the first of a document is the end of another
    key[1:] += word[:-1]
    key[:1] += place[0]
    pair, of = distinct(key)
    del key
    return word, (pair // len(ids)).astype(np.int32), (pair % len(ids)).astype(np.int32), of, sizes


def counted(docs: DataFrame, numbers: DataFrame, parts: int) -> DataFrame:
    """What each chunk has for each part: its words (the chunk's and the part's numbers),
    pairs per word, and of each pair the context and how often it is learned from."""
    def run(d: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        if not len(d):
            return pd.DataFrame(columns=["chunk", "part", "asked"], dtype=object)
        a = a.sort_values("part")
        got = [opened(x) for x in a["ids"]]
        ids = np.concatenate([x[0] for x in got])
        name = np.concatenate([x[1].astype(np.int64) * parts + p for x, p in zip(got, a["part"])])
        _, word, context, of, sizes = token_pairs(d["codes"], ids)
        train = np.repeat(~np.concatenate(d["held"].to_list()).astype(bool), sizes)
        count = np.bincount(of[train], minlength=len(word))
        per_word = np.bincount(word, minlength=len(ids))
        out, lo = [], 0
        cuts = np.append(0, np.cumsum(per_word))
        for (own, number), part in zip(got, a["part"]):
            hi = lo + len(own)
            at = slice(cuts[lo], cuts[hi])
            out.append((d["chunk"].iloc[0], part, shut(own, number, per_word[lo:hi], name[context[at]], count[at])))
            lo = hi
        return pd.DataFrame(out, columns=["chunk", "part", "asked"])

    return docs.groupBy("chunk").cogroup(numbers.groupBy("chunk")).applyInPandas(run, "chunk long, part int, asked binary")


# --- restaurants

#: Per part a row of its pairs (``fixed``: customers and pairs per word, and the contexts
#: and customers of the pairs) with sums, and per chunk a row of the pairs it asked for
#: (``asked``: as in :func:`counted`, whether each is known, and the steps between the known).
PAIRS = "part int, chunk long, asked binary, fixed binary, tokens long, n_words long, n_pairs long, few array<long>"
_PAIRS_NAMES = [f.split(" ")[0] for f in PAIRS.split(", ")]
#: A row per part: words with pairs of more than one customer (numbers, such pairs, other
#: pairs) and these pairs (place of the context, customers); the contexts (part and
#: number, and in how many pairs each occurs anywhere); tables past the first of each
#: pair; their sums over the samples, per pair and (for each sample) per word.
STATE = "part int, pairs binary, contexts binary, more binary, means binary, n_more long"
_STATE_NAMES = [f.split(" ")[0] for f in STATE.split(", ")]


@dataclass
class Sums:
    """Customers and tables per context, words, and how many pairs (words) have one
    and two customers (tables); ``all_tables`` if these are not all contexts."""

    customers: np.ndarray
    tables: np.ndarray
    words: int
    few: np.ndarray
    all_tables: int | None = None

    @property
    def total(self) -> int:
        return int(self.tables.sum()) if self.all_tables is None else self.all_tables


#: A context as one number, its part first.
HOME = 44
LOW = (1 << HOME) - 1


def by_home(context: np.ndarray, parts: int) -> np.ndarray:
    return context % parts << HOME | context // parts


def merged(asked: DataFrame, parts: int) -> DataFrame:
    """The pairs of each part that the training text holds, and where a chunk's are."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        got = [opened(b) for b in rows["asked"]]
        # contexts in the order in which chunks hold them: by part, then number
        names, place = distinct(by_home(np.concatenate([g[3] for g in got]).astype(np.int64), parts))
        places = np.split(place, np.cumsum([len(g[3]) for g in got])[:-1])
        keys = [np.repeat(number.astype(np.int64), pairs) * len(names) + at for (_, number, pairs, *_), at in zip(got, places)]
        del place, places
        learned = [g[4] > 0 for g in got]
        key, of = distinct(np.concatenate([k[x] for k, x in zip(keys, learned)]))
        count = np.bincount(of, np.concatenate([g[4][x] for g, x in zip(got, learned)]), minlength=len(key)).astype(np.int64)
        del of
        part, out = rows["part"].iloc[0], []
        for chunk, k, (ids, number, pairs, _, _) in zip(rows["chunk"], keys, got):
            at = np.searchsorted(key, k)
            known = key[np.minimum(at, len(key) - 1)] == k if len(key) else np.zeros(len(k), dtype=bool)
            step = np.diff(at[known], prepend=0)
            out.append((part, chunk, shut(ids, number, pairs, known, step), None, None, None, None, None))
        word, n = key // len(names), max(int(g[1].max()) for g in got) + 1
        name = names[key % len(names)]
        pairs = np.bincount(word, minlength=n)
        few = [int((count == 1).sum()), int((count == 2).sum()), int((pairs == 1).sum()), int((pairs == 2).sum())]
        fixed = shut(np.bincount(word, count, minlength=n).astype(np.int64), pairs, (name & LOW) * parts + (name >> HOME), count)
        out.append((part, None, None, fixed, int(count.sum()), int((pairs > 0).sum()), len(key), few))
        return pd.DataFrame(out, columns=_PAIRS_NAMES, dtype=object)

    return asked.groupBy("part").applyInPandas(run, PAIRS)


def gathered(pairs: DataFrame) -> Sums:
    """Sums over the parts."""
    r = pairs.agg(F.sum("tokens"), F.sum("n_words"), F.sum("n_pairs"), *[F.sum(F.col("few")[i]) for i in range(4)]).first()
    tokens, words, n_pairs, *few = (x or 0 for x in r)
    return Sums(np.array([tokens]), np.array([n_pairs]), words, np.array(few))


#: Numbers for the words (``ids``) of part ``home`` as contexts; those ``wanted`` get the sums.
SENT = "home int, part int, ids binary, numbers binary, wanted binary"
_SENT_NAMES = [f.split(" ")[0] for f in SENT.split(", ")]
MET = "home int, part int, numbers binary"


def sent(part: int, home, ids, numbers, wanted) -> pa.RecordBatch:
    """A row for each home (``home`` ascending)."""
    homes, lo = np.unique(home, return_index=True)
    cuts = np.append(lo, len(home))
    rows = [(int(h), part, *(shut(x[cuts[i]:cuts[i + 1]]) for x in (ids, numbers, wanted))) for i, h in enumerate(homes)]
    return pa.RecordBatch.from_pylist([dict(zip(_SENT_NAMES, r)) for r in rows], schema=pa.schema([("home", pa.int32()), ("part", pa.int32()), ("ids", pa.binary()), ("numbers", pa.binary()), ("wanted", pa.binary())]))


def met(rows: DataFrame) -> DataFrame:
    """The sums of what was sent for each context: all of a home (``part`` is null), and
    for each sender those it wanted, in its order."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        home, (ids, numbers, wanted) = rows["home"].iloc[0], ([opened(x)[0].astype(np.int64) for x in rows[c]] for c in _SENT_NAMES[2:])
        total = np.bincount(np.concatenate(ids), np.concatenate(numbers)).astype(np.int64)
        out = [(home, p, shut(total[i[w > 0]])) for p, i, w in zip(rows["part"], ids, wanted)]
        return pd.DataFrame([(home, None, shut(total)), *out], columns=["home", "part", "numbers"]).astype({"part": "Int32"})

    return rows.groupBy("home").applyInPandas(run, MET)


def replies(met_rows: pd.DataFrame) -> np.ndarray:
    """What the homes answered a part, in the order of its contexts."""
    got = [opened(x)[0].astype(np.int64) for x in met_rows.sort_values("home")["numbers"]]
    return np.concatenate([np.zeros(0, np.int64), *got])


def context_pairs(pairs: DataFrame, parts: int) -> DataFrame:
    """In how many pairs each context occurs."""
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                _, _, context, count = opened(r["fixed"])
                key = by_home(context.astype(np.int64), parts)
                order = np.argsort(key, kind="stable")
                key = key[order]
                lo = np.flatnonzero(np.diff(key, prepend=-1))
                if len(lo):
                    wanted = np.maximum.reduceat((count > 1)[order].astype(np.int64), lo)
                    yield sent(r["part"], key[lo] >> HOME, key[lo] & LOW, np.diff(np.append(lo, len(key))), wanted)

    return met(pairs.where("fixed is not null").select("part", "fixed").mapInArrow(run, SENT))


def seating(pairs: DataFrame, bases: DataFrame, parts: int) -> DataFrame:
    """One table per pair."""
    def run(rows: pd.DataFrame, base: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=_STATE_NAMES, dtype=object)
        _, pairs, context, count = (x.astype(np.int64) for x in opened(rows["fixed"].iloc[0]))
        word, many = np.repeat(np.arange(len(pairs)), pairs), count > 1
        words, own = np.unique(word[many], return_counts=True)
        key, place = np.unique(by_home(context[many], parts), return_inverse=True)
        none = np.zeros(int(many.sum()), np.int64)
        return pd.DataFrame([(rows["part"].iloc[0], shut(words, own, pairs[words] - own, place, count[many]), shut(key >> HOME, key & LOW, replies(base)), shut(none), shut(), 0)], columns=_STATE_NAMES)

    fixed = pairs.where("fixed is not null").select("part", "fixed")
    return fixed.groupBy("part").cogroup(bases.where("part is not null").groupBy("part")).applyInPandas(run, STATE)


def context_tables(state: DataFrame) -> DataFrame:
    """Tables past the first of each pair, by context."""
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                place, (home, ids, _) = opened(r["pairs"])[3], opened(r["contexts"])
                if len(home):
                    more = np.bincount(place, opened(r["more"])[0], minlength=len(home)).astype(np.int64)
                    yield sent(r["part"], home, ids, more, np.ones(len(home), np.int64))

    return met(state.select("part", "pairs", "contexts", "more").mapInArrow(run, SENT))


@dataclass
class Prior:
    discount: float
    strength: float
    root_discount: float
    root_strength: float


def prior_of(s: Sums, strength: float, root_strength: float) -> Prior:
    """Discounts from how many pairs and words occur once and twice."""
    d = lambda a, b: min(0.95, max(0.05, a / (a + 2 * b))) if a else 0.5
    return Prior(d(*s.few[:2]), strength, d(*s.few[2:]), root_strength)


def alone_table(discount: float, most: int = EXACT) -> np.ndarray:
    """``[c, t]``: the probability that one of ``c`` customers at ``t`` tables sits
    alone, S(c-1, t-1) / S(c, t) with generalised Stirling numbers."""
    s = np.zeros((most + 1, most + 1))
    s[0, 0] = 1.0
    for c in range(1, most + 1):
        t = np.arange(1, c + 1)
        s[c, 1:c + 1] = s[c - 1, :c] + (c - 1 - discount * t) * np.where(t <= c - 1, s[c - 1, 1:c + 1], 0.0)
        s[c] = np.maximum(s[c], 0.0)
    out = np.zeros_like(s)
    for c in range(1, most + 1):
        out[c, 1:c + 1] = s[c - 1, :c] / np.where(s[c, 1:c + 1] > 0, s[c, 1:c + 1], 1.0)
    return out


def seat(context, count, tables, starts, pairs, sums: Sums, prior: Prior, rng, others=0) -> np.ndarray:
    """One sweep over the pairs of some words (those of a word lie together,
    ``pairs`` of them from ``starts``; each word has ``others`` tables besides);
    returns the new numbers of tables."""
    d, a, d0, a0 = prior.discount, prior.strength, prior.root_discount, prior.root_strength
    alone = alone_table(d)
    tables = tables.astype(np.int64).copy()
    word_tables = (np.add.reduceat(tables, starts) if len(starts) else np.zeros(0, np.int64)) + others
    all_tables = float(sums.total)
    in_context = sums.tables.astype(np.float64)

    def weight(u, at_word, gone):
        """Of a new table, when ``gone`` tables of the pair are closed."""
        return (a + d * (in_context[u] - gone)) * np.maximum(at_word - d0, 0.0) / (a0 + all_tables - gone)

    done, own = np.zeros(len(pairs), np.int64), np.flatnonzero(pairs > 0)
    while len(own):
        step = np.minimum(np.maximum(1, done[own] // CONTEXTS), pairs[own] - done[own])
        at, word = spans(starts[own] + done[own], step), np.repeat(own, step)
        done[own] += step
        own = own[done[own] < pairs[own]]
        c = count[at]
        few = np.flatnonzero((c > 1) & (c <= EXACT))
        w, i = word[few], at[few]
        u, c, t0 = context[i], count[i], tables[i]
        t, tw = t0.copy(), word_tables[w].copy()
        for r in range(int(c.max()) if len(c) else 0):
            live = np.flatnonzero(c > r)
            cl, tl = c[live], t[live]
            left = (rng.random(len(live)) < alone[cl, tl]).astype(np.int64)
            tl, twl = tl - left, tw[live] - left
            p = weight(u[live], twl, t0[live] - tl)
            new = rng.random(len(live)) * (p + cl - 1 - d * tl) < p
            t[live], tw[live] = tl + new, twl + new
        tables[i] = t
        np.add.at(word_tables, w, t - t0)
        many = np.flatnonzero(count[at] > EXACT)
        if len(many):
            w, i = word[many], at[many]
            u, c, t0 = context[i], count[i], tables[i]
            rest = word_tables[w] - t0
            t, n = np.ones(len(i), dtype=np.int64), np.ones(len(i), dtype=np.int64)
            while True:
                live = np.flatnonzero(n < c)
                if not len(live):
                    break
                step = np.minimum(np.maximum(1, n[live] // 32), c[live] - n[live])
                p = weight(u[live], rest[live] + t[live], t0[live] - t[live])
                t[live] += rng.binomial(step, np.clip(p / (p + n[live] - d * t[live]), 0.0, 1.0))
                n[live] += step
            tables[i] = t
            np.add.at(word_tables, w, t - t0)
    return tables


def root_probability(word_tables, sums: Sums, prior: Prior):
    return (word_tables - prior.root_discount) / (prior.root_strength + sums.total)


def sweep(state: DataFrame, tables: DataFrame | None, sums: Sums, prior: Prior, number: int, seed: int, keep: bool) -> DataFrame:
    """All words reseated; ``tables`` are those of :func:`context_tables` of this state
    (None: one per pair).  With ``keep`` the new state is a sample: it is added to the sums."""
    def run(rows: pd.DataFrame, met_rows: pd.DataFrame | None = None) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=_STATE_NAMES, dtype=object)
        r = rows.iloc[0].to_dict()
        _, own, others, place, count = (x.astype(np.int64) for x in opened(r["pairs"]))
        base, more = opened(r["contexts"])[2].astype(np.int64), opened(r["more"])[0].astype(np.int64)
        if met_rows is not None:
            base = base + replies(met_rows)
        here = Sums(sums.customers, base, sums.words, sums.few, sums.total)
        starts = np.cumsum(own) - own
        more = seat(place, count, more + 1, starts, own, here, prior, np.random.default_rng([seed, number, r["part"]]), others) - 1
        if keep:
            old = opened(r["means"])
            of_word = (np.add.reduceat(more, starts) if len(starts) else more)[:, None]
            all_of = np.concatenate([old[1].reshape(len(own), len(old[1]) // max(1, len(own))).astype(np.int64), of_word], axis=1) if old else of_word
            r["means"] = shut(old[0] + more if old else more, all_of.ravel())
        r["more"], r["n_more"] = shut(more), int(more.sum())
        return pd.DataFrame([r], columns=_STATE_NAMES)

    if tables is None:
        return state.groupBy("part").applyInPandas(lambda rows: run(rows), STATE)
    return state.groupBy("part").cogroup(tables.where("part is not null").groupBy("part")).applyInPandas(run, STATE)


# --- scoring


def answered(pairs: DataFrame, known: DataFrame, samples: int) -> DataFrame:
    """What each chunk needs of each part (whole numbers): the chunk's numbers of the
    words, their customers and pairs, whether each pair is known, customers and summed
    tables of the known; and of known words, for each sample, their tables and the
    tables in their restaurant.  ``known`` holds per part the last state (``kind`` -2),
    the pairs (-1) and further tables (sample) of its words as contexts."""
    def run(rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=["chunk", "part", "answer"], dtype=object)
        total, pairs, _, count = (x.astype(np.int64) for x in opened(rows.loc[rows["fixed"].notna(), "fixed"].iloc[0]))
        tables = np.full(len(count), samples)
        roots, contexts = (np.zeros((len(total), samples), np.int64) for _ in range(2))
        roots += pairs[:, None]
        for kind, a, b in zip(known["kind"], known["a"], known["b"]):
            if kind == -2 and samples:
                words, (more, of_word) = opened(a)[0], opened(b)
                tables[count > 1] += more
                roots[words] += of_word.reshape(len(words), samples)
            elif kind != -2:
                x = opened(a)[0]
                contexts[:len(x), slice(None) if kind == -1 else kind] += x[:, None] if kind == -1 else x
        out = []
        for chunk, blob in zip(rows["chunk"], rows["asked"]):
            if blob is None:
                continue
            ids, number, n, hit, step = opened(blob)
            at, c = np.cumsum(step.astype(np.int64)), total[number]
            own = number[c > 0]
            out.append((chunk, rows["part"].iloc[0], shut(ids, c, n, hit, count[at], tables[at], roots[own].ravel(), contexts[own].ravel())))
        return pd.DataFrame(out, columns=["chunk", "part", "answer"])

    asked = pairs.select("part", "chunk", "asked", "fixed")
    return asked.groupBy("part").cogroup(known.groupBy("part")).applyInPandas(run, "chunk long, part int, answer binary")


def scored(docs: DataFrame, answers: DataFrame, first: Sums, prior: Prior, all_tables: list[int]) -> DataFrame:
    """Every document of each chunk under the averaged probabilities; ``all_tables``
    of each sample."""
    samples, tokens = len(all_tables), int(first.customers.sum())
    scale = tokens + 0.5 * (first.words + 1)
    every = prior.root_strength + np.array(all_tables, dtype=np.float64)
    id_type = docs.schema["doc_ids"].dataType.elementType.simpleString()
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(d: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        if not len(d):
            return pd.DataFrame(columns=names, dtype=object)
        got = [opened(x) for x in a.sort_values("part")["answer"]]
        ids, c, _, hit, count, tables, roots, contexts = (np.concatenate(x) for x in zip(*got))
        c, known = c.astype(np.int64), c > 0
        word, w, u, of, sizes = token_pairs(d["codes"], ids)
        p = np.ones(len(w))
        if samples:
            # a word never seen has what the parent keeps for new words, and no restaurant
            root = np.tile((prior.root_strength + prior.root_discount * first.words) / every, (len(c), 1))
            root[known] = (roots.reshape(-1, samples) - prior.root_discount) / every
            back = np.ones((len(c), samples))
            back[known] = (prior.strength + prior.discount * contexts.reshape(-1, samples)) / (prior.strength + c[known, None])
            p[:] = 0.0
            for s in range(samples):
                x = root[w, s]
                x *= back[u, s]
                p += x
            p /= samples
            del x, w
            hit = hit > 0
            p[hit] += (count - prior.discount * tables / samples) / (prior.strength + c[u[hit]])
        starts = np.cumsum(sizes) - sizes
        base, logp = np.log10((c + 0.5) / scale), np.log10(p)
        out = pd.DataFrame({"doc_id": [x for some in d["doc_ids"] for x in some], "held_out": np.concatenate(d["held"].to_list()).astype(bool), "n_tokens": sizes, "n_known": np.add.reduceat(known[word], starts, dtype=np.int64), "train_tokens": tokens, "base_score": np.add.reduceat(base[word], starts), "score": np.add.reduceat(logp[of], starts)})
        if id_type in ("tinyint", "smallint", "int", "bigint"):
            out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    schema = f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    answers = answers.toDF(*answers.columns)
    return docs.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(run, schema)


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", burn_in: int = 2, samples: int = 3, strength: float = 1.0, root_strength: float = 1.0, seed: int = 0, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of
    every row; ``held_out`` is over ``doc_id``.  Scores are log10 probabilities;
    ``10 ** (-score / n_tokens)`` is the perplexity."""
    rows = texts(docs, id_col, text_col)
    spark = rows.sparkSession
    rows = rows.select("doc_id", held_out.alias("held_out"), F.col("text").cast("binary").alias("text"))
    parts = block_count(rows, PART_BYTES)
    table = saved(coded(rows, chunk_tokens, parts), "coded")
    codes = table.where("codes is not null").select("chunk", "doc_ids", "held", "codes")
    numbers = numbered(table.where("part is not null").select("chunk", "part", "words", "ids"))
    pairs = saved(merged(counted(codes.select("chunk", "held", "codes"), numbers, parts), parts), "pairs")
    release_shuffles(spark)
    first = gathered(pairs)
    prior = prior_of(first, strength, root_strength)
    bases = saved(context_pairs(pairs, parts), "contexts")
    old = scratch(spark, "seating")
    state = stored(seating(pairs, bases, parts), old)
    here, tables, kept = first, None, []
    for k in range(burn_in + samples if first.words else 0):
        new = scratch(spark, "seating")
        state = stored(sweep(state, tables, here, prior, k, seed, k >= burn_in), new)
        drop_folder(spark, old)
        old = new
        here = Sums(first.customers, first.tables, first.words, first.few, first.total + (state.agg(F.sum("n_more")).first()[0] or 0))
        tables = saved(context_tables(state), "tables")
        release_shuffles(spark)
        if k >= burn_in:
            kept.append((tables, here.total))
    nothing = F.lit(None).cast("binary")
    known = state.select("part", F.lit(-2).alias("kind"), F.col("pairs").alias("a"), F.col("means").alias("b"))
    for k, x in enumerate([bases, *[t for t, _ in kept]]):
        known = known.unionByName(x.where("part is null").select(F.col("home").alias("part"), F.lit(k - 1).alias("kind"), F.col("numbers").alias("a"), nothing.alias("b")))
    return scored(codes, answered(pairs, known, len(kept)), first, prior, [n for _, n in kept])
