"""Operators 2, 4 and 8: against direct computations and held-out accuracy."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from countmix.llm import hpylm, kneser_ney, zdict
from countmix.llm.common import held_out

SF = "/root/testdata/sf0.01"


def prose(rnd, n, syllables):
    return " ".join("".join(rnd.choice(syllables) for _ in range(rnd.randrange(1, 4))) for _ in range(n))


# --- Kneser-Ney


def test_kneser_ney_equals_recursion():
    rnd, size = random.Random(1), 5
    texts = ["".join(rnd.choice("abcab") for _ in range(rnd.randrange(40))) for _ in range(50)] + ["", "zzz", "a😀b"]
    lut = kneser_ney.symbol_table(list("abc"))
    key, starts = kneser_ney.events(texts, lut, size)
    grams, want_starts = [], []
    for t in texts:
        x = [0, 0, 0] + [{"a": 2, "b": 3, "c": 4}.get(c, 1) for c in t] + [0]
        want_starts.append(len(grams))
        grams += [tuple(x[i - 3:i + 1]) for i in range(3, len(x))]
    assert key.tolist() == [((a * size + b) * size + c) * size + d for a, b, c, d in grams]
    assert starts.tolist() == want_starts
    p = np.exp(kneser_ney.probabilities(*np.unique(key, return_counts=True), size).astype(float)).reshape((size,) * 4)
    assert np.allclose(p.sum(axis=-1), 1, atol=1e-5)
    count = {4: Counter(grams)}
    for n in (3, 2, 1):
        count[n] = Counter(g[1:] for g in count[n + 1])

    def discount(n, c):
        of = Counter(count[n].values())
        k, y = min(c, 3), of[1] / (of[1] + 2 * of[2]) if of[1] else 0
        return min(k, max(0, k - (k + 1) * y * of[k + 1] / of[k])) if of[k] else 0

    def prob(g):
        if not g:
            return 1 / size
        same = {h: c for h, c in count[len(g)].items() if h[:-1] == g[:-1]}
        if not same:
            return prob(g[1:])
        left = sum(discount(len(g), c) for c in same.values())
        c = count[len(g)].get(g, 0)
        return (c - (discount(len(g), c) if c else 0) + left * prob(g[1:])) / sum(same.values())

    for g in itertools.islice(itertools.product(range(size), repeat=4), 0, None, 7):
        assert abs(prob(g) - p[g]) < 1e-6


def quality_tables(spark):
    rnd = random.Random(2)
    en, de = ["th", "er", "on", "an", "re"], ["sch", "ung", "ein", "ä", "ch"]
    rows, labels = [], []
    for i in range(300):
        lang = ["en", "de"][i % 2]
        junk = i % 10 == 0
        t = prose(rnd, rnd.randrange(20, 80), [en, de][i % 2])
        rows.append((i, t.upper().replace(" ", "!! ") if junk else t, lang, i))
        if i % 3:
            labels.append((i, 0 if junk else 1, 0))
    rows += [(1000, None, None, 0), (1001, "", "en", 0), (1002, "th" * 20000, "xx", 0), (None, "thon eran", "en", 0), rows[4]]
    labels += [(4, 1, 0), (None, 1, 0), (2, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, nll int")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_classifier(spark):
    docs, labels = quality_tables(spark)
    got = kneser_ney.classify(docs, labels, least=20).collect()
    assert len(got) == docs.count()
    keep = {r.doc_id: r.keep for r in got}
    junk = [i for i in range(300) if i % 10 == 0]
    assert sum(keep[i] for i in junk) == 0
    assert np.mean([keep[i] for i in range(300) if i % 10]) > 0.97
    assert keep[1000] == keep[1001] == keep[None] == 1
    kept = kneser_ney.keep_good(docs, labels, least=20)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert len(rows) == sum(r.keep for r in got) and sum(r.doc_id == 4 for r in rows) == 2
    # no trusted text: everything stays
    assert {r.keep for r in kneser_ney.classify(docs, labels.where("false")).collect()} == {1}
    assert kneser_ney.classify(docs.where("false"), labels).count() == 0


def test_quality_held_out_on_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    train, test = labels.where(~held_out("doc_id", 0)), labels.where(held_out("doc_id", 0))
    rows = kneser_ney.classify(docs, train).join(test, "doc_id").collect()
    assert np.mean([r.keep for r in rows if r.quality == 1]) > 0.95
    assert np.mean([r.keep for r in rows if r.quality == 0]) < 0.3


def test_quality_learns_from_every_trusted_document(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(kneser_ney, "train", lambda trusted, symbols: seen.update(n=trusted.count(), texts=trusted.distinct().count()))
    n = 50_300
    docs = spark.range(n).selectExpr("id as doc_id", "concat('text ', id) as text", "'en' as lang")
    labels = spark.range(n).selectExpr("id as doc_id", "if(id % 1000 = 0, 0, 1) as quality")
    kneser_ney.classify(docs, labels)
    assert seen == {"n": n - 51, "texts": n - 51}


def script_tables(spark):
    rnd = random.Random(5)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"] + [(a + b).upper() for a in "cdhjqvwxyz" for b in "aeiou"]
    words = ["".join(chr(rnd.choice([0x4E00, 0x20000]) + rnd.randrange(200)) for _ in range(3)) for _ in range(120)]
    rows = [(i, prose(rnd, 40, syllables), "en") for i in range(400)]
    for i in range(1000, 1300):
        t = " ".join(rnd.choice(words) for _ in range(40))
        rows.append((i, t, "zh"))
        if i >= 1150:  # the same letters in another order
            letters = "".join(rnd.sample(t.replace(" ", ""), 120))
            rows.append((i + 1000, " ".join(letters[k:k + 3] for k in range(0, 120, 3)), "zh"))
    labels = [(i, 1) for i, _, _ in rows if i < 1150]
    rows += [rows[0], rows[500], (None, rows[1][1], "en"), (3000, "\u0416" * 50, "zh")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_quality_knows_every_character(spark):
    docs, labels = script_tables(spark)
    got = kneser_ney.classify(docs, labels, least=20).collect()
    assert len(got) == docs.count()
    assert np.mean([r.keep for r in got if r.doc_id is not None and (r.doc_id < 400 or 1150 <= r.doc_id < 1300)]) > 0.9
    assert np.mean([r.keep for r in got if r.doc_id is not None and r.doc_id >= 2150]) < 0.05


def test_quality_stage_keeps_words_of_every_script(spark):
    docs, labels = script_tables(spark)
    kept = {r.doc_id for r in kneser_ney.keep_good(docs, labels, least=20).collect()}
    assert len(kept & set(range(1150, 1300))) > 135
    assert len(kept & set(range(2150, 2300))) < 8


def test_quality_in_pieces(spark, monkeypatch):
    docs, labels = script_tables(spark)
    rows = lambda: sorted(((r.doc_id or -1, r.mark, r.n_events, r.keep), r.perplexity, r.level, r.threshold) for r in kneser_ney.classify(docs, labels, least=20).collect())
    whole = rows()
    monkeypatch.setattr(kneser_ney, "PIECE", 2000)
    some = rows()
    assert [r[0] for r in some] == [r[0] for r in whole]
    assert np.allclose([r[1:] for r in some], [r[1:] for r in whole], rtol=1e-5)


def test_quality_finds_by_table_and_search(monkeypatch):
    rnd = random.Random(6)
    chars = [chr(0x1F600 + i) for i in range(12)]
    lut = kneser_ney.symbol_table(chars)
    context, last, _ = kneser_ney.windows(["".join(rnd.choice(chars) for _ in range(rnd.randrange(60))) for _ in range(40)], lut, 14)
    assert set(last.tolist()) == set(range(14)) - {1}
    of = [context * 14 + last, np.ones(len(last), dtype=np.int64)]
    p = kneser_ney.probabilities(*of, 14)
    monkeypatch.setattr(kneser_ney, "CELLS", 0)
    assert np.array_equal(kneser_ney.probabilities(*of, 14), p)


# --- toxicity


def toxic_rows(n, seed):
    rnd = random.Random(seed)
    syllables = ["th", "er", "on", "an", "re", "in", "es", "ti", "ou", "ha"]
    out = []
    for i in range(n):
        w = prose(rnd, rnd.randrange(10, 120), syllables).split()
        toxic = rnd.random() < 0.3
        if toxic:
            for _ in range(rnd.randrange(2, 5)):
                w[rnd.randrange(len(w))] = rnd.choice(["wretched", "villain", "scoundrel", "knavish"])
        out.append((i, " ".join(w), int(toxic)))
    return out


def test_toxicity_held_out(spark):
    rows = toxic_rows(1500, 3)
    docs = spark.createDataFrame([r[:2] + (1,) for r in rows] + [(9000, None, 1), (9001, "", 1), (9002, "an " * 50000, 1), rows[0][:2] + (1,)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    model = zdict.train(docs, labels, ~held_out("doc_id", 0))
    got = zdict.score(docs, model).collect()
    assert len(got) == docs.count()
    truth = {r[0]: r[2] for r in rows}
    test = [r for r in got if r.doc_id < 9000 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([r.predicted == truth[r.doc_id] for r in test]) > 0.9
    by = {r.doc_id: r for r in got}
    assert by[9000].score == by[9001].score < 0.5 and by[9002].predicted == 0
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert zdict.score(docs.where("false"), model).count() == 0


def test_toxicity_sample_of_repeated_ids_and_bytes(spark):
    rows = toxic_rows(300, 5)
    odd = [(i, f"other text {i}", 1) for i in range(0, 300, 3)]  # an id on two texts
    docs = spark.createDataFrame([r[:2] + (1,) for r in rows] + odd, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    models = [zdict.train(d, labels, F.lit(True)) for d in (docs, docs.repartition(7, "text"))]
    assert models[0].toxic == models[1].toxic and models[0].ordinary == models[1].ordinary
    assert (models[0].weights == models[1].weights).all()
    few = zdict.train(docs, labels, F.lit(True), sample_bytes=1)  # one document a class
    assert few.weights is not None and few.share == models[0].share


def test_toxicity_without_a_class(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    for use, share in ((F.lit(True), 0.0), (F.lit(False), 0.5)):
        assert [r.score for r in zdict.score(docs, zdict.train(docs, labels, use)).collect()] == [share] * 2


def test_copies_do_not_make_words_telling():
    rnd = random.Random(7)
    plain = [prose(rnd, 40, ["th", "er", "on", "an"]).encode() for _ in range(200)]
    copy = b"thonerxx anqq erzz thww " + plain[0]
    assert zdict.telling_words([copy] * 50 + plain[:50], plain[50:]) == set()


# --- Pitman-Yor


def brute_base(rows):
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, (_, t) in enumerate(rows)}
    train = [i for i, (d, _) in enumerate(rows) if d is None or zlib.crc32(str(d).encode()) % 5 != 1]
    c = Counter(w for i in train for w in tokens[i])
    n, v = sum(c.values()), len(c)
    return {i: (len(w), sum(c[x] > 0 for x in w), n, sum(np.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)) for i, w in tokens.items()}


def test_pitman_yor_base_and_gain(spark):
    rnd = random.Random(4)
    en, de = ["th", "er", "on", "an", "re"], ["sch", "ung", "ein", "ä", "ch"]
    rows = [(i, prose(rnd, rnd.randrange(1, 90), [en, de][i % 2])) for i in range(400)] + [(500, None), (501, ""), (502, "Ä\x0bb\x1cc  d"), (503, "ther " * 4000), (None, "ther on"), (3, "again the same id"), (504, "ther"), (504, "ther")]
    df = spark.createDataFrame([r + (1,) for r in rows], "doc_id long, text string, word int")
    got = hpylm.score(df, held_out("doc_id", 1), chunk_tokens=700).collect()
    assert len(got) == len(rows)
    base = brute_base(rows)
    want = sorted((str(rows[i][0]), *b[:3], round(b[3], 6)) for i, b in base.items())
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {d for d, _ in rows if d is not None and zlib.crc32(str(d).encode()) % 5 == 1}
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 for r in got)
    assert hpylm.score(df.where("false"), held_out("doc_id", 1)).count() == 0
    only = hpylm.score(df.where("doc_id = 1"), F.lit(True)).collect()  # nothing to learn from
    assert [(r.n_known, r.train_tokens, r.score) for r in only] == [(0, 0, 0.0)]


def test_pitman_yor_chunks(spark):
    """Scores depend neither on how rows are dealt nor on the size of chunks, and
    a chunk may hold unseen pairs only."""
    rnd = random.Random(4)
    rows = [(i, prose(rnd, rnd.randrange(30), ["th", "er", "on", "an"])) for i in range(60)]
    rows += [(100 + i, None if i % 2 else "never seen") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = F.col("doc_id") >= 100
    want = {r.doc_id: (r.n_tokens, r.n_known, r.score) for r in hpylm.score(docs.coalesce(1), train).collect()}
    got = {r.doc_id: (r.n_tokens, r.n_known, r.score) for r in hpylm.score(docs.repartition(7), train, chunk_tokens=40).collect()}
    assert len(want) == len(rows) and got.keys() == want.keys()
    for k, (n, known, score) in want.items():
        assert got[k][:2] == (n, known) and got[k][2] == pytest.approx(score, abs=1e-9)
    alone = hpylm.score(docs.where("doc_id < 60 or doc_id = 101"), train, chunk_tokens=1).collect()
    assert len(alone) == 61 and all(r.score < 0 for r in alone)


def test_pitman_yor_contexts_are_the_words_before(spark, monkeypatch):
    """Every pair of words occurs once, so each has one table and the scores follow from
    the counts; words are dealt into many parts."""
    monkeypatch.setattr(hpylm, "PART_BYTES", 400)
    rnd = random.Random(8)
    vocab = [a + b for a in "bdfgklmnprst" for b in ("alo", "ino", "ta", "ino.")]
    used, texts = set(), []
    for i in range(40):
        words = []
        for _ in range(30):
            w = rnd.choice(vocab)
            pair = (words[-1] if words else "", w)
            if pair not in used and (w, "") not in used:
                words.append(w)
                used.add(pair)
        if words:
            used.add((words[-1], ""))
            texts.append(" ".join(words))
    train = [(i, t) for i, t in enumerate(texts)]
    other = [(100 + i, " ".join(rnd.choice([*vocab, "zz"]) for _ in range(rnd.randrange(12)))) for i in range(30)]
    docs = spark.createDataFrame(train + other, "doc_id long, text string")
    pairs = Counter((u, w) for _, t in train for u, w in zip([""] + t.split(), t.split() + [""]))
    assert set(pairs.values()) == {1} and len({u[-2:] for u in vocab}) == 4
    tables, customers = Counter(w for _, w in pairs), Counter(u for u, _ in pairs)
    few = Counter(tables.values())
    d, d0 = 0.95, min(0.95, max(0.05, few[1] / (few[1] + 2 * few[2]))) if few[1] else 0.5

    def prob(u, w):
        root = (tables[w] - d0 if w in tables else 1 + d0 * len(tables)) / (1 + len(pairs))
        return ((u, w) in pairs) * (1 - d) / (1 + customers[u]) + (1 + d * customers[u]) / (1 + customers[u]) * root

    got = {r.doc_id: r.score for r in hpylm.score(docs, F.col("doc_id") >= 100, chunk_tokens=50).collect()}
    for i, t in train + other:
        want = sum(np.log10(prob(u, w)) for u, w in zip([""] + t.split(), t.split() + [""]))
        assert got[i] == pytest.approx(want, abs=1e-9)


def test_pitman_yor_tables_of_contexts_meet(spark, monkeypatch):
    """In each sample the tables summed by context, those summed by word and their number
    agree, whatever parts hold them."""
    monkeypatch.setattr(hpylm, "PART_BYTES", 1000)
    rnd, seen, texts = random.Random(9), {}, hpylm.texts
    monkeypatch.setattr(hpylm, "texts", lambda *a: texts(*a).coalesce(1))  # one chunk asks for every word
    docs = spark.createDataFrame([(i, prose(rnd, rnd.randrange(40), ["th", "er", "on"])) for i in range(80)], "doc_id long, text string")
    monkeypatch.setattr(hpylm, "scored", lambda codes, answers, first, prior, totals: seen.update(rows=answers.collect(), first=first, totals=totals))
    hpylm.score(docs, F.lit(False))
    parts = [hpylm.opened(r.answer) for r in seen["rows"]]
    assert len(parts) > 3 and len(seen["totals"]) == 3 and min(seen["totals"]) > seen["first"].total
    for of in (6, 7):
        assert sum(p[of].reshape(-1, 3).sum(axis=0).astype(int) for p in parts).tolist() == seen["totals"]
    assert sum(p[4].sum() for p in parts) == sum(p[1].sum() for p in parts) == seen["first"].customers.sum()
    assert all((p[4] * 3 >= p[5]).all() and (p[5] >= 3).all() for p in parts)


def test_pairs_are_found_in_bounded_memory():
    """The tokens of a chunk take at most 40 bytes each while their pairs are found."""
    import tracemalloc

    rng = np.random.default_rng(3)
    sizes, ids = np.array([100_000, 1, 299_999]), rng.permutation(70_000)
    codes = np.minimum(rng.zipf(1.3, 400_000), 69_999)
    blob = [hpylm.shut(sizes[:2], codes[:100_001]), hpylm.shut(sizes[2:], codes[100_001:])]
    tracemalloc.start()
    word, w, u, of, got = hpylm.token_pairs(blob, ids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * len(codes)
    before = np.append(0, codes[:-1])
    assert (ids[word] == codes).all() and (ids[w[of]] == codes).all() and (ids[u[of]] == before).all()
    assert got.tolist() == sizes.tolist() and (np.diff(w.astype(np.int64) * len(ids) + u) > 0).all()
    values, at = hpylm.distinct(np.zeros(0, np.int64))
    assert len(values) == len(at) == 0


def test_predictive_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    pairs = rng.integers(1, 6, 50)
    starts = np.cumsum(pairs) - pairs
    context = np.concatenate([rng.choice(hpylm.CONTEXTS, k, replace=False) for k in pairs])
    count = rng.integers(1, 200, pairs.sum())
    add = lambda x: np.bincount(context, x, minlength=hpylm.CONTEXTS).astype(np.int64)
    tables = np.ones(len(count), dtype=np.int64)
    sums = hpylm.Sums(add(count), add(tables), 50, np.array([5, 3, 9, 9]))
    prior = hpylm.prior_of(sums, 1.0, 1.0)
    for _ in range(3):
        tables = hpylm.seat(context, count, tables, starts, pairs, sums, prior, rng)
        assert ((tables >= 1) & (tables <= count)).all()
        sums = hpylm.Sums(add(count), add(tables), 50, sums.few)
    root = hpylm.root_probability(np.add.reduceat(tables, starts), sums, prior)
    new = (prior.root_strength + prior.root_discount * 50) / (prior.root_strength + sums.tables.sum())
    assert abs(root.sum() + new - 1) < 1e-9
    back = (prior.strength + prior.discount * sums.tables) / (prior.strength + sums.customers)
    for u in range(hpylm.CONTEXTS):
        own = context == u
        seen = ((count - prior.discount * tables)[own] / (prior.strength + sums.customers[u])).sum()
        assert abs(seen + back[u] * (root.sum() + new) - 1) < 1e-9


def test_seating_has_the_posterior_of_tables():
    """One pair, everything else held: p(t) ~ S(c, t) d^... a weights."""
    c, reps = 4, 20000
    far = np.zeros(hpylm.CONTEXTS, np.int64)
    far[0], far[1] = c, 10_000  # the parent hardly notices
    sums = hpylm.Sums(far, np.where(far > 100, 5000, np.minimum(far, 1)), 50, np.array([1, 1, 1, 1]))
    prior = hpylm.Prior(0.5, 2000.0, 0.5, 1.0)
    context, count = np.tile([0, 1], reps), np.tile([c, 1], reps)
    # other tables of the word, held in a context with one customer per table
    tables, rng = np.ones(2 * reps, dtype=np.int64), np.random.default_rng(1)
    for _ in range(6):
        tables = hpylm.seat(context, count, tables, np.arange(0, 2 * reps, 2), np.full(reps, 2), sums, prior, rng)
    got = np.bincount(tables[::2], minlength=c + 1)[1:] / reps
    s = np.zeros((c + 1, c + 1))
    s[0, 0] = 1
    for n in range(1, c + 1):
        for t in range(1, n + 1):
            s[n, t] = s[n - 1, t - 1] + (n - 1 - prior.discount * t) * s[n - 1, t]
    # the joint weight of t tables: each further table adds its factor
    w = []
    total, own = float(sums.tables.sum()), float(sums.tables[0])
    for t in range(1, c + 1):
        f = s[c, t]
        for k in range(1, t):
            gone = 1 - k  # tables of the pair against those in the held sums
            f *= (prior.strength + prior.discount * (own - gone)) * (1 + k - prior.root_discount) / (prior.root_strength + total - gone)
        w.append(f)
    assert np.abs(got - np.array(w) / sum(w)).max() < 0.02


@pytest.mark.parametrize("n", [hpylm.EXACT + 1, 5000])
def test_blocked_seating_is_near_the_sequence(n):
    sums = hpylm.Sums(np.full(hpylm.CONTEXTS, 10_000), np.full(hpylm.CONTEXTS, 1000), 50, np.array([1, 1, 1, 1]))
    prior, reps = hpylm.Prior(0.6, 1.0, 0.5, 1.0), 400
    context, count = np.zeros(reps, np.int64), np.full(reps, n)
    got = hpylm.seat(context, count, np.ones(reps, np.int64), np.arange(reps), np.ones(reps, np.int64), sums, prior, np.random.default_rng(2))
    rng, want = np.random.default_rng(3), []
    total = float(sums.tables.sum())
    for _ in range(100):
        t = 1
        for k in range(1, n):
            gone = 1 - t
            p = (1 + 0.6 * (1000 - gone)) * (t - 0.5) / (1 + total - gone)
            t += rng.random() < p / (p + k - 0.6 * t)
        want.append(t)
    assert abs(got.mean() - np.mean(want)) < 4 * np.std(want) / 10 + 0.05 * np.mean(want)
