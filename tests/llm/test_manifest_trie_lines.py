"""Operators 11, 12, 13 against plain loops, with odd rows."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from countmix.llm import line_dedup, merkle, prefix_trie  # noqa: E402


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ------------------------------------------------------------- manifest ---

def plain_leaf(row, more=0):
    doc_id, text, lang, source, n_chars = row
    n_chars = None if n_chars is None else n_chars + more
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_tree(leaves):
    """Root and, per leaf, the siblings from below."""
    path, where, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for i, at in enumerate(where):
            other = at ^ 1
            path[i].append(("R" if at & 1 else "L", level[other] if other < len(level) else ""))
            where[i] = at // 2
        level = [sha("".join(level[j:j + 2])) for j in range(0, len(level), 2)]
    return level[0], path


def plain_manifest(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[g] = plain_tree([plain_leaf(r) for r in groups[g]])
    root, upper = plain_tree([trees[g][0] for g in names])
    out = []
    for g, above in zip(names, upper):
        for row, path in zip(groups[g], trees[g][1]):
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            node = plain_leaf(row, 1 if changed else 0)
            for side, s in path + above:
                node = sha(s + node if side == "R" else node + s)
            out.append((row[0], plain_leaf(row), trees[g][0], root, sha("".join(s for _, s in path + above)), node, node == root))
    return out


DOC = "doc_id long, text string, lang string, source string, n_chars long, path int, n int"


def manifest_rows(spark, rows, levels):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], DOC)
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    out = merkle.document_manifest(df, changed, levels=levels)
    out = out.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")), "folded_root", "verified")
    return sorted([tuple(r) for r in out.collect()], key=str)


@pytest.mark.parametrize("levels", [2, 10])
def test_manifest_equals_a_plain_tree(spark, levels):
    rnd = random.Random(3)
    rows = [(i * 3 - 20, f"téxt {i}", rnd.choice(["en", "de", None, "é", "z"]), rnd.choice(["s", None, ""]), rnd.choice([i, None, 2**63 - 1])) for i in range(57)]
    rows += [(None, None, None, None, None), (4, "a", "one", "s", 1), rows[3], rows[3], (rows[3][0], "another", rows[3][2], None, 5)]
    got = manifest_rows(spark, rows, levels)
    assert got == sorted(plain_manifest(rows), key=str)
    assert {r[-1] for r in got} == {True, False}


def test_manifest_of_one_row_and_none(spark):
    rows = [(7, "", "en", "s", 0)]
    assert manifest_rows(spark, rows, 10) == plain_manifest(rows)
    assert manifest_rows(spark, [], 10) == []


# ----------------------------------------------------------------- trie ---

def plain_trie(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs.setdefault(conv, []).append(((turn is not None, turn or 0), tie, (role, text)))
    convs = {c: [t for *_, t in sorted(ts)] for c, ts in convs.items()}
    members = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(convs.get(c - c % 20, [])[:h] + own[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append((c, d == len(path)))
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    totals = {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        below = [totals[k] for k in kids.get(p, [])]
        totals[p] = (sum(b[0] for b in below) or 1, sum(b[1] for b in below) + (len(members[p]) - 1) * words)
    least = {p: min(c for c, _ in m) for p, m in members.items()}
    return sorted((least[p], len(p), least[p[:-1]] if p else None, len(m), len(kids.get(p, [])), *totals[p],
                   sha(",".join(str(c) for c in sorted(c for c, end in m if end)))) for p, m in members.items())


def trie_rows(spark, rows):
    df = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, digest int")
    convs = prefix_trie.conversations(df)
    again = prefix_trie.rebuilt(convs, lambda c: c - c % 20, (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int"))
    return sorted(tuple(r) for r in prefix_trie.trie(prefix_trie.paths(again)).collect())


def talk(n, seed=5):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rnd.randrange(1, 6)):
            rows.append((c, t, "user" if t % 2 == 0 else "bot", rnd.choice(["hi", "hello there\x0b you", "x  y z", "é\xa0e"]) if rnd.random() < 0.8 else f"only {c}"))
    return rows


def test_trie_equals_a_plain_trie(spark, monkeypatch):
    rows = talk(150)
    rows += [(None, 0, "user", "lost"), (2000, None, None, None), (2000, None, "user", ""), (2000, 1, "a", "b"), (2000, 1, "a", "b"), (2000, 1, "a", "c"), (2007, 0, "u", "v" * 50_000)]
    rows += [(3000 + c, t, "user", f"the same long talk {t}") for c in range(200) for t in range(6)]  # a hot conversation
    rows += [(5000, t, "user", f"w {t}") for t in range(900)]
    want = plain_trie(rows)
    assert trie_rows(spark, rows) == want
    monkeypatch.setattr(prefix_trie, "SHARD_ROWS", 12)  # the hot conversation lies in many shards
    assert trie_rows(spark, rows) == want
    monkeypatch.setattr(prefix_trie, "SKELETON_BYTES", 3_000)  # fewer shards
    assert trie_rows(spark, rows) == want


def test_trie_of_an_empty_table(spark):
    assert trie_rows(spark, []) == []
    assert trie_rows(spark, [(None, 1, "a", "b")]) == []


def test_pieces_of_a_hot_node(monkeypatch):
    skeleton = prefix_trie.Skeleton([(b"a" * 16, 5)])
    rows = []
    monkeypatch.setattr(prefix_trie, "PIECE", 10)
    shard = prefix_trie.Shard(0, skeleton, rows.append)
    for c in range(40):
        shard.add(b"a" * 16, [2], c)
    shard.close()
    pieces = [r[-1] for r in rows if r[0] == 2]
    assert len(pieces) > 5 and b",".join(pieces).decode() == ",".join(map(str, range(40)))


# ---------------------------------------------------------------- lines ---

UP = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def plain_lines(rows, min_chars=20, min_docs=3):
    def key(line):
        return line.strip("\x20\x09\x0a\x0b\x0c\x0d").translate(UP)

    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(line_dedup.NO_ID if doc is None else doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        me = line_dedup.NO_ID if doc is None else doc
        keep = [x for x in lines if len(holders.get(key(x), ())) < min_docs or me == max(holders[key(x)])]
        out.append((doc, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


LINES = ["A line of more than twenty characters", "\t a LINE of more than twenty characters \r", "İstanbul ÉÀ twenty one characters", "İstanbul éÀ twenty one characters",
         "short", "", "  ", "nineteen characters", "日本" * 10, "twenty characters ok", "exactly 20 chars x!!", "another long line that comes and goes"]


def line_rows():
    rnd = random.Random(11)
    rows = [(i, "\n".join(rnd.choices([*LINES, f"line of document {i} only, long enough"], k=rnd.randrange(0, 9)))) for i in range(80)]
    rows += [(None, "\n".join(LINES)), (None, None), (7, rows[7][1]), (7, "\n".join(LINES[:5])), (200, "\n" * 5), (201, "long line in two documents only\n" * 2000), (202, "long line in two documents only")]
    return rows


@pytest.mark.parametrize("batches, fanout", [(6, 3), (1, 2), (5, 2)])
def test_lines_equal_a_plain_loop(spark, batches, fanout):
    rows = line_rows()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, pos int, lines string")
    got = sorted([tuple(r) for r in line_dedup.dedup_lines(df, batches=batches, fanout=fanout).collect()], key=str)
    assert got == plain_lines(rows)


def test_lines_of_an_empty_table(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_runs_in_any_order_of_batches(spark):
    """Fed oldest first, one batch after another, the runs know the same keys."""
    rows = [(d, t) for d, t in line_rows() if d is not None]
    lines = line_dedup.line_hashes(line_dedup.documents(spark.createDataFrame(rows, "doc_id long, text string"))).cache()
    runs = line_dedup.LineRuns(spark, 4, fanout=2)
    assert runs.repeated() is None
    for lo in range(0, 210, 30):
        runs.add(lines.where(f"doc >= {lo} and doc < {lo + 30}").select("doc", "h1", "h2"))
        assert all(len(level) < 2 for level in runs.levels)
    got = {(r.h1, r.h2, r.top) for r in runs.repeated().collect()}
    whole = lines.groupBy("h1", "h2").agg(F.count_distinct("doc").alias("n"), F.max("doc").alias("top")).where("n >= 3")
    assert got == {(r.h1, r.h2, r.top) for r in whole.collect()}
    runs.drop()
    assert runs.runs() == []
