"""Secret scans by corpus-wide ownership frequency, in DataFrame functions only.

Patterns find candidates in every whole text: three base kinds (``assign``,
``access``, ``hex``) and ``owned``, long tokens that mix digits and letters
outside any base span.  The hashes of all candidate values are counted over
the corpus by distinct owners and by distinct repositories of an owner (each
level pre-aggregates, so a value in a third of all rows is no hot group).  A
value held by more than ``max_owners`` owners or ``max_repos`` repositories is a
widely copied example; any other is live.  Base spans are always reported;
``owned`` spans only when live.

Positions: a text cut at a pattern gives the gaps between its matches, and
sums of the lengths of gaps and matches give code-point positions.  Sums run in
chunks of 256 matches, so a text with very many matches stays cheap.

Edge cases: null text counts as empty and has no span; null owner or
repository counts as one owner or repository of its own; repeated rows are
each reported; a null id is passed through; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, saved

#: Fixed patterns of the base kinds (``assign`` has its value as group 2).
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
OWNED = r"[A-Za-z0-9_+-]{20,}"
#: The order of kinds at one start.
KINDS = ("assign", "access", "hex", "owned")
CHUNK = 256


def _hits(text: Column, pattern: str) -> Column:
    """Array of ``gap`` (code points before it), ``n`` (its length), ``hit``."""
    found = F.when(text.rlike(pattern), F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit")))
    return F.transform(F.filter(found, lambda z: z["hit"].isNotNull()), lambda z: F.struct(F.length(z["gap"]).alias("gap"), F.length(z["hit"]).alias("n"), z["hit"].alias("hit")))


def _total(hits: Column) -> Column:
    return F.aggregate(hits, F.lit(0), lambda a, h: a + h["gap"] + h["n"])


def _placed(df: DataFrame, name: str) -> DataFrame:
    """Column ``name`` of hits becomes an array of ``start, end, hit``."""
    c = F.col(name)
    n = F.size(F.coalesce(c, F.array()))
    chunks = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int")), lambda k: F.slice(c, k * CHUNK + 1, F.lit(CHUNK))))
    df = df.withColumn(name, chunks)
    df = df.withColumn(name, F.arrays_zip(c.alias("part"), F.transform(c, _total).alias("size")))
    sizes = F.col(f"{name}.size")
    based = F.transform(c, lambda z, k: F.struct(z["part"].alias("part"), F.aggregate(F.slice(sizes, F.lit(1), k), F.lit(0), lambda a, s: a + s).alias("base")))
    df = df.withColumn(name, based)

    def place(z):
        def one(h, j):
            start = z["base"] + _total(F.slice(z["part"], F.lit(1), j)) + h["gap"]
            return F.struct(start.alias("start"), (start + h["n"]).alias("end"), h["hit"].alias("hit"))
        return F.transform(z["part"], one)

    return df.withColumn(name, F.coalesce(F.flatten(F.transform(c, place)), F.expr("array()")))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str | Column = "source", repo_col: str | Column = "lang") -> DataFrame:
    """``doc_id, mark, owner, repo, spans`` per row: ``spans`` holds ``start, end,
    kind`` (index in KINDS) and ``value`` (hash of the candidate); ``mark`` is a
    hash of the text that tells rows with one id apart."""
    df = columns(docs, doc_id=id_col, text=F.coalesce(F.col(f"`{text_col}`"), F.lit("")), owner=owner_col, repo=repo_col)
    df = df.withColumn("mark", F.xxhash64("text"))
    patterns = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, OWNED), strict=True))
    for kind, pattern in patterns.items():
        df = df.withColumn(kind, _hits(F.col("text"), pattern))
    df = df.drop("text")
    for kind in KINDS:
        df = _placed(df, kind)
    # a failing assignment is dropped after matching: it still uses up its text
    df = df.withColumn("assign", F.transform("assign", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.regexp_extract(s["hit"], ASSIGN, 2).alias("hit"))))
    df = df.withColumn("assign", F.filter("assign", lambda s: F.length(s["hit"]) >= 6))
    base = F.concat("assign", "access", "hex")
    apart = lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    mixed = lambda s: (F.length(F.regexp_replace(s["hit"], "[^0-9]", "")) >= 4) & (F.length(F.regexp_replace(s["hit"], "[^A-Za-z]", "")) >= 4)
    df = df.withColumn("owned", F.filter("owned", lambda s: mixed(s) & apart(s)))

    def tagged(k: int) -> Column:
        return F.transform(KINDS[k], lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end"), F.xxhash64(s["hit"]).alias("value")))

    kinds = [tagged(k) for k in range(len(KINDS))]
    return df.select("doc_id", "mark", "owner", "repo", F.array_sort(F.concat(*kinds)).alias("spans"))


def ownership(found: DataFrame, max_owners: int = 2, max_repos: int = 4) -> DataFrame:
    """``value, owners, repos, live`` of every candidate value of the corpus."""
    values = found.select("owner", "repo", F.explode("spans").alias("s")).select(F.col("s.value").alias("value"), "owner", "repo")
    by_repo = values.groupBy("value", "owner", "repo").agg(F.lit(1).alias("one"))
    by_owner = by_repo.groupBy("value", "owner").agg(F.count("*").alias("repos"))
    counts = by_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    return counts.withColumn("live", (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos))


def scan(docs: DataFrame, max_owners: int = 2, max_repos: int = 4, **cols) -> DataFrame:
    """``doc_id, mark, spans`` per row; each span has ``start, kind, end, live``;
    ``owned`` spans of widely copied values are left out."""
    found = saved(candidates(docs, **cols), "candidates")
    verdict = ownership(found, max_owners, max_repos)
    some = found.where(F.size("spans") > 0).select("doc_id", "mark", "spans").distinct()
    each = some.select("doc_id", "mark", F.explode("spans").alias("s")).select("doc_id", "mark", "s", F.col("s.value").alias("value"))
    judged = (each.join(verdict.select("value", "live"), "value")
              .groupBy("doc_id", "mark").agg(F.array_sort(F.collect_list(F.struct("s.start", "s.kind", "s.end", "live"))).alias("judged")))
    judged = judged.withColumn("judged", F.filter("judged", lambda s: (s["kind"] < 3) | s["live"]))
    rows, j = found.select("doc_id", "mark").alias("f"), judged.alias("j")
    joined = rows.join(j, F.col("f.doc_id").eqNullSafe(F.col("j.doc_id")) & (F.col("f.mark") == F.col("j.mark")), "left")
    return joined.select("f.doc_id", "f.mark", F.coalesce("judged", F.expr("array()")).alias("spans"))


def written(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def report(docs: DataFrame, **options) -> DataFrame:
    """Per row: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owned,
    n_live``."""
    df = scan(docs, **options)
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return df.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
                     F.sha2(written(F.filter("spans", lambda s: s["kind"] < 3)).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"),
                     n(3).alias("n_owned"), F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"))


def redact(docs: DataFrame, mask: str = "[SECRET]", **options) -> DataFrame:
    """``documents`` rows with every live span of the text masked; spans that
    overlap become one mask, ``n_chars`` follows the text."""
    live = scan(docs, **options).withColumn("spans", F.filter("spans", lambda s: s["live"])).where(F.size("spans") > 0).distinct()
    marked = docs.withColumn("__mark", F.xxhash64(F.coalesce("text", F.lit(""))))
    live = live.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__m"), F.col("spans").alias("__spans"))
    df = marked.join(live, marked["doc_id"].eqNullSafe(live["__id"]) & (marked["__mark"] == live["__m"]), "left")
    # a cut after each span, at the furthest end so far
    step = lambda a, s: F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))).otherwise(
        F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring("text", a["at"] + 1, s["start"] - a["at"]), F.lit(mask)).alias("out")))
    done = F.aggregate("__spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring("text", a["at"] + 1, F.length("text"))))
    df = df.withColumn("text", F.when(F.col("__spans").isNotNull(), done).otherwise(F.col("text")))
    return df.withColumn("n_chars", F.when(F.col("__spans").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)
