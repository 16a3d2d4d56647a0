"""Main text of web pages by union-free wrapper inference.

Pages of one host come from few templates.  Each page's token stream (start
tags with class, id and role; end tags; text) is read as nested groups, and
equal neighbours fold into a repeated group ``( )+``.  The streams of a host are
then aligned one after another: groups that match in order are aligned inside
in turn, a group that only one side has becomes optional ``( )?``, and text
becomes a slot ``#``.  The result is the host's wrapper, a regular expression
without unions.

Every page is then matched against its host's wrapper, so a slot is a position
in the wrapper: two groups of one key before and after another group are two
slots.  Pages with the same slots are of one template, and each template of a
host has its own main slots: its main container is an article or main element,
or else the deepest of its groups that holds most of the unlinked text, each slot
weighed by what it holds on all the host's pages that have it; a slot inside is
main text unless a group around it is a menu, header, footer, sidebar, notice,
advert, form, script, style or reader comments, or its text is the same on all
of many pages that have the container and otherwise differ.  A block of a
repeated slot that stands on all of those pages is template text too.  A page's
main text is what its main slots hold.

Streams are folded per page and grouped by (host, stream) first, so a host with
a third of all pages aligns only its distinct streams; those are merged in
salted parts and the parts per host.  What the slots hold is added up per task,
then per (host, slot).

Edge cases: null or empty html gives empty text; a null url counts as the host
"" ; broken html is read to its end, an open comment, script or style takes the
rest; repeated rows and ids are each returned.
"""

from __future__ import annotations

import html as html_lib
import json
import re
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators._util import ship
from .common import columns, saved, spread

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTR = re.compile(r"""([A-Za-z_:][-A-Za-z0-9_:.]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: Fixed lists of HTML's elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre search section summary table tbody td tfoot th thead tr ul".split())
#: What a start tag ends: open elements named here, up to a limit.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
CLOSES_P = BLOCK - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "option", "optgroup", "caption", "legend"}
#: Elements and words of class, id or role that mark what is not main text.
OFF_TAGS = frozenset("head nav aside footer header form menu button select dialog search canvas audio video object".split()) | RAW
OFF_WORDS = re.compile(r"^(ads?|advert\w*|adsense|adslot|banner|promo\w*|sponsor\w*|sidebar\w*|menu\w*|nav\w*|breadcrumbs?|comments?|commentlist|respond|replies|disqus\w*|cookies?|consent|gdpr|notices?|alert|newsletter|subscribe\w*|subscription|signup|login|popup|modal|overlay|share|sharing|social\w*|related|recommend\w*|footer\w*|header|masthead|toolbar|widget\w*|copyright|pagination|pager|skip|hidden|complementary|contentinfo|search|navigation|form|dialog|off0)$")
#: A text can be template text if it is the same on at least this many pages.
CONSTANT_PAGES = 20
SALTS = 32
#: Slots and texts that a task holds before it passes its sums on.
HELD = 200_000


def group_key(tag: str, attrs: str) -> str:
    """``tag.class#id@role`` of a start tag, digits as 0."""
    if not attrs.strip(" /\t\r\n"):
        return tag
    marks = []
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name in ("class", "id", "role") and value:
            marks += [{"class": ".", "id": "#", "role": "@"}[name] + w for w in sorted(set(html_lib.unescape(value).lower().split()))]
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            marks.append(".hidden")
    return tag + re.sub(r"\d+", "0", re.sub(r"[/>|]", "_", "".join(marks)))


def off(key: str) -> bool:
    """True for a group that is not main text."""
    tag, *marks = re.split(r"[.#@]", key)
    if tag in OFF_TAGS:
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    return any(OFF_WORDS.match(w) for m in marks for w in re.split(r"[-_]", m)) or any(OFF_WORDS.match(m) for m in marks)


def read_page(page: str):
    """The texts of a page in order: ``(path, block, linked, text)``, and its
    folded token stream.  ``path`` joins the open groups by "/"; texts with one
    ``block`` number stand in one block."""
    texts, _, root = parse(page)
    fold(root)
    return texts, root


def parse(page: str):
    """As ``read_page``, with the group of each text and the stream not folded."""
    stack: list[tuple[str, str]] = []
    root = ["", [], False]  # key, children, has text
    nodes = [root]
    texts: list[tuple[str, int, bool, str]] = []
    owners: list[list] = []
    block = at = 0
    path, linked = "", 0
    raw = None

    def text(s: str) -> None:
        if s.strip():
            nodes[-1][2] = True
        if s:
            texts.append((path, block, linked > 0, s))
            owners.append(nodes[-1])

    def pop_to(n: int) -> None:
        nonlocal path, block, linked
        while len(stack) > n:
            tag, key = stack.pop()
            nodes.pop()
            path = path[:-len(key) - 1]
            if tag in BLOCK:
                block += 1
            if tag == "a":
                linked -= 1

    size = len(page)
    while at < size:
        if raw is not None:
            m = raw.search(page, at)
            at = m.end() if m else size
            raw = None
            pop_to(len(stack) - 1)
            continue
        m = TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at:m.start()])
        at = m.end() if m.end() > m.start() else m.start() + 1
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop_to(k)
                    break
            else:
                if tag in BLOCK:
                    block += 1
            continue
        if tag in VOID:
            if tag == "hr":
                block += 1
            elif tag in ("br", "wbr") and tag == "br":
                texts.append((path, block, linked > 0, " "))
                owners.append(nodes[-1])
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    pop_to(k)
                    break
                if stack[k][0] in BLOCK:
                    break
        if tag in ENDS:
            ended, limit = ENDS[tag]
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in limit:
                    break
                if stack[k][0] in ended:
                    pop_to(k)
                    break
        key = group_key(tag, m[3])
        node = [key, [], False]
        nodes[-1][1].append([node, 0])
        if tag in BLOCK:
            block += 1
        nodes.append(node)
        stack.append((tag, key))
        path += "/" + key
        linked += tag == "a"
        if tag in RAW:
            raw = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I)
    return texts, owners, root


# A group is [key, children, has text]; a child is [group, flags].
OPTIONAL, REPEATED = 1, 2


def fold(group: list) -> None:
    """Equal neighbours become one repeated group."""
    out: list = []
    for child, flags in group[1]:
        if flags == 0:
            fold(child)
        if out and out[-1][0][0] == child[0]:
            out[-1] = [align(out[-1][0], child), (out[-1][1] & flags & OPTIONAL) | REPEATED]
        else:
            out.append([child, flags])
    group[1] = out


def align(a: list, b: list) -> list:
    """The least group that both match: children matched in order (a longest
    common subsequence of keys), the others optional."""
    x, y = a[1], b[1]
    n, m = len(x), len(y)
    if [c[0][0] for c in x] == [c[0][0] for c in y]:
        return [a[0], [[align(p[0], q[0]), p[1] | q[1]] for p, q in zip(x, y)], a[2] or b[2]]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i][0][0] == y[j][0][0] else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    out = []
    while i < n or j < m:
        if i < n and j < m and x[i][0][0] == y[j][0][0] and best[i][j] == best[i + 1][j + 1] + 1:
            out.append([align(x[i][0], y[j][0]), x[i][1] | y[j][1]])
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            out.append([x[i][0], x[i][1] | OPTIONAL])
            i += 1
        else:
            out.append([y[j][0], y[j][1] | OPTIONAL])
            j += 1
    merged: list = []
    for child, flags in out:  # an optional group beside its like repeats it
        if merged and merged[-1][0][0] == child[0]:
            merged[-1] = [align(merged[-1][0], child), (merged[-1][1] & flags & OPTIONAL) | REPEATED]
        else:
            merged.append([child, flags])
    return [a[0], merged, a[2] or b[2]]


def expression(group: list) -> str:
    """The wrapper as text: ``<key>#( ... )?( ... )+</key>``."""
    inner = "#" * group[2]
    for child, flags in group[1]:
        s = expression(child)
        inner += {0: s, OPTIONAL: f"({s})?", REPEATED: f"({s})+", OPTIONAL | REPEATED: f"({s})*"}[flags]
    return f"<{group[0]}>{inner}</{group[0]}>" if group[0] else inner


def merge_all(streams) -> list:
    """One wrapper of many streams, in a fixed order."""
    out = None
    for s in sorted(streams):
        w = json.loads(s)
        out = w if out is None else align(out, w)
    return out


def block_texts(texts, keep) -> str:
    """The kept texts: white space of a block as one space, blocks trimmed and
    joined by an empty line."""
    blocks: dict[int, list[str]] = {}
    for path, block, _, s in texts:
        if keep(path):
            blocks.setdefault(block, []).append(s)
    done = (" ".join(html_lib.unescape("".join(b)).split()) for b in blocks.values())
    return "\n\n".join(b for b in done if b)


# --- pages against their host's wrapper


def number(root: list) -> tuple[list[str], list[int]]:
    """Numbers the groups of a wrapper in order (their fourth place); returns the
    key and the parent's number of each."""
    keys, parents = [], []

    def go(group, parent):
        group.append(len(keys))
        keys.append(group[0])
        parents.append(parent)
        for child, _ in group[1]:
            go(child, group[3])

    go(root, -1)
    return keys, parents


def runs_of(node: list) -> list[tuple[str, list]]:
    return [(k, [c[0] for c in run]) for k, run in groupby(node[1], lambda c: c[0][0])]


def places(runs: list[tuple[str, list]], children: list, memo: dict) -> list[int]:
    """Which children of a wrapper's group the runs of a page's groups are, in
    order (-1: none): so that as many groups as possible, those inside too, have
    a place, and then the fewest that are not optional are left out."""
    n, m = len(runs), len(children)
    keys = [c[0][0] for c in children]
    if [k for k, _ in runs] == keys:
        return list(range(n))

    def gain(i, j):
        key, run = runs[i]
        inside = 1 if keys.count(key) == 1 else sum(fitting(node, children[j][0], memo) for node in run)
        return (m + 1) * inside + (not children[j][1] & OPTIONAL)

    gains = {(i, j): gain(i, j) for i in range(n) for j in range(m) if runs[i][0] == keys[j]}
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + gains[i, j] if (i, j) in gains else 0)
    out, i, j = [-1] * n, 0, 0
    while i < n and j < m:
        if (i, j) in gains and best[i][j] == best[i + 1][j + 1] + gains[i, j]:
            out[i] = j
            i, j = i + 1, j + 1
        elif best[i][j] == best[i][j + 1]:
            j += 1
        else:
            i += 1
    return out


def fitting(node: list, group: list, memo: dict) -> int:
    """How many groups have a place if ``node`` stands for ``group``."""
    key = id(node), group[3]
    if key not in memo:
        runs = runs_of(node)
        memo[key] = 1 + sum(fitting(child, group[1][j][0], memo) for (_, run), j in zip(runs, places(runs, group[1], memo)) if j >= 0 for child in run)
    return memo[key]


def place(node: list, group: list, out: dict[int, int], memo: dict) -> None:
    """The number of the wrapper's group of every group below ``node``, by
    ``id``; every page that the wrapper is made of has a place for all."""
    out[id(node)] = group[3]
    runs = runs_of(node)
    for (_, run), j in zip(runs, places(runs, group[1], memo)):
        if j >= 0:
            for child in run:
                place(child, group[1][j][0], out, memo)


def placed(page: str, root: list) -> tuple[list[tuple[int, int, bool, str]], dict[int, tuple[int, str]]]:
    """The texts of a page with the number of their slot for a path, and of each
    block the slot it begins in and its whole text."""
    texts, owners, tree = parse(page)
    of: dict[int, int] = {}
    place(tree, root, of, {})
    out = [(of.get(id(o), -1), *t[1:]) for o, t in zip(owners, texts)]
    first: dict[int, int] = {}
    held: dict[int, list[str]] = {}
    for slot, block, _, s in out:
        held.setdefault(block, []).append(s)
        if s.strip():
            first.setdefault(block, slot)
    return out, {b: (slot, " ".join(html_lib.unescape("".join(held[b])).split())) for b, slot in first.items()}


@dataclass
class Slot:
    size: int  # characters on all pages
    linked: int
    pages: int
    constant: bool  # one text on all its pages
    same: dict[int, int]  # hash and size of the blocks that begin in it on all its pages


def main_slots(slots: dict[int, Slot], keys: list[str], parents: list[int]) -> dict[int, frozenset[int]]:
    """The main ones of a template's slots, each with the hashes of its blocks that
    are template text.  A slot weighs what it holds on a page that has it."""
    def chain(n):
        out = []
        while n >= 0:
            out.append(n)
            n = parents[n]
        return out[::-1]

    chains = {n: chain(n) for n in slots if n >= 0}
    good = [n for n, c in chains.items() if not any(off(keys[g]) for g in c[1:])]
    mean = {n: slots[n].size / slots[n].pages for n in good}
    fixed = {n: mean[n] if slots[n].constant else min(mean[n], sum(slots[n].same.values())) if slots[n].pages >= CONSTANT_PAGES else 0.0 for n in good}
    differ = max((slots[n].pages for n in good), default=0) >= CONSTANT_PAGES and sum(fixed.values()) < sum(mean.values()) / 2

    def own(n):
        """Unlinked text that is not the same on all pages."""
        if differ and slots[n].constant and slots[n].pages >= CONSTANT_PAGES:
            return 0.0
        return max(0.0, mean[n] - 2 * slots[n].linked / slots[n].pages - (fixed[n] if differ else 0.0))

    def chosen(some):
        """Without what is the same on all pages that have the container."""
        some = list(some)
        most = max((slots[n].pages for n in some), default=0)
        if not differ or most < CONSTANT_PAGES:
            return {n: frozenset() for n in some}
        return {n: frozenset(slots[n].same) if slots[n].pages == most else frozenset() for n in some if not (slots[n].constant and slots[n].pages == most)}

    marked = [n for n in good if any(k.split(".")[0].split("#")[0].split("@")[0] in ("article", "main") or "@main" in k or "@article" in k for k in (keys[g] for g in chains[n][1:]))]
    if sum(slots[n].size - slots[n].linked for n in marked) > 0:
        return chosen(marked)
    # no such element: go down while one child holds most of the text
    at = depth = 0
    while True:
        weight: dict[int, float] = {}
        total = 0.0
        for n in good:
            c = chains[n]
            if len(c) > depth and c[depth] == at:
                w = own(n)
                total += w
                if len(c) > depth + 1:
                    weight[c[depth + 1]] = weight.get(c[depth + 1], 0.0) + w
        top = max(weight, key=lambda g: (weight[g], g), default=None)
        if top is None or not total or weight[top] < 0.7 * total or re.split(r"[.#@]", keys[top])[0] in ("p", "pre", "blockquote", "ul", "ol", "table"):
            break
        at, depth = top, depth + 1
    return chosen(n for n in good if len(chains[n]) > depth and chains[n][depth] == at)


class Wrapper:
    """A host's wrapper and what its slots hold, as it travels."""

    def __init__(self, value: bytes):
        self.root, slots = json.loads(zstandard.decompress(value))
        self.keys, self.parents = number(self.root)
        self.slots = {n: Slot(size, linked, pages, constant, dict(same)) for n, size, linked, pages, constant, same in slots}
        self._main: dict[frozenset[int], dict[int, frozenset[int]]] = {}

    @staticmethod
    def shut(root: list, slots=()) -> bytes:
        return zstandard.compress(json.dumps([root, list(slots)], separators=(",", ":")).encode(), 9)

    def main(self, own: frozenset[int]) -> dict[int, frozenset[int]]:
        """Main slots of the pages that have the slots ``own``."""
        if own not in self._main:
            if len(self._main) >= 4096:
                self._main.clear()
            self._main[own] = main_slots({n: self.slots[n] for n in own if n in self.slots}, self.keys, self.parents)
        return self._main[own]

    def text(self, page: str) -> str:
        """Main text of a page."""
        texts, blocks = placed(page, self.root)
        main = self.main(frozenset(t[0] for t in texts if t[3].strip()))
        dropped = {b for b, (slot, s) in blocks.items() if main.get(slot) and hash_text([s]) in main[slot]}
        return block_texts([t for t in texts if t[1] not in dropped], main.__contains__)


class Opened:
    """The wrappers of the hosts a task meets; the last ones stay open."""

    def __init__(self):
        self.held: dict[bytes, Wrapper] = {}

    def __call__(self, value: bytes) -> Wrapper:
        if value not in self.held:
            if len(self.held) >= 256:
                self.held.clear()
            self.held[value] = Wrapper(value)
        return self.held[value]


def host_of(url: str) -> str:
    return f"lower(regexp_extract({url}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1))"


def aligned(rows: DataFrame) -> DataFrame:
    """Per host: ``host, plan`` (its wrapper, as it travels)."""
    def streams(batches):
        for b in batches:
            out = {(host, json.dumps(read_page(page)[1], separators=(",", ":"), ensure_ascii=False)) for host, page in zip(b.column("host").to_pylist(), b.column("html").to_pylist())}
            yield pa.RecordBatch.from_pylist([{"host": h, "stream": s} for h, s in sorted(out)], schema=STREAMS)

    distinct = rows.select("host", "html").mapInArrow(streams, "host string, stream string").distinct().withColumn("salt", F.pmod(F.xxhash64("stream"), F.lit(SALTS)))

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "stream": [json.dumps(merge_all(pdf["stream"]), separators=(",", ":"), ensure_ascii=False)]})

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "plan": [Wrapper.shut(merge_all(pdf["stream"]))]})

    parts = distinct.groupBy("host", "salt").applyInPandas(part, "host string, stream string")
    return parts.groupBy("host").applyInPandas(whole, "host string, plan binary")


def held(rows: DataFrame) -> DataFrame:
    """What the slots of every host hold (``rows`` with their host's ``plan``):
    ``host, slot, size, linked, pages, constant, same``."""
    def sums(batches):
        opened, by = Opened(), {}

        def passed():
            out = [{"host": h, "slot": n, "size": v[0], "linked": v[1], "pages": v[2], "low": v[3], "high": v[4], "same": [{"hash": k, "size": z} for k, z in sorted(v[5].items())]} for (h, n), v in by.items()]
            by.clear()
            return pa.RecordBatch.from_pylist(out, schema=SLOTS)

        n = 0
        for b in batches:
            for host, page, plan in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), b.column("plan").to_pylist()):
                if not page:
                    continue
                texts, blocks = placed(page, opened(plan).root)
                own: dict[int, list] = {}
                for slot, _, linked, s in texts:
                    if s.strip():
                        v = own.setdefault(slot, [0, 0, [], {}])
                        v[0] += len(s)
                        v[1] += len(s) if linked else 0
                        v[2].append(" ".join(s.split()))
                for slot, s in blocks.values():
                    own[slot][3][hash_text([s])] = len(s)
                for slot, (size, linked, parts, begun) in own.items():
                    h = hash_text(parts)
                    v = by.get((host, slot))
                    if v is None:
                        by[host, slot] = [size, linked, 1, h, h, begun]
                        n += 1 + len(begun)
                    else:  # a block on all pages is on all pages of every task
                        v[0], v[1], v[2], v[3], v[4] = v[0] + size, v[1] + linked, v[2] + 1, min(v[3], h), max(v[4], h)
                        v[5] = {k: z for k, z in v[5].items() if k in begun}
                if n >= HELD:
                    yield passed()
                    n = 0
        yield passed()

    some = rows.select("host", "html", "plan").mapInArrow(sums, "host string, slot int, size long, linked long, pages long, low long, high long, same array<struct<hash: long, size: long>>")
    every = F.collect_list("same")
    return some.groupBy("host", "slot").agg(F.sum("size").alias("size"), F.sum("linked").alias("linked"), F.sum("pages").alias("pages"), (F.min("low") == F.max("high")).alias("constant"), F.aggregate(every, F.element_at(every, 1), F.array_intersect).alias("same"))


def infer(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per host: ``host, wrapper`` (text), ``plan`` (the wrapper and what its slots
    hold, as it travels)."""
    rows = _pages(pages, id_col, url_col, html_col)
    plans = saved(aligned(rows), "wrappers")
    slots = held(rows.join(plans, "host"))

    def whole(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        root = json.loads(zstandard.decompress(left["plan"].iloc[0]))[0]
        own = sorted((r.slot, r.size, r.linked, r.pages, bool(r.constant), [(x["hash"], x["size"]) for x in r.same]) for r in right.itertuples(index=False)) if len(right) else []
        own = [[int(x) for x in r[:4]] + [r[4], [(int(h), int(z)) for h, z in r[5]]] for r in own]
        return pd.DataFrame({"host": [key[0]], "wrapper": [expression(root)], "plan": [Wrapper.shut(root, own)]})

    return plans.groupBy("host").cogroup(slots.groupBy("host")).applyInPandas(whole, "host string, wrapper string, plan binary")


STREAMS = pa.schema([("host", pa.string()), ("stream", pa.string())])
SLOTS = pa.schema([("host", pa.string()), ("slot", pa.int32()), *[(c, pa.int64()) for c in ("size", "linked", "pages", "low", "high")], ("same", pa.list_(pa.struct([("hash", pa.int64()), ("size", pa.int64())])))])


def hash_text(parts: list[str]) -> int:
    import xxhash
    return xxhash.xxh64_intdigest("\n".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


def _pages(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    ship(pages.sparkSession)
    rows = columns(pages, page_id=id_col, url=url_col, html=F.coalesce(F.col(f"`{html_col}`"), F.lit("")))
    return spread(rows.withColumn("host", F.expr(host_of("coalesce(url, '')"))))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars, host`` of every page."""
    wrappers = saved(infer(pages, id_col, url_col, html_col), "wrappers").select("host", "plan")
    rows = _pages(pages, id_col, url_col, html_col).join(wrappers, "host", "left")
    id_type = rows.schema["page_id"].dataType.simpleString()

    def run(batches):
        opened = Opened()
        for b in batches:
            out = [opened(plan).text(page) if page else "" for page, plan in zip(b.column("html").to_pylist(), b.column("plan").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64()), b.column("host")], ["page_id", "url", "text", "n_chars", "host"])

    return rows.select("page_id", "url", "html", "host", "plan").mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars long, host string")
