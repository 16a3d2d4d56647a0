"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

#: The 256 values of the CRC-32 table (polynomial 0xEDB88320), worked out.
_CRC_TABLE = """crct AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS t
  FROM range(256) r(i))"""


def _crc(text: str) -> str:
    codes = f"list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT)"
    return f"xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])))"


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::VARCHAR))::VARCHAR || ':' || {value}::VARCHAR, '-')"


def _leaf(n_chars: str = "n_chars") -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


def _levels(name: str, base: str) -> str:
    """All nodes ``g, lv, idx, d, n`` above the leaves of ``base``."""
    return f"""{name} AS (
  SELECT g, 0 AS lv, idx, d, n FROM {base}
  UNION ALL
  SELECT g, lv + 1, idx // 2, sha256(string_agg(d, '' ORDER BY idx)), (n + 1) // 2 FROM {name} WHERE n > 1 GROUP BY g, lv, idx // 2, n
)"""


def _steps(name: str, base: str, nodes: str) -> str:
    """Per leaf the list of its steps: R or L, then the sibling's digest."""
    return f"""{name} AS (
  SELECT b.g, b.idx, list(CASE WHEN (b.idx >> k.lv) & 1 = 1 THEN 'R' ELSE 'L' END || coalesce(s.d, '') ORDER BY k.lv) FILTER (k.lv IS NOT NULL) AS steps
  FROM {base} b LEFT JOIN (SELECT DISTINCT g, lv FROM {nodes} WHERE n > 1) k ON k.g IS NOT DISTINCT FROM b.g
  LEFT JOIN {nodes} s ON s.g IS NOT DISTINCT FROM b.g AND s.lv = k.lv AND s.idx = xor(b.idx >> k.lv, 1)
  GROUP BY b.g, b.idx
)"""


OP11 = f"""WITH RECURSIVE {_CRC_TABLE},
docs AS (
  SELECT doc_id, lang AS g, {_leaf()} AS d, CASE WHEN {_crc("doc_id::VARCHAR")} % 7 = 0 THEN {_leaf("(n_chars + 1)")} END AS forged,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n
  FROM documents, crct
),
{_levels("nodes", "docs")},
tops AS (
  SELECT g AS lang, 0 AS g, d, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1
),
{_levels("upper", "tops")},
{_steps("low", "docs", "nodes")},
{_steps("high", "tops", "upper")},
found AS (
  SELECT doc_id, docs.d AS leaf, forged, tops.d AS subroot, (SELECT d FROM upper WHERE n = 1) AS root,
    list_concat(coalesce(low.steps, []), coalesce(high.steps, [])) AS steps
  FROM docs JOIN low ON low.g IS NOT DISTINCT FROM docs.g AND low.idx = docs.idx
  JOIN tops ON tops.lang IS NOT DISTINCT FROM docs.g JOIN high ON high.idx = tops.idx
),
folded AS (
  SELECT *, list_reduce(list_concat([coalesce(forged, leaf)], steps),
    lambda node, s: sha256(CASE WHEN s[1] = 'R' THEN s[2:] || node ELSE node || s[2:] END)) AS folded_root FROM found
)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(steps, lambda s: s[2:]), ''), '')) AS proof_sha256,
  folded_root, folded_root = root AS verified FROM folded"""

OP12 = f"""WITH {_CRC_TABLE},
turns AS (
  SELECT conv_id, turn, md5(octet_length(encode(role))::VARCHAR || ':' || role || text) AS digest,
    len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
),
convs AS (
  SELECT conv_id, {_crc("conv_id::VARCHAR")} % 4 AS h, turns FROM crct,
    (SELECT conv_id, list({{'digest': digest, 'words': words}} ORDER BY turn NULLS FIRST, digest, words) AS turns FROM turns GROUP BY conv_id)
),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns
  FROM convs c LEFT JOIN convs b ON b.conv_id = c.conv_id - c.conv_id % 20
),
members AS (
  SELECT conv_id, depth, list_transform(turns[1:depth], lambda x: x.digest) AS path, depth = len(turns) AS ends,
    CASE WHEN depth > 0 THEN turns[depth].words ELSE 0 END AS words
  FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM rebuilt)
),
nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(words) AS own,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM members GROUP BY path, depth
),
kids AS (SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2),
under AS (
  SELECT path[1:up] AS path, up AS depth, sum(own) AS saved, count(*) FILTER (n IS NULL) AS leaves
  FROM (SELECT nodes.path, own, n, unnest(range(nodes.depth + 1)) AS up FROM nodes LEFT JOIN kids ON kids.path = nodes.path AND kids.depth = nodes.depth)
  GROUP BY 1, 2
)
SELECT a.conv_id, a.depth, p.conv_id AS parent_conv_id, a.n_convs, coalesce(k.n, 0) AS n_children, u.leaves AS n_leaves,
  u.saved::BIGINT AS saved_tokens, a.ends_sha256
FROM nodes a JOIN under u ON u.path = a.path AND u.depth = a.depth
LEFT JOIN kids k ON k.path = a.path AND k.depth = a.depth
LEFT JOIN nodes p ON a.depth > 0 AND p.depth = a.depth - 1 AND p.path = a.path[1:a.depth - 1]"""

_SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP13 = f"""WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
  SELECT doc_id, i, line, translate(trim(line, {_SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(range(len(lines))) AS i, unnest(lines) AS line FROM docs)
),
repeated AS (SELECT key, max(doc_id) AS top FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT lines.*, coalesce(doc_id < top, false) AS gone FROM lines LEFT JOIN repeated USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

SQL = {
    "op11_merkle_manifest": OP11,
    "op12_prefix_trie": OP12,
    "op13_line_dedup": OP13,
}
