"""DuckDB oracle SQL for the registered queries (same names, same aliases).

The digamma series and the md5 uniform draw are rendered from the same
constants the Spark side uses (:mod:`countmix.functions`).  DuckDB has
``lgamma`` but no digamma, so the VE queries inline the series.
"""

from __future__ import annotations

from ..functions.hashing import hash_uniform_sql
from ..functions.special import digamma_sql as psi
from ..functions.text import normalise_text_sql
from . import catalog as C

NORM = normalise_text_sql("text")

TOK = f"""toks AS (
  SELECT doc_id, lang, source, unnest(string_split({NORM}, ' ')) AS term FROM documents),
t AS (SELECT doc_id, lang, source, term FROM toks WHERE length(term) >= 3),
dtm_t AS (SELECT doc_id, term, count(*) AS cnt FROM t GROUP BY doc_id, term)"""

VOCAB = """vocab AS (
  SELECT (row_number() OVER (ORDER BY term) - 1)::INTEGER AS term_id, term
  FROM (SELECT DISTINCT term FROM dtm_t)),
dtm AS (SELECT d.doc_id, v.term_id, d.cnt FROM dtm_t d JOIN vocab v USING (term))"""

PRUNED = f"""vocab5 AS (
  SELECT (row_number() OVER (ORDER BY term) - 1)::INTEGER AS term_id, term
  FROM (SELECT term FROM dtm_t GROUP BY term HAVING count(*) >= {C.MIN_DOCS})),
dtm5 AS (SELECT d.doc_id, v.term_id, d.cnt FROM dtm_t d JOIN vocab5 v USING (term))"""

LANG = """langs AS (
  SELECT lang, (row_number() OVER (ORDER BY lang))::INTEGER AS cluster
  FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)),
asg AS (SELECT d.doc_id, l.cluster FROM documents d JOIN langs l USING (lang))"""

SRC = """srcs AS (
  SELECT source, (row_number() OVER (ORDER BY source))::INTEGER AS topic
  FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL))"""


def _entropy_ctes(counts_cte: str, k_sql: str) -> str:
    """b (topic, term_id, p), y, w (topic, term_id, p, weight) from a counts CTE."""
    return f"""b AS (SELECT topic, term_id, cnt / sum(cnt) OVER (PARTITION BY topic) AS p FROM {counts_cte}),
y AS (SELECT topic, term_id, p, p / sum(p) OVER (PARTITION BY term_id) AS y FROM b),
w AS (SELECT topic, term_id, p,
        p * pow(1 + sum(CASE WHEN y > 0 THEN y * ln(y) ELSE 0 END) OVER (PARTITION BY term_id)
                / ln(({k_sql})), {C.ENTROPY_S}) AS weight FROM y)"""


LANG_COUNTS = """lc AS (SELECT a.cluster AS topic, d.term_id, sum(d.cnt)::DOUBLE AS cnt
  FROM dtm d JOIN asg a USING (doc_id) GROUP BY 1, 2)"""

TOP = f"""r AS (SELECT topic, term_id, weight, rank() OVER (PARTITION BY topic ORDER BY weight DESC) AS rnk FROM w)
SELECT r.topic, v.term, round(r.weight, 9) AS weight, r.rnk::INTEGER AS rank
FROM r JOIN vocab v USING (term_id) WHERE r.rnk <= {C.TOP_N}"""


def _ve_ctes(iters: int = C.VE_ITERS, alpha: float = 1.0) -> str:
    """Unrolled VE-step: language meta-documents, smoothed source topics."""
    parts = [TOK, PRUNED, LANG, SRC,
             """sc AS (SELECT s.topic, d.term_id, sum(d.cnt)::DOUBLE AS cnt
  FROM dtm5 d JOIN documents x USING (doc_id) JOIN srcs s ON s.source = x.source GROUP BY 1, 2)""",
             f"""cells AS (SELECT s.topic, v.term_id, coalesce(sc.cnt, 0) + {C.SMOOTHING} AS w
  FROM vocab5 v CROSS JOIN srcs s LEFT JOIN sc ON sc.topic = s.topic AND sc.term_id = v.term_id)""",
             "beta AS (SELECT topic, term_id, w / sum(w) OVER (PARTITION BY topic) AS p FROM cells)",
             """meta AS (SELECT a.cluster, d.term_id, sum(d.cnt)::DOUBLE AS cnt
  FROM dtm5 d JOIN asg a USING (doc_id) GROUP BY 1, 2)""",
             "ntot AS (SELECT cluster, sum(cnt) AS n FROM meta GROUP BY cluster)",
             "kk AS (SELECT count(*)::DOUBLE AS k FROM srcs)",
             f"""g0 AS (SELECT n.cluster, s.topic, {alpha} + n.n / (SELECT k FROM kk) AS gamma
  FROM ntot n CROSS JOIN srcs s)"""]
    for i in range(iters + 1):
        parts.append(f"""e{i} AS (SELECT g.cluster, g.topic, g.gamma, s.gs,
    {psi('g.gamma')} - {psi('s.gs')} AS e
  FROM g{i} g JOIN (SELECT cluster, sum(gamma) AS gs FROM g{i} GROUP BY cluster) s USING (cluster))""")
        parts.append(f"""z{i} AS (SELECT m.cluster, m.term_id, m.cnt, sum(b.p * exp(e.e)) AS z
  FROM meta m JOIN beta b USING (term_id) JOIN e{i} e ON e.cluster = m.cluster AND e.topic = b.topic
  GROUP BY m.cluster, m.term_id, m.cnt)""")
        if i < iters:
            parts.append(f"""g{i + 1} AS (SELECT e.cluster, e.topic, {alpha} + exp(e.e) * sum(z.cnt * b.p / z.z) AS gamma
  FROM z{i} z JOIN beta b USING (term_id) JOIN e{i} e ON e.cluster = z.cluster AND e.topic = b.topic
  GROUP BY e.cluster, e.topic, e.e)""")
    f = iters
    parts.append(f"ll AS (SELECT cluster, sum(cnt * ln(z)) AS ll FROM z{f} GROUP BY cluster)")
    parts.append(f"""pp AS (SELECT cluster, any_value(gs) AS gs, sum(e) AS se, sum(lgamma(gamma)) AS slg,
    sum((gamma - 1) * e) AS sge FROM e{f} GROUP BY cluster)""")
    parts.append(f"""elbo AS (SELECT p.cluster,
    lgamma((SELECT k FROM kk) * {alpha}) - (SELECT k FROM kk) * lgamma({alpha})
    + ({alpha} - 1) * p.se + l.ll - lgamma(p.gs) + p.slg - p.sge AS elbo
  FROM pp p JOIN ll l USING (cluster))""")
    parts.append("sizes AS (SELECT cluster, count(*) AS n FROM asg GROUP BY cluster)")
    parts.append("nn AS (SELECT count(DISTINCT doc_id)::DOUBLE AS n FROM documents)")
    return "WITH " + ",\n".join(parts)


def _hash_cluster(q: int) -> str:
    return f"(floor({hash_uniform_sql('doc_id', str(C.SEED), '0')} * {q}) + 1)::INTEGER"


ROLE_TOK = f"""toks AS (
  SELECT conv_id * 1000000 + turn AS doc_id, role, unnest(string_split({NORM}, ' ')) AS term
  FROM conversations),
t AS (SELECT doc_id, role, term FROM toks WHERE length(term) >= 3),
dtm_t AS (SELECT doc_id, term, count(*) AS cnt FROM t GROUP BY doc_id, term)"""


TFIDF = """dfs AS (SELECT term_id, count(*) AS df FROM dtm5 GROUP BY 1),
wts AS (SELECT doc_id, term_id, cnt / sum(cnt) OVER (PARTITION BY doc_id) * log2((SELECT count(DISTINCT doc_id) FROM documents) / df) AS w
        FROM dtm5 JOIN dfs USING (term_id)),
tfidf AS (SELECT doc_id, term_id, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM wts WHERE w > 0)"""


def _mixture_step(i: int) -> str:
    """One M-step and E-step: responsibilities r{i} of r{i - 1}."""
    s = C.SMOOTHING
    return f"""wt{i} AS (SELECT r.cluster, d.term_id, sum(d.cnt * r.r) AS w FROM dtm5 d JOIN r{i - 1} r USING (doc_id) GROUP BY 1, 2),
tot{i} AS (SELECT cluster, sum(w) + {s} * (SELECT v FROM vv) AS t FROM wt{i} GROUP BY 1),
lam{i} AS (SELECT cluster, ln(sum(r) / (SELECT n FROM nn)) AS lw FROM r{i - 1} GROUP BY 1),
th{i} AS (SELECT t.cluster, v.term_id, ln((coalesce(w.w, 0) + {s}) / t.t) AS lp
          FROM tot{i} t CROSS JOIN vocab5 v LEFT JOIN wt{i} w ON w.cluster = t.cluster AND w.term_id = v.term_id),
sc{i} AS (SELECT x.doc_id, l.cluster, l.lw + coalesce(s.s, 0) AS s FROM (SELECT DISTINCT doc_id FROM documents) x CROSS JOIN lam{i} l
          LEFT JOIN (SELECT d.doc_id, t.cluster, sum(d.cnt * t.lp) AS s FROM dtm5 d JOIN th{i} t USING (term_id) GROUP BY 1, 2) s
          ON s.doc_id = x.doc_id AND s.cluster = l.cluster),
ll{i} AS (SELECT doc_id, m + ln(sum(exp(s - m))) AS ll FROM (SELECT *, max(s) OVER (PARTITION BY doc_id) AS m FROM sc{i}) GROUP BY doc_id, m),
r{i} AS (SELECT doc_id, cluster, exp(s - ll) AS r, ll FROM sc{i} JOIN ll{i} USING (doc_id))"""


def _kmeans_step(i: int) -> str:
    """Means of k{i - 1} and the nearest of them; a document stays on a tie."""
    return f"""n{i} AS (SELECT cluster, count(*) AS n FROM k{i - 1} GROUP BY 1),
c{i} AS (SELECT k.cluster, t.term_id, sum(t.w) / any_value(n.n) AS c FROM tfidf t JOIN k{i - 1} k USING (doc_id) JOIN n{i} n USING (cluster) GROUP BY 1, 2),
cn{i} AS (SELECT n.cluster, coalesce(sum(c * c), 0) AS nn FROM n{i} n LEFT JOIN c{i} USING (cluster) GROUP BY 1),
x{i} AS (SELECT k.doc_id, k.cluster AS was, cn.cluster, sqrt(greatest(0, coalesce(x2.x, 0) - 2 * coalesce(s.s, 0) + cn.nn)) AS d
         FROM k{i - 1} k CROSS JOIN cn{i} cn
         LEFT JOIN (SELECT doc_id, sum(w * w) AS x FROM tfidf GROUP BY 1) x2 ON x2.doc_id = k.doc_id
         LEFT JOIN (SELECT t.doc_id, c.cluster, sum(t.w * c.c) AS s FROM tfidf t JOIN c{i} c USING (term_id) GROUP BY 1, 2) s
         ON s.doc_id = k.doc_id AND s.cluster = cn.cluster),
k{i} AS (SELECT doc_id, CASE WHEN min(d) FILTER (cluster = was) <= min(d) THEN any_value(was) ELSE min_by(cluster, (d, cluster)) END AS cluster
         FROM x{i} GROUP BY doc_id)"""


def _gauss_step(i: int) -> str:
    """One M-step (2 x 2 covariances) and E-step: responsibilities g{i} of g{i - 1}."""
    return f"""m{i} AS (SELECT cluster, sum(r) AS n, sum(r * x) / sum(r) AS mx, sum(r * y) / sum(r) AS my,
          sum(r * x * x) / sum(r) AS xx, sum(r * x * y) / sum(r) AS xy, sum(r * y * y) / sum(r) AS yy
          FROM pts JOIN g{i - 1} USING (doc_id) GROUP BY 1),
p{i} AS (SELECT cluster, mx, my, ln(n / (SELECT sum(n) FROM m{i})) AS lw, xx - mx * mx + f AS a, xy - mx * my AS b, yy - my * my + f AS c
         FROM m{i} CROSS JOIN (SELECT f FROM whole)),
sc{i} AS (SELECT doc_id, cluster, lw - ln(2 * pi()) - 0.5 * ln(a * c - b * b)
          - 0.5 * (c * (x - mx) * (x - mx) - 2 * b * (x - mx) * (y - my) + a * (y - my) * (y - my)) / (a * c - b * b) AS s
          FROM pts CROSS JOIN p{i}),
ll{i} AS (SELECT doc_id, m + ln(sum(exp(s - m))) AS ll FROM (SELECT *, max(s) OVER (PARTITION BY doc_id) AS m FROM sc{i}) GROUP BY doc_id, m),
g{i} AS (SELECT doc_id, cluster, exp(s - ll) AS r, ll FROM sc{i} JOIN ll{i} USING (doc_id))"""


SQL: dict[str, str] = {
    "top_terms_by_lang": f"WITH {TOK}, {VOCAB}, {LANG}, {LANG_COUNTS}, {_entropy_ctes('lc', 'SELECT count(*) FROM langs')}, {TOP}",
    "term_frequencies": f"WITH {TOK} SELECT doc_id, term, cnt FROM dtm_t",
    "vocabulary": f"WITH {TOK}, {VOCAB} SELECT term_id, term FROM vocab",
    "vocabulary_de": f"""WITH {TOK},
de AS (SELECT DISTINCT d.term FROM dtm_t d JOIN documents x USING (doc_id) WHERE x.lang = 'de' AND d.cnt > 0)
SELECT (row_number() OVER (ORDER BY term) - 1)::INTEGER AS term_id, term FROM de""",
    "sparse_rows": f"""WITH {TOK}, {VOCAB},
s AS (SELECT doc_id, list(term_id ORDER BY term_id) AS terms,
             list(cnt::DOUBLE ORDER BY term_id) AS cnts FROM dtm GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.terms, []::INTEGER[]) AS terms, coalesce(s.cnts, []::DOUBLE[]) AS cnts
FROM documents d LEFT JOIN s USING (doc_id)""",
    "term_totals": f"""WITH {TOK}, {VOCAB}
SELECT term_id, sum(cnt)::BIGINT AS total, count(DISTINCT doc_id) AS n_docs FROM dtm GROUP BY term_id""",
    "dims": f"""WITH {TOK}, {VOCAB}
SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS n_docs, (SELECT count(*) FROM vocab) AS n_terms,
       (SELECT count(*) FROM dtm) AS nnz, (SELECT coalesce(sum(cnt), 0)::BIGINT FROM dtm) AS n_tokens""",
    "count_matrix_customer_parttype": """
SELECT o.o_custkey, p.p_type, round(sum(l.l_quantity), 4) AS cnt
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
WHERE o.o_custkey IS NOT NULL AND p.p_type IS NOT NULL GROUP BY 1, 2""",
    "count_matrix_user_event": """
SELECT user_id, event_type, count(*) AS cnt FROM events
WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2""",
    "stopword_removal": f"""WITH {TOK},
stop AS (SELECT term FROM dtm_t GROUP BY term HAVING count(*) >= {C.STOP_SHARE} * (SELECT count(*) FROM documents))
SELECT doc_id, term, count(*) AS cnt FROM t WHERE NOT EXISTS (SELECT 1 FROM stop s WHERE s.term = t.term)
GROUP BY doc_id, term""",
    "term_mapping": f"""WITH {TOK},
terms AS (SELECT DISTINCT term FROM t),
smap AS (SELECT a.term, substr(a.term, 1, length(a.term) - 1) AS canonical FROM terms a
         WHERE suffix(a.term, 's') AND length(a.term) > 1
           AND substr(a.term, 1, length(a.term) - 1) IN (SELECT term FROM terms)),
m AS (SELECT t.doc_id, coalesce(s.canonical, t.term) AS term FROM t LEFT JOIN smap s USING (term))
SELECT doc_id, term, count(*) AS cnt FROM m GROUP BY doc_id, term""",
    "cluster_sizes_lang": f"""WITH {LANG}
SELECT cluster, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 12) AS pi
FROM asg GROUP BY cluster""",
    "meta_documents_lang": f"""WITH {TOK}, {VOCAB}, {LANG}
SELECT a.cluster, d.term_id, sum(d.cnt)::BIGINT AS cnt FROM dtm d JOIN asg a USING (doc_id) GROUP BY 1, 2""",
    "cluster_word_counts_lang": f"""WITH {TOK}, {VOCAB}, {LANG}
SELECT a.cluster, sum(d.cnt)::BIGINT AS n_words FROM dtm d JOIN asg a USING (doc_id) GROUP BY 1""",
    "init_random_partition": f"SELECT doc_id, {_hash_cluster(6)} AS cluster FROM documents",
    "init_beta_random": f"""WITH {TOK}, {VOCAB},
cells AS (SELECT k.topic, v.term_id,
  1.0 / (SELECT count(*) FROM vocab) + {hash_uniform_sql(str(C.SEED), 'k.topic', 'v.term_id')} * 1e-10 AS w
  FROM vocab v CROSS JOIN (SELECT unnest(range(1, 5)) AS topic) k)
SELECT topic::INTEGER AS topic, term_id, round(w / sum(w) OVER (PARTITION BY topic), 15) AS p FROM cells""",
    "beta_by_lang": f"""WITH {TOK}, {VOCAB}, {LANG}, {LANG_COUNTS}
SELECT topic, term_id, round(cnt / sum(cnt) OVER (PARTITION BY topic), 12) AS p FROM lc""",
    "beta_by_source_smoothed": _ve_ctes() + """
SELECT topic, term_id, round(p, 12) AS p FROM beta""",
    "topic_weights_by_lang": f"""WITH {TOK}, {VOCAB}, {LANG}, {LANG_COUNTS}, {_entropy_ctes('lc', 'SELECT count(*) FROM langs')}
SELECT topic, term_id, round(p, 12) AS p, round(weight, 12) AS weight FROM w""",
    "ve_gamma_lang_source": _ve_ctes() + f"""
SELECT cluster, topic, round(gamma, 4) AS gamma, round(gamma / gs, 9) AS theta FROM e{C.VE_ITERS}""",
    "ve_elbo_lang_source": _ve_ctes() + """
SELECT e.cluster, n.n::BIGINT AS n_words, round(e.elbo, 2) AS elbo FROM elbo e JOIN ntot n USING (cluster)""",
    "bound_icl_lang_source": _ve_ctes() + """,
bd AS (SELECT sum(coalesce(e.elbo, 0) + s.n * ln(s.n / (SELECT n FROM nn))) AS bound
       FROM sizes s LEFT JOIN elbo e USING (cluster))
SELECT round(bound, 2) AS bound,
  round(bound - (SELECT k FROM kk) * ((SELECT count(*) FROM vocab5) - 1) / 2.0 * ln((SELECT count(*) FROM sizes))
        - ((SELECT count(*) FROM sizes) - 1) / 2.0 * ln((SELECT n FROM nn)), 2) AS icl FROM bd""",
    "batch_round_lang_source": _ve_ctes() + f""",
lnz AS (SELECT e.cluster, b.term_id, ln(sum(b.p * exp(e.e))) AS lnz
        FROM beta b JOIN e{C.VE_ITERS} e ON e.topic = b.topic GROUP BY 1, 2),
ds AS (SELECT d.doc_id, l.cluster, sum(d.cnt * l.lnz) AS s FROM dtm5 d JOIN lnz l USING (term_id) GROUP BY 1, 2),
allc AS (SELECT x.doc_id, s.cluster, coalesce(ds.s, 0) + ln(s.n / (SELECT n FROM nn)) AS score
         FROM (SELECT DISTINCT doc_id FROM documents) x CROSS JOIN sizes s
         LEFT JOIN ds ON ds.doc_id = x.doc_id AND ds.cluster = s.cluster),
rk AS (SELECT doc_id, cluster, score,
        row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, cluster ASC) AS rn FROM allc)
SELECT doc_id, cluster, round(score, 4) AS score FROM rk WHERE rn = 1""",
    "move_meta_lang_source": _ve_ctes() + f""",
lnz AS (SELECT e.cluster, b.term_id, ln(sum(b.p * exp(e.e))) AS lnz
        FROM beta b JOIN e{C.VE_ITERS} e ON e.topic = b.topic GROUP BY 1, 2),
ds AS (SELECT d.doc_id, l.cluster, sum(d.cnt * l.lnz) AS s FROM dtm5 d JOIN lnz l USING (term_id) GROUP BY 1, 2),
allc AS (SELECT x.doc_id, s.cluster, coalesce(ds.s, 0) + ln(s.n / (SELECT n FROM nn)) AS score
         FROM (SELECT DISTINCT doc_id FROM documents) x CROSS JOIN sizes s
         LEFT JOIN ds ON ds.doc_id = x.doc_id AND ds.cluster = s.cluster),
rk AS (SELECT doc_id, cluster,
        row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, cluster ASC) AS rn FROM allc)
SELECT r.cluster, d.term_id, sum(d.cnt)::BIGINT AS cnt
FROM dtm5 d JOIN rk r ON r.doc_id = d.doc_id AND r.rn = 1 GROUP BY 1, 2""",
    "tidy_beta_lang": f"""WITH {TOK}, {VOCAB}, {LANG}, {LANG_COUNTS}
SELECT l.topic, v.term, round(l.cnt / sum(l.cnt) OVER (PARTITION BY l.topic), 12) AS beta
FROM lc l JOIN vocab v USING (term_id)""",
    "contingency_lang_quality": """
SELECT d.lang AS a, l.quality AS b, count(*) AS n FROM documents d JOIN labels l USING (doc_id) GROUP BY 1, 2""",
    "ari_lang_source": """WITH c AS (SELECT lang AS a, source AS b, count(*) AS n FROM documents GROUP BY 1, 2),
s AS (SELECT sum(n * (n - 1) / 2.0) AS sij, sum(n) AS nn FROM c),
sa AS (SELECT sum(na * (na - 1) / 2.0) AS sa FROM (SELECT a, sum(n) AS na FROM c GROUP BY a)),
sb AS (SELECT sum(nb * (nb - 1) / 2.0) AS sb FROM (SELECT b, sum(n) AS nb FROM c GROUP BY b)),
x AS (SELECT sij, sa * sb / (nn * (nn - 1) / 2.0) AS ex, (sa + sb) / 2.0 AS mx FROM s, sa, sb)
SELECT round(CASE WHEN mx = ex THEN 1.0 ELSE (sij - ex) / (mx - ex) END, 12) AS ari FROM x""",
    "top_terms_by_role": f"""WITH {ROLE_TOK}, {VOCAB},
roles AS (SELECT role, (row_number() OVER (ORDER BY role))::INTEGER AS topic
          FROM (SELECT DISTINCT role FROM conversations WHERE role IS NOT NULL)),
rc AS (SELECT r.topic, d.term_id, sum(d.cnt)::DOUBLE AS cnt
       FROM dtm d JOIN (SELECT DISTINCT doc_id, role FROM t) x USING (doc_id)
       JOIN roles r USING (role) GROUP BY 1, 2),
{_entropy_ctes('rc', 'SELECT count(*) FROM roles')}, {TOP}""",
    "tfidf_unit_rows": f"""WITH {TOK}, {PRUNED}, {TFIDF}
SELECT doc_id, term_id, round(w, 9) AS w FROM tfidf""",
    "mixture_two_steps": f"""WITH {TOK}, {PRUNED}, {LANG},
nn AS (SELECT count(DISTINCT doc_id)::DOUBLE AS n FROM documents), vv AS (SELECT count(*) AS v FROM vocab5),
r0 AS (SELECT doc_id, cluster, 1.0::DOUBLE AS r FROM asg),
{_mixture_step(1)}, {_mixture_step(2)}
SELECT doc_id, max_by(cluster, (r, -cluster)) AS cluster, round(max(ll), 4) AS loglik FROM r2 GROUP BY doc_id""",
    "kmeans_two_steps": f"""WITH {TOK}, {PRUNED}, {TFIDF}, {LANG},
k0 AS (SELECT doc_id, cluster FROM asg),
{_kmeans_step(1)}, {_kmeans_step(2)}
SELECT doc_id, cluster FROM k2""",
    "gaussian_two_steps": f"""WITH {LANG},
raw AS (SELECT doc_id, ln(length(coalesce(text, '')) + 1.0) AS x, ln(len(string_split(coalesce(text, ''), ' ')) + 0.0) AS y FROM documents WHERE doc_id IS NOT NULL),
mid AS (SELECT avg(x) AS cx, avg(y) AS cy FROM raw),
pts AS (SELECT doc_id, x - cx AS x, y - cy AS y FROM raw CROSS JOIN mid),
whole AS (SELECT {C.GAUSS_RIDGE} * greatest((avg(x * x) + avg(y * y)) / 2, 1e-12) AS f FROM pts),
g0 AS (SELECT doc_id, cluster, 1.0::DOUBLE AS r FROM asg),
{_gauss_step(1)}, {_gauss_step(2)}
SELECT doc_id, max_by(cluster, (r, -cluster)) AS cluster, round(max(ll), 5) AS loglik FROM g2 GROUP BY doc_id""",
}
