"""DuckDB SQL with the rows of those opN queries that SQL can express."""

from __future__ import annotations

from .url_filter import LEAST_PRECISION, MOST_PRECISION, RULES

_COMPONENTS = """w AS (SELECT id AS start, id AS node FROM n UNION SELECT w.start, e.b FROM w JOIN e ON e.a = w.node),
c AS (SELECT start AS id, min(node) AS component_id FROM w GROUP BY start)"""

OP2 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, a || ' ' || b || ' ' || c AS gram FROM (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) >= 3))),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT g.doc_id, g.i, unnest([0, 1, 2]) AS j FROM g JOIN (SELECT doc_id, gram FROM g GROUP BY ALL HAVING count(*) > 1) USING (doc_id, gram)) GROUP BY doc_id),
t AS (SELECT doc_id, max(n) AS top, sum(n) FILTER (regexp_matches(w, '[A-Za-z\x{C0}-\x{10FFFF}]')) AS letters FROM (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS w FROM d) GROUP BY ALL) GROUP BY doc_id),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines, coalesce(top, 0) AS top, coalesce(letters, 0) AS letters FROM d JOIN l USING (doc_id) LEFT JOIN r USING (doc_id) LEFT JOIN t USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND word_chars BETWEEN 2 * n_words AND 15 * n_words AND 100 * n_symbols <= 30 * n_words
  AND 100 * n_dup_lines <= 50 * n_lines AND 100 * letters >= 60 * n_words AND 100 * top <= 40 * n_words AS kept FROM b
"""


def _rule_sql(value: dict) -> str:
    """The value of the longest rule that fits, as nested CASEs."""
    out = "NULL"
    for rule in sorted(RULES, key=lambda r: (len(r[1] + r[2]), r)):
        _, host, path = rule
        out = f"CASE WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{value[rule]}' ELSE {out} END"
    return out


def _level(name: str, above: str) -> str:
    """Counts, prior mean, precision and posterior of one level of the hierarchy."""
    group = f"SELECT {name} AS name, {above} AS above, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k FROM hosts GROUP BY ALL"
    prior = "SELECT g.*, (SELECT sum(k) / sum(n) FROM hosts) AS m FROM g0 g" if name == "suffix" else f"SELECT g.*, p.mean AS m FROM g0 g JOIN {above}_p p ON p.name = g.above"
    return f"""{name}_c AS (WITH g0 AS ({group}) {prior}),
{name}_s AS (SELECT sum(n * power(k / n - m, 2)) AS s, sum(m * (1 - m)) AS e, sum(m * (1 - m) * (n - 1)) AS d FROM {name}_c),
{name}_w AS (SELECT CASE WHEN d IS NULL OR d < 1e-12 THEN {MOST_PRECISION} ELSE round(least(greatest(1 / greatest((s - e) / d, 1e-9) - 1, {LEAST_PRECISION}), {MOST_PRECISION}), 6) END AS w FROM {name}_s),
{name}_p AS (SELECT name, a / (a + b) AS mean, a / (a + b) + 1.645 * sqrt(a * b / (power(a + b, 2) * (a + b + 1))) AS bound FROM (SELECT name, w * m + k AS a, w * (1 - m) + n - k AS b FROM {name}_c, {name}_w))"""


OP3 = rf"""
WITH u AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
f AS (SELECT *, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix FROM p),
lab AS (SELECT host, domain, suffix, (quality = 1 AND toxic = 0)::INT AS good FROM f JOIN labels ON doc_id = try_cast(regexp_extract(path, '/([0-9]{{1,18}})(?:\.html|/)?$', 1) AS BIGINT) WHERE quality IS NOT NULL AND toxic IS NOT NULL),
hosts AS (SELECT host, domain, suffix, count(*) AS n, sum(good) AS k FROM lab GROUP BY ALL),
{_level("suffix", "NULL")}, {_level("domain", "suffix")}, {_level("host", "domain")},
v AS (SELECT f.*, {_rule_sql({r: r[1] + r[2] for r in RULES})} AS rule, {_rule_sql({r: r[0] for r in RULES})} AS fixed, coalesce(h.bound, d.bound, s.bound, 1.0) AS bound FROM f LEFT JOIN host_p h ON h.name = host LEFT JOIN domain_p d ON d.name = domain LEFT JOIN suffix_p s ON s.name = suffix)
SELECT page_id, host, path, rule, coalesce(fixed, CASE WHEN bound < 0.5 THEN 'block' ELSE 'allow' END) AS verdict, round(bound, 4) AS good_bound FROM v
"""

OP5 = f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
e AS (SELECT p.id AS a, q.id AS b FROM v p JOIN v q ON p.id <> q.id AND len(p.x) = len(q.x) AND list_cosine_similarity(p.x, q.x) >= 0.95),
n AS (SELECT vec_id AS id FROM embeddings), {_COMPONENTS}
SELECT id AS vec_id, coalesce(k, 0)::BIGINT AS n_links, component_id, id = component_id AS kept FROM c LEFT JOIN (SELECT a, count(*) AS k FROM e GROUP BY a) k ON k.a = id
"""

OP6 = rf"""
WITH RECURSIVE d AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT id, g FROM (SELECT id, ws[i] || ' ' || ws[i + 1] AS g FROM (SELECT id, ws, unnest(range(1, len(ws))) AS i FROM d WHERE len(ws) >= 2) UNION ALL SELECT id, ws[1] FROM d WHERE len(ws) = 1)),
s AS (SELECT id, count(*) AS n FROM g GROUP BY id),
-- a pair with 80 % of the union in common shares a shingle among the rarest 20 % + 1 of either set
o AS (SELECT id, g, row_number() OVER (PARTITION BY id ORDER BY f, g) AS r FROM g JOIN (SELECT g, count(*) AS f FROM g GROUP BY g) USING (g)),
x AS (SELECT id, g FROM o JOIN s USING (id) WHERE r <= n - ceil(0.8 * n) + 1),
q AS (SELECT DISTINCT a.id AS a, b.id AS b FROM x a JOIN x b ON a.g = b.g AND a.id < b.id),
j AS (SELECT q.a, q.b, count(*) AS k FROM q JOIN g u ON u.id = q.a JOIN g v ON v.id = q.b AND v.g = u.g GROUP BY ALL),
l AS (SELECT a, b FROM j JOIN s sa ON sa.id = a JOIN s sb ON sb.id = b WHERE 100 * k >= 80 * (sa.n + sb.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), n AS (SELECT id FROM d), {_COMPONENTS}
SELECT id AS doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, component_id, id = component_id AS kept FROM c LEFT JOIN s USING (id)
"""
