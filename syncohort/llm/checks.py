"""SQL texts of the queries that SQL can express, for DuckDB, over whole tables."""

from __future__ import annotations

from syncohort.llm.licenses import COPYRIGHT, KNOWN, SIGNS, SPELLINGS
from syncohort.llm.urls import BLOCKED_NAMES, SITE_RULES

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def near_duplicates_sql(size: int, percent: int) -> str:
    """All pairs of different shingle sets that share a shingle, then reachable classes."""
    return rf"""
WITH RECURSIVE worded AS (
  SELECT doc_id, [w FOR w IN regexp_split_to_array({_LOWER.format("coalesce(text, '')")},
    '[\x20\x09-\x0D]+') IF w <> ''] AS words FROM documents),
cut AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {size}
    THEN [array_to_string(words, ' ')]
    ELSE list_distinct([array_to_string(words[i:i + {size - 1}], ' ')
      FOR i IN range(1, len(words) - {size - 2})]) END AS shingles FROM worded),
sets AS (
  SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n,
    sha256(array_to_string(list_sort(shingles), chr(10))) AS digest, shingles FROM cut),
classes AS (
  SELECT digest, min(doc_id) AS rep, any_value(n) AS n, any_value(shingles) AS shingles
  FROM sets WHERE n > 0 AND doc_id IS NOT NULL GROUP BY digest),
held AS (SELECT rep, n, unnest(shingles) AS shingle FROM classes),
links AS (
  SELECT a.rep AS a, b.rep AS b FROM held a JOIN held b ON a.shingle = b.shingle
    AND a.rep < b.rep AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n
  HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT rep AS node, rep AS other FROM classes
  UNION SELECT r.node, w.b FROM reached r JOIN both_ways w ON w.a = r.other),
groups AS (SELECT node, min(other) AS component FROM reached GROUP BY node),
named AS (
  SELECT s.doc_id, s.n, CASE WHEN s.doc_id IS NOT NULL THEN coalesce(g.component, s.doc_id) END
    AS component_id FROM sets s LEFT JOIN classes c ON c.digest = s.digest
    LEFT JOIN groups g ON g.node = c.rep)
SELECT doc_id, n AS n_shingles, component_id, coalesce(doc_id = component_id, true) AS kept
FROM named"""


def _canonical(text: str) -> str:
    low = _LOWER.format(text)
    kept = f"regexp_replace(chr(10) || {low}, {_text(COPYRIGHT)}, '', 'g')"
    out = f"(' ' || regexp_replace({kept}, {_text(SIGNS)}, ' ', 'g') || ' ')"
    out = f"replace({out}, ' ', '  ')"
    for other, usual in SPELLINGS.items():
        out = f"replace({out}, {_text(f' {other} ')}, {_text(f' {usual} ')})"
    return f"regexp_replace({out}, ' +', ' ', 'g')"


def licenses_sql() -> str:
    """Digests of whole texts and lines, looked up in the digests of the known texts."""
    known = ", ".join(f"({_text(k)}, {_text(t)})" for k, t in KNOWN.items())
    digest = "nullif(sha256({0}), sha256(' '))"
    return f"""
WITH listed AS (
  SELECT {digest.format(_canonical("text"))} AS digest, min(license_id) AS license_id
  FROM (VALUES {known}) AS k(license_id, text) GROUP BY 1),
lines AS (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
noticed AS (
  SELECT doc_id, count(DISTINCT license_id) AS n,
    string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
  FROM (SELECT doc_id, {digest.format(_canonical("line"))} AS digest FROM lines) l
  JOIN listed USING (digest) GROUP BY doc_id),
whole AS (SELECT doc_id, {digest.format(_canonical("text"))} AS digest FROM documents)
SELECT w.doc_id, w.digest, k.license_id, coalesce(m.n, 0) AS n_notices,
  coalesce(m.notices, '') AS notices
FROM whole w LEFT JOIN listed k ON k.digest = w.digest LEFT JOIN noticed m ON m.doc_id = w.doc_id"""


def urls_sql() -> str:
    """Every rule on every URL, without the token index."""
    rules = ", ".join(
        f"({_text(verdict)}, {_text(name)}, {_text(host)}, {_text(slash + path)})"
        for verdict, name in SITE_RULES
        for host, slash, path in [name.partition("/")]
    )
    blocked = " OR ".join(
        f"contains('.' || host, {_text('.' + word + end)})" for word in BLOCKED_NAMES for end in ".-"
    )
    return f"""
WITH rules AS (SELECT * FROM (VALUES {rules}) AS r(verdict, name, host, path)),
rests AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3)
    ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, {_LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
places AS (SELECT DISTINCT host, path FROM parts),
best AS (
  SELECT p.host, p.path, arg_max(r.name, length(r.name)) AS rule,
    arg_max(r.verdict, length(r.name)) AS verdict
  FROM places p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host))
    AND starts_with(p.path, r.path) GROUP BY p.host, p.path)
SELECT p.page_id, p.host, p.path, b.rule,
  coalesce(b.verdict, CASE WHEN {blocked.replace("host", "p.host")} THEN 'block' ELSE 'allow' END)
    AS verdict
FROM parts p LEFT JOIN best b ON b.host = p.host AND b.path = p.path"""


def hard_negatives_sql() -> str:
    """All scores of the anchors, then the first rows by window."""
    return """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * CAST(c AS DOUBLE)) FOR c IN embedding] AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM vectors a JOIN vectors b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.positive_id,
  CAST(row_number() OVER near AS INTEGER) AS rank,
  n.id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 80 * p.positive_score <= 100 * n.score AND n.score <= p.positive_score
WINDOW near AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.id)
QUALIFY row_number() OVER near <= 5"""


CHECKS = {
    "op3_minhash": near_duplicates_sql(4, 80),
    "op6_licenses": licenses_sql(),
    "op10_urls": urls_sql(),
    "op13_hard_negatives": hard_negatives_sql(),
}
