"""DuckDB SQL for the rows of those queries that SQL can express."""

from __future__ import annotations

from .license_scan import COVERED, NEAR, NOTES, PHRASES
from .quality_rules import DEVIATIONS, REJECTED, SURE, WATCHED, WEAKEST
from .quality_rules import RULES as HOST_RULES
from .queries import AWAY, REPORTED, SITES
from .url_filter import RULES


def values(rows) -> str:
    """Rows as a SQL VALUES list."""
    one = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return ", ".join("(" + ", ".join(map(one, row)) + ")" for row in rows)


WARC = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS d FROM pages),
l AS (SELECT page_id, strlen(t)::BIGINT AS n, d, max(page_id) FILTER (WHERE strlen(t) >= 1000) OVER (PARTITION BY d) AS top FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM l
"""

LICENSE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), raw AS (
  SELECT string_split(p, ' ') AS t, label, base FROM (VALUES {values([(p, x, True) for p, x in PHRASES] + [(p, x, False) for p, x in NOTES])}) v(p, label, base)
), templates AS (
  SELECT row_number() OVER () AS template, * FROM raw
), tg AS (
  SELECT template, label, base, len(t) - 2 AS runs, unnest(range(0, len(t) - 2)) AS q, t FROM templates
), tgrams AS (
  SELECT template, label, base, runs, q, t[q + 1] || ' ' || t[q + 2] || ' ' || t[q + 3] AS g FROM tg
), dg AS (
  SELECT r, w, unnest(range(0, len(w) - 2)) AS p FROM d WHERE len(w) >= 3
), votes AS (
  SELECT r, template, label, base, runs, p - q AS diagonal, list(DISTINCT q) AS seen FROM dg JOIN tgrams ON g = w[p + 1] || ' ' || w[p + 2] || ' ' || w[p + 3]
  GROUP BY ALL
), apart AS (
  SELECT *, base AND len(seen) = runs AS exact,
    CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) <= {NEAR} THEN 0 ELSE 1 END AS a FROM votes
), grouped AS (
  SELECT *, sum(a) OVER (PARTITION BY r, template ORDER BY diagonal) AS span FROM apart
), spans AS (
  SELECT r, template, label, base, runs, span, len(list_distinct(flatten(list(seen)))) AS seen, count(*) FILTER (WHERE exact) AS places,
    min(diagonal) FILTER (WHERE exact) AS lo, max(diagonal) FILTER (WHERE exact) AS hi FROM grouped GROUP BY ALL
), shares AS (
  SELECT *, CASE WHEN base THEN CASE WHEN places > 0 THEN 1.0 ELSE 0.0 END ELSE seen / runs END::DOUBLE AS share FROM spans
), j AS (
  SELECT r, sum(places)::BIGINT AS n_base, min(lo)::BIGINT AS first_word, max(hi)::BIGINT AS last_word,
    array_to_string(list_sort(coalesce(list(DISTINCT label) FILTER (WHERE places > 0), [])), ',') AS base_labels,
    array_to_string(list_sort(coalesce(list(DISTINCT label) FILTER (WHERE places > 0 OR (NOT base AND share >= {COVERED})), [])), ',') AS labels, max(share) AS score
  FROM shares GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN j USING (r)
"""

URLS = rf"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages
), rules(rh, rp, rv) AS (VALUES {values(RULES)}), canonical AS (
  SELECT DISTINCT host || CASE WHEN path = '' THEN '/' ELSE path END AS e FROM u WHERE host != ''
), listed AS (
  SELECT e FROM canonical WHERE substr(md5(e), 1, 1) IN ({", ".join(f"'{x}'" for x in REPORTED)})
  UNION SELECT '{AWAY}' || e FROM canonical UNION SELECT * FROM (VALUES {values((x,) for x in SITES)})
),
j AS (
  SELECT page_id, host, path,
    (SELECT max_by(rh || rp, len(rh || rp) * 1000 + len(rh)) FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS rule,
    (SELECT max_by(rv, len(rh || rp) * 1000 + len(rh)) FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS ruled,
    host != '' AND EXISTS (SELECT 1 FROM listed WHERE (host = split_part(e, '/', 1) OR ends_with(host, '.' || split_part(e, '/', 1))) AND
      (CASE WHEN path = '' THEN '/' ELSE path END = substr(e, position('/' IN e)) OR (ends_with(e, '/') AND starts_with(CASE WHEN path = '' THEN '/' ELSE path END, substr(e, position('/' IN e)))))) AS listed
  FROM u
)
SELECT page_id, host, path, rule, listed, coalesce(ruled, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict FROM j
"""

QUALITY = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d
), windows AS (
  SELECT r, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3
), tri AS (
  SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM windows
), rep AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM tri) WHERE c > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) o(k) GROUP BY r
), lines AS (
  SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), m AS (
  SELECT w.r, w.doc_id, w.source AS host, len(words)::BIGINT AS n_words,
    len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN lines USING (r) LEFT JOIN covered USING (r)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
), rules AS (
  {" UNION ALL ".join(f"SELECT r, doc_id, host, {i} AS rule, ({rule}) AS fails FROM f" for i, (_, rule) in enumerate(HOST_RULES))}
), counts AS (
  SELECT host, rule, count(*)::DOUBLE AS n, sum(fails::INT)::DOUBLE AS x FROM rules WHERE host IS NOT NULL GROUP BY ALL
), total AS (
  SELECT rule, sum(n) AS n_all, sum(x) / sum(n) AS p, count(*) AS hosts, sum(n * n) AS nn FROM counts GROUP BY rule
), spread AS (
  SELECT rule, sum(n * (x / n - p) * (x / n - p)) AS spread FROM counts JOIN total USING (rule) GROUP BY rule
), r AS (
  SELECT rule, p, CASE WHEN p * (1 - p) > 0 AND hosts > 1 THEN (spread - p * (1 - p) * (hosts - 1)) / (p * (1 - p) * (n_all - nn / n_all - (hosts - 1))) END AS rho
  FROM total JOIN spread USING (rule)
), prior AS (
  SELECT rule, p, CASE WHEN rho > 0 THEN greatest({WEAKEST}, 1 / rho - 1) END AS k FROM r
), rates AS (
  SELECT host, rule, p, rate, sqrt(rate * (1 - rate) / (n + k + 1)) AS deviation
  FROM (SELECT host, rule, n, p, k, (x + p * k) / (n + k) AS rate FROM counts JOIN prior USING (rule))
), bad AS (
  SELECT host FROM rates WHERE rule = 0 AND rate - {DEVIATIONS} * deviation > {REJECTED}
), watched AS (
  SELECT DISTINCT r FROM rules JOIN rates USING (host, rule) WHERE fails AND rate - {SURE} * deviation > {WATCHED} * p
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  concat_ws(',', {", ".join(f"CASE WHEN {rule} THEN '{name}' END" for name, rule in HOST_RULES)}) AS failed_rules,
  bad.host IS NOT NULL AS host_rejected, NOT base_failed AND bad.host IS NULL AND watched.r IS NULL AS kept
FROM f LEFT JOIN bad USING (host) LEFT JOIN watched USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_warc_bundles": WARC, "op6_license_scan": LICENSE, "op8_url_filter": URLS, "op4_host_quality": QUALITY}
