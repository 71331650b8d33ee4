"""DuckDB SQL for the queries that SQL can express."""

OP2 = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm, length(coalesce(text, '')) AS n
  FROM documents
), g AS (
  SELECT doc_id, sha256(norm) AS text_sha256,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

_SHRINK = """
{x}_up AS (SELECT t.*, p.mean FROM {x}_n t {join}),
{x}_s AS (
  SELECT coalesce(sum(n * (good / n - mean) * (good / n - mean)), 0) AS q, coalesce(sum(mean * (1 - mean)), 0) AS v1, coalesce(sum((n - 1) * mean * (1 - mean)), 0) AS v2
  FROM {x}_up WHERE n > 0
),
{x} AS (
  SELECT u.* EXCLUDE (mean), s * mean + good AS a, s * (1 - mean) + n - good AS b, (s * mean + good) / (s + n) AS mean
  FROM {x}_up u, (SELECT CASE WHEN v2 > 0 AND q - v1 > 0 THEN least(1000.0, greatest(2.0, 1 / ((q - v1) / v2) - 1)) ELSE 1000.0 END AS s FROM {x}_s)
)"""

OP5 = (
    r"""
WITH u AS (
  SELECT page_id,
         CASE WHEN contains(url, '://') THEN lower(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)) ELSE '' END AS host,
         CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages
), r AS (
  SELECT *, CASE
      WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND prefix(path, '/en/1') THEN 'example.org/en/1'
      WHEN (host = 'example.org' OR suffix(host, '.example.org')) AND prefix(path, '/es/') THEN 'example.org/es/'
      WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/de/') THEN 'com/de/'
      WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/fr/') THEN 'com/fr/'
      WHEN (host = 'org' OR suffix(host, '.org')) AND prefix(path, '/') THEN 'org/'
    END AS rule
  FROM u
), v AS (
  SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled FROM r
), h_n AS (
  SELECT host, CASE WHEN regexp_matches(host, '(^|\.)(co|com|org|net|ac|gov|edu)\.[a-z]{2}$') THEN array_to_string(string_split(host, '.')[-3:], '.')
         ELSE array_to_string(string_split(host, '.')[-2:], '.') END AS domain,
         count(ruled)::DOUBLE AS n, count(*) FILTER (ruled = 'allow')::DOUBLE AS good
  FROM v GROUP BY host
), d_n AS (SELECT domain, string_split(domain, '.')[-1] AS suffix, sum(n) AS n, sum(good) AS good FROM h_n GROUP BY domain),
s_n AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM d_n GROUP BY suffix),
root AS (SELECT (coalesce(sum(good), 0) + 1) / (coalesce(sum(n), 0) + 2) AS mean FROM s_n),"""
    + _SHRINK.format(x="s", join="CROSS JOIN root p")
    + ","
    + _SHRINK.format(x="d", join="JOIN s p USING (suffix)")
    + ","
    + _SHRINK.format(x="h", join="JOIN d p USING (domain)")
    + """
SELECT page_id, v.host, v.path, v.rule,
       coalesce(ruled, CASE WHEN round(mean - sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 9) >= 0.5 THEN 'allow' ELSE 'block' END) AS verdict
FROM v JOIN h USING (host)
"""
)

SQL = {"op2_exact_dedup": OP2, "op5_url_filter": OP5}
