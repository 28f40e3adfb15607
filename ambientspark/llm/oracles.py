"""DuckDB statements for the corpus queries that SQL can express."""

from __future__ import annotations

from ambientspark.llm import quality


def _rules(rules) -> str:
    parts = []
    for r in rules:
        parts += [f"{r.metric} < {r.least}"] if r.least is not None else []
        parts += [f"{r.metric} > {r.most}"] if r.most is not None else []
    return "coalesce(" + ", false) OR coalesce(".join(parts) + ", false)"


_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))

QUALITY = rf"""
WITH numbered AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), split AS (
  SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM numbered
), windows AS (
  SELECT rid, i, array_to_string(words[i:i + 4], ' ') AS w
  FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM split)
), often AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS c FROM windows
), covered AS (
  SELECT rid, sum(least(5, coalesce(nxt - i, 5))) AS n
  FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM often WHERE c > 1) GROUP BY rid
), counted AS (
  SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(covered.n, 0) AS n_repeat_words, len(lines) AS n_lines,
         len(list_filter(words, lambda x: x IN ({_STOP}))) AS n_stop, len(regexp_extract_all(text, '\p{{Lu}}')) AS n_upper
  FROM split LEFT JOIN covered USING (rid)
), ratios AS (
  SELECT *, 100 * n_repeat_words / nullif(n_words, 0) AS repeat_percent, word_chars / nullif(n_words, 0) AS mean_word_chars,
         n_symbols / nullif(n_words, 0) AS symbols_per_word,
         CASE WHEN n_words >= {quality.STOP_WORDS_FROM} THEN n_stop / n_words END AS stop_word_ratio,
         n_upper / nullif(word_chars, 0) AS upper_char_ratio, n_dup_lines / nullif(n_lines, 0) AS dup_line_ratio
  FROM counted
), failed AS (
  SELECT *, {_rules(quality.BASE)} AS base_failed, {_rules(quality.RULES)} AS rule_failed FROM ratios
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND NOT rule_failed AS kept
FROM failed
"""

REVISITS = r"""
WITH bare AS (
  SELECT page_id, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^(?i)https?://', '') AS b FROM pages
), parts AS (
  SELECT page_id, html,
         regexp_replace(regexp_replace(lower(regexp_extract(b, '^([^/?]*)', 1)), '^.*@', ''), ':(80|443)$', '') AS host,
         regexp_extract(b, '^[^/?]*([^?]*)', 1) AS path,
         list_sort(list_filter(string_split(regexp_extract(b, '\?(.*)$', 1), '&'),
                   lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^(utm_[^=]*|gclid|fbclid|ref|sessionid)(=|$)'))) AS args
  FROM bare
), keyed AS (
  SELECT page_id, md5(html) AS digest, strlen(html) AS bytes, page_id * 600 AS stored_at, page_id * 600 + 34560000 AS "at",
         host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END AS url_key
  FROM parts
), found AS (
  SELECT v.page_id, v.url_key, v."at", v.digest AS tag,
         max_by(r.page_id, r.stored_at) AS rid, max_by(r.digest, r.stored_at) AS rdigest, max_by(r.bytes, r.stored_at) AS rbytes
  FROM keyed v LEFT JOIN keyed r ON r.url_key = v.url_key AND r.stored_at < v."at"
  GROUP BY ALL
)
SELECT 'v' || page_id AS record_id, url_key, "at", 'r' || rid AS response_id,
       CASE WHEN rid IS NULL THEN 'no_response' WHEN tag = rdigest THEN 'resolved' ELSE 'mismatch' END AS status,
       'cache-control=max-age=60;content-length=' || CASE WHEN tag = rdigest THEN rbytes ELSE 0 END || ';etag="' || tag || '"' AS headers,
       CASE WHEN tag = rdigest THEN rdigest END AS payload_digest
FROM found
"""
