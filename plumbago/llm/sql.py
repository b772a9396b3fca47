"""DuckDB SQL of the corpus operators that SQL can express, over the whole tables."""

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, w[i:i + 4] AS g FROM d, unnest(range(1, len(w) - 3)) t(i)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
cov AS (SELECT doc_id, sum(least(5, step)) AS n FROM (SELECT doc_id, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), i - 5) AS step FROM rep) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN cov USING (doc_id)),
r AS (
  SELECT *, len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         100 * word_chars // greatest(n_words, 1) AS length, 1000 * n_symbols // greatest(n_words, 1) AS symbols,
         1000 * n_dup_lines // greatest(n_lines, 1) AS lines
  FROM m),
flat AS (
  SELECT lang, source, ratio, (v >> greatest(length(bin(v)) - 8, 0)) << greatest(length(bin(v)) - 8, 0) AS bucket
  FROM (SELECT lang, source, unnest(['length', 'symbols', 'lines']) AS ratio, unnest([length, symbols, lines]) AS v FROM r WHERE NOT base_failed)),
levels AS (
  SELECT 0 AS level, lang, source, ratio, bucket FROM flat UNION ALL
  SELECT 1, lang, NULL, ratio, bucket FROM flat UNION ALL
  SELECT 2, NULL, NULL, ratio, bucket FROM flat),
hist AS (SELECT level, lang, source, ratio, bucket, count(*) AS n FROM levels GROUP BY ALL),
cum AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, ratio ORDER BY bucket) AS below, sum(n) OVER (PARTITION BY level, lang, source, ratio) AS docs FROM hist),
q AS (
  SELECT level, lang, source, ratio, any_value(docs)::DOUBLE AS docs,
         min(bucket) FILTER (100 * below >= CASE ratio WHEN 'length' THEN 25 WHEN 'symbols' THEN 50 ELSE 99 END * docs)::DOUBLE AS lo,
         min(bucket) FILTER (100 * below >= CASE ratio WHEN 'length' THEN 75 WHEN 'symbols' THEN 85 ELSE 99 END * docs)::DOUBLE AS hi
  FROM cum GROUP BY ALL),
l AS (
  SELECT b.lang, b.ratio, (b.docs * b.lo + 10.0::DOUBLE * c.lo) / (b.docs + 10.0::DOUBLE) AS lo, (b.docs * b.hi + 10.0::DOUBLE * c.hi) / (b.docs + 10.0::DOUBLE) AS hi
  FROM q b JOIN q c ON c.level = 2 AND b.ratio = c.ratio WHERE b.level = 1),
t AS (
  SELECT a.lang, a.source, a.ratio, (a.docs * a.lo + 10.0::DOUBLE * l.lo) / (a.docs + 10.0::DOUBLE) AS lo, (a.docs * a.hi + 10.0::DOUBLE * l.hi) / (a.docs + 10.0::DOUBLE) AS hi
  FROM q a JOIN l ON a.ratio = l.ratio AND a.lang IS NOT DISTINCT FROM l.lang WHERE a.level = 0),
f AS (
  SELECT lang, source, max(lo) FILTER (ratio = 'length') AS len_lo, max(hi) FILTER (ratio = 'length') AS len_hi,
         max(lo) FILTER (ratio = 'symbols') AS sym_lo, max(hi) FILTER (ratio = 'symbols') AS sym_hi, max(hi) FILTER (ratio = 'lines') AS lin
  FROM t GROUP BY ALL),
e AS (
  SELECT r.*, len_lo, len_hi, 3.0::DOUBLE * (len_hi - len_lo) AS spread, 700.0::DOUBLE / sqrt(greatest(n_words, 1)::DOUBLE) AS slack,
         (sym_hi + 3.0::DOUBLE * (sym_hi - sym_lo)) * n_words::DOUBLE / 1000.0::DOUBLE AS e_sym, lin * n_lines::DOUBLE / 1000.0::DOUBLE AS e_lin
  FROM r LEFT JOIN f ON r.lang IS NOT DISTINCT FROM f.lang AND r.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(
         length::DOUBLE BETWEEN len_lo - spread - slack AND len_hi + spread + slack
         AND n_symbols::DOUBLE <= e_sym + 3.0::DOUBLE * sqrt(e_sym) + 3.0::DOUBLE
         AND n_dup_lines::DOUBLE <= e_lin + 3.0::DOUBLE * sqrt(e_lin) + 3.0::DOUBLE, false) AS kept
FROM e
"""
