"""SQL twins (DuckDB) of the queries that SQL can express."""

from __future__ import annotations

from .quality_rules import ALPHA, DELTA, GRIDS, MAX_REPEAT_PCT, MIN_WORDS
from .url_filter import OP8_SQL

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

OP2_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, body, strlen(body) AS payload_bytes, sha1(body) AS hex FROM p),
b AS (SELECT page_id, body, payload_bytes,  -- five hexadecimal digits are four of base 32
  list_aggregate(list_transform(range(8), lambda g: list_aggregate(list_transform(range(4), lambda k: '{_BASE32}'[(('0x' || hex[g * 5 + 1:g * 5 + 5])::BIGINT >> (15 - 5 * k)) % 32 + 1]), 'string_agg', '')), 'string_agg', '') AS payload_digest FROM d),
f AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS first FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM f
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP6_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)),
m AS (SELECT doc_id, item_id, i, dw.n FROM dw JOIN iw ON dw.n = iw.n AND dw.s = iw.s),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY 1),
iw2 AS (SELECT item_id, j, least(13, len(w)) AS n, array_to_string(w[j:j + least(13, len(w)) - 1], ' ') AS s FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(j) WHERE len(w) > 0),
diag AS (SELECT doc_id, item_id, n, i - j AS k, i - row_number() OVER (PARTITION BY doc_id, item_id, i - j ORDER BY i) AS run FROM dw JOIN iw2 USING (n, s)),
l AS (SELECT doc_id, max(c) AS longest FROM (SELECT doc_id, any_value(n) - 1 + count(*) AS c FROM diag GROUP BY doc_id, item_id, k, run) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, CAST(coalesce(longest, 0) AS BIGINT) AS longest
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id) LEFT JOIN l USING (doc_id)
"""

_TESTS = ", ".join(f"('{s}', {c})" for s, cuts in GRIDS.items() for c in cuts)
_COUNT = sum(map(len, GRIDS.values()))
_RISK = ALPHA / len(GRIDS)
OP10_SQL = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
t AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM d, unnest(range(1, len(w) - 1)) AS r(i)),
again AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM t) WHERE c > 1) GROUP BY 1),
b AS (SELECT l.doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(len(lines) AS BIGINT) AS n_lines, coalesce(again.n, 0) AS n_repeat_words, len(regexp_extract_all(text, '!')) AS shouts FROM l LEFT JOIN again USING (doc_id)),
s AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words AS base_failed, CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbols_per_word, CASE WHEN n_words > 0 THEN shouts / n_words ELSE 0 END AS shouts_per_word, CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_share, CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_word_share FROM b),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL GROUP BY 1 HAVING min(quality) = 1),
held AS (SELECT * FROM s WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good)),
tests(signal, cut) AS (VALUES {_TESTS}),
counts AS (SELECT lang, signal, cut, count(*) AS n, count(*) FILTER (WHERE CASE signal WHEN 'symbols_per_word' THEN symbols_per_word WHEN 'shouts_per_word' THEN shouts_per_word WHEN 'dup_line_share' THEN dup_line_share ELSE repeat_word_share END > cut) AS k FROM held, tests GROUP BY 1, 2, 3),
passed AS (SELECT lang, signal, min(cut) AS cut FROM counts WHERE k < n * {_RISK} AND list_sum(list_transform(range(k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_RISK}) + (n - i) * ln(1 - {_RISK})))) <= {DELTA} / ({_COUNT} * (SELECT count(DISTINCT coalesce(lang, '~')) FROM held)) GROUP BY 1, 2),
cuts AS (SELECT lang, max(cut) FILTER (WHERE signal = 'symbols_per_word') AS a, max(cut) FILTER (WHERE signal = 'shouts_per_word') AS b, max(cut) FILTER (WHERE signal = 'dup_line_share') AS c, max(cut) FILTER (WHERE signal = 'repeat_word_share') AS d FROM passed GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR coalesce(symbols_per_word > a, false) OR coalesce(shouts_per_word > b, false) OR coalesce(dup_line_share > c, false) OR coalesce(repeat_word_share > d, false)) AS kept, CAST(symbols_per_word AS DOUBLE) AS symbols_per_word, CAST(shouts_per_word AS DOUBLE) AS shouts_per_word, CAST(dup_line_share AS DOUBLE) AS dup_line_share, CAST(repeat_word_share AS DOUBLE) AS repeat_word_share
FROM s LEFT JOIN cuts ON s.lang IS NOT DISTINCT FROM cuts.lang
"""

# Bytes are pairs of hexadecimal digits; a window is compared by its MD5.
OP7_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, i, md5(substr(h, 2 * i + 1, 400)) AS s FROM d, unnest(range(CAST(strlen(h) // 2 - 199 AS BIGINT))) AS t(i) WHERE strlen(h) >= 400),
a AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY s) AS n FROM w) WHERE n > 1),
g AS (SELECT r, i, CASE WHEN i <= lag(i) OVER o + 200 THEN 0 ELSE 1 END AS new FROM a WINDOW o AS (PARTITION BY r ORDER BY i)),
runs AS (SELECT r, min(i) AS low, max(i) + 200 AS high FROM (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS k FROM g) GROUP BY r, k),
cut AS (SELECT r, count(*) AS n_spans, sum(high - low) AS n_removed, list(low ORDER BY low) AS lows, list(high ORDER BY low) AS highs FROM runs GROUP BY r)
SELECT doc_id, CAST(strlen(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE array_to_string(list_transform(range(n_spans + 1), lambda k: substr(h, 2 * CASE WHEN k = 0 THEN 0 ELSE highs[k] END + 1, 2 * (CASE WHEN k = n_spans THEN strlen(h) // 2 ELSE lows[k + 1] END - CASE WHEN k = 0 THEN 0 ELSE highs[k] END))), '') END)) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""

SQL = {"op2_warc": OP2_SQL, "op6_decontaminate": OP6_SQL, "op7_suffix_dedup": OP7_SQL, "op8_url_filter": OP8_SQL, "op10_quality_rules": OP10_SQL}
