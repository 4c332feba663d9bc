"""The registry of this subpackage: a query for each operator, and SQL where SQL can express it."""

from __future__ import annotations

from .chat_format import op12_chat_format
from .decontaminate import op1_qgram_decontamination
from .divergence import op13_source_divergence
from .jaccard_join import op6_partenum_jaccard
from .lexical_search import op11_ranked_search
from .line_rules import op10_line_rules
from .pitman_yor import op8_pitman_yor
from .pu_quality import op3_pu_quality
from .sharding import op5_ring_sharding
from .suffix_dedup import op2_suffix_dedup
from .unigram import op9_unigram_pieces
from .warc import op4_warc_merge
from .wordpiece import op7_token_counts

QUERIES = {
    "op1_qgram_decontamination": op1_qgram_decontamination,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_pu_quality": op3_pu_quality,
    "op4_warc_merge": op4_warc_merge,
    "op5_ring_sharding": op5_ring_sharding,
    "op6_partenum_jaccard": op6_partenum_jaccard,
    "op7_token_counts": op7_token_counts,
    "op8_pitman_yor": op8_pitman_yor,
    "op9_unigram_pieces": op9_unigram_pieces,
    "op10_line_rules": op10_line_rules,
    "op11_ranked_search": op11_ranked_search,
    "op12_chat_format": op12_chat_format,
    "op13_source_divergence": op13_source_divergence,
}
ORACLES: dict[str, str] = {
    "op10_line_rules": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(range(len(s))) AS k, unnest(s) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM t)),
w AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS words, regexp_replace(line, '[^\p{L}]', '', 'g') AS letters FROM l),
v0 AS (SELECT doc_id, k, len(words) AS n, unnest(range(len(words))) AS i, unnest(words) AS v FROM w WHERE len(words) > 2000),
y AS (SELECT doc_id, k, sum(greatest(0, least(i, n - 2000) - greatest(last, i - 2000))) AS different FROM (SELECT *, coalesce(lag(i) OVER (PARTITION BY doc_id, k, v ORDER BY i), -1) AS last FROM v0) GROUP BY doc_id, k),
x AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) > 1 AS again, list_sum(list_transform(words, lambda v: length(v))) AS size,
  len(list_filter(words, lambda v: v IN ('|', '||', '·', '•', '»', '›', '>', '/', '::'))) AS bars, len(list_filter(words, lambda v: regexp_matches(v, '[#*$%&|<>]'))) AS marked,
  len(list_filter(words, lambda v: ends_with(v, '!!'))) AS shouts, CASE WHEN n <= 2000 THEN len(list_distinct(words)) ELSE different END AS kinds, CASE WHEN n <= 2000 THEN n ELSE 2000 * (n - 1999) END AS whole, len(list_filter(range(1, len(words)), lambda i: words[i] = words[i + 1])) AS twins,
  coalesce(list_sum(list_transform(regexp_extract_all(line, '(?i)cookie policy|accept (?:all )?cookies|we use cookies|enable javascript|javascript is (?:disabled|required)|privacy policy|terms of (?:use|service)|all rights reserved|sign in to|log in to|subscribe to our|click here|skip to (?:main )?content|lorem ipsum'), lambda m: len(string_split(m, ' ')))), 0) AS notice FROM (SELECT w.*, len(words) AS n, different FROM w LEFT JOIN y USING (doc_id, k)) WHERE n > 0),
j AS (SELECT *, CASE WHEN bars >= 2 AND 4 * bars > n THEN 'navigation' WHEN 10 * marked > 3 * n THEN 'symbols'
  WHEN n >= 3 AND (2 * shouts > n OR 10 * length(regexp_replace(letters, '[^\p{Lu}]', '', 'g')) > 7 * length(letters)) THEN 'shouting'
  WHEN n >= 10 AND (2 * twins > n OR 5 * kinds < whole) THEN 'repetition'
  WHEN notice > 0 AND 5 * notice >= n THEN 'boilerplate'
  WHEN again THEN 'duplicate' WHEN NOT regexp_matches(words[-1], '[.!?…:;"'')»”。！？؟।,]$') AND 40 * len(list_filter(words, lambda v: regexp_matches(v, '[.!?…:;"'')»”。！？؟।,]$'))) < n THEN 'punctuation' ELSE '' END AS why FROM x),
d AS (SELECT doc_id, sum(n) AS n_words, sum(size) AS word_chars, count(*) FILTER (again) AS n_dup_lines, count(*) AS n_lines, count(*) FILTER (why = '') AS n_kept_lines, coalesce(sum(size) FILTER (why = ''), 0) AS kept_chars,
  coalesce(string_agg(DISTINCT why, ',' ORDER BY why) FILTER (why <> ''), '') AS failed_rules FROM j GROUP BY doc_id),
v AS (SELECT doc_id, unnest(range(1, len(a) - 1)) AS i, unnest(list_transform(range(1, len(a) - 1), lambda i: a[i] || ' ' || a[i + 1] || ' ' || a[i + 2])) AS g FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS a FROM t)),
o AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM v) WHERE c > 1),
r AS (SELECT doc_id, count(*) AS n_repeat_words FROM o GROUP BY doc_id),
e AS (SELECT t.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_kept_lines, 0) AS n_kept_lines, CAST(coalesce(kept_chars, 0) AS BIGINT) AS kept_chars, coalesce(failed_rules, '') AS failed_rules FROM t LEFT JOIN d ON d.doc_id = t.doc_id LEFT JOIN r ON r.doc_id = t.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * kept_chars >= word_chars AS kept FROM e""",
    "op2_suffix_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, CAST(unnest(range(0, n - 49)) AS INTEGER) AS i, h, n FROM d WHERE n >= 50),
k AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 100)) AS g FROM w),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM k),
b AS (SELECT doc_id, i, CASE WHEN i <= 49 + lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 1 THEN 0 ELSE 1 END AS new FROM f WHERE first < doc_id),
s AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM b) GROUP BY doc_id, span),
x AS (SELECT doc_id, list(a ORDER BY a) AS a, list(z ORDER BY z) AS z, sum(z - a) AS gone, count(*) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(from_hex(CASE WHEN gone IS NULL THEN h ELSE substr(h, 1, 2 * a[1]) || array_to_string(list_transform(range(1, len(a) + 1), lambda j: CASE WHEN j = len(a) THEN substr(h, 2 * z[j] + 1) ELSE substr(h, 2 * z[j] + 1, 2 * (a[j + 1] - z[j])) END), '') END)) AS kept_sha256
FROM d LEFT JOIN x ON x.doc_id = d.doc_id""",
    "op4_warc_merge": r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT *, sha1(html) AS h, min(page_id) OVER (PARTITION BY sha1(html)) AS first FROM p),
k AS (SELECT *, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS query FROM d),
r AS (SELECT page_id, strlen(html) AS payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, 1 + 5 * i // 4, 2) AS BIGINT) >> (3 - 5 * i % 4)) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to,
  array_to_string(list_reverse(string_split(lower(host), '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS url_key,
  strftime(TIMESTAMP '2024-01-01' + to_seconds(page_id % 1000000000), '%Y%m%d%H%M%S') AS capture_ts FROM k)
SELECT *, row_number() OVER (ORDER BY url_key, capture_ts, page_id) - 1 AS history_no, lag(capture_ts) OVER (PARTITION BY url_key ORDER BY capture_ts, page_id) AS previous_ts FROM r""",
    "op5_ring_sharding": r"""
WITH RECURSIVE tab AS (SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY b) AS t FROM range(256) r(b)),
pts AS (SELECT row_number() OVER (ORDER BY pos, shard) - 1 AS arc, shard, pos FROM (SELECT i % 24 AS shard, CAST('0x' || substr(md5('shard ' || (i % 24) || ' node ' || (i // 24)), 1, 8) AS BIGINT) AS pos FROM range(3072) r(i))),
raw AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
keys AS (SELECT doc_id, CAST(n + 8 AS BIGINT) AS size, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) AS pos,
  xor(list_reduce(list_prepend(4294967295, list_transform(range(n), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[CAST((xor(c, b) & 255) + 1 AS INTEGER)])), 4294967295) AS text_crc32 FROM raw, tab),
placed AS (SELECT k.*, coalesce(p.arc, 0) AS arc FROM keys k ASOF LEFT JOIN pts p ON k.pos <= p.pos),
ranked AS (SELECT *, row_number() OVER (PARTITION BY arc ORDER BY pos, doc_id, text_crc32, size) - 1 AS k FROM placed),
total AS (SELECT count(*) AS n FROM keys),
a0 AS (SELECT pts.arc, shard, coalesce(c.n, 0) AS n, total.n // 24 + CASE WHEN shard < total.n % 24 THEN 1 ELSE 0 END AS cap FROM pts LEFT JOIN (SELECT arc, count(*) AS n FROM placed GROUP BY arc) c ON c.arc = pts.arc, total),
a1 AS (SELECT *, greatest(0, least(n, cap - CAST(sum(n) OVER (PARTITION BY shard ORDER BY arc) AS BIGINT) + n)) AS stay FROM a0),
a2 AS (SELECT *, n - stay AS leave, CAST(sum(stay) OVER (PARTITION BY shard ORDER BY arc) AS BIGINT) - stay AS slot, CAST(sum(stay) OVER (PARTITION BY shard) AS BIGINT) AS home, CAST(sum(n - stay) OVER (ORDER BY arc) AS BIGINT) - (n - stay) AS left_before FROM a1),
walk(step, queue, used, sent, take, shard, slot) AS (
  SELECT -1, CAST(0 AS BIGINT), (SELECT list(home ORDER BY shard) FROM (SELECT DISTINCT shard, home FROM a2)), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT)
  UNION ALL
  SELECT step, q - take, list_transform(used, lambda u, i: CASE WHEN i = shard + 1 THEN u + take ELSE u END), sent + take, take, shard, slot FROM (
    SELECT w.step + 1 AS step, w.queue + CASE WHEN w.step + 1 < 3072 THEN a2.leave ELSE 0 END AS q, w.used, w.sent, a2.shard, w.used[CAST(a2.shard + 1 AS INTEGER)] AS slot,
      least(w.queue + CASE WHEN w.step + 1 < 3072 THEN a2.leave ELSE 0 END, a2.cap - w.used[CAST(a2.shard + 1 AS INTEGER)]) AS take
    FROM walk w JOIN a2 ON a2.arc = (w.step + 1) % 3072 WHERE w.step < 6143)),
pieces AS (SELECT sent - take AS lo, sent AS hi, shard, slot FROM walk WHERE take > 0),
away AS (SELECT r.*, a2.shard AS home_shard, a2.stay, a2.slot AS first_slot, a2.left_before + r.k - a2.stay AS rank FROM ranked r JOIN a2 USING (arc))
SELECT w.doc_id, w.size, w.text_crc32, 'rows' AS law, CAST(coalesce(p.shard, w.home_shard) AS INTEGER) AS shard, coalesce(p.slot + w.rank - p.lo, w.first_slot + w.k) AS slot, CAST(NULL AS INTEGER) AS grown_shard,
  CAST(w.home_shard AS INTEGER) AS home_shard, p.shard IS NOT NULL AS moved
FROM away w LEFT JOIN pieces p ON w.k >= w.stay AND w.rank >= p.lo AND w.rank < p.hi""",
    "op6_partenum_jaccard": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN s ON s.doc_id = w.doc_id GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, low) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.y, r.low FROM r JOIN e ON e.x = r.doc_id WHERE r.low < e.y)
SELECT n.doc_id, n.n AS n_shingles, min(r.low) AS component_id FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY 1, 2""",
    "op11_ranked_search": r"""
WITH
d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
c AS (SELECT CAST(count(*) FILTER (len(w) > 0) AS BIGINT) AS N, CAST(sum(len(w)) AS BIGINT) AS L FROM d),
t AS (SELECT k, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT k, unnest(w) AS term FROM d) SEMI JOIN b USING (term) GROUP BY k, term),
f AS (SELECT term, CAST(floor(1000 * ln((2 * N + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t, c GROUP BY term, N),
m AS (SELECT k, doc_id, 50 + (50 * len(w) * N) // L AS m FROM d, c WHERE len(w) > 0),
s AS (SELECT b.item_id, t.k, CAST(sum(f.w * ((1000000000 * t.tf) // (1000 * t.tf + 20 * m.m))) AS BIGINT) AS score FROM b JOIN t ON t.term = b.term JOIN f ON f.term = b.term JOIN m ON m.k = t.k GROUP BY b.item_id, t.k),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s JOIN m USING (k) WHERE score > 0)
SELECT * FROM r WHERE rank <= 50""",
    "op12_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')),
t AS (SELECT *, length(text) + len(regexp_extract_all(text, '\\|<s>|</s>|\[/?INST\]|\[TEXT\]|\[/?ROLE\]')) AS n, length(role) + len(regexp_extract_all(role, '\\|<s>|</s>|\[/?INST\]|\[TEXT\]|\[/?ROLE\]')) AS r FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(CASE role WHEN 'user' THEN n + 15 WHEN 'assistant' THEN n + 10 ELSE r + n + 17 END) AS BIGINT) AS formatted_chars FROM t GROUP BY conv_id""",
    "op13_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT k, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
keep AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN keep USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM keep GROUP BY lang),
g AS (SELECT d.lang, d.source, coalesce(any_value(v.v), 0) AS v, coalesce((SELECT sum(c.n) FROM c WHERE c.lang = d.lang AND c.source = d.source), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) d LEFT JOIN v ON v.lang = d.lang GROUP BY d.lang, d.source),
p AS (SELECT g.lang, g.source, keep.term, coalesce(c.n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2) // CAST(g.n + 2 * g.v AS HUGEINT) AS p FROM g JOIN keep ON keep.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = keep.term),
q AS (SELECT keep.lang, keep.term, 1 + CAST(1000000000 AS HUGEINT) * (keep.n + 2) // CAST(v.n + 2 * v.v AS HUGEINT) AS q FROM keep JOIN v ON v.lang = keep.lang),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT p.lang, p.source, 'term', p.term, CAST((p.p - q.q) * (p.p - q.q) // (p.p + q.q) AS BIGINT) FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r) WHERE part = 'pair' OR rank <= 10""",
}
