"""SQL for DuckDB of those queries that SQL can say: all but tokenizers (1, 4), the quantised trie (3) and the classifier (5).

op10's taken follows from multipliers found by iteration and has no SQL either."""

from __future__ import annotations

from .quality import STOP

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
first AS (SELECT payload, min(page_id) AS f FROM p GROUP BY payload),
d AS (SELECT page_id, octet_length(payload) AS payload_bytes, CAST(unhex(sha1(payload)) AS BIT)::VARCHAR AS bits, f,
             f IS NOT NULL AND page_id IS DISTINCT FROM f AS again FROM p JOIN first USING (payload))
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(0, 160, 5), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(1 + list_sum(list_transform(range(0, 5), lambda j: (16 >> j) * CAST(substr(bits, CAST(i + j + 1 AS INTEGER), 1) AS INTEGER))) AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN f END AS refers_to
FROM d
"""

OP6 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256.0 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

OP7 = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
spots AS (SELECT doc_id, CAST(unnest(range(1, len(w) - 48)) AS INTEGER) AS k, w FROM d WHERE len(w) >= 50),
win AS (SELECT doc_id, k, md5_number(array_to_string(w[k : k + 49], ' ')) AS h FROM spots),
least AS (SELECT h, min(doc_id) AS low FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 50)) AS k FROM win JOIN least USING (h) WHERE low < doc_id),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM d),
marked AS (SELECT doc_id, k, x, g.k IS NOT NULL AS gone FROM word LEFT JOIN gone g USING (doc_id, k)),
edged AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY k), false) AS edge FROM marked),
summed AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY k) FILTER (NOT gone), '') AS kept,
                  count(*) FILTER (edge) AS n_spans FROM edged GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(n_spans, 0) AS n_spans
FROM d LEFT JOIN summed USING (doc_id)
"""

OP8 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[CAST(k AS INTEGER) : CAST(k + 4 AS INTEGER)], ' ')) END) AS s FROM d),
one AS (SELECT doc_id, len(s) AS n, md5_number(x) AS x FROM (SELECT doc_id, s, unnest(s) AS x FROM sets)),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS c FROM one a JOIN one b USING (x)
           WHERE a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM common WHERE 100 * c >= 85 * (na + nb - c)),
sides AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM sides UNION SELECT r.a, e.b FROM reach r JOIN sides e ON r.b = e.a),
low AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(m, doc_id)) AS kept
FROM sets LEFT JOIN low USING (doc_id)
"""

OP9 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
lines AS (SELECT doc_id, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines
          FROM (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d)),
five AS (SELECT doc_id, k, array_to_string(w[k : k + 4], ' ') AS x FROM (SELECT doc_id, w, CAST(unnest(range(1, len(w) - 3)) AS INTEGER) AS k FROM d WHERE len(w) >= 5)),
twice AS (SELECT doc_id, x FROM five GROUP BY doc_id, x HAVING count(*) > 1),
again AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(k, k + 5)) AS p FROM five JOIN twice USING (doc_id, x)) GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_lines,
             CAST(coalesce(again.n, 0) AS BIGINT) AS n_repeat_words,
             len(list_filter(range(2, len(w) + 1), lambda k: w[k] = w[k - 1])) AS n_stutter,
             octet_length(encode(array_to_string(w, ''))) AS n_bytes,
             octet_length(encode(regexp_replace(array_to_string(w, ''), '[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]', '', 'g'))) AS n_alpha,
             len(list_filter(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'),
                             lambda x: list_contains([{", ".join(f"'{x}'" for x in sorted(STOP))}], x))) AS n_stop
      FROM d JOIN lines USING (doc_id) LEFT JOIN again USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 10 * n_words OR (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines) OR 100 * n_stutter > 25 * n_words
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 100 * n_alpha < 40 * n_bytes OR (n_words >= 50 AND 100 * n_stop < n_words)) AS kept
FROM b
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2, "op6_knn": OP6, "op7_substring": OP7, "op8_minhash": OP8, "op9_quality": OP9}
