"""DuckDB SQL for the queries that SQL can express."""

WORD = r"[^\x20\x09-\x0D]+"

SQL = {
    "op1_quality_rules": r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text FROM documents
), n AS (
    SELECT doc_id, text, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
        length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^a-z]', '', 'g')) AS n_lower
    FROM d
), w AS (
    SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM d
), g AS (
    SELECT doc_id, i, word, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c, lead(word, 3) OVER o AS e, lead(word, 4) OVER o AS f
    FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), r AS (
    SELECT doc_id, i FROM g WHERE f IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, word, b, c, e, f) > 1
), p AS (
    SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n_repeat_words FROM r, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY doc_id
), a AS (
    SELECT n.*, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
    FROM n LEFT JOIN p USING (doc_id)
), f AS (
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM a
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR n_symbols > n_words OR 2 * n_dup_lines > len(lines) OR word_chars < 2 * n_words OR word_chars > 25 * n_words OR n_upper > n_lower) AS kept
FROM f
""",
    "op2_mixing": r"""
WITH n AS (
    SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source
), r AS (
    SELECT source, pow(n, 0.5) / (SELECT sum(pow(n, 0.5)) FROM n) * (SELECT sum(n) FROM n) / n AS rate FROM n
), k AS (
    SELECT source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::BIGINT + 1)) AS k FROM r
), c AS (
    SELECT source, list(cdf ORDER BY k) AS cdf
    FROM (SELECT source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k)
    GROUP BY source
), u AS (
    SELECT d.*, len(list_filter(cdf, lambda x: x < (('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT + 0.5) / 281474976710656.0))::BIGINT AS n_copies
    FROM documents d JOIN c ON d.source IS NOT DISTINCT FROM c.source
), e AS (
    SELECT *, unnest(range(0, n_copies)) AS copy FROM u WHERE n_copies > 0
)
SELECT doc_id, text, lang, source, n_chars, n_copies, copy, md5('17:order:' || coalesce(doc_id::VARCHAR, '') || ':' || copy::VARCHAR) AS shuffle_key FROM e
""",
    "op3_exact_dedup": """
SELECT doc_id, max(doc_id) OVER t AS keep_id, count(*) OVER t AS group_size, doc_id = max(doc_id) OVER t AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW t AS (PARTITION BY coalesce(text, ''))
""",
    "op7_warc": """
WITH p AS (
    SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
    FROM pages
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM p
""",
}
