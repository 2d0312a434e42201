"""SQL counterparts of the text queries that SQL can express."""

from __future__ import annotations

OP10_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT page_id, html, strlen(html) AS n, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha256(html) AS payload_digest,
    CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
FROM f
"""

OP11_FILTER_AUDIT = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), l AS (
    SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic
    FROM labels GROUP BY doc_id
), m AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END)
        + (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END)
        + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END)
        + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
        + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END) AS mask
    FROM d LEFT JOIN l USING (doc_id)
), c AS (
    SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS t FROM m GROUP BY part, mask
), f(l, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)), o AS (
    SELECT f1.l || f2.l || f3.l || f4.l || f5.l AS filter_order, [f1.b, f2.b, f3.b, f4.b, f5.b] AS bits
    FROM f f1, f f2, f f3, f f4, f f5 WHERE f1.b | f2.b | f3.b | f4.b | f5.b = 31
), s AS (
    SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS earlier
    FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
)
SELECT part, filter_order, step,
    coalesce(sum(n) FILTER (WHERE mask & (own | earlier) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (WHERE mask & own <> 0 AND mask & earlier = 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE mask & own <> 0 AND mask & earlier <> 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (WHERE mask = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(g) FILTER (WHERE mask & own <> 0 AND mask & earlier = 0), 0)::BIGINT AS good_lost,
    coalesce(sum(t) FILTER (WHERE mask & own <> 0 AND mask & earlier = 0), 0)::BIGINT AS toxic_lost,
    coalesce(sum(n * (120 // greatest(1, bit_count(mask)))) FILTER (WHERE mask & own <> 0), 0)::BIGINT AS shapley
FROM c, s GROUP BY part, filter_order, step
"""

OP12_DE_BRUIJN_REPEATS = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), w AS (
    SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM d
), s AS (
    SELECT doc_id, i, words[i:i + 19] AS span FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM d)
), later AS (
    SELECT doc_id, i FROM s QUALIFY row_number() OVER (PARTITION BY span ORDER BY doc_id, i) > 1
), gone AS (
    SELECT DISTINCT doc_id, i + k AS pos FROM later, (SELECT unnest(range(0, 20)) AS k)
), r AS (
    SELECT w.doc_id, count(gone.pos) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY w.pos) FILTER (WHERE gone.pos IS NULL), '') AS kept
    FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id AND w.pos = gone.pos GROUP BY w.doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""

OP13_DIVERGENCE = r"""
WITH d AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), t AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term),
c AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
p AS (
    SELECT c.lang, c.source, c.term, c.n,
        1 + (1000000000::HUGEINT * (c.n + 1)) // (sum(c.n) OVER (PARTITION BY c.lang, c.source) + v.v) AS p,
        1 + (1000000000::HUGEINT * (sum(c.n) OVER (PARTITION BY c.lang, c.term) + 1)) // (sum(c.n) OVER (PARTITION BY c.lang) + v.v) AS q
    FROM c JOIN v USING (lang)
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source
), rows AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM rows QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 200
"""
