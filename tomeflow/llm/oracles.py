"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

EXACT = """
WITH d AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""

#: crc32 by its table of 256 remainders (0xEDB88320 reflected), byte by byte.
SPELLING = """
WITH RECURSIVE crc AS (
    SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) r(n)
), runs AS (
    SELECT DISTINCT coalesce(doc_id::VARCHAR, '') AS id, run, count(*) AS times FROM (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents)
    WHERE length(run) >= 5 GROUP BY 1, 2
), bytes AS (
    SELECT run, times, hex(encode(id || ':' || run)) AS x FROM runs
), hashed AS (
    SELECT run, times, xor(list_reduce(list_concat([4294967295], list_transform(range(0, length(x) // 2), lambda k: ('0x' || substr(x, 2 * k + 1, 2))::BIGINT)),
                                       lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
    FROM bytes, crc
), words AS (
    SELECT word, sum(times)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, times FROM hashed)
    WHERE length(word) >= 5 GROUP BY 1 HAVING sum(times) >= 3
), cut AS (
    SELECT word, length(word) AS len, k AS place, word[:k - 1] || word[k + 1:] AS rest FROM words, unnest(range(1, length(word) + 1)) u(k)
), near AS (
    SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.rest = b.rest AND a.place = b.place AND a.word <> b.word
    UNION SELECT c.word, w.word FROM cut c JOIN words w ON c.rest = w.word
    UNION SELECT w.word, c.word FROM cut c JOIN words w ON c.rest = w.word
), best AS (
    SELECT a AS word, count(*) AS n_near, arg_min(b, (-n, b)) AS other, max(n) AS other_n FROM near JOIN words ON word = b GROUP BY 1
), forms AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form, CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n FROM words w LEFT JOIN best USING (word)
), walk AS (
    SELECT word, word AS at_word FROM forms
    UNION ALL SELECT walk.word, f.form FROM walk JOIN forms f ON f.word = walk.at_word WHERE f.form IS NOT NULL
), ends AS (
    SELECT walk.word, walk.at_word AS root FROM walk JOIN forms f ON f.word = walk.at_word WHERE f.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""


def codes(rounds: int = 6) -> str:
    """Lloyd's rounds one after the other; parts by their number, entries by theirs."""
    parts = ["""
v AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS z FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
    SELECT vec_id, part, z[part * (len(z) // 8) + 1:(part + 1) * (len(z) // 8)] AS z FROM v, range(8) r(part)
), b0 AS MATERIALIZED (
    SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, z FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 16)
)"""]
    for k in range(rounds + 1):
        parts.append(f"""
d{k} AS (
    SELECT p.vec_id, p.part, b.e, list_sum(list_transform(list_zip(p.z, b.z), lambda t: (t[1] - t[2]) * (t[1] - t[2])))::BIGINT AS d FROM p JOIN b{k} b USING (part)
), a{k} AS MATERIALIZED (
    SELECT vec_id, part, arg_min(e, (d, e)) AS e, min(d) AS d FROM d{k} GROUP BY 1, 2
)""")
        if k < rounds:
            parts.append(f"""
s{k} AS (
    SELECT part, e, pos, sum(x) AS s, count(*) AS n FROM (SELECT part, e, unnest(z) AS x, generate_subscripts(z, 1) AS pos FROM a{k} JOIN p USING (vec_id, part)) GROUP BY ALL
), m{k} AS (
    SELECT part, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY pos) AS z FROM s{k} GROUP BY 1, 2
), b{k + 1} AS MATERIALIZED (
    SELECT part, e, coalesce(m.z, b.z) AS z FROM b{k} b LEFT JOIN m{k} m USING (part, e)
)""")
    last = f"""
book AS (SELECT sha256(string_agg(array_to_string(z, ','), ',' ORDER BY part, e)) AS sha FROM b{rounds}),
c AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY 1)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, sha AS codebooks_sha256 FROM c JOIN v USING (vec_id), book
"""
    return "WITH " + ",".join(parts).lstrip() + "," + last


#: Base32 of a SHA-1: eight groups of five hexadecimal digits, each four characters.
ARCHIVE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS x FROM pages),
d AS (
    SELECT page_id, body, octet_length(encode(body)) AS payload_bytes,
           array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               ((('0x' || substr(x, 5 * (k // 4) + 1, 5))::BIGINT >> (5 * (3 - k % 4))) & 31)::INT + 1, 1)), '') AS payload_digest FROM p
), m AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS kept FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> kept THEN kept END AS refers_to
FROM m
"""

#: Words by themselves have no blank, so five of them joined by one are one shingle.
NEAR = """
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), s AS (
    SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(1, len(words) - 3), lambda k: array_to_string(words[k:k + 4], ' ')) END) AS shingles FROM w
), n AS (SELECT doc_id, len(shingles) AS n FROM s),
e AS MATERIALIZED (SELECT doc_id, hash(unnest(shingles)) AS h FROM s),
near AS MATERIALIZED (
    SELECT a.doc_id AS a, b.doc_id AS b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM e x JOIN e y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY 1, 2) c
    JOIN n a ON a.doc_id = c.a JOIN n b ON b.doc_id = c.b WHERE 100 * shared >= 85 * (a.n + b.n - shared)
), edges AS MATERIALIZED (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach AS (
    SELECT a AS doc_id, b AS other FROM edges UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other
), least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT n.doc_id, n.n AS n_shingles, coalesce(component_id, n.doc_id) AS component_id, coalesce(component_id, n.doc_id) = n.doc_id AS kept FROM n LEFT JOIN least USING (doc_id)
"""

#: Strings of 100 bytes by their hash; a string of an earlier start removes later ones.
REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
starts AS MATERIALIZED (SELECT doc_id, pos, md5(substr(x, 2 * pos + 1, 200)) AS h FROM (SELECT doc_id, x, unnest(range(0, n - 99)) AS pos FROM d WHERE n >= 100)),
later AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) AS k FROM starts) WHERE k > 1),
runs AS (
    SELECT doc_id, min(pos) AS s, max(pos) + 100 AS e FROM (
        SELECT doc_id, pos, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM (
            SELECT doc_id, pos, CASE WHEN pos > lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 100 THEN 1 ELSE 0 END AS fresh FROM later))
    GROUP BY doc_id, run
), spans AS (SELECT doc_id, list(s ORDER BY s) AS s, list(e ORDER BY s) AS e, count(*) AS n_spans, sum(e - s) AS n_removed FROM runs GROUP BY 1)
SELECT d.doc_id, d.n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN x ELSE array_to_string(list_transform(range(0, n_spans + 1), lambda k:
           substr(x, 2 * (CASE WHEN k = 0 THEN 0 ELSE e[k] END) + 1, 2 * ((CASE WHEN k = n_spans THEN d.n ELSE s[k + 1] END) - (CASE WHEN k = 0 THEN 0 ELSE e[k] END)))), '') END)) AS kept_sha256
FROM d LEFT JOIN spans USING (doc_id)
"""
