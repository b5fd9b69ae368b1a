"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

WORDS = r"len(regexp_extract_all({}, '[^\x20\x09-\x0D]+'))"

MIXING = rf"""
WITH worst AS (SELECT doc_id AS label_id, min(quality) AS q FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
sized AS (
    SELECT d.doc_id, d.source, coalesce({WORDS.format('d.text')}, 0)::BIGINT AS size,
           -ln(((('0x' || substr(md5('42:' || coalesce(d.doc_id::VARCHAR, '') || ':' || md5(coalesce(d.text, ''))), 1, 13))::BIGINT)
                + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
           / CASE q WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS key
    FROM documents d LEFT JOIN worst ON d.doc_id = label_id),
sources AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
    FROM sized GROUP BY source),
turns AS (
    SELECT *, 150 * sum(source_size) OVER () - 200 * coalesce(sum(source_size) OVER (
               ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
           sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w,
           row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS turn
    FROM sources),
marked AS (SELECT *, 200 * source_size * open_w <= rest * w AS full_up FROM turns),
goals AS (
    SELECT source, source_size, CASE WHEN full_up THEN (2 * source_size)::DOUBLE ELSE
        (w * first_value(rest) OVER (ORDER BY full_up, turn))::DOUBLE / (100 * first_value(open_w) OVER (ORDER BY full_up, turn))::DOUBLE
        END AS target
    FROM marked),
epochs AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size)::BIGINT END AS n FROM goals),
ordered AS (
    SELECT s.*, source_size, target, n, target - n * source_size AS budget,
           sum(size) OVER (PARTITION BY s.source ORDER BY key RANGE UNBOUNDED PRECEDING) AS upto,
           sum(size) OVER (PARTITION BY s.source, key) AS tied, row_number() OVER (PARTITION BY s.source, key) AS nth
    FROM sized s JOIN epochs e ON s.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       (size * (n + CASE WHEN budget > 0 AND upto - tied + (nth - 1) * size + size / 2.0::DOUBLE <= budget THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ordered
"""

WARC = """
WITH rows AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM rows)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM firsts
"""

EMBEDDINGS = """
WITH RECURSIVE sound AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b
    ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (
    SELECT vec_id AS id, vec_id AS other FROM embeddings
    UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.other),
least AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, component_id = vec_id AS kept
FROM embeddings JOIN least ON id = vec_id LEFT JOIN degree ON a = vec_id
"""

CONVERSATIONS = """
WITH turns AS (
    SELECT conv_id AS c, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id,
           strlen(coalesce(text, '')) AS size,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS r
    FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
    SELECT DISTINCT c, c - c % 5 AS base, xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)),
            lambda x, i: CASE WHEN (x & 1) = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 9 AS h
    FROM turns),
rebuilt AS (
    SELECT v.c, 0 AS own, r, id, size FROM convs v JOIN turns t ON t.c = v.base AND r <= h
    UNION ALL SELECT v.c, 1, r, id, size FROM convs v JOIN turns t ON t.c = v.c AND r > h),
paths AS (
    SELECT v.c, coalesce(list(id ORDER BY own, r) FILTER (id IS NOT NULL), []) AS p,
           coalesce(list(size ORDER BY own, r) FILTER (id IS NOT NULL), []) AS sizes
    FROM convs v LEFT JOIN rebuilt b ON b.c = v.c GROUP BY v.c),
steps AS (SELECT c, unnest(range(len(p) + 1)) AS d, p, sizes FROM paths),
places AS (SELECT c, d, p[1:d] AS node, p[1:d-1] AS up, CASE WHEN d = 0 THEN 0 ELSE sizes[d] END AS size, len(p) = d AS ends FROM steps),
nodes AS (
    SELECT node, d, any_value(up) AS up, min(c) AS conv, count(*) AS n, any_value(size) AS size,
           sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends
    FROM places GROUP BY node, d),
children AS (SELECT up, count(*) AS k FROM nodes WHERE d > 0 GROUP BY up),
above AS (  -- every node with each of its ancestors and itself, by its smallest member's path
    SELECT n.node AS of, a.node, (n.n - 1) * n.size AS saved, CASE WHEN k IS NULL THEN 1 ELSE 0 END AS leaf
    FROM nodes n JOIN places a ON a.c = n.conv AND a.d <= n.d LEFT JOIN children ch ON ch.up = n.node),
sums AS (SELECT node, sum(saved)::BIGINT AS saved, sum(leaf)::BIGINT AS leaves FROM above GROUP BY node)
SELECT n.conv AS conv_id, n.d AS depth, CASE WHEN n.d > 0 THEN u.conv END AS parent_conv_id, n.n AS n_convs,
       coalesce(k, 0) AS n_children, leaves AS n_leaves, saved AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN sums s ON s.node = n.node LEFT JOIN children ch ON ch.up = n.node LEFT JOIN nodes u ON u.node = n.up AND u.d = n.d - 1
"""

COLLOCATIONS = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
    FROM documents),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
numbered AS (SELECT row_number() OVER () AS piece, lang, w FROM pieces WHERE len(w) > 0),
places AS (SELECT piece, lang, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM numbered),
next AS (SELECT lang, word AS a, lead(word, 1) OVER o AS b, lead(word, 2) OVER o AS c, lead(word, 3) OVER o AS d
         FROM places WINDOW o AS (PARTITION BY piece ORDER BY i)),
grams AS (SELECT lang, a AS p, 1 AS m FROM next UNION ALL SELECT lang, a || ' ' || b, 2 FROM next WHERE b IS NOT NULL
          UNION ALL SELECT lang, a || ' ' || b || ' ' || c, 3 FROM next WHERE c IS NOT NULL
          UNION ALL SELECT lang, a || ' ' || b || ' ' || c || ' ' || d, 4 FROM next WHERE d IS NOT NULL),
f AS (SELECT lang, p AS phrase, string_split(p, ' ') AS w, any_value(m) AS m, count(*) AS a FROM grams GROUP BY lang, p HAVING count(*) >= 30),
parts AS (SELECT lang, phrase, m, a, k, array_to_string(w[1:k], ' ') AS front, array_to_string(w[k+1:m], ' ') AS back
          FROM f, range(1, 4) t(k) WHERE k < m),
cuts AS (
    SELECT c.*, l.a AS l, r.a AS r, ((2000000::HUGEINT * c.a) // (l.a::HUGEINT + r.a))::BIGINT AS score
    FROM parts c JOIN f l ON l.lang = c.lang AND l.phrase = front JOIN f r ON r.lang = c.lang AND r.phrase = back),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
    SELECT lang, array_to_string(w[i:i+k-1], ' ') AS q, max(a) AS around FROM f, range(2, 4) t(k), range(1, 4) s(i)
    WHERE k < m AND i + k - 1 <= m GROUP BY ALL),
kept AS (
    SELECT c.* FROM scored c LEFT JOIN inside x ON x.lang = c.lang AND x.q = c.phrase
    WHERE around IS NULL OR 100::HUGEINT * around < 80::HUGEINT * c.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

SQL = {"op11_collocations": COLLOCATIONS, "op13_conversation_trie": CONVERSATIONS, "op1_mixing": MIXING, "op2_warc": WARC, "op8_embeddings": EMBEDDINGS}
