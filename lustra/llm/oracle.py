"""SQL of the queries that SQL can express on whole tables: benchmark passages, conversations, archives, lines and near duplicates."""

from __future__ import annotations


# The words of op3: A-Z as a-z, runs of letters, digits and all beyond ASCII.
_PLAIN = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
# Five bits at a time of a hash as hexadecimal text.
_BITS = "array_to_string(list_transform(string_split(sha1(coalesce(html, '')), ''), lambda c: lpad(bin(CAST('0x' || c AS INT)), 4, '0')), '')"
_BASE32 = "array_to_string(list_transform(range(32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST(('0b' || bits[5 * k + 1:5 * k + 5]) AS INT) + 1]), '')"

ORACLE = {
    "op3_decontamination": rf"""
        WITH docs AS (SELECT doc_id, {_PLAIN} AS w FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
        items AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_PLAIN} AS w FROM (SELECT item_id, coalesce(text, '') AS text FROM benchmark)),
        windows AS (
            SELECT DISTINCT item, size, array_to_string(w[i + 1:i + size], ' ') AS passage
            FROM (SELECT item, w, least(len(w), 10) AS size, unnest(range(len(w) - least(len(w), 10) + 1)) AS i FROM items WHERE len(w) > 0)),
        places AS (
            SELECT doc_id, size, i, array_to_string(w[i + 1:i + size], ' ') AS passage
            FROM (SELECT doc_id, w, size, unnest(range(len(w) - size + 1)) AS i FROM docs, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)),
        found AS (SELECT doc_id, size, i, item FROM places JOIN windows USING (size, passage)),
        words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY doc_id),
        named AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(words.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
            sha256(coalesce(names, '')) AS items_sha256, words.n IS NOT NULL AS contaminated
        FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op6_warc": rf"""
        WITH pages_ AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS size, {_BITS} AS bits FROM pages),
        kept AS (SELECT *, max(page_id) OVER (PARTITION BY bits) AS keeper FROM pages_)
        SELECT page_id, CAST(size AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
            CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM kept""",
    "op10_jaccard_join": r"""
        WITH RECURSIVE docs AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-]+') AS w FROM documents),
        shingles AS (
            SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 5], ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM docs WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)),
        reached AS (SELECT doc_id AS x, doc_id AS y FROM docs UNION SELECT r.x, l.y FROM reached r JOIN links l ON l.x = r.y)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
        FROM docs d LEFT JOIN sizes USING (doc_id) JOIN (SELECT x, min(y) AS component_id FROM reached GROUP BY x) c ON c.x = d.doc_id""",
    "op5_chat_format": r"""
        WITH rows AS (
            SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
        written AS (
            SELECT *, regexp_replace(text, '([<\[])(\\*)(\|[A-Za-z0-9_]+\|>|/?s>|/?INST\]|<SYS>>|</SYS>>)', '\1\\\2\3', 'g') AS escaped FROM rows)
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(length('<|turn|>' || role || '<|text|>' || escaped || '<|end|>')) AS BIGINT) AS formatted_chars,
            CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS expanded_tokens
        FROM written GROUP BY conv_id""",
    "op7_line_dedup": r"""
        WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
        each AS (SELECT doc_id, l, unnest(range(len(l))) AS i FROM docs),
        plain AS (SELECT doc_id, i, l[i + 1] AS line, if(regexp_matches(l[i + 1], '[^\x20\x09-\x0D]'), l[i + 1], NULL) AS x FROM each),
        windows AS (
            SELECT doc_id, i, x AS a, lead(x, 1) OVER w AS b, lead(x, 2) OVER w AS c, lead(i, 2) OVER w AS e
            FROM plain WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
        ranked AS (
            SELECT doc_id, i, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) AS k
            FROM windows WHERE e IS NOT NULL AND coalesce(a, b, c) IS NOT NULL),
        gone AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS i FROM ranked WHERE k > 1),
        kept AS (
            SELECT p.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
                coalesce(string_agg(p.line, chr(10) ORDER BY p.i) FILTER (g.i IS NULL), '') AS text
            FROM plain p LEFT JOIN gone g USING (doc_id, i) GROUP BY p.doc_id)
        SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
            sha256(if(docs.text IS NULL, NULL, kept.text)) AS kept_sha256, if(docs.text IS NULL, NULL, kept.text) AS text
        FROM docs LEFT JOIN kept USING (doc_id)""",
}
