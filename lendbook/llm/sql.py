"""The corpus queries SQL can answer, as DuckDB statements over the same tables."""

from __future__ import annotations

_WS = r"[^\x20\x09-\x0D]+"

OP3 = rf"""
WITH docs AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
words AS (
    SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS place
    FROM (SELECT rid, regexp_extract_all(text, '{_WS}') AS w FROM docs)),
windows AS (
    SELECT rid, place, word,
           lead(word, 1) OVER o AS second, lead(word, 2) OVER o AS third
    FROM words WINDOW o AS (PARTITION BY rid ORDER BY place)),
repeated AS (
    SELECT rid, place FROM (
        SELECT rid, place, count(*) OVER (PARTITION BY rid, word, second, third) AS n
        FROM windows WHERE third IS NOT NULL) WHERE n > 1),
covered AS (
    SELECT rid, count(DISTINCT p) AS n_repeat_words
    FROM (SELECT rid, unnest([place, place + 1, place + 2]) AS p FROM repeated) GROUP BY rid),
per_word AS (
    SELECT rid, count(*) AS n_words, sum(length(word)) AS word_chars,
           count(*) FILTER (WHERE regexp_matches(word, '[A-Z]')
                            AND NOT regexp_matches(word, '[a-z]')) AS n_upper
    FROM words GROUP BY rid),
lines AS (
    SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
    FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs)
    WHERE regexp_matches(line, '{_WS}') GROUP BY rid),
measured AS (
    SELECT d.doc_id, coalesce(w.n_words, 0) AS n_words, coalesce(w.word_chars, 0) AS word_chars,
           length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
           coalesce(l.n_dup_lines, 0) AS n_dup_lines, coalesce(l.n_lines, 0) AS n_lines,
           coalesce(c.n_repeat_words, 0) AS n_repeat_words, coalesce(w.n_upper, 0) AS n_upper
    FROM docs d LEFT JOIN per_word w USING (rid) LEFT JOIN lines l USING (rid)
    LEFT JOIN covered c USING (rid)),
bits AS (
    SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END
      + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
      + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
      + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
      + CASE WHEN 100 * n_upper > 30 * n_words THEN 16 ELSE 0 END
      + CASE WHEN word_chars < 2 * n_words THEN 32 ELSE 0 END
      + CASE WHEN word_chars > 15 * n_words THEN 64 ELSE 0 END)::BIGINT AS fail_bits
    FROM measured)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars,
       n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, (fail_bits & 3) <> 0 AS base_failed,
       fail_bits = 0 AS kept, fail_bits
FROM bits
"""

OP8 = r"""
WITH parts AS (
    SELECT page_id, url, coalesce(html, '') AS html,
           regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#]*)([^?#]*)(?:\?([^#]*))?',
                          ['host', 'path', 'query']) AS u
    FROM pages),
named AS (
    SELECT page_id, url, html, md5(html) AS digest, strlen(html) AS body,
        CASE WHEN url IS NOT NULL THEN
        regexp_replace(regexp_replace(lower(u.host), '^www[.]', ''), ':(80|443)$', '')
        || regexp_replace(regexp_replace(u.path, '/+$', ''), '/index[.]html?$', '') END AS place,
        array_to_string(list_sort(list_filter(string_split(u.query, '&'), lambda x: x <> ''
            AND NOT regexp_matches(x, '^(utm_[^=]*|ref|gclid|fbclid|sessionid|sid)(=|$)'))),
            '&') AS query
    FROM parts),
urls AS (
    SELECT *, place || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS canonical_url,
           '"' || digest[1:16] || '"' AS tag, (page_id * 600 - 3600)::VARCHAR AS changed,
           page_id % 5 AS kind, page_id * 600 AS full_ts,
           page_id * 600 + 60 + (page_id * 7919) % 86400 AS ts
    FROM named),
pairs AS (
    SELECT r.*, f.page_id AS f_page, f.tag AS f_tag, f.changed AS f_changed,
           f.digest AS f_digest, f.body AS f_body, f.full_ts AS f_ts
    FROM urls r ASOF LEFT JOIN urls f
      ON r.canonical_url = f.canonical_url AND r.ts > f.full_ts),
agreed AS (
    SELECT *, CASE kind WHEN 0 THEN tag = f_tag WHEN 1 THEN tag = f_tag
                        WHEN 2 THEN changed = f_changed WHEN 3 THEN '"gone"' = f_tag
                        ELSE digest = f_digest END AS same
    FROM pairs),
told AS (
    SELECT *, CASE WHEN canonical_url IS NULL THEN 'no_url'
                   WHEN f_page IS NULL THEN 'no_earlier_response'
                   WHEN same THEN 'resolved' ELSE 'validator_mismatch' END AS status,
           CASE kind WHEN 0 THEN tag WHEN 1 THEN 'W/' || tag WHEN 3 THEN '"gone"' END AS sent
    FROM agreed)
SELECT page_id * 2 + 1 AS capture_id, url, canonical_url, ts, status,
       CASE WHEN status = 'resolved' THEN f_page * 2 END AS refers_to,
       CASE WHEN status = 'resolved' THEN array_to_string([
            'cache-control: max-age=120', 'content-length: ' || f_body, 'content-type: text/html',
            'date: ' || ts, 'etag: ' || coalesce(sent, f_tag),
            'last-modified: ' || f_changed], chr(10))
       ELSE array_to_string(list_filter([
            'cache-control: max-age=120', 'connection: close', 'content-length: 0',
            'date: ' || ts, 'etag: ' || sent,
            CASE WHEN kind = 2 THEN 'last-modified: ' || changed END],
            lambda x: x IS NOT NULL), chr(10)) END AS headers,
       CASE WHEN status = 'resolved' THEN f_digest END AS payload_digest,
       CASE WHEN status = 'resolved' THEN f_body::BIGINT END AS payload_length
FROM told
"""

OP4 = r"""
WITH lines AS (
    SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS pos, len(l) AS n
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents
          WHERE text IS NOT NULL)),
hashed AS (
    SELECT *, ('0x' || md5(line)[1:8])::BIGINT AS h FROM lines),
rolled AS (
    SELECT *, coalesce(lag(h) OVER o, 0) * 31 + h AS r, length(line) >= 200 AS long_line,
           coalesce(lead(length(line)) OVER o, 0) >= 200 AS next_long
    FROM hashed WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
cut AS (
    SELECT *, (coalesce(r < lag(r) OVER o AND r <= lead(r) OVER o, false)
               OR long_line OR next_long) AS ends
    FROM rolled WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
numbered AS (
    SELECT *, coalesce(sum(ends::INT) OVER (
        PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
        AS chunk_no FROM cut),
chunks AS (
    SELECT doc_id, chunk_no, string_agg(line, chr(10) ORDER BY pos) AS chunk, count(*) AS n_lines,
           count(*) FILTER (WHERE regexp_matches(line, '[^ \t\n\x0b\f\r]')) AS filled
    FROM numbered GROUP BY ALL),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, chunk_no) > 1
        AND (filled >= 2 OR (length(chunk) >= 200 AND filled > 0)) AS gone
    FROM chunks),
pairs AS (
    SELECT doc_id, pos, line || chr(10) || next_line AS pair
    FROM (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS next_line FROM lines)
    WHERE next_line IS NOT NULL AND NOT (length(line) >= 200 AND length(next_line) >= 200)
      AND regexp_matches(line || next_line, '[^ \t\n\x0b\f\r]')),
later AS (
    SELECT doc_id, pos FROM (
        SELECT *, row_number() OVER (PARTITION BY pair ORDER BY doc_id, pos) AS place FROM pairs)
    WHERE place > 1),
told AS (
    SELECT n.doc_id, n.pos, n.line, r.gone,
           r.gone OR EXISTS (FROM later l WHERE l.doc_id = n.doc_id AND l.pos = n.pos)
           OR EXISTS (FROM later l WHERE l.doc_id = n.doc_id AND l.pos + 1 = n.pos) AS covered
    FROM numbered n JOIN ranked r USING (doc_id, chunk_no)),
stretched AS (
    SELECT *, sum((NOT covered)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS stretch,
           len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words
    FROM told),
judged AS (
    SELECT *, gone OR covered AND sum(words) FILTER (WHERE covered) OVER (
        PARTITION BY doc_id, stretch) >= 50 AS goes
    FROM stretched),
left_over AS (
    SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT goes) AS text,
           count(*) AS n_lines, count(*) FILTER (WHERE goes) AS n_lines_removed
    FROM judged GROUP BY doc_id),
chunks_gone AS (
    SELECT doc_id, count(*) FILTER (WHERE gone) AS n_chunks_removed FROM ranked GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(o.text, '') END AS text,
       coalesce(o.n_lines, 0)::BIGINT AS n_lines,
       coalesce(g.n_chunks_removed, 0)::BIGINT AS n_chunks_removed,
       coalesce(o.n_lines_removed, 0)::BIGINT AS n_lines_removed
FROM documents d LEFT JOIN left_over o USING (doc_id) LEFT JOIN chunks_gone g USING (doc_id)
"""

_TERMS = r"""regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

OP13 = f"""
WITH held AS (
    SELECT row_number() OVER () AS doc, doc_id, terms, len(terms) AS n
    FROM (SELECT doc_id, {_TERMS} AS terms FROM documents) WHERE len(terms) > 0),
corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS all_terms FROM held),
counted AS (
    SELECT doc, doc_id, n, term, count(*) AS tf
    FROM (SELECT doc, doc_id, n, unnest(terms) AS term FROM held) GROUP BY ALL),
asked AS (
    SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark)),
weighed AS (
    SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
    FROM counted, corpus GROUP BY term, docs),
scored AS (
    SELECT item_id, doc, doc_id, sum(w * ((1000000000 * tf) // (
        1000 * tf + 20 * (100 - 50 + (50 * n * docs) // all_terms))))::BIGINT AS score
    FROM asked JOIN counted USING (term) JOIN weighed USING (term), corpus GROUP BY ALL),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank
    FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""

SQL = {"op4_line_dedup": OP4, "op3_quality_ledger": OP3,
       "op8_revisit_resolution": OP8, "op13_ranked_search": OP13}
