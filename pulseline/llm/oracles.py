"""DuckDB twins of the queries that SQL can express, written the plain way."""

from __future__ import annotations

_WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = """
WITH usable AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
measured AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS norm FROM usable),
pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v) / (q.norm * c.norm) AS score
    FROM measured q JOIN measured c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP2 = f"""
WITH RECURSIVE split AS (
    SELECT doc_id, {_WORDS.format(text=f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')")} AS w FROM documents
),
shingles AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3
        THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM split
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
),
links AS (
    SELECT c.a, c.b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b
    WHERE 100 * c.n >= 85 * (x.n + y.n - c.n)
),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (
    SELECT a, b FROM both_ways
    UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a
),
least AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.m, d.doc_id)) AS component_id,
       least(d.doc_id, coalesce(l.m, d.doc_id)) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least l USING (doc_id)
"""

MIX = f"""
sized AS (
    SELECT doc_id, source, CAST(len({_WORDS.format(text="coalesce(text, '')")}) AS BIGINT) AS size,
           md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS key FROM documents
),
sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][CAST((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS INTEGER)] AS w
    FROM sized GROUP BY source
),
goal AS (SELECT CAST(1.5 AS DOUBLE) * sum(source_size) AS g FROM sources),
levels AS (
    SELECT (g - coalesce((SELECT sum(2.0::DOUBLE * t.source_size) FROM sources t WHERE 2 * t.source_size / t.w < 2 * s.source_size / s.w), 0))
        / (SELECT sum(t.w) FROM sources t WHERE 2 * t.source_size / t.w >= 2 * s.source_size / s.w) AS level,
        2 * s.source_size / s.w AS bound
    FROM sources s, goal
),
targets AS (
    SELECT source, source_size, least(2.0::DOUBLE * source_size, w * (SELECT max(level) FROM levels WHERE level <= bound)) AS target FROM sources
),
placed AS (
    SELECT d.*, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
           coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
"""

OP3 = f"""
WITH {MIX}
SELECT doc_id, size, source_size, target, CAST(CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size
       + greatest(0, least(size, budget % source_size - before)) END AS BIGINT) AS taken FROM placed
"""

OP5 = r"""
WITH parts AS (
    SELECT page_id, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages
),
keyed AS (
    SELECT page_id, html,
        regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*')), '^([^@]*@)?(www[0-9]*\.)?', ''), ':(80|443)?$', '')
        || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '')
        || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '^[^?]*\?(.*)$', 1), '&'),
            lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[^=]*|phpsessid|jsessionid|sid|sessionid)(=|$)'))), '&'), ''), '') AS url_key,
        '"' || md5(html) || '"' AS etag, 'day ' || CAST(page_id % 97 AS VARCHAR) AS modified FROM parts
),
found AS (
    SELECT r.page_id, max(f.page_id) AS target FROM keyed r LEFT JOIN keyed f
    ON f.url_key = r.url_key AND f.page_id * 60 < r.page_id * 60 + 36000 GROUP BY r.page_id
),
judged AS (
    SELECT r.page_id, r.url_key, f.page_id AS target, f.html, f.etag, f.modified, r.etag AS own_etag, r.modified AS own_modified, r.page_id % 8 AS turn,
        CASE WHEN f.page_id IS NULL THEN 'no earlier response'
             WHEN r.page_id % 8 <= 4 THEN CASE WHEN r.etag = f.etag THEN 'etag' ELSE 'changed' END
             WHEN r.page_id % 8 = 5 THEN CASE WHEN r.modified = f.modified THEN 'last-modified' ELSE 'changed' END
             WHEN r.page_id % 8 = 6 THEN 'changed'
             ELSE CASE WHEN md5(r.html) = md5(f.html) THEN 'digest' ELSE 'changed' END END AS outcome
    FROM keyed r JOIN found USING (page_id) LEFT JOIN keyed f ON f.page_id = found.target
)
SELECT page_id * 2 + 1 AS record_id, url_key AS canonical_url,
       CASE WHEN outcome IN ('etag', 'last-modified', 'digest') THEN target * 2 END AS refers_to, outcome,
       CASE WHEN outcome IN ('etag', 'last-modified', 'digest') THEN
           'cache-control: max-age=600' || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || CAST(page_id AS VARCHAR) || chr(10)
           || 'etag: ' || CASE WHEN turn = 4 THEN 'W/' || own_etag ELSE etag END || chr(10) || 'last-modified: ' || modified || chr(10)
           || 'server: ' || CASE WHEN turn = 7 THEN 'edge' ELSE 'origin' END END AS headers,
       CASE WHEN outcome IN ('etag', 'last-modified', 'digest') THEN CAST(length(html) AS BIGINT) END AS payload_chars,
       CASE WHEN outcome IN ('etag', 'last-modified', 'digest') THEN md5(html) END AS payload_md5
FROM judged
"""

OP6 = f"""
WITH split AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS w FROM documents),
windows AS (
    SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM split WHERE len(w) >= 50)
),
first_in AS (SELECT h, min(doc_id) AS d FROM windows GROUP BY h),
gone AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM windows JOIN first_in USING (h) WHERE d < doc_id
),
placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM split),
kept AS (
    SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.i) AS text, count(*) AS n
    FROM placed p ANTI JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i GROUP BY p.doc_id
)
SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256 FROM split s LEFT JOIN kept USING (doc_id)
"""

#: The 256 steps of CRC-32 (reversed polynomial 0xEDB88320), as a one-row table.
_CRC_STEPS = """
    SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS steps
    FROM (SELECT unnest(range(256)) AS i)
"""
#: CRC-32 of the bytes whose hex digits are in ``digits``.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(len(digits) // 2),
        lambda k: CAST('0x' || substr(digits, 2 * k + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])))"""

OP11 = f"""
WITH crc AS ({_CRC_STEPS}),
numbered AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place
    FROM conversations WHERE conv_id IS NOT NULL
),
convs AS (
    SELECT conv_id, conv_id - conv_id % 5 AS lender, {_CRC} % 9 AS h
    FROM (SELECT DISTINCT conv_id, hex(encode(CAST(conv_id AS VARCHAR))) AS digits FROM numbered), crc
),
sequences AS (
    SELECT c.conv_id, 0 AS own, n.place, n.role, n.text FROM convs c JOIN numbered n ON n.conv_id = c.lender AND n.place < c.h
    UNION ALL SELECT c.conv_id, 1, n.place, n.role, n.text FROM convs c JOIN numbered n ON n.conv_id = c.conv_id AND n.place >= c.h
),
steps AS (
    SELECT conv_id, row_number() OVER w AS depth, strlen(text) AS bytes,
           md5(string_agg(strlen(role) || ':' || strlen(text) || ':' || role || text, ',') OVER w) AS node
    FROM sequences WINDOW w AS (PARTITION BY conv_id ORDER BY own, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    UNION ALL SELECT conv_id, 0, 0, 'root' FROM convs
),
linked AS (SELECT s.*, a.node AS parent FROM steps s LEFT JOIN steps a ON a.conv_id = s.conv_id AND a.depth = s.depth - 1),
nodes AS (
    SELECT node, parent, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved FROM linked GROUP BY ALL
),
children AS (SELECT parent AS node, count(*) AS n FROM nodes GROUP BY parent),
sums AS (
    SELECT a.node, sum(u.saved) AS saved, count(*) FILTER (WHERE k.n IS NULL) AS leaves
    FROM nodes u JOIN steps a ON a.conv_id = u.conv_id AND a.depth <= u.depth LEFT JOIN children k ON k.node = u.node GROUP BY a.node
),
ends AS (
    SELECT node, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
    FROM (SELECT conv_id, max_by(node, depth) AS node FROM steps GROUP BY conv_id) GROUP BY node
)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, v.n_convs, coalesce(k.n, 0) AS n_children, s.leaves AS n_leaves,
       CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes v JOIN sums s USING (node) LEFT JOIN nodes p ON p.node = v.parent LEFT JOIN children k ON k.node = v.node LEFT JOIN ends e ON e.node = v.node
"""

OP13 = rf"""
WITH RECURSIVE crc AS ({_CRC_STEPS}),
runs AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents
),
counted AS (SELECT doc_id, run, count(*) AS n, hex(encode(doc_id || ':' || run)) AS digits FROM runs GROUP BY ALL),
hashed AS (SELECT run, n, {_CRC} AS h FROM counted, crc),
bent AS (
    SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) + 2 AS BIGINT)) ELSE run END AS word, n
    FROM hashed
),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM bent WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
rests AS (
    SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
),
pairs AS (
    SELECT a.word, b.word AS near FROM rests a JOIN rests b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT a.word, b.word FROM rests a JOIN words b ON a.rest = b.word
    UNION SELECT b.word, a.word FROM rests a JOIN words b ON a.rest = b.word
),
ranked AS (
    SELECT p.word, p.near, w.n AS near_n, count(*) OVER (PARTITION BY p.word) AS n_near,
           row_number() OVER (PARTITION BY p.word ORDER BY w.n DESC, encode(p.near)) AS place
    FROM pairs p JOIN words w ON w.word = p.near
),
formed AS (
    SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form,
           CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n
    FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1
),
way(word, here, steps) AS (
    SELECT word, word, 0 FROM formed
    UNION ALL SELECT y.word, f.form, y.steps + 1 FROM way y JOIN formed f ON f.word = y.here WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n
FROM formed f JOIN (SELECT word, max_by(here, steps) AS root FROM way GROUP BY word) r USING (word)
"""

ORACLES = {"op1_nearest": OP1, "op2_near_dup": OP2, "op3_mixing": OP3, "op5_revisits": OP5, "op6_repeats": OP6, "op11_prefix_trie": OP11, "op13_spelling": OP13}
