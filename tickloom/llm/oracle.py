"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

SPACE = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ngram_components(n: int, num: int, den: int) -> str:
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+')"
    return f"""
WITH RECURSIVE words AS (SELECT doc_id, {words} AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[])
                             WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
                             ELSE list_distinct(list_transform(range(1, len(w) - {n} + 2), lambda i : array_to_string(w[i:i + {n - 1}], ' '))) END AS s FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING {den} * count(*) >= {num} * (a.n + b.n - count(*))),
edges AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach(doc_id, other) AS (SELECT x, y FROM edges UNION SELECT r.doc_id, e.y FROM reach r JOIN edges e ON r.other = e.x),
least AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(l.other, s.doc_id)) AS component_id
FROM sets s LEFT JOIN least l ON s.doc_id = l.doc_id"""


EXACT_GROUPS = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(text) AS text_sha256
FROM t WINDOW g AS (PARTITION BY text)"""

LINES = f"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
keyed AS (SELECT *, translate(trim(line, {SPACE}), '{UPPER}', '{LOWER}') AS k FROM lines),
first AS (SELECT k, min(doc_id) AS keeper FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT d.*, f.keeper IS NOT NULL AND d.doc_id <> f.keeper AS gone FROM keyed d LEFT JOIN first f ON d.k = f.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

SHARDS = """
WITH named AS (SELECT *, coalesce(lang, 'none') || coalesce('-' || CAST(((doc_id % 4) + 4) % 4 AS VARCHAR), '') AS arrival FROM documents)
SELECT doc_id, arrival, sha256(coalesce(text, '')) AS text_sha256, count(*) OVER () AS manifest_rows,
       arrivals, CAST(0 AS BIGINT) AS arrivals_again, arrivals >= 16 AS merged
FROM named, (SELECT count(DISTINCT arrival) AS arrivals FROM named)"""

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

RANKED = f"""
WITH terms AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM documents),
lengths AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY doc_id),
said AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM lengths),
tfs AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY doc_id, term),
asked AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark) GROUP BY item_id, term),
weights AS (SELECT term, CAST(floor(1000 * ln((CAST(2 AS DOUBLE) * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, said GROUP BY term, docs),
scores AS (SELECT item_id, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // words)))) AS BIGINT) AS score
           FROM asked JOIN tfs USING (term) JOIN weights USING (term) JOIN lengths USING (doc_id), said GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10"""

#: The root's key is empty; a node's key adds the digests of its last turn to its parent's.
TRIE = """
WITH RECURSIVE turns AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
                                md5(coalesce(role, '')) || md5(coalesce(text, '')) AS k, strlen(coalesce(text, '')) AS bytes FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT DISTINCT c, CAST(c AS VARCHAR) AS s FROM turns),
crc(c, s, i, v) AS (
    SELECT c, s, 0, 4294967295::BIGINT FROM convs
    UNION ALL
    SELECT c, s, i + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END
    FROM (SELECT c, s, i, CASE WHEN i % 8 = 0 THEN xor(v, ascii(substr(s, i // 8 + 1, 1))::BIGINT) ELSE v END AS x FROM crc WHERE i < 8 * length(s))),
heads AS (SELECT c, xor(v, 4294967295::BIGINT) % 9 AS h FROM crc WHERE i = 8 * length(s)),
rebuilt AS (SELECT h.c, 0 AS piece, t.i, t.k, t.bytes FROM heads h JOIN turns t ON t.c = h.c - h.c % 5 AND t.i <= h.h
            UNION ALL SELECT h.c, 1, t.i, t.k, t.bytes FROM heads h JOIN turns t ON t.c = h.c AND t.i > h.h),
paths AS (SELECT c, row_number() OVER w AS depth, string_agg(k, '') OVER w AS path, bytes FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY piece, i)
          UNION ALL SELECT c, 0, '', 0 FROM convs),
lengths AS (SELECT c, max(depth) AS n FROM paths GROUP BY c),
nodes AS (SELECT path, depth, min(p.c) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes,
                 sha256(coalesce(string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) FILTER (depth = n), '')) AS ends_sha256
          FROM paths p JOIN lengths l ON p.c = l.c GROUP BY path, depth),
children AS (SELECT left(path, 64 * (depth - 1)) AS parent, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
each AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN children k ON k.parent = n.path),
below AS (SELECT a.path, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.bytes) AS saved
          FROM each a JOIN each b ON b.depth >= a.depth AND starts_with(b.path, a.path) GROUP BY a.path)
SELECT e.conv_id, e.depth, p.conv_id AS parent_conv_id, e.n_convs, e.n_children, b.n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, e.ends_sha256
FROM each e JOIN below b ON e.path = b.path LEFT JOIN nodes p ON e.depth > 0 AND p.path = left(e.path, 64 * (e.depth - 1))"""
