"""Results of registered queries in SQL, written independently of how Spark gets them."""

from __future__ import annotations

from muster.llm.licences import NOTICES, SPELLINGS


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical(column: str) -> str:
    sql = rf"regexp_replace(lower({column}), '(?m)^[ \t]*(copyright|\(c\)|©)[^\n]*$', '', 'g')"
    sql = rf"trim(regexp_replace({sql}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    for variant, usual in SPELLINGS:
        sql = f"replace({sql}, {_quoted(variant)}, {_quoted(usual)})"
    return sql


LICENSES = f"""
    WITH known AS (
        SELECT min(license) AS license, sha256({_canonical("text")}) AS digest
        FROM (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in NOTICES)}) AS n(license, text)
        GROUP BY 2
    ),
    lines AS (
        SELECT row_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line
        FROM (SELECT row_number() OVER () AS row_id, * FROM documents)
    ),
    hits AS (
        SELECT row_id, string_agg(DISTINCT license, ',' ORDER BY license) AS names, count(*) AS n
        FROM lines JOIN known ON sha256({_canonical("line")}) = digest GROUP BY row_id
    )
    SELECT doc_id, sha256({_canonical("coalesce(text, '')")}) AS text_sha256, known.license AS license,
           coalesce(names, '') AS line_licenses, coalesce(n, 0) AS n_license_lines
    FROM (SELECT row_number() OVER () AS row_id, * FROM documents) d
    LEFT JOIN known ON sha256({_canonical("coalesce(text, '')")}) = digest
    LEFT JOIN hits USING (row_id)
"""

_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

DECONTAMINATION = rf"""
    WITH item_words AS (
        SELECT item_id, regexp_extract_all(translate(text, {_UPPER}, {_LOWER}),
                                           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM benchmark WHERE text IS NOT NULL
    ),
    windows AS (
        SELECT DISTINCT item_id, least(10, len(w)) AS width, array_to_string(w[i + 1 : i + 10], ' ') AS win
        FROM (SELECT item_id, w, unnest(range(greatest(1, len(w) - 9))) AS i FROM item_words WHERE len(w) > 0)
    ),
    words AS (
        SELECT doc_id, coalesce(regexp_extract_all(translate(text, {_UPPER}, {_LOWER}),
                                          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
        FROM documents
    ),
    hits AS (
        SELECT doc_id, p, windows.width, item_id
        FROM (SELECT doc_id, w, unnest(range(len(w))) AS p FROM words)
        CROSS JOIN (SELECT DISTINCT width FROM windows) AS v
        JOIN windows ON windows.width = v.width AND win = array_to_string(w[p + 1 : p + v.width], ' ')
        WHERE p + v.width <= len(w)
    ),
    totals AS (
        SELECT doc_id, count(DISTINCT q) AS n_hit FROM (
            SELECT doc_id, unnest(range(p, p + width)) AS q FROM hits
        ) GROUP BY doc_id
    ),
    items AS (
        SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hits) GROUP BY doc_id
    )
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM words LEFT JOIN totals USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_BACKSLASH = "chr(92)"


def _escaped(column: str) -> str:
    sql = f"replace({column}, {_BACKSLASH}, {_BACKSLASH} || {_BACKSLASH})"
    for mark in ("<turn>", "</turn>"):
        sql = f"replace({sql}, '{mark}', {_BACKSLASH} || '{mark}')"
    return sql


CHAT = rf"""
    WITH said AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
        UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
    )
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))
               AS loss_sha256,
           sum(length('<turn>') + length(replace({_escaped("role")}, chr(10), chr(92) || 'n')) + 1
               + length({_escaped("text")}) + length('</turn>') + 1)::BIGINT AS formatted_chars
    FROM said GROUP BY conv_id
"""

SHARDS = """
    WITH crc_table AS (
        SELECT list_transform(range(256), lambda n: list_reduce(
            list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
            lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
    ),
    bytes AS (
        SELECT doc_id, text, hex(encode(text)) AS h FROM documents
    ),
    sized AS (
        SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 8 AS size,
               CASE WHEN text IS NOT NULL THEN xor(list_reduce(list_prepend(4294967295,
                   list_transform(range(length(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT)),
                   lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) END AS text_crc32
        FROM bytes CROSS JOIN crc_table
    ),
    placed AS (
        SELECT *, ((sum(size) OVER (ORDER BY text_crc32 NULLS FIRST, doc_id NULLS FIRST, size
                                    ROWS UNBOUNDED PRECEDING) - size) * 24
                   // sum(size) OVER ())::INT AS shard
        FROM sized
    )
    SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard,
           row_number() OVER (PARTITION BY shard ORDER BY text_crc32 NULLS FIRST, doc_id NULLS FIRST, size) - 1 AS slot,
           NULL::INT AS grown_shard
    FROM placed
"""

LINES = r"""
    WITH raw AS (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) - 1 AS number
        FROM documents WHERE text IS NOT NULL
    ),
    lines AS (
        SELECT doc_id, number, regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+') AS w FROM raw
    ),
    kinds AS (
        SELECT w, min((doc_id, number)) AS first FROM lines WHERE len(w) >= 1 GROUP BY w
    ),
    variants AS (
        SELECT w, first, i, w[1 : i] || w[i + 2 :] AS v
        FROM (SELECT w, first, unnest(range(len(w))) AS i FROM kinds WHERE len(w) >= 4)
    ),
    near AS (
        SELECT a.w FROM variants a JOIN variants b ON a.v = b.v AND a.i = b.i WHERE b.first < a.first
        UNION SELECT a.w FROM variants a JOIN kinds b ON a.v = b.w WHERE len(b.w) >= 4 AND b.first < a.first
        UNION SELECT b.w FROM variants a JOIN kinds b ON a.v = b.w WHERE len(b.w) >= 4 AND a.first < b.first
    )
    SELECT doc_id, number AS line, near.w IS NOT NULL AS near
    FROM lines JOIN kinds USING (w) LEFT JOIN near USING (w)
    WHERE near.w IS NOT NULL OR (doc_id, number) <> first
"""

COMPONENTS = rf"""
    WITH RECURSIVE words AS (
        SELECT doc_id, coalesce(regexp_extract_all(translate(text, {_UPPER}, {_LOWER}),
                                                   '[^\x20\x09-\x0D]+'), []) AS w
        FROM documents
    ),
    shingles AS (
        SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 5], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(greatest(1, len(w) - 4))) AS i FROM words WHERE len(w) > 0)
    ),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    shared AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o
        FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
    ),
    links AS (
        SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
        WHERE 100 * o >= 75 * (x.n + y.n - o)
    ),
    reach AS (
        SELECT doc_id, doc_id AS r FROM words
        UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON r = a
    )
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
    FROM (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
    LEFT JOIN sizes USING (doc_id)
"""

_CRC_TABLE = """
    crc_table AS (
        SELECT list_transform(range(256), lambda n: list_reduce(
            list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
            lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
    )
"""

SPELLING = rf"""
    WITH RECURSIVE {_CRC_TABLE},
    runs AS (
        SELECT doc_id, run, count(*) AS n
        FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, {_UPPER}, {_LOWER}), '[A-Za-zÀ-ÿ]+')) AS run
              FROM documents WHERE text IS NOT NULL)
        WHERE length(run) >= 7 GROUP BY ALL
    ),
    hashed AS (
        SELECT run, n, xor(list_reduce(list_prepend(4294967295,
                   list_transform(range(length(x) // 2), lambda i: ('0x' || x[2 * i + 1 : 2 * i + 2])::BIGINT)),
                   lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
        FROM (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, 'None') || ':' || run)) AS x FROM runs) CROSS JOIN crc_table
    ),
    words AS (
        SELECT word, sum(n)::BIGINT AS n
        FROM (SELECT n, CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
                             ELSE run END AS word FROM hashed)
        WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
    ),
    shorter AS (
        SELECT word, i, left(word, i::INT) || substr(word, i::INT + 2) AS v
        FROM (SELECT word, unnest(range(length(word))) AS i FROM words)
    ),
    near AS (
        SELECT a.word, b.word AS other FROM shorter a JOIN shorter b ON a.v = b.v AND a.i = b.i AND a.word <> b.word
        UNION SELECT a.word, b.word FROM shorter a JOIN words b ON a.v = b.word
        UNION SELECT b.word, a.word FROM shorter a JOIN words b ON a.v = b.word
    ),
    best AS (
        SELECT near.word, count(*) AS n_near,
               first(o.word ORDER BY o.n DESC, o.word) AS form, max(o.n) AS form_n
        FROM near JOIN words o ON other = o.word GROUP BY near.word
    ),
    forms AS (
        SELECT words.word, form, n, form_n FROM words JOIN best USING (word) WHERE form_n >= 10 * n
    ),
    steps AS (
        SELECT word, form AS root FROM forms
        UNION SELECT steps.word, forms.form FROM steps JOIN forms ON steps.root = forms.word
    ),
    roots AS (
        SELECT word, root FROM steps WHERE root NOT IN (SELECT word FROM forms)
    )
    SELECT word, form, coalesce(root, word) AS root, words.n, coalesce(n_near, 0) AS n_near, forms.form_n
    FROM words LEFT JOIN (SELECT word, n_near FROM best) USING (word)
    LEFT JOIN (SELECT word, form, form_n FROM forms) AS forms USING (word) LEFT JOIN roots USING (word)
"""

PASSAGES = r"""
    WITH words AS (
        SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
    ),
    windows AS (
        SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 50], ' ')) AS h
        FROM (SELECT doc_id, w, unnest(range(len(w) - 49)) AS i FROM words WHERE len(w) >= 50)
    ),
    firsts AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h),
    gone AS (
        SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM windows JOIN firsts USING (h) WHERE first < doc_id
    ),
    tokens AS (
        SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS p FROM words
    ),
    kept AS (
        SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text
        FROM tokens ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
    )
    SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
           sha256(coalesce(text, '')) AS kept_sha256
    FROM words LEFT JOIN kept USING (doc_id)
"""

COLLOCATIONS = rf"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array(translate(text, {_UPPER}, {_LOWER}), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents WHERE text IS NOT NULL
    ),
    words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
    totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
    phrases AS (
        SELECT lang, w[i + 1 : i + size] AS w
        FROM (SELECT lang, w, size, unnest(range(greatest(0, len(w) - size + 1))) AS i
              FROM words CROSS JOIN (SELECT unnest(range(1, 5)) AS size))
    ),
    counted AS (SELECT lang, w, count(*) AS a FROM phrases GROUP BY lang, w HAVING count(*) >= 30),
    candidates AS (SELECT * FROM counted WHERE len(w) > 1),
    cuts AS (
        SELECT c.lang, c.w, c.a, k, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a) // (x.a + y.a) AS score
        FROM (SELECT *, unnest(range(1, len(w))) AS k FROM candidates) c
        JOIN counted x ON x.lang = c.lang AND x.w = c.w[1 : k]
        JOIN counted y ON y.lang = c.lang AND y.w = c.w[k + 1 :]
    ),
    scored AS (
        SELECT lang, w, a, first(l ORDER BY score, k) AS l, first(r ORDER BY score, k) AS r, min(score) AS score
        FROM cuts GROUP BY lang, w, a
    ),
    inside AS (
        SELECT lang, w[i + 1 : i + size] AS w, max(a) AS longer
        FROM (SELECT lang, w, a, size, unnest(range(len(w) - size + 1)) AS i
              FROM candidates CROSS JOIN (SELECT unnest([2, 3]) AS size) WHERE len(w) > size)
        GROUP BY ALL
    ),
    ranked AS (
        SELECT lang, array_to_string(w, ' ') AS phrase, a, l, r, score,
               row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(w, ' ')) AS rank
        FROM scored LEFT JOIN inside USING (lang, w)
        WHERE longer IS NULL OR 100 * longer::HUGEINT < 80 * a::HUGEINT
    )
    SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
    FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
