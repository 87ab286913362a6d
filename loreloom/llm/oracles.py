"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from loreloom.llm.common import ASCII_LOWER, ASCII_UPPER
from loreloom.llm.embedding_dedup import LEAST

WORDS = r"regexp_extract_all({text}, '[^\x20\x09-\x0D]+')"

#: The smallest id that edges (a, b, both ways) reach from each node.
REACH = """
reach AS (
    SELECT node, node AS seen FROM nodes
    UNION
    SELECT reach.node, edges.b FROM reach JOIN edges ON reach.seen = edges.a
),
parts AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
"""

OP1 = f"""
WITH RECURSIVE words AS (
    SELECT doc_id, {WORDS.format(text=f"translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}')")} AS w FROM documents
),
sets AS (
    SELECT doc_id, CASE
        WHEN len(w) = 0 THEN []::VARCHAR[]
        WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)])
    END AS s FROM words
),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (
    SELECT x.doc_id AS a, y.doc_id AS b FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id < y.doc_id
    GROUP BY 1, 2, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
nodes AS (SELECT doc_id AS node FROM sets),
{REACH}
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM sets JOIN parts ON node = doc_id
"""

OP3 = f"""
WITH sized AS (
    SELECT doc_id, source, len({WORDS.format(text="coalesce(text, '')")})::BIGINT AS size,
        ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS row_hash
    FROM documents
),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
    SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_rank FROM totals
),
weighed AS (
    SELECT *, [5, 2, 1][source_rank % 3 + 1] AS weight, 2 * source_size AS cap,
        2 * source_size / [5, 2, 1][source_rank % 3 + 1]::DOUBLE AS ratio
    FROM ranked
),
filled AS (
    SELECT *, sum(source_size) OVER () AS everything, sum(weight) OVER () AS weights,
        coalesce(sum(cap) OVER w, 0)::DOUBLE AS capped, coalesce(sum(weight) OVER w, 0)::DOUBLE AS passed
    FROM weighed WINDOW w AS (ORDER BY ratio, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
levels AS (SELECT *, (everything * 3 / 2.0::DOUBLE - capped) / (weights - passed) AS level FROM filled),
chosen AS (SELECT min_by(level, ratio) AS level FROM levels WHERE ratio >= level),
targets AS (
    SELECT source, source_size, everything, coalesce(least(cap::DOUBLE, weight * chosen.level), cap::DOUBLE) AS target
    FROM levels, chosen
),
queued AS (
    SELECT sized.*, source_size, target, everything,
        sum(size) OVER (PARTITION BY sized.source ORDER BY row_hash, doc_id, size ROWS UNBOUNDED PRECEDING) AS reached
    FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
),
copies AS (
    SELECT queued.*, epoch, (reached + epoch * source_size)::DOUBLE / target AS finish
    FROM queued, (VALUES (0), (1)) e(epoch) WHERE target > 0
),
used AS (
    SELECT *, sum(size) OVER (
        ORDER BY finish, epoch, source NULLS LAST, row_hash, doc_id, size ROWS UNBOUNDED PRECEDING
    ) AS spent FROM copies
),
taken AS (
    SELECT doc_id, source, sum(size)::BIGINT AS taken FROM used WHERE spent <= everything * 3 // 2 GROUP BY doc_id, source
)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(t.taken, 0) AS taken, q.source
FROM queued q LEFT JOIN taken t ON q.doc_id = t.doc_id AND q.source IS NOT DISTINCT FROM t.source
"""

OP6 = r"""
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
    UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
    sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(length(role) + length(text) + len(regexp_extract_all(text, '<\\*\|'))
        + length('<|im_start|>') + 1 + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""

OP7 = f"""
WITH RECURSIVE vectors AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS norm
    FROM embeddings
),
links AS (
    SELECT x.vec_id AS a, y.vec_id AS b FROM vectors x JOIN vectors y
    ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v) AND x.norm > 0 AND y.norm > 0
    WHERE list_inner_product(x.v, y.v) / (x.norm * y.norm) >= {LEAST}
),
edges AS (SELECT a, b FROM links),
nodes AS (SELECT vec_id AS node FROM vectors),
{REACH}
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM vectors JOIN parts ON node = vec_id
"""

#: CRC-32 by its table, one byte at a time.
CRC_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"

OP8 = f"""
WITH crc AS (
    SELECT list_transform(range(256), lambda b: list_reduce([b::BIGINT] || range(8), lambda c, _: {CRC_STEP})) AS entry
),
sized AS (
    SELECT doc_id, (coalesce(strlen(text), 0) + 16)::BIGINT AS size,
        xor(list_reduce([4294967295::BIGINT] || [
            ('0x' || substr(hex(encode(coalesce(text, ''))), 2 * i + 1, 2))::BIGINT
            FOR i IN range(strlen(coalesce(text, '')))
        ], lambda c, b: xor(c >> 8, entry[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
    FROM documents, crc
),
placed AS (
    SELECT *, sum(size) OVER w - size AS start, sum(size) OVER () AS everything, row_number() OVER w AS place
    FROM sized WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)
),
cut AS (SELECT *, least((2 * start + size) * 40 // (2 * everything), 39)::INT AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
    row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS slot, NULL::INT AS grown_shard
FROM cut
"""

#: CRC-32 of the UTF-8 bytes of ``{text}``, with ``crc`` in the FROM clause.
CRC_TABLE = f"SELECT list_transform(range(256), lambda b: list_reduce([b::BIGINT] || range(8), lambda c, _: {CRC_STEP})) AS entry"
CRC32 = """xor(list_reduce([4294967295::BIGINT] || [
    ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT FOR i IN range(strlen({text}))
], lambda c, b: xor(c >> 8, entry[(xor(c, b) & 255) + 1])), 4294967295)"""

LEAF = " || ".join(
    f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(({c})::VARCHAR) || ':' || ({c})::VARCHAR END"
    for c in ("doc_id", "source", "lang", "{n_chars}", "text")
)
PAIRED = """list_transform(range((len(h) + 1) // 2), lambda i: sha256(h[2 * i + 1] || coalesce(h[2 * i + 2], '')))"""

OP11 = f"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
rows AS (
    SELECT doc_id, lang, sha256({LEAF.format(n_chars="n_chars")}) AS leaf,
        CASE WHEN {CRC32.format(text="doc_id::VARCHAR")} % 7 = 0 THEN sha256({LEAF.format(n_chars="n_chars::HUGEINT + 1")})
            ELSE sha256({LEAF.format(n_chars="n_chars")}) END AS claim
    FROM documents, crc
),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM rows
),
tree AS (
    SELECT lang, 0 AS level, list(leaf ORDER BY place) AS h FROM placed GROUP BY lang
    UNION ALL
    SELECT lang, level + 1, {PAIRED} FROM tree WHERE len(h) > 1
),
subroots AS (
    SELECT lang, h[1] AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS place
    FROM tree WHERE len(h) = 1
),
top AS (
    SELECT 0 AS level, list(subroot ORDER BY place) AS h FROM subroots
    UNION ALL
    SELECT level + 1, {PAIRED} FROM top WHERE len(h) > 1
),
steps AS (
    SELECT doc_id, placed.lang, place, level, h, (place >> level) AS spot
    FROM placed JOIN tree ON placed.lang IS NOT DISTINCT FROM tree.lang WHERE len(h) > 1
    UNION ALL
    SELECT doc_id, placed.lang, placed.place, 1000 + level, h, (subroots.place >> level)
    FROM placed JOIN subroots ON placed.lang IS NOT DISTINCT FROM subroots.lang, top WHERE len(h) > 1
),
ways AS (
    SELECT doc_id, lang, place, list(CASE WHEN spot % 2 = 1 THEN 'L' || h[spot] ELSE 'R' || coalesce(h[spot + 2], '') END ORDER BY level) AS way
    FROM steps GROUP BY doc_id, lang, place
),
folded AS (
    SELECT placed.doc_id, placed.leaf, subroot, (SELECT h[1] FROM top WHERE len(h) = 1) AS root,
        sha256(coalesce(array_to_string([s[2:] FOR s IN way], ''), '')) AS proof_sha256,
        list_reduce([claim] || coalesce(way, []), lambda d, s: sha256(
            CASE WHEN s[1] = 'L' THEN s[2:] || d ELSE d || s[2:] END)) AS folded_root
    FROM placed JOIN subroots ON placed.lang IS NOT DISTINCT FROM subroots.lang
    LEFT JOIN ways ON placed.doc_id IS NOT DISTINCT FROM ways.doc_id AND placed.lang IS NOT DISTINCT FROM ways.lang
        AND placed.place = ways.place
)
SELECT *, folded_root = root AS verified FROM folded
"""

OP13 = f"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
runs AS (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), '{ASCII_UPPER}', '{ASCII_LOWER}') AS run
    FROM documents
),
counted AS (SELECT doc_id, run, coalesce(doc_id::VARCHAR, '') || ':' || run AS key, count(*) AS n FROM runs GROUP BY ALL),
coded AS (SELECT run, n, {CRC32.format(text="key")} AS h FROM counted, crc),
written AS (
    SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
        ELSE run END AS word FROM coded
),
words AS (
    SELECT word, sum(n)::BIGINT AS n FROM written WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
),
less AS (
    SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
    FROM (SELECT word, unnest(range(1, length(word) + 1))::INT AS i FROM words)
),
near AS (
    SELECT x.word, y.word AS other FROM less x JOIN less y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
    UNION SELECT words.word, less.word FROM words JOIN less ON words.word = rest
    UNION SELECT less.word, words.word FROM words JOIN less ON words.word = rest
),
chosen AS (
    SELECT near.word, count(*) AS n_near, arg_min(near.other, (-o.n, encode(near.other))) AS other, max(o.n) AS other_n
    FROM near JOIN words o ON near.other = o.word GROUP BY near.word
),
forms AS (
    SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form,
        CASE WHEN other_n >= 2 * n THEN other_n END AS form_n
    FROM words LEFT JOIN chosen ON words.word = chosen.word
),
chain AS (
    SELECT word, word AS at FROM forms
    UNION ALL
    SELECT chain.word, forms.form FROM chain JOIN forms ON chain.at = forms.word WHERE forms.form IS NOT NULL
)
SELECT forms.word, forms.form, chain.at AS root, forms.n, forms.n_near, forms.form_n
FROM forms JOIN chain ON forms.word = chain.word JOIN forms last ON chain.at = last.word WHERE last.form IS NULL
"""

ORACLES = {
    "op1_ngram_join": OP1, "op3_mixing": OP3, "op6_chat_format": OP6, "op7_embedding_dedup": OP7, "op8_sharding": OP8,
    "op11_merkle_manifest": OP11, "op13_spelling_variants": OP13,
}
