"""DuckDB SQL for the registered queries of this subpackage."""

from answerloom.llm import license_scan

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACE_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
STRIP = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

REPEATED_LINES = f"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents
), keyed AS (
    SELECT *, {STRIP.format(LOWER.format('line'))} AS key FROM lines
), frequent AS (
    SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
), marked AS (
    SELECT doc_id, pos, line, key IN (SELECT key FROM frequent) AS dropped FROM keyed
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE worded AS (
    SELECT doc_id, {SPACE_WORDS.format(LOWER.format("coalesce(text, '')"))} AS w FROM documents
), shingled AS (
    SELECT doc_id, CASE
        WHEN len(w) = 0 THEN []
        WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s
    FROM worded
), classes AS (
    SELECT s, min(doc_id) AS node FROM (SELECT doc_id, list_sort(s) AS s FROM shingled WHERE len(s) > 0) GROUP BY s
), items AS (SELECT node, len(s) AS n, unnest(s) AS item FROM classes),
pairs AS (
    SELECT a.node AS a, b.node AS b, any_value(a.n) AS n_a, any_value(b.n) AS n_b, count(*) AS both_n
    FROM items a JOIN items b ON a.item = b.item AND a.node < b.node GROUP BY a.node, b.node
), links AS (SELECT a, b FROM pairs WHERE 100 * both_n >= 75 * (n_a + n_b - both_n)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
    SELECT node, node AS seen FROM classes
    UNION SELECT reach.node, edges.b FROM reach JOIN edges ON reach.seen = edges.a
), labels AS (SELECT node, min(seen) AS component FROM reach GROUP BY node),
placed AS (
    SELECT shingled.doc_id, len(shingled.s) AS n_shingles, coalesce(labels.component, shingled.doc_id) AS component_id
    FROM shingled LEFT JOIN classes ON list_sort(shingled.s) = classes.s LEFT JOIN labels ON classes.node = labels.node
)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM placed
"""

_PUNCTUATED = r"list_filter(regexp_split_to_array(lower({}), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

BENCHMARK_WINDOWS = f"""
WITH texts AS (
    SELECT doc_id, {_PUNCTUATED.format("coalesce(text, '')")} AS w FROM documents
), items AS (
    SELECT item_id, {_PUNCTUATED.format("coalesce(text, '')")} AS w FROM benchmark
), doc_rows AS (
    SELECT doc_id, len(w) - 4 AS n, i - 1 AS pos, array_to_string(w[i:i + 4], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM texts WHERE len(w) >= 5)
), item_rows AS (
    SELECT item_id, len(w) - 4 AS size, array_to_string(w[i:i + 4], ' ') AS s
    FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM items WHERE len(w) >= 5)
), weights AS (SELECT item_id, size, s, count(*) AS weight FROM item_rows GROUP BY ALL),
hits AS (SELECT doc_id, n, item_id, size, pos, s, weight FROM doc_rows JOIN weights USING (s)),
windows AS (SELECT DISTINCT doc_id, item_id, size, n, pos AS start FROM hits),
shared AS (
    SELECT windows.doc_id, windows.item_id, windows.size, windows.n, start, hits.s, least(count(*), any_value(weight)) AS common
    FROM windows JOIN hits ON windows.doc_id = hits.doc_id AND windows.item_id = hits.item_id
         AND hits.pos >= start AND hits.pos < start + windows.size
    GROUP BY ALL
), sums AS (
    SELECT doc_id, item_id, start, size, least(size, n - start) AS whole, sum(common)::BIGINT AS common
    FROM shared GROUP BY doc_id, item_id, start, size, n
), close AS (
    SELECT *, common::DOUBLE / (whole + size - common) AS similarity FROM sums
    WHERE 100 * common >= 75 * (whole + size - common)
)
SELECT doc_id, item_id, similarity, start AS first_word, whole + 4 AS n_words
FROM close QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

ARCHIVES = f"""
WITH hashed AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), firsts AS (SELECT hex, min(page_id) AS first FROM hashed GROUP BY hex)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, array_to_string([
           '{_BASE32}'[1 + ((('0x' || hex[1 + 5 * (k // 4):5 + 5 * (k // 4)])::BIGINT >> (15 - 5 * (k % 4))) & 31)]
           FOR k IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM hashed JOIN firsts USING (hex)
"""


def _licenses() -> str:
    """Phrases by their word lists, templates as regular expressions over spaced words."""
    spots, base = [], []
    for phrase, label in license_scan.PHRASES:
        words = phrase.split()
        stand = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words))
        spots.append(f"[i - 1 FOR i IN range(1, len(w) + 1) IF {stand}]")
        base.append(f"CASE WHEN contains(joined, ' {phrase} ') THEN '{label}' END")
    own = [
        f"CASE WHEN regexp_matches(joined, '{license_scan.as_regex(text)}') THEN '{label}' END"
        for label, text in license_scan.TEMPLATES
    ]
    tidy = "list_sort(list_distinct(list_filter([{}], lambda x: x IS NOT NULL)))"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
WITH worded AS (
    SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{word}') AS w FROM documents
), spaced AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS joined FROM worded),
found AS (
    SELECT doc_id, len(w) AS n_words, flatten([{", ".join(spots)}]) AS spots,
           {tidy.format(", ".join(base))} AS base, {tidy.format(", ".join(own))} AS own
    FROM spaced
)
SELECT doc_id, n_words, len(spots) AS n_base, list_min(spots)::BIGINT AS first_word, list_max(spots)::BIGINT AS last_word,
       array_to_string(base, ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base, own))), ',') AS labels,
       CASE WHEN len(own) > 0 THEN 1.0 WHEN len(base) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM found
"""


LICENSES = _licenses()

_CAP = "3.0e0 * source_size"

# Sources that are full by cap / weight, ascending: a source is full if its cap is below its share of what those before it leave.
MIXED_SOURCES = rf"""
WITH quality AS (
    SELECT doc_id, avg(quality) AS share FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id
), sized AS (
    SELECT d.doc_id, d.source, len({SPACE_WORDS.format("coalesce(d.text, '')")})::BIGINT AS size,
           -ln((('0x' || substr(md5('42:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5e0)
               / 4503599627370496.0e0) / CASE WHEN share > 0.5 THEN 2.0e0 WHEN share < 0.5 THEN 0.5e0 ELSE 1.0e0 END AS key
    FROM documents d LEFT JOIN quality ON d.doc_id = quality.doc_id
), sources AS (
    SELECT source, source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight
    FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source)
), levels AS (
    SELECT *, sum(source_size) OVER () - coalesce(sum({_CAP}) OVER before, 0e0) AS rest,
           sum(weight) OVER () - coalesce(sum(weight) OVER before, 0e0) AS open
    FROM sources
    WINDOW before AS (ORDER BY {_CAP} / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), full_ones AS (
    SELECT *, {_CAP} * open < weight * rest AS is_full FROM levels
), shares AS (
    SELECT source, source_size, CASE WHEN is_full THEN {_CAP} ELSE
        weight * (SELECT sum(source_size) - coalesce(sum({_CAP}) FILTER (is_full), 0e0) FROM full_ones)
        / (SELECT sum(weight) FILTER (NOT is_full) FROM full_ones) END AS target
    FROM full_ones
), wanted AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM shares
), units AS (
    SELECT source, key, doc_id, sum(size) AS unit FROM sized GROUP BY source, key, doc_id
), summed AS (
    SELECT *, sum(unit) OVER (
        PARTITION BY source ORDER BY key, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
    FROM units
), taken AS (
    SELECT u.source, u.doc_id, w.source_size, w.target,
           w.epochs + (2 * u.upto - u.unit < 2 * (w.target - w.epochs * w.source_size))::BIGINT AS copies
    FROM summed u JOIN wanted w ON u.source IS NOT DISTINCT FROM w.source
)
SELECT s.doc_id, s.size, t.source_size, t.target, (t.copies * s.size)::BIGINT AS taken
FROM sized s JOIN taken t ON s.source IS NOT DISTINCT FROM t.source AND s.doc_id IS NOT DISTINCT FROM t.doc_id
"""

MIDDLES = r"""
WITH tokens AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS key,
           regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w
    FROM documents
), drawn AS (
    SELECT *, len(w) AS n, ('0x' || substr(key, 1, 8))::BIGINT AS h1, ('0x' || substr(key, 9, 8))::BIGINT AS h2,
           ('0x' || substr(key, 17, 8))::BIGINT AS h3, ('0x' || substr(key, 25, 8))::BIGINT AS h4
    FROM tokens
), formed AS (
    SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                        OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
           least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b
    FROM drawn
), parts AS (
    SELECT doc_id, n, form, text, array_to_string(w[1:a], '') AS prefix, array_to_string(w[a + 1:b], '') AS middle,
           array_to_string(w[b + 1:], '') AS suffix
    FROM formed
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""

# CRC-32, bit by bit: the reflected polynomial is a fixed value.
_CRC32 = """xor(list_reduce(list_transform(string_split({}, ''), lambda x: ascii(x)::BIGINT), lambda crc, byte:
    list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[],
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(crc, byte)), 4294967295), 4294967295)"""

CONVERSATION_TRIE = f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), short AS (
    SELECT conv_id, turn, substr(sha256(length(role)::VARCHAR || ':' || role || text), 1, 32) AS digest, length(text) AS chars
    FROM turns
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS place FROM short
), ids AS (
    SELECT conv_id, conv_id - conv_id % 100 AS head, {_CRC32.format("conv_id::VARCHAR")} % 6 AS shared
    FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
    SELECT conv_id, place, digest, chars FROM placed JOIN ids USING (conv_id) WHERE place > shared
    UNION ALL
    SELECT ids.conv_id, place, digest, chars FROM ids JOIN placed ON placed.conv_id = ids.head WHERE place <= shared
), chained AS (
    SELECT conv_id, chars, row_number() OVER turn AS d, md5(string_agg(digest, '') OVER turn) AS node
    FROM rebuilt WINDOW turn AS (PARTITION BY conv_id ORDER BY place)
), prefixes AS (
    SELECT conv_id, chars, d, node, lag(node, 1, '') OVER (PARTITION BY conv_id ORDER BY d) AS parent FROM chained
    UNION ALL SELECT conv_id, 0, 0, '', NULL FROM ids
), nodes AS (
    SELECT node, any_value(parent) AS parent, any_value(d) AS depth, any_value(chars) AS chars, min(conv_id) AS conv_id,
           count(*) AS n_convs
    FROM prefixes GROUP BY node
), children AS (SELECT parent AS node, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
counted AS (SELECT nodes.*, coalesce(children.n, 0) AS n_children FROM nodes LEFT JOIN children USING (node)),
below AS (
    SELECT above.node, count(*) FILTER (x.n_children = 0) AS n_leaves, sum((x.n_convs - 1) * x.chars)::BIGINT AS saved
    FROM counted x JOIN prefixes above ON above.conv_id = x.conv_id AND above.d <= x.depth GROUP BY above.node
), last AS (
    SELECT arg_max(node, d) AS node, conv_id FROM prefixes GROUP BY conv_id
), ends AS (SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS digest FROM last GROUP BY node)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved AS saved_tokens,
       coalesce(digest, sha256('')) AS ends_sha256
FROM counted n JOIN below USING (node) LEFT JOIN nodes p ON p.node = n.parent LEFT JOIN ends ON ends.node = n.node
"""
