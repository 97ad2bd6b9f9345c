"""One query per operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from salesmix.llm import (bpe, collocations, embedding_dedup, exact_dedup, harmonic_packing, html_text, line_dedup, minhash_dedup,
                          packing, prefix_trie, suffix_dedup, token_files, toxicity)
from salesmix.llm.common import table, text_or_empty
from salesmix.session import work_dir

TOXIC_FROM = 0.3
VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.json"


def held_out(doc_id):
    """Documents that no training may use."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def toxicity_model(spark, sf_dir):
    """Fitted on the labelled documents that are not held out."""
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id")))
    return toxicity.fit(table(spark, sf_dir, "documents"), labels)


def op7_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op1_token_files(spark, sf_dir):
    folder = work_dir(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), folder)
    return token_files.document_checks(spark, folder)


def op2_minhash_dedup(spark, sf_dir):
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_bpe(spark, sf_dir):
    return bpe.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op4_suffix_dedup(spark, sf_dir):
    return suffix_dedup.removed_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op5_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.without_repeated_lines(docs, counts=True).select(
        "doc_id", "n_lines", "n_removed", "n_near", F.sha2(text_or_empty("text"), 256).alias("kept_sha256"))


def op6_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op8_html_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return html_text.main_text(pages, html_text.fit(pages))


def op9_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark, sf_dir):
    scored = toxicity.score(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op11_conversation_trie(spark, sf_dir):
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations")).drop("tour_place", "n_nodes", "turn_sha256")


def op12_harmonic_packing(spark, sf_dir):
    pieces = harmonic_packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_VOCABULARY))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


REGISTRY = {f.__name__: f for f in (
    op1_token_files, op2_minhash_dedup, op3_bpe, op4_suffix_dedup, op5_line_dedup, op6_best_fit_packing, op7_exact_dedup,
    op8_html_text, op9_embedding_dedup, op10_toxicity, op11_conversation_trie,
    op12_harmonic_packing, op13_collocations)}

# Lines within one edit: lines that share a half, compared after their common beginning.
LINES_SQL = """
    all_lines AS (
        SELECT doc_id, text, unnest(range(len(parts))) AS n, unnest(parts) AS raw
        FROM (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM {docs})),
    lines AS (SELECT doc_id, n, raw, trim(raw) AS line, doc_id * 4294967296 + n AS place FROM all_lines),
    firsts AS (SELECT line, length(line) AS size, min(place) AS first FROM lines
               WHERE length(line) >= 10 GROUP BY line),
    halves AS (
        SELECT line, size, first, base, 'head' AS side, left(line, base // 2) AS part
        FROM firsts, LATERAL (SELECT unnest([size, size - 1]) AS base)
        UNION ALL
        SELECT line, size, first, base, 'tail', right(line, base - base // 2)
        FROM firsts, LATERAL (SELECT unnest([size, size - 1]) AS base)),
    pairs AS (
        SELECT DISTINCT a.line, a.size, b.line AS other, b.size AS other_size
        FROM halves a JOIN halves b ON a.base = b.base AND a.side = b.side AND a.part = b.part
        WHERE b.first < a.first AND abs(a.size - b.size) <= 1),
    common AS (
        SELECT *, len(list_filter(range(1, least(size, other_size) + 1),
                                  lambda i: left(line, i) = left(other, i))) AS same FROM pairs),
    near AS (
        SELECT DISTINCT line FROM common WHERE CASE
            WHEN size = other_size THEN substr(line, same + 2) = substr(other, same + 2)
            WHEN size < other_size THEN substr(line, same + 1) = substr(other, same + 2)
            ELSE substr(line, same + 2) = substr(other, same + 1) END),
    judged AS (
        SELECT l.doc_id, l.n, l.raw, f.line IS NOT NULL AND l.place <> f.first AS again,
               x.line IS NOT NULL AS near
        FROM lines l LEFT JOIN firsts f ON l.line = f.line LEFT JOIN near x ON l.line = x.line)
"""

# CRC-32 a byte at a time with its table of 256 values; each node's subtree from the paths of its smallest members.
TRIE_SQL = """
    WITH crc_table AS (
        SELECT list(v ORDER BY i) AS t FROM (
            SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x:
                CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(i))),
    turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        WHERE conv_id IS NOT NULL),
    digests AS (SELECT conv_id, turn, role, text, sha256(length(role) || '|' || role || '|' || text) AS d FROM turns),
    own AS (
        SELECT conv_id, d, len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS words,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, d) - 1 AS pos FROM digests),
    convs AS (
        SELECT conv_id, xor(list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)),
                                        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 4 AS h
        FROM (SELECT DISTINCT conv_id FROM own), crc_table),
    taken AS (
        SELECT c.conv_id, o.pos, o.d, o.words FROM convs c
        JOIN own o ON o.conv_id = c.conv_id - c.conv_id % 20 AND o.pos < c.h),
    shared AS (SELECT conv_id, count(*) AS k FROM taken GROUP BY conv_id),
    rebuilt AS (
        SELECT * FROM taken UNION ALL
        SELECT o.conv_id, o.pos - c.h + coalesce(s.k, 0), o.d, o.words
        FROM own o JOIN convs c USING (conv_id) LEFT JOIN shared s USING (conv_id) WHERE o.pos >= c.h),
    paths AS (
        SELECT conv_id, 0 AS depth, '' AS prefix, NULL AS parent, 0 AS words FROM convs UNION ALL
        SELECT conv_id, pos + 1, string_agg(d, '') OVER p, coalesce(string_agg(d, '') OVER (
            PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), ''), words
        FROM rebuilt WINDOW p AS (PARTITION BY conv_id ORDER BY pos)),
    nodes AS (
        SELECT prefix, min(parent) AS parent, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words
        FROM paths GROUP BY prefix),
    kids AS (SELECT parent AS prefix, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
    subtrees AS (
        SELECT p.prefix, count(*) FILTER (k.n_children IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved_tokens
        FROM nodes n LEFT JOIN kids k USING (prefix) JOIN paths p ON p.conv_id = n.conv_id AND p.depth <= n.depth
        GROUP BY p.prefix),
    ends AS (
        SELECT prefix, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
        FROM (SELECT conv_id, arg_max(prefix, depth) AS prefix FROM paths GROUP BY conv_id) GROUP BY prefix)
    SELECT n.conv_id, n.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children,
           s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
    FROM nodes n JOIN subtrees s USING (prefix) LEFT JOIN kids k USING (prefix) LEFT JOIN ends e USING (prefix)
    LEFT JOIN nodes up ON up.prefix = n.parent
"""

COLLOCATIONS_SQL = """
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
        FROM documents),
    words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM pieces),
    sizes AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
    found AS (
        SELECT lang, k, phrase, count(*) AS a FROM (
            SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
            FROM words, range(1, 6) AS r(k)) GROUP BY lang, k, phrase HAVING count(*) >= 100),
    cuts AS (
        SELECT c.lang, c.phrase, c.k, c.a, n, x.a AS l, y.a AS r, j,
               (1000::HUGEINT * c.a * n) // (x.a::HUGEINT * y.a) AS score
        FROM found c JOIN sizes USING (lang), range(1, 5) AS s(j), found x, found y
        WHERE j < c.k AND x.lang = c.lang AND x.phrase = array_to_string(string_split(c.phrase, ' ')[:j], ' ')
          AND y.lang = c.lang AND y.phrase = array_to_string(string_split(c.phrase, ' ')[j + 1:], ' ')),
    best AS (
        SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
    inside AS (
        SELECT lang, phrase, max(a) AS most FROM (
            SELECT f.lang, f.a, unnest(list_transform(range(1, f.k - m + 2),
                lambda i: array_to_string(string_split(f.phrase, ' ')[i:i + m - 1], ' '))) AS phrase
            FROM found f, range(2, 5) AS r(m) WHERE m < f.k) GROUP BY lang, phrase),
    ranked AS (
        SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
        FROM best b LEFT JOIN inside i USING (lang, phrase) WHERE coalesce(i.most, 0) < b.a)
    SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""

ORACLE = {
    "op11_conversation_trie": TRIE_SQL,
    "op13_collocations": COLLOCATIONS_SQL,
    "op5_line_dedup": "WITH " + LINES_SQL.format(docs="documents") + """
        SELECT doc_id, count(n) AS n_lines, count(*) FILTER (again OR near) AS n_removed,
               count(*) FILTER (near AND NOT again) AS n_near,
               sha256(coalesce(string_agg(raw, chr(10) ORDER BY n) FILTER (NOT again AND NOT near), ''))
                   AS kept_sha256
        FROM judged GROUP BY doc_id""",
    "op7_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(text) AS text_sha256
        FROM d WINDOW same AS (PARTITION BY text)""",
}
