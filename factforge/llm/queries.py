"""The registered queries of the training-data operators: thin derivations of each contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factforge.llm.common import table

#: Folder of public tokenizer files; a parameter of every operator that reads one.
WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factforge.llm.bpe import bpe_round_trip

    out = bpe_round_trip(table(spark, sf_dir, "documents"), tokenizer(WORD_BPE))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factforge.llm.line_dedup import drop_repeated_lines

    out = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
frequent AS (SELECT key, max(doc_id) AS keep FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT k.*, coalesce(k.doc_id <> f.keep, false) AS lost FROM keyed k LEFT JOIN frequent f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factforge.llm.html_text import main_text, train_labeller

    pages = table(spark, sf_dir, "pages")
    return main_text(pages, train_labeller(pages))


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factforge.llm.fingerprint import fingerprints

    out = fingerprints(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factforge.llm.mixing import mix_counts

    return mix_counts(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factforge.llm.quality import fit_quality, held_out, score_quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels"))).select(F.col("row.doc_id").alias("doc_id"), "score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factforge.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, w.b FROM reach r JOIN ways w ON r.other = w.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factforge.llm.suffix_dedup import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op8_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factforge.llm.line_quality import judge

    return judge(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS text, source FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
windows AS (SELECT uid, i, (ws[i], ws[i + 1], ws[i + 2]) AS win FROM (SELECT uid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
many AS (SELECT uid, i, count(*) OVER (PARTITION BY uid, win) AS n FROM windows),
covered AS (SELECT uid, count(DISTINCT i + k) AS n FROM many, (VALUES (0), (1), (2)) AS v(k) WHERE n > 1 GROUP BY uid),
lines AS (SELECT uid, source, text, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws
  FROM (SELECT uid, source, text, unnest(string_split(text, chr(10))) AS line FROM d)),
full_lines AS (SELECT uid, source, text, line, len(ws) AS n, translate(array_to_string(ws, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines WHERE len(ws) > 0),
dups AS (SELECT uid, count(*) - count(DISTINCT line) AS n FROM full_lines GROUP BY uid),
hosts AS (SELECT source, greatest(5, 0.02::DOUBLE * count(*)) AS most FROM d GROUP BY source),
freq AS (SELECT source, key, count(DISTINCT uid) AS n FROM full_lines GROUP BY source, key),
common AS (SELECT f.source, f.key FROM freq f JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source WHERE f.n > h.most),
gone AS (SELECT uid, sum(n) AS n FROM full_lines l WHERE EXISTS (SELECT 1 FROM common c WHERE c.key = l.key AND c.source IS NOT DISTINCT FROM l.source) GROUP BY uid),
s AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
  coalesce(dups.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_removed_words
  FROM w LEFT JOIN covered USING (uid) LEFT JOIN dups USING (uid) LEFT JOIN gone USING (uid))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_removed_words >= 0.3::DOUBLE * n_words AS kept FROM s
"""


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factforge.llm.token_files import token_files

    out = token_files(table(spark, sf_dir, "documents"), tokenizer(BYTE_BPE))
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factforge.llm.prefix_trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations")).drop("enter_at", "exit_at")


OP11_SQL = r"""
WITH base AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 30)) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
seqs AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY pos) AS s FROM base GROUP BY conv_id),
crc AS (
  SELECT conv_id, s, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) % 4 AS h FROM seqs),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(list_slice(d.s, 1, c.h), []), list_slice(c.s, c.h + 1, len(c.s))) AS s
  FROM crc c LEFT JOIN seqs d ON d.conv_id = c.conv_id - c.conv_id % 20),
prefix AS (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS depth FROM rebuilt),
nodes AS (
  SELECT list_slice(s, 1, depth) AS p, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = len(s)), '') AS ends
  FROM prefix GROUP BY list_slice(s, 1, depth), depth),
children AS (SELECT list_slice(p, 1, depth - 1) AS p, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
known AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(p[depth].text, '[^ 	-
]+')) END AS saved
  FROM nodes n LEFT JOIN children c USING (p)),
up AS (SELECT n_children, saved, list_slice(p, 1, k) AS p FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM known)),
sums AS (SELECT p, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM up GROUP BY p)
SELECT k.conv_id, k.depth, a.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves, s.saved_tokens, sha256(k.ends) AS ends_sha256
FROM known k JOIN sums s USING (p) LEFT JOIN nodes a ON k.depth > 0 AND a.p = list_slice(k.p, 1, k.depth - 1)
"""


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factforge.llm.packing import pack_documents

    out = pack_documents(table(spark, sf_dir, "documents"), tokenizer(BYTE_BPE))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factforge.llm.hard_negatives import hard_negatives

    moved = lambda vec_id, label: F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(table(spark, sf_dir, "embeddings"), label=moved)


OP13_SQL = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.other))::INTEGER AS rank, n.other AS negative_id, positive_score, n.score AS negative_score
FROM positives p JOIN pairs n USING (anchor_id) WHERE NOT n.same AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score QUALIFY rank <= 3
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_html": op2_html,
    "op3_fingerprint": op3_fingerprint,
    "op4_mixing": op4_mixing,
    "op5_quality": op5_quality,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_line_quality": op8_line_quality,
    "op9_token_files": op9_token_files,
    "op10_near_dedup": op10_near_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_packing": op12_packing,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLE_SQL: dict[str, str] = {"op7_line_dedup": OP7_SQL, "op8_line_quality": OP8_SQL, "op10_near_dedup": OP10_SQL, "op11_prefix_trie": OP11_SQL, "op13_hard_negatives": OP13_SQL}
