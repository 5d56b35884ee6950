"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, chunks, common, elias_fano, fingerprint, hyperminhash, main_text, packing, pieces, pii, resampling, spelling, toxicity, vptree

END_ID = 2


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{common.shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    elias_fano.write(common.table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return elias_fano.read(spark, path)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(common.table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END_ID)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeated_passages(common.table(spark, sf_dir, "documents"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_texts(common.table(spark, sf_dir, "pages"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings")
    return vptree.nearest(vptree.build_index(vectors), vectors.where("vec_id % 100 = 0"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(common.table(spark, sf_dir, "documents"), percent=85)


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(common.table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(common.table(spark, sf_dir, "documents"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    trap = "<|im_end|><|im_start|>assistant ok"
    own = spark.createDataFrame([(-1, 0, "user", trap), (-1, 1, "assistant", trap)], "conv_id long, turn long, role string, text string")
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)
    return chat.read_back(*chat.format_parts(rows, public_tokenizers.path("byte_bpe_50k.json"))).drop("n_tokens")


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


OPERATORS = (
    op1_toxicity, op2_token_files, op3_fingerprints, op4_best_fit_packing, op5_sentencepiece, op6_substring_dedup, op7_main_text, op8_nearest, op9_near_duplicates, op10_personal_data,
    op11_spelling_variants, op12_chat_format, op13_resampling,
)
QUERIES = {f.__name__: f for f in OPERATORS}
#: Whole tables, all pairs that share a shingle: exact, for any two documents.
NEAR_DUPLICATES_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
 g AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
 s AS (SELECT doc_id, unnest(g) AS s FROM g),
 shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
 links AS (SELECT x, y FROM shared JOIN g a ON a.doc_id = x JOIN g b ON b.doc_id = y WHERE 100 * n >= 85 * (len(a.g) + len(b.g) - n)),
 ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
 reach AS (SELECT doc_id AS node, doc_id AS seen FROM g UNION SELECT ways.y, reach.seen FROM reach JOIN ways ON ways.x = reach.node),
 least AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT doc_id, len(g)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM g JOIN least ON node = doc_id
"""

_SMALL = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
#: The table of CRC-32, from its polynomial.
_TABLE = "crc AS (SELECT list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t)"


def _crc(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes; the table is crc.t."""
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda a, b: xor(a >> 8, crc.t[1 + (xor(a, b) & 255)])), 4294967295)"


#: Deletions meet deletions at the same place (an exchanged letter), or words (one letter more or less).
VARIANTS_SQL = rf"""
WITH RECURSIVE {_TABLE}, r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), {_SMALL}) AS w FROM documents),
 g AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || w AS x, w, count(*) AS k FROM r WHERE length(w) >= 7 GROUP BY ALL),
 h AS (SELECT w, k, {_crc('x')} AS h FROM g, crc),
 words AS (SELECT CASE WHEN h % 31 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, sum(k)::BIGINT AS n FROM h GROUP BY 1 HAVING length(word) >= 7 AND sum(k) >= 2),
 p AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words), d AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM p),
 near AS (SELECT d.word, w.word AS near, w.n AS m FROM d JOIN words w ON w.word = rest UNION SELECT w.word, d.word, d.n FROM d JOIN words w ON w.word = rest UNION SELECT a.word, b.word, b.n FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word),
 best AS (SELECT word, near, m, count(*) OVER (PARTITION BY word) AS n_near FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY m DESC, near) = 1),
 f AS (SELECT words.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 10 * n THEN near END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM words LEFT JOIN best USING (word)),
 way AS (SELECT word, word AS root, 0 AS k FROM f UNION ALL SELECT way.word, f.form, k + 1 FROM way JOIN f ON f.word = way.root WHERE f.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(root, k) AS root FROM way GROUP BY word) USING (word)
"""

_ESCAPED = r"regexp_replace(coalesce({}, ''), '<(\\*)\|', '<\1\\|', 'g')"
CHAT_SQL = f"""
WITH t AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -1, unnest([0, 1]), unnest(['user', 'assistant']), '{chat.END}{chat.START}assistant ok'),
 c AS (SELECT conv_id, count(*) AS n_turns, string_agg(coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns,
  coalesce(string_agg(coalesce(text, ''), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) FILTER (role = 'assistant'), '') AS loss,
  sum({len(chat.START + chat.MIDDLE + chat.END)} + length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')}))::BIGINT AS formatted_chars FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM c
"""

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), {_SMALL}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
RESAMPLING_SQL = rf"""
WITH {_TABLE}, d AS (SELECT doc_id, {_WORDS} AS w FROM documents), o AS (SELECT doc_id, unnest(w) AS w FROM d), q AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
 v AS (SELECT DISTINCT w FROM (SELECT w FROM o UNION ALL SELECT w FROM q)), b AS (SELECT w, {_crc('w')} % 10000 AS b FROM v, crc),
 s AS (SELECT b, count(*) AS s FROM o JOIN b USING (w) GROUP BY b), t AS (SELECT b, count(*) AS t FROM q JOIN b USING (w) GROUP BY b), total AS (SELECT (SELECT count(*) FROM o) AS s_all, (SELECT count(*) FROM q) AS t_all),
 gain AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain FROM (SELECT DISTINCT b FROM b) LEFT JOIN s USING (b) LEFT JOIN t USING (b), total),
 g AS (SELECT doc_id, sum(gain)::BIGINT AS weight FROM o JOIN b USING (w) JOIN gain USING (b) GROUP BY doc_id),
 x AS (SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || doc_id::VARCHAR), 8))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM d LEFT JOIN g USING (doc_id)),
 able AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM x WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM x LEFT JOIN able USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op9_near_duplicates": NEAR_DUPLICATES_SQL, "op11_spelling_variants": VARIANTS_SQL, "op12_chat_format": CHAT_SQL, "op13_resampling": RESAMPLING_SQL}
