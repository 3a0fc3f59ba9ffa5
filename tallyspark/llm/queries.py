"""The registered queries of this subpackage, one for each dealt operator.

Each one runs its operator with production parameters over whole tables.
Vocabulary files come from the installed package of public tokenizers.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import (distinct_words, grammar, line_dedup, lz_fingerprint, packing, prefix_trie, quality, sentencepiece_backend, sharding, simhash,
                            token_alignment, token_counts, toxicity)
from tallyspark.llm.common import documents, labels
from tallyspark.session import checkpoint_dir

BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
MULTI_BPE = "byte_bpe_multi_50k.tiktoken"
#: Shards of the placement query, and its table's size: a prime over a hundred times as large.
SHARDS = [f"shard-{i:03d}" for i in range(24)]
SLOTS = 4093


def held_out() -> F.Column:
    """Whether a row is kept from learning; a row without an id is not (no label can meet it)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, their parity with the SentencePiece library, and whether they decode to the text."""
    return sentencepiece_backend.digests(documents(spark, sf_dir), public_tokenizers.path(PIECES))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document, and its shard once the last shard is gone."""
    docs = documents(spark, sf_dir).select("doc_id")
    placed = sharding.place(docs, "doc_id", SHARDS, SLOTS)
    return sharding.place(placed, "doc_id", SHARDS[:-1], SLOTS, "shard_after_loss")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the lines that have an earlier near copy anywhere."""
    return line_dedup.dedup_report(documents(spark, sf_dir))


def op4_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase fingerprints of every text and of its edited text, and their likeness."""
    return lz_fingerprint.edited_fingerprints(documents(spark, sf_dir))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every text, learnt from the rows that are not held out."""
    out, model = toxicity.fit_scored(documents(spark, sf_dir), labels(spark, sf_dir), allowed=~held_out(), keep=["doc_id", "lang"])
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= toxicity.CUTOFF).cast("int").alias("predicted"),
                      (F.col("score") >= toxicity.threshold(model, F.col("lang"))).alias("beyond_language_threshold"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text."""
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_groups(documents(spark, sf_dir))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality features and verdict of every document."""
    rated = quality.rate(documents(spark, sf_dir), labels(spark, sf_dir))
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                        "stratum", F.concat_ws(",", "beyond").alias("beyond"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in packed sequences."""
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE))


def op10_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, read back from grammar-compressed shards."""
    folder = f"{checkpoint_dir(spark)}/shards-{uuid.uuid4().hex}"
    grammar.write_shards(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE), folder)
    return grammar.read_shards(spark, folder)


def op11_distinct_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text from distinct words encoded once, and the bytes they decode to, as digests."""
    path = public_tokenizers.path(MULTI_BPE)
    return distinct_words.encode_words(documents(spark, sf_dir), path, public_tokenizers.PATTERN, decoded=True).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all conversations, each started like the conversation of its twenty."""
    turns = prefix_trie.turn_sequences(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4
    return prefix_trie.prefix_trie(prefix_trie.with_shared_starts(turns, 20, 3, shared)).nodes_with_digests()


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of both tokenizers' tokens in every text."""
    return token_alignment.align(documents(spark, sf_dir), public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECES))[0]


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_sharding, op3_line_dedup, op4_lz_fingerprint, op5_toxicity,
                                   op6_token_counts, op7_simhash, op8_quality, op9_packing, op10_grammar, op11_distinct_words,
                                   op12_prefix_trie, op13_token_alignment)}

#: Fills both tables turn by turn, then looks every document up.
OP2_SQL = """
WITH RECURSIVE pref AS (
  SELECT i, name, (('0x' || substr(md5(name), 1, 16))::UBIGINT % 4093)::BIGINT AS first_slot,
         (('0x' || substr(md5(name), 17, 16))::UBIGINT % 4092)::BIGINT + 1 AS skip
  FROM (SELECT i, 'shard-' || lpad(i::VARCHAR, 3, '0') AS name FROM range(24) t(i))),
orders AS (
  SELECT i, list(((first_slot + j * skip) % 4093)::SMALLINT ORDER BY j) AS slots FROM pref, range(4093) r(j) GROUP BY i),
fill AS (
  SELECT n, 0::BIGINT AS turn, list_transform(range(4093), lambda x: -1::TINYINT) AS owner FROM (VALUES (24), (23)) v(n)
  UNION ALL
  SELECT n, turn + 1, list_concat(list_concat(owner[1:slot], [(turn % n)::TINYINT]), owner[slot + 2:])
  FROM (SELECT f.n, f.turn, f.owner, list_filter(o.slots, lambda s: f.owner[s + 1] < 0)[1] AS slot
        FROM fill f JOIN orders o ON o.i = f.turn % f.n WHERE f.turn < 4093)),
tables AS (
  SELECT n, slot - 1 AS slot, owner[slot] AS shard FROM fill, range(1, 4094) r(slot) WHERE turn = 4093),
keys AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % 4093 AS slot FROM documents)
SELECT k.doc_id, p.name AS shard, q.name AS shard_after_loss
FROM keys k JOIN tables a ON a.slot = k.slot AND a.n = 24 JOIN tables b ON b.slot = k.slot AND b.n = 23
JOIN pref p ON p.i = a.shard JOIN pref q ON q.i = b.shard
"""

ORACLE_SQL = {"op2_sharding": OP2_SQL}
