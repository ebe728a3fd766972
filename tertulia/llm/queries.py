"""The operators as named queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tertulia.llm import sql
from tertulia.llm.bpe import encoded, read_ranks, vocabulary
from tertulia.llm.classify import fit_language, fit_quality, with_language, with_quality
from tertulia.llm.neardup import near_duplicates
from tertulia.llm.contamination import with_hits
from tertulia.llm.shards import sharded
from tertulia.llm.lattice import read_pieces, scored
from tertulia.llm.tries import prefix_trie
from tertulia.llm.toxicity import fit_toxicity, with_toxicity
from tertulia.llm.neighbours import nearest
from tertulia.llm.packing import file_encoder, packed
from tertulia.llm.phrases import collocations
from tertulia.llm.lengths import length_table, with_token_count
from tertulia.llm.store import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def multilingual_bpe() -> dict:
    """The vocabulary of the public rank file that the BPE queries use."""
    import public_tokenizers

    return vocabulary(
        read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")),
        public_tokenizers.PATTERN,
    )


def token_digests(docs: DataFrame) -> DataFrame:
    """Number of tokens, and digests of the ids and of the bytes they decode to."""
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded(docs.select("doc_id", "text"), multilingual_bpe()).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op2_bpe")
def bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded by byte-level BPE."""
    return token_digests(table(spark, folder, "documents"))


@query("op3_quality")
def quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document by a byte network that learned from four folds of five."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").where(fold(F.col("doc_id"), 5) != 0)
    return with_quality(docs, fit_quality(docs, labels)).select(
        "doc_id",
        (fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@query("op8_language")
def language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document by a byte network that learned from three folds of four."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    fitted = fit_language(docs.where(fold(F.col("doc_id"), 4) != 2))
    return with_language(docs.drop("lang"), fitted).select(
        "doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score"
    )


@query("op7_minhash", sql.NEAR_DUPLICATES)
def minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate documents: components of links at 85 in 100 shared shingles."""
    return near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))


@query("op4_contamination", sql.CONTAMINATION)
def contamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items that documents hold at 80 in 100 of their shingles."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    marked = with_hits(docs, table(spark, folder, "benchmark")).select(
        "doc_id", F.explode("hits").alias("hit")
    )
    return marked.select(
        "doc_id",
        "hit.item_id",
        "hit.item_shingles",
        "hit.shared",
        (F.col("hit.shared") / F.col("hit.item_shingles")).alias("containment"),
    )


SHARDS = 24


@query("op1_sharding")
def sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Every document in one of 24 shards of near equal size; equal texts stay together."""
    return sharded(table(spark, folder, "documents"), SHARDS).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op6_lattice")
def lattice(spark: SparkSession, folder: str) -> DataFrame:
    """Log10 probability of every document over all its segmentations into pieces."""
    import public_tokenizers

    docs = table(spark, folder, "documents").select("doc_id", "text")
    pieces = read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    training = fold(F.col("doc_id"), 10) != 0
    return scored(docs, training, pieces).select(
        "doc_id",
        (fold(F.col("doc_id"), 10) == 0).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
    )


@query("op9_toxicity")
def toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document by trees that learned from four folds of five."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels").where(fold(F.col("doc_id"), 5) != 0)
    return with_toxicity(docs, fit_toxicity(docs, labels)).select(
        "doc_id",
        (fold(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query("op10_neighbours")
def neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors of every vector whose id is divisible by 100."""
    vectors = table(spark, folder, "embeddings")
    return nearest(vectors, F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)))


@query("op5_token_counts")
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, tokens and truncated tokens at every encoded length."""
    docs = table(spark, folder, "documents").select("text")
    return length_table(with_token_count(docs, multilingual_bpe()))


@query("op11_collocations", sql.COLLOCATIONS)
def phrases(spark: SparkSession, folder: str) -> DataFrame:
    """The first 2000 collocations of each language."""
    return collocations(table(spark, folder, "documents").select("text", "lang"))


@query("op12_prefix_trie", sql.PREFIX_TRIE)
def trie(spark: SparkSession, folder: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return prefix_trie(table(spark, folder, "conversations"))


def word_encoder():
    """In a worker: the encoder of the public tokenizer file of the packing query."""
    import public_tokenizers

    return file_encoder(public_tokenizers.path("word_bpe_49k.json"))


@query("op13_packing")
def packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's ids in pieces of sequences of 4096 tokens."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return packed(docs, word_encoder).select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )
