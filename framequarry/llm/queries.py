"""Queries of this subpackage, by name, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapters, bpe, chroma, mixing, oracle, prefix_trie, quality, resharding, simhash, spelling, substring_dedup, suffix_dedup, token_counts, token_store, tool_calls
from .storage import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Where the file of a public tokenizer lies on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"), F.size("spans").alias("n_spans"))


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.rules(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


@query
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"))


@query
def op1_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mixed(docs)


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query
def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = token_store.write(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return token_store.contents(shards)


@query
def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return tool_calls.linked(adapters.calls_of(turns), adapters.results_of(turns), adapters.SCHEMAS)


@query
def op9_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = stored(chroma.fingerprints(adapters.audio_of(table(spark, sf_dir, "embeddings"))), "prints")
    found = chroma.aligned(prints, prints.where("id % 20 = 0").select("id")).select(F.lit("match").alias("kind"), "*")
    members = chroma.classes(prints).select(F.lit("member").alias("kind"), "id", "class_id")
    return found.unionByName(members, allowMissingColumns=True)


@query
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(*prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


@query
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.vocabulary(table(spark, sf_dir, "documents"))
    return spelling.forms(words)


@query
def op13_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    old = resharding.laid(docs, F.pmod(F.crc32(F.encode(F.coalesce("source", F.lit("")), "UTF-8")), F.lit(5)), 5)
    new = resharding.resharded(old, 8)
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    grown = F.lit(None).cast("int").alias("grown_shard")
    return resharding.contents(new).select("doc_id", F.col("__size").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("bytes").alias("law"), F.col("__shard").alias("shard"), F.col("__slot").alias("slot"), grown)


SQL["op2_quality_rules"] = oracle.QUALITY
SQL["op5_substring_dedup"] = oracle.SUBSTRING
SQL["op11_prefix_trie"] = oracle.PREFIX_TRIE
SQL["op12_spelling"] = oracle.SPELLING
