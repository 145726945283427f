"""The registered queries of this subpackage: thin calls of its operators on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, divergence, filters, jaccard, langid, lm, matroska, mixing, pii, secretscan, sstable, urls, vectors
from .common import stored, table

#: The pseudonyms of the registered query; a production run passes a secret of its own.
PII_KEY = "registered-query-key"


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "copies")


def op2_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.tiktoken"), _pattern(), from_files=True)


def op4_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.read_back(stored(matroska.media(table(spark, sf_dir, "documents")), "media"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents"), PII_KEY).select("doc_id", "text", F.size("pii").cast("long").alias("n_replaced"), F.array_join("pii", ",").alias("kinds"))


def op6_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.shard_round_trip(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _pattern())


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network = langid.train(docs, ~langid.held_out())
    return langid.identify(docs.select("doc_id", "text"), network).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), langid.held_out(parts=5, part=1), order=3, from_files=True)


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.digests(secretscan.scan(table(spark, sf_dir, "documents")))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_jaccard, op2_vectors, op3_bpe, op4_matroska, op5_pii, op6_sstable, op7_mixing, op8_urls, op9_langid, op10_lm, op11_secrets, op12_divergence, op13_filters)}


def oracle_sql() -> dict[str, str]:
    return {"op1_jaccard": jaccard.oracle(), "op2_vectors": vectors.oracle(), "op8_urls": urls.oracle(), "op12_divergence": divergence.oracle(), "op13_filters": filters.oracle()}
