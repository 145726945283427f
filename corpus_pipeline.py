"""The corpus pipeline: from raw documents to token ids.

Every stage works on all that the one before kept, and all but the last return the columns
of ``documents``. Of rows with one id and text one goes on after the second stage. Nulls in any column pass; a document with a null
or empty text has no language and goes in the first stage. Empty input gives empty output.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chainloom.llm import bpe, jaccard, langid, mixing, pii
from chainloom.llm.common import screened, stored, table, whole
from chainloom.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A language is rejected if its score is less than this part of the way from equal scores to 1.
LEAST_LEAD = 1 / 15
#: Bytes of texts that a task encodes at once: less than by itself, as executors hold what earlier stages took.
CHUNK = 4_000_000
#: The key of the pseudonyms; a production run sets its own.
PII_KEY = os.environ.get("PIPELINE_PII_KEY", "pipeline-key")


def _stage(f):
    """A stage whose executors have this package."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return f(ship(spark), docs, sf_dir)

    return run


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labels know; texts without letters, unlike all learned ones or with a low score go."""
    network, familiar = langid.learn(docs, F.lit(True))
    found = langid.identify(docs, network, familiar=familiar)
    equal = 1 / len(network.languages) if network else 1.0
    return found.where((F.col("lang_pred") != langid.NONE) & (F.col("score") >= equal + (1 - equal) * LEAST_LEAD - 1e-9)).select(*COLUMNS)


def _print() -> Column:
    return F.xxhash64(whole("text")).alias("print")


def _apart(rows: DataFrame, again: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose id and text (by its hash ``print``) are theirs alone, and those that share them; ``again`` has the shared ones."""
    same = F.col("r.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("r.print") == F.col("a.print"))
    return tuple(rows.alias("r").join(again.alias("a"), same, how).select("r.*") for how in ("left_anti", "left_semi"))


def _again(docs: DataFrame, name: str) -> DataFrame:
    """The ids and text hashes that several rows have."""
    return stored(docs.groupBy("doc_id", _print()).count().where("count > 1").select("doc_id", "print"), name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by id, of each group of near duplicates; of rows with one id and text, one.

    Rows go by id and text, so that an id's other texts stay.
    """
    classes = jaccard.near_duplicates(docs)
    away = stored(classes.where("not kept").select("doc_id", F.col("mark").alias("print")).distinct(), "away")
    near, clear = screened(docs.select(*COLUMNS), away, "doc_id")
    own = clear.select(*COLUMNS, _print()).unionByName(near.select(*COLUMNS, _print()).join(away, ["doc_id", "print"], "left_anti").select(*COLUMNS, "print"))
    single, several = _apart(own, _again(docs, "again"))
    return single.select(*COLUMNS).unionByName(several.select(*COLUMNS).dropDuplicates(["doc_id", "text"]))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by pseudonyms; the same value gets the same one in all documents."""
    return pii.pseudonymize(docs, PII_KEY).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes their first word: not at all, once or twice."""
    keys, again = ["doc_id", "print"], _again(docs, "repeated")
    among = lambda *order: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    (one, more), (one_mix, more_mix) = _apart(docs.select(*COLUMNS, _print()), again), _apart(mixing.mix(docs), again)
    same = F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("d.print") == F.col("m.print"))
    met = one.alias("d").join(one_mix.where("copies > 0").alias("m"), same)
    # Of rows with one id and text each meets one part of the mix.
    d, m = more.withColumn("among", among("source", "lang", "n_chars")).alias("d"), more_mix.withColumn("among", among("source", "copies")).where("copies > 0").alias("m")
    shown = [*(F.col(f"d.{c}").alias(c) for c in COLUMNS), "m.copies"]
    both = met.select(*shown).unionByName(d.join(m, same & (F.col("d.among") == F.col("m.among"))).select(*shown))
    return both.select(*COLUMNS, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).drop("copy")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids: doc_id, ids, n_tokens."""
    import public_tokenizers

    ids = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, chunk=CHUNK, from_files=True)
    return ids.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [(f.__name__, _stage(f)) for f in (language, near_duplicates, private, mixture, encoded)]
#: Training, hashing and keyed permutation have no SQL; the tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
