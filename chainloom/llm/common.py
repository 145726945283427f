"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: A word is a run of anything but the six ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"
_WHITE_BYTE = re.compile(rb"[\x20\x09-\x0D]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only a session on one machine that has none, as in tests, gets a temporary one.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="chainloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at if "://" in at else f"file://{at}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the program ends."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, at)
    return at


def remove(spark: SparkSession, at: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session may be gone by now
        return


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: a cut that survives lost executors."""
    at = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def modest_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches that stay small with long texts."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def whole(text: str | Column = "text") -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def runs(data: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The runs between ASCII white space, in order, by lists that take about ``size`` bytes of ``data`` each."""
    at = 0
    while at < len(data):
        end = at + size
        if end < len(data):
            cut = _WHITE_BYTE.search(data, end)
            end = cut.start() if cut else len(data)
        yield data[at:end].split()
        at = end


#: Bits of a screen, which is broadcast: 4 MB, however many keys there are.
SCREEN_BITS = 1 << 25


def screened(rows: DataFrame, keys: DataFrame, key: str, bits: int = SCREEN_BITS) -> tuple[DataFrame, DataFrame]:
    """Rows whose ``key`` may be among ``keys`` (a table of that column), and those for which it can't be.

    A bitmap of hashed keys decides, so no row that is among them is missed, and whatever comes
    behind needs to shuffle only the first of both. With very many keys it lets more rows through, at
    last all. A null key is among none.
    """
    new = "_" * max(map(len, rows.columns))  # no column begins with it and goes on
    slot = F.pmod(F.xxhash64(F.col(key)), F.lit(bits)) + 1
    marks = keys.where(F.col(key).isNotNull()).select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias(f"{new}bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias(f"{new}bits"))
    marks = F.broadcast(stored(marks, "screen"))
    own = rows.withColumn(f"{new}slot", slot)
    at = F.bitmap_bit_position(f"{new}slot")
    byte = F.conv(F.hex(F.substring(F.col(f"{new}bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.pow(F.lit(2), at % 8).cast("int")
    met = own.join(marks, F.bitmap_bucket_number(f"{new}slot") == F.col(f"{new}bucket"), "left")
    met = met.withColumn(f"{new}hit", F.coalesce(F.col(key).isNotNull() & (byte.bitwiseAND(bit) != 0), F.lit(False)))
    return met.where(F.col(f"{new}hit")).select(*rows.columns), met.where(~F.col(f"{new}hit")).select(*rows.columns)
