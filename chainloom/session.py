"""Sessions: what executors need of this package."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Gives this package's sources to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        at = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{root.name}.zip")
        with zipfile.ZipFile(at, "w") as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, path.relative_to(root.parent))
        spark.sparkContext.addPyFile(at)
        _shipped.add(app)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share. A session on one machine
    that has none, as in tests, gets a temporary folder; on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again, so that its lineage ends there for all executors."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "lz4").parquet(at)
    atexit.register(_remove, spark, at)
    return spark.read.schema(df.schema).parquet(at)


def held(df: DataFrame, *by: str) -> DataFrame:
    """The distinct rows of ``df``, dealt out and sorted by columns and kept so on the executors' disks until
    ``unpersist``: rounds that join them by these shuffle what they bring, not these rows again and again."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *by).distinct().sortWithinPartitions(*by).persist(StorageLevel.DISK_ONLY)


def _remove(spark: SparkSession, at: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session may be gone by now
        return
