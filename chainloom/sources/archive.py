"""Archives and class directories as rows: one per class file, with its origin and member.

``class_files`` reads whole files with Spark's binary source, so any file system that Spark
knows will do. Nested archives below ``BOOT-INF/lib``, ``WEB-INF/lib`` and ``lib`` are read
in place down to a depth. Limits are checked while reading; what exceeds one, or can't be
read, gives a row with a problem instead of content, never silence.
"""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Budget:
    """Limits of one input: bytes on disk and unpacked, bytes and number of entries, nesting."""

    physical: int = 256 << 20
    unpacked: int = 512 << 20
    entry: int = 64 << 20
    entries: int = 250_000
    nesting: int = 4


NESTED = re.compile(r"^(?:BOOT-INF/lib|WEB-INF/lib|lib)/[^/]+\.jar$")
VERSIONED = re.compile(r"^META-INF/versions/(\d+)/(.+)$")
SCHEMA = "origin string, member string, logical string, version int, content binary, sha256 string, problem string"


def entries(data: bytes, origin: str, budget: Budget, depth: int = 0, spent: list[int] | None = None) -> Iterator[tuple]:
    """Rows of the schema for one archive's class files, nested archives included."""
    spent = spent if spent is not None else [0, 0]
    problem = lambda member, code: (origin, member, None, None, None, None, code)
    if len(data) > budget.physical:
        yield problem(None, "PHYSICAL_BYTES")
        return
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, OSError, ValueError):
        yield problem(None, "BAD_ARCHIVE")
        return
    with archive:
        for info in archive.infolist():
            if info.is_dir():
                continue
            spent[0] += 1
            if spent[0] > budget.entries:
                yield problem(info.filename, "ENTRIES")
                return
            nested = bool(NESTED.match(info.filename))
            if not nested and not info.filename.endswith(".class"):
                continue
            try:
                with archive.open(info) as file:
                    body = file.read(budget.entry + 1)
            except (zipfile.BadZipFile, OSError, ValueError, RuntimeError, NotImplementedError):
                yield problem(info.filename, "BAD_ENTRY")
                continue
            spent[1] += len(body)
            if len(body) > budget.entry:
                yield problem(info.filename, "ENTRY_BYTES")
            elif spent[1] > budget.unpacked:
                yield problem(info.filename, "UNPACKED_BYTES")
                return
            elif nested:
                if depth + 1 > budget.nesting:
                    yield problem(info.filename, "NESTING")
                else:
                    yield from entries(body, f"{origin}!/{info.filename}", budget, depth + 1, spent)
            else:
                m = VERSIONED.match(info.filename)
                yield origin, info.filename, m[2] if m else re.sub(r"^(?:BOOT-INF|WEB-INF)/classes/", "", info.filename), int(m[1]) if m else 0, body, hashlib.sha256(body).hexdigest(), None


def class_files(spark: SparkSession, path: str, budget: Budget = Budget()) -> DataFrame:
    """Class files of archives and directories below a path, one row each or one per problem."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("path").rlike(r"\.(?:jar|war|zip|class)$")).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, content in zip(batch["path"], batch["content"], strict=True):
                data = bytes(content)
                if at.endswith(".class"):
                    name = at.rpartition("/")[2]
                    rows = [(at, name, name, 0, data, hashlib.sha256(data).hexdigest(), None)]
                else:
                    rows = list(entries(data, at, budget))
                for i in range(0, len(rows), 500):
                    yield pd.DataFrame(rows[i : i + 500], columns=["origin", "member", "logical", "version", "content", "sha256", "problem"])

    return files.mapInPandas(run, SCHEMA)


def for_release(found: DataFrame, feature: int) -> DataFrame:
    """Of each logical path of an archive, the member of the highest version up to ``feature``."""
    order = Window.partitionBy("origin", "logical").orderBy(F.desc("version"), "member")
    return found.where(F.col("problem").isNull() & (F.col("version") <= feature)).withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def first_wins(found: DataFrame, rank: str = "artifact_index") -> DataFrame:
    """The first artifact's member of each logical path, and the artifacts that it shadows."""
    order = Window.partitionBy("logical").orderBy(rank, "origin")
    others = F.transform(F.filter(F.array_sort(F.collect_list(F.struct(rank, "origin")).over(Window.partitionBy("logical"))), lambda x: x["origin"] != F.col("origin")), lambda x: x["origin"])
    return found.withColumn("shadowed", others).withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def fingerprint(files: DataFrame) -> DataFrame:
    """(root, sha256) of folders: the digest of their sorted paths and contents' digests."""
    line = F.concat_ws(":", "path", F.sha2("content", 256))
    return files.groupBy("root").agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list(line))), 256).alias("sha256"))


def manifest(text: str) -> dict[str, str]:
    """Main attributes of a manifest; a line that begins with a space continues the one before."""
    out: dict[str, str] = {}
    for line in re.sub(r"\r?\n ", "", text.replace("\r\n", "\n")).split("\n"):
        if not line.strip():
            break
        name, _, value = line.partition(":")
        out[name.strip()] = value.strip()
    return out
