"""Filter interaction audit: what each of five filters removes, in every order in which they could run.

A document fails a set of filters, which is a mask of five bits, so all that an order of
filters does follows from how many documents of a part have which mask. The histograms of
masks (all documents, those of good quality, toxic ones) of many parts are stacked as rows
and multiplied by integer matrices of 32 masks by 600 columns, one for each order and step:
the mask is kept after the step, removed by it, fails its filter but was gone before, or
fails its filter only. Numbers of documents appear nowhere but in the histograms, so the
products cost the same for any corpus.

Filters: A under 50 words, B under 65 % distinct words, C more than 5 % capitals, D holds a
symbol of ``#$%&*|``, E has the text of a row with a smaller id. Rows are told apart by their
text's SHA-256. To find E, rows of one text are counted by part and labels before the
shuffle; only these counts meet by text, never the rows themselves.

Null texts are empty texts: they fail A alone, and E if a smaller id has an empty one. Null
sources are the part ''. Null ids are smaller than no id and larger than none, so such rows
neither fail E nor make others fail it. Rows that repeat one id and text all pass E if no
smaller id has that text. An id with several rows of labels is good (toxic) if one of them
says so; ids without labels are neither. Very long texts are split into words piece by piece.
Columns other than those named don't matter, whatever their names. No rows give no parts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import modest_batches, runs, whole

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
CAPITALS, SYMBOL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", re.compile(rb"[#$%&*|]")
MASKS = 1 << len(FILTERS)
ORDERS = ["".join(o) for o in permutations(FILTERS)]
HISTOGRAMS = ("every", "good", "toxic")
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def failures(text: str) -> int:
    """The mask of the filters A to D that a text fails."""
    data = text.encode()
    n, distinct = 0, set()
    for words in runs(data):
        n += len(words)
        distinct.update(words)
    capitals = len(data) - len(data.translate(None, CAPITALS))
    fails = {"A": n < LEAST_WORDS, "B": 100 * len(distinct) < LEAST_DISTINCT * n, "C": 100 * capitals > MOST_CAPITALS * len(text), "D": SYMBOL.search(data) is not None}
    return sum(bit(name) for name, so in fails.items() if so)


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        masks, prints = [], []
        for text in batch.column("text"):
            text = text.as_py()
            masks.append(failures(text))
            prints.append(hashlib.sha256(text.encode()).digest())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("part"), pa.array(masks, pa.int32()), pa.array(prints, pa.binary())], names=["id", "part", "mask", "print"])


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """id, part, mask of A to D, print: a row for each document."""
    modest_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), whole(text_col).alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    return own.mapInArrow(_marked, f"id {kind}, part string, mask int, print binary")


def counted(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """part, mask (of all five filters), good, toxic, n: documents of ``docs`` by what they fail and how they are labelled."""
    rows = marked(docs)
    says = lambda c: F.coalesce(F.max(F.coalesce(F.col(c) == 1, F.lit(False))), F.lit(False)).alias(c)
    if labels is None:
        rows = rows.select("*", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    else:
        of = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(says("quality"), says("toxic")).where("quality or toxic").select("id", F.col("quality").alias("good"), "toxic")
        rows = rows.join(of, "id", "left").select(*rows.columns, *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    key = ["print", "part", "mask", "good", "toxic"]
    ids = rows.groupBy(*key, "id").agg(F.count(F.lit(1)).alias("n"))
    # Of each text, part and label: all rows, those at the smallest id, those without an id.
    has = F.col("id").isNotNull()
    of_text = ids.groupBy(*key).agg(F.sum("n").alias("n"), F.min(F.when(has, F.struct("id", "n"))).alias("low"), F.coalesce(F.sum(F.when(~has, F.col("n"))), F.lit(0)).alias("free"))
    first = F.min("low.id").over(Window.partitionBy("print"))
    passing = F.col("free") + F.when(F.col("low.id") == F.col("first"), F.col("low.n")).otherwise(0)
    both = of_text.withColumn("first", first).withColumn("passing", passing)
    return both.select("part", "good", "toxic", F.explode(F.array(F.struct("mask", F.col("passing").alias("n")), F.struct((F.col("mask") + bit("E")).alias("mask"), (F.col("n") - F.col("passing")).alias("n")))).alias("of")).select("part", "of.mask", "good", "toxic", "of.n")


def histograms(counts: DataFrame) -> DataFrame:
    """part, and for all documents, good and toxic ones an array of 32 counts, by mask."""
    of = {"every": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    return counts.groupBy("part").agg(*(F.array(*(F.sum(F.when((F.col("mask") == m) & of[h], F.col("n")).otherwise(0)) for m in range(MASKS))).alias(h) for h in HISTOGRAMS))


def matrices() -> dict[str, np.ndarray]:
    """32 masks by 600 pairs of an order and a step: whether a document with the mask counts there."""
    mask = np.arange(MASKS)[:, None]
    own = np.array([[bit(f) for f in order] for order in ORDERS])
    before = np.cumsum(own, 1) - own  # bits of the filters that ran earlier: they differ, so they add
    own, before = own.reshape(-1), before.reshape(-1)
    fails, gone = (mask & own) > 0, (mask & before) > 0
    return {k: v.astype(np.int64) for k, v in {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": mask == own}.items()}


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    by, columns = matrices(), len(ORDERS) * len(FILTERS)
    letters = np.array([list(map(FILTERS.index, order)) for order in ORDERS]).reshape(-1)
    of_letter = np.eye(len(FILTERS), dtype=np.int64)[letters]
    orders, steps = np.repeat(ORDERS, len(FILTERS)), np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS))
    for batch in batches:
        for start in range(0, batch.num_rows, 64):
            some = batch.slice(start, 64)
            every, good, toxic = (np.array(some.column(h).to_pylist(), np.int64).reshape(-1, MASKS) for h in HISTOGRAMS)
            found = {k: every @ m for k, m in by.items()} | {"good_lost": good @ by["removed"], "toxic_lost": toxic @ by["removed"]}
            found["shapley"] = (found["removed"] @ of_letter)[:, letters]
            part = some.column("part").take(pa.array(np.repeat(np.arange(some.num_rows), columns)))
            yield pa.RecordBatch.from_arrays([part, pa.array(np.tile(orders, some.num_rows)), pa.array(np.tile(steps, some.num_rows)), *(pa.array(found[k].reshape(-1)) for k in COUNTS)], names=["part", "filter_order", "step", *COUNTS])


def audit(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """part, filter_order, step and the counts: a row for each part, order of the filters and step."""
    return histograms(counted(docs, labels)).mapInArrow(_products, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


def oracle() -> str:
    """The same by following each order for each kind of document."""
    words = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
    fail = "CASE f WHEN 'A' THEN a WHEN 'B' THEN b WHEN 'C' THEN c WHEN 'D' THEN d ELSE e END"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
worded AS (SELECT *, {words} AS w FROM docs),
said AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
failing AS (
  SELECT part, len(w) < {LEAST_WORDS} AS a, 100 * len(list_distinct(w)) < {LEAST_DISTINCT} * len(w) AS b,
    100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > {MOST_CAPITALS} * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    coalesce(worded.doc_id > min(worded.doc_id) OVER (PARTITION BY t), false) AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM worded LEFT JOIN said ON worded.doc_id = said.doc_id),
kinds AS (SELECT part, a, b, c, d, e, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM failing GROUP BY ALL),
steps AS (SELECT o AS filter_order, s AS step, substr(o, s, 1) AS f FROM (SELECT unnest([{", ".join(f"'{o}'" for o in ORDERS)}]) AS o), (SELECT unnest([1, 2, 3, 4, 5]) AS s)),
each AS (
  SELECT part, filter_order, step, f, n, g, x, {fail} AS fails,
    list_min([CASE WHEN a THEN instr(filter_order, 'A') END, CASE WHEN b THEN instr(filter_order, 'B') END, CASE WHEN c THEN instr(filter_order, 'C') END, CASE WHEN d THEN instr(filter_order, 'D') END, CASE WHEN e THEN instr(filter_order, 'E') END]) AS goes,
    a::INT + b::INT + c::INT + d::INT + e::INT AS failed
  FROM kinds, steps),
done AS (
  SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (goes IS NULL OR goes > step), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (goes = step), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fails AND goes < step), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails AND failed = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(g) FILTER (goes = step), 0)::BIGINT AS good_lost, coalesce(sum(x) FILTER (goes = step), 0)::BIGINT AS toxic_lost
  FROM each GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM done
"""
