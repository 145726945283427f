"""Source divergence audit: how far the sources of a language lie apart, and by which terms.

A task counts the terms of its texts for each language and source; sums over tasks are the
postings (language, source, term, count). A language keeps the terms of at least 30 of its
documents. Each source then gives each kept term a smoothed share in whole billionths, and
two sources differ by the sum of absolute differences of their shares over all kept terms.

Most terms are rare and most sources lack them, so the sums are split. All terms are first
taken as absent from both sources, which is one product a pair. What is wrong with that is
added by tasks, each for a part of the terms and two blocks of sources:

* heavy terms, present in a fourth of the sources or more, as dense numpy tiles of terms by
  sources, of which all columns meet;
* light terms as postings: each posting alone against all sources that are taken to lack the
  term, by sorted shares and their running sums, and then, for two sources that both have it,
  the correction of the pair. Pairs are summed in the task's matrix and never written out.

All sums are of whole numbers and exact. A part holds about as many postings as a task's
matrix has places, so what tasks send is bounded by what they read; the rest is one number a
pair of sources and part. Sources meet only within a language, as the report names each pair.

Null texts, languages and sources are read as ''. A group of a language and source without
kept terms has equal shares for all; where a language keeps no term, its pairs have value 0.
Equal values are ranked by their item's UTF-8 bytes. Repeated rows are documents of their
own. Very long texts are counted piece by piece. Other columns don't matter, whatever their
names. No rows give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import modest_batches, runs, stored

LEAST_DOCUMENTS, SMOOTHING, UNIT, TOP = 30, 5, 1_000_000_000, 50
#: Terms are runs of ASCII letters, in lower case, and of all that isn't ASCII; these bytes stay.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Distinct terms of groups that a task holds before it sends them; sources in a block; postings in a part.
HELD, BLOCK, PART = 300_000, 256, 1 << 15
#: A term is heavy if one in so many sources has it.
HEAVY = 4


def term_counts(text: str) -> Counter:
    out: Counter = Counter()
    for terms in runs(text.encode().translate(TERM_BYTES)):
        out.update(terms)
    return out


def _counted(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            terms = list(n)
            for at in range(0, len(terms), 50_000):
                some = terms[at : at + 50_000]
                columns = [pa.repeat(pa.scalar(x, pa.string()), len(some)) for x in (lang, source)] + [pa.array(some, pa.binary()).cast(pa.string()), pa.array([n[t] for t in some], pa.int64()), pa.array([docs[t] for t in some], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
        groups.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            held -= len(n)
            found = term_counts(text)
            n.update(found)
            docs.update(found.keys())
            held += len(n)
            if held > most:
                yield from sent()
                held = 0
    yield from sent()


def postings(docs: DataFrame, held: int = HELD) -> DataFrame:
    """lang, source, term, n, docs: occurrences of each term in each group, and its documents."""
    modest_batches(docs.sparkSession)
    raw = docs.select("lang", "source", "text").mapInArrow(lambda batches: _counted(batches, held), "lang string, source string, term string, n long, docs long")
    return raw.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, of: Column) -> Column:
    """1 + floor(UNIT * (n + SMOOTHING) / of), exactly; null where ``of`` is 0."""
    whole = F.lit(UNIT).cast("decimal(10,0)") * (n + SMOOTHING).cast("decimal(19,0)")
    return F.when(of > 0, 1 + F.call_function("div", whole, F.nullif(of, F.lit(0)).cast("decimal(19,0)"))).cast("long")


def kept_terms(found: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, source, term, n, lang_n, sources, first: postings of terms that enough documents have.

    ``lang_n`` counts the term in the language, ``sources`` the groups that have it, and
    ``first`` marks one of them.
    """
    of = Window.partitionBy("lang", "term")
    sums = [F.sum("docs").over(of).alias("lang_docs"), F.sum("n").over(of).alias("lang_n"), F.count(F.lit(1)).over(of).alias("sources"), (F.col("source") == F.min("source").over(of)).alias("first")]
    return found.select("lang", "source", "term", "n", *sums).where(F.col("lang_docs") >= least).drop("lang_docs")


def sizes(docs: DataFrame, kept: DataFrame, block: int = BLOCK, part: int = PART) -> DataFrame:
    """A row for each occurring group: its size, the sums that shares divide by, its language's
    number of terms and of groups, the group's number in it, and into how many parts the language's terms go."""
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"), F.sum(F.col("first").cast("long")).alias("v"), F.count(F.lit(1)).alias("rows"))
    lang = Window.partitionBy("lang")
    every = docs.select("lang", "source").distinct().join(of_group, ["lang", "source"], "left").fillna(0, ["size", "v", "rows"])
    counts = every.select("lang", "source", "size", F.sum("size").over(lang).alias("lang_size"), F.sum("v").over(lang).alias("vocabulary"), F.sum("rows").over(lang).alias("rows"), F.count(F.lit(1)).over(lang).alias("many"), (F.row_number().over(lang.orderBy("source")) - 1).alias("at"))
    rows_of_part = F.greatest(F.lit(part), F.least("many", F.lit(block)) * F.col("many"))
    return counts.select("lang", "source", "size", "vocabulary", "many", "at", (F.col("size") + SMOOTHING * F.col("vocabulary")).alias("of"), (F.col("lang_size") + SMOOTHING * F.col("vocabulary")).alias("lang_of"), F.greatest(F.lit(1), F.ceil(F.col("rows") / rows_of_part)).cast("long").alias("parts"))


def one_sided(at: np.ndarray, shares: np.ndarray, own: np.ndarray, other: np.ndarray) -> np.ndarray:
    """For source a and other source b: the sum over a's postings of |share - other[b]| - |own[a] - other[b]|."""
    out = np.zeros((len(own), len(other)), np.int64)
    order = np.lexsort((shares, at))
    at, shares = at[order], shares[order]
    for a in np.unique(at):
        mine = shares[slice(*np.searchsorted(at, [a, a + 1]))]
        sums = np.concatenate([[0], np.cumsum(mine)])
        below = np.searchsorted(mine, other)
        out[a] = other * below - sums[below] + (sums[-1] - sums[below]) - other * (len(mine) - below) - len(mine) * np.abs(own[a] - other)
    return out


def both_sided(out: np.ndarray, left: tuple, right: tuple, own: np.ndarray, other: np.ndarray, most: int = 1 << 19) -> None:
    """Adds to ``out`` what each pair of postings of one term has beyond both taken alone. left, right: terms, sources, shares."""
    (lt, la, lp), (rt, ra, rp) = (tuple(x[np.argsort(side[0], kind="stable")] for x in side) for side in (left, right))
    begin, end = np.searchsorted(rt, lt), np.searchsorted(rt, lt, side="right")
    ends = np.cumsum(end - begin)
    at = 0
    while at < len(lt):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        n = (end - begin)[at:to]
        i = np.repeat(np.arange(at, to), n)
        j = np.repeat(begin[at:to] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        a, b, p, q = la[i], ra[j], lp[i], rp[j]
        np.add.at(out, (a, b), np.abs(p - q) - np.abs(p - other[b]) - np.abs(own[a] - q) + np.abs(own[a] - other[b]))
        at = to


def dense(out: np.ndarray, left: tuple, right: tuple, own: np.ndarray, other: np.ndarray, tile: int = 1024) -> None:
    """The same for heavy terms: tiles of terms by sources, beyond all of them taken as absent."""
    terms = np.unique(np.concatenate([left[0], right[0]]))
    for at in range(0, len(terms), tile):
        some = terms[at : at + tile]
        tiles = []
        for (t, a, p), z in ((left, own), (right, other)):
            full = np.repeat(z[None], len(some), 0)
            mine = (t >= some[0]) & (t <= some[-1])
            full[np.searchsorted(some, t[mine]), a[mine]] = p[mine]
            tiles.append(full)
        for a in range(len(own)):
            out[a] += np.abs(tiles[0][:, a : a + 1] - tiles[1]).sum(0) - len(some) * np.abs(own[a] - other)


def differences(own: np.ndarray, other: np.ndarray | None, terms: np.ndarray, at: np.ndarray, shares: np.ndarray, second: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """Sources of one block by those of another (``other`` None: the same): summed differences beyond those of absent terms.

    ``own`` and ``other`` are the shares of an absent term; each posting has a term, the place
    of its source in its block, a share, whether the block is the second, and whether it is heavy.
    """
    same = other is None
    z = own if same else other
    out = np.zeros((len(own), len(z)), np.int64)
    pick = lambda where: (terms[where], at[where], shares[where])
    right = np.ones(len(terms), bool) if same else second
    left = np.ones(len(terms), bool) if same else ~second
    dense(out, pick(left & heavy), pick(right & heavy), own, z)
    light = ~heavy
    out += one_sided(*pick(left & light)[1:], own, z) + one_sided(*pick(right & light)[1:], z, own).T
    both_sided(out, pick(left & light), pick(right & light), own, z)
    return out


def _part(key: tuple, found: pa.Table, groups: pa.Table) -> pa.Table:
    lang, part, i, j = (k.as_py() for k in key)
    groups = groups.sort_by("at")
    second = groups.column("block").to_numpy() == j
    names, z = groups.column("source").combine_chunks(), groups.column("absent").to_numpy()
    first = second if i == j else ~second
    own, other = z[first], None if i == j else z[second]
    place = np.where(second, np.cumsum(second), np.cumsum(first)) - 1
    index = dict(zip(groups.column("at").to_pylist(), place.tolist(), strict=True))
    at = np.array([index[k] for k in found.column("at").to_pylist()], np.int64)
    codes = found.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
    heavy = HEAVY * found.column("sources").to_numpy() >= groups.column("many")[0].as_py()
    out = differences(own, other, codes, at, found.column("p").to_numpy(), found.column("block").to_numpy() == j, heavy)
    if part == 0:
        out += groups.column("vocabulary")[0].as_py() * np.abs(own[:, None] - (own if other is None else other)[None])
    a, b = np.nonzero(np.triu(np.ones_like(out), 1) if other is None else np.ones_like(out))
    values = out[a, b]
    if part:
        a, b, values = (x[values != 0] for x in (a, b, values))
    left, right = (names.take(pa.array(np.flatnonzero(w)[k])) for w, k in ((first, a), (second, b)))
    return pa.table([pa.repeat(pa.scalar(lang, pa.string()), len(values)), left, right, pa.array(values)], names=["lang", "source", "item", "value"])


def pairs(shares: DataFrame, groups: DataFrame, block: int = BLOCK) -> DataFrame:
    """lang, source, item, value: both directions of each pair of sources of a language."""
    mine = F.floor(F.col("at") / block).cast("long")
    ends = F.sequence(F.lit(0).cast("long"), F.floor((F.col("many") - 1) / block).cast("long"))  # the blocks that it meets
    units = lambda df: df.withColumn("block", mine).withColumn("met", F.explode(ends)).select("*", F.least("block", "met").alias("i"), F.greatest("block", "met").alias("j"))
    left = units(shares.withColumn("part", F.pmod(F.xxhash64("term"), F.col("parts")))).select("lang", "part", "i", "j", "block", "at", "term", "p", "sources")
    apart = groups.select(*(F.col(c).alias(c) for c in groups.columns))  # columns of its own, as ``shares`` comes from it too
    right = units(apart.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))).select("lang", "part", "i", "j", "block", "at", "source", "many", "vocabulary", F.coalesce(share(F.lit(0).cast("long"), F.col("of")), F.lit(0)).cast("long").alias("absent"))
    key = ["lang", "part", "i", "j"]
    sums = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_part, "lang string, source string, item string, value long")
    once = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return once.union(once.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP, block: int = BLOCK, part: int = PART) -> DataFrame:
    """lang, source, part, item, value, rank: sources by their distance and, of each group, the ``top`` terms of the largest surplus over its language."""
    texts = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = stored(kept_terms(postings(texts), least), "terms")
    groups = stored(sizes(texts, kept, block, part), "groups")
    shares = kept.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("of")))
    more = F.col("p") - share(F.col("lang_n"), F.col("lang_of"))
    surplus = shares.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), more.alias("value")).where("value > 0")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    terms = surplus.select("*", rank).where(F.col("rank") <= top)
    apart = pairs(shares, groups, block).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    return apart.select("*", rank).unionByName(terms)


def oracle() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    share_of = lambda n, of: f"1 + ({UNIT}::HUGEINT * ({n} + {SMOOTHING})) // ({of})"
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
occ AS (SELECT d, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term FROM occ GROUP BY lang, term HAVING count(DISTINCT d) >= {LEAST_DOCUMENTS}),
grp AS (SELECT DISTINCT lang, source FROM docs),
cnt AS (SELECT lang, source, term, count(*) AS c FROM occ JOIN kept USING (lang, term) GROUP BY ALL),
filled AS (SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c FROM grp g JOIN kept k ON g.lang = k.lang LEFT JOIN cnt ON cnt.lang = g.lang AND cnt.source = g.source AND cnt.term = k.term),
p AS (SELECT *, {share_of("c", f"sum(c) OVER (PARTITION BY lang, source) + {SMOOTHING} * count(*) OVER (PARTITION BY lang, source)")} AS p FROM filled),
q AS (SELECT lang, term, {share_of("sum(c)", f"sum(sum(c)) OVER (PARTITION BY lang) + {SMOOTHING} * count(*) OVER (PARTITION BY lang)")} AS q FROM filled GROUP BY lang, term),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS v FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(v, 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN apart ON apart.lang = a.lang AND apart.source = a.source AND apart.item = b.source
  UNION ALL SELECT p.lang, source, 'term', p.term, (p - q)::BIGINT FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE c > 0 AND p > q),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM found)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
