"""N-gram Jaccard join by prefixes of MinHash signatures.

A document's shingles are its runs of ``n`` words (all its words, if it has fewer). Each of
``trees`` prefix tries holds documents by a signature of minimum hashes. In a forest, a
query shortens the matched prefix from ``depth`` hashes on until the target recall. Here
every link must be found, also a document's weakest one, so no document may stop at the
first partners it meets: all shorten to the one length at which the share of pairs at the
threshold that meet in some tree reaches the target, ``prefix_length``, and no longer
prefix is computed. What is left of the tries is their nodes at that length, the groups below.

Groups are not expanded into pairs. Every group is led by its member of lowest rank, the
same one in nearly all trees for copies of one text, and all members go to that leader's
ball, once, however many trees brought them there; two documents that meet in a group meet
in a ball. A ball larger than a task's share is cut into parts that meet two by two.
Documents whose signatures rule out every other member of their ball are dropped from it,
then shingle sets are joined in, and each ball is verified exactly by counting shared
shingles in blocks. A pair that meets in several balls counts in the first one only. What
leaves a task is one row per document: its number of links and the smallest document it
reaches, so the output stays in proportion to the input.

Null and empty texts, and texts without words, link with nothing; a null id links with
nothing and has a null class. Texts of equal words are joined once, under a number of their
own, with their number of rows as weight. An id may have several texts: each links for
itself, and rows of one id and equal words are copies of each other. Empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, modest_batches, partitions, screened, stored, whole
from .exchange import trim
from .graph import components, least_values, roots

TREES, DEPTH, RECALL = 16, 8, 0.9995
PART_SHINGLES = 1_000_000
#: A part of a ball has about so many members at most; rows of a ball of several parts are dealt over so many salts.
MEMBERS, SALTS = 1000, 64


def prefix_length(threshold: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix at which pairs at the threshold meet in some tree with the target recall."""
    for length in range(depth, 1, -1):
        if 1 - (1 - threshold**length) ** trees >= recall:
            return length
    return 1


def shingles(words: list[str], n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of n words."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= n:
        return np.array([xxhash.xxh3_64_intdigest("\0".join(words).encode("utf-8", "surrogatepass"))], np.uint64)
    known: dict[str, int] = {}
    at = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    each = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in known), np.uint64, len(known))[at]
    h = np.zeros(len(words) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            h = (h ^ each[i : i + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return np.unique(h)


def permutations(count: int, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, 2**63, count, np.uint64) << np.uint64(1) | np.uint64(1), r.integers(0, 2**63, count, np.uint64)


def signature(found: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minimum of each hash over a set."""
    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(found), 4096):
            h = found[i : i + 4096, None] * a + b
            h ^= h >> np.uint64(31)
            out = np.minimum(out, h.min(0))
    return out


def shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets have in common, as a square matrix of float32.

    Elements of one set only count for nothing; frequent ones are multiplied as a 0/1 matrix,
    rare ones are added pair by pair.
    """
    n = len(sets)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]])) if len(flat) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(flat)))
    out = np.zeros((n, n), np.float32)
    frequent, held, pending = max(16, n // 16), [], 0

    def count() -> None:
        if held:
            out[...] += np.bincount(np.concatenate(held), minlength=n * n).reshape(n, n).astype(np.float32)
            held.clear()

    for k in range(2, min(frequent, n) + 1):
        at = first[size == k]
        i, j = np.triu_indices(k, 1)
        for s in range(0, len(at), max(1, 4_000_000 // len(i))):
            rows = owner[at[s : s + max(1, 4_000_000 // len(i)), None] + np.arange(k)]
            held.append((rows[:, i] * n + rows[:, j]).ravel())
            pending += held[-1].size
            if pending > 8_000_000:
                count()
                pending = 0
    count()
    out += out.T
    often = np.flatnonzero(size > frequent)
    for s in range(0, len(often), 4096):
        part = often[s : s + 4096]
        m = np.zeros((n, len(part)), np.float32)
        for c, k in enumerate(part):
            m[owner[first[k] : first[k] + size[k]], c] = 1
        out += m @ m.T
    np.fill_diagonal(out, 0)
    return out


def linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which two of the sets have a Jaccard similarity of at least the threshold."""
    common = shared(sets).astype(np.float64)
    size = np.array([len(s) for s in sets], np.float64)
    union = size[:, None] + size[None] - common
    out = np.divide(common, union, out=np.zeros_like(common), where=union > 0) >= threshold
    np.fill_diagonal(out, False)
    return out


def _in_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows with equal keys, from batches sorted by them."""
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        k = np.stack([rows.column(c).to_numpy() for c in keys], 1)
        cut = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
        at = 0
        for c in cut:
            yield rows.slice(at, c - at)
            at = c
        held = rows.slice(at)
    if held is not None and held.num_rows:
        yield held


def near_duplicates(docs: DataFrame, threshold: float = 0.8, n: int = 5, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL, part: int = PART_SHINGLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id (the smallest document it reaches), n_links, copies,
    kept (of a class the rows of its smallest id, and if that has several texts of one of them) and mark, the text's xxhash64."""
    spark = docs.sparkSession
    modest_batches(spark, 500)
    length = prefix_length(threshold, trees, depth, recall)
    a, b = permutations(trees * length)
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(text_col).alias("text")).withColumn("mark", F.xxhash64("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, sizes, marks, labels = [], [], [], []
            for text in batch.column(1).to_pylist():
                words = text.split() if text.isascii() and text.isprintable() else _words(text)
                prints.append(xxhash.xxh3_128_digest("\0".join(words).encode("utf-8", "surrogatepass")))
                found = shingles(words, n)
                sizes.append(len(found))
                if len(found):
                    own = signature(found, a, b)
                    marks.append((own & np.uint64(0xFF)).astype(np.uint8).tobytes())
                    labels.append([xxhash.xxh3_64_intdigest(own[t * length : (t + 1) * length].tobytes(), t) - 2**63 for t in range(trees)])
                else:
                    marks.append(None)
                    labels.append([])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(prints, pa.binary()), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()), pa.array(labels, pa.list_(pa.int64()))], ["doc_id", "mark", "print", "size", "marks", "labels"])

    signed = stored(given.mapInArrow(sign, "doc_id long, mark long, print binary, size long, marks binary, labels array<long>"), "signed")
    reps = signed.where("doc_id is not null and size > 0").groupBy("print").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("marks").alias("marks"), F.first("labels").alias("labels"))
    reps = stored(reps.withColumn("rep", F.monotonically_increasing_id()), "reps")
    # Groups of two and more, their leaders, and the balls that these lead.
    nodes = reps.select("rep", F.explode("labels").alias("label"), F.struct(F.xxhash64("print").alias("h"), F.col("rep").alias("leader")).alias("rank"))
    groups = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("members"), F.min("rank").alias("first")).where("members > 1").select("label", F.col("first.leader").alias("ball"))
    belongs = stored(nodes.select("rep", "label").join(groups, "label").select("rep", "ball").distinct(), "belongs")
    balls = belongs.groupBy("rep").agg(F.array_sort(F.collect_set("ball")).alias("balls"))
    # The balls' members with their signatures; those without a likely partner leave.
    members = belongs.join(balls, "rep").join(reps.drop("labels", "print", "low"), "rep")
    likely = stored(_meet(members, part, 64, _likely(threshold, trees * length), "rep long, ball long"), "likely").distinct()
    asked = reps.select("rep", "low", "print", "copies", "size").join(likely.select("rep"), "rep", "left_semi")
    ids = asked.select(F.col("low").alias("doc_id"))
    chosen = screened(given, ids, "doc_id")[0].join(ids, "doc_id", "left_semi")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [_words(t) for t in batch.column(1).to_pylist()]
            prints = [xxhash.xxh3_128_digest("\0".join(w).encode("utf-8", "surrogatepass")) for w in split]
            sets = [shingles(w, n).tobytes() for w in split]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary()), pa.array(sets, pa.binary())], ["low", "print", "shingles"])

    sets = chosen.mapInArrow(gather, "low long, print binary, shingles binary")
    whole_sets = sets.join(asked, ["low", "print"]).dropDuplicates(["low", "print"]).drop("low", "print")
    ready = likely.join(belongs.groupBy("rep").agg(F.array_sort(F.collect_set("ball")).alias("balls")), "rep").join(whole_sets, "rep")
    found = stored(_meet(ready, part, 1, _verify(threshold), "rep long, links long, root long"), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comps = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    # Of each class the least id and, if that has several texts, the least of their hashes.
    first = least_values(comps, reps.select(F.col("rep").alias("node"), F.struct("low", "print").alias("value")))
    per = reps.select("print", "low", "rep", "copies").join(links, "rep", "left").join(first.withColumnRenamed("node", "rep"), "rep", "left")
    leads = F.coalesce(F.col("least.print") == F.col("print"), F.lit(True))
    per = per.select(F.col("print").alias("p2"), "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("least.low", "low").alias("class_id"), leads.alias("leads"))
    out = signed.select("doc_id", "mark", "print", "size").join(per, F.col("doc_id").isNotNull() & (F.col("size") > 0) & (F.col("print") == F.col("p2")), "left")
    kept = F.coalesce(F.col("leads") & (F.col("class_id") == F.col("doc_id")), F.lit(True))
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("n_links"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), kept.alias("kept"), "mark")


def _words(text: str) -> list[str]:
    """Runs of anything but the six ASCII white space characters."""
    return [w for w in text.translate(_BLANK).split(" ") if w]


_BLANK = {i: " " for i in (9, 10, 11, 12, 13)}


def _meet(rows: DataFrame, part: int, cheaper: int, f, schema: str) -> DataFrame:
    """Brings the members of each ball together, in parts of about ``part`` shingles and
    ``MEMBERS`` members, or of 2,500 if only signatures meet, that meet two by two, and applies f to (rows, own part or not) of each meeting."""
    spark = rows.sparkSession
    cost = F.greatest(F.col("size"), F.lit(part // MEMBERS)) if cheaper == 1 else F.lit(400)
    # Only balls of several parts are looked up, by ball and salt, so that a large one's rows go to many tasks.
    sizes = rows.groupBy("ball").agg(F.ceil(F.sum(cost) / F.lit(part)).cast("int").alias("parts")).where("parts > 1")
    salt = F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")
    large = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met_ = rows.withColumn("salt", salt).join(large, ["ball", "salt"], "left").drop("salt").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = met_.withColumn("own", F.pmod(F.xxhash64(F.lit(1), "rep"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    met = dealt.withColumn("other", other).withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).drop("parts", "other")
    keys = ["ball", "low", "high"]
    ranged = met.repartition(partitions(spark), *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _in_groups(batches, keys):
            if group.num_rows > 1:
                out = f(group)
                if out is not None and out.num_rows:
                    yield out
        trim()

    return ranged.mapInArrow(run, schema)


def _sides(group: pa.Table) -> np.ndarray:
    """Which pairs a meeting of two parts is for: those across, or all if it is of one part with itself."""
    own = group.column("own").to_numpy()
    if group.column("low")[0].as_py() == group.column("high")[0].as_py():
        return np.ones((len(own), len(own)), bool)
    return own[:, None] != own[None]


def _likely(threshold: float, hashes: int):
    """Members with a partner whose signature doesn't rule the threshold out: it agrees in
    no fewer hashes than the mean at the threshold less six standard deviations."""
    least = hashes * threshold - 6 * np.sqrt(hashes * threshold * (1 - threshold))

    def run(group: pa.Table) -> pa.RecordBatch | None:
        marks = np.frombuffer(b"".join(group.column("marks").to_pylist()), np.uint8).reshape(group.num_rows, -1)
        size = group.column("size").to_numpy().astype(float)
        ok = np.zeros(len(marks), bool)
        sides = _sides(group)
        for s in range(0, len(marks), 64):
            agree = (marks[s : s + 64, None] == marks[None]).sum(2)
            fit = (agree >= least) & sides[s : s + 64] & (np.minimum(size[s : s + 64, None], size) >= threshold * np.maximum(size[s : s + 64, None], size))
            fit[np.arange(len(fit)), s + np.arange(len(fit))] = False
            ok[s : s + 64] |= fit.any(1)
        rep, ball = group.column("rep").to_numpy()[ok], group.column("ball").to_numpy()[ok]
        return pa.RecordBatch.from_arrays([pa.array(rep), pa.array(ball)], ["rep", "ball"])

    return run


def _verify(threshold: float):
    def run(group: pa.Table) -> pa.RecordBatch | None:
        sets = [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]
        ball = group.column("ball")[0].as_py()
        met = linked(sets, threshold) & _sides(group)
        earlier = [np.array([x for x in own if x < ball], np.int64) for own in group.column("balls").to_pylist()]
        if sum(len(e) > 0 for e in earlier) > 1:
            met &= shared(earlier) == 0
        rep, copies = group.column("rep").to_numpy(), group.column("copies").to_numpy()
        links = met @ copies
        hit = links > 0
        if not hit.any():
            return None
        root = roots(met, rep)[0]
        return pa.RecordBatch.from_arrays([pa.array(rep[hit]), pa.array(links[hit].astype(np.int64)), pa.array(root[hit])], ["rep", "links", "root"])

    return run


def oracle(threshold: float = 0.8, n: int = 5) -> str:
    """DuckDB SQL over all pairs of distinct texts that share a shingle."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
texts AS (SELECT words, row_number() OVER (ORDER BY min(doc_id), words) AS rep, min(doc_id) AS low, count(*) AS copies FROM w WHERE len(words) > 0 AND doc_id IS NOT NULL GROUP BY words),
s AS (SELECT DISTINCT rep, copies, unnest(CASE WHEN len(words) <= {n} THEN [array_to_string(words, chr(0))]
        ELSE list_transform(range(1, len(words) - {n} + 2), lambda i: array_to_string(words[i:i + {n - 1}], chr(0))) END) AS shingle FROM texts),
z AS (SELECT rep, count(*) AS n FROM s GROUP BY rep),
c AS (SELECT a.rep AS a, b.rep AS b, b.copies AS copies, count(*) AS n FROM s a JOIN s b ON a.shingle = b.shingle AND a.rep <> b.rep GROUP BY ALL),
links AS (SELECT c.a, c.b, c.copies FROM c JOIN z x ON x.rep = c.a JOIN z y ON y.rep = c.b WHERE c.n / (x.n + y.n - c.n) >= {threshold}),
reach AS (SELECT rep AS a, rep AS r FROM texts UNION SELECT l.a, reach.r FROM links l JOIN reach ON l.b = reach.a),
comp AS (SELECT a, min(r) AS c FROM reach GROUP BY a),
k AS (SELECT a, sum(copies) AS n FROM links GROUP BY a)
SELECT w.doc_id, coalesce(top.low, w.doc_id) AS class_id, CAST(coalesce(coalesce(k.n, 0) + t.copies - 1, 0) AS BIGINT) AS n_links, CAST(coalesce(t.copies, 1) AS BIGINT) AS copies
FROM w LEFT JOIN texts t ON t.words = w.words AND w.doc_id IS NOT NULL LEFT JOIN comp ON comp.a = t.rep LEFT JOIN texts top ON top.rep = comp.c LEFT JOIN k ON k.a = t.rep"""
