"""URL filter: host and path rules first, then a weighted vocabulary.

The vocabulary is a table of terms with weights, ``VOCABULARY`` or one's own. A weight of
``STRICT`` rejects at once. Lighter, soft terms reject if at least ``soft_hits`` distinct
ones stand in the URL and their weights sum to ``soft_weight`` or more. An Aho-Corasick
automaton over all terms finds them in one pass; a hit counts only if no ASCII letter or digit stands right before or after it.

Null URLs and URLs without ``://`` have an empty host and path; the vocabulary is still
applied to what text there is. Very long URLs are judged whole, repeated rows each by
itself; among rules of one length that fit, which can't differ in host and path, ties don't
arise. Columns of the input other than the id and the URL don't reach the result, whatever
their names. Empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRICT, SOFT_HITS, SOFT_WEIGHT, MOST_TERMS = 9, 2, 4, 200_000
#: Weight, then the terms that have it.
VOCABULARY = """
9 casino porn porno pornhub xxx viagra cialis levitra pill pills spam escort malware warez phishing hentai camgirl keygen ransomware spyware botnet carding nude bukkake milf fetish steroid
3 bet bets betting gambling gamble jackpot roulette blackjack slot slots poker bookie adult erotic erotica sex sexy cam crack cracked nulled torrent pirate payday tramadol xanax ambien replica counterfeit doorway adserver adclick popunder clickbait
2 free cheap win winner prize prizes lottery loan loans credit debt bonus deal deals discount coupon offer ad ads banner banners track tracker affiliate promo sponsor pop popup redirect click download serial farm pharma pharmacy drug drugs diet weight slim hack hacker cheat exploit leak leaked forex crypto bitcoin airdrop profit rich cash money instant guarantee hot single dating hookup girl babe lingerie vip
1 buy sale order best top now today online fast easy secret miracle amazing exclusive limited save earn income work home pay paid bill fund rate quote insurance mortgage refinance clearance outlet wholesale rx generic gift card giveaway contest survey reward trial login verify account secure update confirm unlock proxy mirror stream watch hd movie mp3 apk mod
"""


def vocabulary(text: str = VOCABULARY) -> dict[str, int]:
    """Terms with weights from lines of a weight and its terms; of several weights a term has the first."""
    out: dict[str, int] = {}
    for weight, *terms in map(str.split, text.strip().splitlines()):
        for term in terms:
            out.setdefault(term, int(weight))
    return out


def vocabulary_of(table: DataFrame, term_col: str = "term", weight_col: str = "weight") -> dict[str, int]:
    """The same from a table of at most ``MOST_TERMS`` rows, in lower case; rows with a null or empty term don't count."""
    rows = table.select(lower_ascii(F.col(term_col)).alias("term"), F.col(weight_col).cast("int").alias("weight")).where("term <> '' and weight is not null").groupBy("term").agg(F.max("weight").alias("weight")).limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"a vocabulary of more than {MOST_TERMS} terms")
    return {r["term"]: r["weight"] for r in rows}


#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://``: the host up to / ? or #, and the path up to ? or #."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The text and the verdict of the longest rule that fits, null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(start))
        rule, verdict = F.when(fits, name + start).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def automaton(terms: dict[str, int]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term, weight in terms.items():
        found.add_word(term, (len(term), term, weight))
    found.make_automaton()
    return found


def hits(url: str | None, machine: ahocorasick.Automaton) -> tuple[int, int, int]:
    """Distinct strict terms, distinct soft terms, and the weight of these, that stand as whole words in the URL."""
    if not url:
        return 0, 0, 0
    text, found = url.translate(_UPPER), {}
    for end, (size, term, weight) in machine.iter(text):
        start = end - size + 1
        if (start == 0 or text[start - 1] not in _ALNUM) and (end + 1 == len(text) or text[end + 1] not in _ALNUM):
            found[term] = weight
    soft = [w for w in found.values() if w < STRICT]
    return len(found) - len(soft), len(soft), sum(soft)


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", terms: dict[str, int] | None = None, soft_hits: int = SOFT_HITS, soft_weight: int = SOFT_WEIGHT, rules=RULES) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, strict_hits, soft_hits, soft_weight."""
    given = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    own = vocabulary() if terms is None else terms

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(own)
        for batch in batches:
            found = [hits(u, machine) for u in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([f[k] for f in found], pa.int32()) for k in range(3))], ["page_id", "url", "strict_hits", "soft_hits", "soft_weight"])

    kind = given.schema["page_id"].dataType.simpleString()
    counted = given.mapInArrow(count, f"page_id {kind}, url string, strict_hits int, soft_hits int, soft_weight int")
    host, path = host_path(F.col("url"))
    split = counted.withColumns({"host": host, "path": path})
    rule, says = longest_rule(F.col("host"), F.col("path"), rules)
    method = F.when((F.col("strict_hits") >= 1) | ((F.col("soft_hits") >= soft_hits) & (F.col("soft_weight") >= soft_weight)), "block").otherwise("allow")
    return split.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, method).alias("verdict"), "strict_hits", "soft_hits", "soft_weight")


def oracle() -> str:
    """DuckDB SQL for the columns of the registered query."""
    text = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    terms = vocabulary()
    values = ", ".join(f"('{t}', {w})" for t, w in terms.items())
    rest = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
    fits = lambda r: f"(host = '{r[0]}' OR ends_with(host, '.{r[0]}')) AND starts_with(path, '{r[1]}')"
    order = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    rule = " ".join(f"WHEN {fits(r)} THEN '{r[0]}{r[1]}'" for r in order)
    says = " ".join(f"WHEN {fits(r)} THEN '{r[2]}'" for r in order)
    return f"""
WITH p AS (SELECT page_id, {text} AS t, coalesce({rest}, '') AS rest FROM pages),
q AS (SELECT page_id, t, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
terms(term, weight) AS (VALUES {values}),
urls AS (SELECT DISTINCT t FROM q),
n AS (SELECT t, CAST(count(*) FILTER (weight >= {STRICT}) AS INT) AS strict_hits, CAST(count(*) FILTER (weight < {STRICT}) AS INT) AS soft_hits, CAST(sum(CASE WHEN weight < {STRICT} THEN weight ELSE 0 END) AS INT) AS soft_weight
      FROM urls JOIN terms ON strpos(t, term) > 0 AND regexp_matches(t, '(^|[^a-z0-9])' || term || '([^a-z0-9]|$)') GROUP BY t),
h AS (SELECT page_id, host, path, coalesce(strict_hits, 0) AS strict_hits, coalesce(soft_hits, 0) AS soft_hits, coalesce(soft_weight, 0) AS soft_weight FROM q LEFT JOIN n USING (t))
SELECT page_id, host, path, CASE {rule} END AS rule,
       CASE {says} WHEN strict_hits >= 1 OR (soft_hits >= {SOFT_HITS} AND soft_weight >= {SOFT_WEIGHT}) THEN 'block' ELSE 'allow' END AS verdict,
       strict_hits, soft_hits, soft_weight FROM h"""
