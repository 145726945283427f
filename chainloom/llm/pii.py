"""Personal data replaced by format-preserving pseudonyms, in DataFrame functions alone.

A pattern finds candidates, each is validated, and valid ones are permuted within their
format by a keyed Feistel network: two halves in turn add a keyed hash of the other, modulo
their own size. That is a permutation for any key, so equal values get equal pseudonyms in all
documents and different ones stay different. Mail names and secrets are permuted without
regard to case and get their capitals back (a secret all or none), so that spellings of one
value stay linked. Dates that name a day only with the month first, as their day is above 12,
are permuted among such dates: drawn again from all months and days 13 to 31 until the month
has the day, which keeps it a permutation. So no two dates of one written form meet, and none
is read as the other form's; a day keeps one pseudonym in the forms that begin with day or year.

kind      valid if                                   kept of it
card      13 to 19 digits at once or as printed,     first digit, grouping, a right check digit
          Luhn sum right
ssn       area, group and serial in use              dashes; the result is valid too
date      a day of 1890-01-01 and 76,799 days on     order and separators
phone     ten digits, with or without country code   country code, punctuation
ip        four numbers up to 255                     dots
email     name, @, domain                            letters as letters and digits as digits, the domain
key       AKIA and 16 capitals or digits             AKIA
secret    password, token, secret or key = hex       the name, quotes, length

A null text stays null, an empty one empty; texts without a match come back unchanged, very
long ones are read whole. Each row is handled by itself, so repeated rows and ties give
equal rows; other columns pass. Empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS, SEGMENT = 8, 16
EPOCH, DAYS = "1890-01-01", 256 * 300
#: The epoch's year, the months that begin in its days and have days above 12 among them, and how often one is drawn
#: again at most: one in thirty pairs of month and day is none, so that nothing is left after so many.
YEAR, MONTHS, WALK = 1890, 2523, 32
LETTERS, BASE_26 = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdefghijklmnop"
#: Fixed patterns, tried in this order at each place.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
KEY = r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"
SECRET = r"(?<![A-Za-z0-9])(?i:password|passwd|token|secret|api_?key) ?[=:] ?[\"']?[0-9a-fA-F]{12,128}+(?![A-Za-z0-9])"
IP = r"(?<![0-9.])(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}(?![0-9]|\.[0-9])"
DATE = r"(?<![0-9./-])(?:[0-9]{4}(?<a>[-/.])[0-9]{2}\k<a>[0-9]{2}|[0-9]{2}(?<b>[-/.])[0-9]{2}\k<b>[0-9]{4})(?![0-9]|[./-][0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
PHONE = r"(?<![0-9+])(?:\+?[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-]?[0-9]{4}(?![0-9]|[.-][0-9])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}+|[0-9]{4}(?<c>[ -])[0-9]{4}\k<c>[0-9]{4}\k<c>[0-9]{4}|[0-9]{4}(?<d>[ -])[0-9]{6}\k<d>[0-9]{5})(?![0-9]|-[0-9])"
KINDS = ("email", "key", "secret", "ip", "date", "ssn", "card", "phone")
ANY = "|".join((EMAIL, KEY, SECRET, IP, DATE, SSN, CARD, PHONE))


def _hash(key: str, tweak: Column, step: Column, half: Column) -> Column:
    """60 bits of a keyed SHA-256."""
    text = F.concat_ws("|", F.lit(key), tweak, step.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: str, tweak: Column) -> Column:
    """A struct l, r: the permuted halves, l below left_size and r below right_size."""
    begin = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"), left_size.cast("long").alias("ls"), right_size.cast("long").alias("rs"))
    turn = lambda s, i: F.struct(s["r"].alias("l"), F.pmod(s["l"] + F.pmod(_hash(key, tweak, i, s["r"]), s["ls"]), s["ls"]).alias("r"), s["rs"].alias("ls"), s["ls"].alias("rs"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), begin, turn)


def symbols(text: Column, radix: int, key: str, tweak: str) -> Column:
    """Permutes a string of digits of this radix among those of its length, in segments."""

    def segment(i: Column) -> Column:
        part = F.substring(text, i * SEGMENT + 1, F.lit(SEGMENT))
        n = F.length(part)
        a = F.floor(n / 2).cast("int")
        number = lambda s: F.coalesce(F.conv(F.when(F.length(s) > 0, s).otherwise("0"), radix, 10).cast("long"), F.lit(0))
        size = lambda k: F.pow(F.lit(float(radix)), k).cast("long")
        about = F.concat_ws("|", F.lit(tweak), i.cast("string"), F.length(text).cast("string"))
        got = feistel(number(F.substring(part, F.lit(1), a)), number(F.substring(part, a + 1, n - a)), size(a), size(n - a), key, about)
        show = lambda x, k: F.when(k > 0, F.lpad(F.conv(x.cast("string"), 10, radix), k, F.lit("0"))).otherwise("")
        return F.transform(F.array(got), lambda g: F.concat(show(g["l"], a), show(g["r"], n - a)))[0]

    return F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / SEGMENT).cast("int"), F.lit(1)) - 1), segment), "")


def refill(form: Column, what: str, new: Column) -> Column:
    """``form`` with its characters of class ``what`` replaced in turn by those of ``new``."""
    begin = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def put(s: Column, c: Column) -> Column:
        hit = c.rlike(what)
        return F.struct(F.concat(s["out"], F.when(hit, F.substring(new, s["at"], F.lit(1))).otherwise(c)).alias("out"), (s["at"] + hit.cast("int")).alias("at"))

    return F.aggregate(F.split(form, ""), begin, put)["out"]


def luhn_sum(digits: Column, first: int) -> Column:
    """Sum over digits from the right; the first has weight ``first``, 1 or 2, then they alternate."""

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * F.when((i + first) % 2 == 1, 1).otherwise(2)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def _only(text: Column, what: str) -> Column:
    return F.regexp_replace(text, f"[^{what}]", "")


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.transform(F.array(value), f)[0]


def is_card(m: Column) -> Column:
    return m.rlike(f"^{CARD}$") & (luhn_sum(_only(m, "0-9"), 1) % 10 == 0)


def _card(m: Column, key: str) -> Column:
    def new(d: Column) -> Column:
        n = F.length(d)
        body = F.concat(F.substring(d, 1, 1), symbols(F.substring(d, F.lit(2), n - 2), 10, key, "card"))
        return _let(body, lambda b: F.concat(b, F.pmod(-luhn_sum(b, 2), F.lit(10)).cast("string")))

    return refill(m, "[0-9]", _let(_only(m, "0-9"), new))


def is_ssn(m: Column) -> Column:
    return m.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    place = area - F.when(area > 666, 2).otherwise(1)
    got = feistel(place, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, F.lit("ssn"))
    show = lambda g: F.concat_ws("-", F.lpad((g["l"] + F.when(g["l"] >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((F.floor(g["r"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((g["r"] % 9999 + 1).cast("string"), 4, "0"))
    return _let(got, show)


def _day(m: Column) -> Column:
    """Days since the epoch of a date in either order, null if there is no such day."""
    plain = F.regexp_replace(m, "[/.]", "-")
    of = lambda form: F.datediff(F.to_date(F.try_to_timestamp(plain, F.lit(form))), F.lit(EPOCH).cast("date"))
    day_first, month_first = of("dd-MM-yyyy"), of("MM-dd-yyyy")
    return F.when(m.rlike(r"^[0-9]{4}\D"), of("yyyy-MM-dd")).when(m.rlike(r"^[0-9]{2}\D[0-9]{2}\D"), F.coalesce(day_first, month_first))


def _month_first(m: Column) -> Column:
    """Whether a date with the year last names a day only if its month comes first."""
    return F.substring(m, 4, 2).cast("int") > 12


def is_date(m: Column) -> Column:
    return F.coalesce(_day(m).between(0, DAYS - 1), F.lit(False))


def _shown(month: Column, day: Column) -> Column:
    """The date of a day in the month so many after the epoch's."""
    return F.make_date((F.floor(month / 12) + YEAR).cast("int"), (F.pmod(month, F.lit(12)) + 1).cast("int"), day)


def _late_day(m: Column, key: str) -> Column:
    """The pseudonym, as a date, of one with the month first and a day above 12."""
    month = (F.substring(m, 7, 4).cast("int") - YEAR) * 12 + F.substring(m, 1, 2).cast("int") - 1
    draw = lambda l, r: feistel(l, r, F.lit(MONTHS), F.lit(19), key, F.lit("late"))  # noqa: E731, E741
    exists = lambda s: s["r"] + 13 <= F.day(F.last_day(_shown(s["l"], F.lit(1))))
    again = lambda s, i: F.when(exists(s), s).otherwise(draw(s["l"], s["r"]))
    got = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), draw(month, F.substring(m, 4, 2).cast("int") - 13), again)
    return _let(got, lambda g: _shown(g["l"], (g["r"] + 13).cast("int")))


def _date(m: Column, key: str) -> Column:
    got = _let(_day(m), lambda d: feistel(F.floor(d / 300), d % 300, F.lit(256), F.lit(300), key, F.lit("date")))
    day = F.date_add(F.lit(EPOCH).cast("date"), (got["l"] * 300 + got["r"]).cast("int"))
    digits = F.when(m.rlike(r"^[0-9]{4}\D"), F.date_format(day, "yyyyMMdd")).when(_month_first(m), F.date_format(_late_day(m, key), "MMddyyyy")).otherwise(F.date_format(day, "ddMMyyyy"))
    return refill(m, "[0-9]", digits)


def _phone(m: Column, key: str) -> Column:
    body = F.regexp_extract(m, r"((?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-]?[0-9]{4})$", 1)
    head = F.substring(m, F.lit(1), F.length(m) - F.length(body))
    return F.concat(head, refill(body, "[0-9]", symbols(_only(body, "0-9"), 10, key, "phone")))


def _ip(m: Column, key: str) -> Column:
    n = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    got = feistel(n[0] * 256 + n[1], n[2] * 256 + n[3], F.lit(65536), F.lit(65536), key, F.lit("ip"))
    return _let(got, lambda g: F.concat_ws(".", F.floor(g["l"] / 256).cast("string"), (g["l"] % 256).cast("string"), F.floor(g["r"] / 256).cast("string"), (g["r"] % 256).cast("string")))


def _cased(new: Column, like: Column) -> Column:
    """``new`` with a capital wherever ``like``, of the same length, has one."""
    return F.array_join(F.zip_with(F.split(new, ""), F.split(like, ""), lambda n, o: F.when(o.rlike("[A-Z]"), F.upper(n)).otherwise(n)), "")


def _email(m: Column, key: str) -> Column:
    written = F.substring_index(m, "@", 1)
    name = F.lower(written)
    letters = F.translate(symbols(F.translate(_only(name, "a-z"), LETTERS, BASE_26), 26, key, "email"), BASE_26.upper(), LETTERS)
    named = refill(refill(name, "[0-9]", symbols(_only(name, "0-9"), 10, key, "email")), "[a-z]", letters)
    return F.concat(_cased(named, written), F.lit("@"), F.substring_index(m, "@", -1))


def _key(m: Column, key: str) -> Column:
    return F.concat(F.lit("AKIA"), symbols(F.substring(m, 5, 16), 36, key, "key"))


def _secret(m: Column, key: str) -> Column:
    body = F.regexp_extract(m, "([0-9a-fA-F]{12,})$", 1)
    new = F.lower(symbols(F.lower(body), 16, key, "secret"))
    capital = body.rlike("[A-F]") & ~body.rlike("[a-f]")  # digits may become letters: one case for all
    return F.concat(F.substring(m, F.lit(1), F.length(m) - F.length(body)), F.when(capital, F.upper(new)).otherwise(new))


def kind_of(m: Column) -> Column:
    """The kind of a candidate, null if it isn't valid."""
    return (
        F.when(m.contains("@"), "email").when(m.rlike(f"^{KEY}$"), "key").when(m.rlike(f"^{SECRET}$"), "secret").when(m.rlike(f"^{IP}$"), "ip")
        .when(is_date(m), "date").when(is_ssn(m), "ssn").when(is_card(m), "card").when(m.rlike(f"^{PHONE}$"), "phone")
    )


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    makers = {"email": _email, "key": _key, "secret": _secret, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}
    out = F.when(kind.isNull(), m)
    for name, make in makers.items():
        out = out.when(kind == name, make(m, key))
    return out


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the text replaced, and ``pii``: an array of the kinds replaced, in the order of their places.

    A column ``pii`` of the input is replaced; all others pass, whatever their names.
    """
    text = F.col(text_col)
    new = "new" + "_" * max(map(len, docs.columns))  # no column has this name
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    judged = F.transform(found, lambda m: _let(kind_of(m), lambda k: F.struct(k.alias("kind"), pseudonym(m, k, key).alias("new"))))
    parts = docs.withColumn(new, judged)
    joined = F.array_join(F.zip_with(F.split(text, ANY, -1), F.col(new), lambda gap, p: F.concat(gap, F.coalesce(p["new"], F.lit("")))), "")
    any_ = F.size(new) > 0
    return parts.withColumns({text_col: F.when(any_, joined).otherwise(text), "pii": F.coalesce(F.filter(F.transform(new, lambda p: p["kind"]), lambda k: k.isNotNull()), F.array().cast("array<string>"))}).drop(new)
