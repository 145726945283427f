"""Column functions on names, descriptors and signatures. Null gives null unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ONE = r"\[*(?:[BCDFIJSZ]|L[^;]+;)"


def type_id(name: Column) -> Column:
    """``a.b.C``, ``La/b/C;`` and ``a/b/C`` as ``a/b/C``."""
    return F.regexp_replace(F.regexp_replace(F.trim(name), r"^L(.*);$", "$1"), r"\.", "/")


def package_of(name: Column) -> Column:
    """What stands before the last slash, empty if there is none."""
    return F.regexp_extract(name, r"^(.*)/[^/]*$", 1)


def package_prefix(name: Column, parts: int) -> Column:
    """The first parts of a package, or all of it if it has fewer."""
    return F.substring_index(package_of(name), "/", parts)


def parameter_types(descriptor: Column) -> Column:
    """The types between a method descriptor's parentheses."""
    return F.regexp_extract_all(F.regexp_extract(descriptor, r"^\(([^)]*)\)", 1), F.lit(_ONE), F.lit(0))


def return_type(descriptor: Column) -> Column:
    return F.regexp_extract(descriptor, r"\)(.+)$", 1)


def slots(descriptor: Column) -> Column:
    """Stack slots of the parameters: two for long and double, one for all others."""
    kinds = parameter_types(descriptor)
    return F.size(kinds) + F.size(F.filter(kinds, lambda t: t.isin("J", "D")))


def slot_of(descriptor: Column, ordinal: Column, static: Column) -> Column:
    """The first local variable of a parameter."""
    before = F.slice(parameter_types(descriptor), F.lit(1), ordinal)
    return F.size(before) + F.size(F.filter(before, lambda t: t.isin("J", "D"))) + F.when(static, 0).otherwise(1)


def referenced_types(signature: Column) -> Column:
    """Distinct class names in a generic signature, in order."""
    found = F.regexp_extract_all(signature, F.lit(r"L([A-Za-z_$][\w$/]*)[;<]"), F.lit(1))
    return F.array_sort(F.array_distinct(found))


def short_id(key: Column) -> Column:
    return F.substring(F.sha1(key), 1, 8)


def model_source(text: Column) -> Column:
    """A struct kind, arg, element of ``this``, ``argN`` or ``element(...)`` of one of them; kind is null for anything else."""
    at = lambda i: F.regexp_extract(text, r"^(element\()?(this|arg)(\d+)?(\))?$", i)
    sound = text.rlike(r"^(?:element\((?:this|arg\d+)\)|this|arg\d+)$")
    return F.struct(F.when(sound, at(2)).alias("kind"), F.when(sound, at(3).try_cast("int")).alias("arg"), F.coalesce(sound & (at(1) != ""), F.lit(False)).alias("element"))
