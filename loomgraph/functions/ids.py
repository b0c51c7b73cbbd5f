"""Identifiers as column expressions: ``a.b.C``, ``a.b.C#m(p1,p2)``, ``a.b.C#f``, ``GET:/path``.

Parameters are split at every comma, so a generic type with commas counts as several: approximate on purpose.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def class_of(fqn: Column) -> Column:
    return F.split_part(fqn, F.lit("#"), F.lit(1))


def method_name(fqn: Column) -> Column:
    """Between ``#`` and ``(``; the whole text without ``#``."""
    return F.when(fqn.contains("#"), F.split_part(F.split_part(fqn, F.lit("#"), F.lit(2)), F.lit("("), F.lit(1))).otherwise(fqn)


def package_of(class_fqn: Column) -> Column:
    return F.regexp_extract(class_fqn, r"^(.*)\.[^.]*$", 1)


def simple_class(class_fqn: Column) -> Column:
    return F.substring_index(F.substring_index(class_fqn, ".", -1), "$", -1)


def is_constructor(fqn: Column) -> Column:
    return fqn.contains("#") & (method_name(fqn) == simple_class(class_of(fqn)))


def params_text(fqn: Column) -> Column:
    return F.regexp_extract(fqn, r"\((.*)\)", 1)


def param_count(fqn: Column) -> Column:
    p = params_text(fqn)
    return F.when(p == "", 0).otherwise(F.size(F.split(p, ",")))


def short_params(fqn: Column, sep: str = ",") -> Column:
    parts = F.transform(F.split(params_text(fqn), ","), lambda x: F.substring_index(F.trim(x), ".", -1))
    return F.array_join(parts, sep)


def endpoint_id(verb: Column, path: Column) -> Column:
    return F.concat(verb, F.lit(":"), path)


def is_external(external: Column) -> Column:
    return F.coalesce(external, F.lit(False))


def is_accessor(fqn: Column) -> Column:
    """get/set/is with at most one parameter; also anything without ``#`` or ``(``."""
    named = method_name(fqn).rlike("^(get|set|is)")
    return ~fqn.contains("#") | ~fqn.contains("(") | (named & (param_count(fqn) <= 1))


#: Names that say nothing about a program.
TRIVIAL_NAMES = ("toString", "hashCode", "equals", "clone", "finalize")


def is_trivial(name: Column, line_start: Column, line_end: Column) -> Column:
    short = F.coalesce(line_end, F.lit(0)) - F.coalesce(line_start, F.lit(0)) <= 3
    return name.isin(*TRIVIAL_NAMES) | (short & name.rlike(r"^(get|set|is|has|can)\p{Lu}"))
