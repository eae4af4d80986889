"""Column functions on text, with the semantics that the engine's rules rely on."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode classes and case folding for patterns on questions.
UNICODE = "(?iuU)"


def squeezed(x: Column) -> Column:
    """White space runs as one space, ends trimmed; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "))


def folded(x: Column) -> Column:
    """squeezed and lowered: how names and codes are compared."""
    return F.lower(squeezed(x))


def blank(x: Column) -> Column:
    return F.coalesce(F.trim(x) == "", F.lit(True))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row, also where `use` has it inside of functions on array items."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def matches_any(x: Column, patterns: Iterable[str], prefix: str = UNICODE) -> Column:
    """Whether any pattern is found: one alternation, so one pass of the regex engine."""
    return x.rlike(prefix + "|".join(f"(?:{p})" for p in patterns))


def contains_any(x: Column, parts: Iterable[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | x.contains(p)
    return out


def lines(x: Column) -> Column:
    """Lines at every Unicode line break."""
    return F.split(x, r"\R")


def texts(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def unique_folded(x: Column) -> Column:
    """An array's trimmed items without blanks and later items that are equal when lowered; order stays."""
    empty = F.array().cast("array<string>")
    return F.aggregate(
        F.transform(x, lambda v: F.trim(v)), empty, lambda got, v: F.when((v == "") | F.exists(got, lambda g: F.lower(g) == F.lower(v)), got).otherwise(F.concat(got, F.array(v)))
    )


def sha_key(*parts: Column) -> Column:
    """sha256 over the trimmed parts joined by a bar; null as empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.trim(p), F.lit("")) for p in parts]), 256)


def literal(x: Column) -> Column:
    """A pattern that matches a text as it is."""
    return F.concat(F.lit("\\Q"), F.replace(x, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
