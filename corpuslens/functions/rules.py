"""Dates, windows, ordered rules and statistics in closed form."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_FORMATS = ("yyyy-MM-dd", "MM/dd/yyyy", "MM/dd/yy", "yyyyMMdd")


def parse_date(value: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """First format that fits; an error for other non-blank text; null for blank."""
    trimmed = F.trim(value)
    tried = F.coalesce(*(F.try_to_date(trimmed, f) for f in formats))
    return F.when(F.coalesce(trimmed, F.lit("")) == "", F.lit(None).cast("date")).when(tried.isNotNull(), tried).otherwise(F.raise_error(F.concat(F.lit("not a date: "), trimmed)))


def event_window(announced: Column, effective: Column, *, before: int = 30, after: int = 30, missing: int = 365) -> Column:
    """struct(start, end, status): around an event, by whether its closing is known and not before its announcement."""
    known = effective.isNotNull()
    good = known & (effective >= announced)
    end = F.when(good, F.date_add(effective, after)).otherwise(F.date_add(announced, missing))
    status = F.when(good, "closing_observed").when(known, "invalid_effective_date").otherwise("closing_missing")
    return F.struct(F.date_sub(announced, before).alias("start"), end.alias("end"), status.alias("status"))


def assessment_window(announced: Column, effective: Column, *, before: int = 30, after: int = 30, missing: int = 365) -> Column:
    """As ``event_window`` without a check of the order of the dates."""
    end = F.when(effective.isNotNull(), F.date_add(effective, after)).otherwise(F.date_add(announced, missing))
    return F.struct(F.date_sub(announced, before).alias("start"), end.alias("end"))


def first_match(rules: Iterable[tuple[str, Column]], otherwise: str | None = None) -> Column:
    """The name of the first rule that holds: one CASE, evaluated in order."""
    rules = list(rules)
    out = F.when(rules[0][1], rules[0][0])
    for name, holds in rules[1:]:
        out = out.when(holds, name)
    return out.otherwise(otherwise) if otherwise is not None else out


def all_matches(rules: Iterable[tuple[str, Column]]) -> Column:
    """Names of all rules that hold, in order."""
    return F.filter(F.array(*(F.when(holds, name) for name, holds in rules)), lambda r: r.isNotNull())


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def mapped(value: Column, table: dict[str, str], otherwise: Column | None = None) -> Column:
    """A literal map, with a fallback for other values."""
    lookup = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.coalesce(F.try_element_at(lookup, value), otherwise if otherwise is not None else F.lit(None).cast("string"))


def first_number(*values: Column) -> Column:
    """The first column that is a number once its commas are gone."""
    return F.coalesce(*(F.regexp_replace(v.cast("string"), ",", "").try_cast("double") for v in values))


def as_boolean(value: Column) -> Column:
    """true/false/1/yes/no/0 in any case; an error for anything else; null for blank."""
    v = F.lower(F.trim(value.cast("string")))
    return F.when(v.isin("true", "1", "yes"), True).when(v.isin("false", "0", "no"), False).when(F.coalesce(v, F.lit("")) == "", F.lit(None)).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), v)))


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """struct(low, high) of the score interval, clamped to 0 and 1; null for no trials."""
    n = n.cast("double")
    p = successes / n
    middle, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low, high = F.greatest(F.lit(0.0), (middle - spread) / (1 + z * z / n)), F.least(F.lit(1.0), (middle + spread) / (1 + z * z / n))
    return F.when(n > 0, F.struct(low.alias("low"), high.alias("high")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def top_margin(values: Column) -> Column:
    """The largest value less the next one (or 0)."""
    ordered = F.sort_array(values, asc=False)
    return ordered[0] - F.coalesce(F.try_element_at(ordered, F.lit(2)), F.lit(0.0))
