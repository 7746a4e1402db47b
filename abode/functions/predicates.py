"""Post-filter predicates: parsed request columns x listing columns -> BOOLEAN.

A missing listing value takes the default of a dict lookup (rent 0,
bedrooms 0, type '', flags false, amenities []); a missing constraint passes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from abode.constants import FLAG_COLUMNS
from abode.functions.sqltext import q


def _wants(amen: Column, name: str) -> Column:
    return F.array_contains(amen, F.lit(name))


def price_ok(max_price: Column, rent: Column) -> Column:
    return max_price.isNull() | (F.coalesce(rent, F.lit(0)) <= max_price)


def bedrooms_ok(want: Column, beds: Column) -> Column:
    return want.isNull() | (F.coalesce(beds, F.lit(0)).cast("bigint") == want)


def type_ok(want: Column, ptype: Column) -> Column:
    return want.isNull() | (F.lower(F.coalesce(ptype, F.lit(""))) == want)


def flags_ok(want_amen: Column, c=F.col) -> Column:
    return reduce(lambda a, b: a & b,
                  [~_wants(want_amen, f) | F.coalesce(c(f), F.lit(False)) for f in FLAG_COLUMNS])


def _amen(c=F.col) -> Column:
    return F.coalesce(c("amenities"), F.array().cast("array<string>"))


def _amen_sql() -> str:
    return "coalesce(amenities, CAST(array() AS ARRAY<STRING>))"


def amenity_contains_ok(want_amen: Column, name: str, c=F.col) -> Column:
    """API: the name is a case-insensitive substring of any listing amenity."""
    return ~_wants(want_amen, name) | F.expr(f"exists({_amen_sql()}, a -> contains(lower(a), {q(name)}))")


def amenity_exact_ok(want_amen: Column, name: str, c=F.col) -> Column:
    """UI: the name equals a listing amenity, case-insensitively."""
    return ~_wants(want_amen, name) | F.expr(f"array_contains(transform({_amen_sql()}, a -> lower(a)), {q(name)})")


def all_ok(mode: str = "api", c=F.col) -> Column:
    """Every constraint of the request row against the listing row."""
    want = c("want_amenities")
    other = amenity_contains_ok if mode == "api" else amenity_exact_ok
    return (price_ok(c("max_price"), c("monthly_rent"))
            & bedrooms_ok(c("want_bedrooms"), c("bedrooms"))
            & type_ok(c("want_type"), c("property_type"))
            & flags_ok(want, c)
            & other(want, "pool", c) & other(want, "gym", c))
