"""Derived listing columns (Column -> Column), all JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from abode.constants import FLAG_AMENITY


def _s(c: Column) -> Column:
    return c.cast("string")


def price_per_sqft(rent: Column, sqft: Column) -> Column:
    """rent / sqft; zero or missing sqft gives null (pandas would give inf)."""
    return F.try_divide(rent.cast("double"), sqft.cast("double"))


def full_address(street: Column, city: Column, state: Column, zip_code: Column) -> Column:
    """Null-propagating concatenation (concat, not concat_ws)."""
    return F.concat(street, F.lit(", "), city, F.lit(", "), state, F.lit(" "), zip_code)


def bedroom_text(bedrooms: Column, bathrooms: Column) -> Column:
    return (F.when(bedrooms > 0, F.concat(_s(bedrooms), F.lit(" bedroom, "),
                                          _s(bathrooms), F.lit(" bathroom")))
            .otherwise(F.lit("Studio")))


def listing_flags(amenities: Column) -> list[Column]:
    """Four booleans by exact membership of fixed amenity names."""
    return [F.array_contains(amenities, name).alias(flag) for flag, name in FLAG_AMENITY]


def profile_text(c=F.col) -> Column:
    """One searchable text per listing.  Absent numbers print as 'None'
    (bedrooms as 0); no amenities -> 'basic amenities'; no flags ->
    'standard features'; missing description/title -> ''."""
    def num(name):
        return F.coalesce(_s(c(name)), F.lit("None"))

    amen = F.coalesce(F.nullif(F.array_join(F.coalesce(c("amenities"), F.array().cast("array<string>")), ", "),
                               F.lit("")), F.lit("basic amenities"))
    feats = F.concat_ws(", ",
                        F.when(c("pet_friendly"), F.lit("pet-friendly")),
                        F.when(c("parking_available"), F.lit("parking available")),
                        F.when(c("furnished"), F.lit("furnished")),
                        F.when(c("utilities_included"), F.lit("utilities included")))
    feats = F.coalesce(F.nullif(feats, F.lit("")), F.lit("standard features"))
    return F.concat(
        F.coalesce(_s(c("bedrooms")), F.lit("0")), F.lit(" BHK "), num("property_type"),
        F.lit(" in "), num("city"), F.lit(", "), num("state"), F.lit(" "), num("zip_code"),
        F.lit(" with "), num("sqft"), F.lit(" sqft, ₹"), num("monthly_rent"), F.lit(" monthly, "),
        num("bathrooms"), F.lit(" bathrooms, amenities: "), amen, F.lit(", features: "), feats,
        F.lit(". "), F.coalesce(c("description"), F.lit("")), F.lit(" "),
        F.coalesce(c("title"), F.lit("")))


def numeric_coerce(col: Column) -> Column:
    """Text or number -> DOUBLE; anything but a plain decimal number, NaN
    included, is missing: null (skipped by aggregates)."""
    text = F.trim(col.cast("string"))
    return F.when(text.rlike(r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$"), text.try_cast("double"))
