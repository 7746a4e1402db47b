"""Corpus statistics (two-phase hash aggregates; hot keys are combined map-side)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abode.functions.derive import numeric_coerce


def stats_overview(listings: DataFrame) -> DataFrame:
    """One row: total, distinct cities, mean/min/max rent, mean sqft (coerced
    numerics; unparsable values are skipped).  An empty corpus yields the
    error row of the reference (``error = 'No data loaded'``)."""
    rent = numeric_coerce(F.col("monthly_rent"))
    sqft = numeric_coerce(F.col("sqft"))
    return listings.agg(
        F.count(F.lit(1)).alias("total_properties"),
        F.countDistinct(F.col("city").cast("string")).alias("cities"),
        F.avg(rent).alias("avg_rent"),
        F.min(rent).alias("min_rent"),
        F.max(rent).alias("max_rent"),
        F.avg(sqft).alias("avg_sqft"),
    ).withColumn("error", F.when(F.col("total_properties") == 0, F.lit("No data loaded")))


def stats_public(listings: DataFrame) -> DataFrame:
    """The public subset: total and distinct cities (0 when absent)."""
    return listings.agg(F.count(F.lit(1)).alias("total_properties"),
                        F.countDistinct(F.col("city").cast("string")).alias("cities"))


def value_counts(listings: DataFrame, col: str) -> DataFrame:
    """Counts by value, most frequent first (ties by value); missing values aren't counted."""
    return (listings.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
                    .orderBy(F.desc("count"), F.asc(col)))


def stats_index(vectors: DataFrame) -> DataFrame:
    """Index size and vector dimension (one two-phase aggregate)."""
    return vectors.agg(F.count("embedding").alias("index_size"),
                       F.max(F.size("embedding")).alias("embedding_dimension"))


def distinct_values(listings: DataFrame, cols=("city", "property_type")) -> DataFrame:
    """Distinct values as rows (field, value) — one row per value, so the
    result never has to fit in a single cell.  One scan: each row fans out
    to one (field, value) pair per column, deduplicated map-side first."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value"))
                                for c in cols]))
    out = listings.select(pairs.alias("p")).select("p.field", "p.value")
    return out.where(F.col("value").isNotNull()).distinct().orderBy("field", "value")


def bedroom_histogram(listings: DataFrame) -> DataFrame:
    """Listings per bedroom count, by key (partial counts combine map-side); missing counts are left out."""
    return (listings.where(F.col("bedrooms").isNotNull()).groupBy("bedrooms").agg(F.count(F.lit(1)).alias("count")).orderBy("bedrooms"))


def top_amenities(listings: DataFrame, n: int = 10) -> DataFrame:
    """Most common amenities over the exploded lists (top-n is the feature)."""
    return (listings.select(F.explode("amenities").alias("amenity"))
                    .groupBy("amenity").agg(F.count(F.lit(1)).alias("count"))
                    .orderBy(F.desc("count"), F.asc("amenity")).limit(n))


def city_counts(listings: DataFrame) -> DataFrame:
    """Listings per city (a hot city is combined map-side); missing cities are left out."""
    return listings.where(F.col("city").isNotNull()).groupBy("city").agg(F.count(F.lit(1)).alias("count")).orderBy("city")


def preview(listings: DataFrame, n: int = 3, cols=("id", "listing_id", "city")) -> DataFrame:
    """First n rows by key (a head() with a total order; the limit is the feature)."""
    return listings.select(*cols).orderBy("id").limit(n)


def column_profile(listings: DataFrame) -> DataFrame:
    """One row per column: (column, position, non_null) — the column list
    printed after a load, with fill counts.  One pass, one aggregate row,
    unpivoted with stack."""
    cols = listings.columns
    counts = listings.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(cols)])
    pairs = ", ".join(f"'{c}', {i}, c{i}" for i, c in enumerate(cols))
    return counts.selectExpr(f"stack({len(cols)}, {pairs}) AS (column, position, non_null)")
