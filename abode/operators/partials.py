"""Statistics kept as partial states: an append reads only what is new.

``add_partials`` reduces one input (a delivery of listings) to rows
(measure, key, n, total, low, high) and to a sketch of its amenities, written
once under the input's name.  States merge by sums, least and greatest values
and sketch unions, so statistics over everything delivered come from the states.

Measures: ``rows``; ``monthly_rent`` and ``sqft`` (coerced numbers; what can't
be read isn't counted); value counts of ``city``, ``property_type``,
``bedrooms`` and ``amenity`` (missing values aren't counted).
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abode.functions.derive import numeric_coerce
from abode.sources.files import _matches, _written

NUMBERS, VALUES = ("monthly_rent", "sqft"), ("city", "property_type", "bedrooms")
# amenities a sketch follows: counts are exact while there are at most three quarters as many
TRACKED = 10_000


def partials(listings: DataFrame) -> DataFrame:
    """The state of ``listings``: one scan, one aggregate that combines before its exchange.
    Empty tables give no rows."""
    def row(measure, key=None, number=None):
        return F.struct(F.lit(measure).alias("measure"), (F.lit(None) if key is None else key).cast("string").alias("key"),
                        (F.lit(None) if number is None else number).cast("double").alias("number"))

    numbers = {c: numeric_coerce(F.col(c)) for c in NUMBERS}
    fixed = F.array(row("rows"), *[F.when(v.isNotNull(), row(c, number=v)) for c, v in numbers.items()],
                    *[F.when(F.col(c).isNotNull(), row(c, F.col(c))) for c in VALUES])
    amenities = F.transform(F.coalesce("amenities", F.array().cast("array<string>")), lambda a: F.when(a.isNotNull(), row("amenity", a)))
    return (listings.select(F.explode(F.concat(fixed, amenities)).alias("r")).where("r is not null").select("r.*").groupBy("measure", "key")
            .agg(F.count("*").alias("n"), F.sum("number").alias("total"), F.min("number").alias("low"), F.max("number").alias("high")))


def amenity_sketch(listings: DataFrame) -> DataFrame:
    """One row: the mergeable frequent-items state of all amenities; none without amenities."""
    each = listings.select(F.explode("amenities").alias("amenity")).where("amenity is not null")
    # grouped by a constant: the aggregate can't be made of an empty partition
    return each.groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_accumulate(amenity, {TRACKED})").alias("state")).select("state")


def add_partials(listings: DataFrame, out: str, name: str) -> bool:
    """Keep the state of ``listings`` under ``name``; False, and nothing read,
    if that is there.  The marker is written last: an input whose state was cut
    off doesn't count and is written again under a new folder."""
    spark = listings.sparkSession
    if _written(spark, f"{out}/input={name}"):
        return False
    folder = f"state-{uuid.uuid4().hex}"
    partials(listings).write.parquet(f"{out}/{folder}/counts")
    amenity_sketch(listings).write.parquet(f"{out}/{folder}/sketch")
    spark.range(1).select(F.lit(folder).alias("folder")).coalesce(1).write.mode("overwrite").parquet(f"{out}/input={name}")
    return True


def _kept(spark: SparkSession, out: str, table: str) -> DataFrame:
    inputs = [f"{out}/{p}" for p in sorted(_matches(spark, f"{out}/input=*")) if _written(spark, f"{out}/{p}")]
    if not inputs:
        raise FileNotFoundError(f"no statistics under {out}")
    folders = [r["folder"] for r in spark.read.parquet(*inputs).select("folder").collect()]  # one name an input
    return spark.read.parquet(*[f"{out}/{f}/{table}" for f in folders])


def merged(spark: SparkSession, out: str) -> DataFrame:
    """The state of all inputs kept under ``out``."""
    return _kept(spark, out, "counts").groupBy("measure", "key").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))


def overview(state: DataFrame) -> DataFrame:
    """``stats_overview`` from a state."""
    def of(measure, value):
        return F.when(F.col("measure") == measure, value)

    total = F.coalesce(F.sum(of("rows", F.col("n"))), F.lit(0))
    mean = {c: (F.sum(of(c, F.col("total"))) / F.sum(of(c, F.col("n")))).alias(f"avg_{s}") for c, s in zip(NUMBERS, ("rent", "sqft"), strict=True)}
    return state.agg(total.alias("total_properties"), F.count(of("city", F.col("key"))).alias("cities"), mean["monthly_rent"],
                     F.min(of("monthly_rent", F.col("low"))).alias("min_rent"), F.max(of("monthly_rent", F.col("high"))).alias("max_rent"),
                     mean["sqft"]).withColumn("error", F.when(F.col("total_properties") == 0, F.lit("No data loaded")))


def counts_of(state: DataFrame, measure: str) -> DataFrame:
    """Exact value counts (value, count) of one measure of a state."""
    return state.where(F.col("measure") == measure).select(F.col("key").alias("value"), F.col("n").alias("count"))


def heavy_hitters(spark: SparkSession, out: str, n: int = 10) -> DataFrame:
    """(amenity, count): the most frequent amenities by the united sketches,
    ties by name.  A sketch that follows m items counts an item wrong by at
    most 3.5 / m of all occurrences, and not at all with under 3 m / 4 items.
    Names that tie with the n-th beyond ten times n aren't compared."""
    found = _kept(spark, out, "sketch").groupBy(F.lit(0).alias("all")).agg(F.expr(f"approx_top_k_combine(state, {TRACKED})").alias("state")).select(
        F.explode(F.expr(f"approx_top_k_estimate(state, {10 * n})")).alias("e"))
    return found.select(F.col("e.item").alias("amenity"), F.col("e.count").alias("count")).orderBy(F.desc("count"), "amenity").limit(n)


def add_all(inputs: dict[str, DataFrame], out: str) -> int:
    """Keep every input; how many were new."""
    return reduce(lambda n, item: n + add_partials(item[1], out, item[0]), inputs.items(), 0)
