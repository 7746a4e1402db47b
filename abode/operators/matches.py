"""Requests against the whole listing table: how many listings meet all
constraints of each request (F1-F7 without a ranking in between).

Neither side is paired with the other:

* requests shrink to their distinct constraints (price cap, bedrooms, type,
  set of wanted amenities as bits);
* listings shrink to grid cells (bedrooms, type, set of amenities as bits,
  rent) with a count, in one map-side combined aggregate;
* containment of amenity sets becomes equality: a cell is counted under each
  asked set that its own holds, and under "any" bedrooms or type where asked.
  The asked shapes (with or without bedrooms, with or without type, amenity
  set) are at most ``4 * 2^6``;
* a price cap is a running count over rent.  Rents lie in bands: a window over
  the bands of a key gives what is below a band, a window over one band's rents
  and caps gives the rest, so no window holds more than ``BAND`` rents or the
  number of bands.

Missing listing values take the predicates' defaults; a missing constraint
passes; every request gets a row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abode.constants import FLAG_COLUMNS
from abode.functions import predicates
from abode.operators.topk import salted_join
from abode.session import shared_dir

BAND = 1024
OTHER_AMENITIES = ("pool", "gym")
WANTS = (*FLAG_COLUMNS, *OTHER_AMENITIES)
SMALL_SIGNATURES = 200_000  # rows of a short text and a number that are broadcast


def wanted_bits(want: Column) -> Column:
    return reduce(lambda a, b: a + b, [F.when(F.array_contains(want, F.lit(w)), F.lit(1 << i)).otherwise(F.lit(0)) for i, w in enumerate(WANTS)])


def offered_bits(mode: str) -> Column:
    """The amenities of ``WANTS`` that a listing has, by the mode's rule."""
    one = predicates.amenity_contains_ok if mode == "api" else predicates.amenity_exact_ok
    has = [F.coalesce(F.col(f), F.lit(False)) for f in FLAG_COLUMNS] + [one(F.array(F.lit(a)), a) for a in OTHER_AMENITIES]
    return reduce(lambda a, b: a + b, [F.when(h, F.lit(1 << i)).otherwise(F.lit(0)) for i, h in enumerate(has)])


def listing_cells(listings: DataFrame, mode: str) -> DataFrame:
    """bedrooms, kind, bits, rent, n: one row per grid cell and rent."""
    return (listings.select(F.coalesce("bedrooms", F.lit(0)).cast("long").alias("bedrooms"), F.lower(F.coalesce("property_type", F.lit(""))).alias("kind"),
                            offered_bits(mode).alias("bits"), F.coalesce("monthly_rent", F.lit(0)).cast("long").alias("rent"))
            .groupBy("bedrooms", "kind", "bits", "rent").agg(F.count("*").alias("n")))


def signature(parsed: DataFrame) -> Column:
    """A request's constraints as one text."""
    return F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("-")) for c in (
        F.col("max_price"), F.col("want_bedrooms"), wanted_bits(F.col("want_amenities")), F.col("want_type"))])


def matching_counts(parsed: DataFrame, listings: DataFrame, mode: str = "api", band: int = BAND) -> DataFrame:
    """(qid, matches) for parsed requests: listings of the whole table that meet all constraints."""
    want = parsed.select("qid", signature(parsed).alias("sig"), F.col("max_price").cast("long").alias("cap"), F.col("want_bedrooms").cast("long").alias("bedrooms"),
                         F.col("want_type").alias("kind"), wanted_bits(F.col("want_amenities")).alias("bits"))
    asked = want.groupBy("sig").agg(*[F.first(c).alias(c) for c in ("cap", "bedrooms", "kind", "bits")])  # equal within a signature
    shared_dir(parsed.sparkSession)  # checkpoints go there
    asked = asked.withColumns({"b": F.coalesce("bedrooms", F.lit(-1)), "t": F.coalesce("kind", F.lit("*")), "any_b": F.col("bedrooms").isNull(),
                               "any_t": F.col("kind").isNull()}).checkpoint(eager=True)
    shapes = asked.select("any_b", "any_t", "bits").distinct().collect()  # 4 * 2^6 rows at most
    key = ["any_b", "any_t", "b", "t", "mask"]
    if not shapes:
        return parsed.select("qid", F.lit(0).cast("long").alias("matches"))
    shape = F.array(*[F.struct(F.lit(s["any_b"]).alias("any_b"), F.lit(s["any_t"]).alias("any_t"), F.lit(s["bits"]).alias("mask")) for s in shapes])
    cells = (listing_cells(listings, mode).withColumn("s", F.explode(F.filter(shape, lambda s: F.col("bits").bitwiseAND(s["mask"]) == s["mask"])))
             .select("s.any_b", "s.any_t", F.when(F.col("s.any_b"), F.lit(-1)).otherwise(F.col("bedrooms")).alias("b"),
                     F.when(F.col("s.any_t"), F.lit("*")).otherwise(F.col("kind")).alias("t"), F.col("s.mask"), "rent", "n")
             .groupBy(*key, "rent").agg(F.sum("n").alias("n"))).checkpoint(eager=True)  # read three times; no larger than the grid
    asked = asked.withColumnRenamed("bits", "mask")

    def in_bands(df: DataFrame, value: str) -> DataFrame:
        return df.withColumn("band", F.floor(F.col(value) / band).cast("long"))

    # below: the listings of a key in the bands before; points of both kinds in one stream of bands
    none = F.lit(None).cast("string")
    bands = in_bands(cells, "rent").groupBy(*key, "band").agg(F.sum("n").alias("n"))
    no_cap = asked.where("cap is null").select("sig", *key)
    capped = in_bands(asked.where("cap is not null"), "cap")
    before = Window.partitionBy(*key).orderBy("band").rangeBetween(Window.unboundedPreceding, -1)
    marks = capped.select(*key, "band").distinct().withColumn("n", F.lit(0).cast("long"))
    below = (bands.unionByName(marks).groupBy(*key, "band").agg(F.sum("n").alias("n"))
             .withColumn("below", F.coalesce(F.sum("n").over(before), F.lit(0))).select(*key, "band", "below"))
    upto = Window.partitionBy(*key, "band").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    points = in_bands(cells, "rent").select(*key, "band", F.col("rent").alias("at"), "n", none.alias("sig")).unionByName(
        capped.select(*key, "band", F.col("cap").alias("at"), F.lit(0).cast("long").alias("n"), "sig"))
    within = points.withColumn("inside", F.sum("n").over(upto)).where("sig is not null").select("sig", *key, "band", "inside")
    counted = within.join(below, [*key, "band"]).select("sig", (F.col("inside") + F.col("below")).alias("matches"))
    whole = no_cap.join(bands.groupBy(*key).agg(F.sum("n").alias("matches")), key, "left").select("sig", F.coalesce("matches", F.lit(0)).alias("matches"))
    found = counted.unionByName(whole).checkpoint(eager=True)
    rows = want.select("qid", "sig")
    if found.count() <= SMALL_SIGNATURES:
        out = rows.join(F.broadcast(found), "sig", "left")
    else:
        out = salted_join(rows, found, "sig", "qid", "left")  # hot signatures are spread
    return out.select("qid", F.coalesce("matches", F.lit(0)).cast("long").alias("matches"))
