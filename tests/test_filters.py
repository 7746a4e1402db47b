"""Post-filter predicates: golden pass counts over the whole 2,000-listing
table (a brute-force 23 x 2,000 fixture join), monotonicity, null rules."""
import pytest
from pyspark.sql import functions as F

from abode.functions import predicates
from abode.functions.parse import parse_request
from abode.plans import registry as RG
from abode.sources.requests import golden_requests
from conftest import SF01

ROWS_API = [455, 0, 41, 417, 455, 101, 191, 2000, 92, 109, 121, 170, 0, 201, 146, 1588, 0, 0, 0, 5, 2000, 252, 2000]
ROWS_UI = [2000, 0, 0, 417, 2000, 101, 191, 2000, 443, 109, 121, 170, 0, 201, 146, 1588, 0, 0, 0, 0, 2000, 252, 2000]


def _counts(spark, mode):
    p = parse_request(golden_requests(spark), mode=mode).select(
        "qid", "max_price", "want_bedrooms", "want_type", "want_amenities")
    l = RG.listings(spark, SF01)
    x = p.crossJoin(l).filter(predicates.all_ok(mode))  # brute force on the 23-row fixture only
    got = {-r.qid - 1: r["count"] for r in x.groupBy("qid").count().collect()}
    return [got.get(g, 0) for g in range(23)]


@pytest.mark.parametrize("mode,expected", [("api", ROWS_API), ("ui", ROWS_UI)])
def test_golden_pass_counts(spark, mode, expected):
    assert _counts(spark, mode) == expected


def test_missing_listing_values_take_dict_defaults(spark):
    req = spark.createDataFrame(
        [(1, 100, None, None, []), (2, None, 0, None, []), (3, None, None, "house", []),
         (4, None, None, None, ["furnished"]), (5, None, None, None, ["pool"])],
        "qid bigint, max_price bigint, want_bedrooms bigint, want_type string, want_amenities array<string>")
    lst = spark.createDataFrame(
        [(None, None, None, None, None, None, None, None)],
        "monthly_rent bigint, bedrooms int, property_type string, amenities array<string>, "
        "pet_friendly boolean, parking_available boolean, furnished boolean, utilities_included boolean")
    got = {r.qid for r in req.crossJoin(lst).filter(predicates.all_ok("api")).collect()}
    # no rent passes a cap (0 <= 100); no bedroom count is a studio; no type/flag/amenity fails
    assert got == {1, 2}


def test_adding_a_constraint_never_adds_rows(spark):
    l = RG.listings(spark, SF01)
    base = spark.createDataFrame([(1, 8000, None, None, [])],
                                 "qid bigint, max_price bigint, want_bedrooms bigint, want_type string, "
                                 "want_amenities array<string>")
    tighter = base.withColumn("want_type", F.lit("house"))
    n0 = base.crossJoin(l).filter(predicates.all_ok("api")).count()
    n1 = tighter.crossJoin(l).filter(predicates.all_ok("api")).count()
    assert n1 <= n0 and n0 > 0
