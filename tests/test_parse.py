"""Golden request parse table (API and UI modes) and enhancement."""
import pytest
from pyspark.sql import functions as F

from abode.constants import GOLDEN_MESSAGES, LONG_MAX
from abode.functions.parse import parse_request
from abode.sources.requests import golden_requests

N = None
# qid: (max_price, bedrooms api, bedrooms ui, type, amenities)
GOLDEN = {
    0: (N, 2, N, N, []), 1: (N, N, N, N, ["parking_available", "furnished"]),
    2: (N, 0, 0, "studio", ["gym"]), 3: (N, N, N, "apartment", []), 4: (N, 2, N, N, []),
    5: (N, N, N, "apartment", ["furnished"]), 6: (N, 0, 0, "studio", []), 7: (N, N, N, N, []),
    8: (N, 2, N, N, ["furnished"]), 9: (30000, 2, 2, "apartment", []), 10: (5000, N, N, "house", []),
    11: (6000, N, N, "house", []), 12: (2, N, N, N, []), 13: (4000, N, N, "condo", []),
    14: (3500, N, N, "condo", []), 15: (7000, N, N, N, []), 16: (N, 0, 0, "apartment", ["pool"]),
    17: (N, 11, 1, "house", ["furnished"]), 18: (30000, 3, N, N, ["pet_friendly"]),
    19: (9000, N, N, "house", ["pool", "gym"]), 20: (N, N, N, N, []), 21: (4500, N, N, "condo", []),
    22: (N, N, N, N, []),
}
ENHANCED_SUFFIX = {
    3: " high-end expensive luxury amenities",
    15: " low cost economical",
    19: " low cost economical spacious multiple bedrooms safe neighborhood modern amenities downtown urban",
}


@pytest.fixture(scope="module")
def parsed(spark):
    api = {-r.qid - 1: r for r in parse_request(golden_requests(spark)).collect()}
    ui = {-r.qid - 1: r for r in parse_request(golden_requests(spark), mode="ui").collect()}
    return api, ui


@pytest.mark.parametrize("g", sorted(GOLDEN))
def test_golden_parse(parsed, g):
    api, ui = parsed
    price, beds_api, beds_ui, ptype, amen = GOLDEN[g]
    a, u = api[g], ui[g]
    assert a.max_price == price and u.max_price == price
    assert a.want_bedrooms == beds_api
    assert u.want_bedrooms == beds_ui
    assert a.want_type == ptype and u.want_type == ptype
    assert list(a.want_amenities) == amen
    assert a.enhanced == GOLDEN_MESSAGES[g] + ENHANCED_SUFFIX.get(g, "")


def _parse_one(spark, msg, mode="api"):
    df = spark.createDataFrame([(1, msg)], "qid bigint, msg string")
    return parse_request(df, mode=mode).collect()[0]


@pytest.mark.parametrize("msg,price", [
    ("under +5", 5), ("under -5", -5), ("under 0007", 7), ("under 1__0", None), ("under _1", None),
    ("under 99999999999999999999", LONG_MAX), ("below $1,500", 1500), ("less than 300 max 200", 300), ("max 200 less than 300", 300),
    ("max\t250", 250), ("under 300", 300), ("UNDER 40", 40), ("under", None),
])
def test_price_edge_cases(spark, msg, price):
    assert _parse_one(spark, msg).max_price == price


def test_null_and_empty_message(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "qid bigint, msg string")
    rows = parse_request(df).orderBy("qid").collect()
    for r in rows:
        assert r.enhanced == "" and r.max_price is None and r.want_bedrooms is None
        assert r.want_type is None and list(r.want_amenities) == []


def test_bedroom_overflow_never_matches(spark):
    assert _parse_one(spark, "99999999999999999999 bhk").want_bedrooms == LONG_MAX


def test_mode_validation(spark):
    with pytest.raises(ValueError):
        parse_request(golden_requests(spark), mode="web")
