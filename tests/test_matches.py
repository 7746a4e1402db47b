"""Requests against all listings: golden counts, plain loops, missing values, hot bands."""
import random

import pytest
from pyspark.sql import functions as F

from abode.constants import FLAG_COLUMNS
from abode.functions.parse import parse_request
from abode.operators.matches import matching_counts
from abode.plans import registry as RG
from abode.sources.requests import golden_requests
from conftest import SF01

API = [455, 0, 41, 417, 455, 101, 191, 2000, 92, 109, 121, 170, 0, 201, 146, 1588, 0, 0, 0, 5, 2000, 252, 2000]
UI = [2000, 0, 0, 417, 2000, 101, 191, 2000, 443, 109, 121, 170, 0, 201, 146, 1588, 0, 0, 0, 0, 2000, 252, 2000]


@pytest.mark.parametrize("mode, want", [("api", API), ("ui", UI)])
def test_golden_counts(spark, mode, want):
    got = {-r.qid - 1: r.matches for r in matching_counts(parse_request(golden_requests(spark), mode=mode), RG.listings(spark, SF01), mode).collect()}
    assert [got[i] for i in range(23)] == want


def plain(q, l):
    _, cap, beds, kind, amen = q
    rent, b, t, names, flags = l
    ok = (cap is None or (rent or 0) <= cap) and (beds is None or (b or 0) == beds) and (kind is None or (t or "").lower() == kind)
    for f, v in zip(FLAG_COLUMNS, flags, strict=True):
        ok = ok and (f not in amen or bool(v))
    return ok and all(a not in amen or any(a in x.lower() for x in names or []) for a in ("pool", "gym"))


@pytest.mark.parametrize("band", [1, 7, 1024])
def test_against_plain_loops(spark, band):
    rng = random.Random(band)
    pick = lambda *x: rng.choice(x)
    listings = [(pick(None, -5, 0, 3, 50, 51, 52, 2000), pick(None, 0, 1, 2), pick(None, "", "House", "condo"), pick(None, [], ["Swimming POOL"], ["Gym", "x"], ["pool", "gym"]),
                 tuple(pick(None, True, False) for _ in FLAG_COLUMNS)) for _ in range(300)]
    requests = [(i, pick(None, -6, 0, 50, 51, 10**12), pick(None, None, 0, 1, 9), pick(None, None, "house", "studio"),
                 sorted({pick("pool", "gym", FLAG_COLUMNS[0], FLAG_COLUMNS[2]) for _ in range(rng.randrange(3))})) for i in range(60)]
    lst = spark.createDataFrame([(*x[:4], *x[4]) for x in listings], "monthly_rent long, bedrooms int, property_type string, amenities array<string>, "
                                + ", ".join(f"{f} boolean" for f in FLAG_COLUMNS)).withColumns({"n": F.lit("clash"), "kind": F.lit(1)})
    req = spark.createDataFrame(requests, "qid long, max_price long, want_bedrooms int, want_type string, want_amenities array<string>")
    got = dict(tuple(r) for r in matching_counts(req, lst, band=band).collect())
    assert got == {q[0]: sum(plain(q, x) for x in listings) for q in requests}
    none = dict(tuple(r) for r in matching_counts(req, lst.where("false"), band=band).collect())
    assert none == dict.fromkeys(range(60), 0)
    assert matching_counts(req.where("false"), lst).collect() == []
