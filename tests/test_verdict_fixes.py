"""Loader, statistics and skew cases that once lost or invented data."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from abode.functions.derive import numeric_coerce
from abode.operators.stats import city_counts, value_counts
from abode.operators.topk import exact_topk, salted_join
from abode.session import fresh_path
from abode.sources.files import load_listings
from abode.sources.requests import requests_from_table, validate_k


def _local(spark, name):
    import os
    p = fresh_path(spark, name).replace("file:", "")
    os.makedirs(p)
    return p


def test_json_array_folder(spark):
    d = _local(spark, "arrays")
    for n in range(2):
        with open(f"{d}/{n}.json", "w") as f:
            f.write(" " * 1500 + "\n" + json.dumps([{"listing_id": f"L{n}{i}", "monthly_rent": ["25000.0", 25000.0, 25000][i],
                                                     "amenities": ['["gym"]', ["gym"], None][i]} for i in range(3)], indent=1))
    with open(f"{d}/lines.json", "w") as f:
        f.write('{"listing_id": "x", "monthly_rent": 7}\n')
    got = {r["listing_id"]: (r["monthly_rent"], r["amenities"]) for r in load_listings(spark, d, "json").collect()}
    assert len(got) == 7 and got["x"] == (7, []) and got["L00"] == got["L11"] == (25000, ["gym"]) and got["L02"] == (25000, [])


def test_broken_json_fails(spark):
    d = _local(spark, "broken")
    with open(f"{d}/a.json", "w") as f:
        f.write('{"listing_id": "x"}\n{"listing_id": \n')
    with pytest.raises(Exception):
        load_listings(spark, d, "json").collect()


def test_csv_floats_and_headers(spark):
    d = _local(spark, "csv")
    with open(f"{d}/a.csv", "w") as f:
        f.write('listing_id,monthly_rent,bedrooms\nA,25000.0,2.0\nB,,x\n')
    got = {r["listing_id"]: (r["monthly_rent"], r["bedrooms"]) for r in load_listings(spark, d, "csv").collect()}
    assert got == {"A": (25000, 2), "B": (None, None)}
    with open(f"{d}/b.csv", "w") as f:
        f.write('city,listing_id,bedrooms\nRome,C,1\n')
    with pytest.raises(Exception):
        load_listings(spark, d, "csv").collect()


def test_numbers_and_missing_groups(spark):
    d = spark.createDataFrame([("nan",), ("12d",), (" 12 ",), ("1e3",), ("Infinity",), (None,)], "v string")
    assert [r[0] for r in d.select(numeric_coerce(F.col("v"))).collect()] == [None, None, 12.0, 1000.0, None, None]
    c = spark.createDataFrame([("a",), (None,), ("a",)], "city string")
    assert [tuple(r) for r in city_counts(c).collect()] == [("a", 2)] == [tuple(r) for r in value_counts(c, "city").collect()]


def test_null_keys_keep_their_rows(spark):
    left = spark.createDataFrame([(i, None if i % 2 else "k") for i in range(10)], "qid long, key string")
    right = spark.createDataFrame([("k", 1)], "key string, v int")
    got = {r["qid"]: r["v"] for r in salted_join(left, right, "key", "qid", "left").collect()}
    assert got == {i: None if i % 2 else 1 for i in range(10)}
    assert salted_join(left, right, "key", "qid", "inner").count() == 5


def test_dense_ranks_are_the_same_in_any_layout(spark):
    """Copies of vectors tie exactly, whatever the tile shape, and go by key."""
    rng = np.random.default_rng(5)
    vecs = rng.normal(size=(60, 64)).astype("float32")
    q = spark.createDataFrame([(i, vecs[i].tolist(), 50) for i in range(40)], "q long, v array<float>, k int")
    c = spark.createDataFrame([(i, vecs[(i * 7) % 60].tolist()) for i in range(3000)], "id long, v array<float>")
    got = []
    for block_q, block_c in ((4096, 700), (7, 1024), (40, 2048), (13, 16384)):
        r = exact_topk(q, c, qkey="q", qcol="v", kcol="k", ckey="id", ccol="v", block_q=block_q, block_c=block_c)
        got.append(sorted((x["q"], x["rank"], x["id"], x["score"]) for x in r.collect()))
    assert len(got[0]) == 40 * 50 and all(g == got[0] for g in got)
    for (a, _, i, s), (b, _, j, t) in zip(got[0], got[0][1:]):
        assert a != b or s > t or (s == t and i < j)
    bad = spark.createDataFrame([(1, [float("nan")] * 64)], "id long, v array<float>")
    with pytest.raises(Exception, match="infinite"):
        exact_topk(q, bad, qkey="q", qcol="v", kcol="k", ckey="id", ccol="v").collect()


def test_requests_as_given(spark):
    d = spark.createDataFrame([(1, "a", "x"), (2, None, "y")], "qid int, msg string, extra string")
    got = validate_k(requests_from_table(d)).orderBy("qid").collect()
    assert [(r["qid"], r["msg"], r["max_results"], r["vec_id"]) for r in got] == [(1, "a", 10, None), (2, None, 10, None)]
    with pytest.raises(ValueError):
        requests_from_table(d.drop("msg"))


def test_text_rankings_carry_short_keys(spark):
    """Long request texts are ranked under a key of fixed width; equal, null and empty texts share theirs."""
    from abode.operators import search
    from abode.plans import registry as RG
    from conftest import SF001

    lst = RG.listings(spark, SF001)
    long = "apartment with parking " * 20_000
    req = spark.createDataFrame([(1, long, 3), (2, long, 5), (3, None, 2), (4, "", 2), (5, "with apartment parking", 4)],
                                "qid long, enhanced string, max_results int")
    ranked, bound = search.rank_texts(req, lst)
    rows = ranked.collect()
    assert {len(r.qkey) for r in rows} == {32} and len({r.qkey for r in rows}) == 2
    assert bound >= len(rows) == 9
    hits = {r.qid: r.n for r in search.lexical_hits(req, lst).groupBy("qid").agg(F.count("*").alias("n")).collect()}
    assert hits == {1: 3, 2: 5, 5: 4}
