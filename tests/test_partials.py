"""Kept statistics equal those of the whole table, after every append."""

import pytest
from pyspark.sql import functions as F

from abode.operators import partials as P
from abode.operators import stats
from abode.plans.registry import listings

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture()
def deliveries(spark):
    whole = listings(spark, SF)
    half = F.col("bedrooms") >= 2
    return whole, {"one": whole.where(half), "two": whole.where(~half | half.isNull())}


def test_appends_equal_the_whole_table(spark, deliveries, tmp_path):
    whole, parts = deliveries
    out = str(tmp_path)
    seen = None
    for name, part in parts.items():
        assert P.add_partials(part, out, name)
        seen = part if seen is None else seen.unionByName(part)
        state = P.merged(spark, out)
        assert P.overview(state).first() == pytest.approx(stats.stats_overview(seen).first())
        assert rows(P.heavy_hitters(spark, out)) == rows(stats.top_amenities(seen))
    assert rows(P.counts_of(state, "city")) == rows(stats.city_counts(whole))
    assert rows(P.counts_of(state, "property_type")) == rows(stats.value_counts(whole, "property_type"))
    assert rows(P.counts_of(state, "bedrooms")) == rows(stats.bedroom_histogram(whole).selectExpr("cast(bedrooms as string)", "count"))


def test_an_input_counts_once(spark, deliveries, tmp_path):
    whole, parts = deliveries
    out = str(tmp_path)
    assert P.add_all(parts, out) == 2
    broken = whole.withColumn("city", F.raise_error(F.lit("read again")).cast("string"))
    assert not P.add_partials(broken, out, "one")  # nothing of it is read
    assert P.overview(P.merged(spark, out)).first()["total_properties"] == whole.count()


def test_cut_off_state_does_not_count(spark, deliveries, tmp_path):
    whole, parts = deliveries
    out = str(tmp_path)
    P.add_partials(parts["one"], out, "one")
    P.add_partials(parts["two"], out, "two")
    (tmp_path / "input=two" / "_SUCCESS").unlink()
    assert P.overview(P.merged(spark, out)).first()["total_properties"] == parts["one"].count()
    assert P.add_partials(parts["two"], out, "two")
    assert P.overview(P.merged(spark, out)).first() == pytest.approx(stats.stats_overview(whole).first())


def test_empty_input_and_no_state(spark, deliveries, tmp_path):
    whole, _ = deliveries
    with pytest.raises(FileNotFoundError):
        P.merged(spark, str(tmp_path))
    P.add_partials(whole.limit(0), str(tmp_path), "none")
    assert P.overview(P.merged(spark, str(tmp_path))).first()["error"] == "No data loaded"
    assert P.heavy_hitters(spark, str(tmp_path)).collect() == []
    P.add_partials(whole, str(tmp_path), "all")
    assert P.overview(P.merged(spark, str(tmp_path))).first() == pytest.approx(stats.stats_overview(whole).first())


def test_nulls(spark, tmp_path):
    t = spark.createDataFrame([(None, None, None, None, None, None), ("12", "x", "a", None, 2, ["p", None, "p"])],
                              "monthly_rent string, sqft string, city string, property_type string, bedrooms int, amenities array<string>")
    got = {(r["measure"], r["key"]): r["n"] for r in P.partials(t).collect()}
    assert got == {("rows", None): 2, ("monthly_rent", None): 1, ("city", "a"): 1, ("bedrooms", "2"): 1, ("amenity", "p"): 2}


def test_many_items_stay_within_the_bound(spark, monkeypatch, tmp_path):
    """Four times as many amenities as a sketch follows: counts stay within the stated bound."""
    monkeypatch.setattr(P, "TRACKED", 512)
    t = spark.range(20_000).select(F.array(F.concat(F.lit("a"), F.when(F.col("id") % 3 == 0, F.col("id") % 5).otherwise(F.col("id") % 2048)).alias("x")).alias("amenities"))
    none = [F.lit(None).cast("string").alias(c) for c in (*P.NUMBERS, *P.VALUES)]
    t = t.select("amenities", *none)
    P.add_all({"a": t.limit(9_000), "b": t.exceptAll(t.limit(9_000))}, str(tmp_path))
    exact = {r["value"]: r["count"] for r in P.counts_of(P.merged(spark, str(tmp_path)), "amenity").collect()}
    n = sum(exact.values())
    got = P.heavy_hitters(spark, str(tmp_path), 5).collect()
    assert {r["amenity"] for r in got} == {f"a{i}" for i in range(5)}
    assert all(abs(r["count"] - exact[r["amenity"]]) <= 3.5 / 512 * n for r in got)
