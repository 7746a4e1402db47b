"""File fixtures: JSON lines, JSON array document, CSV (JSON and Python-repr
amenities), unsupported extension, missing corpus, nulls, sqft 0, duplicate
listing ids, empty table, non-numeric rent."""
import json
import os

import pytest
from pyspark.sql import functions as F

from abode.functions.derive import numeric_coerce, profile_text
from abode.operators import stats
from abode.plans import registry as RG
from abode.sources import files
from conftest import SF001


def _local(p):
    return p[len("file:"):] if p.startswith("file:") else p


def _rows(df):
    return sorted(tuple(r) for r in RG._listing_out(df).collect())


def test_json_lines_round_trip(spark, scratch):
    lst = RG.listings(spark, SF001)
    back = files.load_listings(spark, files.save_listings_json(lst, scratch + "/l.json"), "json")
    assert _rows(back) == _rows(lst)


def test_csv_round_trip_keeps_amenity_lists(spark, scratch):
    lst = RG.listings(spark, SF001)
    back = files.load_listings(spark, files.save_listings_csv(lst, scratch + "/l.csv"), "csv")
    assert _rows(back) == _rows(lst)


def _write(path, text):
    os.makedirs(os.path.dirname(_local(path)), exist_ok=True)
    with open(_local(path), "w", encoding="utf-8") as f:
        f.write(text)
    return path


REC = {"listing_id": "SP1", "property_type": "condo", "title": "t", "description": "d", "monthly_rent": 5000,
       "bedrooms": 2, "bathrooms": 1, "sqft": 900, "city": "Pune", "state": "MH", "zip_code": "411001",
       "amenities": ["Lift", "Children's Play Area"], "pet_friendly": False, "furnished": True}


def test_json_array_document(spark, scratch):
    path = _write(scratch + "/props.json", json.dumps([REC, dict(REC, listing_id="SP2")], indent=2))
    df = files.load_listings(spark, path)  # detected as an array document
    rows = df.orderBy("listing_id").collect()
    assert [r.listing_id for r in rows] == ["SP1", "SP2"]
    assert rows[0].amenities == ["Lift", "Children's Play Area"] and rows[0].furnished is True


def test_csv_python_repr_amenities_load_as_empty(spark, scratch):
    text = ("listing_id,amenities,monthly_rent\n"
            "SP1,\"['Lift', 'Gymnasium']\",100\n"
            "SP2,\"[\"\"Lift\"\"]\",200\n")
    df = files.load_listings(spark, _write(scratch + "/p.csv", text))
    got = {r.listing_id: r.amenities for r in df.collect()}
    assert got == {"SP1": [], "SP2": ["Lift"]}


def test_unsupported_extension(spark, scratch):
    with pytest.raises(ValueError):
        files.load_listings(spark, _write(scratch + "/p.txt", "x"))


def test_corpus_build_or_load(spark, scratch):
    with pytest.raises(FileNotFoundError):
        files.load_corpus(spark, scratch + "/nothing")
    lst = RG.listings(spark, SF001)
    vec = RG.embeddings(spark, SF001).select(F.col("vec_id").alias("id"), "embedding")
    l1, v1 = files.prepare_corpus(spark, lst, vec, scratch + "/corpus")
    l2, v2 = files.prepare_corpus(spark, lst.limit(0), vec.limit(0), scratch + "/corpus")  # loads, no rebuild
    assert l2.count() == lst.count() and v2.count() == vec.count()


def test_null_listing_profile_defaults(spark):
    df = spark.createDataFrame([(1, None)], "id bigint, x string").select(
        "id", *[F.lit(None).cast(t).alias(c) for c, t in [
            ("bedrooms", "int"), ("property_type", "string"), ("city", "string"), ("state", "string"),
            ("zip_code", "string"), ("sqft", "int"), ("monthly_rent", "bigint"), ("bathrooms", "int"),
            ("amenities", "array<string>"), ("pet_friendly", "boolean"), ("parking_available", "boolean"),
            ("furnished", "boolean"), ("utilities_included", "boolean"), ("description", "string"),
            ("title", "string")]])
    t = df.select(profile_text().alias("t")).collect()[0].t
    assert t == ("0 BHK None in None, None None with None sqft, ₹None monthly, None bathrooms, "
                 "amenities: basic amenities, features: standard features.  ")


def test_sqft_zero_and_non_numeric_rent(spark):
    df = spark.createDataFrame([("SP1", "abc", 0, "Pune"), ("SP1", "300", 100, "Pune")],
                               "listing_id string, monthly_rent string, sqft int, city string")
    from abode.functions.derive import price_per_sqft
    got = df.select(numeric_coerce(F.col("monthly_rent")).alias("r"),
                    price_per_sqft(numeric_coerce(F.col("monthly_rent")), F.col("sqft")).alias("p")).collect()
    assert (got[0].r, got[0].p) == (None, None) and (got[1].r, got[1].p) == (300.0, 3.0)
    s = stats.stats_overview(df).collect()[0]
    assert s.total_properties == 2 and s.cities == 1 and s.avg_rent == 300.0 and s.error is None


def test_empty_corpus_stats(spark):
    s = stats.stats_overview(RG.listings(spark, SF001).limit(0)).collect()[0]
    assert s.total_properties == 0 and s.error == "No data loaded"


def test_duplicate_listing_id_kept_apart_by_key(spark):
    lst = RG.listings(spark, SF001).withColumn("listing_id", F.lit("SP1"))
    assert lst.select("id").distinct().count() == lst.count()


def test_conversation_user_turns_as_requests(spark):
    import pytest
    from abode.plans import registry as RG
    from abode.sources.requests import requests_from_conversations
    from conftest import SF001
    conv = RG.read(spark, SF001, "conversations")
    reqs = requests_from_conversations(conv)
    n_user = conv.filter("role = 'user'").count()
    assert reqs.count() == n_user == reqs.select("qid").distinct().count()
    assert reqs.filter("msg IS NULL OR max_results <> 10 OR vec_id IS NOT NULL").count() == 0
    bad = spark.createDataFrame([(1, 10**6, "user", "x")], "conv_id bigint, turn bigint, role string, text string")
    with pytest.raises(Exception, match="turn out of range"):
        requests_from_conversations(bad).collect()


@pytest.mark.parametrize("name", ["a b.json", "a[1].json", "a%20b.json", "{x,y}.json", "50%.json", "ü+&.json"])
def test_json_file_names(spark, scratch, name):
    """Names with blanks, pattern signs and percent signs are read as they are, lines and array documents alike."""
    _write(f"{scratch}/in/{name}", '{"id": 1, "title": "lines"}\n{"id": 9007199254740993, "monthly_rent": "9007199254740993.0"}\n')
    _write(f"{scratch}/in/second {name}", '[\n {"id": 3, "title": "array"}\n]')
    got = sorted(tuple(r) for r in files.load_listings(spark, f"{scratch}/in", "json").select("id", "title", "monthly_rent").collect())
    assert got == [(1, "lines", None), (3, "array", None), (9007199254740993, None, 9007199254740993)]


def test_failed_rebuild_leaves_the_version_before(spark, scratch):
    """Manifest last: bad vectors stop a rebuild, a version without a whole manifest doesn't count."""
    out = f"{scratch}/corpus"
    lst = RG.listings(spark, SF001)
    vec = RG.embeddings(spark, SF001).select(F.col("vec_id").alias("id"), "embedding")
    files.prepare_corpus(spark, lst, vec, out)
    for bad in (vec.withColumn("embedding", F.transform("embedding", lambda x: x * 2)), vec.withColumn("embedding", F.when(F.col("id") != 3, F.col("embedding"))),
                vec.withColumn("embedding", F.when(F.col("id") == 3, F.slice("embedding", 1, 9)).otherwise(F.col("embedding")))):
        with pytest.raises(Exception, match="wrong dimension or norm"):
            files.prepare_corpus(spark, lst.limit(1), bad, out, rebuild=True)
        assert files.load_corpus(spark, out)[0].count() == lst.count()
    files.prepare_corpus(spark, lst.limit(7), vec, out, rebuild=True)
    assert files.load_corpus(spark, out)[0].count() == 7
    os.remove(_local(f"{out}/manifest=2/_SUCCESS"))
    assert files.load_corpus(spark, out)[0].count() == lst.count()


def test_corpus_from_files_prefers_json(spark, scratch):
    with pytest.raises(FileNotFoundError):
        files.corpus_from_files(spark, f"{scratch}/none", f"{scratch}/c0")
    _write(f"{scratch}/in/a.csv", 'id,title,monthly_rent\n1,from csv,5\n2,too,6\n')
    l, v = files.corpus_from_files(spark, f"{scratch}/in", f"{scratch}/c1")
    assert sorted(r.title for r in l.collect()) == ["from csv", "too"] and v.count() == 2
    _write(f"{scratch}/in/b.json", '[{"id": 3, "title": "from json"}, {"id": 4, "title": "pool"}, {"id": 5}]')
    assert sorted(r.id for r in files.corpus_from_files(spark, f"{scratch}/in", f"{scratch}/c2")[0].collect()) == [3, 4, 5]
    assert files.corpus_from_files(spark, f"{scratch}/in", f"{scratch}/c1")[0].count() == 2  # loaded
    assert files.corpus_from_files(spark, f"{scratch}/in", f"{scratch}/c1", rebuild=True)[0].count() == 3


def test_update_encodes_changed_listings_only(spark, scratch):
    """Kept vectors are copied, so what the second encoder says shows what was encoded again."""
    lst, out = RG.listings(spark, SF001), f"{scratch}/corpus"

    def to(x, y):
        return lambda texts: texts.withColumn("embedding", F.array(F.lit(x), F.lit(y)))

    files.update_corpus(lst, out, to(1.0, 0.0))
    changed = lst.where("id <> 7").withColumn("city", F.when(F.col("id") == 5, F.lit("Elsewhere")).otherwise(F.col("city")))
    new = lst.where("id = 7").withColumn("id", F.lit(10_000_007).cast("long"))
    l, v = files.update_corpus(changed.unionByName(new), out, to(0.0, 1.0))
    got = {r.id: list(r.embedding) for r in v.collect()}
    assert sorted(got) == sorted(r.id for r in l.collect())
    assert {i for i, e in got.items() if e == [0.0, 1.0]} == {5, 10_000_007}

    def fails(texts):
        return texts.withColumn("embedding", F.array(F.lit(3.0), F.lit(4.0)))

    with pytest.raises(Exception, match="wrong dimension or norm"):
        files.update_corpus(lst, out, fails)
    assert {r.id: list(r.embedding) for r in files.load_corpus(spark, out)[1].collect()} == got
    files.prepare_corpus(spark, lst, v.drop("digest"), out, rebuild=True)  # a version without digests
    assert files.update_corpus(lst, out, to(0.0, 1.0))[1].where("embedding[1] = 1").count() == lst.count()
