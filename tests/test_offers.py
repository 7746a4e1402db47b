"""Facts of a ranked listing that the post-filter compares, against its predicates row by row; listings that share a key."""

import itertools

import pytest
from pyspark.sql import functions as F

from abode.constants import FLAG_COLUMNS
from abode.functions import predicates
from abode.operators import search, terms
from abode.operators.matches import wanted_bits


@pytest.mark.parametrize("mode", ["api", "ui"])
def test_offers_meet_what_the_predicates_meet(spark, mode):
    flags = ", ".join(f"{f} boolean" for f in FLAG_COLUMNS)
    homes = spark.createDataFrame([(0, 900, 2, "Condo", ["Gym", "POOL"], True, None, False, True), (1, None, None, None, None, None, None, None, None),
                                   (2, 2000, 0, "house", ["Swimming Pool", None, "x"], False, True, True, None), (3, 901, 2, "condo", [], True, True, True, True)],
                                  f"id long, monthly_rent long, bedrooms int, property_type string, amenities array<string>, {flags}")
    wants = [[], ["pool"], ["gym"], ["pool", "gym"], [FLAG_COLUMNS[0]], [FLAG_COLUMNS[1], "pool"], [*FLAG_COLUMNS]]
    asked = [(q, *v) for q, v in enumerate(itertools.product([None, 0, 900], [None, 0, 2], [None, "condo"], wants))]
    req = spark.createDataFrame(asked, "qid int, max_price long, want_bedrooms long, want_type string, want_amenities array<string>")
    want = {(r.qid, r.id) for r in req.crossJoin(homes).where(predicates.all_ok(mode)).collect()}
    facts = homes.select("id", F.struct(*search.offers(mode)).alias("x")).crossJoin(req.withColumn("__want", wanted_bits(F.col("want_amenities"))))
    got = {(r.qid, r.id) for r in facts.where(search._ALL_OK).select("qid", "id").collect()}
    assert got == want and 0 < len(want) < len(asked) * 4


def test_rows_that_share_a_key_are_one_text(spark, monkeypatch):
    """With the vocabulary broadcast and joined."""
    df = spark.createDataFrame([(1, "a b"), (1, "b c"), (2, "c"), (None, "a"), (None, None), (3, None)], "id long, text string").repartition(3)
    words = terms.vocabulary(df)
    rows = [sorted(map(repr, terms.term_weights(df, words).collect()))]
    monkeypatch.setattr(terms, "BROADCAST_BYTES_MAX", 0)
    rows.append(sorted(map(repr, terms.term_weights(df, words).collect())))
    assert rows[0] == rows[1] and len(rows[0]) == 4


def test_encoded_texts_are_not_exploded(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "c")], "id long, text string")
    plan = terms.term_weights(df, terms.vocabulary(df))._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "Generate" not in plan and "Aggregate" not in plan


def test_parsed_tokens(spark):
    from abode.functions.parse import tokens_sql
    texts = ["", "   ", " a\tb  c ", "x", None]
    got = spark.createDataFrame([(t,) for t in texts], "m string").select(F.expr(tokens_sql("coalesce(m, '')")).alias("t")).collect()
    assert [r.t for r in got] == [(t or "").split() for t in texts]
