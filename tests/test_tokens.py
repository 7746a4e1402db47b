"""Batches of texts split, folded and encoded in tasks, against Spark's own functions."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from abode.operators.encode import encode_profiles, hashed_tfidf_encoder, measured, norm
from abode.operators.search import text_tokens
from abode.operators.tokens import batch_tokens
from abode.sources.synth import synth_listings

TEXTS = ["2 BHK condo, ₹30000", "", None, "été 12é3x a-b--c", "  ", "Kelvin İstanbul z", "nineteen letters 1234567890abcdefghij", "condo condo CONDO"]


def test_tokens_are_those_of_the_sql_split(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string")
    rows = df.select("i", F.lower("text").alias("low"), text_tokens(F.col("text")).alias("t")).orderBy("i").collect()
    for lo, hi in ((0, 8), (2, 7), (1, 3), (4, 4)):
        row, tokens = batch_tokens(pa.array([r.low for r in rows], pa.string()).slice(lo, hi - lo))
        assert [[t for i, t in zip(row, tokens.to_pylist(), strict=True) if i == at] for at in range(hi - lo)] == [r.t for r in rows[lo:hi]]


@pytest.mark.parametrize("size", [7, 1024])
def test_hashed_encoder_is_that_of_spark_ml(spark, size):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, text string").repartition(3)
    plain = df.select("i", F.coalesce("text", F.lit("")).alias("text"))
    model = Pipeline(stages=[RegexTokenizer(inputCol="text", outputCol="tok", pattern="[^a-z0-9]+", toLowercase=True),
                             HashingTF(inputCol="tok", outputCol="tf", numFeatures=size), IDF(inputCol="tf", outputCol="w"),
                             Normalizer(inputCol="w", outputCol="v", p=2.0)]).fit(plain)
    want = {r.i: r.e for r in model.transform(plain).select("i", vector_to_array("v", "float32").alias("e")).collect()}
    got = {r.i: r.embedding for r in hashed_tfidf_encoder(size)(df)(df).collect()}
    assert set(got) == set(want)
    for i in want:
        assert np.allclose(got[i], want[i], rtol=1e-6, atol=0) and len(got[i]) == size


def test_empty_corpus_fails(spark):
    with pytest.raises(ValueError, match="empty corpus"):
        hashed_tfidf_encoder(8)(spark.createDataFrame([], "text string"))


def test_measures_of_a_batch(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0]), (2, []), (3, None), (4, [0.0, 0.0]), (5, [1.0])], "i int, v array<float>").coalesce(1)
    got = df.select(measured("v").alias("m"), norm("v").alias("n")).select("m.*", "n").collect()
    assert [r.norm for r in got] == [r.n for r in got] == [5.0, 0.0, None, 0.0, 1.0]
    assert [r.dim for r in got] == [2, 0, None, 2, 1]


def test_profiles_are_encoded_without_a_lambda_on_each_element(spark):
    l = synth_listings(spark.range(50).select(F.col("id").alias("p_partkey")))
    _, enc = encode_profiles(l)
    assert enc.columns == ["id", "embedding"] and enc.where(F.abs(norm("embedding") - 1) < 1e-5).count() == 50
    from abode.plans import registry as RG
    plan = RG.QUERIES["encode_profiles"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "zip_with" not in plan
