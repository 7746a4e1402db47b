"""Hot keys: a third of all requests share one vector / one text.  They are
ranked once (dedupe) and every request still gets its complete answer."""
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from abode.functions.parse import parse_request
from abode.operators import search
from abode.plans import registry as RG
from conftest import SF001


def _hot_requests(spark):
    r = RG.requests(spark, SF001, golden=False)
    hot = F.pmod(F.col("qid"), F.lit(3)) == 0
    return (r.withColumn("vec_id", F.when(hot, F.lit(7)).otherwise(F.col("vec_id")))
             .withColumn("msg", F.when(hot, F.lit("2 bhk in Mumbai under 9000")).otherwise(F.col("msg")))
             .withColumn("max_results", F.when(hot, F.lit(10)).otherwise(F.col("max_results"))))


def test_hot_vector_key(spark):
    p = parse_request(_hot_requests(spark))
    h = search.vector_hits(p, RG.listings(spark, SF001), RG.embeddings(spark, SF001))
    per = h.filter(F.pmod("qid", F.lit(3)) == 0).groupBy("qid").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("ids"))
    rows = per.collect()
    assert len(rows) == 334 and {r.n for r in rows} == {10}
    assert len({tuple(r.ids) for r in rows}) == 1  # identical ranking for the shared key


def test_hot_text_key_lexical(spark):
    p = parse_request(_hot_requests(spark))
    h = search.lexical_hits(p, RG.listings(spark, SF001))
    per = h.filter(F.pmod("qid", F.lit(3)) == 0).groupBy("qid").count().collect()
    assert len(per) == 334 and {r["count"] for r in per} == {10}


@pytest.mark.parametrize("exploded", [False, True])
def test_hot_key_shuffle_path_is_salted(spark, monkeypatch, exploded):
    """Ranking too big to broadcast: requests shuffle on (key, salt); the
    third of them sharing one key is split into ceil(334 / 50) = 7 salts,
    and every hot request still gets its complete, identical answer."""
    from abode.operators import topk
    lst, emb = RG.listings(spark, SF001), RG.embeddings(spark, SF001)

    def run():
        if exploded:
            h = search.vector_hits(parse_request(_hot_requests(spark)), lst, emb)
            return h, sorted((r.qid, r.id, r.search_rank) for r in h.collect())
        resp = search.chat_batch(_hot_requests(spark), lst, emb, fields=("listing_id",))
        return resp, sorted((r.qid, r.message, tuple(p.listing_id for p in r.properties)) for r in resp.collect())

    _, expected = run()
    monkeypatch.setattr(search, "BROADCAST_BYTES_MAX", -1)
    monkeypatch.setattr(topk, "BROADCAST_BYTES_MAX", -1)
    monkeypatch.setattr(topk, "SALT_ROWS", 50)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df, got = run()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "__salt" in plan and "BroadcastHashJoin" not in plan
        assert got == expected
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_salted_join_spreads_a_hot_key(spark, monkeypatch):
    from abode.operators import topk
    monkeypatch.setattr(topk, "SALT_ROWS", 100)
    left = spark.range(3000).selectExpr("id AS qid", "CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS k")
    right = spark.range(3000).selectExpr("id AS k", "id * 10 AS v")
    j = topk.salted_join(left, right, "k", "qid")
    assert j.count() == 3000 and j.filter("v = 70").count() == 1001  # ids 0, 3, ... and 7
    # the hot key's 1001 rows are split into ceil(1001 / 100) = 11 salt groups
    salted = (left.join(F.broadcast(spark.createDataFrame([(7, 11)], "k long, __s int")), "k")
                  .select(F.pmod(F.xxhash64("qid"), F.col("__s")).alias("salt")).distinct().count())
    assert salted == 11


@settings(max_examples=6, deadline=None, derandomize=True,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(left_keys=st.lists(st.integers(0, 6), min_size=1, max_size=300),
       right_keys=st.lists(st.integers(0, 8), min_size=0, max_size=12),
       salt_rows=st.integers(1, 60), how=st.sampled_from(["inner", "left"]))
def test_salted_join_equals_plain_join(spark, monkeypatch, left_keys, right_keys, salt_rows, how):
    """Same rows as a plain join, whatever the skew: nothing lost, nothing doubled."""
    from abode.operators import topk
    monkeypatch.setattr(topk, "SALT_ROWS", salt_rows)
    left = spark.createDataFrame(list(enumerate(left_keys)), "qid long, k long")
    right = spark.createDataFrame([(k, i) for i, k in enumerate(right_keys)], "k long, v long")
    got = sorted(tuple(r) for r in topk.salted_join(left, right, "k", "qid", how).select("qid", "k", "v").collect())
    exp = sorted(tuple(r) for r in left.join(right, "k", how).select("qid", "k", "v").collect())
    assert got == exp
