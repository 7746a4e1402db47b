"""Physical plans of every registered query: no cross join, no nested-loop
join, no row-at-a-time Python; scans read only the columns they need; the
post-filter stays above the ranking."""
import re

import pytest

import __spark_entry__ as E
from abode.plans import registry as RG
from conftest import SF001

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in E.queries() if n != "chat_stream"))
def test_no_pairs_no_row_udfs(spark, name):
    p = _plan(E.queries()[name](spark, SF001))
    assert not [f for f in FORBIDDEN if f in p], p


def test_listing_scans_read_only_the_key(spark):
    p = _plan(E.queries()["stats_overview"](spark, SF001))
    assert re.findall(r"ReadSchema: (struct<[^>]*>)", p) == ["struct<p_partkey:bigint>"]


def test_request_scan_prunes_event_columns(spark):
    p = _plan(E.queries()["parse_request"](spark, SF001))
    assert set(re.findall(r"ReadSchema: (struct<[^>]*>)", p)) == {"struct<event_id:bigint>"}


def test_ranking_is_arrow_tiles_not_pairs(spark):
    p = _plan(E.queries()["topk_batch"](spark, SF001))
    assert "FlatMapCoGroupsInArrow" in p


def _subtree(plan: str, node: str) -> list[str]:
    """Lines of the subtree under the first line naming ``node`` (children of
    a node starting at column c have their branch mark at column >= c)."""
    lines = plan.splitlines()
    start = next(i for i, l in enumerate(lines) if node in l)
    col = lines[start].index(node)
    out = []
    for l in lines[start + 1:]:
        m = re.search(r"[+:]- ", l)
        if m is None or m.start() < col:
            break
        out.append(l)
    return out


def test_post_filter_not_pushed_below_ranking(spark):
    """Constraints filter ranked hits, never the ranking input: nothing under
    the Arrow tile operator mentions a constraint or a listing attribute."""
    from abode.functions import predicates
    hits = RG._hits_joined(spark, SF001).filter(predicates.all_ok("api"))
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    below = "\n".join(_subtree(plan, "FlatMapCoGroupsInArrow"))
    assert "embedding" in below  # the subtree was found
    for attr in ("monthly_rent", "max_price", "want_type", "bedrooms", "property_type"):
        assert attr not in below, attr
    top = plan.splitlines()[:plan.splitlines().index(next(l for l in plan.splitlines()
                                                          if "FlatMapCoGroupsInArrow" in l))]
    assert any("monthly_rent" in l and "max_price" in l for l in top)


def test_split_corpus_merge_limits_candidates_map_side(spark):
    """With several corpus blocks the per-key merge gets a partial
    WindowGroupLimit (literal bound = largest k) before its shuffle."""
    from pyspark.sql import functions as F
    from abode.operators import search
    from abode.operators.topk import exact_topk
    lst, emb = RG.listings(spark, SF001), RG.embeddings(spark, SF001)
    corpus = search.vector_corpus(lst, emb)
    q = corpus.select(F.col("id").alias("q"), "embedding", F.lit(5).alias("k"))
    out = exact_topk(q, corpus, qkey="q", qcol="embedding", kcol="k", ckey="id", ccol="embedding",
                     block_c=64)
    p = _plan(out)
    assert "WindowGroupLimit" in p and "Partial" in p


def test_broadcast_width_estimate_and_cluster_conf():
    from pyspark.sql import types as T
    from abode.operators.topk import est_row_bytes
    from abode.session import cluster_conf
    row = T.StructType([T.StructField("k", T.LongType()), T.StructField("s", T.StringType()),
                        T.StructField("a", T.ArrayType(T.StringType()))])
    assert est_row_bytes(row) == 8 + 8 + 96 + (16 + 8 * 96)
    conf = cluster_conf(1000, 8)
    assert conf["spark.sql.shuffle.partitions"] == "24000"
    assert conf["spark.sql.adaptive.skewJoin.enabled"] == "true"
    assert conf["spark.sql.autoBroadcastJoinThreshold"] == "64m"


def test_tile_sizes_follow_dimension():
    from abode.operators.topk import _row_chunk, dense_block
    assert dense_block(64) == 16384 and dense_block(1024) == 4096
    assert dense_block(1) == 65536 and dense_block(10**9) == 1024
    assert _row_chunk(16384) == 512 and _row_chunk(65536) == 256 and _row_chunk(10**9) == 1
