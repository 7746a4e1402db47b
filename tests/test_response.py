"""Per-request answers from per-key ranked arrays: equal to the exploded
hits path, equal with and without broadcasts, and no qid shuffle."""
import re

import pytest
from pyspark.sql import functions as F

from abode.functions.parse import parse_request
from abode.operators import search, topk
from abode.plans import registry as RG
from abode.sources.requests import validate_k
from conftest import SF001

TS = "2024-01-01 00:00:00"


def _key(df):
    return sorted((r.qid, r.message, r.total_found, r.query_processed,
                   tuple((p.search_rank, p.listing_id) for p in r.properties)) for r in df.collect())


def _inputs(spark):
    return RG.requests(spark, SF001), RG.listings(spark, SF001), RG.embeddings(spark, SF001)


@pytest.mark.parametrize("mode,ranking", [("api", "vector"), ("ui", "vector"), ("api", "lexical")])
def test_array_path_equals_exploded_hits(spark, mode, ranking):
    req, lst, emb = _inputs(spark)
    ts = F.lit(TS).cast("timestamp")
    new = search.chat_batch(req, lst, emb, mode=mode, ranking=ranking, answered_at=ts, fields=("listing_id",))
    p = parse_request(validate_k(req), mode=mode)
    hits = (search.vector_hits(p, lst, emb, carry=search.CARRY, with_listings=True) if ranking == "vector"
            else search.lexical_hits(p, lst, carry=search.CARRY, with_listings=True))
    old = search.respond(p, search.post_filter(hits, p, lst, mode), ts, fields=("listing_id",))
    assert _key(new) == _key(old)


def test_shuffle_path_equals_broadcast_path(spark, monkeypatch):
    req, lst, emb = _inputs(spark)
    ts = F.lit(TS).cast("timestamp")
    small = _key(search.chat_batch(req, lst, emb, answered_at=ts, fields=("listing_id",)))
    monkeypatch.setattr(search, "BROADCAST_BYTES_MAX", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = search.chat_batch(req, lst, emb, answered_at=ts, fields=("listing_id",))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"BroadcastHashJoin .*LeftOuter", plan)
        assert re.search(r"SortMergeJoin .*LeftOuter", plan)
        assert _key(df) == small
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_request_side_not_multiplied_nor_shuffled_by_qid(spark):
    req, lst, emb = _inputs(spark)
    df = search.chat_batch(req, lst, emb, fields=("listing_id",))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"BroadcastHashJoin .*LeftOuter", plan)
    assert "hashpartitioning(qid" not in plan


def test_empty_corpus_cannot_fit_the_encoder(spark):
    """As in the reproduced service, embedding an empty corpus is an error."""
    req, lst, emb = _inputs(spark)
    with pytest.raises(ValueError, match="empty corpus"):
        search.chat_batch(req, lst.filter(F.lit(False)), emb, ranking="encoded")


@pytest.mark.parametrize("ranking", ["vector", "lexical"])
def test_empty_corpus_answers_every_request(spark, ranking):
    req, lst, emb = _inputs(spark)
    none = lst.filter(F.lit(False))
    df = search.chat_batch(req, none, emb, ranking=ranking, fields=("listing_id",))
    rows = df.select("total_found", "message").collect()
    assert len(rows) == 1000 + 23
    assert {r.total_found for r in rows} == {0}
    assert all(r.message.startswith("No properties matched your search for '") for r in rows)
