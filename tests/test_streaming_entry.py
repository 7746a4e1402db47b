"""Streaming = batch; driver contract."""
from pyspark.sql import functions as F

import __spark_entry__ as E
from abode.operators import search
from abode.plans import registry as RG
from abode.streaming.chat_stream import cached_rankings, run_chat_stream, start_chat_stream
from conftest import SF001


def _key(df):
    return sorted((r.qid, r.message, r.total_found, r.query_processed,
                   tuple(p.listing_id for p in r.properties)) for r in df.collect())


def test_stream_equals_batch(spark, scratch):
    lst, emb = RG.listings(spark, SF001), RG.embeddings(spark, SF001)
    ts = "2024-01-01 00:00:00"
    streamed = run_chat_stream(spark, SF001, lst, emb, answered_at=ts, out=scratch)
    batch = search.chat_batch(RG.requests(spark, SF001, golden=False), lst, emb,
                              answered_at=F.lit(ts).cast("timestamp"))
    assert _key(streamed) == _key(batch)


def test_several_micro_batches_equal_one(spark, scratch):
    """Events split over three files, one file per trigger (three batches),
    give the same responses as the whole log in one batch."""
    src = f"{scratch}/events-src"
    RG.read(spark, SF001, "events").repartition(3, "event_id").write.parquet(src)
    lst, emb = RG.listings(spark, SF001), RG.embeddings(spark, SF001)
    ts = "2024-01-01 00:00:00"
    one = run_chat_stream(spark, src, lst, emb, answered_at=ts, out=f"{scratch}/one", glob="*.parquet")
    three = run_chat_stream(spark, src, lst, emb, answered_at=ts, out=f"{scratch}/three", glob="*.parquet",
                            max_files_per_trigger=1, compact_every=2)
    n_batches = len(spark.read.parquet(f"{scratch}/three/responses").select("batch_id").distinct().collect())
    assert n_batches == 3
    assert _key(three) == _key(one)
    assert three.count() == 1000
    # ranking cache: a key is ranked again only when it asks for a larger k
    cache = spark.read.parquet(f"{scratch}/three/_rankings").select("__key", "kc", "batch_id").distinct()
    per_key = {}
    for r in cache.orderBy("batch_id").collect():
        per_key.setdefault(r["__key"], []).append(r.kc)
    assert all(ks == sorted(set(ks)) for ks in per_key.values())
    ranked_pairs = cache.count()
    # (key, micro-batch) pairs a cache-less stream would rank: one file per batch
    seen = (spark.read.parquet(src).select(F.pmod("event_id", F.lit(500)).alias("vec_id"),
                                           F.input_file_name().alias("f")).distinct().count())
    assert len(per_key) == 500 and ranked_pairs < seen
    # after batch 1 the cache was compacted: each key once, at its largest k so far
    from abode.streaming.chat_stream import read_cache, ranking_cache_schema
    comp = spark.read.parquet(f"{scratch}/three/_rankings_compact/upto=1")
    assert comp.groupBy("__key").agg(F.countDistinct("kc").alias("n")).filter("n > 1").count() == 0
    # the reader takes the compaction plus the later batch only
    cache_now = read_cache(spark, f"{scratch}/three/_rankings", ranking_cache_schema())
    assert cache_now.count() == comp.count() + spark.read.parquet(f"{scratch}/three/_rankings/batch_id=2").count()


def test_lexical_stream_equals_batch(spark, scratch):
    src = f"{scratch}/events-src"
    RG.read(spark, SF001, "events").repartition(2, "event_id").write.parquet(src)
    lst, emb = RG.listings(spark, SF001), RG.embeddings(spark, SF001)
    ts = "2024-01-01 00:00:00"
    streamed = run_chat_stream(spark, src, lst, emb, answered_at=ts, out=f"{scratch}/lex", glob="*.parquet",
                               max_files_per_trigger=1, ranking="lexical")
    batch = search.chat_batch(RG.requests(spark, SF001, golden=False), lst, emb, ranking="lexical",
                              answered_at=F.lit(ts).cast("timestamp"))
    assert _key(streamed) == _key(batch)


def test_long_running_stream_picks_up_new_files(spark, scratch):
    """A processing-time stream answers files as they arrive; a restart from
    the same checkpoint answers only the new file (exactly once overall)."""
    src = f"{scratch}/incoming"
    ev = RG.read(spark, SF001, "events")
    ev.filter("event_id < 400").coalesce(1).write.parquet(src, mode="append")
    lst, emb = RG.listings(spark, SF001), RG.embeddings(spark, SF001)
    ts = "2024-01-01 00:00:00"
    out = f"{scratch}/out"
    q = start_chat_stream(spark, src, lst, emb, out, answered_at=ts, glob="*.parquet", processing_time="1 second")
    try:
        q.processAllAvailable()
        ev.filter("event_id >= 400").coalesce(1).write.parquet(src, mode="append")
        q.processAllAvailable()
    finally:
        q.stop()
    q2 = start_chat_stream(spark, src, lst, emb, out, answered_at=ts, glob="*.parquet", available_now=True)
    q2.awaitTermination()
    got = spark.read.parquet(f"{out}/responses")
    assert got.count() == 1000 and got.select("qid").distinct().count() == 1000
    batch = search.chat_batch(RG.requests(spark, SF001, golden=False), lst, emb,
                              answered_at=F.lit(ts).cast("timestamp"))
    assert _key(got.drop("batch_id")) == _key(batch)


def test_entry_and_registry(spark):
    df = E.entry(spark)
    assert df.count() == 1000 + 23
    assert set(df.columns) == {"qid", "message", "total_found", "query_processed", "hit_ids", "hit_ranks"}
    q, o = E.queries(), E.oracle_sql()
    assert set(RG.QUERIES) <= set(q) and set(RG.QUERIES) <= set(o)
    assert set(o) <= set(q)


def test_replayed_batch_gives_the_same_rankings(spark, scratch):
    """A batch that runs again after its rankings were cached, or after a later
    batch, answers as at first; keys without a result stay cached."""
    lst, emb = RG.listings(spark, SF001), RG.embeddings(spark, SF001)
    asked = spark.createDataFrame([(0, 5), (1, 3), (10**9, 4)], "vec_id bigint, max_results int")
    rows = lambda: sorted(tuple(r) for r in cached_rankings(asked, lst, emb, f"{scratch}/cache", 0)[0].collect())
    first = rows()
    assert len(first) >= 8 and rows() == first
    later = cached_rankings(asked, lst, emb, f"{scratch}/cache", 1)[0]
    assert sorted(tuple(r) for r in later.collect()) == first
    assert spark.read.parquet(f"{scratch}/cache/batch_id=1").count() == 0
    assert rows() == first


def test_total_found_bounded_by_k(spark):
    resp = search.chat_batch(RG.requests(spark, SF001), RG.listings(spark, SF001), RG.embeddings(spark, SF001),
                             fields=("listing_id",))
    assert resp.filter(F.col("total_found") > 24).count() == 0


def test_max_results_rules(spark):
    import pytest
    from abode.sources.requests import validate_k
    df = spark.createDataFrame([(1, None), (2, 3)], "qid bigint, max_results int")
    assert [r.max_results for r in validate_k(df).orderBy("qid").collect()] == [10, 3]
    bad = spark.createDataFrame([(1, 0)], "qid bigint, max_results int")
    with pytest.raises(Exception, match="max_results"):
        validate_k(bad).collect()


def test_compaction_survives_replays_and_cut_off_writes(spark, scratch):
    """Batches around a compaction run again, with whole folders and with folders
    whose write was cut off: the rankings are those of a fresh cache."""
    import os

    lst, emb = RG.listings(spark, SF001), RG.embeddings(spark, SF001)

    def ask(lo, k):
        return spark.createDataFrame([(i, k) for i in range(lo, lo + 4)], "vec_id bigint, max_results int")

    batches = [ask(0, 3), ask(2, 5), ask(4, 2), ask(0, 4), ask(6, 3)]
    cache = f"{scratch}/cache"

    def rows(n, folder=cache):
        got, bound = cached_rankings(batches[n], lst, emb, folder, n, compact_every=2)
        kept = sorted(tuple(r) for r in got.collect())
        assert bound >= len(kept)
        return kept

    want = [rows(n, f"{scratch}/other-{n}") for n in range(5)]  # each batch alone, nothing cached

    def enough(n, got):  # a cache may hold more results of a key than asked for
        ranks = {(r[0], r[1]): r[2:] for r in got}
        assert all(ranks[r[:2]] == r[2:] for r in want[n]), n

    for n in range(5):
        for _ in range(2):
            enough(n, rows(n))
    whole = spark.read.parquet(f"{cache}_compact/upto=3").count()
    for n in (2, 4):  # batch N runs again after its compaction was published
        enough(n, rows(n))
    assert whole > 0 and spark.read.parquet(f"{cache}_compact/upto=3").count() == whole
    # a crash while the compaction is written: no _SUCCESS, so it counts as absent and is written again
    cut = f"{cache}_compact/upto=3".replace("file:", "")
    os.rename(f"{cut}/_SUCCESS", f"{cut}/_gone")
    enough(4, rows(4))
    assert os.path.exists(f"{cut}/_SUCCESS") and spark.read.parquet(f"{cache}_compact/upto=3").count() == whole
    # a crash while the batch's own rows are written
    cut = f"{cache}/batch_id=4".replace("file:", "")
    os.rename(f"{cut}/_SUCCESS", f"{cut}/_gone")
    enough(4, rows(4))
