"""Bounded pieces: written files, partitions of generated listings."""

import json

from pyspark.sql import functions as F

from abode.sources import files, synth
from abode.sources.synth import dealt, synth_listings


def _texts(spark, path):
    return [r["doc"] for r in spark.read.text(path, wholetext=True).select(F.col("value").alias("doc")).collect()]


def test_array_documents_are_bounded(spark, scratch, monkeypatch):
    monkeypatch.setattr(files, "FILE_ROWS", 3)
    l = synth_listings(spark.range(8).select(F.col("id").alias("p_partkey"))).coalesce(1)
    docs = [json.loads(t) for t in _texts(spark, files.save_listings_array(l, f"{scratch}/array"))]
    assert sorted(map(len, docs)) == [2, 3, 3]
    back = files.load_listings(spark, f"{scratch}/array", "json")
    assert sorted(r["id"] for r in back.collect()) == list(range(8))
    # a last document that is full, and a partition without records
    for n, sizes in ((6, [3, 3]), (0, [0])):
        one = l.where(F.col("id") < n)
        docs = [json.loads(t) for t in _texts(spark, files.save_listings_array(one, f"{scratch}/array-{n}"))]
        assert sorted(map(len, docs)) == sizes


def test_csv_files_are_bounded(spark, scratch, monkeypatch):
    monkeypatch.setattr(files, "FILE_ROWS", 3)
    l = synth_listings(spark.range(8).select(F.col("id").alias("p_partkey"))).coalesce(1).withColumn("title", F.lit('two\nlines, "quoted"'))
    path = files.save_listings_csv(l, f"{scratch}/csv")
    back = files.load_listings(spark, path, "csv")
    assert back.select(F.col("_metadata.file_path") if "_metadata" in back.columns else F.input_file_name()).distinct().count() == 3
    assert sorted((r["id"], r["title"]) for r in back.collect()) == [(i, 'two\nlines, "quoted"') for i in range(8)]


def test_listing_keys_are_dealt(spark, scratch, monkeypatch):
    spark.range(1000).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(scratch)
    keys = spark.read.parquet(scratch)
    assert dealt(keys).rdd.getNumPartitions() == keys.rdd.getNumPartitions()
    monkeypatch.setattr(synth, "PIECE_ROWS", 10)
    sizes = dealt(keys).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= 100 and max(r["count"] for r in sizes) <= 30
    assert sorted(r["p_partkey"] for r in dealt(keys).collect()) == list(range(1000))
