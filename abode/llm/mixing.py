"""Mixing sources to target weights.

1. Sizes: words per document, summed per source.  Targets: the water level
   ``w`` at which ``sum(min(w * weight, cap * size))`` equals all words, which
   is where resharing the excess of stopped sources ends.  Ranks and running
   sums over sources come from range partitions and the partitions' totals, so
   a table with a source per web domain isn't one task either.
2. Packing: a source's documents, in a fixed pseudorandom order, form one
   stream of words, cut into blocks of ``block_words``.  Starts come from two-
   level running sums (hash buckets within a source, then the buckets), so a
   hot source is never one task.  Rows equal in id, source and text are one row
   with a number until their places are known.
3. Drawing: source s has ``q`` full passes over its ``n`` blocks and a rest,
   which is its number of slots.  How many of them each output shard gets is
   drawn from a multinomial, by binomials that halve the shards; a shard's
   slots are the next ones in number.
4. Slot ``t * n + k`` holds block ``perm_s(k)``, where ``perm_s`` is a Feistel
   permutation of the source's indices.  In the last pass blocks are taken in
   permuted order until the rest is reached, the last one cut to the words
   still due, so each source meets its target to a word and no block is taken
   more than ``ceil(target / size)`` times.
5. Slots and document segments join by (source, block).

Defined results: null or empty texts have size 0 and are taken 0 times; a null
source is a source, last in order; repeated rows are packed each; a null doc_id
is kept; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abode.llm.common import mix64, words_col, written

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3.0
BLOCK_WORDS = 512
SHARD_WORDS = 4_000_000
DOCS_PER_BUCKET = 20_000


ROUNDS = np.array([r * 0x9E3779B97F4A7C15 % 2**64 for r in range(4)], np.uint64)


def permute(k: np.ndarray, n: np.ndarray, key: np.ndarray, back: bool = False) -> np.ndarray:
    """Pseudorandom permutation of 0..n-1 (per row), or its inverse: a four-
    round Feistel network over the least even number of bits that holds n,
    walked until the value is below n (on average fewer than four steps)."""
    k, n, key = (np.asarray(x).astype(np.uint64) for x in (k, n, key))
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype(float))) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    out, todo = k.copy(), np.arange(len(k))
    while len(todo):
        left, right, m, s = out[todo] >> half[todo], out[todo] & mask[todo], mask[todo], key[todo]
        for r in ROUNDS[::-1] if back else ROUNDS:
            if back:
                left, right = right ^ (mix64(left + s + r) & m), left
            else:
                left, right = right, left ^ (mix64(right + s + r) & m)
        out[todo] = (left << half[todo]) | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def running(t: DataFrame, order: list[Column], name: str, **sums: str) -> DataFrame:
    """``t`` with columns ``<key>``: the sum of column ``sums[key]`` over the
    rows before each row in ``order`` (which must be a total order).  Rows are
    range-partitioned; a partition's first row starts at the partitions before it."""
    t = written(t.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), name)
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    parts = (t.groupBy("part").agg(*[F.sum(c).alias(f"of_{k}") for k, c in sums.items()])
             .select("part", *[F.coalesce(F.sum(f"of_{k}").over(earlier), F.lit(0)).alias(f"base_{k}") for k in sums]))
    for k, c in sums.items():
        t = t.withColumn(k, F.coalesce(F.sum(c).over(inside), F.lit(0)))
    t = t.join(parts, "part")
    for k in sums:
        t = t.withColumn(k, F.col(k) + F.col(f"base_{k}"))
    return t.drop("part", *[f"base_{k}" for k in sums])


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """source, source_size -> adds source_rank and target; one row per source."""
    w = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("source_rank"), F.lit(len(weights))).cast("int") + 1)
    t = running(sizes.withColumn("one", F.lit(1).cast("long")), [F.col("source").asc_nulls_last()], "source_ranks", source_rank="one")
    t = t.drop("one").withColumn("weight", w).withColumn("most", cap * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("weight"))
    t = written(t, "source_weights")
    every = t.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights")).first()
    words, all_weights = every["words"] or 0, every["weights"] or 0.0
    t = running(t, [F.col("ratio").asc(), F.col("source_rank").asc()], "source_levels", most_before="most", weight_before="weight")
    t = t.withColumn("level", (F.lit(words) - F.col("most_before")) / (F.lit(all_weights) - F.col("weight_before")))
    # sources in order of most/weight stop until the level fits below it; from there on every source takes the level
    free = t.where("level * weight <= most").agg(F.min(F.struct("ratio", "source_rank", "level")).alias("m")).first()["m"]
    target = F.least(F.lit(free["level"]) * F.col("weight"), F.col("most")) if free else F.col("most")
    return t.select("source", "source_size", "source_rank", target.alias("target"))


def pack(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, row_hash -> doc_id, source, size and the word at
    which each row starts in its source's stream."""
    same = docs.groupBy("doc_id", "source", "size", "row_hash").agg(F.count(F.lit(1)).alias("copies"))
    same = written(same, "distinct_rows")
    buckets = max(1, -(-same.count() // DOCS_PER_BUCKET))
    key = ["source", "bucket"]
    d = same.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "row_hash"), F.lit(buckets)))
    words = F.col("size") * F.col("copies")
    per = d.groupBy(*key).agg(F.sum(words).alias("s"))
    inner = Window.partitionBy(*key).orderBy(F.xxhash64(F.lit("order"), "doc_id", "row_hash"), "doc_id", "row_hash", "size")
    d = d.withColumn("inside", F.sum(words).over(inner.rowsBetween(Window.unboundedPreceding, -1)))
    outer = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("base", F.coalesce(F.sum("s").over(outer), F.lit(0))).select(
        F.col("source").alias("s_"), F.col("bucket").alias("b_"), "base")
    d = d.join(per, F.col("source").eqNullSafe(F.col("s_")) & (F.col("bucket") == F.col("b_")))
    d = d.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    return d.select("doc_id", "source", "size", (F.col("base") + F.coalesce("inside", F.lit(0)) + F.col("copy") * F.col("size")).alias("start"))


def slot_numbers(size: np.ndarray, due: np.ndarray, key: np.ndarray, block_words: int) -> tuple[np.ndarray, ...]:
    """(blocks, words missing in the last block, slot of the last block within a pass, slots) of sources with words."""
    n = -(-size // block_words)
    short = n * block_words - size
    at_last = permute(n - 1, n, key, back=True)
    rest = due % size
    # slots of the last pass start before ``rest``: those up to the short block's, then those after it
    upto = np.minimum(at_last + 1, -(-rest // block_words))
    after = np.maximum(0, np.minimum(n, -(-(rest + short) // block_words)) - (at_last + 1))
    return n, short, at_last, due // size * n + upto + np.where(rest > 0, after, 0)


def shard_counts(slots: int, shards: int, key: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(shard, slots drawn) where some are: multinomial with equal shares.
    The shards are halved level by level, each half's count a binomial."""
    lo, hi, count = np.array([0]), np.array([shards]), np.array([slots], np.int64)
    level = 0
    while (hi - lo).max(initial=0) > 1:
        mid = (lo + hi + 1) // 2
        left = np.random.default_rng([*key, level]).binomial(count, (mid - lo) / (hi - lo))
        lo, hi, count = (np.column_stack(x).ravel() for x in ((lo, mid), (mid, hi), (left, count - left)))
        on = (count > 0) & (lo < hi)
        lo, hi, count, level = lo[on], hi[on], count[on], level + 1
    return lo[count > 0], count[count > 0]


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, block_words: int = BLOCK_WORDS,
                seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(per-document result, slots).

    Result: doc_id, source, size, source_size, target, taken.  Slots: source,
    source_rank, slot, shard, block, words: the mix itself, as blocks to copy."""
    text = F.col(text_col).cast("string")
    sized = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                                F.size(words_col(text)).cast("long").alias("size"), F.xxhash64(text).alias("row_hash")), "sizes")
    targets = written(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap), "targets")
    total = int(targets.agg(F.sum("source_size").alias("n")).first()["n"] or 0)
    shards = max(1, -(-total // SHARD_WORDS))
    t = targets.select(F.col("source").alias("s_"), "source_size", "source_rank", F.round("target").cast("long").alias("due"), "target")
    packed = written(pack(sized).join(t, F.col("source").eqNullSafe(F.col("s_"))).drop("s_"), "packed")

    # segments: the part of a document in each block that it touches
    last = F.floor((F.col("start") + F.col("size") - 1) / block_words)
    seg = (packed.where("size > 0").select("doc_id", "source_rank", "start", "size",
                                           F.explode(F.sequence(F.floor(F.col("start") / block_words), last)).alias("block"))
           .withColumn("a", F.greatest(F.col("start") - F.col("block") * block_words, F.lit(0)))
           .withColumn("b", F.least(F.col("start") + F.col("size") - F.col("block") * block_words, F.lit(block_words))))
    def keys(p: pd.DataFrame) -> np.ndarray:
        return mix64(p.source_rank.to_numpy().astype(np.uint64) + np.uint64(seed))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.to_pandas()
            every = slot_numbers(p.source_size.to_numpy(), p.due.to_numpy(), keys(p), block_words)[3]
            for row, n in zip(p.itertuples(), every, strict=True):
                shard, c = shard_counts(int(n), shards, (seed, int(row.source_rank)))
                yield pa.RecordBatch.from_pandas(pd.DataFrame({
                    "source_rank": row.source_rank, "source_size": row.source_size, "due": row.due, "shard": shard.astype(np.int64),
                    "first": np.cumsum(c) - c, "count": c}), preserve_index=False)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # a shard of a source has some SHARD_WORDS / block_words slots
                p = batch.slice(at, 64).to_pandas()
                c = p["count"].to_numpy()
                row = np.repeat(np.arange(len(p)), c)
                slot = p["first"].to_numpy()[row] + np.arange(len(row)) - np.repeat(np.cumsum(c) - c, c)
                size, due, key = p.source_size.to_numpy(), p.due.to_numpy(), keys(p)
                n, short, at_last, _ = slot_numbers(size, due, key, block_words)
                n, short, at_last, size, due, key = (x[row] for x in (n, short, at_last, size, due, key))
                turn, k = np.divmod(slot, n)
                block = permute(k, n, key)
                length = np.where(block == n - 1, block_words - short, block_words)
                # words of the pass before slot k: all blocks are full but the last
                before = k * block_words - np.where(k > at_last, short, 0)
                words = np.where(turn < due // size, length, np.clip(due % size - before, 0, length))
                yield pa.RecordBatch.from_pandas(pd.DataFrame({
                    "source_rank": p.source_rank.to_numpy()[row], "slot": slot, "shard": p["shard"].to_numpy()[row],
                    "block": block, "words": words.astype(np.int64)}), preserve_index=False)

    drawn = written(t.where("source_size > 0 and due > 0").select(F.col("source_rank").cast("long"), F.col("source_size").cast("long"), "due").mapInArrow(
        count, "source_rank long, source_size long, due long, shard long, first long, count long"), "shard_counts")
    slots = written(drawn.repartition("source_rank", "shard").mapInArrow(
        fill, "source_rank long, slot long, shard long, block long, words long"), "slots")
    got = (seg.join(slots.select("source_rank", "block", "words"), ["source_rank", "block"])
           .withColumn("w", F.greatest(F.least("b", "words") - F.col("a"), F.lit(0)))
           .groupBy("source_rank", "start").agg(F.sum("w").alias("w")))
    s = packed.where("size > 0").join(got, ["source_rank", "start"], "left")
    cols = ["doc_id", "source", "size", "source_size", "target"]
    result = (s.select(*cols, F.coalesce("w", F.lit(0)).cast("long").alias("taken"))
              .unionAll(packed.where("size = 0").select(*cols, F.lit(0).cast("long").alias("taken"))))
    return result, slots

