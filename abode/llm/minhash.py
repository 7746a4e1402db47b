"""MinHash near-duplicates with tensored banding.

1. One pass makes each document's set of word shingles, a 128-bit key of the
   set, and two collections of ``m`` short keys, each of ``r`` minhashes:
   2*m*r minhashes in all.  Equal sets become one class.
2. Tensoring: table (i, j) has the pair (key i of the first collection, key j
   of the second), so m*m tables of 2*r minhashes cost 2*m*r minhashes.  A
   short key that no other class has can't be part of a shared pair, so only
   shared short keys are paired.
3. Buckets link as stars: each class goes to the head with which it shares
   most buckets, and full sets confirm the link.  Buckets whose members are
   still in several components get new heads (the member with most links).
   Members of what is then left over meet by an exact prefix filter on their
   full sets.  Pairs within a component are never formed, no bucket is cut.
4. Components by min-label hooking; the result is one row per document.

At similarity 0.75 with m = 17 and r = 4 a pair shares a bucket with
probability (1 - (1 - 0.75^4)^17)^2 = 0.997, at 0.8 with 0.9997.

Defined results: null or empty texts have no shingles and link with nothing;
fewer words than a shingle make one shingle; rows with a null doc_id are left
unlinked (component null, kept); rows that share a doc_id are one document;
other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abode.llm.common import U64, bounded_batches, mix64, odd_constants, window_hash, word_hash, words_of, written
from abode.llm.components import merge_components

SHINGLE = 5
KEYS = 17
PER_KEY = 4
STAR_ROUNDS = 2
CHUNK = 1 << 18  # shingles hashed at a time


def ascii_lower(text: str | None) -> list[bytes]:
    return [] if not text else text.encode("utf-8", "surrogatepass").lower().split()


def shingle_sets(texts: list[str | None], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    cache, out = word_hash(), []
    for t in texts:
        h = cache.many(ascii_lower(t))
        out.append(np.unique(window_hash(h, min(k, len(h)), 11)) if len(h) else h)
    return out


def short_keys(sets: list[np.ndarray], m: int, r: int) -> np.ndarray:
    """(documents, 2*m) keys; rows of empty sets are zero."""
    full = [i for i, s in enumerate(sets) if len(s)]
    out = np.zeros((len(sets), 2 * m), U64)
    a, b = odd_constants(2 * m * r, 21), odd_constants(2 * m * r, 22)
    i = 0
    while i < len(full):
        part, size = [full[i]], len(sets[full[i]])
        while i + len(part) < len(full) and size + len(sets[full[i + len(part)]]) <= CHUNK:
            part.append(full[i + len(part)])
            size += len(sets[part[-1]])
        i += len(part)
        flat = np.concatenate([sets[x] for x in part])
        starts = np.r_[0, np.cumsum([len(sets[x]) for x in part])[:-1]]
        for key in range(2 * m):
            acc = np.full(len(part), key + 1, U64)
            for t in range(key * r, key * r + r):
                low = np.minimum.reduceat(((flat * a[t] + b[t]) >> U64(32)).astype(np.uint32), starts)
                acc = mix64(acc * U64(0x9E3779B97F4A7C15) + low)
            out[part, key] = acc
    return out


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, whatever its order."""
    hi, lo = mix64(s + U64(0x5851F42D4C957F2D)).sum(dtype=U64), mix64(s ^ U64(0x14057B7EF767814F)).sum(dtype=U64)
    return int(hi.view(np.int64)), int(lo.view(np.int64))


def signatures(docs: DataFrame, k: int = SHINGLE, m: int = KEYS, r: int = PER_KEY) -> DataFrame:
    """doc_id, n, hi, lo, keys for (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = shingle_sets(part.column(1).to_pylist(), k)
                keys = short_keys(sets, m, r).view(np.int64)
                ids = [set_key(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([x[0] for x in ids], pa.int64()),
                     pa.array([x[1] for x in ids], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * 2 * m, pa.int32()), pa.array(keys.ravel()))],
                    names=["doc_id", "n", "hi", "lo", "keys"])

    return docs.mapInArrow(run, "doc_id long, n long, hi long, lo long, keys array<long>")


def sets_of(docs: DataFrame, k: int) -> DataFrame:
    """node, shingles for (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = shingle_sets(part.column(1).to_pylist(), k)
                offs = np.r_[0, np.cumsum([len(s) for s in sets])]
                flat = np.concatenate([*sets, np.zeros(0, U64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(flat))], names=["node", "shingles"])

    return docs.mapInArrow(run, "node long, shingles array<long>")


def alike(a: Column, b: Column, percent: int) -> Column:
    both = F.size(F.array_intersect(a, b))
    return 100 * both >= percent * (F.size(a) + F.size(b) - both)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike."""
    sa, sb = sets.toDF("a", "sa"), sets.toDF("b", "sb")
    sized = percent * F.greatest(F.size("sa"), F.size("sb")) <= 100 * F.least(F.size("sa"), F.size("sb"))
    return (pairs.join(sa, "a").join(sb, "b").where(sized & alike(F.col("sa"), F.col("sb"), percent))
            .select("a", "b"))


def rare_pairs(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, comp) in different components that can
    be alike: exact prefix filter.  Shingles are ordered by how many of these
    nodes have them, rarest first; two sets that are alike share one within
    their first ``n - ceil(percent% of n) + 1``, at places that leave enough
    of both sets behind it.  Passages that many texts share come last in that
    order, so they pair nothing."""
    s = nodes.join(sets, "node").select("node", "comp", F.explode("shingles").alias("x")).distinct()  # rows may share a doc_id
    s = written(s, "open-shingles")
    common = s.groupBy("x").agg(F.count("*").alias("c"))
    every, place = Window.partitionBy("node"), F.row_number().over(Window.partitionBy("node").orderBy("c", "x"))
    need = F.ceil(F.lit(percent) * F.col("n") / 100)
    first = (s.join(common, "x").withColumn("p", place).withColumn("n", F.count("*").over(every)).where((F.col("c") > 1) & (F.col("p") <= F.col("n") - need + 1)))
    first = written(first.select("x", "node", "comp", "n", "p"), "prefixes")
    a, b = first.toDF("x", "a", "ca", "na", "pa"), first.toDF("x", "b", "cb", "nb", "pb")
    fits = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (
        (100 + percent) * (1 + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))) >= percent * (F.col("na") + F.col("nb")))
    return a.join(b, "x").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & fits).select("a", "b").distinct()


def buckets_of(reps: DataFrame, m: int) -> DataFrame:
    """bucket, node: every pair of a shared key of each collection."""
    keys = reps.select("node", F.posexplode("keys").alias("i", "key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    mine = keys.join(shared, "key").groupBy("node").agg(
        F.collect_list(F.when(F.col("i") < m, F.col("key"))).alias("g"), F.collect_list(F.when(F.col("i") >= m, F.col("key"))).alias("h"))
    pairs = F.flatten(F.transform("g", lambda x: F.transform("h", lambda y: F.xxhash64(x, y))))
    return mine.where("size(g) > 0 and size(h) > 0").select("node", F.explode(pairs).alias("bucket"))


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = 75, m: int = KEYS, r: int = PER_KEY,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``."""
    bounded_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sig = written(signatures(src, k, m, r), "signatures")
    real = sig.where("n > 0 and doc_id is not null")
    classes = written(real.groupBy("hi", "lo", "n").agg(F.min("doc_id").alias("node")), "classes")
    reps = real.join(classes.withColumnRenamed("node", "doc_id"), ["doc_id", "hi", "lo", "n"]).dropDuplicates(["doc_id", "hi", "lo", "n"])
    full = buckets_of(reps.withColumnRenamed("doc_id", "node"), m)
    many = full.groupBy("bucket").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head <> last")
    buckets = written(full.join(many.select("bucket", "head"), "bucket"), "buckets")
    labels = written(buckets.select("node").distinct().select("node", F.col("node").alias("comp")), "labels")
    sets = written(sets_of(src.join(labels.select(F.col("node").alias("doc_id")), "doc_id", "left_semi"), k), "sets")

    votes = buckets.where("node <> head").groupBy("node", "head").agg(F.count("*").alias("v"))
    pairs = votes.groupBy("node").agg(F.max_by("head", F.struct("v", -F.col("head"))).alias("head"))
    tested = written(pairs.select(F.col("node").alias("a"), F.col("head").alias("b")), "pairs")
    links = written(confirm(tested, sets, percent), "links")
    labels = merge_components(labels, links)
    for turn in range(STAR_ROUNDS + 1):
        # buckets that still hold several components
        here = buckets.select("bucket", "node").join(labels, "node")
        open_ = here.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("bucket")
        here = written(here.join(open_, "bucket"), "open")
        if here.isEmpty():
            break
        if turn < STAR_ROUNDS:
            degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("deg"))
            graded = here.join(degree, "node", "left").fillna({"deg": 0})
            heads = graded.groupBy("bucket").agg(F.max_by(F.struct("node", "comp"), F.struct("deg", -F.col("node"))).alias("t"))
            far = (here.join(heads, "bucket").where("comp <> t.comp")
                   .groupBy("node", F.col("t.comp").alias("c"), F.col("t.node").alias("head")).agg(F.count("*").alias("v")))
            new = far.groupBy("node", "c").agg(F.max_by("head", F.struct("v", -F.col("head"))).alias("head")).select(
                F.col("node").alias("a"), F.col("head").alias("b"))
        else:
            new = rare_pairs(here.select("node", "comp").distinct(), sets, percent)
        seen = tested.unionAll(tested.select("b", "a").toDF("a", "b"))
        new = written(new.join(seen, ["a", "b"], "left_anti"), "pairs")
        got = written(confirm(new, sets, percent), "links")
        tested, links = tested.unionAll(new), links.unionAll(got)
        labels = merge_components(labels, got)
    node = F.coalesce("comp", "node")
    named = classes.join(labels, "node", "left").select("hi", "lo", F.col("n").alias("n_"), node.alias("component"))
    out = sig.join(named, (sig["hi"] == named["hi"]) & (sig["lo"] == named["lo"]) & (sig["n"] == named["n_"]), "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
