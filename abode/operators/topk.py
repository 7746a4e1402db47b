"""Exact top-k of a query set against a corpus, without materialising pairs.

Plan
----
1. Each side gets a block id from a hash of its key (uniform by
   construction, so a hot *value* cannot skew a block).  Query rows are
   replicated to every corpus block, corpus rows to every query block.
2. ``cogroup(qb, cb).applyInArrow`` scores one (query block x corpus block)
   tile in numpy — a matrix product for dense vectors, inverted lists
   with skipping for lexical cosine (``postings``) — and emits only that
   tile's top-k per query (ties broken by ascending corpus key, exactly).  A
   matrix product rounds differently per tile shape, so it only picks dense
   candidates (with a margin over its rounding error, ``Dense``); their scores are
   summed in the order of the dimensions and so are the same in every block layout.
3. A window ``row_number() over (partition by query order by score desc,
   key)`` merges at most ``blocks_c * k`` candidates per query; its literal
   largest-k bound gives a map-side partial ``WindowGroupLimit``.

Shuffle volume is ``n_q * blocks_c + n_c * blocks_q`` rows.  Dense tiles are
square with side sqrt(TILE_MADDS / d), the least shuffle for a fixed tile
cost; score chunks are capped, so a tile fits a task's memory at any scale.
No pair table and no driver collect: only the sizing job's few aggregates
(row counts, largest k, dimension) reach the driver.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from abode.operators.postings import Postings
from abode.session import shared_dir

# rows of a lexical query block scored at once (bounds the tile's working set):
# at most 512, and at most 16M scores (128 MB) per chunk
_ROW_CHUNK = 512
_CHUNK_SCORES = 1 << 24


def _row_chunk(nc: int) -> int:
    return max(1, min(_ROW_CHUNK, _CHUNK_SCORES // max(nc, 1)))


# ---------------------------------------------------------------------------
# numpy kernels (run inside tasks)
# ---------------------------------------------------------------------------

def _matrix(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """list<float> column -> float64 (n, d) matrix; all rows must share d."""
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    n = len(arr)
    if n == 0:
        return np.zeros((0, 0))
    if arr.null_count:
        raise ValueError("null vector in top-k input")
    offs = arr.offsets.to_numpy()
    lens = np.diff(offs)
    d = int(lens[0])
    if not np.all(lens == d):
        raise ValueError("vectors of different dimension in top-k input")
    vals = arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if not np.isfinite(vals).all():
        raise ValueError("vector with a missing or infinite element in top-k input")
    return vals.reshape(n, d)


def _ranked(rows: np.ndarray, cols: np.ndarray, sc: np.ndarray, kk: np.ndarray):
    """The first ``kk[row]`` candidates of each row by score desc, col."""
    order = np.lexsort((cols, -sc, rows))
    rows, cols, sc = rows[order], cols[order], sc[order]
    first = np.searchsorted(rows, rows, side="left")
    rank = np.arange(len(rows)) - first + 1
    keep = rank <= kk[rows]
    return rows[keep], cols[keep], sc[keep]


def _ordered_products(qv: np.ndarray, cv: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Inner products of the pairs (rows, cols), summed dimension by dimension:
    a pair's score depends on its two vectors alone."""
    d = qv.shape[1]
    out = np.zeros(len(rows))
    step = max(1, (1 << 18) // max(d, 1))
    for lo in range(0, len(rows), step):
        a, b = qv[rows[lo:lo + step]].T.copy(), cv[cols[lo:lo + step]].T.copy()
        for j in range(d):
            out[lo:lo + step] += a[j] * b[j]
    return out


# scores held at once: a step of the queries against a step of the corpus (4 MB in single precision)
_DENSE_ROWS, _DENSE_COLS = 512, 2048


class Dense:
    """Corpus vectors of one tile, in the order of their keys, for exact top-k
    in little memory.

    Products in single precision (both sides scaled to about 1) only pick
    candidates: a pair's product is off by at most ``(d + 4) * 2^-23`` of the
    vectors' lengths, and every column within four times that of the k-th best
    so far is kept.  Their ordered sums decide, so rows are the same for any
    tile shape.  If lengths differ so much that this would keep many columns,
    products are in double precision.  Of equal vectors only the first ``most``
    can be hits; the others aren't scored."""

    def __init__(self, cv: np.ndarray, most: int):
        self.at = _first_copies(cv, most)
        self.cv = cv if len(self.at) == len(cv) else cv[self.at]
        self.unit = float(np.abs(self.cv).max(initial=0.0)) or 1.0
        u = self.cv / self.unit
        length = np.linalg.norm(u, axis=1)
        self.longest = float(length.max(initial=0.0))
        single = len(length) > 0 and float(length.min()) * 64 >= self.longest
        self.kind, self.error = (np.float32, 2.0**-23) if single else (np.float64, 2.0**-52)
        self.u = u.astype(self.kind, copy=False)

    def topk(self, qv: np.ndarray, k: np.ndarray, floor: np.ndarray | None = None):
        """(row, column, score) of each query's first ``k`` by score desc, column;
        of those with a score of ``floor`` at least, where it is given."""
        d, parts = qv.shape[1], []
        for a in range(0, len(qv), _DENSE_ROWS):
            q, kk = qv[a:a + _DENSE_ROWS], np.minimum(k[a:a + _DENSE_ROWS], len(self.cv))
            unit = np.abs(q).max(axis=1, initial=0.0)
            unit[unit == 0] = 1.0
            u = q / unit[:, None]
            room = 4 * (d + 4) * self.error * np.linalg.norm(u, axis=1) * self.longest
            low = np.full(len(q), -np.inf) if floor is None else floor[a:a + _DENSE_ROWS] / (unit * self.unit)
            low = np.where(kk > 0, low, np.inf)
            rows, cols = self._candidates(u.astype(self.kind, copy=False), kk, low, room)
            found = _ranked(rows, cols, _ordered_products(q, self.cv, rows, cols), kk)
            parts.append((found[0] + a, self.at[found[1]], found[2]))
        if not parts:
            e = np.zeros(0, dtype=np.int64)
            return e, e, np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _candidates(self, u: np.ndarray, kk: np.ndarray, low: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Columns whose product may be among a row's first ``kk`` and at or above ``low``."""
        most, n = int(kk.max(initial=0)), len(kk)
        rows, cols, near = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.kind)
        for lo in range(0, len(self.cv) if most > 0 else 0, _DENSE_COLS):
            s = u @ self.u[lo:lo + _DENSE_COLS].T
            if s.shape[1] > most and np.isneginf(low).any():
                low = np.maximum(low, np.partition(s, s.shape[1] - most, axis=1)[:, s.shape[1] - most])
            r, c = np.nonzero(s >= (low - room).astype(self.kind)[:, None])
            if not len(r):
                continue
            rows, cols, near = np.r_[rows, r], np.r_[cols, c + lo], np.r_[near, s[r, c]]
            order = np.lexsort((-near, rows))
            rows, cols, near = rows[order], cols[order], near[order]
            first = np.searchsorted(rows, np.arange(n + 1))
            at = first[:-1] + kk - 1
            full = (kk > 0) & (at < first[1:])
            low = low.copy()
            low[full] = np.maximum(low[full], near[at[full]])
            keep = near >= (low - room)[rows]
            rows, cols, near = rows[keep], cols[keep], near[keep]
        return rows, cols


def _first_copies(cv: np.ndarray, most: int) -> np.ndarray:
    """Rows of a matrix without those that equal ``most`` earlier ones."""
    n = len(cv)
    mix = np.arange(1, 2 * cv.shape[1], 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (np.ascontiguousarray(cv).view(np.uint64) * mix).sum(axis=1, dtype=np.uint64)
    order = np.argsort(h, kind="stable")
    start = np.flatnonzero(np.r_[True, h[order[1:]] != h[order[:-1]]]) if n else np.zeros(0, np.int64)
    size = np.diff(np.r_[start, n])
    gone = np.zeros(n, bool)
    for a, m in zip(start[size > most], size[size > most], strict=True):
        group = order[a:a + m]
        same = (cv[group] == cv[group[0]]).all(axis=1)  # a hash may be shared by chance
        gone[group[same][max(most, 0):]] = True
    return np.flatnonzero(~gone)


def _make_tile_fn(kind: str, qkey: str, ckey: str, qcol: str, ccol: str, kcol: str,
                  score_type: pa.DataType, key_types: tuple):
    qkt, ckt = key_types
    out_schema = pa.schema([(qkey, qkt), (ckey, ckt), ("__score", pa.float64()), ("__k", pa.int32()),
                            ("__rank", pa.int32())])

    def fn(qt: pa.Table, ct: pa.Table) -> pa.Table:
        if qt.num_rows == 0 or ct.num_rows == 0:
            return out_schema.empty_table()
        # both sides sorted by key: a retried task sees the same matrices in
        # the same order, so its scores and ranks are bit-identical
        ckeys = ct.column(ckey).to_numpy(zero_copy_only=False)
        order = np.argsort(ckeys, kind="stable")
        ct = ct.take(pa.array(order))
        ckeys = ckeys[order]
        qorder = np.argsort(qt.column(qkey).to_numpy(zero_copy_only=False), kind="stable")
        qt = qt.take(pa.array(qorder))
        qkeys = qt.column(qkey)
        k = qt.column(kcol).to_numpy().astype(np.int64)
        nq, nc = qt.num_rows, ct.num_rows
        outs = []
        if kind == "dense":
            cv = _matrix(ct.column(ccol))
            qv_all = _matrix(qt.column(qcol))
            if qv_all.shape[1] != cv.shape[1]:
                raise ValueError(f"query dim {qv_all.shape[1]} != corpus dim {cv.shape[1]}")
            outs.append(Dense(cv, int(k.max())).topk(qv_all, k))
        else:
            chunk = _row_chunk(nc)
            lists = Postings(ct.column(ccol))
            qtab = qt.column(qcol)
            for lo in range(0, nq, chunk):
                hi = min(nq, lo + chunk)
                rows, cols, sc, _ = lists.topk(qtab.slice(lo, hi - lo), k[lo:hi])
                rows, cols, sc = _ranked(rows, cols, sc, k[lo:hi])
                outs.append((rows + lo, cols, sc))
        rows = np.concatenate([o[0] for o in outs])
        cols = np.concatenate([o[1] for o in outs])
        sc = np.concatenate([o[2] for o in outs])
        rank = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left") + 1
        return pa.table({
            qkey: qkeys.take(pa.array(rows)),
            ckey: pa.array(ckeys[cols], type=ckt),
            "__score": pa.array(sc, type=pa.float64()),
            "__k": pa.array(k[rows].astype(np.int32), type=pa.int32()),
            "__rank": pa.array(rank.astype(np.int32), type=pa.int32()),
        }, schema=out_schema)

    return fn


_ARROW = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.StringType(): pa.string()}


# multiply-adds in one dense tile (block_q x block_c x d): a few seconds of one
# core.  For a fixed tile cost, shuffle (n_q*n_c*d*(1/block_q + 1/block_c)) is
# smallest with square blocks, so the side is sqrt(TILE_MADDS / d).
TILE_MADDS = 1 << 34
BLOCK_MIN, BLOCK_MAX = 1024, 65536


def dense_block(d: int) -> int:
    """Square tile side for vectors of dimension ``d``."""
    return max(BLOCK_MIN, min(BLOCK_MAX, int(math.sqrt(TILE_MADDS / max(d, 1)))))


# byte budget for any broadcast of a ranking (proven rows x estimated width)
BROADCAST_BYTES_MAX = 64 << 20


def est_row_bytes(t: T.DataType) -> int:
    """Conservative width of one value of ``t`` (strings 96 B, arrays 8
    elements), used with a proven row bound before deciding a broadcast."""
    if isinstance(t, T.StructType):
        return 8 + sum(est_row_bytes(f.dataType) for f in t.fields)
    if isinstance(t, T.ArrayType):
        return 16 + 8 * est_row_bytes(t.elementType)
    if isinstance(t, (T.StringType, T.BinaryType)):
        return 96
    return 8


def _sizes(q: DataFrame, c: DataFrame, kind: str, write: bool) -> tuple[int, int, int, int, DataFrame | pa.Table]:
    """(queries, largest k, dimension, corpus rows, queries): what the block plan needs.

    Dense queries that are small come back as a table.  Otherwise, with
    ``write``, the distinct query set - small next to the request log - is
    written once to the shared checkpoint folder, so scoring and retries start
    there, and measured by the same job.  The corpus is counted meanwhile."""
    d = F.size("__qv") if kind == "dense" else F.lit(0)
    measures = [F.count(F.lit(1)).alias("n"), F.max("__kq").alias("kmax"), F.max(d).alias("d")]
    with ThreadPoolExecutor(1) as pool:
        corpus = pool.submit(inheritable_thread_target(c.sparkSession)(c.count))
        if kind == "dense":
            small = _small_queries(q)
            if small is not None:
                k = small.column("__kq")
                dim = len(small.column("__qv")[0]) if len(small) and small.column("__qv")[0].is_valid else 1
                return len(small), int(pc.max(k).as_py() or 0), dim, corpus.result(), small
        if write:
            shared_dir(q.sparkSession)
            seen = Observation()
            q = q.observe(seen, *measures).checkpoint(eager=True)
            got = seen.get
        else:
            got = q.agg(*measures).first().asDict()
        return got["n"] or 0, int(got["kmax"] or 0), int(got["d"] or 1), corpus.result(), q


# rows and numbers of a dense query set that goes to the corpus as a whole (32 MB as doubles)
SMALL_ROWS, SMALL_QUERIES = 8192, 4 << 20


def _small_queries(q: DataFrame) -> pa.Table | None:
    """The query set as a table, if it has at most ``SMALL_ROWS`` rows (one more
    is fetched to know) and ``SMALL_QUERIES`` numbers."""
    got = q.limit(SMALL_ROWS + 1).toArrow()
    return got if len(got) <= SMALL_ROWS and len(got.column("__qv").combine_chunks().flatten()) <= SMALL_QUERIES else None


def _topk_of_splits(q: pa.Table, corpus: DataFrame, qkey: str, ckey: str, schema: T.StructType) -> DataFrame:
    """Each corpus split's best rows for every query of the (small) set: the
    corpus isn't exchanged, only ``queries x k`` rows leave a task."""
    q = q.take(pa.array(np.argsort(q.column(qkey).to_numpy(zero_copy_only=False), kind="stable")))
    keys, k, qv = q.column(qkey).combine_chunks(), q.column("__kq").to_numpy().astype(np.int64), _matrix(q.column("__qv"))
    sent = corpus.sparkSession.sparkContext.broadcast((keys, k, qv))

    def run(batches):
        keys, k, qv = sent.value
        best = None
        for b in batches:
            if not b.num_rows:
                continue
            ck, cv = b.column(0).to_numpy(zero_copy_only=False), _matrix(b.column(1))
            if cv.shape[1] != qv.shape[1]:
                raise ValueError(f"query dim {qv.shape[1]} != corpus dim {cv.shape[1]}")
            order = np.argsort(ck, kind="stable")
            ck, cv, floor = ck[order], cv[order], np.full(len(k), -np.inf)
            if best is not None:  # a row's k-th best score so far: what is below isn't a hit
                first = np.searchsorted(best[0], np.arange(len(k) + 1))
                full = (k > 0) & (first[1:] - first[:-1] >= k)
                floor[full] = best[2][first[:-1][full] + k[full] - 1]
            rows, cols, sc = Dense(cv, int(k.max(initial=0))).topk(qv, k, floor)
            found = [(rows, ck[cols], sc)] if best is None else [best, (rows, ck[cols], sc)]
            best = _ranked(*(np.concatenate(x) for x in zip(*found, strict=True)), k)
        if best is not None:
            rows, ck, sc = best
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(rows)), pa.array(ck, _ARROW[schema[1].dataType]), pa.array(sc), pa.array(k[rows].astype(np.int32)),
                 pa.array(np.zeros(len(rows), np.int32))], names=schema.fieldNames())

    return corpus.mapInArrow(run, schema)


def exact_topk(queries: DataFrame, corpus: DataFrame, *, qkey: str, qcol: str, kcol: str,
               ckey: str, ccol: str, kind: str = "dense",
               score_col: str = "score", rank_col: str = "rank",
               block_q: int | None = None, block_c: int | None = None,
               min_parallel_pairs: float = 5e7, with_bound: bool = False,
               materialize_queries: bool = True):
    """Top-``kcol`` corpus rows per query row, ranked by score desc, key asc.

    ``kind='dense'``: ``qcol``/``ccol`` are ARRAY<FLOAT|DOUBLE> vectors and the
    score is their inner product.  ``kind='lexical'``: they are ARRAY<STRING>
    token lists, or structs <terms, weights> of ``terms.term_encoder``, and the
    score is the cosine of term counts or weights (pairs without a shared term
    are never returned).  Query keys must be unique.
    Returns (qkey, ckey, score DOUBLE, rank INT); with ``with_bound`` also an
    upper bound on its row count (queries x largest k), used to decide a
    broadcast downstream.
    """
    if kind not in ("dense", "lexical"):
        raise ValueError(f"unknown kind {kind!r}")
    spark = queries.sparkSession
    # fresh attribute ids: both sides may derive from one table (self-join)
    q = queries.select(F.col(qkey).alias(qkey), F.col(qcol).alias("__qv"),
                       F.col(kcol).cast("int").alias("__kq"))
    c = corpus.select(F.col(ckey).alias(ckey), F.col(ccol).alias("__cv"))
    nq, kmax, dim, nc, q = _sizes(q, c, kind, materialize_queries)
    if kind == "dense":
        side = dense_block(dim)
        block_q, block_c = block_q or side, block_c or side
    else:
        # lexical tiles pay per corpus token: keep query blocks small
        block_q, block_c = block_q or 4096, block_c or 16384
    bound = nq * min(kmax, nc)
    if nq == 0 or nc == 0:
        out = _empty(spark, queries, corpus, qkey, ckey, score_col, rank_col)
        return (out, 0) if with_bound else out
    qkt = _ARROW.get(queries.schema[qkey].dataType)
    ckt = _ARROW.get(corpus.schema[ckey].dataType)
    if qkt is None or ckt is None:
        raise TypeError("top-k keys must be BIGINT, INT or STRING")
    out_schema = T.StructType([
        T.StructField(qkey, queries.schema[qkey].dataType),
        T.StructField(ckey, corpus.schema[ckey].dataType),
        T.StructField("__score", T.DoubleType()),
        T.StructField("__k", T.IntegerType()),
        T.StructField("__rank", T.IntegerType()),
    ])
    bq = max(1, math.ceil(nq / block_q))
    bc = max(1, math.ceil(nc / block_c))
    par = spark.sparkContext.defaultParallelism
    if isinstance(q, pa.Table) and bq == 1 and bc > 1:
        # one query block: every corpus split meets the whole query set
        tiles = _topk_of_splits(q, c, qkey, ckey, out_schema)
        bc = 0
    else:
        if isinstance(q, pa.Table):
            q = spark.createDataFrame(q)
        if bq * bc < par and (kind == "lexical" or nq * nc >= min_parallel_pairs):
            # enough work to spread (lexical tiles pay per corpus token, whatever
            # the query count): split the corpus finer (min 1024 rows/block)
            bc = max(bc, min(math.ceil(par / bq), math.ceil(nc / 1024)))
        qb = F.pmod(F.xxhash64(F.col(qkey)), F.lit(bq)).cast("int")
        cb = F.pmod(F.xxhash64(F.col(ckey)), F.lit(bc)).cast("int")
        qx = q.select("*", qb.alias("__qb"), F.explode(F.sequence(F.lit(0), F.lit(bc - 1))).alias("__cb"))
        cx = c.select("*", cb.alias("__cb"), F.explode(F.sequence(F.lit(0), F.lit(bq - 1))).alias("__qb"))
        fn = _make_tile_fn(kind, qkey, ckey, "__qv", "__cv", "__kq", pa.float64(), (qkt, ckt))
        tiles = (qx.groupBy("__qb", "__cb")
                   .cogroup(cx.groupBy("__qb", "__cb"))
                   .applyInArrow(fn, out_schema))
    if bc == 1:
        # one corpus block: each query's tile is already its exact top-k
        out = tiles.select(qkey, ckey, F.col("__score").alias(score_col), F.col("__rank").alias(rank_col))
    else:
        w = Window.partitionBy(qkey).orderBy(F.desc("__score"), F.asc(ckey))
        # the literal bound (largest k) lets Spark cut candidates per key on
        # the map side before the merge shuffle (partial WindowGroupLimit)
        out = (tiles.withColumn(rank_col, F.row_number().over(w))
                    .filter((F.col(rank_col) <= F.lit(kmax)) & (F.col(rank_col) <= F.col("__k")))
                    .select(qkey, ckey, F.col("__score").alias(score_col),
                            F.col(rank_col).cast("int").alias(rank_col)))
    return (out, bound) if with_bound else out


def exact_topk_of_members(queries: DataFrame, vectors: DataFrame, members: DataFrame, *, qkey: str, qcol: str, kcol: str,
                          vkey: str, vcol: str, ckey: str, score_col: str = "score", rank_col: str = "rank") -> DataFrame:
    """``exact_topk`` of a corpus whose rows (``members``: ckey, vkey; a ckey has
    one vkey) point to a table of vectors (vkey, vcol), several to one vector
    or not: each vector is scored once, however many rows point to it.

    Vectors stand in the ranking at their smallest member key.  A vector that k
    others stand before has no hit, as each of those has a row that stands
    before all of its own; of the first k, those count that fewer than k members
    of better vectors stand before, each with its k smallest keys.
    Query keys may repeat: each query row has hits of its own.
    Returns (qkey, ckey, score DOUBLE, rank INT)."""
    asked = (queries.groupBy(F.col(qkey).alias("__of"), F.col(qcol).alias("__qv"), F.col(kcol).cast("int").alias("__kq")).agg(F.count(F.lit(1)).alias("__copies"))
             .withColumn("__q", F.md5(F.to_json(F.struct("__of", "__qv", "__kq")))))
    most = queries.agg(F.max(F.col(kcol)).cast("int")).first()[0] or 0
    place = Window.partitionBy("__vkey").orderBy(ckey)
    held = (members.select(F.col(vkey).alias("__vkey"), ckey).where("__vkey is not null")
            .withColumn("__at", F.row_number().over(place)).where(F.col("__at") <= max(most, 1)))
    first = held.groupBy("__vkey").agg(F.min(ckey).alias("__first"), F.count(F.lit(1)).alias("__n"))
    corpus = vectors.select(F.col(vkey).alias("__vkey"), F.col(vcol).alias("__vector")).join(first.drop("__n"), "__vkey").drop("__vkey")
    ranked = exact_topk(asked, corpus, qkey="__q", qcol="__qv", kcol="__kq", ckey="__first", ccol="__vector", score_col=score_col, rank_col="__place")
    ranked = ranked.join(first.select("__first", "__n"), "__first").join(asked.select("__q", "__of", "__kq", "__copies"), "__q")
    better = Window.partitionBy("__q").orderBy(F.desc(score_col)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    equal = Window.partitionBy("__q", score_col)
    few = ranked.withColumn("__before", F.sum("__n").over(better) - F.sum("__n").over(equal)).where("__before < __kq")
    rows = few.join(held.join(first.select("__vkey", "__first"), "__vkey").select("__first", ckey), "__first")
    w = Window.partitionBy("__q").orderBy(F.desc(score_col), F.asc(ckey))
    best = rows.withColumn(rank_col, F.row_number().over(w)).where((F.col(rank_col) <= max(most, 1)) & (F.col(rank_col) <= F.col("__kq")))
    return (best.withColumn("__copy", F.explode(F.expr("sequence(1L, __copies)")))
            .select(F.col("__of").alias(qkey), ckey, score_col, F.col(rank_col).cast("int").alias(rank_col)))


# requests per key above which a key's requests are split over several tasks
SALT_ROWS = 1_000_000


def salted_join(left: DataFrame, right: DataFrame, key: str, row_key: str, how: str = "inner") -> DataFrame:
    """Shuffle join of a large ``left`` (requests, unique ``row_key``) with a
    ``right`` side holding one row (or a few) per ``key``, where one key may
    carry a third of all left rows.

    One small job counts left rows per key and finds the hot keys (more than
    ``SALT_ROWS`` rows).  Their number is known exactly, so the hot set is
    broadcast only under the byte budget.  A hot key gets ``ceil(n /
    SALT_ROWS)`` salts: its left rows take ``xxhash64(row_key) mod salts``
    and only its right rows are replicated once per salt; every other key
    keeps salt 0.  The join then runs on (key, salt), so no task receives
    more than about ``SALT_ROWS`` rows of one key, and no row is dropped."""
    # a null key meets nothing: its rows pass by the join instead of filling one partition
    lost, left = left.where(F.col(key).isNull()), left.where(F.col(key).isNotNull())
    joined = _salted(left, right, key, row_key, how)
    return joined.unionByName(lost, allowMissingColumns=True) if how == "left" else joined


def _salted(left: DataFrame, right: DataFrame, key: str, row_key: str, how: str) -> DataFrame:
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    hot = counts.filter(F.col("__n") > SALT_ROWS).select(
        key, F.ceil(F.col("__n") / F.lit(SALT_ROWS)).cast("int").alias("__s"))
    n_hot = hot.count()
    if n_hot == 0:
        return left.join(right, key, how)
    if n_hot * (16 + est_row_bytes(left.schema[key].dataType)) <= BROADCAST_BYTES_MAX:
        hot = F.broadcast(hot)
    salts = F.coalesce(F.col("__s"), F.lit(1))
    lx = (left.join(hot, key, "left")
              .withColumn("__salt", F.pmod(F.xxhash64(F.col(row_key)), salts).cast("int")).drop("__s"))
    rx = (right.join(hot, key, "left")
               .withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__s"))
    return lx.join(rx, [key, "__salt"], how).drop("__salt")


def join_ranked(requests: DataFrame, ranked: DataFrame, bound: int, key: str,
                row_key: str = "qid") -> DataFrame:
    """Requests x their key's ranking.  The ranked side has at most ``bound``
    rows (distinct keys x k); it is broadcast only when that proven bound
    times its estimated row width fits the byte budget, otherwise both sides
    shuffle on the key with hot keys salted (``salted_join``)."""
    if bound * est_row_bytes(ranked.schema) <= BROADCAST_BYTES_MAX:
        return requests.join(F.broadcast(ranked), key)
    return salted_join(requests, ranked, key, row_key)


def _empty(spark, queries, corpus, qkey, ckey, score_col, rank_col):
    schema = T.StructType([
        T.StructField(qkey, queries.schema[qkey].dataType),
        T.StructField(ckey, corpus.schema[ckey].dataType),
        T.StructField(score_col, T.DoubleType()),
        T.StructField(rank_col, T.IntegerType()),
    ])
    return spark.createDataFrame([], schema)


def inner_product(a: str, b: str):
    """JVM-only inner product of two ARRAY<FLOAT> columns, by name (exact, double)."""
    return F.expr(f"aggregate(zip_with(`{a}`, `{b}`, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), "
                  "CAST(0 AS DOUBLE), (s, v) -> s + v)")
