"""Exact top-k by inner product that visits only the cells that can hold a hit.

The corpus is cut into cells around pivots (at most ``MAX_CELLS`` corpus rows
with the smallest key hashes); every row goes to its nearest pivot, a cell's
radius is its farthest row's distance.  For a query q, a cell with pivot p and
radius r holds no product above ``q.p + |q| r``.

1. Each query visits the cells with the largest ``q.p`` that together hold k
   rows; its k-th best product there is its threshold.
2. It then visits every cell whose bound isn't below the threshold, and only
   products that reach the threshold leave a task.

Pass one joins queries and corpus on (cell, slice of the cell, block of
queries): a cell that holds a third of all rows has as many slices as its rows
need, a cell that every query visits as many query blocks.  Pass two does so by
groups of cells that fill a tile, so a query moves once for each group with a
cell to visit, not for each cell.  The driver sees the pivots and one row per
cell.  Products are summed in the order of the dimensions, so the rows equal
those of ``exact_topk``, ties by key included.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from abode.operators.topk import _ARROW, Dense, _empty, _make_tile_fn, _matrix, dense_block
from abode.session import shared_dir

MAX_CELLS = 1024
# relative room for the rounding of bounds; far above 2^-53 times any dimension in use
ROOM = 1e-10
# vectors whose products with all pivots are held at once
STEP = 1024


class Cells:
    """Pivots, radii and sizes of the cells."""

    def __init__(self, pivots: np.ndarray):
        self.pivots = np.unique(pivots, axis=0)
        self.radius = np.full(len(self.pivots), -1.0)
        self.rows = np.zeros(len(self.pivots), np.int64)

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and distance of each vector."""
        self.check(v)
        half = (self.pivots**2).sum(axis=1) / 2
        cell = np.concatenate([np.argmax(v[a:a + STEP] @ self.pivots.T - half, axis=1) for a in range(0, len(v), STEP)] or [np.zeros(0, np.int64)])
        return cell, np.linalg.norm(v - self.pivots[cell], axis=1)

    def check(self, v: np.ndarray) -> None:
        if len(v) and v.shape[1] != self.pivots.shape[1]:
            raise ValueError(f"vector dim {v.shape[1]} != corpus dim {self.pivots.shape[1]}")

    def first(self, q: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Which cells each query visits first: the largest products with the
        pivot, until they hold k rows."""
        self.check(q)
        product = np.where(self.rows > 0, q @ self.pivots.T, -np.inf)
        order = np.argsort(-product, axis=1, kind="stable")
        held = np.cumsum(self.rows[order], axis=1) - self.rows[order]
        out = np.zeros(product.shape, bool)
        np.put_along_axis(out, order, held < k[:, None], axis=1)
        return out & (self.rows > 0)

    def reached(self, q: np.ndarray, threshold: np.ndarray, cells: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Which of the cells may hold a product at or above the threshold."""
        pivots, radius = self.pivots[cells], self.radius[cells]
        length = np.linalg.norm(q, axis=1)[:, None]
        bound = q @ pivots.T + length * radius
        bound += ROOM * length * (np.linalg.norm(pivots, axis=1) + radius)
        return (bound >= threshold[:, None]) & (self.rows[cells] > 0)

    def second(self, q: np.ndarray, k: np.ndarray, threshold: np.ndarray) -> np.ndarray:
        """Which cells but the first may hold a product at or above the threshold."""
        self.check(q)
        return self.reached(q, threshold) & ~self.first(q, k)

    def groups(self, side: int) -> np.ndarray:
        """A group for each cell: neighbours that hold about ``side`` rows together."""
        return np.unique((np.cumsum(self.rows) - self.rows) // max(side, 1), return_inverse=True)[1].astype(np.int64)


def build_cells(corpus: DataFrame, key: str, vector: str, cells: int | None = None) -> tuple[Cells, DataFrame]:
    """(cells, corpus rows with ``__cell``); the rows are written once to the
    shared folder.  ``cells`` defaults to the square root of the corpus' size,
    at most ``MAX_CELLS``."""
    n = cells or math.ceil(math.sqrt(corpus.count()))
    hashed = corpus.select(vector, F.xxhash64(key).alias("__h"), F.col(key).alias("__key")).orderBy("__h", "__key").limit(max(1, min(n, MAX_CELLS)))
    got = Cells(_matrix(hashed.select(vector).toArrow().column(0)))
    schema = T.StructType([corpus.schema[key], corpus.schema[vector], T.StructField("__cell", T.IntegerType()), T.StructField("__far", T.DoubleType())])

    def assign(batches):
        for b in batches:
            if b.num_rows:
                cell, far = got.nearest(_matrix(b.column(1)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(far)], names=schema.fieldNames())

    shared_dir(corpus.sparkSession)
    rows = corpus.select(key, vector).mapInArrow(assign, schema).checkpoint(eager=True)
    for r in rows.groupBy("__cell").agg(F.max("__far").alias("far"), F.count("*").alias("n")).collect():  # one row a cell
        got.radius[r["__cell"]], got.rows[r["__cell"]] = r["far"], r["n"]
    return got, rows


def _visits(queries: DataFrame, cells: Cells, key: str, threshold: bool, group: np.ndarray | None = None) -> DataFrame:
    """One row per query and cell to visit; ``queries`` has the columns key, __qv, __kq (, __t).
    With ``group``: one row per query and group with a cell that reaches its threshold."""
    keep = [key, "__qv", "__kq", *(["__t"] if group is not None else [])]
    schema = T.StructType([*queries.select(*keep).schema.fields, T.StructField("__cell" if group is None else "__group", T.IntegerType())])

    def run(batches):
        for whole in batches:
            for a in range(0, whole.num_rows, STEP):
                b = whole.slice(a, STEP)
                q, k = _matrix(b.column("__qv")), b.column("__kq").to_numpy().astype(np.int64)
                if group is not None:
                    cells.check(q)
                    go = cells.reached(q, b.column("__t").to_numpy())
                    go = np.add.reduceat(go[:, order], start, axis=1) > 0
                else:
                    go = cells.second(q, k, b.column("__t").to_numpy()) if threshold else cells.first(q, k)
                row, cell = np.nonzero(go)
                for lo in range(0, len(row), 1 << 14):
                    at = pa.array(row[lo:lo + (1 << 14)])
                    yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in keep), pa.array(cell[lo:lo + (1 << 14)].astype(np.int32))],
                                                     names=schema.fieldNames())

    if group is not None:
        order = np.argsort(group, kind="stable")
        start = np.searchsorted(group[order], np.arange(int(group.max()) + 1))
    return queries.mapInArrow(run, schema)


def _make_group_fn(cells: Cells, qkey: str, ckey: str, key_types: tuple):
    """Hits of the queries of one block in the cells of one group (a slice of each)."""
    schema = pa.schema([(qkey, key_types[0]), (ckey, key_types[1]), ("__score", pa.float64()), ("__k", pa.int32())])

    def fn(qt: pa.Table, ct: pa.Table) -> pa.Table:
        if qt.num_rows == 0 or ct.num_rows == 0:
            return schema.empty_table()
        # by key, so that columns are in the order of ties
        ckeys = ct.column(ckey).to_numpy(zero_copy_only=False)
        order = np.argsort(ckeys, kind="stable")
        ckeys, cv, cell = ckeys[order], _matrix(ct.column("__cv"))[order], ct.column("__cell").to_numpy()[order]
        qv, k, floor = _matrix(qt.column("__qv")), qt.column("__kq").to_numpy().astype(np.int64), qt.column("__t").to_numpy()
        cells.check(qv)
        here, at = np.unique(cell, return_inverse=True)
        size, most = np.bincount(at), int(k.max())
        go = cells.reached(qv, floor, here)
        found = []
        if (go * size).sum() * 2 > len(qv) * len(cv):  # most pairs: all in one product
            found.append(Dense(cv, most).topk(qv, k, floor))
        else:
            for i in range(len(here)):
                q, c = np.flatnonzero(go[:, i]), np.flatnonzero(at == i)
                if len(q):
                    rows, cols, score = Dense(cv[c], most).topk(qv[q], k[q], floor[q])
                    found.append((q[rows], c[cols], score))
        rows, cols, score = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        return pa.table({qkey: qt.column(qkey).take(pa.array(rows)), ckey: pa.array(ckeys[cols], type=key_types[1]),
                         "__score": pa.array(score, type=pa.float64()), "__k": pa.array(k[rows].astype(np.int32))}, schema=schema)

    return fn


def cell_topk(queries: DataFrame, corpus: DataFrame, *, qkey: str, qcol: str, kcol: str, ckey: str, ccol: str, score_col: str = "score",
              rank_col: str = "rank", cells: int | None = None, block: int | None = None, with_visits: bool = False):
    """The rows of ``exact_topk(kind='dense')``: (qkey, ckey, score, rank).

    Keys are unique, BIGINT, INT or STRING; a missing vector or element, or
    vectors of different dimension, is an error; an empty side gives no rows;
    k < 1 gives a query none.  With ``with_visits`` also a table (qkey, pairs,
    visited): the corpus' size and how many of its rows the query met."""
    spark = queries.sparkSession
    q = queries.select(qkey, F.col(qcol).alias("__qv"), F.col(kcol).cast("int").alias("__kq")).where("__kq >= 1")
    size = q.agg(F.count("*").alias("n"), F.max("__kq").alias("k")).first()
    kinds = [_ARROW.get(d.schema[c].dataType) for d, c in ((queries, qkey), (corpus, ckey))]
    if None in kinds:
        raise TypeError("top-k keys must be BIGINT, INT or STRING")
    empty = _empty(spark, queries, corpus, qkey, ckey, score_col, rank_col)
    if not size["n"] or corpus.isEmpty():
        return (empty, q.select(qkey, F.lit(0).alias("pairs"), F.lit(0).alias("visited"))) if with_visits else empty
    got, rows = build_cells(corpus.select(F.col(ckey).alias("__ck"), F.col(ccol).alias("__cv")), "__ck", "__cv", cells)
    side = block or dense_block(got.pivots.shape[1])
    n_blocks = max(1, -(-size["n"] // side))
    rows = rows.select(F.col("__ck").alias(ckey), "__cv", "__cell")
    fields = [T.StructField(qkey, queries.schema[qkey].dataType), T.StructField(ckey, corpus.schema[ckey].dataType),
              T.StructField("__score", T.DoubleType()), T.StructField("__k", T.IntegerType()), T.StructField("__rank", T.IntegerType())]

    def of(numbers, place: str) -> Column:
        return F.element_at(F.array(*[F.lit(int(n)) for n in numbers]), F.col(place) + 1)

    def tiles(visits: DataFrame, corpus: DataFrame, place: str, slices, blocks, fn, schema) -> DataFrame:
        """Queries and corpus rows of one place meet by slice of the place and block of queries."""
        by = [place, "__slice", "__block"]
        there = visits.select("*", F.explode(F.sequence(F.lit(0), of(slices, place) - 1)).alias("__slice"),
                              F.pmod(F.xxhash64(qkey), of(blocks, place)).cast("int").alias("__block"))
        here = corpus.select("*", F.pmod(F.xxhash64(ckey), of(slices, place)).cast("int").alias("__slice"),
                             F.explode(F.sequence(F.lit(0), of(blocks, place) - 1)).alias("__block"))
        return there.groupBy(*by).cogroup(here.groupBy(*by)).applyInArrow(fn, schema).select(qkey, ckey, "__score", "__k")

    def best(hits: DataFrame) -> DataFrame:
        w = Window.partitionBy(qkey).orderBy(F.desc("__score"), F.asc(ckey))
        # the literal bound lets Spark cut candidates before the shuffle
        return hits.withColumn("__rank", F.row_number().over(w)).where((F.col("__rank") <= size["k"]) & (F.col("__rank") <= F.col("__k")))

    one = _visits(q, got, qkey, False)
    visits = np.zeros(len(got.rows), np.int64)
    for r in one.groupBy("__cell").count().collect():  # one row a cell
        visits[r["__cell"]] = r["count"]
    tile = _make_tile_fn("dense", qkey, ckey, "__qv", "__cv", "__kq", pa.float64(), tuple(kinds))
    found = best(tiles(one, rows, "__cell", np.maximum(-(-got.rows // side), 1), np.maximum(-(-visits // side), 1), tile, T.StructType(fields)))
    # with fewer rows than k a query has been to every cell, so any threshold will do
    threshold = found.groupBy(F.col(qkey).alias("__of")).agg(F.min("__score").alias("__t")).checkpoint(eager=True)
    reach = q.join(threshold, F.col(qkey).eqNullSafe(F.col("__of"))).drop("__of")
    group = got.groups(side)
    held = np.bincount(group, got.rows).astype(np.int64)
    hits = tiles(_visits(reach, got, qkey, True, group), rows.withColumn("__group", of(group, "__cell")), "__group",
                 np.maximum(-(-held // (2 * side)), 1), np.full(len(held), n_blocks), _make_group_fn(got, qkey, ckey, tuple(kinds)), T.StructType(fields[:4]))
    out = best(hits).select(qkey, ckey, F.col("__score").alias(score_col), F.col("__rank").cast("int").alias(rank_col))
    if not with_visits:
        return out
    met = one.unionByName(_visits(reach, got, qkey, True)).withColumn("__n", of(got.rows, "__cell"))
    return out, met.groupBy(qkey).agg(F.lit(int(got.rows.sum())).alias("pairs"), F.sum("__n").alias("visited"))
