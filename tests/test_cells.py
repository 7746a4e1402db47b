"""Pruned exact ranking against ``exact_topk`` and plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from abode.operators.cells import Cells, cell_topk
from abode.operators.topk import exact_topk

ARGS = {"qkey": "q", "qcol": "v", "kcol": "k", "ckey": "c", "ccol": "v"}


def table(spark, key, vectors, k=None):
    rows = [(i, [float(x) for x in v], *([k] if k is not None else [])) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, f"{key} long, v array<double>" + (", k int" if k is not None else ""))


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def clustered():
    """Clusters of different spread, and one vector that a third of the rows share."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 8)) * 4
    corpus = np.concatenate([centres[rng.integers(0, 20, 800)] + rng.normal(size=(800, 8)) * 0.1, np.repeat(centres[:1], 400, axis=0)])
    queries = centres[rng.integers(0, 20, 60)] + rng.normal(size=(60, 8)) * 0.2
    return queries / np.linalg.norm(queries, axis=1)[:, None], corpus


@pytest.mark.parametrize("block", [None, 100])
def test_equals_exact_topk(spark, clustered, block):
    q, c = table(spark, "q", clustered[0], 10), table(spark, "c", clustered[1])
    got, visits = cell_topk(q, c, **ARGS, block=block, with_visits=True)
    assert rows(got) == rows(exact_topk(q, c, **ARGS))
    share = visits.agg((F.sum("visited") / F.sum("pairs")).alias("s")).first()["s"]
    assert share < 0.6
    assert visits.count() == 60


def test_random_directions(spark):
    """Nothing can be ruled out; the result is the same."""
    rng = np.random.default_rng(6)
    q, c = table(spark, "q", rng.normal(size=(20, 16)), 7), table(spark, "c", rng.normal(size=(300, 16)))
    assert rows(cell_topk(q, c, **ARGS)) == rows(exact_topk(q, c, **ARGS))


def test_k_over_corpus_and_below_one(spark):
    c = table(spark, "c", np.eye(3))
    q = spark.createDataFrame([(1, [1.0, 2.0, 3.0], 9), (2, [1.0, 0.0, 0.0], 0), (3, [1.0, 1.0, 0.0], 2)], "q long, v array<double>, k int")
    assert rows(cell_topk(q, c, **ARGS)) == [(1, 0, 1.0, 3), (1, 1, 2.0, 2), (1, 2, 3.0, 1), (3, 0, 1.0, 1), (3, 1, 1.0, 2)]


def test_empty_sides_and_bad_vectors(spark):
    q, c = table(spark, "q", np.eye(3), 2), table(spark, "c", np.eye(3))
    assert rows(cell_topk(q.limit(0), c, **ARGS)) == rows(cell_topk(q, c.limit(0), **ARGS)) == []
    with pytest.raises(Exception, match="dim"):
        cell_topk(table(spark, "q", np.eye(4), 2), c, **ARGS).collect()


def test_second_pass_misses_no_cell():
    """Whatever a cell that isn't visited holds, it is below the threshold."""
    rng = np.random.default_rng(7)
    corpus, q, k = rng.normal(size=(500, 4)), rng.normal(size=(50, 4)), np.full(50, 5)
    cells = Cells(corpus[:30])
    at, far = cells.nearest(corpus)
    cells.rows = np.bincount(at, minlength=len(cells.pivots))
    np.maximum.at(cells.radius, at, far)
    product = q @ corpus.T
    first = cells.first(q, k)
    assert ((first * cells.rows).sum(axis=1) >= 5).all()
    threshold = np.array([np.sort(p[f[at]])[-5] for p, f in zip(product, first, strict=True)])
    seen = first | cells.second(q, k, threshold)
    assert not (seen[:, at] == False)[product >= threshold[:, None]].any()  # noqa: E712
    assert not seen.all()


def test_only_what_reaches_the_threshold_leaves_a_group(clustered):
    """A task of pass two returns no more than the hits at or above the queries' thresholds, and sees a group once."""
    import pyarrow as pa

    from abode.operators.cells import _make_group_fn
    queries, corpus = clustered
    cells = Cells(corpus[::40])
    cell, far = cells.nearest(corpus)
    cells.rows = np.bincount(cell, minlength=len(cells.pivots))
    np.maximum.at(cells.radius, cell, far)
    assert len(np.unique(cells.groups(500))) <= 4
    exact = queries @ corpus.T
    floor = np.sort(exact, axis=1)[:, -10]
    fn = _make_group_fn(cells, "q", "c", (pa.int64(), pa.int64()))
    qt = pa.table({"q": range(60), "__qv": list(queries), "__kq": [10] * 60, "__t": floor - 1e-9})
    got = fn(qt, pa.table({"c": range(1200), "__cv": list(corpus), "__cell": cell.astype(np.int32)}))
    want = {(int(r), int(c)) for r in range(60) for c in np.lexsort((np.arange(1200), -np.round(exact[r], 9)))[:10]}
    assert set(zip(got["q"].to_pylist(), got["c"].to_pylist())) == want
