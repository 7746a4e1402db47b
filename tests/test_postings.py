"""Inverted lists: exact against a plain count of shared terms, split lists,
and sub-blocks that were skipped hold no hit."""
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from abode.operators import search
from abode.operators.postings import Postings
from abode.operators.topk import exact_topk
from abode.plans import registry as RG
from conftest import SF001


def texts(seed, n, kinds):
    """Listings of a few groups of terms, a stop word in all of them, some empty, repeated or null."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        g = rng.randrange(kinds)
        out.append(["the"] * rng.randint(1, 3) + [f"g{g}"] * rng.randint(1, 2) + [f"w{g}-{rng.randrange(9)}" for _ in range(rng.randint(1, 6))] + [f"own{i % 450}"])
    return out + [[], None, out[0], out[0]]


def cosines(q, docs):
    qc, qn = Counter(q or []), math.sqrt(sum(v * v for v in Counter(q or []).values()))
    got = []
    for i, d in enumerate(docs):
        dc = Counter(d or [])
        dot = sum(n * dc[w] for w, n in qc.items())
        if dot:
            got.append((-(dot / (qn * math.sqrt(sum(v * v for v in dc.values())))), i))
    return sorted(got)


@pytest.mark.parametrize("seed, n, kinds, sub", [(1, 900, 12, 32), (2, 300, 3, 16), (3, 40, 40, 256), (4, 1, 1, 8)])
def test_hits_and_skips(seed, n, kinds, sub):
    docs = texts(seed, n, kinds)
    rng = random.Random(seed)
    queries = [["the", f"g{rng.randrange(kinds)}", f"w{rng.randrange(kinds)}-1"] for _ in range(25)] + [["the"], ["none"], [], None, docs[0], ["g0", "g0"]]
    k = np.array([rng.randint(1, 12) for _ in queries], np.int64)
    lists = Postings(pa.array(docs, pa.list_(pa.string())), sub)
    rows, cols, scores, visited = lists.topk(pa.array(queries, pa.list_(pa.string())), k)
    where = np.empty(len(docs), np.int64)
    where[lists.row_at] = np.arange(len(docs)) // sub
    for i, q in enumerate(queries):
        want = cosines(q, docs)
        got = sorted(zip((-scores[rows == i]).tolist(), cols[rows == i].tolist(), strict=True))[:k[i]]
        assert got == want[:k[i]]
        kth = -want[k[i] - 1][0] if len(want) >= k[i] else 0.0
        for s, d in want:  # what was skipped is worse than the k-th best
            assert visited[i, where[d]] or -s < kth
    if kinds == 12:
        assert visited[:25].mean() < 0.9


def test_stop_word_list_is_split():
    docs = texts(7, 1000, 5)
    lists = Postings(pa.array(docs, pa.list_(pa.string())), 64)
    at = lists.terms.to_pylist().index("the")
    pieces = slice(lists.first_piece[at], lists.first_piece[at + 1])
    size = lists.piece_stop[pieces] - lists.piece_start[pieces]
    assert len(size) == lists.subs == 16 and size.max() <= 64 and size.sum() == 1002


def test_same_rows_in_any_blocks(spark):
    lst = RG.listings(spark, SF001)
    q = spark.createDataFrame([("a", 30), ("b", 7), ("c", 3)], "qtext string, kq int").select(
        "qtext", "kq", search.text_tokens(F.expr("decode(qtext, 'a', 'studio with gym in Mumbai', 'b', '2 bhk house pool parking', 'zzz')")).alias("terms"))
    opts = {"qkey": "qtext", "qcol": "terms", "kcol": "kq", "ckey": "id", "ccol": "terms", "kind": "lexical"}
    rows = [sorted(map(tuple, exact_topk(q, search.profile_corpus(lst), block_c=b, **opts).collect())) for b in (16384, 37, 5)]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) == 37


def test_small_query_set_goes_to_the_corpus(spark):
    """A dense query set of one block: the corpus isn't exchanged; same rows as tiles."""
    e = RG.embeddings(spark, SF001)
    q = e.where("vec_id % 3 = 0").select("vec_id", "embedding", (F.col("vec_id") % 5 + 1).cast("int").alias("k"))
    c = e.select(F.col("vec_id").alias("id"), "embedding").repartition(5, "id")
    opts = {"qkey": "vec_id", "qcol": "embedding", "kcol": "k", "ckey": "id", "ccol": "embedding"}
    small = exact_topk(q, e.select(F.col("vec_id").alias("id"), "embedding"), block_c=64, **opts)
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" not in plan and "MapInArrow" in plan
    assert plan.count("Exchange") == 1  # candidates, not vectors
    tiles = exact_topk(q, c, block_q=50, block_c=64, **opts)
    assert "CoGroup" in tiles._jdf.queryExecution().executedPlan().toString()
    rows = [sorted(map(tuple, x.collect())) for x in (small, exact_topk(q, c, block_c=64, **opts), exact_topk(q, c, **opts), tiles)]
    assert rows[0] == rows[1] == rows[2] == rows[3] and len(rows[0]) == sum(v % 5 + 1 for v in range(0, 500, 3))


def test_texts_that_rank_alike_are_ranked_once(spark):
    """Texts with the same known terms and length share a signature; rankings equal those of the whole texts, bit by bit."""
    from pyspark.sql import functions as F

    from abode.operators import search
    from abode.operators.topk import exact_topk
    from abode.sources.synth import synth_listings
    listings = synth_listings(spark.range(300).select(F.col("id").alias("p_partkey")))
    words = ["in with zzq", "with in qqz", "zzq zzq in", "pool gym xx xx xx yy", "yy yy yy pool gym xx", "zzz", "", "2 bhk in mumbai"]
    texts = spark.createDataFrame([(w, 5 + i) for i, w in enumerate(words)], "enhanced string, max_results int")
    got, bound = search.rank_texts(texts, listings)
    qv = search.distinct_texts(texts, "enhanced").select("qkey", "kq", search.text_tokens(F.col("qtext")).alias("terms"))
    want = exact_topk(qv, search.profile_corpus(listings), qkey="qkey", qcol="terms", kcol="kq", ckey="id", ccol="terms", kind="lexical",
                      score_col="similarity_score", rank_col="search_rank")
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, want.select(*got.columns).collect())) and 0 < len(rows) <= bound
    signed = search.signatures(qv, search.profile_corpus(listings)).collect()
    assert len(signed) == 6 and len({r["skey"] for r in signed}) == 4
