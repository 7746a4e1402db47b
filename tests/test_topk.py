"""Exact top-k: golden hits, brute-force agreement, ties, multi-block merge,
lexical cosine against a direct computation."""
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from abode.functions.parse import parse_request
from abode.operators import search
from abode.operators.topk import exact_topk
from abode.plans import registry as RG
from abode.sources.requests import golden_requests
from conftest import SF001, SF01


def _brute(q, c, k):
    """{qkey: [(ckey, score)...]} by score desc, key asc."""
    out = {}
    for qk, qv in q.items():
        s = sorted(((ck, float(np.dot(np.asarray(qv, float), np.asarray(cv, float)))) for ck, cv in c.items()),
                   key=lambda t: (-t[1], t[0]))
        out[qk] = s[:k]
    return out


def test_golden_surviving_hits(spark):
    p = parse_request(golden_requests(spark))
    lst, emb = RG.listings(spark, SF01), RG.embeddings(spark, SF01)
    kept = search.post_filter(search.vector_hits(p, lst, emb, carry=search.CONSTRAINT_COLS), p, lst, "api")
    got = {-r.qid - 1: r["count"] for r in kept.groupBy("qid").count().collect()}
    assert got == {0: 3, 3: 1, 4: 1, 5: 1, 6: 1, 7: 10, 10: 1, 13: 1, 14: 2, 15: 5, 20: 10, 22: 10}
    q0 = kept.filter("qid = -1").orderBy("search_rank").select("listing_id", "search_rank", "similarity_score").collect()
    assert [(r.listing_id, r.search_rank) for r in q0] == [("SP100334", 3), ("SP100387", 4), ("SP100190", 9)]
    assert [round(r.similarity_score, 6) for r in q0] == [0.362722, 0.331139, 0.281795]


@pytest.mark.parametrize("block_c", [16384, 64])  # one corpus block, then many blocks + merge
def test_dense_matches_brute_force(spark, block_c):
    e = RG.embeddings(spark, SF001)
    q = e.filter("vec_id < 40").select("vec_id", "embedding", F.lit(7).alias("k"))
    c = e.select(F.col("vec_id").alias("id"), "embedding")
    res = exact_topk(q, c, qkey="vec_id", qcol="embedding", kcol="k", ckey="id", ccol="embedding",
                     block_q=16, block_c=block_c).collect()
    rows = {r.vec_id: r.embedding for r in e.collect()}
    want = _brute({k: v for k, v in rows.items() if k < 40}, rows, 7)
    got = {}
    for r in res:
        got.setdefault(r.vec_id, []).append((r["rank"], r.id, r.score))
    for qk, lst in want.items():
        g = sorted(got[qk])
        assert [t[1] for t in g] == [t[0] for t in lst]
        assert all(abs(a[2] - b[1]) < 1e-9 for a, b in zip(g, lst))
        assert [t[0] for t in g] == list(range(1, 8))


def test_ties_break_by_key_across_blocks(spark):
    # every corpus vector is duplicated under 5 keys: all ties, across blocks
    e = RG.embeddings(spark, SF001).filter("vec_id < 30")
    c = (e.select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("j"))
          .select((F.col("vec_id") * 10 + F.col("j")).alias("id"), "embedding"))
    q = e.filter("vec_id < 5").select("vec_id", "embedding", F.lit(3).alias("k"))
    res = exact_topk(q, c, qkey="vec_id", qcol="embedding", kcol="k", ckey="id", ccol="embedding",
                     block_c=16).collect()
    for r in res:
        assert r.id == r.vec_id * 10 + (r["rank"] - 1)  # self-match 1.0, smallest keys first


def test_k_larger_than_corpus_returns_fewer(spark):
    e = RG.embeddings(spark, SF001).filter("vec_id < 4")
    q = e.select("vec_id", "embedding", F.lit(50).alias("k"))
    c = e.select(F.col("vec_id").alias("id"), "embedding")
    res = exact_topk(q, c, qkey="vec_id", qcol="embedding", kcol="k", ckey="id", ccol="embedding").collect()
    assert Counter(r.vec_id for r in res) == {0: 4, 1: 4, 2: 4, 3: 4}


def test_ranks_and_bounds_in_pipeline(spark):
    p = parse_request(RG.requests(spark, SF001))
    h = search.vector_hits(p, RG.listings(spark, SF001), RG.embeddings(spark, SF001), carry=["max_results"])
    bad = h.filter((F.col("search_rank") > F.col("max_results")) | (F.col("search_rank") < 1)).count()
    assert bad == 0
    dup = h.groupBy("qid", "search_rank").count().filter("count > 1").count()
    assert dup == 0


def _tokens(t):
    import re
    return [x for x in re.split("[^a-z0-9]+", (t or "").lower()) if x]


def test_lexical_matches_direct_cosine(spark):
    lst = RG.listings(spark, SF001)
    docs = {r.id: Counter(_tokens(r.t)) for r in lst.select("id", search.profile_text().alias("t")).collect()}
    texts = ["2 bhk in mumbai with lift", "studio with gym low cost economical", "house pool", "zzz"]
    q = spark.createDataFrame([(t, 5) for t in texts], "qtext string, kq int") \
        .select("qtext", "kq", search.text_tokens(F.col("qtext")).alias("terms"))
    res = exact_topk(q, search.profile_corpus(lst), qkey="qtext", qcol="terms", kcol="kq", ckey="id",
                     ccol="terms", kind="lexical", block_c=64).collect()
    got = {}
    for r in res:
        got.setdefault(r.qtext, []).append((r["rank"], r.id, r.score))
    for t in texts:
        qc = Counter(_tokens(t))
        qn = math.sqrt(sum(v * v for v in qc.values()))
        sc = []
        for i, dc in docs.items():
            dot = sum(qc[w] * dc.get(w, 0) for w in qc)
            if dot > 0:
                sc.append((i, dot / (qn * math.sqrt(sum(v * v for v in dc.values())))))
        sc.sort(key=lambda x: (-x[1], x[0]))
        g = sorted(got.get(t, []))
        assert [x[1] for x in g] == [x[0] for x in sc[:5]]
        assert all(a[2] == b[1] for a, b in zip(g, sc[:5]))  # bit-identical formula


def test_topk_of_members_equals_the_joined_corpus(spark):
    """Rows that share vectors, equal vectors under other keys, vectors without rows, k over the corpus."""
    from abode.operators.topk import exact_topk_of_members
    rng = np.random.default_rng(3)
    base = rng.integers(-2, 3, size=(30, 4)).astype(float)  # many equal scores
    v = spark.createDataFrame([(i, [float(x) for x in base[i % 25]]) for i in range(30)], "v long, e array<double>")
    members = [(int(c), int(rng.integers(0, 40)) if c % 3 else 7) for c in rng.permutation(200)]
    m = spark.createDataFrame(members + [(500, None)], "c long, v long")
    for k in (1, 6, 300):
        q = v.where("v < 20").select(F.col("v").alias("q"), "e", F.lit(k).alias("k"))
        want = exact_topk(q, m.join(v, "v"), qkey="q", qcol="e", kcol="k", ckey="c", ccol="e", block_c=50)
        got = exact_topk_of_members(q, v, m, qkey="q", qcol="e", kcol="k", vkey="v", vcol="e", ckey="c")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    twice = exact_topk_of_members(q.unionByName(q.where("q < 3")), v, m, qkey="q", qcol="e", kcol="k", vkey="v", vcol="e", ckey="c")
    assert sorted(map(tuple, twice.collect())) == sorted([tuple(r) for r in want.collect()] + [tuple(r) for r in want.where("q < 3").collect()])


def test_dense_kernel_holds_few_scores(monkeypatch):
    """Equal to plain numpy in steps of the corpus, with ties, unequal lengths and k = 0; never a whole block of scores."""
    from abode.operators import topk
    monkeypatch.setattr(topk, "_DENSE_ROWS", 7)
    monkeypatch.setattr(topk, "_DENSE_COLS", 11)
    rng = np.random.default_rng(4)
    for scale in (np.ones((90, 1)), 10.0 ** rng.integers(-5, 5, (90, 1))):
        c = rng.integers(-2, 3, size=(90, 5)) * scale
        c[30:60] = c[0]
        q, k = rng.integers(-2, 3, size=(40, 5)).astype(float), rng.integers(0, 9, 40)
        got = topk.Dense(c, int(k.max())).topk(q, k)
        exact = np.zeros((40, 90))
        for j in range(5):
            exact += q[:, j:j + 1] * c[:, j]
        want = [(r, x, exact[r, x]) for r in range(40) for x in np.lexsort((np.arange(90), -exact[r]))[:k[r]]]
        assert [tuple(map(float, t)) for t in zip(*got)] == [tuple(map(float, t)) for t in want]
