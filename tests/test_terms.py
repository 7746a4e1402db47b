"""Sparse term encoder against plain Python: numbers, weights, ranking, and
the join of a vocabulary that isn't broadcast."""
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from abode.operators import terms, topk
from abode.operators.terms import term_encoder, term_weights, vocabulary

RNG = random.Random(3)
TEXTS = [" ".join(["The"] + [f"w{RNG.randrange(60)}" for _ in range(RNG.randrange(12))]) for _ in range(150)]
TEXTS += [None, "", "  ,;", TEXTS[0], TEXTS[0], "the " * 50, "única É 9"]


def tokens(t):
    return [w for w in re.split("[^a-z0-9]+", (t or "").lower()) if w]


def expected(texts):
    df = Counter(w for t in texts for w in set(tokens(t)))
    idf = {w: math.floor(1000 * math.log((len(texts) + 1) / (n + 1)) + 0.5) for w, n in df.items()}
    return {w: i for i, w in enumerate(sorted(df))}, df, idf


def vector(t, ids, idf):
    return {ids[w]: n * idf[w] for w, n in Counter(tokens(t)).items() if idf.get(w)}


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").repartition(7)


def test_vocabulary(spark, corpus):
    ids, df, idf = expected(TEXTS)
    got = {r.term: r for r in vocabulary(corpus).collect()}
    assert {w: r.term_id for w, r in got.items()} == ids
    assert all((r.df, r.weight) == (df[w], idf[w]) for w, r in got.items())


@pytest.mark.parametrize("budget, salt", [(64 << 20, 10**6), (0, 10**6), (0, 20)])
def test_weights(spark, corpus, monkeypatch, budget, salt):
    """The vocabulary broadcast, joined, and joined with split frequent terms gives the same rows."""
    monkeypatch.setattr(terms, "BROADCAST_BYTES_MAX", budget)
    monkeypatch.setattr(topk, "SALT_ROWS", salt)
    ids, _, idf = expected(TEXTS)
    rows = term_weights(corpus.withColumn("tf", F.lit(7).cast("string")).select("id", "tf", "text").withColumnRenamed("tf", "kq"),
                        vocabulary(corpus)).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert r.embedding.terms == sorted(r.embedding.terms)
        assert dict(zip(r.embedding.terms, r.embedding.weights, strict=True)) == vector(TEXTS[r.id], ids, idf)


def test_ranking(spark, corpus):
    """Same hits and ranks as cosines over all rows, in any block layout; no hit without a common term."""
    ids, _, idf = expected(TEXTS)
    docs = [vector(t, ids, idf) for t in TEXTS]
    asked = ["w1 w2 unknown", "the", "", "w5 w5 w7", TEXTS[3]]
    encode = term_encoder()(corpus)
    queries = encode(spark.createDataFrame([(i, 6, t) for i, t in enumerate(asked)], "q long, k int, text string"))
    want = []
    for i, t in enumerate(asked):
        q = vector(t, ids, idf)
        dots = [(sum(x * d.get(w, 0) for w, x in q.items()), j) for j, d in enumerate(docs)]
        norm = math.sqrt(sum(x * x for x in q.values()))
        hits = sorted((-(s / (norm * math.sqrt(sum(x * x for x in docs[j].values())))), j) for s, j in dots if s)[:6]
        want += [(i, j, r + 1, -s) for r, (s, j) in enumerate(hits)]
    for opts in ({}, {"block_q": 2, "block_c": 30}):
        got = topk.exact_topk(queries, encode(corpus), qkey="q", qcol="embedding", kcol="k", ckey="id", ccol="embedding", kind="lexical", **opts)
        assert sorted((r.q, r.id, r["rank"], r.score) for r in got.collect()) == sorted(want)


def test_empty_corpus(spark, corpus):
    with pytest.raises(ValueError, match="empty corpus"):
        vocabulary(corpus.where("id < 0"))
    got = term_weights(corpus, vocabulary(spark.createDataFrame([("",)], "text string"))).collect()
    assert len(got) == len(TEXTS) and all(not r.embedding.terms for r in got)
