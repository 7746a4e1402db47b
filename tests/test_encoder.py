"""Encoded ranking (text -> encoder -> exact inner-product top-k) against a
numpy brute force over the same vectors, for the default JVM encoder and a
model plugged in through ``batch_encoder`` (one call per Arrow batch)."""
import sys
from hashlib import md5

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from abode.functions.derive import profile_text
from abode.functions.parse import parse_request
from abode.operators import search
from abode.operators.encode import batch_encoder, hashed_tfidf_encoder
from abode.plans import registry as RG
from abode.sources.requests import validate_k
from conftest import SF001


# the model factory runs in Python workers, which cannot import this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _char_model():
    """Toy model: L2-normalised counts of a-z and 0-9 (36 dims)."""
    alphabet = "abcdefghijklmnopqrstuvwxyz0123456789"

    def predict(texts):
        out = np.zeros((len(texts), len(alphabet)), dtype=np.float32)
        for i, t in enumerate(texts):
            for ch in str(t).lower():
                j = alphabet.find(ch)
                if j >= 0:
                    out[i, j] += 1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n == 0, 1, n)
    return predict


@pytest.mark.parametrize("which", ["tfidf", "batch"])
def test_encoded_ranking_matches_brute_force(spark, which):
    enc_fit = hashed_tfidf_encoder(256) if which == "tfidf" else batch_encoder(_char_model, 36, batch_size=64)
    lst = RG.listings(spark, SF001)
    p = parse_request(validate_k(RG.requests(spark, SF001)))
    ranked, _ = search.rank_encoded(p, lst, enc_fit)
    got = {}
    for r in ranked.collect():
        got.setdefault(r.qkey, []).append((r.search_rank, r.id, round(r.similarity_score, 9)))
    # brute force over the same encoder's vectors
    prof = lst.select("id", profile_text().alias("text"))
    encode = enc_fit(prof)
    C = encode(prof, "text").orderBy("id").collect()
    ids = np.array([r.id for r in C])
    M = np.array([r.embedding for r in C], dtype=np.float64)
    keys = p.groupBy(F.coalesce("enhanced", F.lit("")).alias("qtext")).agg(F.max("max_results").alias("k"))
    Q = encode(keys, "qtext").collect()
    assert len(Q) == len(got)
    for q in Q:
        s = M @ np.array(q.embedding, dtype=np.float64)
        order = np.lexsort((ids, -s))[: q.k]
        exp = [(i + 1, int(ids[j]), round(float(s[j]), 9)) for i, j in enumerate(order)]
        assert sorted(got[md5(q.qtext.encode()).hexdigest()]) == exp, q.qtext


def test_chat_encoded_registered(spark):
    import __spark_entry__ as E
    df = E.queries()["chat_encoded"](spark, SF001)
    assert df.count() == 1000 + 23
    assert df.filter("total_found > 24").count() == 0


def test_coverage_counts_what_has_no_vector(spark):
    from abode.operators.encode import coverage

    lst = spark.createDataFrame([(1,), (2,), (9,)], "id long")
    req = spark.createDataFrame([(0, 1), (1, 1), (2, 7), (3, None)], "qid long, vec_id long")
    emb = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [2.0, 0.0]), (4, [1.0]), (5, None)], "vec_id long, embedding array<float>")
    assert coverage(req, lst, emb).first().asDict() == {"listings": 3, "listings_without_vector": 1, "requests": 4, "requests_without_vector": 2, "vectors": 5,
                                                        "dimensions": 2, "norm_breaches": 2}
    none = coverage(req.where("false"), lst.where("false"), emb.where("false")).first()
    assert set(none) == {0}
