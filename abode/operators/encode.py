"""Batch text encoder for listing profiles.

Tokenise -> hashed term frequencies -> IDF -> L2 normalise -> ARRAY<FLOAT>,
a batch of texts at once in numpy, with the buckets and weights of
``pyspark.ml.feature`` (``HashingTF``, ``IDF``, ``Normalizer``).
IDF is one distributed aggregate over the corpus; its result (one weight per
hash bucket) is bounded by ``num_features``, not by the data.  A model-based
encoder plugs in through ``batch_encoder`` (``predict_batch_udf``: the model
loads once per Python worker and is called once per Arrow batch); none ships
offline.

An *encoder* is a function ``fit(corpus_texts) -> encode`` where
``corpus_texts`` has a ``text`` column and ``encode(df, text_col)`` returns
``df`` plus an ``embedding ARRAY<FLOAT>`` column (L2-normalised).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from abode.functions.derive import profile_text
from abode.operators.tokens import buckets


def _tokens_in(text_col: str) -> Column:
    """What the tasks split: the text in lower case (null: empty)."""
    return F.lower(F.coalesce(F.col(text_col), F.lit("")))


def fit_weights(texts: DataFrame, num_features: int, text_col: str = "text") -> np.ndarray:
    """IDF of each bucket, ``ln((N + 1) / (df + 1))`` over N texts: every task
    sums its texts, ``num_features`` numbers of them meet."""
    def held(batches):
        df, n = np.zeros(num_features, np.int64), 0
        for b in batches:
            df += np.bincount(buckets(b.column(0), num_features)[1], minlength=num_features)
            n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.arange(num_features), -1]), pa.array(np.r_[df, n])], names=["bucket", "n"])

    sums = texts.select(_tokens_in(text_col)).mapInArrow(held, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    total = F.sum(F.when(F.col("bucket") < 0, F.col("n")))
    got = sums.agg(total.alias("total"), F.collect_list(F.when(F.col("bucket") >= 0, F.struct("bucket", "n"))).alias("df")).first()
    if not got["total"]:
        raise ValueError("no corpus texts to fit the encoder on (empty corpus)")
    df = np.zeros(num_features)
    df[[r["bucket"] for r in got["df"]]] = [r["n"] for r in got["df"]]
    return np.log((got["total"] + 1.0) / (df + 1.0))


def encoded(text_col: str, weights: np.ndarray) -> Column:
    """ARRAY<FLOAT> of a text: counts per bucket times weights, L2-normalised (no weight: zeros)."""
    size = len(weights)

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def vectors(texts: pa.Array) -> pa.Array:
        row, bucket, count = buckets(texts, size)
        value = count * weights[bucket]
        length = np.sqrt(np.bincount(row, value * value, minlength=len(texts)))[row]
        out = np.zeros((len(texts), size), np.float32)
        out[row, bucket] = np.divide(value, length, out=np.zeros(len(value)), where=length > 0)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * size), pa.array(out.ravel()))

    return vectors(_tokens_in(text_col))


def hashed_tfidf_encoder(num_features: int = 1024):
    """Encoder of hashed term frequencies, fitted on the corpus texts."""
    def fit(corpus_texts: DataFrame):
        weights = fit_weights(corpus_texts, num_features)

        def encode(df: DataFrame, text_col: str = "text") -> DataFrame:
            return df.select(*df.columns, encoded(text_col, weights).alias("embedding"))
        return encode
    return fit


def batch_encoder(make_predict_fn, dim: int, batch_size: int = 256):
    """Model-based encoder: ``make_predict_fn()`` returns ``predict(texts:
    np.ndarray[str]) -> np.ndarray (n, dim)``; it runs once per Arrow batch
    in the Python workers (``predict_batch_udf``), never per row."""
    from pyspark.ml.functions import predict_batch_udf
    udf = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size,
                            input_tensor_shapes=None)

    def fit(_corpus_texts: DataFrame):
        def encode(df: DataFrame, text_col: str = "text") -> DataFrame:
            e = udf(F.coalesce(F.col(text_col), F.lit("")))
            raw = df.withColumn("__raw", F.when(F.size(e) == dim, e)
                                .otherwise(F.raise_error(F.lit(f"encoder must return {dim} dims"))))
            # the ranking is a cosine: vectors get unit norm here, zero vectors stay
            return raw.withColumn("__norm", norm("__raw")).withColumn("embedding", F.transform("__raw", lambda x: F.when(
                F.col("__norm") > 0, x / F.col("__norm")).otherwise(x).cast("float"))).drop("__raw", "__norm")
        return encode
    return fit


def encode_profiles(listings: DataFrame, num_features: int = 1024):
    """Fit the encoder on the profile texts; returns (encode, (id, embedding))."""
    texts = listings.select("id", profile_text().alias("text"))
    encode = hashed_tfidf_encoder(num_features)(texts)
    return encode, encode(texts).select("id", "embedding")


def measured(name: str) -> Column:
    """struct<dim, norm> of ARRAY<FLOAT> vectors, a batch at once: ``size`` and
    ``norm`` (null: nulls).  Right after an encoder the vectors stay in the task."""
    @F.arrow_udf("dim int, norm double")
    def sizes(vectors: pa.Array) -> pa.Array:
        dim = pc.list_value_length(vectors)
        size = pc.fill_null(dim, 0).to_numpy(zero_copy_only=False)
        x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        sums, some = np.zeros(len(size)), size > 0
        if some.any():
            sums[some] = np.add.reduceat(x * x, (np.cumsum(size) - size)[some])
        length = pa.array(np.sqrt(sums), mask=pc.is_null(vectors).to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([dim.cast(pa.int32()), length], names=["dim", "norm"])

    return sizes(F.col(name))


def norm(name: str) -> Column:
    """Euclidean norm of an array column."""
    return F.sqrt(F.aggregate(name, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def check_vectors(vectors: DataFrame, dim: int | None = None, tol: float = 1e-5) -> DataFrame:
    """Index check: every vector has the dimension (if given) and unit norm, or
    is zero (a text without known terms, which meets nothing); anything else,
    null included, fails at execution.  The vectors are cast to ARRAY<FLOAT>."""
    ok = (F.size("embedding") == F.lit(dim)) if dim is not None else F.size("embedding") > 0
    ok = ok & ((F.abs(norm("embedding") - 1) < tol) | (norm("embedding") == 0))
    return vectors.withColumn("embedding", F.when(ok, F.col("embedding").cast("array<float>"))
                              .otherwise(F.raise_error(F.lit("vector with wrong dimension or norm"))))


def coverage(requests: DataFrame, listings: DataFrame, embeddings: DataFrame, tol: float = 1e-5) -> DataFrame:
    """One row: listings, listings_without_vector, requests,
    requests_without_vector, vectors, dimensions (distinct), norm_breaches.
    A request counts by its key, so one hot key is one row of the join."""
    ids = embeddings.select(F.col("vec_id").alias("id"), F.lit(1).alias("has"))
    n = F.count(F.lit(1))
    l = listings.select("id").join(ids, "id", "left").agg(n.alias("listings"), F.sum(F.col("has").isNull().cast("long")).alias("listings_without_vector"))
    keys = requests.groupBy(F.col("vec_id").alias("id")).agg(n.alias("n"))
    r = keys.join(ids, "id", "left").agg(F.sum("n").alias("requests"), F.sum(F.when(F.col("has").isNull(), F.col("n")).otherwise(0)).alias("requests_without_vector"))
    v = embeddings.agg(n.alias("vectors"), F.count_distinct(F.size("embedding")).alias("dimensions"),
                       F.sum((~F.coalesce(F.abs(norm("embedding") - 1) < tol, F.lit(False))).cast("long")).alias("norm_breaches"))
    parts = l.unionByName(r, allowMissingColumns=True).unionByName(v, allowMissingColumns=True)  # one row each
    return parts.agg(*[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in parts.columns])
