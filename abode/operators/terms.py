"""Sparse term encoder: a text as (term id, weight) of its own terms, no buckets.

Fit: document counts per term (two-phase aggregate), terms numbered without
gaps in their order: range partitions, numbered inside and moved up by the
partitions before them.  The vocabulary (term, term_id, df, weight) is written
to the shared folder and read from there by every later step.

Weight of a term in a text: its count times ``round(1000 ln((N + 1) / (df +
1)))``, N texts of which df hold the term.  Whole numbers add up exactly in any
order, so scores and ties are the same for every layout.  Terms that every text
holds weigh 0 and, like terms the corpus lacks, aren't in a vector.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abode.operators.tokens import batch_tokens, counted_places, lists
from abode.operators.topk import BROADCAST_BYTES_MAX, salted_join
from abode.session import fresh_path

SCALE = 1000


def vocabulary(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, term_id, df, weight) of a text column; term ids are 0, 1, 2, ... in the order of the terms."""
    from abode.operators.search import text_tokens

    spark = texts.sparkSession
    n = texts.count()
    if not n:
        raise ValueError("no corpus texts to fit the encoder on (empty corpus)")
    held = texts.select(F.explode(F.array_distinct(text_tokens(F.col(text_col)))).alias("term"))
    counts = _stored(held.groupBy("term").agg(F.count(F.lit(1)).alias("df")).repartitionByRange("term")
                     .withColumn("part", F.spark_partition_id()), "term-counts")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    parts = counts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("term"))
    weight = F.round(F.lit(SCALE) * F.log(F.lit(n + 1.0) / (F.col("df") + 1.0))).cast("long")
    numbered = counts.withColumn("at", inside).join(parts, "part")
    return _stored(numbered.select("term", (F.col("base") + F.col("at") - 1).alias("term_id"), "df", weight.alias("weight")), "terms")


def _stored(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def term_weights(df: DataFrame, words: DataFrame, text_col: str = "text") -> DataFrame:
    """The other columns of ``df`` plus ``embedding``: struct<terms, weights>,
    by term id.  The first column identifies a row; the texts of rows that
    share it are one text.

    The vocabulary is broadcast if its measured size allows; then no text
    moves (only keys do, to see that none repeats), each is encoded where it
    is.  Where keys repeat, texts move by their key and their counts add up.
    A vocabulary that isn't broadcast meets the counts in a join on the term,
    where a term held by very many texts is split (``salted_join``)."""
    from abode.operators.search import text_tokens

    keep = [c for c in df.columns if c != text_col]
    small = (words.agg(F.sum(F.octet_length("term") + F.lit(48)).alias("b")).first()["b"] or 0) <= BROADCAST_BYTES_MAX
    known = words.where("weight > 0").select("term", "term_id", "weight")
    if small and (df.groupBy(keep[0]).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) <= 1:
        return df.select(*keep, _encoded(known, F.lower(F.coalesce(F.col(text_col), F.lit("")))).alias("embedding"))
    tokens = df.repartition(keep[0]).select(*keep, F.explode_outer(text_tokens(F.col(text_col))).alias("term"))
    counts = tokens.groupBy(*keep, "term").agg(F.count(F.lit(1)).alias("tf"))
    if small:
        met = counts.join(F.broadcast(known), "term", "left")
    else:
        met = salted_join(counts, known, "term", keep[0], "left")
    pair = F.when(F.col("term_id").isNotNull(), F.struct("term_id", (F.col("tf") * F.col("weight")).alias("weight")))
    rows = met.groupBy(*keep).agg(F.array_sort(F.collect_list(pair)).alias("__t"))
    return rows.select(*keep, F.struct(F.col("__t.term_id").alias("terms"), F.col("__t.weight").alias("weights")).alias("embedding"))


def _encoded(known: DataFrame, low: Column) -> Column:
    """struct<terms, weights> of lower-cased texts by the (broadcast) vocabulary."""
    table = known.toArrow().sort_by("term_id")
    terms = table.column("term").combine_chunks().cast(pa.large_string())
    ids, weights = (table.column(c).to_numpy().astype(np.int64) for c in ("term_id", "weight"))
    sent = known.sparkSession.sparkContext.broadcast((terms, ids, weights))

    @F.arrow_udf("terms array<bigint>, weights array<bigint>")
    def encode(texts: pa.Array) -> pa.Array:
        terms, ids, weights = sent.value
        rows, tokens = batch_tokens(texts)
        enc = tokens.dictionary_encode()
        at = pc.fill_null(pc.index_in(enc.dictionary, value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        at = at[enc.indices.to_numpy(zero_copy_only=False)]
        row, at, count = counted_places(rows[at >= 0], at[at >= 0], len(terms))
        return pa.StructArray.from_arrays([lists(row, len(texts), pa.array(ids[at])), lists(row, len(texts), pa.array(count * weights[at]))],
                                          names=["terms", "weights"])

    return encode(low)


def term_encoder():
    """Encoder (``fit(corpus_texts) -> encode``) over real terms: no two terms
    share a place, and a vector is as long as its text has terms.  Ranked by
    cosine from inverted lists; listings without a common term aren't hits."""
    def fit(corpus_texts: DataFrame):
        words = vocabulary(corpus_texts)

        def encode(df: DataFrame, text_col: str = "text") -> DataFrame:
            return term_weights(df, words, text_col)
        return encode
    return fit
