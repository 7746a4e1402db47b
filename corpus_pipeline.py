"""The corpus pipeline: toxic documents go, one document of each near-duplicate
group stays, repeated passages are cut, contaminated documents go, and what is
left is mixed to the sources' target weights.

Each stage is ``f(spark, docs, sf_dir)`` over the whole table that the stage
before wrote; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from abode.llm.common import written
from abode.llm.decontaminate import clean_documents
from abode.llm.minhash import near_duplicates
from abode.llm.mixing import mix_sources
from abode.llm.substring_dedup import substring_dedup
from abode.llm.toxicity import toxicity

TOXIC = 0.3


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under ``TOXIC``; null and empty texts have
    the lowest score.  Without usable labels all stay."""
    got = toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), rest=True)
    columns = [F.col(c) if c in ("doc_id", "text") else F.col(f"rest.`{c}`").alias(c) for c in docs.columns]
    return got.where(F.col("score") < TOXIC).select(*columns)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: the one with the smallest id.  Rows that
    share an id stay or go together; of rows with the same id and text one
    stays, the smallest by their other columns.  Rows without an id stay.
    Null and empty texts have no near duplicates."""
    groups = near_duplicates(docs).where("doc_id is not null").groupBy("doc_id").agg(F.bool_and("kept").alias("kept"), F.count("*").alias("n"))
    groups = written(groups, "groups")
    gone = groups.where("not kept").select("doc_id")
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    twice = groups.where("kept and n > 1").select("doc_id")
    if twice.isEmpty():
        return left
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    same = (left.join(twice, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(F.lit(0).alias("row"), *[F.col(f"`{c}`") for c in rest])).alias("rest"))
            .select(*[F.col(f"rest.`{c}`").alias(c) if c in rest else F.col(c) for c in docs.columns]))
    return left.join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(same)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows that a document with a smaller id has;
    ``n_chars`` follows a text that was cut.  Null texts become empty, no row goes."""
    got = substring_dedup(docs, rest=True)
    cut = F.col("n_removed") > 0
    columns = []
    for c, kind in docs.dtypes:
        col = {"doc_id": F.col("doc_id"), "text": F.col("kept_text")}.get(c)
        if col is None:
            col = F.col(f"rest.`{c}`")
            if c == "n_chars":
                col = F.when(cut, F.length("kept_text")).otherwise(col)
        columns.append(col.cast(kind).alias(c))
    return got.select(*columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark questions; null, empty and short texts stay."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: the mix, one row per
    document; null texts have size 0, a null source is a source."""
    return mix_sources(docs)[0]


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

# models and pseudorandom draws have no SQL form; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
