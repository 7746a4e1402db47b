"""Request tables: the request log derived from ``events`` plus the golden
messages.  Columns: qid BIGINT, user_id BIGINT, ts TIMESTAMP, msg STRING,
max_results INT, vec_id BIGINT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from abode.constants import BASE_TS, DEFAULT_K, GOLDEN_MESSAGES

REQUEST = T.StructType([
    T.StructField("qid", T.LongType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("msg", T.StringType()),
    T.StructField("max_results", T.IntegerType()),
    T.StructField("vec_id", T.LongType()),
])

def vector_count(embeddings: DataFrame) -> Column:
    """Size of the whole vector table as a scalar subquery (evaluated once per
    query; a row count reads parquet footers only)."""
    return embeddings.select(F.count(F.lit(1))).scalar()


def requests_from_events(events: DataFrame, n_vectors: Column | int) -> DataFrame:
    """One request per event; message shape by event_id mod 5.  The request
    vector spans the whole ``embeddings`` table: vec_id = event_id mod
    ``n_vectors`` (the driver's vector ids are dense, 0..n-1), so the ranking
    work grows with both tables.  A pure projection (the scalar is a constant
    of the query)."""
    msg = ("CASE pmod(event_id, 5) "
           "WHEN 0 THEN concat(CAST(1 + pmod(event_id, 4) AS STRING), ' bhk in Mumbai under ', "
           "CAST(3000 + pmod(event_id, 9) * 1000 AS STRING)) "
           "WHEN 1 THEN concat('furnished ', element_at(array('apartment', 'condo', 'house'), "
           "CAST(pmod(event_id, 3) AS INT) + 1), ' below $', CAST(4000 + pmod(event_id, 7) * 500 AS STRING)) "
           "WHEN 2 THEN 'studio with gym' "
           "WHEN 3 THEN 'affordable family house with pool' "
           "ELSE concat(CAST(1 + pmod(event_id, 5) AS STRING), ' bedroom flat less than ', "
           "CAST(5000 + pmod(event_id, 11) * 700 AS STRING)) END")
    n = n_vectors if isinstance(n_vectors, Column) else F.lit(int(n_vectors))
    return events.select(
        F.col("event_id").cast("bigint").alias("qid"),
        F.col("user_id").cast("bigint").alias("user_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.expr(msg).alias("msg"),
        F.expr(f"CAST(CASE WHEN pmod(event_id, 4) = 0 THEN {DEFAULT_K} ELSE 5 + pmod(event_id, 20) END AS INT)")
         .alias("max_results"),
        F.pmod(F.col("event_id"), n.cast("bigint")).cast("bigint").alias("vec_id"),
    )


def requests_from_table(df: DataFrame) -> DataFrame:
    """Requests as users sent them: ``qid`` and ``msg`` are required;
    ``max_results`` (null: the default), ``vec_id`` (needed by vector ranking
    only), ``user_id`` and ``ts`` may be missing.  Other columns are left out."""
    lost = {"qid", "msg"} - set(df.columns)
    if lost:
        raise ValueError(f"requests need the columns {sorted(lost)}")
    return df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in REQUEST.fields])


CONV_TURNS = 1_000_000  # qid = conv_id * CONV_TURNS + turn


def requests_from_conversations(conversations: DataFrame) -> DataFrame:
    """User turns of chat conversations as requests: the whole message text,
    the default k, no request vector (text ranking only).  A pure filter and
    projection; qid = conv_id * 1e6 + turn (a larger turn fails the query
    rather than collide)."""
    turn = F.col("turn").cast("bigint")
    return conversations.where(F.col("role") == "user").select(
        F.when((turn >= 0) & (turn < CONV_TURNS), F.col("conv_id").cast("bigint") * CONV_TURNS + turn)
         .otherwise(F.raise_error(F.lit("conversation turn out of range"))).cast("bigint").alias("qid"),
        F.col("conv_id").cast("bigint").alias("user_id"),
        F.lit(BASE_TS).cast("timestamp").alias("ts"),
        F.col("text").alias("msg"),
        F.lit(DEFAULT_K).cast("int").alias("max_results"),
        F.lit(None).cast("bigint").alias("vec_id"),
    )


def golden_requests(spark: SparkSession) -> DataFrame:
    """The fixed messages as a JVM-side local relation (messages bound as
    named parameters: no quoting, one call)."""
    rows = ", ".join(f"({-(g + 1)}L, CAST(NULL AS BIGINT), TIMESTAMP '{BASE_TS}', :m{g}, {DEFAULT_K}, {g}L)"
                     for g in range(len(GOLDEN_MESSAGES)))
    args = {f"m{g}": m for g, m in enumerate(GOLDEN_MESSAGES)}
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(qid, user_id, ts, msg, max_results, vec_id)", args=args)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-repartition by a unique key only when the input has fewer
    partitions than the cluster runs tasks (e.g. one small file): large
    inputs keep their splits and pay no shuffle.  Hashing a unique key is
    deterministic on retry and cannot skew."""
    par = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < par:
        return df.repartition(par, key)
    return df


def request_log(spark: SparkSession, events: DataFrame, n_vectors: Column | int,
                include_golden: bool = True) -> DataFrame:
    """The request log from ``events`` (plus the golden messages)."""
    log = requests_from_events(spread(events, "event_id"), n_vectors)
    if include_golden:
        log = log.unionByName(golden_requests(spark))
    return log


def validate_k(requests: DataFrame, k_col: str = "max_results") -> DataFrame:
    """Null k -> default 10; k < 1 raises at execution (ValueError semantics)."""
    k = F.coalesce(F.col(k_col), F.lit(DEFAULT_K))
    return requests.withColumn(
        k_col, F.when(k >= 1, k).otherwise(F.raise_error(F.lit("max_results must be >= 1"))).cast("int"))
