"""Requests as a stream against a static corpus (Structured Streaming).

The request log is read with the file source; each micro-batch runs the
batch pipeline inside ``foreachBatch`` (a per-request window rank is not
allowed on a streaming frame).  Writes are keyed by ``batch_id`` with
overwrite, so a replayed batch after a failure rewrites the same output
(idempotent); progress lives in the checkpoint under the shared folder.
The answers are stateless, so no watermark is needed.  Rankings are cached:
the corpus is static, so a key's ranking never goes stale, and each batch
ranks only keys it has not seen (or asks more results for) — the corpus is
shuffled into tiles only when there is something new to rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from abode.functions.parse import parse_request
from abode.operators.search import fitted_encoder, rank_encoded, rank_texts, rank_vectors, respond_ranked, text_key
from abode.session import fresh_path, shared_dir
from abode.sources.requests import requests_from_events, requests_from_table, validate_k, vector_count


def event_stream(spark: SparkSession, src_dir: str, glob: str = "events.parquet",
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Raw files of events or requests in ``src_dir`` (matching ``glob``) as a stream."""
    src_dir = src_dir.rstrip("/")
    schema = spark.read.parquet(f"{src_dir}/{glob}").schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(src_dir)


def ranking_cache_schema(ranking: str = "vector") -> T.StructType:
    """Cached rankings: request key (vector id, or enhanced text), the k it
    was ranked for, and the ranked listings."""
    return T.StructType([
        T.StructField("__key", T.LongType() if ranking == "vector" else T.StringType()),
        T.StructField("kc", T.IntegerType()),
        T.StructField("id", T.LongType()),
        T.StructField("similarity_score", T.DoubleType()),
        T.StructField("search_rank", T.IntegerType()),
    ])


def _key(ranking: str) -> tuple[str, F.Column]:
    """Name of the ranking key and the request column it comes from."""
    if ranking == "vector":
        return "vec_id", F.col("vec_id")
    if ranking in ("lexical", "encoded"):
        return "qkey", text_key("enhanced")
    raise ValueError(f"unknown ranking {ranking!r}")


CACHE_BUCKETS = 256


def _written_dirs(spark: SparkSession, root: str, name: str, among: range | None = None) -> list[int]:
    """N of every ``{root}/{name}=N`` folder (of the numbers ``among``, if
    given) whose write came to its end (file-system metadata only)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if among is None:
        if not fs.exists(p):
            return []
        names = [st.getPath().getName() for st in fs.listStatus(p) if st.isDirectory()]
        among = sorted(int(n.split("=", 1)[1]) for n in names if n.startswith(name + "="))
    return [n for n in among if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{name}={n}/_SUCCESS"))]


def key_bucket(key: F.Column) -> F.Column:
    return F.pmod(F.xxhash64(key), F.lit(CACHE_BUCKETS)).cast("int")


def read_cache(spark: SparkSession, cache_dir: str, schema: T.StructType, before: int | None = None,
               buckets: list[int] | None = None) -> DataFrame:
    """The ranking cache: the newest compaction (``{cache_dir}_compact/upto=M``)
    plus the batch folders written after it, so a long stream reads a
    bounded set of folders instead of one per batch ever run.  With
    ``before``, only what batches under that number have written; with
    ``buckets``, only those partitions of the compaction.  A folder whose
    write was cut off counts as absent."""
    compact = [c for c in _written_dirs(spark, f"{cache_dir}_compact", "upto") if before is None or c < before]
    last = compact[-1] if compact else None
    if before is None:
        batches = [b for b in _written_dirs(spark, cache_dir, "batch_id") if last is None or b > last]
    else:  # batches are numbered one by one
        batches = _written_dirs(spark, cache_dir, "batch_id", range(-1 if last is None else last + 1, before))
    parts = [spark.read.schema(schema).parquet(f"{cache_dir}/batch_id={b}") for b in batches]
    if last is not None:
        base = spark.read.schema(T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(f"{cache_dir}_compact/upto={last}")
        parts.insert(0, (base if buckets is None else base.where(F.col("bucket").isin(buckets))).select(*schema.fieldNames()))
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def compact_cache(spark: SparkSession, cache_dir: str, schema: T.StructType, batch_id: int) -> None:
    """Each key's latest ranking of all batches before ``batch_id``, by bucket
    of the key, as ``upto=batch_id - 1``.  What it reads is older than what it
    writes, and a folder that came to its end is never written again: a batch
    that runs again finds it as it was."""
    out, upto = f"{cache_dir}_compact", batch_id - 1
    if not _written_dirs(spark, out, "upto", range(upto, upto + 1)):
        latest = _latest(read_cache(spark, cache_dir, schema, before=upto).unionByName(_batch(spark, cache_dir, schema, upto)))
        (latest.withColumn("bucket", key_bucket(F.col("__key"))).repartition("bucket")
         .write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/upto={upto}"))


def _batch(spark: SparkSession, cache_dir: str, schema: T.StructType, batch_id: int) -> DataFrame:
    """The rows that one batch has added, none if it has written nothing."""
    if _written_dirs(spark, cache_dir, "batch_id", range(batch_id, batch_id + 1)):
        return spark.read.schema(schema).parquet(f"{cache_dir}/batch_id={batch_id}")
    return spark.createDataFrame([], schema)


def _latest(cache: DataFrame) -> DataFrame:
    """Each key's rows ranked for its largest k."""
    return cache.join(cache.groupBy("__key").agg(F.max("kc").alias("kc")), ["__key", "kc"], "left_semi")


def cached_rankings(parsed: DataFrame, listings: DataFrame, embeddings: DataFrame, cache_dir: str,
                    batch_id: int, ranking: str = "vector", encoder=None, compact_every: int = 20):
    """Rankings for this batch's keys, from the cache where it holds enough
    results (``kc >= k``), else computed now and added to the cache under
    ``batch_id=N`` (overwrite: a replayed batch looks only at what earlier
    batches cached, so it rewrites the same rows).  A key without any result
    is cached as one row without an id.  When nothing is new the corpus isn't read.
    Every ``compact_every`` batches, before anything else, what the earlier
    ones cached is compacted (``compact_cache``; nothing is deleted); of a
    compaction only the buckets of this batch's keys are read.
    Returns (ranking keyed like the batch path, proven row bound)."""
    spark = parsed.sparkSession
    shared_dir(spark)  # checkpoints go to the cluster's shared folder
    schema = ranking_cache_schema(ranking)
    key, req_key = _key(ranking)
    # a text's key stands for the text; only the keys to rank now need the text itself
    texts = [] if ranking == "vector" else ["enhanced"]
    keys = (parsed.groupBy(req_key.alias("__key"), *[F.coalesce(t, F.lit("")).alias(t) for t in texts])
            .agg(F.max("max_results").alias("kq")).checkpoint(eager=True))
    if compact_every and batch_id > 0 and batch_id % compact_every == 0:
        compact_cache(spark, cache_dir, schema, batch_id)
    buckets = [r[0] for r in keys.select(key_bucket(F.col("__key"))).distinct().collect()]  # at most CACHE_BUCKETS
    earlier = read_cache(spark, cache_dir, schema, before=batch_id, buckets=buckets)
    have = earlier.groupBy("__key").agg(F.max("kc").alias("kc"))
    need = (keys.join(have, "__key", "left")
                .filter(F.col("kc").isNull() | (F.col("kq") > F.col("kc")))
                .select("__key", *texts, F.col("kq").alias("max_results")).checkpoint(eager=True))
    if need.isEmpty():
        found = spark.createDataFrame([], schema)
    else:
        opts = {"materialize_queries": False}
        if ranking == "vector":
            new, _ = rank_vectors(need.withColumnRenamed("__key", "vec_id"), listings, embeddings, **opts)
        elif ranking == "lexical":
            new, _ = rank_texts(need, listings, **opts)
        else:
            new, _ = rank_encoded(need, listings, encoder, **opts)
        found = (need.select("__key", F.col("max_results").cast("int").alias("kc"))
                 .join(new.withColumnRenamed(key, "__key"), "__key", "left").select(*schema.fieldNames()))
    found.write.mode("overwrite").parquet(f"{cache_dir}/batch_id={batch_id}")
    # latest (largest-k) ranking of each key of this batch that it or an earlier batch cached
    cache = earlier.unionByName(_batch(spark, cache_dir, schema, batch_id))
    best = _latest(cache.join(keys.select("__key"), "__key", "left_semi"))
    n = keys.agg(F.count(F.lit(1)).alias("n"), F.max("kq").alias("k")).first()
    kc_max = best.agg(F.max("kc")).first()[0] or 0
    out = best.where(F.col("id").isNotNull()).select(F.col("__key").alias(key), "id", "similarity_score", "search_rank")
    return out, (n["n"] or 0) * max(kc_max, n["k"] or 0)


def start_chat_stream(spark: SparkSession, src_dir: str, listings: DataFrame, embeddings: DataFrame,
                      out: str, answered_at: str | None = None, mode: str = "api",
                      glob: str = "events.parquet", max_files_per_trigger: int | None = None,
                      processing_time: str | None = None, available_now: bool = False,
                      ranking: str = "vector", encoder=None, compact_every: int = 20):
    """Start answering the request stream; returns the ``StreamingQuery``.

    Files with a ``msg`` column hold requests as users sent them (``qid, msg``
    and, where given, ``max_results, vec_id``); other files hold events, which
    become requests (vector ids over the whole static vector table).  Each
    micro-batch is answered by the batch pipeline.  Output goes
    to ``{out}/responses/batch_id=N`` with overwrite, so a batch replayed
    after a failure rewrites the same files; progress is kept in
    ``{out}/_checkpoint`` (on the shared folder)."""
    sink, ckpt, cache_dir = f"{out}/responses", f"{out}/_checkpoint", f"{out}/_rankings"
    key, req_key = _key(ranking)
    ts = F.lit(answered_at).cast("timestamp") if answered_at else None
    if ranking == "encoded":  # the listings are static: one fit serves every batch
        fitted = fitted_encoder(listings, encoder)
        encoder = lambda _texts: fitted

    def answer(batch: DataFrame, batch_id: int) -> None:
        reqs = requests_from_table(batch) if "msg" in batch.columns else requests_from_events(batch, vector_count(embeddings))
        parsed = parse_request(validate_k(reqs), mode=mode)
        ranked, bound = cached_rankings(parsed, listings, embeddings, cache_dir, batch_id, ranking, encoder,
                                        compact_every)
        resp = respond_ranked(parsed, listings, ranked, bound, key, req_key, mode, ts)
        resp.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    # an empty, typed cache to start from (kept as is on restart)
    spark.createDataFrame([], ranking_cache_schema(ranking)).coalesce(1).write.mode("ignore").parquet(f"{cache_dir}/batch_id=-1")
    w = (event_stream(spark, src_dir, glob, max_files_per_trigger).writeStream.foreachBatch(answer)
         .option("checkpointLocation", ckpt))
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()


def run_chat_stream(spark: SparkSession, sf_dir: str, listings: DataFrame, embeddings: DataFrame,
                    answered_at: str | None = None, mode: str = "api", out: str | None = None,
                    glob: str = "events.parquet", max_files_per_trigger: int | None = None,
                    ranking: str = "vector", encoder=None, compact_every: int = 20) -> DataFrame:
    """Drain the request stream (availableNow) and return the sink table."""
    out = out or fresh_path(spark, "chat-stream")
    q = start_chat_stream(spark, sf_dir, listings, embeddings, out, answered_at, mode, glob,
                          max_files_per_trigger, available_now=True, ranking=ranking, encoder=encoder,
                          compact_every=compact_every)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return spark.read.parquet(f"{out}/responses").drop("batch_id")
