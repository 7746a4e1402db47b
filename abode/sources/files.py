"""Listing files: JSON (lines or array document), CSV, Parquet corpus.

Reads always use an explicit schema (no inference pass over the data).
"""

from __future__ import annotations

import os
import re
import uuid
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from abode.schema import LISTING, LISTING_CSV

_JSON_OPTS = {"allowSingleQuotes": "false"}

# records of a written file that is read as one piece (array document, CSV with quoted line ends)
FILE_ROWS = 50_000


def coerce_amenities(col: Column) -> Column:
    """Amenities given as JSON text -> ARRAY<STRING>; anything unparsable
    (including Python-repr lists with single quotes) -> empty list."""
    return F.coalesce(F.from_json(col, "array<string>", _JSON_OPTS), F.array().cast("array<string>"))


def _amenities_any(df: DataFrame) -> DataFrame:
    """Normalise an amenities column that may be text or array."""
    t = df.schema["amenities"].dataType.simpleString() if "amenities" in df.columns else None
    if t == "string":
        return df.withColumn("amenities", coerce_amenities(F.col("amenities")))
    return df


def typed(text: Column, kind: T.DataType) -> Column:
    """A text cell as ``kind``; whole numbers written as decimals ("25000.0")
    keep their value, cells that can't be read are null."""
    if isinstance(kind, (T.LongType, T.IntegerType)):
        d = text.try_cast("decimal(38,10)")  # exact: a double would round numbers past 2^53
        return F.coalesce(text.try_cast(kind), F.when(d == F.floor(d), d.try_cast(kind)))
    return text.try_cast(kind)


def _by_name(raw: DataFrame) -> DataFrame:
    """Text columns cast by name to the listing's types; columns a file lacks are null."""
    have = set(raw.columns)
    return raw.select(*[
        (typed(F.col(f"`{f.name}`"), f.dataType) if f.name != "amenities" else F.col("amenities"))
        .alias(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name)
        for f in LISTING_CSV.fields])


def load_listings(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Read listings by extension: ``.json`` (per file JSON lines or one array
    document, told apart by the file's first character), ``.csv`` (header,
    quoted, amenities as JSON text), ``.parquet``.  Other extensions raise.

    JSON and CSV cells are read as text and cast by name, so amenities may be
    a list or JSON text and numbers may be quoted or decimal.  A broken JSON
    record, or a CSV file whose header differs from the others', is an error."""
    fmt = fmt or os.path.splitext(path.rstrip("/"))[1].lstrip(".").lower()
    if fmt in ("json", "jsonarray", "json_array"):
        df = _by_name(_read_json(spark, path))
    elif fmt == "csv":
        opts = {"header": True, "multiLine": True, "escape": '"'}
        names = spark.read.options(**opts).csv(path).schema
        df = _by_name(spark.read.schema(names).options(enforceSchema=False, **opts).csv(path))
    elif fmt == "parquet":
        df = spark.read.schema(LISTING).parquet(path)
    else:
        raise ValueError(f"listings are read from .json, .csv or .parquet, not {fmt!r}")
    return with_keys(_amenities_any(df))


def _read_json(spark: SparkSession, path: str) -> DataFrame:
    """All fields as text.  One scan finds each file's first character that
    isn't blank; array documents ("[") are read whole, one task per file."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"),
                                         F.monotonically_increasing_id().alias("n"), F.ltrim(F.translate("value", "\t\r\ufeff", "")).alias("v"))
    first = (lines.where("v <> ''").groupBy("file").agg(F.min_by(F.substring("v", 1, 1), F.struct("at", "n")).alias("c")).collect())
    schema = T.StructType([T.StructField(f.name, T.StringType()) for f in LISTING.fields])
    arrays = [literal_path(r["file"]) for r in first if r["c"] == "["]
    others = [literal_path(r["file"]) for r in first if r["c"] != "["]
    parts = [spark.read.schema(schema).options(mode="FAILFAST", multiLine=whole).json(files)
             for files, whole in ((others, False), (arrays, True)) if files]
    if not parts:
        return spark.createDataFrame([], schema)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def literal_path(uri: str) -> str:
    """A file's name as ``_metadata.file_path`` gives it (percent-encoded) as a
    path to read: decoded, with the signs that mean a pattern escaped."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", unquote(uri))


def with_keys(df: DataFrame) -> DataFrame:
    """Files written elsewhere carry no internal key: give such rows a unique
    BIGINT (above 2^62, so it cannot meet a supplied id).  Splits of a file
    are fixed, so a recomputed partition gets the same keys."""
    return df.withColumn("id", F.coalesce(F.col("id"), F.monotonically_increasing_id() + F.lit(1 << 62)))


def save_listings_csv(df: DataFrame, path: str) -> str:
    """CSV with header; amenities written as JSON text (CSV has no arrays).
    A partition becomes files of at most ``FILE_ROWS`` rows: quoted cells may
    hold line ends, so a file is read by one task."""
    (df.withColumn("amenities", F.to_json("amenities"))
       .write.mode("overwrite").option("header", True).option("escape", '"').option("maxRecordsPerFile", FILE_ROWS).csv(path))
    return path


def save_listings_json(df: DataFrame, path: str) -> str:
    """JSON lines (splittable on read)."""
    df.write.mode("overwrite").json(path)
    return path


def save_listings_array(df: DataFrame, path: str) -> str:
    """JSON array documents, one record a line: a partition becomes documents of
    at most ``FILE_ROWS`` records (none: an empty one), each a file, as a
    document is read by one task."""
    most = FILE_ROWS

    def lines(*values):
        return pa.RecordBatch.from_arrays([pa.array(values, pa.string())], names=["value"])

    def documents(batches):
        held = 0  # records of the open document
        yield lines("[")
        for b in batches:
            rows = b.column(0).to_pylist()
            while rows:
                if held == most:
                    yield lines("]", "[")
                    held = 0
                some, rows = rows[:most - held], rows[most - held:]
                yield lines(*[r if held + i == 0 else "," + r for i, r in enumerate(some)])
                held += len(some)
        yield lines("]")

    text = df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value"))
    # every document but a partition's last has FILE_ROWS records and two brackets
    text.mapInArrow(documents, "value string").write.mode("overwrite").option("maxRecordsPerFile", most + 2).text(path)
    return path


def prepare_corpus(spark: SparkSession, listings: DataFrame, vectors: DataFrame, out: str,
                   rebuild: bool = False) -> tuple[DataFrame, DataFrame]:
    """Build-or-load: when there is no corpus under ``out``, or with
    ``rebuild``, listings and checked vectors (one dimension, unit norm) are
    written as a new version; then the newest version is read.

    A version's tables have a folder of their own, and its manifest is written
    last: until then, and after a crash or a failed check, the version before
    stays the corpus.  Two writers of one version: the second one fails."""
    versions = _versions(spark, out)
    if rebuild or not versions:
        from abode.operators.encode import check_vectors

        n = (versions[-1] if versions else 0) + 1
        folder = f"version-{n}-{uuid.uuid4().hex[:8]}"
        first = vectors.select(F.size("embedding").alias("dim")).first()
        listings.write.parquet(f"{out}/{folder}/listings")
        check_vectors(vectors, first["dim"] if first else None).write.parquet(f"{out}/{folder}/vectors")
        spark.range(1).select(F.lit(folder).alias("folder"), F.lit(first["dim"] if first else None).cast("int").alias("dim")).coalesce(1).write.parquet(
            f"{out}/manifest={n}")
    return load_corpus(spark, out)


def load_corpus(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """The (listings, vectors) of the newest version; FileNotFoundError if there is none."""
    versions = _versions(spark, out)
    if not versions:
        raise FileNotFoundError(f"no complete corpus under {out}")
    folder = spark.read.parquet(f"{out}/manifest={versions[-1]}").first()["folder"]
    return spark.read.parquet(f"{out}/{folder}/listings"), spark.read.parquet(f"{out}/{folder}/vectors")


def corpus_from_files(spark: SparkSession, folder: str, out: str, encoder=None, rebuild: bool = False) -> tuple[DataFrame, DataFrame]:
    """The corpus of the listing files in ``folder``: an existing one is loaded;
    else the JSON files, or without any the CSV files, are read, their
    profile texts encoded (``encoder`` as in ``encode``, of dense vectors; default hashed TF-IDF) and
    both persisted.  Without files and corpus: FileNotFoundError."""
    if not rebuild and _versions(spark, out):
        return load_corpus(spark, out)
    kinds = [k for k in ("json", "csv") if _matches(spark, f"{folder}/*.{k}")]
    if not kinds:
        raise FileNotFoundError(f"no .json or .csv listings in {folder}")
    from abode.operators.encode import hashed_tfidf_encoder
    from abode.operators.search import fitted_encoder, profile_texts

    listings = load_listings(spark, f"{folder}/*.{kinds[0]}", kinds[0])
    vectors = fitted_encoder(listings, encoder or hashed_tfidf_encoder())(profile_texts(listings), "text").select("id", "embedding")
    return prepare_corpus(spark, listings, vectors, out, rebuild)


def update_corpus(listings: DataFrame, out: str, encode) -> tuple[DataFrame, DataFrame]:
    """A new version with ``listings`` (unique ids); only listings whose profile
    text differs from the newest version's, or that are new, are encoded, the
    others keep their vector.

    ``encode(texts) -> texts with embedding`` may depend on a text alone (a
    model), not on the corpus.  Vectors carry the digest of the text they were
    made of; without a version, or with one that has no digests, all are
    encoded.  A null id is always encoded again."""
    from abode.operators.search import profile_texts

    spark = listings.sparkSession
    texts = profile_texts(listings).withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256))
    known = load_corpus(spark, out)[1] if _versions(spark, out) else None
    if known is None or "digest" not in known.columns:
        vectors = encode(texts).select("id", "embedding", "digest")
    else:
        kept = texts.select("id", "digest").join(known.select("id", "digest", "embedding"), ["id", "digest"])
        new = texts.join(known.select("id", "digest"), ["id", "digest"], "left_anti")
        vectors = kept.select("id", "embedding", "digest").unionByName(encode(new).select("id", "embedding", "digest"))
    return prepare_corpus(spark, listings, vectors, out, rebuild=True)


def _versions(spark: SparkSession, out: str) -> list[int]:
    """Numbers of the versions whose manifest was written to its end."""
    return sorted(n for n in (int(p.split("=", 1)[1]) for p in _matches(spark, f"{out}/manifest=*")) if _written(spark, f"{out}/manifest={n}"))


def _matches(spark: SparkSession, pattern: str) -> list[str]:
    """Names that fit a path pattern."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return [f.getPath().getName() for f in found or []]


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def _written(spark: SparkSession, path: str) -> bool:
    """True if a write to ``path`` came to its end."""
    return _exists(spark, f"{path}/_SUCCESS")


def python_repr_list(col: Column) -> Column:
    """Text form of a list as Python's repr prints it (what a pandas CSV
    export of a list column contains): single quotes, or double quotes for
    items holding an apostrophe."""
    quoted = F.transform(col, lambda x: F.when(x.contains("'"), F.concat(F.lit('"'), x, F.lit('"')))
                         .otherwise(F.concat(F.lit("'"), x, F.lit("'"))))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))
