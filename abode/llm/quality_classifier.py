"""Quality classifier: random Fourier features over document statistics, ridge
scores from partition-summed normal equations, isotonic calibration.

1. One pass turns each text into ``len(STATS)`` numbers.
2. Standardised statistics x give features sqrt(2/D) cos(w.x + b) with normal
   w: their inner products approximate a Gaussian kernel.
3. Each partition of labelled rows sums its part of the normal equations,
   (Z'Z, Z'y); rows of the matrix are summed by Spark and the D+1 sized system
   is solved once.
4. Scores of labelled rows held apart from step 3 give the isotonic curve.

Defined results: null and empty texts have the statistics of no words and a
score like any other; without usable labels every score is 1 (keep); null labels are
ignored; repeated rows are scored each; a null doc_id is kept; an empty table
gives an empty table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from abode.llm.common import bounded_batches, fold, word_hash, written
from abode.llm.isotonic import calibrated, calibration

FEATURES = 256
WIDTH = 3.0
RIDGE = 1.0
STEP = 0.005
SUM_ROWS = 100_000
FAN = 64
STATS = ("log_words", "word_chars", "word_spread", "upper", "digit", "blank", "bang", "bar", "sign", "point", "quote", "wide",
         "distinct", "stutter", "top_word", "dup_lines", "log_lines", "line_words", "repeat", "letters_used", "entropy", "short_words")


def byte_classes() -> np.ndarray:
    """Class of each byte: 0 other, 1 capital, 2 digit, 3 blank, 4 !, 5 |, 6 sign, 7 point, 8 quote, 9 not ASCII."""
    t = np.zeros(256, np.int64)
    for k, chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\n\r\x0b\x0c", "!", "|", "#*$%&<>{}[]=+~^\\/_@", ".,;:?", "\"'`()-"), 1):
        t[[ord(c) for c in chars]] = k
    t[128:] = 9
    return t


def statistics(text: str | None, table: np.ndarray) -> list[float]:
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n, size = len(words), max(len(data), 1)
    raw = np.frombuffer(data, np.uint8)
    used = np.bincount(raw, minlength=256)
    share = np.bincount(table, weights=used, minlength=10) / size
    capitals = share[1] * size / max(int(used[97:123].sum()) + share[1] * size, 1)
    lengths = np.fromiter(map(len, words), np.int64, n) if n else np.zeros(1)
    counts = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    h = word_hash().many(words).view(np.int64) if n > 5 else np.zeros(0, np.int64)
    runs = h[:-4] + 3 * h[1:-3] + 5 * h[2:-2] + 7 * h[3:-1] + 11 * h[4:] if n > 5 else h
    p = used[used > 0] / size
    m = max(n, 1)
    return [math.log1p(n), min(float(lengths.mean()), 50.0), min(float(lengths.std()), 50.0), capitals, *share[2:10],
            len(counts) / m, sum(a == b for a, b in zip(words, words[1:], strict=False)) / m, (max(counts.values()) if n else 0) / m,
            1 - len(set(lines)) / max(len(lines), 1), math.log1p(len(lines)), math.log1p(n / max(len(lines), 1)),
            1 - len(np.unique(runs)) / max(len(runs), 1), int((used > 0).sum()) / 100, float(-(p * np.log(p)).sum()), float((lengths <= 2).mean())]


def document_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` (with a text column) plus x array<double>, without the text."""
    at = docs.columns.index("text")
    fields = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_classes()
        for batch in batches:
            x = np.array([statistics(t.as_py(), table) for t in batch.column(at)], float).reshape(-1, len(STATS))
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(STATS), pa.int32()), pa.array(x.ravel()))
            keep = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), rows], names=[*(batch.schema.names[i] for i in keep), "x"])

    return docs.mapInArrow(run, T.StructType([*fields, T.StructField("x", T.ArrayType(T.DoubleType()))]))


class Fourier:
    """x -> (1, sqrt(2/D) cos(w.x' + b)) of the standardised x'."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int, width: float, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.w, self.b = rng.normal(0, 1 / width, (len(mean), features)), rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6) @ self.w + self.b
        return np.hstack([np.ones((len(x), 1)), np.cos(z) * math.sqrt(2 / self.w.shape[1])])


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATS)) if len(column) else np.zeros((0, len(STATS)))


def normal_equations(rows: DataFrame, fourier: Fourier) -> tuple[np.ndarray, np.ndarray]:
    """(Z'Z, Z'y) of (x, y) rows: summed in partitions of about ``SUM_ROWS``
    rows, then by matrix row in levels of ``FAN`` partial sums, so no group
    holds more than that many, whatever the number of partitions."""
    d = fourier.w.shape[1] + 1
    parts = max(1, math.ceil(rows.count() / SUM_ROWS))
    rows = rows.coalesce(parts)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_ = np.zeros((d, d + 1)), False
        for batch in batches:
            z, y = fourier(matrix(batch.column(0))), batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            total += z.T @ np.column_stack([z, y])
            any_ |= len(y) > 0
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, TaskContext.get().partitionId()), pa.int32()), pa.array(np.arange(d), pa.int32()),
                                              pa.array(list(total), pa.list_(pa.float64()))], names=["g", "i", "v"])

    def add(t):
        v = t.column("v").combine_chunks()
        total = v.flatten().to_numpy().reshape(-1, d + 1).sum(0)
        return pa.table({"g": t.column("g").slice(0, 1), "i": t.column("i").slice(0, 1), "v": pa.array([total], pa.list_(pa.float64()))})

    schema = "g int, i int, v array<double>"
    sums = rows.select("x", "y").mapInArrow(part, schema)
    while parts > 1:
        parts = math.ceil(parts / FAN)
        sums = sums.withColumn("g", F.pmod("g", F.lit(parts))).groupBy("i", "g").applyInArrow(add, schema)
    full = np.zeros((d, d + 1))
    for r in sums.collect():  # one row of the matrix each
        full[r["i"]] = r["v"]
    return full[:, :d], full[:, d]


def quality_scores(docs: DataFrame, labels: DataFrame, held_mod: int = 5, held_rest: int = 0, features: int = FEATURES,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) for each row of ``docs``; learns from
    (doc_id, quality) rows whose crc32 of the id modulo ``held_mod`` isn't
    ``held_rest``."""
    bounded_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    stats = written(document_statistics(src), "statistics")
    known = (labels.where("doc_id is not null and quality is not null").where(fold(F.col("doc_id"), held_mod) != held_rest)
             .groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("y")))
    train = written(stats.join(known, "doc_id").select("x", "y", (F.pmod(F.xxhash64("doc_id", F.lit("apart")), F.lit(4)) == 0).alias("apart")), "train")
    n = len(STATS)
    at = train.where("not apart").agg(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(n)], *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(n)]).first()
    mean, spread = (np.array([at[f"{k}{i}"] or 0.0 for i in range(n)]) for k in "ms")
    fourier = Fourier(mean, spread, features, WIDTH)
    a, b = normal_equations(train.where("not apart"), fourier)
    beta = np.linalg.solve(a + RIDGE * np.eye(len(a)), b)
    curve = calibration(ridge(train.where("apart").select("x", "y"), fourier, beta, None), F.col("score"), F.col("y"), STEP, -1.0, 2.0)
    return ridge(stats, fourier, beta, curve).drop("x")


def ridge(rows: DataFrame, fourier: Fourier, beta: np.ndarray, curve: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """``rows`` plus their ridge score, calibrated if there is a curve."""
    at, names = rows.columns.index("x"), rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = fourier(matrix(batch.column(at))) @ beta
            score = score if curve is None else calibrated(score, curve, 1.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*names, "score"])

    return rows.mapInArrow(run, rows.selectExpr("*", "cast(0 as double) score").schema)
