"""Shared pieces of the training-data operators: words and their hashes,
written intermediate tables, documents dealt into blocks, and a two-way
exchange of packed hashes between blocks and hash shards."""

from __future__ import annotations

import math
import sys
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from abode.session import fresh_path

# the white space that separates words: space and U+0009..U+000D
SPACES = r"[\x20\x09-\x0D]+"
BATCH_BYTES = 16 << 20
U64 = np.uint64


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches are cut by bytes as well as rows, so that a run of very
    long texts can't fill a Python worker (runtime SQL setting, kept when the
    session already has a smaller one)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(2**31 - 1))) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage is cut, and
    a lost executor costs no more than reading it again."""
    spark = df.sparkSession
    path = fresh_path(spark, f"llm-{name}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words_col(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text column (null: none), in the JVM."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def fold(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null ids count as remainder of ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def words_of(text: str | None) -> list[bytes]:
    """The same words as bytes: ``bytes.split`` splits at space and 0x09-0x0D only."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def worker_state(owner: str = "words") -> dict:
    """A dict that a Python worker keeps from task to task (caches only: it may
    be empty at any time).  One owner at a time: an operator whose worker ran
    another one before takes over its memory, not its caches."""
    kept = sys.modules.setdefault("_llm_worker_state", types.ModuleType("_llm_worker_state"))
    if getattr(kept, "owner", None) != owner:
        kept.owner, kept.caches = owner, {}
    return kept.caches


def word_hash() -> WordHash:
    """The worker's cache of word hashes."""
    return worker_state().setdefault("word_hash", WordHash())


class WordHash(dict):
    """word -> 64-bit hash, remembered; emptied when it grows past ``most``."""

    most = 1_000_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def many(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = np.asarray(x, U64)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def odd_constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd numbers that depend on ``seed`` alone; remembered by the worker."""
    state, key = worker_state(), f"odd {n} {seed}"
    if key not in state:
        state[key] = np.random.default_rng(seed).integers(0, 2**63, n, dtype=U64) * U64(2) + U64(1)
    return state[key]


def window_hash(h: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive word hashes (none if too few)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    c = odd_constants(k, seed)
    out = np.zeros(n, U64)
    for i in range(k):
        out += h[i:i + n] * c[i]
    return mix64(out)


# ---------------------------------------------------------------------------
# documents dealt into blocks
# ---------------------------------------------------------------------------

def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return int(docs.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0)


def others(docs: DataFrame, *but: str) -> Column:
    """The other columns of ``docs`` as one struct ``rest``, whatever their names."""
    return F.struct(F.lit(True).alias("row"), *[F.col(f"`{c}`") for c in docs.columns if c not in but]).alias("rest")


class Blocks:
    """(doc_id, text) dealt by a hash of id and text into blocks of about
    ``block_bytes`` of text and stored bucketed by block, so that several
    passes can meet other data by block without moving the texts again.

    A block is the unit a Python task holds; their number follows the input.
    Id and text together deal the rows: many rows with one id (or a null id)
    spread over blocks.  With ``rest`` every row carries its other columns."""

    def __init__(self, docs: DataFrame, name: str, block_bytes: int, id_col: str = "doc_id", text_col: str = "text",
                 total: int | None = None, rest: bool = False):
        spark = docs.sparkSession
        bounded_batches(spark)
        src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                          *([others(docs, id_col, text_col)] if rest else []))
        total = text_bytes(src) if total is None else total
        self.n = max(1, math.ceil(total / block_bytes))
        parts = min(self.n, max(1, math.ceil(total / (32 << 20))) * 4)
        block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(self.n)).cast("int")
        table = f"llm_{name}_{uuid.uuid4().hex[:12]}"
        (src.withColumn("block", block).repartition(parts, "block").write.option("compression", "zstd")
         .option("path", fresh_path(spark, table)).bucketBy(parts, "block").format("parquet").saveAsTable(table))
        self.df = spark.table(table)
        self.spark = spark

    def grouped(self):
        return self.df.groupBy("block")


def block_table(t: pa.Table) -> pa.Table:
    """A block's rows in an order that depends on ids and texts alone."""
    ids, texts = t.column("doc_id").to_pylist(), t.column("text").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i] is not None, texts[i] or ""))
    return t.take(pa.array(order, pa.int64()))


def pack(**arrays: np.ndarray) -> bytes:
    """Named arrays as one byte string (little-endian, no pickling)."""
    batch = pa.record_batch([pa.array([a.tobytes()], pa.binary()) for a in arrays.values()],
                            names=[f"{k}:{a.dtype.str}" for k, a in arrays.items()])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(data: bytes) -> dict[str, np.ndarray]:
    batch = pa.ipc.open_stream(data).read_next_batch()
    out = {}
    for name, col in zip(batch.schema.names, batch.columns, strict=True):
        k, _, kind = name.partition(":")
        out[k] = np.frombuffer(col[0].as_py(), np.dtype(kind))
    return out


PIECES = "shard int, block int, data binary"


def pieces(block: int, rows: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"shard": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([block] * len(rows), pa.int32()),
                     "data": pa.array([r[1] for r in rows], pa.binary())})


def send(blocks: Blocks, make: Callable[[pa.Table], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """Rows (shard, block, data): what each block's documents ask of each shard."""
    def up(key, t):
        return pieces(key[0].as_py(), list(make(block_table(t))))

    return blocks.grouped().applyInArrow(up, PIECES)


def answer(asked: DataFrame, reply: Callable[[int, list[int], list[bytes]], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """Rows (shard, block, data): what each shard says to each block.  A shard
    holds a hash share of the distinct items of every block; the number of
    shards follows the input, so a shard's size doesn't."""
    def run(key, t):
        s = key[0].as_py()
        order = np.argsort(t.column("block").to_numpy(), kind="stable")
        blocks_, data = t.column("block").to_pylist(), t.column("data").to_pylist()
        rows = list(reply(s, [blocks_[i] for i in order], [data[i] for i in order]))
        return pa.table({"shard": pa.array([s] * len(rows), pa.int32()), "block": pa.array([r[0] for r in rows], pa.int32()),
                         "data": pa.array([r[1] for r in rows], pa.binary())})

    return asked.groupBy("shard").applyInArrow(run, PIECES)


def receive(blocks: Blocks, answers: DataFrame, use: Callable[[int, pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``use(block, documents, answers)`` for every block of documents; the
    documents come in ``block_table`` order, the answers (any table with a
    ``block`` column) as they are."""
    def down(key, docs, ans):
        block = (docs if docs.num_rows else ans).column("block")[0].as_py()
        return use(block, block_table(docs), ans)

    return blocks.grouped().cogroup(answers.groupBy("block")).applyInArrow(down, schema)


def groups(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): ``values[order]`` is sorted, an equal run begins at each start."""
    order = np.argsort(values)
    v = values[order]
    return order, np.flatnonzero(np.r_[True, v[1:] != v[:-1]]) if len(v) else np.zeros(0, np.int64)


def ranks(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first of each distinct value, ascending by value; rank of every value)."""
    order, first = groups(values)
    rank = np.empty(len(values), np.int64)
    rank[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(order)]))
    return np.minimum.reduceat(order, first) if len(first) else first, rank


def split_by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, positions) of each shard that occurs, positions ascending."""
    order = np.argsort(shard, kind="stable")
    s = shard[order]
    cuts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, int)
    for a, b in zip(cuts, np.r_[cuts[1:], len(s)], strict=True):
        yield int(s[a]), order[a:b]
