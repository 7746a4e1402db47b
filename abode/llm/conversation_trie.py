"""Prefix trie of conversations: every distinct sequence of first turns is a node.

1. ``turn_table``: turns get their place in the conversation and a 128-bit id of
   role and text; texts stay behind.
2. ``prefix_table``: a running exclusive-or of the turns' ids, each hashed with
   its place, is the id of the prefix that ends there.
3. Burst trie: all conversations begin in one container under the root.  A
   container of more than ``MOST`` conversations bursts by the next turn: its
   prefix becomes a head of the trie, its members move to containers under the
   head.  Rounds take 1, 2, 4, ... turns at once, so a long prefix that very
   many share takes few rounds; a round counts only what is still oversized.
4. What remains is dealt by container to shards, sorted by prefix ids and swept:
   neighbours' common prefix says which nodes are closed.  A shard holds one
   path of the trie at a time, and the nodes of one container of at most ``MOST``.
5. Sums over a head's subtree add up the containers and heads under it: each is
   sent to the heads on its path.
6. Conversations that end at a head (any number may) are sorted by range, so many
   tasks write them down in pieces; a node's pieces are put together in order.

Hot turns and prefixes are counted map-side; no conversation's members are
collected.  The turns of one conversation are sorted by one task (spilling), and
the ids of what lies below the heads (24 bytes a turn) are one row.

Defined results: turns with the same place are ordered by their ids, so in one
way in every layout; null role or text is empty; rows without a conversation id belong to no
conversation; other columns are ignored; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from abode.llm.common import written

MOST = 500
PIECE = 1 << 20
BROADCAST_HEADS = 500_000  # rows of five numbers
EMPTY = hashlib.sha256(b"").hexdigest()
KEY = ["depth", "k1", "k2"]
SWEPT = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
         "top boolean, cut long, h1 long, h2 long")
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def ordered(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, *keep: str) -> DataFrame:
    """conv_id, pos (from 1, by turn, null first), x, y (the turn's id), n_chars and ``keep`` of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    ident = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    half = [F.conv(F.substring(ident, a, 15), 16, 10).cast("long") for a in (1, 17)]  # 60 bits of each half
    turns = conversations.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), half[0].alias("x"), half[1].alias("y"),
        F.length(text).cast("long").alias("n_chars"), role.alias("role"), text.alias("text"))
    by = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "x", "y")
    return turns.select("conv_id", F.row_number().over(by).cast("long").alias("pos"), "x", "y", "n_chars", *keep)


def turn_table(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
               text_col: str = "text") -> DataFrame:
    """conv_id, pos, x, y, n_chars of every turn; texts don't move."""
    return ordered(conversations, conv_col, turn_col, role_col, text_col)


def prefix_table(turns: DataFrame) -> DataFrame:
    """conv_id, depth, k1, k2 (the prefix's id), n_chars (of its last turn), n (turns) from (conv_id, pos, x, y, n_chars)."""
    whole = Window.partitionBy("conv_id")
    so_far = whole.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return turns.select("conv_id", F.col("pos").alias("depth"), F.bit_xor(F.xxhash64("pos", "x", "y")).over(so_far).alias("k1"),
                        F.bit_xor(F.xxhash64("y", "pos", "x")).over(so_far).alias("k2"), "n_chars", F.max("pos").over(whole).alias("n"))


def small(df: DataFrame) -> DataFrame:
    """``df`` (a few numbers a row), broadcast while its counted rows are under ``BROADCAST_HEADS``."""
    return F.broadcast(df) if df.count() <= BROADCAST_HEADS else df


def burst(prefixes: DataFrame, most: int) -> tuple[DataFrame | None, DataFrame | None]:
    """(heads: depth, k1, k2, n_convs, conv_id; deepest head of each conversation
    that has one: conv_id, n, cut, h1, h2, head_conv)."""
    heads, reached = [], []
    low, high, active = 0, 1, None
    while True:
        rows = prefixes.where((F.col("depth") > low) & (F.col("depth") <= high))
        if active is not None:
            rows = rows.join(active, "conv_id", "left_semi")
        over = rows.groupBy(*KEY).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("head_conv")).where(F.col("n_convs") > most)
        over = written(over, "heads")
        if over.isEmpty():
            break
        at = F.struct("depth", "k1", "k2", "head_conv")
        deepest = written(rows.join(small(over), KEY).groupBy("conv_id", "n").agg(F.max(at).alias("at"))
                          .select("conv_id", "n", F.col("at.depth").alias("cut"), F.col("at.k1").alias("h1"), F.col("at.k2").alias("h2"), "at.head_conv"), "reached")
        heads.append(over.withColumnRenamed("head_conv", "conv_id"))
        reached.append(deepest)
        active = deepest.where((F.col("cut") == high) & (F.col("n") > high)).select("conv_id")
        low, high = high, 2 * high + 1
    if not heads:
        return None, None
    all_heads, all_reached = heads[0], reached[0]
    for h, r in zip(heads[1:], reached[1:], strict=True):
        all_heads, all_reached = all_heads.unionByName(h), all_reached.unionByName(r)
    if len(reached) > 1:
        all_reached = all_reached.groupBy("conv_id", "n").agg(F.max(F.struct("cut", "h1", "h2", "head_conv")).alias("at")).select("conv_id", "n", "at.*")
    return all_heads, all_reached


class Sweep:
    """Sorted conversations in, closed nodes out: one open path at a time."""

    def __init__(self) -> None:
        self.path: list[list] = []  # open nodes: k1, k2, chars, depth, least member, members, children, leaves, saved, hash, closed children
        self.head: tuple = ()
        self.out: list[tuple] = []

    def close(self, left: int) -> None:
        while len(self.path) > left:
            _, _, chars, depth, first, n, children, leaves, saved, ends, below = self.path.pop()
            leaves = leaves or 1
            saved += (n - 1) * chars
            for b in below:
                self.out.append((*b[:2], first, *b[2:], False, None, None, None))
            node = (first, depth, n, children, leaves, saved, ends.hexdigest() if ends else EMPTY)
            if self.path:
                p = self.path[-1]
                p[4] = first if p[4] is None else min(p[4], first)
                p[5] += n
                p[6] += 1
                p[7] += leaves
                p[8] += saved
                p[10].append(node)
            else:
                cut, h1, h2, parent = self.head
                self.out.append((*node[:2], parent, *node[2:], True, cut, h1, h2))

    def add(self, conv: int, head: tuple, keys: list[tuple[int, int]], chars: list[int]) -> None:
        same = 0
        if head == self.head:
            most = min(len(keys), len(self.path))
            while same < most and (self.path[same][0], self.path[same][1]) == keys[same]:
                same += 1
        self.close(same)
        self.head = head
        for i in range(same, len(keys)):
            self.path.append([*keys[i], chars[i], head[0] + 1 + i, None, 0, 0, 0, 0, None, []])
        end = self.path[-1]
        end[4] = conv if end[4] is None else min(end[4], conv)
        end[5] += 1
        if end[9] is None:
            end[9] = hashlib.sha256(str(conv).encode())
        else:
            end[9].update(f",{conv}".encode())

    def take(self) -> list[tuple]:
        got, self.out = self.out, []
        return got


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state = Sweep()
    kinds = [pa.int64()] * 7 + [pa.string(), pa.bool_()] + [pa.int64()] * 3
    names = [c.split()[0] for c in SWEPT.split(", ")]

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for b in batches:
        conv, cut, h1, h2, parent, paths = (b.column(c) for c in ("conv_id", "cut", "h1", "h2", "head_conv", "path"))
        k1, k2, chars = (f.to_pylist() for f in paths.flatten().flatten())
        keys = list(zip(k1, k2, strict=True))
        ends = paths.value_lengths().to_numpy(zero_copy_only=False).cumsum().tolist()
        at = 0
        for c, head, end in zip(conv.to_pylist(), zip(cut.to_pylist(), h1.to_pylist(), h2.to_pylist(), parent.to_pylist(), strict=True), ends, strict=True):
            state.add(c, head, keys[at:end], chars[at:end])
            at = end
        rows = state.take()
        if rows:
            yield table(rows)
    state.close(0)
    rows = state.take()
    if rows:
        yield table(rows)


def write_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, k1, k2, conv_id) -> (depth, k1, k2, first, ids): pieces of up to ``PIECE`` bytes."""
    key, parts, size, first = None, [], 0, None

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (*key, first)] + [pa.array([",".join(parts)], pa.string())], names=[*KEY, "first", "ids"])

    for b in batches:
        for *k, conv in zip(*(b.column(c).to_pylist() for c in (*KEY, "conv_id")), strict=True):
            if k != key or size > PIECE:
                if parts:
                    yield piece()
                key, parts, size, first = k, [], 0, conv
            parts.append(str(conv))
            size += len(parts[-1]) + 1
    if parts:
        yield piece()


def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces -> (depth, k1, k2, ends_sha256)."""
    key, sha, out = None, None, []
    for b in batches:
        for *k, ids in zip(*(b.column(c).to_pylist() for c in (*KEY, "ids")), strict=True):
            if k != key:
                if key:
                    out.append((*key, sha.hexdigest()))
                key, sha = k, hashlib.sha256(ids.encode())
            else:
                sha.update(f",{ids}".encode())
    if key:
        out.append((*key, sha.hexdigest()))
    cols = list(zip(*out, strict=True)) or [[]] * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 3 + [pa.string()], strict=True)], names=[*KEY, "ends_sha256"])


def ends_at_heads(ends: DataFrame) -> DataFrame:
    """depth, k1, k2, ends_sha256 of the heads at which conversations (conv_id) end."""
    by = ["k1", "k2", "depth"]
    parts = ends.repartitionByRange(*by, "conv_id").sortWithinPartitions(*by, "conv_id").mapInArrow(
        write_down, "depth long, k1 long, k2 long, first long, ids string")
    return parts.repartition(*by).sortWithinPartitions(*by, "first").mapInArrow(digest, "depth long, k1 long, k2 long, ends_sha256 string")


def conversation_trie(turns: DataFrame, members: DataFrame | None = None, most: int = MOST) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id (the
    parent's conv_id), n_convs, n_children, n_leaves (childless nodes of its
    subtree), saved_tokens (over its subtree, members but one times the
    characters of the last turn), ends_sha256 (of the ascending ids of the
    conversations that end there, joined by commas).

    ``turns`` is a ``turn_table``; ``members`` (conv_id) names all conversations, also those without turns."""
    prefixes = written(prefix_table(turns), "prefixes")
    if members is None:
        members = prefixes.where("depth = 1").select("conv_id")
    else:
        members = written(members.where("conv_id is not null").select("conv_id").distinct(), "members")
    every = members.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    heads, reached = burst(prefixes, most)
    root_key = [F.lit(0).cast("long").alias(c) for c in ("cut", "h1", "h2")]

    least = F.lit(every.first()["conv_id"]).cast("long")
    if heads is None:
        rows = prefixes.select("*", *root_key, least.alias("head_conv"))
    else:
        rows = prefixes.join(reached.drop("n"), "conv_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("cut", "h1", "h2")} | {
            "head_conv": F.coalesce("head_conv", least)})
    rows = rows.where(F.col("depth") > F.col("cut"))
    path = F.transform(F.sort_array(F.collect_list(F.struct("depth", "k1", "k2", "n_chars"))), lambda t: F.struct(t["k1"], t["k2"], t["n_chars"]))
    paths = rows.groupBy("conv_id", "cut", "h1", "h2", "head_conv").agg(path.alias("path"))
    nodes = written(paths.repartition("cut", F.col("path")[0]["k1"], F.col("path")[0]["k2"]).sortWithinPartitions("cut", "path", "conv_id")
                    .mapInArrow(sweep, SWEPT), "nodes")

    ends = members.join(prefixes.where("depth = 1").select("conv_id"), "conv_id", "left_anti").select(
        "conv_id", *[F.lit(0).cast("long").alias(c) for c in KEY])
    if heads is not None:
        ends = ends.unionByName(reached.where("cut = n").select("conv_id", F.col("cut").alias("depth"), F.col("h1").alias("k1"), F.col("h2").alias("k2")))
    ends = written(ends_at_heads(written(ends, "ends")), "digests")
    direct = written(nodes.where("top").groupBy(F.col("cut").alias("depth"), F.col("h1").alias("k1"), F.col("h2").alias("k2")).agg(
        F.count("*").alias("tops"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")), "direct")

    zero = F.lit(0).cast("long")
    out = nodes.select(*NODE)
    root = every.where("n_convs > 0")
    sums = direct.where("depth = 0").select(*KEY, "tops", "leaves", "saved")
    if heads is not None:
        own, sub, parents = head_sums(heads, prefixes, direct)
        inner = heads.join(parents, KEY).join(sub, KEY).join(ends, KEY, "left").withColumns({
            "parent_conv_id": F.coalesce("parent_conv_id", least), "ends_sha256": F.coalesce("ends_sha256", F.lit(EMPTY))})
        out = out.unionByName(inner.select(*NODE))
        sums = sums.unionByName(own.select(*[zero.alias(c) for c in KEY], (F.col("depth") == 1).cast("long").alias("tops"), "leaves", "saved"))
    sums = sums.agg(F.sum("tops").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    # the root's parts, one row each, become one row
    parts = root.select("conv_id", "n_convs").unionByName(sums.select("n_children", "n_leaves", "saved_tokens"), allowMissingColumns=True).unionByName(
        ends.where("depth = 0").select("ends_sha256"), allowMissingColumns=True)
    top = parts.agg(*[F.max(c).alias(c) for c in parts.columns]).where("n_convs > 0").select(
        "conv_id", zero.alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", zero).alias("n_children"),
        F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved_tokens", zero).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
    return out.unionByName(top.select(*NODE))


def head_sums(heads: DataFrame, prefixes: DataFrame, direct: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of every head: (own: leaves and saved tokens of itself and the containers
    right under it; sub: n_children, n_leaves, saved_tokens of its subtree; parents: parent_conv_id)."""
    on_path = prefixes.select("conv_id", F.col("depth").alias("d"), F.col("k1").alias("a1"), F.col("k2").alias("a2"), "n_chars")
    path = written(on_path.join(small(heads), "conv_id").where("d <= depth"), "paths")  # a head's ancestors and itself
    up = [F.col("d").alias("depth"), F.col("a1").alias("k1"), F.col("a2").alias("k2")]
    under = path.where("d = depth - 1").groupBy(*up).agg(F.count("*").alias("heads_under"))
    own = path.where("d = depth").join(direct, KEY, "left").join(under, KEY, "left").select(
        *KEY, (F.coalesce("tops", F.lit(0)) + F.coalesce("heads_under", F.lit(0))).alias("n_children"), "leaves",
        (F.coalesce("saved", F.lit(0)) + (F.col("n_convs") - 1) * F.col("n_chars")).alias("saved"))
    own = written(own.withColumn("leaves", F.coalesce("leaves", F.lit(0)) + (F.col("n_children") == 0).cast("long")), "own")
    sub = path.join(own.select(*KEY, "leaves", "saved"), KEY).groupBy(*up).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    names = heads.select(F.col("depth").alias("d"), F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("conv_id").alias("parent_conv_id"))
    parents = path.where("d = depth - 1 or depth = 1").join(names, ["d", "a1", "a2"], "left").select(
        *KEY, F.when(F.col("depth") > 1, F.col("parent_conv_id")).alias("parent_conv_id"))
    return own, sub.join(own.select(*KEY, "n_children"), KEY), parents


def with_turns(nodes: DataFrame, conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
               text_col: str = "text") -> DataFrame:
    """``nodes`` of the trie of ``conversations`` with role and text of each node's last turn (root: null)."""
    turns = ordered(conversations, conv_col, turn_col, role_col, text_col, "role", "text")
    return nodes.join(turns.select("conv_id", F.col("pos").alias("depth"), "role", "text"), ["conv_id", "depth"], "left")
