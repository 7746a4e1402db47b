"""Substring dedup on a de Bruijn graph of words.

Every 13 consecutive words are an edge from their first 12 words to their last
12.  An edge's source is its occurrence in the document with the smallest id.
A walk of repeated edges is nonbranching as long as each edge's source is the
word after the source of the edge before; such paths compact into spans
(document, start, length, source document, source start).

1. Anchors.  The least hash among a window's 5-word runs is its anchor; equal
   windows have equal anchors.  Blocks send their distinct anchors to hash
   shards; anchors seen in one document only rule out their windows.
2. Edges.  Blocks send their remaining distinct edges, each with its first
   coordinate, to the shard of their anchor, so that runs of edges stay
   together; the shard answers with the source of each edge that has one
   before the block's own.
3. Blocks join the answers and compact their documents' repeated edges into
   spans, with a digest of each span's words.
4. Spans join their source's block, which compares the digest with the words
   at the source coordinates; a span that differs (a hash collision) is out.
5. Blocks cover the words of the verified spans and keep the rest.

Blocks are pre-aggregated, so that a passage or a copy in a third of all
documents reaches its shard once per block.

Defined results: null or empty texts have no words; texts of fewer words than
a window lose none; rows that share a doc_id don't count as repeats of each
other; rows with a null doc_id neither lose words nor are sources; repeated
rows get a row each; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abode.llm.common import (PIECES, U64, Blocks, answer, groups, pack, pieces, receive, send, split_by_shard, unpack, window_hash,
                              word_hash, words_of, written)

WINDOW = 13
ANCHOR = 5
BLOCK_BYTES = 8 << 20
HASH_WORDS = 1 << 15  # words hashed at a time
SPANS = ("block int, idx int, start int, words int, src_block int, src_idx int, src_start int, digest binary")


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Least value of every ``w`` consecutive ones, by doubling."""
    have = 1
    while have < w:
        step = min(have, w - have)
        h = np.minimum(h[:-step], h[step:])
        have += step
    return h


def block_edges(t: pa.Table, k: int) -> tuple[np.ndarray, ...]:
    """(edge, anchor, row, start, doc_id) of all windows of a block's rows with
    an id, in order of row and start.  Texts are hashed some at a time, end to
    end, and windows across two texts are left out."""
    ids, cache, short = t.column("doc_id").to_pylist(), word_hash(), min(ANCHOR, k)
    out: list[tuple[np.ndarray, ...]] = []

    def flush(rows: list[int], sizes: list[int], words: list[bytes]) -> None:
        h = cache.many(words)
        edge = window_hash(h, k, 31)
        anchor = sliding_min(window_hash(h, short, 32), k - short + 1)
        n = np.array(sizes) - (k - 1)
        begin = np.cumsum(sizes) - sizes
        at = np.repeat(begin, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        out.append((edge[at], anchor[at], np.repeat(np.array(rows, np.int32), n), (at - np.repeat(begin, n)).astype(np.int32),
                    np.repeat(np.array([ids[i] for i in rows], np.int64), n)))

    rows: list[int] = []
    sizes: list[int] = []
    words: list[bytes] = []
    for i, text in enumerate(t.column("text")):
        w = words_of(text.as_py()) if ids[i] is not None else []
        if len(w) >= k:
            rows.append(i)
            sizes.append(len(w))
            words += w
        if len(words) > HASH_WORDS:
            flush(rows, sizes, words)
            rows, sizes, words = [], [], []
    if rows:
        flush(rows, sizes, words)
    if not out:
        return np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def distinct_anchors(anchor: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct anchors, whether two rows have it)."""
    order, first = groups(anchor)
    if not len(order):
        return anchor, np.zeros(0, bool)
    r = row[order]
    return anchor[order[first]], np.minimum.reduceat(r, first) != np.maximum.reduceat(r, first)


def deltas(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def substring_spans(blocks: Blocks, k: int = WINDOW) -> DataFrame:
    """Verified spans (block, idx, start, words, source): the words of ``words``
    from ``start`` in row ``idx`` of ``block`` all lie in windows that start in
    a document with a smaller id."""
    n = blocks.n

    def ask_anchors(t: pa.Table):
        _, anchor, row, _, _ = block_edges(t, k)
        a, many = distinct_anchors(anchor, row)
        for s, at in split_by_shard((a % U64(n)).astype(np.int64)):
            yield s, pack(a=a[at], many=np.packbits(many[at]))

    def tell_anchors(shard: int, ids: list[int], data: list[bytes]):
        got = [unpack(d) for d in data]
        flat = np.concatenate([g["a"] for g in got])
        many = np.concatenate([np.unpackbits(g["many"])[:len(g["a"])] for g in got]).astype(bool)
        values, back, count = np.unique(flat, return_inverse=True, return_counts=True)
        often = count > 1
        often[back[many]] = True
        cut = np.r_[0, np.cumsum([len(g["a"]) for g in got])]
        for i, b in enumerate(ids):
            keep = often[back[cut[i]:cut[i + 1]]]
            if keep.any():
                yield b, pack(bits=np.packbits(keep))

    def ask_edges(block: int, t: pa.Table, ans: pa.Table) -> pa.Table:
        if not ans.num_rows or not t.num_rows:
            return pieces(block, [])
        edge, anchor, row, start, doc = block_edges(t, k)
        a, _ = distinct_anchors(anchor, row)
        bits = dict(zip(ans.column("shard").to_pylist(), ans.column("data").to_pylist(), strict=True))
        often = np.zeros(len(a), bool)
        for s, at in split_by_shard((a % U64(n)).astype(np.int64)):
            if s in bits:
                often[at] = np.unpackbits(unpack(bits[s])["bits"])[:len(at)].astype(bool)
        at = np.flatnonzero(often[np.searchsorted(a, anchor)])
        # the first occurrence of each edge: rows of a block ascend by id
        order, first = groups(edge[at])
        at = at[np.sort(np.minimum.reduceat(order, first))] if len(at) else at
        return pieces(block, [(s, pack(e=edge[at[x]], row=deltas(row[at[x]]), start=deltas(start[at[x]]), doc=deltas(doc[at[x]])))
                              for s, x in split_by_shard((anchor[at] % U64(n)).astype(np.int64))])

    def tell_edges(shard: int, ids: list[int], data: list[bytes]):
        got = [unpack(d) for d in data]
        size = [len(g["e"]) for g in got]
        edge = np.concatenate([g["e"] for g in got])
        row, start, doc = (np.concatenate([np.cumsum(g[c], dtype=g[c].dtype) for g in got]) for c in ("row", "start", "doc"))
        block = np.repeat(np.array(ids, np.int32), size)
        order, first = groups(edge)
        # each edge's least document, and there its first occurrence: blocks and their rows are in order
        size_of = np.diff(np.r_[first, len(order)])
        least = np.repeat(np.minimum.reduceat(doc[order], first), size_of)
        origin = np.minimum.reduceat(np.where(doc[order] == least, order, len(order)), first)
        source = np.empty(len(order), np.int64)
        source[order] = np.repeat(origin, size_of)
        told = doc[source] < doc
        cut = np.r_[0, np.cumsum(size)]
        for i, b in enumerate(ids):
            at = cut[i] + np.flatnonzero(told[cut[i]:cut[i + 1]])
            if len(at):
                src = source[at]
                yield b, pack(e=edge[at], doc=deltas(doc[src]), block=deltas(block[src]), row=deltas(row[src]), start=deltas(start[src]))

    def compact(block: int, t: pa.Table, ans: pa.Table) -> pa.Table:
        edge, _, row, start, doc = block_edges(t, k)
        if not len(edge):
            return spans_table(block, [], [], [], [], [], [], [])
        order, first = groups(edge)
        own = np.minimum.reduceat(order, first)  # rows ascend by id, so the first is the block's own source
        known = edge[own]
        s_doc, s_block, s_row, s_start = doc[own], np.full(len(own), block, np.int32), row[own], start[own]
        for data in ans.column("data").to_pylist():
            g = unpack(data)
            at = np.searchsorted(known, g["e"])
            s_doc[at], s_block[at], s_row[at], s_start[at] = (np.cumsum(g[c], dtype=g[c].dtype) for c in ("doc", "block", "row", "start"))
        kind = np.empty(len(order), np.int64)
        kind[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(order)]))
        gone = np.flatnonzero(s_doc[kind] < doc)
        if not len(gone):
            return spans_table(block, [], [], [], [], [], [], [])
        q = kind[gone]
        on = (np.diff(row[gone]) == 0) & (np.diff(start[gone]) == 1) & (np.diff(s_block[q]) == 0) & (np.diff(s_row[q]) == 0) & (np.diff(s_start[q]) == 1)
        a = np.flatnonzero(np.r_[True, ~on])
        size = np.diff(np.r_[a, len(gone)]) + k - 1
        texts, digests, last, words = t.column("text"), [], -1, []
        for r, s, m in zip(row[gone[a]], start[gone[a]], size, strict=True):
            if r != last:
                last, words = r, words_of(texts[int(r)].as_py())
            digests.append(xxhash.xxh3_128_digest(b" ".join(words[s:s + m])))
        return spans_table(block, row[gone[a]], start[gone[a]], size, s_block[q[a]], s_row[q[a]], s_start[q[a]], digests)

    anchors = written(answer(send(blocks, ask_anchors), tell_anchors), "anchors")
    known = written(answer(receive(blocks, anchors, ask_edges, PIECES), tell_edges), "edges")
    spans = written(receive(blocks, known, compact, SPANS), "spans")

    def differ(block: int, t: pa.Table, want: pa.Table) -> pa.Table:
        """The wanted spans whose words at the source aren't those of the digest."""
        rows = sorted(zip(*(want.column(c).to_pylist() for c in ("src_idx", "src_start", "words", "digest")), strict=True))
        last, words, bad = -1, [], []
        for r, s, m, d in rows:
            if r != last:
                last, words = r, words_of(t.column("text")[r].as_py())
            if xxhash.xxh3_128_digest(b" ".join(words[s:s + m])) != d:
                bad.append((r, s, m, d))
        cols = list(zip(*bad, strict=True)) or [[], [], [], []]
        return pa.table({"src_block": pa.array([block] * len(bad), pa.int32()), "src_idx": pa.array(cols[0], pa.int32()),
                         "src_start": pa.array(cols[1], pa.int32()), "words": pa.array(cols[2], pa.int32()), "digest": pa.array(cols[3], pa.binary())})

    source = ["src_block", "src_idx", "src_start", "words", "digest"]
    wanted = spans.select(*source).distinct().withColumnRenamed("src_block", "block")
    bad = written(receive(blocks, wanted, differ, "src_block int, src_idx int, src_start int, words int, digest binary"), "differing")
    return spans.join(bad, source, "left_anti")


def spans_table(block, idx, start, words, src_block, src_idx, src_start, digest) -> pa.Table:
    ints = {"idx": idx, "start": start, "words": words, "src_block": src_block, "src_idx": src_idx, "src_start": src_start}
    return pa.table({"block": pa.array([block] * len(idx), pa.int32()),
                     **{c: pa.array(np.asarray(v, np.int32)) for c, v in ints.items()}, "digest": pa.array(digest, pa.binary())})


def substring_dedup(docs: DataFrame, k: int = WINDOW, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id", text_col: str = "text",
                    rest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, removed (start, end of each cut, in words),
    kept_text (the kept words joined by one space) for each row of ``docs``;
    with ``rest`` also the row's other columns as a struct, and kept_text is
    the text as it was where no word is cut."""
    blocks = Blocks(docs, "substr", block_bytes, id_col, text_col, rest=rest)
    spans = substring_spans(blocks, k).select("block", "idx", "start", "words")
    schema = "doc_id long, n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept_text string"
    if rest:
        schema += ", rest " + dict(blocks.df.dtypes)["rest"]
    cut = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def keep(block: int, t: pa.Table, ans: pa.Table) -> pa.Table:
        gone: dict[int, list[tuple[int, int]]] = {}
        for r, s, m in zip(*(ans.column(c).to_pylist() for c in ("idx", "start", "words")), strict=True):
            gone.setdefault(r, []).append((s, s + m))
        n_words, n_removed, removed, kept = [], [], [], []
        for i, text in enumerate(t.column("text")):
            words = words_of(text.as_py())
            cuts: list[list[int]] = []
            for a, b in sorted(gone.get(i, ())):
                if cuts and a <= cuts[-1][1]:
                    cuts[-1][1] = max(cuts[-1][1], b)
                else:
                    cuts.append([a, b])
            n_words.append(len(words))
            n_removed.append(sum(b - a for a, b in cuts))
            removed.append([{"start": a, "end": b} for a, b in cuts])
            for a, b in reversed(cuts):
                del words[a:b]
            kept.append(text.as_py() if rest and not cuts else b" ".join(words).decode("utf-8", "surrogatepass"))
        out = {"doc_id": t.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()),
               "removed": pa.array(removed, cut), "kept_text": pa.array(kept, pa.string())}
        return pa.table(out | ({"rest": t.column("rest")} if rest else {}))

    return receive(blocks, spans, keep, schema)
