"""Periodic runs of words, by an enhanced suffix array.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q``
apart are equal), at least ``max(MIN_LENGTH, 2q)`` long, that no neighbouring
word extends.

1. Texts of a batch are laid end to end.  Suffixes are sorted by prefix
   doubling over (document, word); groups of one suffix drop out, so the work
   of a round is what still repeats.  A run holds two equal stretches of
   ``MIN_LENGTH / 2`` words, so documents where no such stretch occurs twice have
   none and leave after the first rounds.
2. Neighbouring suffixes' common prefixes (LCP) come from the rounds' ranks.
   Each LCP interval of depth ``d`` is split into its children.  For every
   suffix ``i`` of all children but the largest the inverse array says whether
   ``i + d`` or ``i - d`` lies in the interval, in another child: then a square of
   period ``d`` branches there.  No tree nodes are built.
3. A branching square is the last of its run: it is rotated left as far as the
   words stay equal.  Squares with the same ends are one run with the smallest
   of their periods.

Documents are independent: one Arrow pass, no shuffle.  Batches are cut by bytes;
a text is one object in its task and takes about 100 times its size there if it
repeats itself, a tenth of that if not.

Defined results: null or empty texts have no words and no runs; a text's words
are whole and unchanged; repeated rows get the same answer each; null ids are
kept; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from abode.llm.common import bounded_batches, words_of
from abode.llm.token_counts import slices

MIN_LENGTH = 12
SLICE_BYTES = 4 << 20


class Codes(dict):
    """word -> number, in the order of first use."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def by_two(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Order by ``a``, then ``b`` (0 to ``most`` - 1), as one key while that fits 64 bits."""
    if most * (int(a.max(initial=0)) + 1) < 2**63:
        return np.argsort(a * most + b)
    return np.lexsort((b, a))


def refine(act: np.ndarray, rank: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Sorts the suffixes ``act`` (grouped by rank) by ``second`` within their groups and
    gives them the ranks of the finer groups; returns those in groups of two or more."""
    old = rank[act]
    order = by_two(old, second + 1, len(rank) + 1)
    act, old, second = act[order], old[order], second[order]
    place = np.arange(len(act))
    new_old = np.r_[True, old[1:] != old[:-1]]
    new = new_old | np.r_[True, second[1:] != second[:-1]]
    start_old = np.maximum.accumulate(np.where(new_old, place, 0))
    start = np.maximum.accumulate(np.where(new, place, 0))
    rank[act] = old + start - start_old
    many = ~(new & np.r_[new[1:], True])
    return act[many]


def doubled(act: np.ndarray, rank: np.ndarray, end: np.ndarray, h: int) -> np.ndarray:
    """Suffixes ``act`` sorted by twice ``h`` words."""
    after = act + h
    inside = after < end[act]
    return refine(act, rank, np.where(inside, rank[np.where(inside, after, 0)], -1))


def suffix_ranks(code: np.ndarray, begin: np.ndarray, end: np.ndarray, least: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(positions, ranks by 1, 2, 4, ... words) of the documents where a stretch of
    ``least`` words occurs twice, laid end to end; the last ranks are all different."""
    n = len(code)
    rank = begin.astype(np.int64)  # all words of a document are one group, in its place
    act = refine(np.arange(n), rank, code)
    first = [rank.copy()]
    h = 1
    while 2 * h <= least and len(act):
        act = doubled(act, rank, end, h)
        h *= 2
        first.append(rank.copy())
    act = act[act + least <= end[act]]
    if len(act):  # twice the same words: overlapping halves
        a, b = rank[act], rank[act + least - h]
        order = by_two(a, b, n)
        a, b = a[order], b[order]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        act = act[order[1:][same]]
    keep = np.zeros(n + 1, bool)
    keep[begin[act]] = True
    at = np.flatnonzero(keep[begin])
    if not len(at):
        return at, []
    place = np.zeros(n, np.int64)
    place[at] = np.arange(len(at))
    shift = (at - place[at])  # documents move as a whole, ranks (places in the order) with them
    levels = [r[at] - shift for r in first]
    end = end[at] - shift
    rank = levels[-1].copy()
    order = np.argsort(rank, kind="stable")
    r = rank[order]
    single = np.r_[True, r[1:] != r[:-1]] & np.r_[r[1:] != r[:-1], True]
    act = order[~single]
    while len(act):
        act = doubled(act, rank, end, h)
        h *= 2
        levels.append(rank.copy())
    return at, levels


def neighbour_lcp(sa: np.ndarray, doc: np.ndarray, end: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the order; 0 for the
    first and between documents."""
    lcp = np.zeros(len(sa) + 1, np.int64)
    at = np.flatnonzero(doc[sa[1:]] == doc[sa[:-1]]) + 1
    a, b = sa[at - 1], sa[at]
    end_a = end[a]
    got = np.zeros(len(at), np.int64)
    for k in range(len(levels) - 2, -1, -1):
        x, y = a + got, b + got
        ok = (x < end_a) & (y < end_a)
        same = ok.copy()
        same[ok] = levels[k][x[ok]] == levels[k][y[ok]]
        got[same] += 1 << k
    lcp[at] = got
    return lcp


def interval_bounds(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every place with a positive LCP the first and last suffix (in the order)
    of the interval with that depth."""
    values = lcp.tolist()
    left, right = [0] * len(values), [0] * len(values)
    stack: list[int] = []
    for p, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            right[stack.pop()] = p - 1
        left[p] = 0 if not v else (stack[-1] if values[stack[-1]] < v else left[stack[-1]])
        if not v:
            stack.clear()
        stack.append(p)
    return np.array(left), np.array(right)


def branching_squares(sa: np.ndarray, isa: np.ndarray, lcp: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of every branching square."""
    left, right = interval_bounds(lcp)
    at = np.flatnonzero(lcp > 0)
    if not len(at):
        return at, at
    at = at[np.lexsort((at, right[at], left[at]))]  # by interval, then by place
    l, r = left[at], right[at]
    new = np.r_[True, (l[1:] != l[:-1]) | (r[1:] != r[:-1])]
    heads = np.flatnonzero(new)
    last = np.r_[new[1:], True]
    # children: from the interval's first suffix or a place, up to the next place
    low = np.r_[at, l[heads]]
    high = np.r_[np.where(last, r, np.r_[at[1:], 0] - 1), at[heads] - 1]
    first, stop, depth = np.r_[l, l[heads]], np.r_[r, r[heads]], np.r_[lcp[at], lcp[at[heads]]]
    size = high - low + 1
    order = np.lexsort((-size, stop, first))
    largest = np.r_[True, (first[order][1:] != first[order][:-1]) | (stop[order][1:] != stop[order][:-1])]
    small = order[~largest]
    count = size[small]
    total = int(count.sum())
    inside = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
    i = sa[np.repeat(low[small], count) + inside]
    low, high, first, stop, depth = (np.repeat(x[small], count) for x in (low, high, first, stop, depth))

    def meets(j: np.ndarray, ok: np.ndarray) -> np.ndarray:
        k = isa[np.where(ok, j, 0)]
        return ok & (k >= first) & (k <= stop) & ((k < low) | (k > high))

    ahead, back = meets(i + depth, i + depth < end[i]), meets(i - depth, i - depth >= begin[i])
    return np.r_[i[ahead], i[back] - depth[back]], np.r_[depth[ahead], depth[back]]


def runs_of(code: np.ndarray, sizes: list[int], min_length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs of texts laid end to end, by start, then period."""
    sizes_ = np.asarray(sizes, np.int64)
    stops = np.cumsum(sizes_)
    begin, end = np.repeat(stops - sizes_, sizes_), np.repeat(stops, sizes_)
    none = np.zeros(0, np.int64)
    if len(code) == 0:
        return none, none, none
    at, levels = suffix_ranks(code, begin, end, max(1, min_length // 2))
    if not len(at):
        return none, none, none
    shift = at - np.arange(len(at))
    begin, end = begin[at] - shift, end[at] - shift
    isa = levels[-1]
    sa = np.empty(len(isa), np.int64)
    sa[isa] = np.arange(len(isa))
    lcp = neighbour_lcp(sa, begin, end, levels)
    start, period = branching_squares(sa, isa, lcp, begin, end)
    stop = start + 2 * period
    # rotate left: words before the square that equal those a period later
    first = begin[start] if len(start) else start
    for k in range(len(levels) - 2, -1, -1):
        x = start - (1 << k)
        ok = x >= first
        same = ok.copy()
        same[ok] = levels[k][x[ok]] == levels[k][x[ok] + period[ok]]
        start = np.where(same, x, start)
    length = stop - start
    long = length >= np.maximum(min_length, 2 * period)
    start, length, period = start[long], length[long], period[long]
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    once = np.r_[True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])] if len(start) else np.zeros(0, bool)
    start, length, period = start[once], length[once], period[once]
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    return start + (shift[start] if len(start) else 0), length, period


def collapse(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> list[bytes]:
    """The words without those that some run contains after its first period."""
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, start + period, 1)
    np.add.at(step, start + length, -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]


def text_runs(texts: list[str | None], min_length: int = MIN_LENGTH) -> list[tuple[int, list[tuple[int, int, int]], str]]:
    """(words, runs, text without repeated periods) of every text."""
    words = [words_of(t) for t in texts]
    sizes = [len(w) for w in words]
    codes = Codes()
    code = np.fromiter(map(codes.__getitem__, chain.from_iterable(words)), np.int64, sum(sizes))
    start, length, period = runs_of(code, sizes, min_length)
    base = np.cumsum([0, *sizes])
    cut = np.searchsorted(start, base)
    out = []
    for k, w in enumerate(words):
        a, b = cut[k], cut[k + 1]
        s, n, q = start[a:b] - base[k], length[a:b], period[a:b]
        kept = collapse(w, s, n, q) if a < b else w
        out.append((len(w), list(zip(s.tolist(), n.tolist(), q.tolist(), strict=True)), b" ".join(kept).decode("utf-8", "replace")))
    return out


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, by start, then period),
    collapsed_text (one space between words) of every row of ``docs``."""
    bounded_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1)
            for i, j in slices([len(t.as_buffer()) if t.is_valid else 0 for t in texts], SLICE_BYTES):
                got = text_runs(texts.slice(i, j - i).to_pylist(), min_length)
                runs = pa.array([[{"start": s, "length": n, "period": q} for s, n, q in g[1]] for g in got], run_type)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([g[0] for g in got], pa.int64()), runs,
                                                  pa.array([g[2] for g in got], pa.string())], names=["doc_id", "n_words", "runs", "collapsed_text"])

    schema = T.StructType([src.schema["doc_id"], T.StructField("n_words", T.LongType()),
                           T.StructField("runs", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))),
                           T.StructField("collapsed_text", T.StringType())])
    return src.mapInArrow(run, schema)
