"""Inverted lists of one corpus block, for exact lexical top-k with skipping.

A posting is (term, place of the listing, count or weight).  Listings that share terms
are placed side by side and cut into sub-blocks of ``SUB_BLOCK``; a term's list
is cut there too, so a term that every listing has (a stop word) is many short
pieces.  Each piece knows the largest weight (count / norm) of its term in it.

For a query the sum of its terms' largest weights bounds the cosine of every
listing of a sub-block.  The sub-blocks with the largest bounds are scored
first; their k-th best score is a threshold, and a sub-block whose bound is
below it holds no hit and is never scored.  Only postings of the query's own
terms are touched: no row of term counts exists on either side.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SUB_BLOCK = 256
FIRST_VISITS = 2
SLACK = 1e-9  # a bound is a float sum: this much above it is still its own


def flat(col: pa.ChunkedArray | pa.Array) -> tuple[int, np.ndarray, pa.Array, np.ndarray]:
    """(rows, row of each token, tokens, weight of each) of a list column of
    tokens, which weigh 1, or of a struct column <terms, weights>; null lists are empty."""
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    weights = None
    if pa.types.is_struct(arr.type):
        arr, weights = pc.struct_field(arr, "terms"), pc.struct_field(arr, "weights").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = pc.fill_null(pc.list_value_length(arr), 0).to_numpy(zero_copy_only=False)
    tokens = arr.flatten()
    return len(arr), np.repeat(np.arange(len(arr)), sizes), tokens, np.ones(len(tokens)) if weights is None else weights


def counted(rows: np.ndarray, tokens: pa.Array, weights: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(row, code, summed weight) by code, then row, and the codes' terms."""
    enc = pc.dictionary_encode(tokens)
    codes = enc.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    key, back = np.unique(codes * max(n, 1) + rows, return_inverse=True)
    return key % max(n, 1), key // max(n, 1), np.bincount(back, weights, len(key)), enc.dictionary


def expanded(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(range index of each element, element) of the ranges one after the other."""
    size = stop - start
    owner = np.repeat(np.arange(len(start)), size)
    return owner, np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + start[owner]


class Postings:
    def __init__(self, terms: pa.ChunkedArray | pa.Array, sub_block: int = SUB_BLOCK):
        n, rows, tokens, weights = flat(terms)
        row, code, count, self.terms = counted(rows, tokens, weights, n)
        self.n, self.sub_block = n, sub_block
        norm = np.sqrt(np.bincount(row, weights=count**2, minlength=n))
        self.row_at = self._neighbours(row, code, n)  # listing (row) at each place
        place = np.empty(n, np.int64)
        place[self.row_at] = np.arange(n)
        self.norm = norm[self.row_at]
        order = np.argsort(code * max(n, 1) + place[row])
        self.place, self.count, code = place[row][order], count[order], code[order]
        sub = self.place // sub_block
        self.subs = -(-n // sub_block)
        cut = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (sub[1:] != sub[:-1])]) if len(code) else np.zeros(0, np.int64)
        self.piece_sub, self.piece_start, self.piece_stop = sub[cut], cut, np.r_[cut[1:], len(code)].astype(np.int64)
        self.piece_most = np.maximum.reduceat(self.count / self.norm[self.place], cut) if len(cut) else np.zeros(0)
        self.first_piece = np.searchsorted(code[cut], np.arange(len(self.terms) + 1))

    @staticmethod
    def _neighbours(row: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
        """Rows ordered by their two rarest terms among those that split the
        block (neither in nearly all listings nor in hardly any)."""
        df = np.bincount(code) if len(code) else np.zeros(0, np.int64)
        use = np.flatnonzero((df[code] >= n / 64) & (df[code] <= n / 2))
        row, rare = row[use], df[code[use]] * max(len(df), 1) + code[use]
        order = np.lexsort((rare, row))
        row, rare = row[order], rare[order]
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
        sign = np.full((2, n), np.iinfo(np.int64).max)
        sign[0, row[first]] = rare[first]
        second = first[(first + 1 < len(row))]
        second = second[row[np.minimum(second + 1, max(len(row) - 1, 0))] == row[second]]
        sign[1, row[second]] = rare[second + 1]
        return np.lexsort((sign[1], sign[0]))

    def bounds(self, query: tuple) -> np.ndarray:
        """(queries, sub-blocks): no listing of the sub-block has a larger cosine."""
        q, seg, tf, qn = query
        b = np.bincount(q * self.subs + self.piece_sub[seg], weights=tf * self.piece_most[seg], minlength=len(qn) * self.subs)
        return b.reshape(len(qn), self.subs) / np.where(qn > 0, qn, 1.0)[:, None]

    def query(self, terms: pa.ChunkedArray | pa.Array) -> tuple:
        """(query, piece, count in the query) of the queries' terms, and the queries' norms."""
        nq, rows, tokens, weights = flat(terms)
        row, code, count, known = counted(rows, tokens, weights, nq)
        qn = np.sqrt(np.bincount(row, weights=count**2, minlength=nq))
        at = pc.fill_null(pc.index_in(known, value_set=self.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)[code]
        row, at, count = row[at >= 0], at[at >= 0], count[at >= 0]
        owner, seg = expanded(self.first_piece[at], self.first_piece[at + 1])
        return row[owner], seg, count[owner], qn

    def scores(self, query: tuple, visit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place, cosine) of the listings that share a term, in the sub-blocks to visit."""
        q, seg, tf, qn = query
        on = visit[q, self.piece_sub[seg]]
        q, seg, tf = q[on], seg[on], tf[on]
        owner, at = expanded(self.piece_start[seg], self.piece_stop[seg])
        dot = np.bincount(q[owner] * self.n + self.place[at], weights=tf[owner] * self.count[at], minlength=len(qn) * self.n)
        hit = np.flatnonzero(dot)
        row, place = np.divmod(hit, max(self.n, 1))
        return row, place, dot[hit] / (qn[row] * self.norm[place])

    def topk(self, terms: pa.ChunkedArray | pa.Array, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, cosine) that hold each query's first ``k`` by cosine (ties
        by row), in any order and with some more; and which sub-blocks were visited."""
        query = self.query(terms)
        nq = len(query[3])
        bound = self.bounds(query)
        first = min(self.subs, FIRST_VISITS + int(k.max(initial=0)) // self.sub_block)
        visit = np.zeros(bound.shape, bool)
        if first and nq:
            best = np.argpartition(-bound, first - 1, axis=1)[:, :first]
            visit[np.arange(nq)[:, None], best] = True
        visit &= bound > 0
        row, place, score = self.scores(query, visit)
        order = np.lexsort((-score, row))
        ranked = row[order]
        at = np.searchsorted(ranked, np.arange(nq)) + k - 1  # the k-th best so far
        has = at < np.searchsorted(ranked, np.arange(nq), side="right")
        least = np.zeros(nq)
        least[has] = score[order][at[has]]
        more = (bound > 0) & (bound * (1 + SLACK) >= least[:, None]) & ~visit
        if more.any():
            row2, place2, score2 = self.scores(query, more)
            row, place, score = np.r_[row, row2], np.r_[place, place2], np.r_[score, score2]
        keep = score >= least[row]
        return row[keep], self.row_at[place[keep]], score[keep], visit | more
