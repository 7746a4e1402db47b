"""Language-model scores from a sharded Elias-Fano n-gram trie.

Words and word pairs are counted exactly over all training documents: blocks
of documents send their distinct words and pairs with training counts to hash
shards (pairs by their context; the few contexts that hold a large share of a
planning sample are split by the following word).  A shard sums the counts and
builds its part of the trie - monotone pointers, context-relative successors,
8-bit quantised smoothed log probabilities, in a memory-mapped file - and
answers every word and pair that the blocks asked for, held-out ones included.
Blocks add up the documents' scores.  No task or driver holds the whole model.

Model (interpolated absolute discounting): P(w | v) = (c(vw) - D)/c(v) + B(v) P(w),
B(v) = (the sum of D over the pairs of v)/c(v), P(w) = (c(w) - DISCOUNT)/N, and the
mass DISCOUNT V/N for the unknown word; a context without training pairs gives
P(w).  D depends on min(c(vw), 3) and is fitted in each shard from how many of
its pairs were seen one to four times.  The trie stores P(w), the first term and
B(v).  A context dealt to several shards stores shares of its piece; the pieces'
sums, at most SPLIT for each of MOST_HOT + 1 contexts, reach every block.
Each distribution sums to one up to the quantisation (steps of 1/16 in log10).

Defined results: a null or empty text is its end alone, one token; without
training documents every known count is 0, both scores are 0; a null doc_id
counts as remainder of the empty text; repeated rows are learnt and scored
each; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abode.llm.common import U64, Blocks, answer, fold, mix64, pack, ranks, receive, send, split_by_shard, unpack, word_hash, words_col, written
from abode.llm.elias_fano import Trie

DISCOUNT = 0.5
BLOCK_BYTES = 10 << 20
PER_DECADE = 16
SPLIT = 16
HOT_SHARE = 0.002
MOST_HOT = 500
END = U64(0x5BD1E9955BD1E995)  # a text's end, and the context of a text's first token
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def small(x: np.ndarray) -> np.ndarray:
    """Counts in the narrowest unsigned type that holds them."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def code_of(p: np.ndarray) -> np.ndarray:
    """Quantised log10 of probabilities (0 is kept for 'none')."""
    return np.clip(np.rint(-np.log10(np.maximum(p, 1e-30)) * PER_DECADE) + 1, 1, 255).astype(np.uint8)


def value_of(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, np.power(10.0, (1 - code.astype(float)) / PER_DECADE), 0.0)


def discounts(counts: np.ndarray) -> np.ndarray:
    """What pairs seen 0, 1, 2, and 3 or more times lose, from how many pairs
    were seen one to four times; ``DISCOUNT`` where those say nothing."""
    n = np.bincount(np.minimum(counts, 5).astype(np.int64), minlength=6)[1:5].astype(float)
    out = np.array([0.0, DISCOUNT, DISCOUNT, DISCOUNT])
    if (n > 0).all():
        share = n[0] / (n[0] + 2 * n[1])
        fitted = np.arange(1, 4) - np.arange(2, 5) * share * n[1:] / n[:3]
        out[1:] = np.where((fitted > 0) & (fitted < np.arange(1, 4)), fitted, DISCOUNT)
    return out


def is_train(doc_id: int | None, mod: int, rest: int) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % mod != rest


def pair_ranks(context: np.ndarray, word: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """``ranks`` of the pairs of two ranks below ``kinds``; pairs and places
    that fit in 64 bits together are sorted as one number."""
    wide, long = U64(kinds.bit_length()), U64(len(word).bit_length())
    key = (context.astype(U64) << wide) | word.astype(U64)
    if 2 * wide + long > 64:
        return ranks(key)
    key = np.sort((key << long) | np.arange(len(key), dtype=U64))
    order, key = (key & ((U64(1) << long) - U64(1))).astype(np.int64), key >> long
    new = np.r_[True, key[1:] != key[:-1]][:len(key)]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(new) - 1
    return order[new], rank


class BlockGrams:
    """A block's tokens, distinct words and distinct pairs, dealt to shards."""

    def __init__(self, t: pa.Table, hot: np.ndarray, shards: int, mod: int, rest: int):
        cache, parts = word_hash(), []
        self.ids = t.column("doc_id").to_pylist()
        self.train = np.array([is_train(i, mod, rest) for i in self.ids], bool)
        for text in t.column("text"):
            text = text.as_py()
            parts.append(np.append(cache.many(text.encode("utf-8", "surrogatepass").lower().split() if text else []), END))
        self.n = np.array([len(p) for p in parts], np.int64)
        token = np.concatenate([*parts, np.zeros(0, U64)])
        weight = np.repeat(self.train, self.n).astype(float)
        first, self.word = ranks(token)
        self.words = token[first]
        self.word_count = np.bincount(self.word, weight, len(self.words)).astype(np.int64)
        before = np.roll(self.word, 1)  # a text starts after the end of another
        first, self.pair = pair_ranks(before, self.word, len(self.words))
        self.pair_count = np.bincount(self.pair, weight, len(first)).astype(np.int64)
        self.pair_context, self.pair_word = before[first], self.word[first]  # ranks in words; pairs ascend by both
        spread = mix64(self.words)
        self.word_shard = (spread % U64(shards)).astype(np.int64)
        extra = np.where(np.isin(self.words, hot)[self.pair_context], spread[self.pair_word] % U64(SPLIT) + U64(1), U64(0))
        self.pair_shard = (mix64(self.words[self.pair_context] + extra * U64(0x9E3779B97F4A7C15)) % U64(shards)).astype(np.int64)

    def dealt(self):
        """(shard, words' places, names' places, words' places in names, pairs' places, contexts' places in names);
        names are the shard's words and contexts."""
        words = dict(split_by_shard(self.word_shard))
        pairs = dict(split_by_shard(self.pair_shard))
        none, place = np.zeros(0, np.int64), np.empty(len(self.words), np.int64)
        for s in sorted(words.keys() | pairs.keys()):
            w, p = words.get(s, none), pairs.get(s, none)
            names = np.union1d(w, self.pair_context[p])
            place[names] = np.arange(len(names))
            yield s, w, names, place[w], p, place[self.pair_context[p]]

    def ask(self):
        for s, w, names, at, p, context in self.dealt():
            count = np.zeros(len(names), np.int64)
            count[at] = self.word_count[w]
            follow = np.bincount(context, minlength=len(names))
            six = short(self.words[self.pair_word[p]]).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            yield s, pack(names=self.words[names], count=small(count), follow=small(follow), six=np.ascontiguousarray(six), pairs=small(self.pair_count[p]))


def short(word: np.ndarray) -> np.ndarray:
    """48 bits of a word's hash: what a following word is called within its context."""
    return mix64(word) & U64((1 << 48) - 1)


def build_and_answer(shard: int, ids: list[int], data: list[bytes], train_tokens: int, hot: np.ndarray):
    """Sum the counts, build the shard's trie and look up what was asked; then
    (block -1) its number of words and (block -2) the sums of its pieces of hot contexts."""
    got = [unpack(d) for d in data]
    names, name = np.unique(np.concatenate([g["names"] for g in got]), return_inverse=True)
    count = np.bincount(name, np.concatenate([g["count"] for g in got]).astype(float), len(names)).astype(np.int64)
    six = []
    for g in got:
        wide = np.zeros((len(g["six"]) // 6, 8), np.uint8)
        wide[:, :6] = g["six"].reshape(-1, 6)
        six.append(wide.view("<u8").ravel())
    follower, context = np.concatenate(six), np.repeat(name, np.concatenate([g["follow"] for g in got]))
    seen = np.concatenate([g["pairs"] for g in got]).astype(float)
    vocabulary, word = np.unique(follower, return_inverse=True)
    key, back = np.unique(context.astype(U64) * U64(max(len(vocabulary), 1)) + word.astype(U64), return_inverse=True)
    total = np.bincount(back, seen, len(key))
    kept = total > 0
    c, w = np.divmod(key[kept], U64(max(len(vocabulary), 1)))
    c, total = c.astype(np.int64), total[kept]
    loss = discounts(total)[np.minimum(total, 3).astype(np.int64)]
    mass, back_off = np.bincount(c, total, len(names)), np.bincount(c, loss, len(names))
    single = np.where(count > 0, code_of((count - DISCOUNT) / max(train_tokens, 1)), 0).astype(np.uint8)
    left = np.where(mass > 0, code_of(back_off / np.maximum(mass, 1)), 0).astype(np.uint8)
    trie = Trie(names, single, left, c, w, code_of((total - loss) / mass[c]), vocabulary)
    for b, g, f in zip(ids, got, six, strict=True):
        rank = trie.words.find(g["names"])
        codes = trie.context_codes(rank, g["follow"], f)
        yield b, pack(count=small(count[rank]), word=trie.word_codes[rank], left=trie.left_codes[rank], pair=codes)
    yield -1, int((count > 0).sum()).to_bytes(8, "big")
    split = np.flatnonzero(np.isin(names, hot) & (mass > 0))
    if len(split):
        yield -2, pack(names=names[split], mass=mass[split], left=back_off[split])


class HotContexts:
    """Sums of the contexts that are dealt to several shards, whole and by shard."""

    def __init__(self, pieces: list):
        got = [(r["shard"], unpack(bytes(r["data"]))) for r in pieces]
        names = np.concatenate([g["names"] for _, g in got]) if got else np.zeros(0, U64)
        self.names, at = np.unique(names, return_inverse=True)
        self.mass, self.left = (np.bincount(at, np.concatenate([g[k] for _, g in got]), len(self.names)) if got else np.zeros(0) for k in ("mass", "left"))
        self.pieces = {s: (g["names"], g["mass"]) for s, g in got}

    def scale(self, shard: int, context: np.ndarray, pair: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A shard's pair probabilities and back-off masses, those of hot contexts for the whole context."""
        at = np.minimum(np.searchsorted(self.names, context), max(len(self.names) - 1, 0))
        hot = np.flatnonzero(self.names[at] == context) if len(self.names) else np.zeros(0, np.int64)
        if len(hot):
            whole = at[hot]
            names, mass = self.pieces.get(shard, (np.zeros(0, U64), np.zeros(0)))
            piece = np.zeros(len(self.names))
            piece[np.searchsorted(self.names, names)] = mass
            pair[hot] *= piece[whole] / self.mass[whole]
            left[hot] = self.left[whole] / self.mass[whole]
        return pair, left


def hot_contexts(docs: DataFrame) -> np.ndarray:
    """Hashes of words that hold more than ``HOT_SHARE`` of a planning sample
    (documents by hash); at most ``MOST_HOT``.  Only the dealing to shards
    depends on them, no result does."""
    few = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("plan")), F.lit(64)) == 0)
    words = few.select(F.explode_outer(words_col(F.translate("text", UPPER, LOWER))).alias("w"))
    counts = written(words.groupBy("w").agg(F.count("*").alias("n")), "plan")
    total = counts.agg(F.sum("n").alias("n")).first()["n"] or 0
    rows = counts.where((F.col("n") > HOT_SHARE * total) & F.col("w").isNotNull()).orderBy(F.desc("n"), "w").limit(MOST_HOT).collect()
    return np.array([xxhash.xxh3_64_intdigest(r["w"].encode()) for r in rows] + [int(END)], U64)


def score_documents(docs: DataFrame, held_mod: int = 7, held_rest: int = 2, block_bytes: int = BLOCK_BYTES,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for
    each row of ``docs``; rows whose crc32 of the id modulo ``held_mod`` is
    ``held_rest`` aren't learnt from."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tokens = F.size(words_col(F.col("text"))) + 1
    plan = src.agg(F.sum(F.octet_length("text")).alias("b"),
                   F.sum(F.when(fold(F.col("doc_id"), held_mod) != held_rest, tokens).cast("long")).alias("n")).first()
    train_tokens, hot = int(plan["n"] or 0), hot_contexts(src)
    blocks = Blocks(src, "lm", block_bytes, total=int(plan["b"] or 0))
    shards = blocks.n

    def ask(t: pa.Table):
        yield from BlockGrams(t, hot, shards, held_mod, held_rest).ask()

    def reply(shard: int, ids: list[int], data: list[bytes]):
        return build_and_answer(shard, ids, data, train_tokens, hot)

    answers = written(answer(send(blocks, ask), reply), "ngrams")
    kinds = int(answers.where("block = -1").agg(F.sum(F.conv(F.hex("data"), 16, 10).cast("long")).alias("v")).first()["v"] or 0)
    pieces = HotContexts(answers.where("block = -2").select("shard", "data").collect())  # at most (MOST_HOT + 1) * SPLIT contexts' pieces

    def score(block: int, t: pa.Table, ans: pa.Table) -> pa.Table:
        g = BlockGrams(t, hot, shards, held_mod, held_rest)
        got = dict(zip(ans.column("shard").to_pylist(), ans.column("data").to_pylist(), strict=True))
        count, word = np.zeros(len(g.words), np.int64), np.zeros(len(g.words), np.uint8)
        pair, left = np.zeros(len(g.pair_count)), np.zeros(len(g.pair_count))
        for s, w, _, at, p, context in g.dealt():
            a = unpack(got[s])
            count[w], word[w] = a["count"][at], a["word"][at]
            pair[p], left[p] = pieces.scale(s, g.words[g.pair_context[p]], value_of(a["pair"]), value_of(a["left"])[context])
        n = max(train_tokens, 1)
        known = count > 0
        single = np.where(known, value_of(word), (DISCOUNT * kinds if kinds else n) / n)
        base = np.log10((count + 1) / (train_tokens + kinds + 1))
        one = single[g.pair_word]
        p = np.log10(np.where(left > 0, np.minimum(pair + left * one, 1.0), one))
        starts = np.r_[0, np.cumsum(g.n)[:-1]].astype(np.int64)
        add = lambda x: np.add.reduceat(x, starts) if len(starts) else np.zeros(0)  # noqa: E731  every document has an end, so no group is empty
        return pa.table({"doc_id": pa.array(g.ids, pa.int64()), "held_out": pa.array(~g.train), "n_tokens": pa.array(g.n),
                         "n_known": pa.array(add(known.astype(np.int64)[g.word]).astype(np.int64)), "train_tokens": pa.array(np.full(len(g.n), train_tokens)),
                         "base_score": pa.array(add(base[g.word]).astype(float)), "score": pa.array(add(p[g.pair]).astype(float))})

    return receive(blocks, answers.where("block >= 0"), score, SCHEMA)
