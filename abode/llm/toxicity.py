"""Toxicity by noisy-channel deobfuscation.

1. A character language model (trigrams over letter classes) is counted over
   all texts; its table has a fixed size.  The lexicon - words and word
   beginnings with their log-odds in toxic texts - comes from a bounded sample
   of labelled rows (``SAMPLE_ROWS``): terms of ``MIN_TOXIC`` toxic texts or more.
2. A token with digits, signs or repeats among its letters, or letters in a run
   of groups of one or two (with or without punctuation; the run may hold
   several words and other letters), is a noisy observation of a word: each sign is a lattice
   position whose candidates are letters (leetspeak), nothing (spacing and
   masks) or fewer copies (repetition).  Viterbi over letter pairs finds the
   likeliest word under an equal mixture of the corpus model and the model of
   the lexicon's words.
3. A text's raw score is the sum of its three largest term weights after
   restoring; an isotonic curve over held-apart labelled rows turns it into a
   probability.

Defined results: null and empty texts have raw score 0 and the lowest
probability; without usable labels every score is 0; null labels are ignored;
repeated rows are scored each; a null doc_id is kept; an empty table gives an
empty table.
"""

from __future__ import annotations

import heapq
import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from abode.llm.common import bounded_batches, fold, others, worker_state, written
from abode.llm.isotonic import calibrated, calibration

SAMPLE_ROWS = 20_000
MIN_TOXIC = 3
MIN_WEIGHT = 2.0
STARTS = (4, 5, 6)
STEP, TOP = 0.25, 40.0

# letter classes: 0 no letter, 1-26 a-z, 27-59 Latin-1 letters U+00DF-U+00FF, 60 any other letter
N = 61
# fixed table: signs and the letters they stand for
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
GAPS = set(".-_*~'`^/\\:,")
SIGN_COST, GAP_COST, MASK_COST, DROP_COST = math.log(4), 0.1, math.log(30), 0.5
ODD = re.compile(r"[^\W\d_].*[0-9@$!|+(€£.\-_*~'`^/\\:,]+.*[^\W\d_]|^[0-9@$!|+(€£*]+.*[^\W\d_]|[^\W\d_].*[0-9@$]$|([^\W\d_])\1\1")


REPEAT, TRIPLE, DOUBLE = re.compile(r"(.)\1+"), re.compile(r"([^\W\d_])\1\1+"), re.compile(r"([^\W\d_])\1")


def class_table() -> np.ndarray:
    t = np.zeros(0x180, np.int32)
    t[ord("a"):ord("z") + 1] = np.arange(1, 27)
    t[0xDF:0x100] = np.arange(27, 60)
    t[0xF7] = 0
    t[0x100:] = 60
    return t


def classes(text: str, table: np.ndarray) -> np.ndarray:
    """Letter class of each character; characters past the table count as other letters from U+0370 on."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(c < len(table), table[np.minimum(c, len(table) - 1)], np.where((c >= 0x370) & (c < 0x2000), 60, 0))


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of all letter-class trigrams over whole texts; N**3 numbers at any input size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total = class_table(), np.zeros(N ** 3, np.int64)
        parts: list[np.ndarray] = []
        size = 0

        def add(parts: list[np.ndarray]) -> None:
            c = np.concatenate([[0, 0], *parts])  # texts are parted by two positions without a letter
            total[:] += np.bincount(c[:-2] * N * N + c[1:-1] * N + c[2:], minlength=N ** 3)

        for batch in batches:
            for text in batch.column(0):
                c = classes((text.as_py() or "").lower(), table)
                if len(c):
                    parts.append(np.concatenate([[0, 0], c, [0, 0]]))
                    size += len(c)
                if size > 1 << 20:
                    add(parts)
                    parts, size = [], 0
        add(parts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["t", "n"])

    rows = docs.select("text").mapInArrow(run, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(N ** 3)
    out[rows.column("t").to_numpy()] = rows.column("n").to_numpy()
    return out


def smoothed(counts: np.ndarray) -> np.ndarray:
    """P(c | a, b), trigrams backed off to pairs, singles and the uniform (Witten-Bell), as (N, N, N)."""
    tri = counts.reshape(N, N, N)

    def mix(c: np.ndarray, lower: np.ndarray) -> np.ndarray:
        kinds, total = (c > 0).sum(-1, keepdims=True), c.sum(-1, keepdims=True)
        return np.where(total > 0, (c + kinds * lower) / np.maximum(total + kinds, 1), lower)

    one = mix(tri.sum((0, 1)), np.full(N, 1 / N))
    two = mix(tri.sum(0), one[None, :])
    return mix(tri, np.broadcast_to(two[None], tri.shape))


@dataclass
class ToxicModel:
    weights: dict[str, float]
    logp: np.ndarray
    curve: tuple[np.ndarray, np.ndarray]
    name: str


def candidates(token: str) -> list[list[tuple[str, float]]]:
    """Lattice of a token: per position, (letter or nothing, cost)."""
    out: list[list[tuple[str, float]]] = []
    run = 0
    for i, ch in enumerate(token):
        run = run + 1 if i and token[i - 1] == ch else 1
        if ch.isalpha():
            if run == 1:
                out.append([(ch, 0.0)])
            elif run == 2:
                out.append([(ch, 0.0), ("", DROP_COST)])
            # further copies of a letter add nothing
        elif ch in LEET:
            out.append([(x, SIGN_COST) for x in LEET[ch]] + [("", 4 * SIGN_COST)])
        elif ch in GAPS:
            out.append([("", GAP_COST)] + ([(chr(97 + k), MASK_COST) for k in range(26)] if ch == "*" else []))
    return out


def viterbi(token: str, logp: np.ndarray, table: np.ndarray) -> str:
    """Likeliest word behind a token; states are the last two letters' classes."""
    best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for options in candidates(token):
        nxt: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (cost, word) in best.items():
            for letter, extra in options:
                if letter:
                    c = int(table[ord(letter)]) if ord(letter) < len(table) else 60
                    state, total, w = (b, c), cost + extra - float(logp[a, b, c]), word + letter
                else:
                    state, total, w = (a, b), cost + extra, word
                if state not in nxt or (total, w) < nxt[state]:
                    nxt[state] = (total, w)
        best = nxt
    return min((cost - float(logp[a, b, 0]), w) for (a, b), (cost, w) in best.items())[1]


def strip(token: str) -> str:
    return token.strip(".,;:!?\"'()[]{}<>%&#*$|+-_~`^/\\«»„“”‚‘’…")


class Scorer:
    """Raw scores of texts; remembers the weight of each token."""

    most = 500_000

    def __init__(self, weights: dict[str, float], logp: np.ndarray):
        self.weights, self.logp, self.table, self.seen = weights, logp, class_table(), {}
        # beginnings of all terms, copies of letters dropped: what a spaced word must go through
        self.begun = {once[:n] for w in weights for once in [REPEAT.sub(r"\1", w.lstrip("^"))] for n in range(1, len(once) + 1)}
        self.reach = 2 * max([STARTS[-1] + 1, *(len(w) for w in weights if w.isalpha())])  # letters of a spaced word with signs

    def weight(self, word: str) -> float:
        got = self.weights.get(word, 0.0)
        return max([got, *(self.weights.get("^" + word[:n], 0.0) for n in STARTS if len(word) > n)])

    def token(self, token: str) -> tuple[str, float]:
        """(restored word, weight) of a lower-case token."""
        got = self.seen.get(token)
        if got is None:
            if len(self.seen) >= self.most:
                self.seen.clear()
            plain = strip(token)
            got = (plain, self.weight(plain))
            if ODD.search(token):
                for noisy in {token, plain}:
                    word = viterbi(noisy, self.logp, self.table)
                    got = max(got, (word, self.weight(word)), key=lambda x: x[1])
            elif got[1] <= 0 and self.doubled(plain):
                word = viterbi(plain, self.logp, self.table)
                got = max(got, (word, self.weight(word)), key=lambda x: x[1])
            self.seen[token] = got
        return got

    def doubled(self, word: str) -> bool:
        """Whether a term may be left when copies of letters are dropped: only then is the lattice asked."""
        once = TRIPLE.sub(r"\1\1", word)
        at = [m.start() for m in DOUBLE.finditer(once)]
        if not at or len(at) > 6:
            return len(at) > 6
        kept = [once[:at[0]]]
        for i, j in zip(at, [*at[1:], len(once)], strict=True):
            kept = [k + rest for k in kept for rest in (once[i:j], once[i + 1:j])]
        return any(self.weight(k) > 0 for k in kept)

    def joined(self, text: str, pairs: bool) -> tuple[str, float]:
        """(restored word, weight) of letters that stood apart; groups of two make whole terms only,
        as many short words of a language stand side by side."""
        weight = (lambda w: self.weights.get(w, 0.0)) if pairs else self.weight
        got = (text, weight(text))
        if got[1] <= 0 and (not text.isalpha() or self.doubled(text)):
            word = self.seen.get(" " + text)  # no token has a blank
            if word is None:
                if len(self.seen) >= self.most:
                    self.seen.clear()
                word = self.seen[" " + text] = (viterbi(text, self.logp, self.table), 0.0)
            got = max(got, (word[0], weight(word[0])), key=lambda x: x[1])
        return got

    def spaced(self, run: list[str]) -> tuple[tuple[str, float], ...]:
        """(word, weight) of the words in a run of groups of one or two letters: those that lie
        apart from each other, begin and end with a group and weigh most (then most whole terms)."""
        none: tuple[float, int, tuple[tuple[str, float], ...]] = (0.0, 0, ())
        best = [none] * (len(run) + 1)
        for i in range(len(run)):
            if i and best[i - 1][:2] > best[i][:2]:
                best[i] = best[i - 1]
            text, once, pairs, signs = "", "", False, False
            for j in range(i, len(run)):
                if len(text) > self.reach or not (signs or once in self.begun or not once):
                    break  # one group past a beginning: a term of beginnings needs a longer word
                text, pairs = text + run[j], pairs or len(run[j]) > 1
                signs = signs or not run[j].isalpha()
                once = once if signs else REPEAT.sub(r"\1", once + run[j])
                if j > i and len(text) > (3 if pairs else 2):
                    word, w = self.joined(text, pairs)
                    if w > 0:
                        total, whole, words = best[i]
                        best[j + 1] = max(best[j + 1], (total + w, whole + (word in self.weights), (*words, (word, w))), key=lambda x: x[:2])
        return max(best[-2:], key=lambda x: x[:2])[2]

    def raw(self, text: str | None) -> float:
        if not text:
            return 0.0
        found: dict[str, float] = {}
        tokens = text.lower().split()
        for t in set(tokens):
            word, w = self.token(t)
            if w > 0:
                found[word] = w
        run: list[str] = []
        for t in [*tokens, "   "]:
            if t.isalpha():
                if len(t) < 3:
                    run.append(t)
                    continue
            else:
                group = t if len(t) == 1 else strip(t)
                if 0 < len(group) < 3 and all(c.isalpha() or c in LEET for c in group) and (len(group) == 1 or not group.isdigit()):
                    run.append(group)
                    continue
            if len(run) > 1:
                for word, w in self.spaced(run):
                    found[word] = w
            run = []
        return float(sum(heapq.nlargest(3, found.values())))


def terms(text: str | None) -> set[str]:
    words = {w for t in set((text or "").lower().split()) if (w := strip(t))}
    return words | {"^" + w[:n] for w in words for n in STARTS if len(w) > n}


def lexicon(train: DataFrame) -> dict[str, float]:
    """term -> log-odds of toxic texts, from (text, toxic) rows; copies of a text count once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad, clean = Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                (bad if toxic else clean).update(terms(text.as_py()))
        keys = list(bad.keys() | clean.keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([bad[k] for k in keys], pa.int64()),
                                          pa.array([clean[k] for k in keys], pa.int64())], names=["term", "t", "c"])

    texts = train.dropDuplicates(["text", "toxic"])
    size = texts.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("t"), F.count("*").alias("n")).first()
    t, c = size["t"], size["n"] - size["t"]
    weight = F.log((F.col("t") + 0.5) / (t + 1)) - F.log((F.col("c") + 0.5) / (c + 1))
    rows = (texts.select("text", "toxic").mapInArrow(run, "term string, t long, c long").groupBy("term")
            .agg(F.sum("t").alias("t"), F.sum("c").alias("c")).where(F.col("t") >= MIN_TOXIC)
            .select("term", weight.alias("w")).where(F.col("w") >= MIN_WEIGHT).orderBy(F.desc("w"), "term").collect())  # of the bounded sample
    return {r["term"]: r["w"] for r in rows}


def scored(docs: DataFrame, weights: dict[str, float], logp: np.ndarray, curve: tuple[np.ndarray, np.ndarray], name: str) -> DataFrame:
    """``docs`` with raw and score; the model (fixed-size table, bounded lexicon) is broadcast."""
    sent = docs.sparkSession.sparkContext.broadcast((weights, logp, curve))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = worker_state("toxicity")
        if state.get("toxic model") != name:
            state["toxic model"], state["toxic scorer"] = name, Scorer(*sent.value[:2])
        scorer = state["toxic scorer"]
        for batch in batches:
            raw = np.array([scorer.raw(t.as_py()) for t in batch.column(at)], float)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw), pa.array(calibrated(raw, sent.value[2], 0.0))],
                                             names=[*batch.schema.names, "raw", "score"])

    more = [T.StructField("raw", T.DoubleType()), T.StructField("score", T.DoubleType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *more]))


def fit_toxicity(docs: DataFrame, labels: DataFrame, held_mod: int = 4, held_rest: int = 2, sample_rows: int = SAMPLE_ROWS) -> ToxicModel:
    """Fit on (doc_id, text) and (doc_id, toxic), never on rows whose crc32 of
    the id modulo ``held_mod`` is ``held_rest``; at most ``sample_rows``
    labelled ids, chosen by a hash of the id, are used."""
    fresh = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    rest = fold(F.col("doc_id"), held_mod)
    chosen = (fresh.where(rest != held_rest).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
    train = written(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "toxic-train")  # at most sample_rows small rows
    apart = F.pmod(F.xxhash64("doc_id", F.lit("apart")), F.lit(3)) == 0
    weights = lexicon(train.where(~apart))
    logp = np.log(smoothed(trigram_counts(docs)) * 0.5 + 0.5 * smoothed(lexicon_counts(weights))).astype(np.float32)
    name = uuid.uuid4().hex
    apart_scored = scored(train.where(apart).select("text", "toxic"), weights, logp, (np.zeros(0), np.zeros(0)), name)
    curve = calibration(apart_scored, F.col("raw"), F.col("toxic"), STEP, 0.0, TOP)
    return ToxicModel(weights, logp, curve, name)


def lexicon_counts(weights: dict[str, float]) -> np.ndarray:
    """Trigram counts of the lexicon's whole words, each by its odds."""
    out, table = np.zeros(N ** 3), class_table()
    for word, w in weights.items():
        if not word.startswith("^"):
            c = np.concatenate([[0, 0], classes(word, table), [0]])
            np.add.at(out, c[:-2] * N * N + c[1:-1] * N + c[2:], math.exp(w))
    return out


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rest: bool = False,
             held_mod: int = 4, held_rest: int = 2) -> DataFrame:
    """doc_id, raw, score for each row; with ``rest`` also its text and, as a struct, its other columns."""
    bounded_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                      *([others(docs, id_col, text_col)] if rest else []))
    model = fit_toxicity(src, labels, held_mod, held_rest)
    out = scored(src, model.weights, model.logp, model.curve, model.name)
    return out if rest else out.drop("text")
