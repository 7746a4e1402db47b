"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are encoded as the tokenizer's library does without begin, end or added
tokens.  Where the tokenizer drops white space (its first pre-tokenizer removes
everything that isn't a match), no token spans a white-space run, so every text
is cut there; words met twice are encoded alone and remembered, the others in
strings of 256 words.  Other tokenizers get whole texts, in batches of about
``slice_bytes``.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows
are counted each; a null doc_id is kept; other columns are ignored; an empty
table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from abode.llm.common import bounded_batches, words_of, worker_state

SLICE_BYTES = 4 << 20
MAX_MODEL_BYTES = 64 << 20
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def drops_space(model: bytes) -> bool:
    """True if a tokenizers file splits by removing what its pattern doesn't match."""
    pre = json.loads(model).get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    return first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert")) \
        and "\\s" in str(first.get("pattern")) and "[^\\s" in str(first.get("pattern"))


class WordLengths:
    """Token counts of texts as sums over their words.

    The lengths of words seen twice are remembered in two generations of at
    most about ``most`` words: words still in use move to the younger one, the
    older is dropped when that is full.  Words new to the worker and single in
    their slice are encoded together, ``piece`` words to a string."""

    most = 500_000
    piece = 256

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.young: dict[bytes, int] = {}
        self.old: dict[bytes, int] = {}
        self.once: set[bytes] = set()

    def lengths(self, strings: list[str]) -> Iterator[int]:
        for a in range(0, len(strings), 20_000):
            yield from map(len, self.tokenizer.encode_batch_fast(strings[a:a + 20_000], add_special_tokens=False))

    def learn(self, times: dict[bytes, int]) -> dict[bytes, int]:
        """Lengths of those of these words that the worker has met before, or meets twice now."""
        known = {w: self.old[w] for w in times.keys() & self.old.keys()}
        new = [w for w, n in times.items() if w not in known and (n > 1 or w in self.once)]
        known.update(zip(new, self.lengths([w.decode("utf-8", "replace") for w in new]), strict=True))
        self.once.difference_update(new)
        if len(self.young) + len(known) > self.most:
            self.young, self.old = {}, self.young
        self.young.update(known)
        return known

    def texts(self, texts: list[str | None]) -> list[int]:
        total: list[int] = []
        unknown: list[tuple[int, list[bytes]]] = []
        times: dict[bytes, int] = {}
        for i, text in enumerate(texts):
            words = words_of(text)
            found = list(map(self.young.get, words))
            if None in found:
                left = [w for w, n in zip(words, found, strict=True) if n is None]
                for w in left:
                    times[w] = times.get(w, 0) + 1
                unknown.append((i, left))
                found = [n for n in found if n is not None]
            total.append(sum(found))
        known = self.learn(times)
        owners, strings = [], []
        for i, words in unknown:
            found = list(map(known.get, words))
            rare = [w for w, n in zip(words, found, strict=True) if n is None]
            total[i] += sum(n for n in found if n is not None)
            self.once.update(rare)
            for a in range(0, len(rare), self.piece):
                owners.append(i)
                strings.append(b" ".join(rare[a:a + self.piece]).decode("utf-8", "replace"))
        if len(self.once) > self.most:
            self.once.clear()
        for i, n in zip(owners, self.lengths(strings), strict=True):
            total[i] += n
        return total


def counter(kind: str, model: bytes) -> Callable[[list[str | None]], list[int]]:
    """Texts -> token counts, for a tokenizers (.json) or sentencepiece (.model) file's content."""
    if kind == "json":
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(model.decode("utf-8"))
        if drops_space(model):
            return WordLengths(tok).texts
        return lambda texts: [len(e) for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    return lambda texts: [len(e) for e in sp.encode([t or "" for t in texts], num_threads=1)]


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes each; a longer row stands alone."""
    a = got = 0
    for i, n in enumerate(sizes):
        if i > a and got + n > most:
            yield a, i
            a, got = i, 0
        got += n
    if a < len(sizes):
        yield a, len(sizes)


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text",
                 slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs``.

    ``path`` is the tokenizer file as the driver sees it; its content (checked
    to be at most 64 MB) is broadcast, so workers need no copy of the file."""
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(path, "rb") as f:
        model = f.read()
    if len(model) > MAX_MODEL_BYTES:
        raise ValueError(f"tokenizer file of {len(model)} bytes is over {MAX_MODEL_BYTES}")
    kind, sent, digest = path.rpartition(".")[2], spark.sparkContext.broadcast(model), hashlib.sha256(model).hexdigest()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, key = worker_state(), f"lengths of {digest}"
        if key not in state:
            import os

            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            state[key] = counter(kind, sent.value)
        lengths = state[key]
        for batch in batches:
            text = batch.column(1)
            n_bytes = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            n: list[int] = []
            for a, b in slices(n_bytes.to_pylist(), slice_bytes):
                n += lengths(text.slice(a, b - a).to_pylist())
            n_tokens = pa.array(n, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, n_tokens, pc.greater(n_tokens, limit)],
                                             names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    src = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text")
    return src.mapInArrow(count, SCHEMA)
