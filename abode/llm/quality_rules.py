"""Quality rules: a threshold table compiled into one Spark projection.

Every measure is a Column expression over the text (length, symbol, stop-word
and line ratios, repeated words); the table of thresholds becomes one boolean
expression over the measures.  No user functions, no shuffle.

Defined results: a null or empty text has no words, fails the base rule
(fewer than 10 words) and isn't kept; repeated rows are judged each; a null
doc_id is kept as it is; other columns are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from abode.llm.common import words_col

WINDOW = 5
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"

# fixed word lists: frequent function words of four languages
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on", "are", "as", "with", "be", "at", "this", "by", "from",
    "der", "die", "und", "das", "den", "von", "zu", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine",
    "de", "la", "que", "el", "en", "y", "los", "del", "se", "las", "por", "un", "para", "con", "no", "una", "su", "al", "lo",
    "le", "et", "les", "à", "une", "du", "est", "pour", "qui", "dans", "par", "plus", "pas", "au", "sur", "ne", "ce",
)


@dataclass(frozen=True)
class Rule:
    """Keep rows whose ``measure`` is within [low, high]; judged only from ``min_words`` words on."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None
    min_words: int = 0


RULES = (
    Rule("mean word length", "mean_word_chars", 1.5, 25.0),
    Rule("symbols per character", "symbol_ratio", None, 0.04),
    Rule("stop words per word", "stop_ratio", 0.04, None, 30),
    Rule("capitals per letter", "upper_ratio", None, 0.5, 10),
    Rule("exclamation marks per word", "bang_ratio", None, 0.3, 10),
    Rule("digits per character", "digit_ratio", None, 0.5, 10),
    Rule("repeated lines per line", "dup_line_ratio", None, 0.6),
    Rule("words equal to the one before", "stutter_ratio", None, 0.3, 10),
    Rule("words per distinct word", "repeat_ratio", None, 20.0, 30),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_window_words(words: Column, n: Column, k: int = WINDOW) -> Column:
    """Number of words covered by ``k``-word windows found twice or more.

    Windows are told apart by 64-bit hashes within one text.  Where all are
    distinct that ends it; else (hash, start) pairs are sorted, starts whose
    neighbour has an equal hash are kept in order, and each start adds the
    words up to the next start, ``k`` at most."""
    starts = F.sequence(F.lit(0), n - k)
    keys = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))

    def covered(keys: Column) -> Column:
        pairs = F.array_sort(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def count(s: Column) -> Column:
            twice = F.filter(s, lambda x, j: (x["h"] == F.get(s, j - 1)["h"]).eqNullSafe(F.lit(True))
                             | (x["h"] == F.get(s, j + 1)["h"]).eqNullSafe(F.lit(True)))
            return let(F.sort_array(F.transform(twice, lambda x: x["i"])), lambda p: F.aggregate(
                F.transform(p, lambda x, j: F.least(F.lit(k), F.coalesce(F.get(p, j + 1) - x, F.lit(k)))),
                F.lit(0).cast("long"), lambda a, x: a + x))

        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0).cast("long")).otherwise(let(pairs, count))

    return F.when(n < k, F.lit(0).cast("long")).otherwise(let(keys, covered))


def without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def measures(text: Column, words: Column, n: Column) -> dict[str, Column]:
    """The measures that rules can name, as expressions over text, words and their number."""
    chars = F.length(without(text, BLANKS))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(without(x, BLANKS)) > 0)
    n_lines = F.size(lines)
    dup = (n_lines - F.size(F.array_distinct(lines))).cast("long")
    lower = F.lower(text)
    return {
        "word_chars": chars.cast("long"),
        "n_symbols": (F.length(text) - F.length(without(text, SYMBOLS))).cast("long"),
        "n_dup_lines": dup,
        "n_repeat_words": repeated_window_words(words, n),
        "mean_word_chars": chars / F.greatest(n, F.lit(1)),
        "symbol_ratio": (F.length(text) - F.length(without(text, SYMBOLS))) / F.greatest(chars, F.lit(1)),
        "stop_ratio": F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))) / F.greatest(n, F.lit(1)),
        "upper_ratio": F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")) / F.greatest(F.length(F.regexp_replace(lower, r"[^\p{L}]+", "")), F.lit(1)),
        "bang_ratio": (F.length(text) - F.length(without(text, "!"))) / F.greatest(n, F.lit(1)),
        "digit_ratio": (F.length(text) - F.length(without(text, "0123456789"))) / F.greatest(chars, F.lit(1)),
        "dup_line_ratio": dup / F.greatest(n_lines, F.lit(1)),
        "stutter_ratio": F.size(F.filter(words, lambda w, i: w == F.get(words, i - 1))) / F.greatest(n, F.lit(1)),
        "repeat_ratio": n / F.greatest(F.size(F.array_distinct(words)), F.lit(1)),
    }


def compile_rules(rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(all rules hold, names of the rules that don't) over measure columns."""
    def broken(r: Rule) -> Column:
        out = F.lit(False)
        if r.low is not None:
            out = out | (F.col(r.measure) < r.low)
        if r.high is not None:
            out = out | (F.col(r.measure) > r.high)
        return out & (F.col("n_words") >= r.min_words)

    bad = F.array_compact(F.array(*[F.when(broken(r), F.lit(r.name)) for r in rules]))
    return F.size(bad) == 0, bad


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, the base measures, base_failed, kept, and the names of broken rules."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    split = src.select("doc_id", "text", words_col(F.col("text")).alias("words"))
    sized = split.select("doc_id", "text", "words", F.size("words").alias("n"))
    got = measures(F.col("text"), F.col("words"), F.col("n"))
    measured = sized.select("doc_id", F.col("n").cast("long").alias("n_words"), *[c.alias(k) for k, c in got.items()])
    holds, bad = compile_rules(rules)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                           base.alias("base_failed"), (~base & holds).alias("kept"), bad.alias("broken_rules"))
