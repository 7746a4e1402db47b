"""Benchmark decontamination by template canonicalisation.

1. Texts are canonicalised: names (capitalised words inside a sentence),
   numbers (words with a digit) and units (after a number) become typed
   placeholders that remember their value; other words lose case and
   punctuation.
2. Windows of ``WINDOW`` templates of the benchmark items, at most half of
   them placeholders, hash-join the documents' windows.  Letter case alone
   tells a name, so a window has a second hash with names as plain words in
   lower case, and matches if either hash does.
3. Matches of a document and an item at the same offset are one alignment.
   Its slots must be consistent: one value of the item always stands against
   one value of the document.  So a question with other numbers or names is
   caught, and a text that only has the same shape isn't.  Only slots in
   matched windows count; where two disagree the alignment is cut, and each
   longest run that doesn't hold both is judged by its own words.
4. A document is contaminated when a consistent run covers ``MIN_WORDS``
   words, or ``MIN_SHARE`` of a shorter item.  Covered words are those of all
   its windows, each word once.

DataFrame functions only.  The benchmark's windows are counted: up to
``BROADCAST_WINDOWS`` (a hash, an item, two numbers; at most two of them a window) they are broadcast, so the
documents' windows never move; beyond that the join shuffles by hash.

Defined results: null or empty texts and texts shorter than a window match
nothing; a null text in the benchmark is skipped; rows are told apart by id and
text; repeated rows get the same answer each; a null doc_id is kept; other
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abode.llm.common import written
from abode.llm.quality_rules import let

MARK = "\x01"
WINDOW = 8
MIN_WORDS = 13
MIN_SHARE = 0.6
BROADCAST_WINDOWS = 500_000

# fixed list of units
UNITS = ("mm", "cm", "m", "km", "mi", "mile", "miles", "inch", "inches", "foot", "feet", "ft", "yard", "yards", "g", "kg", "mg", "lb", "lbs",
         "pound", "pounds", "ounce", "ounces", "oz", "l", "ml", "liter", "liters", "litre", "litres", "s", "sec", "second", "seconds",
         "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
         "dollar", "dollars", "cent", "cents", "euro", "euros", "usd", "eur", "percent", "degrees", "mph", "kmh", "hz", "kw", "w", "v")
NAME = r"\p{Lu}(?<=[\p{Ll},;]\s\p{Lu})[^\s]*"
NUMBER = r"(?<![^\s])[^\s0-9]*+[0-9][^\s]*"
UNIT = rf"(\x01n[^\s]*\s+)({'|'.join(sorted(UNITS, key=lambda u: (-len(u), u)))})(?![^\s.,;:!?)])"
PUNCTUATION = r"[^\p{L}\p{N}\s\x01]+"


def canonical(text: Column) -> Column:
    """Words of a text as array<string>; a placeholder is MARK, its type (p, n or u), its value."""
    t = F.translate(F.coalesce(text, F.lit("")), MARK, " ")
    t = F.lower(F.regexp_replace(t, NAME, MARK + "p$0"))
    t = F.regexp_replace(F.regexp_replace(t, NUMBER, MARK + "n$0"), UNIT, "$1" + MARK + "u$2")
    return F.array_remove(F.split(F.regexp_replace(t, PUNCTUATION, ""), r"\s+"), "")


def template_hashes(words: Column) -> Column:
    """Hash of each word's template: of the placeholder's type, or of the word."""
    return F.transform(words, lambda w: F.xxhash64(F.when(F.startswith(w, F.lit(MARK)), F.substring(w, 1, 2)).otherwise(w)))


def nameless(words: Column) -> Column:
    """The words with names as plain words: letter case says nothing then."""
    return F.transform(words, lambda w: F.when(F.startswith(w, F.lit(MARK + "p")), F.substring(w, 3, 2**30)).otherwise(w))


def runs(h: Column, k: int) -> Column:
    """Hash of the ``k`` values from each place on, by halves; the last ``k - 1`` places hold no run."""
    if k == 1:
        return h
    if k % 2:
        return let(h, lambda x: F.zip_with(x, shifted(runs(x, k - 1), 1), lambda a, b: F.xxhash64(a, b)))
    return let(runs(h, k // 2), lambda x: F.zip_with(x, shifted(x, k // 2), lambda a, b: F.xxhash64(a, b)))


def shifted(x: Column, by: int) -> Column:
    return F.slice(x, F.lit(by + 1), F.greatest(F.size(x) - by, F.lit(0)))


def window_hashes(words: Column, k: int) -> Column:
    """Hashes of the windows of ``k`` words, null if there is none: first one
    for each window with names as placeholders, then one for each with names as
    plain words (null where that is the same)."""
    n = F.size(words) - (k - 1)

    def both(h: Column) -> Column:
        plain = F.zip_with(words, h, lambda w, x: F.when(F.startswith(w, F.lit(MARK + "p")), F.xxhash64(F.substring(w, 3, 2**30))).otherwise(x))
        return let(F.slice(runs(h, k), F.lit(1), n), lambda a: F.concat(
            a, F.zip_with(a, F.slice(runs(plain, k), F.lit(1), n), lambda x, y: F.when(x != y, y))))

    return F.when(n > 0, let(template_hashes(words), both))


def slots(words: Column) -> Column:
    """array<struct<pos, value>> of the placeholders."""
    marked = F.transform(words, lambda w, i: F.struct(i.alias("pos"), w.alias("value")))
    return F.filter(marked, lambda x: F.startswith(x["value"], F.lit(MARK)))


def window_rows(words: DataFrame, k: int, *keep: str) -> DataFrame:
    """``keep``, windows (of the row), plain (names are plain words), pos, h from (words, ...)."""
    hs = words.select(*keep, window_hashes(F.col("words"), k).alias("hs"))
    # outer: an inner explode infers a filter on its array, which would work the array out twice
    rows = hs.select(*keep, (F.size("hs") / 2).cast("int").alias("windows"), F.posexplode_outer("hs").alias("at", "h")).where("h is not null")
    return rows.select(*keep, "windows", (F.col("at") >= F.col("windows")).alias("plain"), F.pmod("at", "windows").alias("pos"), "h")


def benchmark_windows(words: DataFrame, k: int) -> DataFrame:
    """item, windows (of the item), ipos, h from (item, words)."""
    w = window_rows(words, k, "item", "words")
    form = F.when(F.col("plain"), nameless(F.col("words"))).otherwise(F.col("words"))
    literal = F.size(F.filter(F.slice(form, F.col("pos") + 1, F.lit(k)), lambda x: ~F.startswith(x, F.lit(MARK))))
    return w.where(literal >= k - k // 2).select("item", "windows", F.col("pos").alias("ipos"), "h")


def alignments(docs: DataFrame, benchmark: DataFrame, k: int = WINDOW, item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, th (hash of the text), item, words, windows: one row per document,
    item and offset, with the words of its best consistent run.

    Only (id, hash, place) leaves a document for the match, and only an aligned
    document's placeholders for the check of the slots; texts move only where
    more than ``BROADCAST_WINDOWS`` alignments tell which documents to look at again."""
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_col).alias("item"), canonical(F.col(item_text)).alias("words"))
    bench = benchmark_windows(items, k)
    d = docs.select("doc_id", F.xxhash64("text").alias("th"), canonical(F.col("text")).alias("words"))
    hs = window_rows(d, k, "doc_id", "th").select("doc_id", "th", F.col("pos").alias("dpos"), "h")
    hit = hs.join(F.broadcast(bench) if bench.count() <= BROADCAST_WINDOWS else bench, "h")
    key = ["doc_id", "th", "item", "offset"]
    got = written(hit.groupBy("doc_id", "th", "item", (F.col("dpos") - F.col("ipos")).alias("offset"))
                  .agg(F.max("windows").alias("windows"), F.array_sort(F.collect_set("ipos")).alias("at")), "alignments")
    # slots: the item's placeholder at p stands against the document's at p + offset
    theirs = items.select("item", F.explode(slots(F.col("words"))).alias("x")).select("item", F.col("x.pos").alias("p"), F.col("x.value").alias("a"))
    # only aligned documents are canonicalised again; their keys are counted before they are broadcast
    seen = got.select(F.col("doc_id").alias("id_"), F.col("th").alias("th_")).distinct()
    seen = F.broadcast(seen) if got.count() <= BROADCAST_WINDOWS else seen
    aligned = docs.select("doc_id", F.xxhash64("text").alias("th"), "text").join(
        seen, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("th") == F.col("th_")), "left_semi")
    mine = aligned.select("doc_id", "th", F.explode_outer(slots(canonical(F.col("text")))).alias("x")).where("x is not null").select(
        F.col("doc_id").alias("id_"), F.col("th").alias("th_"), F.col("x.pos").alias("q"), F.col("x.value").alias("b"))
    inside = F.exists("at", lambda i: (F.col("p") >= i) & (F.col("p") < i + k))  # words between the windows say nothing
    pairs = (got.select(*key, "at").join(theirs, "item").where((F.col("p") >= F.element_at("at", 1)) & (F.col("p") < F.element_at("at", -1) + k))
             .where(inside).select(*key, "p", "a", (F.col("p") + F.col("offset")).alias("place")))
    pairs = pairs.join(mine, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("th") == F.col("th_")) & (F.col("place") == F.col("q")))
    # a tear: the next slot of the same value stands against another value, so no run holds both places
    by = Window.partitionBy(*key, "a").orderBy("p")
    tears = (pairs.withColumns({"x": F.lag("p").over(by), "was": F.lag("b").over(by)}).where("was <> b")
             .groupBy(*key).agg(F.collect_list(F.struct("x", F.col("p").alias("y"))).alias("tears"))
             .withColumnsRenamed({c: c + "_" for c in key}))
    same = [F.col(c).eqNullSafe(F.col(c + "_")) for c in key]
    # longest consistent runs: each begins at the first word or after a tear's first place, and ends before a tear's second
    runs_ = F.transform(F.array_prepend(F.transform("tears", lambda t: t["x"] + 1), F.lit(0)), lambda start: F.struct(
        start.alias("start"), F.array_min(F.transform(F.filter("tears", lambda t: t["x"] >= start), lambda t: t["y"])).alias("stop")))
    words = F.array_max(F.transform(runs_, lambda r: covered(F.col("at"), k, r["start"], r["stop"])))
    out = got.join(tears, same[0] & same[1] & same[2] & same[3], "left")
    return out.select("doc_id", "th", "item", F.when(F.col("tears").isNull(), covered(F.col("at"), k)).otherwise(words).alias("words"), "windows")


def covered(at: Column, k: int, start: Column | None = None, stop: Column | None = None) -> Column:
    """Words in the windows of ``k`` words that begin at the places ``at``
    (ascending, distinct): of each the words up to the next.  With ``start``
    and ``stop`` (null: no end) only the words from there and before that."""
    def size(x: Column, y: Column) -> Column:
        end = F.least(x + k, y)  # least and greatest leave nulls out
        return end - x if start is None else F.greatest(F.least(end, stop) - F.greatest(x, start), F.lit(0))

    return F.aggregate(F.zip_with(at, shifted(at, 1), size), F.lit(0).cast("long"), lambda n, x: n + x)


def caught(a: DataFrame, k: int, min_words: int, min_share: float) -> DataFrame:
    return a.where((F.col("words") >= min_words) | (F.col("words") >= min_share * (F.col("windows") + (k - 1))))


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = WINDOW, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE,
                  id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, items (sorted ids of the benchmark items found), n_items,
    matched_words (of the best alignment), contaminated, for each row of ``docs``."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    hits = (caught(alignments(src, benchmark, k, item_col, item_text), k, min_words, min_share).groupBy("doc_id", "th")
            .agg(F.array_sort(F.collect_set("item")).alias("items"), F.max("words").alias("matched_words"))
            .withColumnsRenamed({"doc_id": "id_", "th": "th_"}))
    rows = src.select("doc_id", F.xxhash64("text").alias("th"))
    out = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("th") == F.col("th_")), "left")
    return out.select("doc_id", F.coalesce("items", F.array()).alias("items"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                      F.coalesce("matched_words", F.lit(0)).alias("matched_words"), F.col("items").isNotNull().alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) that aren't contaminated, with all their columns."""
    src = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    bad = (caught(alignments(src, benchmark), WINDOW, MIN_WORDS, MIN_SHARE)
           .select(F.col("doc_id").alias("id_"), F.col("th").alias("th_")).distinct())
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.xxhash64("text") == F.col("th_")), "left_anti")
