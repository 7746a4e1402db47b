"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from abode.llm.common import fold, words_col, written
from abode.llm.conversation_trie import conversation_trie, turn_table
from abode.llm.decontaminate import decontaminate
from abode.llm.html_text import extract_text
from abode.llm.language_model import score_documents
from abode.llm.minhash import near_duplicates
from abode.llm.mixing import mix_sources
from abode.llm.periodic_runs import periodic_runs
from abode.llm.quality_classifier import quality_scores
from abode.llm.quality_rules import RULES, STOP_WORDS, SYMBOLS, quality_rules
from abode.llm.substring_dedup import substring_dedup
from abode.llm.token_counts import token_counts
from abode.llm.toxicity import toxicity
from abode.llm.url_filter import url_filter

CUT = 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "template")


def op2_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(tokenizer))


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substring_dedup(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    result, _ = mix_sources(table(spark, sf_dir, "documents"))
    return result.select("doc_id", "size", "source_size", "target", "taken", "source")


def op7_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("broken_rules")


def crc(number: Column) -> Column:
    """Unsigned crc32 of an id in decimal; null counts as the empty text."""
    return F.crc32(F.coalesce(number.cast("string"), F.lit("")).cast("binary"))


def with_periods(docs: DataFrame) -> DataFrame:
    """doc_id, text: in one document of ten (by crc32) the words from place a on repeat the p words there."""
    h = crc(F.col("doc_id"))
    spread = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.when(h % 10 == 0, words_col(F.col("text"))).alias("w"),
                         F.floor(h / 10).cast("long").alias("g")).withColumn("n", F.size("w"))
    spread = spread.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    spread = spread.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    word = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get(
        F.col("w"), F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))))
    return spread.select("doc_id", F.when(F.col("n") > 0, F.array_join(word, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = periodic_runs(with_periods(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("s"), (-r["period"]).alias("q"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    got = got.withColumn("best", best)
    start, length, period = -F.col("best.s"), F.col("best.length"), -F.col("best.q")
    return got.select("doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
                      F.floor(1000 * length / period).cast("long").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
                      F.sha2(F.col("collapsed_text").cast("binary"), 256).alias("collapsed_sha256"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, pos, x, y, n_chars) of the conversations that begin like the one whose id is a hundred's first."""
    size = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    base_id = F.col("conv_id") - F.col("conv_id") % 100
    convs = size.select("conv_id", base_id.alias("base_id"), (crc(F.col("conv_id")) % 6).alias("h"))
    convs = convs.join(size.select(F.col("conv_id").alias("base_id"), F.col("n").alias("n_base")), "base_id", "left")
    first = (turns.where((F.col("conv_id") % 100 == 0) & (F.col("pos") <= 5)).withColumnRenamed("conv_id", "base_id")
             .join(convs, "base_id").where("pos <= h"))
    rest = turns.join(convs, "conv_id").where("pos > h").withColumn("pos", F.col("pos") - F.col("h") + F.least("h", F.coalesce("n_base", F.lit(0))))
    return first.select(*turns.columns).unionByName(rest.select(*turns.columns))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = written(turn_table(table(spark, sf_dir, "conversations")), "turns")
    return conversation_trie(rebuilt(turns), turns.select("conv_id"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


QUERIES = {f.__name__: f for f in (
    op1_url_filter, op2_token_counts, op3_lm_scores, op4_decontaminate, op5_substring_dedup, op6_source_mix, op7_quality_scores,
    op8_toxicity, op9_near_duplicates, op10_quality_rules, op11_periodic_runs, op12_conversation_trie, op13_html_extraction)}

WORDS_SQL = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP5_SQL = rf"""
with d as (select doc_id, {WORDS_SQL} w from documents),
win as (select doc_id, i, array_to_string(w[i:i+12], ' ') s from (select doc_id, w, unnest(range(1, len(w) - 11)) i from d where len(w) >= 13)),
src as (select s, min(doc_id) first_id from win group by s),
gone as (select distinct doc_id, unnest(range(i, i + 13)) p from win join src using (s) where first_id < doc_id),
cuts as (select doc_id, list(p) ps from gone group by doc_id)
select doc_id, len(w)::bigint n_words, coalesce(len(ps), 0)::bigint n_removed,
  sha256(array_to_string([w[p] for p in range(1, len(w) + 1) if ps is null or not list_contains(ps, p)], ' ')) kept_sha256
from d left join cuts using (doc_id)"""

OP9_SQL = rf"""
with recursive d as (select doc_id, {WORDS_SQL.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} w from documents),
sh as (select distinct doc_id, s from (
  select doc_id, array_to_string(w[i:i+4], ' ') s from (select doc_id, w, unnest(range(1, len(w) - 3)) i from d where len(w) >= 5)
  union all select doc_id, array_to_string(w, ' ') s from d where len(w) between 1 and 4)),
n as (select doc_id, count(*) n from sh group by doc_id),
common as (select a.doc_id a, b.doc_id b, count(*) c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
link as (select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
edge as (select a, b from link union all select b, a from link),
reach(doc_id, other) as (select doc_id, doc_id from d union select r.doc_id, e.b from reach r join edge e on e.a = r.other),
comp as (select doc_id, min(other) component_id from reach group by doc_id)
select doc_id, coalesce(n, 0)::bigint n_shingles, component_id, doc_id = component_id kept from d join comp using (doc_id) left join n using (doc_id)"""


def _op10_sql() -> str:
    blank = r"'[\x20\x09-\x0D]+'"
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    rules = []
    for r in RULES:
        parts = ([f"{r.measure} < {r.low}"] if r.low is not None else []) + ([f"{r.measure} > {r.high}"] if r.high is not None else [])
        rules.append(f"(({' or '.join(parts)}) and n_words >= {r.min_words})")
    return rf"""
with d as (select doc_id, coalesce(text, '') t, {WORDS_SQL} w from documents),
e as (select *, len(w)::bigint n, list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, {blank}, '', 'g') <> '') lines,
  length(regexp_replace(t, {blank}, '', 'g')) chars, greatest(len(w), 1) m from d),
win as (select doc_id, i, array_to_string(w[i:i+4], ' ') s from (select doc_id, w, unnest(range(1, len(w) - 3)) i from d where len(w) >= 5)),
twice as (select doc_id, s from win group by doc_id, s having count(*) > 1),
rep as (select doc_id, count(*) n_repeat_words from (select distinct doc_id, unnest(range(i, i + 5)) p from win semi join twice using (doc_id, s)) group by doc_id),
f as (select doc_id, n n_words, chars::bigint word_chars, (length(t) - length(translate(t, '{SYMBOLS}', '')))::bigint n_symbols,
  (len(lines) - len(list_distinct(lines)))::bigint n_dup_lines, coalesce(n_repeat_words, 0)::bigint n_repeat_words,
  chars / m mean_word_chars, (length(t) - length(translate(t, '{SYMBOLS}', ''))) / greatest(chars, 1) symbol_ratio,
  len(list_filter(w, lambda x: lower(x) in ({stop}))) / m stop_ratio,
  length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) / greatest(length(regexp_replace(lower(t), '[^\p{{L}}]+', '', 'g')), 1) upper_ratio,
  (length(t) - length(translate(t, '!', ''))) / m bang_ratio,
  (length(t) - length(translate(t, '0123456789', ''))) / greatest(chars, 1) digit_ratio,
  (len(lines) - len(list_distinct(lines))) / greatest(len(lines), 1) dup_line_ratio,
  len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) / m stutter_ratio,
  n / greatest(len(list_distinct(w)), 1) repeat_ratio
  from e left join rep using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 or 100 * n_repeat_words > 20 * n_words) base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and not ({' or '.join(rules)}) kept
from f"""


def crc_sql(number: str) -> str:
    """crc32 of a decimal number, bit by bit: a byte is mixed in, then eight shifts (-1)."""
    chars = f"string_split(cast({number} as varchar), '')"
    steps = f"flatten(list_transform({chars}, lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))"
    shift = "case when x >= 0 then xor(a, x) when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {steps}), lambda a, x: {shift}), 4294967295)"


OP11_SQL = rf"""
with o as (select doc_id, {WORDS_SQL} w, {crc_sql("doc_id")} h from documents),
a as (select *, len(w) n, h // 10 g, (h // 10) % greatest(len(w), 1) a from o),
d as (select doc_id, n, case when h % 10 = 0 and n > 0 then
  list_transform(range(0, n), lambda i: w[case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + g % 8)) end + 1]) else w end w from a),
six as (select doc_id, n, i, array_to_string(w[i + 1:i + 6], ' ') s from (select doc_id, n, w, unnest(range(0, n - 5)) i from d where n >= 6)),
pair as (select x.doc_id, x.i, y.i - x.i q from six x join six y on x.doc_id = y.doc_id and x.s = y.s and x.i < y.i),
isle as (select doc_id, q, min(i) s, max(i) + 6 + q - min(i) l from (select *, i - row_number() over (partition by doc_id, q order by i) k from pair) group by doc_id, q, k),
run as (select doc_id, s, l, min(q) q from isle where l >= greatest(12, 2 * q) group by doc_id, s, l),
gone as (select distinct doc_id, unnest(range(s + q, s + l)) i from run),
word as (select doc_id, i, w[i + 1] x from (select doc_id, w, unnest(range(0, n)) i from d)),
kept as (select doc_id, string_agg(x, ' ' order by i) t from word anti join gone using (doc_id, i) group by doc_id),
best as (select doc_id, s, l, q from run qualify row_number() over (partition by doc_id order by l desc, s, q) = 1),
all_runs as (select doc_id, count(*) c, string_agg(s || ',' || l || ',' || q || chr(10), '' order by s, q) t from run group by doc_id)
select doc_id, coalesce(c, 0)::bigint n_runs, s::bigint as start, l::bigint as length, q::bigint as period, (1000 * l // q)::bigint exponent_milli,
  sha256(coalesce(all_runs.t, '')) runs_sha256, sha256(coalesce(kept.t, '')) collapsed_sha256
from d left join best using (doc_id) left join all_runs using (doc_id) left join kept using (doc_id)"""

OP12_SQL = rf"""
with t as (select conv_id, list(md5(coalesce(role, '') || chr(1) || coalesce(text, '')) order by turn nulls first) w,
  list(length(coalesce(text, '')) order by turn nulls first) l from conversations where conv_id is not null group by conv_id),
h as (select *, ({crc_sql("conv_id")} % 6)::int h from t),
r as (select c.conv_id, coalesce(b.w[1:c.h], []) || c.w[c.h + 1:] w, coalesce(b.l[1:c.h], []) || c.l[c.h + 1:] l
  from h c left join t b on b.conv_id = c.conv_id - c.conv_id % 100),
p as (select conv_id, d, array_to_string(w[1:d], ' ') k, array_to_string(w[1:d - 1], ' ') up, l[d] chars, d = len(w) final
  from (select *, unnest(range(0, len(w) + 1)) d from r)),
node as (select d, k, any_value(up) up, any_value(chars) chars, min(conv_id) conv_id, count(*) n,
  sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (final), '')) ends from p group by d, k),
kids as (select d - 1 d, up k, count(*) c from node where d > 0 group by 1, 2),
full_node as (select node.*, coalesce(c, 0) c from node left join kids using (d, k)),
below as (select x.d, x.k, sum(case when y.c = 0 then 1 else 0 end) leaves, sum(case when y.d > 0 then (y.n - 1) * y.chars else 0 end) saved
  from full_node x join full_node y on y.d >= x.d and (x.d = 0 or y.k[1:length(x.k)] = x.k) group by 1, 2)
select x.conv_id, x.d::bigint depth, u.conv_id parent_conv_id, x.n::bigint n_convs, x.c::bigint n_children, leaves::bigint n_leaves,
  saved::bigint saved_tokens, x.ends ends_sha256
from full_node x join below using (d, k) left join node u on u.d = x.d - 1 and u.k = x.up"""

# the given pages keep their main text in one article element of plain blocks
OP13_SQL = r"""
with a as (select page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') t from pages),
b as (select page_id, url, list_transform(regexp_split_to_array(regexp_replace(t, '</?b>', '', 'g'), '</?(?:h1|p|br)>'), lambda x:
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '&quot;?', '"', 'g'),
    '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) x from a),
c as (select page_id, url, array_to_string(list_filter(x, lambda y: y <> ''), chr(10)) as text from b)
select page_id, url, text, length(text)::bigint n_chars from c"""

ORACLE = {"op11_periodic_runs": OP11_SQL, "op12_conversation_trie": OP12_SQL, "op13_html_extraction": OP13_SQL, "op5_substring_dedup": OP5_SQL, "op9_near_duplicates": OP9_SQL, "op10_quality_rules": _op10_sql()}
