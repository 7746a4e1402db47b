"""Every operator and stage over awkward rows: nulls in any column, empty and
long texts, repeated rows, clashing extra columns, and empty tables."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from abode.llm.decontaminate import decontaminate
from abode.llm.language_model import score_documents
from abode.llm.minhash import near_duplicates
from abode.llm.mixing import mix_sources
from abode.llm.quality_classifier import quality_scores
from abode.llm.quality_rules import quality_rules
from abode.llm.substring_dedup import substring_dedup
from abode.llm.token_counts import token_counts
from abode.llm.toxicity import toxicity
from abode.llm.url_filter import url_filter

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LONG = " ".join(f"word{i % 997}" for i in range(30_000))
ROWS = [(1, None, "en", "a", None), (2, "", None, None, 0), (3, " \t\n", "en", "b", 3), (None, "some text without an id at all", "en", "a", 30),
        (None, None, None, None, None), (4, "one two three", "en", "a", 13), (4, "one two three", "en", "a", 13), (5, LONG, "en", "b", len(LONG)),
        (6, LONG, "en", None, len(LONG)), (7, "naïve <|endoftext|> ünïcödé \U0001f600 text", "fr", "b", 30), (-8, "negative id " * 20, "en", "c", 240)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("edges"))
    docs = spark.createDataFrame(ROWS, DOCS).withColumns({
        "n_words": F.lit("clash"), "kept": F.lit(1), "block": F.lit(9), "words": F.lit(2), "score": F.lit("x"), "size": F.lit("s")})
    labels = spark.createDataFrame([(1, None, 1), (4, 1, None), (None, 1, 1), (5, 0, 1), (5, 0, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "a question " * 10), (2, None), (None, ""), (3, "short")], "item_id long, text string")
    docs.write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    bench.write.parquet(f"{d}/benchmark.parquet")
    return d, spark.read.parquet(f"{d}/documents.parquet"), labels, bench


def operators(labels, bench):
    import public_tokenizers

    return {
        "tokens": lambda d: token_counts(d, public_tokenizers.path("word_bpe_49k.json")),
        "lm": score_documents, "decontaminate": lambda d: decontaminate(d, bench), "substring": substring_dedup,
        "mix": lambda d: mix_sources(d)[0], "quality": lambda d: quality_scores(d, labels), "toxicity": lambda d: toxicity(d, labels),
        "near": near_duplicates, "rules": quality_rules,
    }


@pytest.mark.parametrize("name", ["tokens", "lm", "decontaminate", "substring", "mix", "quality", "toxicity", "near", "rules"])
def test_one_row_per_row(tables, name):
    _, docs, labels, bench = tables
    got = operators(labels, bench)[name](docs).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in ROWS)
    none = operators(labels, bench)[name](docs.where("false")).collect()
    assert none == []
    assert len(operators(labels.where("false"), bench.where("false"))[name](docs).collect()) == len(ROWS)


def test_defined_results(tables):
    _, docs, _, _ = tables
    near = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs).collect()}
    assert {(1, 0, 1, True), (2, 0, 2, True), (4, 1, 4, True), (5, 997, 5, True), (6, 997, 5, False)} <= near
    cut = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup(docs).collect() if r["doc_id"]}
    assert cut[1] == (0, 0) and cut[5] == (30_000, 0) and cut[6] == (30_000, 30_000)
    lm = {r["doc_id"]: r["n_tokens"] for r in score_documents(docs).collect() if r["doc_id"]}
    assert lm[1] == 1 and lm[4] == 4


def test_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "HTTP://Sub.Example.ORG/es/x?q#f"), (4, "http://org"), (5, "x://example.org/en/1"), (6, "a://b.com/fr/1/2/3/4/5/6/7/8"),
            (6, "a://b.com/fr/1/2/3/4/5/6/7/8"), (None, "https://a.com/de/"), (8, "https://notorg/es/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit(1), "path": F.lit(2), "bad": F.lit(3)})
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter(pages).collect()}
    assert got[1] == ("", "", None, "allow") and got[2] == ("", "", None, "allow")
    assert got[3] == ("sub.example.org", "/es/x", "example.org/es/", "block")
    assert got[4] == ("org", "", None, "allow") and got[5][2:] == ("example.org/en/1", "block")
    assert got[6][2:] == ("com/fr/", "allow") and got[None][2:] == ("com/de/", "block") and got[8][2] is None
    assert url_filter(pages.where("false")).collect() == []


def test_pipeline(tables, spark):
    d, docs, _, _ = tables
    for empty in (False, True):
        at = docs.where("false") if empty else docs
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, at, d)
            if name != "mixing":
                assert out.dtypes == at.dtypes, name
            at = corpus_pipeline.written(out, f"test-{name}")
        ids = [r["doc_id"] for r in at.collect()]
        if not empty:
            assert 6 not in ids and ids.count(4) == 1


def test_word_lengths_remembered_or_not():
    """Whatever is remembered (a few words, all), the counts are those of whole texts."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from abode.llm.token_counts import WordLengths

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = [" ".join(f"w{(i * j) % 97}x it's \u00e9\u0301t\u00e9 <|endoftext|> a\u00a0b {j}" for j in range(i % 41)) for i in range(300)]
    texts += [None, "", " \t\n ", "\u0301 x", " ".join(f"rare{i}" for i in range(1000))]
    whole = [len(e) for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for most in (0, 5, 500_000):
        lengths = WordLengths(tok)
        lengths.most = most
        assert [n for a in range(0, len(texts), 10) for n in lengths.texts(texts[a:a + 10])] == whole
        assert lengths.texts(texts) == whole


def test_worker_caches_have_one_owner():
    """A worker's caches go when another operator takes over, and stay while it is the same."""
    from abode.llm.common import word_hash, worker_state

    words = word_hash()
    assert word_hash() is words
    worker_state("toxicity")["scorer"] = 1
    assert worker_state("toxicity") == {"scorer": 1} and word_hash() is not words and worker_state("toxicity") == {}
