"""Pipeline stages keep every text that no rule removes, rows that share an id included."""

import corpus_pipeline
from abode.llm.decontaminate import decontaminate

A, B, C = (" ".join(f"{w}{i}" for i in range(40)) for w in ("alpha", "beta", "gamma"))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_near_duplicates_stage_keeps_texts(spark):
    rows = [(1, A, "en", "x", 9), (1, B, "en", "x", 9), (1, A, "de", "y", 9), (2, B, "en", "x", 9), (3, C, None, None, None), (3, C, None, None, None),
            (None, A, "en", "x", 9), (None, A, "en", "x", 9), (4, None, "en", "x", None), (5, "", "en", "x", 0), (6, None, "en", "x", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(str, (tuple(r) for r in corpus_pipeline.near_duplicates_stage(spark, docs, "").collect())))
    want = [(1, A, "de", "y", 9), (1, B, "en", "x", 9), (3, C, None, None, None), (None, A, "en", "x", 9), (None, A, "en", "x", 9), (4, None, "en", "x", None),
            (5, "", "en", "x", 0), (6, None, "en", "x", None)]
    assert got == sorted(map(str, want))


def test_decontamination_with_many_aligned_documents(spark):
    """A header that many items and documents share: documents whose own question is copied go, the answer doesn't
    depend on how the aligned documents are found."""
    header = "read the following passage and then answer the question below it"
    def word(*numbers):  # letters only: digits would be placeholders
        return "".join("abcdefghij"[int(c)] for n in numbers for c in f"{n:02d}")

    items = [(i, f"{header} " + " ".join("q" + word(i, j) for j in range(30))) for i in range(20)]
    docs = [(i, f"{header} " + " ".join("text" + word(i, j) for j in range(50)), "en", "x", 0) for i in range(40)]
    docs += [(100 + i, f"intro {items[i][1]} outro", "en", "x", 0) for i in range(5)] + [(None, items[7][1], None, None, None)]
    import abode.llm.decontaminate as module

    bench = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame(docs, SCHEMA)
    want = {str(100 + i): [i] for i in range(5)} | {"None": [7]}
    most = module.BROADCAST_WINDOWS
    try:
        for module.BROADCAST_WINDOWS in (most, 0):
            got = {str(r["doc_id"]): r["items"] for r in decontaminate(table, bench).collect() if r["contaminated"]}
            assert got == want
    finally:
        module.BROADCAST_WINDOWS = most
