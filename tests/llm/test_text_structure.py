"""Periodic runs, the conversation trie and HTML extraction against plain Python, and their defined results."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from abode.llm import registry
from abode.llm.conversation_trie import conversation_trie, turn_table, with_turns
from abode.llm.html_text import FEATURES, blocks, decide, extract_text, grow, labelled_blocks, main_texts, trained
from abode.llm.periodic_runs import periodic_runs, text_runs

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---------------------------------------------------------------- periodic runs

def plain_runs(w, least=12):
    """(start, length, period): every stretch of words equal q apart, by every q."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            a = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > a and i + q - a >= max(least, 2 * q):
                found.setdefault((a, i + q), q)
            i += 1
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_of_random_words():
    rng = random.Random(5)
    for _ in range(300):
        texts = []
        for _ in range(rng.randint(1, 4)):
            n, k = rng.randint(0, 70), rng.choice([0, 1, 2, 4, 30])
            w = [str(rng.randint(0, k)) for _ in range(n)]
            if n and rng.random() < 0.5:
                a = rng.randrange(n)
                p = 1 + rng.randrange((n - a) // 2 + 1)
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            texts.append(w)
        least = rng.choice([2, 5, 12])
        for w, (n, runs, kept) in zip(texts, text_runs([" ".join(w) for w in texts], least), strict=True):
            assert n == len(w) and runs == plain_runs(w, least)
            gone = {i for s, m, q in runs for i in range(s + q, s + m)}
            assert kept == " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_query(spark):
    got = {r["doc_id"]: r for r in __spark_entry__.queries()["op11_periodic_runs"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        w = (d["text"] or "").encode().split()
        h = zlib.crc32(str(d["doc_id"]).encode())
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        w = [x.decode() for x in w]
        runs = plain_runs(w) if len(w) < 800 else text_runs([" ".join(w)])[0][1]
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        r = got[d["doc_id"]]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == sha("".join(f"{s},{m},{q}\n" for s, m, q in runs))
        assert r["collapsed_sha256"] == sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def test_runs_defined_results(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n\t", None), (None, "a b " * 8, "x"), (4, "a b " * 8, "x"), (4, "a b " * 8, "x"), (5, "w " * 30_000, None),
            (6, "naïve \U0001f600 " * 7, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string").withColumns({"n_words": F.lit("clash"), "collapsed_text": F.lit(1)})
    got = sorted((str(r["doc_id"]), r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed_text"]) for r in periodic_runs(docs).collect())
    pair = (16, [(0, 16, 2)], "a b")
    assert got == sorted([("1", 0, [], ""), ("2", 0, [], ""), ("3", 0, [], ""), ("None", *pair), ("4", *pair), ("4", *pair),
                          ("5", 30_000, [(0, 30_000, 1)], "w"), ("6", 14, [(0, 14, 2)], "naïve \U0001f600")])
    assert periodic_runs(docs.where("false")).collect() == []


# ---------------------------------------------------------------- conversation trie

def plain_trie(conversations):
    """The nodes' rows from {conv_id: [(role, text), ...]}, all prefixes spelled out."""
    members, children, ends = defaultdict(list), defaultdict(set), defaultdict(list)
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[:d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(c)
    sums = {}
    for n in sorted(members, key=len, reverse=True):
        saved = (len(members[n]) - 1) * len(n[-1][1]) if n else 0
        sums[n] = (sum(sums[k][0] for k in children[n]) or 1, saved + sum(sums[k][1] for k in children[n]))
    return sorted(((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), *sums[n], sha(",".join(map(str, sorted(ends[n])))))
                   for n, m in members.items()), key=lambda r: (r[0], r[1], r[7]))


def nodes(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0], r[1], r[7]))


def grouped(rows):
    conv = defaultdict(list)
    for c, t, role, text in rows:
        conv[c].append((t is not None, t or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v)] for c, v in conv.items()}


@pytest.mark.parametrize("most", [2000, 3])
def test_trie_query(spark, most):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    own = grouped(map(tuple, table.select("conv_id", "turn", "role", "text").collect()))
    want = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        want[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    t = turn_table(table)
    assert nodes(conversation_trie(registry.rebuilt(t), t.select("conv_id"), most)) == plain_trie(want)


@pytest.mark.parametrize("most", [1, 4, 500])
def test_trie_of_long_and_equal_conversations(spark, most):
    """A chain that many share, conversations that leave it at every depth, equal ones and one without turns."""
    chain = [("user", f"turn {i}" * (i % 3)) for i in range(21)]
    conv = {i: chain for i in range(12)} | {100 + i: [*chain[:i], ("assistant", "other")] for i in range(0, 21, 4)} | {200: chain[:7], 201: chain[:7], 300: [("", "")]}
    rows = [(c, i, *t) for c, turns in conv.items() for i, t in enumerate(turns)]
    members = spark.createDataFrame([(c,) for c in [*conv, 400]], "conv_id long")
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = conversation_trie(turn_table(table), members, most)
    assert nodes(got) == plain_trie(conv | {400: []})
    if most == 4:
        texts = {(r["conv_id"], r["depth"]): (r["role"], r["text"]) for r in with_turns(got, table).collect()}
        assert texts[(0, 0)] == (None, None) and all(texts[(0, d)] == chain[d - 1] for d in range(1, 22))


def test_trie_defined_results(spark):
    rows = [(1, None, None, None), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, None, "", ""), (2, 5, "user", "a"), (None, 0, "user", "lost"), (3, 0, "user", "x" * 200_000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"pos": F.lit("clash"), "n_convs": F.lit(1), "x": F.lit("x")})
    got = nodes(conversation_trie(turn_table(table)))
    assert got == plain_trie(grouped([r for r in rows if r[0] is not None]))
    assert nodes(conversation_trie(turn_table(table.where("false")))) == []


# ---------------------------------------------------------------- HTML extraction

def test_html_tree():
    rows = labelled_blocks()
    assert len(rows) < 200 and all(len(r) == len(FEATURES) + 1 for r in rows)
    import numpy as np

    x = np.array(rows, float)
    assert (decide(trained(), x[:, :-1]) == (x[:, -1] == 1)).all()
    few = np.array([[0.0, 1.0], [1.0, 1.0], [2.0, 1.0], [3.0, 1.0]])
    assert grow(few, np.array([0, 0, 1, 1])) == (0, 1.5, (0,), (1,)) and grow(few[:, 1:], np.array([0, 0, 1, 1])) == (1,)


TEXT = "The quick brown fox jumps over the lazy dog while the other animals of the wood look on and wonder what it is for. "


@pytest.mark.parametrize("page, want", [
    ("<nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>One\n two<br>three&nbsp;&lt;4&gt;<p>Short.</article><footer>end</footer>",
     "A & B\nOne two\nthree <4>\nShort."),
    ("<article><p>in<b>li</b>ne <i>text", "inline text"),
    ("<body><script>var a = '<p>no</p>';</script><article><style>p{}</style><!-- <p>no</p> --><p title='a > b'>yes</p><noscript>no</noscript></article>", "yes"),
    ("<article><p>keep</p><form><p>Name</p><input></form><section class='comments'><p>" + TEXT + "</p></section><p>this</p></article>", "keep\nthis"),
    ("<div class=cookie-notice><p>" + TEXT * 2 + "</p></div><main><p>word</p><aside>" + TEXT + "</aside></main>", "word"),
    ("<article><header class='entry-header'><h1>Title</h1></header><p>body</p></article><header>site</header>", "Title\nbody"),
    ("<div>" + TEXT + "</div><article><p>only this</p></article><p>" + TEXT + "</p>", "only this"),
    ("<article><div style='display: none'>hidden</div><p class=ad>buy</p><p>seen</p></article>", "seen"),
    ("<div><a href=/>x</a> <a href=/>y</a></div><div><p>" + TEXT * 2 + "</p><p>" + TEXT + "</p></div><div><a href=/>z</a></div>", (TEXT * 2).strip() + "\n" + TEXT.strip()),
    ("just < text & more", ""), ("", ""), (None, ""), ("<article></article>", ""), ("<article>a&#0;&#xD800;&bogus;</article>", "a��&bogus;"),
    ("</div></article><article><p>odd</p></p></section>", "odd")])
def test_html_pages(page, want):
    assert main_texts([page], trained())[0][0] == want


def test_html_long_and_deep_pages():
    page = "<article>" + "<div>" * 20_000 + "<p>" + "word " * 300_000 + "</article><a href=" + "<p" * 20_000
    assert main_texts([page], trained())[0][0] == ("word " * 300_000).strip()
    assert len(blocks("<li>a" * 50_000 + "</ul>" * 50_000)) == 50_000


def test_html_table(spark):
    rows = [(1, "u", "<article>a</article>"), (1, "u", "<article>a</article>"), (None, None, None), (2, "v", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "n_chars": F.lit("clash")})
    got = sorted(map(str, (tuple(r) for r in extract_text(pages).collect())))
    assert got == sorted(map(str, [(1, "u", "a", 1, 1, 1), (1, "u", "a", 1, 1, 1), (None, None, "", 0, 0, 0), (2, "v", "", 0, 0, 0)]))
    assert extract_text(pages.where("false")).collect() == []
