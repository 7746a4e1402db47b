"""Operators against plain Python over the whole smallest tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from abode.llm import elias_fano, mixing, toxicity
from abode.llm.decontaminate import canonical, decontaminate
from abode.llm.minhash import near_duplicates
from abode.llm.registry import RULES
from abode.llm.substring_dedup import substring_dedup

SF = "/root/testdata/sf0.001"
ROOM = re.compile(rb"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in ROOM.split((text or "").encode()) if w]


@pytest.fixture(scope="module")
def rows(spark):
    return sorted((r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())


def run(spark, name):
    return {r[0]: r for r in __spark_entry__.queries()[name](spark, SF).collect()}


def test_entry_registers_all():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert len(RULES) > 5


def test_token_counts(spark, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = run(spark, "op2_token_counts")
    for i, t, _ in rows:
        n = len(tok.encode(t or "", add_special_tokens=False))
        assert tuple(got[i]) == (i, len((t or "").encode()), n, n > 2048)


def test_language_model(spark, rows):
    got = run(spark, "op3_lm_scores")
    tokens = {i: [*words((t or "").encode().lower().decode()), b" "] for i, t, _ in rows}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for i in train for w in tokens[i])
    pairs = Counter(p for i in train for p in zip([b"^", *tokens[i][:-1]], tokens[i]))
    n, v = sum(c.values()), len(c)
    often = [sum(k == j for k in pairs.values()) for j in range(5)]
    share = often[1] / (often[1] + 2 * often[2])
    loss = [0] + [j - (j + 1) * share * often[j + 1] / often[j] for j in (1, 2, 3)]
    follow, spare = Counter(), Counter()
    for (a, _), k in pairs.items():
        follow[a] += k
        spare[a] += loss[min(k, 3)]
    for i, x in tokens.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(x), sum(c[w] > 0 for w in x), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x))
        score = 0.0
        for a, b in zip([b"^", *x[:-1]], x):
            one = (c[b] - 0.5) / n if c[b] else 0.5 * v / n
            k = pairs[a, b]
            score += math.log10(((k - loss[min(k, 3)]) + spare[a] * one) / follow[a] if follow[a] else one)
        assert abs(r["score"] - score) <= 0.035 * len(x)  # quantisation
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_language_model_in_any_layout(spark):
    """Contexts dealt to several shards have the probabilities of the whole
    context: with many small blocks scores stay near those of one block."""
    from abode.llm.language_model import score_documents

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    one, many = ({r["doc_id"]: r for r in score_documents(docs, block_bytes=b).collect()} for b in (64 << 20, 150_000))
    assert all(one[i]["base_score"] == pytest.approx(r["base_score"]) for i, r in many.items())
    assert all(abs(one[i]["score"] - r["score"]) <= 0.05 * r["n_tokens"] for i, r in many.items())


def test_discounts():
    from abode.llm.language_model import DISCOUNT, discounts

    assert discounts(np.array([1, 1, 2])).tolist() == [0, DISCOUNT, DISCOUNT, DISCOUNT]
    got = discounts(np.repeat([1, 2, 3, 4, 9], [100, 30, 15, 8, 5]))
    share = 100 / 160
    assert got[1:] == pytest.approx([1 - 2 * share * 30 / 100, 2 - 3 * share * 15 / 30, 3 - 4 * share * 8 / 15])


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, top in ((1, 5), (1000, 2**60), (5000, 6000), (70_000, 2**40)):
        v = np.sort(rng.integers(0, top, n, dtype=np.uint64))
        e = elias_fano.EliasFano(*elias_fano.EliasFano.build(v))
        q = np.concatenate([v, rng.integers(0, top + 10, 1000, dtype=np.uint64)])
        assert (e.at(np.arange(n)) == v).all() and (e.successor(q) == np.searchsorted(v, q)).all()
        assert ((e.find(q) >= 0) == np.isin(q, v)).all()


@pytest.mark.parametrize("block_bytes", [20_000, 8 << 20])
def test_substring_dedup(spark, rows, block_bytes):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in substring_dedup(docs, block_bytes=block_bytes).collect()}
    first = {}
    for i, t, _ in rows:
        w = words(t)
        gone = set()
        for j in range(len(w) - 12):
            if first.setdefault(tuple(w[j:j + 13]), i) < i:
                gone.update(range(j, j + 13))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_text"].encode()) == (len(w), len(gone), kept)


def test_near_duplicates(spark):
    """A base with chained, star-like and hot variants, against all pairs."""
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(5000)]
    base = [list(rng.choice(vocab, 120)) for _ in range(6)]
    texts = []
    for b in base:
        for _ in range(25):
            t = list(b)
            for j in rng.integers(0, len(t), rng.integers(0, 5)):
                t[j] = str(rng.choice(vocab))
            texts.append(" ".join(t))
    passage = " ".join(rng.choice(vocab, 40))
    texts += [passage + " " + " ".join(rng.choice(vocab, 60)) for _ in range(60)] + ["A b", "a B", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in near_duplicates(docs).collect()}
    sets = []
    for t in texts:
        w = words((t or "").lower())
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    comp = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for a in range(len(texts)):
            for b in range(a):
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both) and comp[a] != comp[b]:
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    changed = True
    for i, s in enumerate(sets):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(s), comp[i], comp[i] == i)


def test_mixing(spark, rows):
    got = run(spark, "op6_source_mix")
    size, taken = Counter(), Counter()
    for i, t, s in rows:
        r = got[i]
        assert r["size"] == len(words(t)) and 0 <= r["taken"] <= 3 * r["size"]
        size[s] += r["size"]
        taken[s] += r["taken"]
    left, target = sum(size.values()), {}
    open_ = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(size))}
    while open_:  # reshare until none is above its cap
        total = sum(open_.values())
        over = [s for s, w in open_.items() if left * w / total > 3 * size[s]]
        if not over:
            target |= {s: left * w / total for s, w in open_.items()}
            break
        for s in over:
            target[s] = 3 * size[s]
            left -= target[s]
            del open_[s]
    for r in got.values():
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == size[r["source"]]
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert got == run(spark, "op6_source_mix")
    for m in (1, 2, 3, 7, 64, 1000):
        k, n, key = np.arange(m), np.full(m, m), np.full(m, 99)
        p = mixing.permute(k, n, key)
        assert sorted(p) == list(range(m)) and (mixing.permute(p, n, key, back=True) == k).all()


def test_decontamination(spark):
    item = "How many apples does Anna have if she buys 12 apples for 3 dollars and then gives 5 apples to her brother Tom at home?"
    other = item.replace("12", "40").replace("Anna", "Maria").replace("Tom", "Paul")
    torn = "Then 7 birds saw 7 cats and 7 dogs near 7 old houses by 7 small rivers all day long"
    docs = [(1, "Clean words only here. " * 5), (2, "Before it. " + item + " After."), (3, "Intro words. " + other + " More."),
            (4, torn.replace("7", "{}").format(1, 2, 3, 4, 5)), (5, torn.replace("7", "9")), (6, None), (7, item[:40])]
    bench = spark.createDataFrame([(10, item), (11, torn), (12, None)], "item_id long, text string")
    got = {r["doc_id"]: (r["items"], r["contaminated"]) for r in decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == {1: ([], False), 2: ([10], True), 3: ([10], True), 4: ([], False), 5: ([11], True), 6: ([], False), 7: ([], False)}
    one = spark.createDataFrame([("we saw Ann, 12 km off",)], "t string").select(canonical(F.col("t"))).first()[0]
    assert one == ["we", "saw", "\x01pann", "\x01n12", "\x01ukm", "off"]


def test_toxicity_restores():
    weights = {"idiot": 8.0, "stupid": 8.0, "^stup": 8.0}
    model = np.log(0.5 * toxicity.smoothed(np.ones(toxicity.N ** 3)) + 0.5 * toxicity.smoothed(toxicity.lexicon_counts(weights)))
    s = toxicity.Scorer(weights, model)
    for noisy in ("1d10t", "i.d.i.o.t", "i d i o t", "IDIOOOOT", "$tup!d", "id!ot,"):
        assert s.raw(f"the and {noisy} of") == 8.0, noisy
    assert s.raw("plain words 12 and a b c d +1 (456) 555-2186") == 0.0


@pytest.mark.parametrize("name,label,mod,rest", [("op7_quality_scores", "quality", 5, 0), ("op8_toxicity", "toxic", 4, 2)])
def test_held_out(spark, name, label, mod, rest):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in __spark_entry__.queries()[name](spark, sf).collect()}
    right = defaultdict(int)
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        g = got[r["doc_id"]]
        assert g["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % mod == rest) and 0 <= g["score"] <= 1
        assert g["predicted"] == int(g["score"] >= 0.3)
        if g["held_out"]:
            right[g["predicted"] == r[label]] += 1
    assert right[True] >= 0.88 * (right[True] + right[False])


def test_digest(spark):
    q = __spark_entry__.queries()["op5_substring_dedup"](spark, SF).first()
    assert len(q["kept_sha256"]) == len(hashlib.sha256(b"").hexdigest())


def test_mixing_slots_and_taken(spark, monkeypatch):
    """Slots and what each document gives, word by word in plain Python; a
    third of the rows are one repeated row without an id."""
    monkeypatch.setattr(mixing, "SHARD_WORDS", 300)
    rng = random.Random(5)
    made = [(i, "w " * rng.randrange(0, 40), rng.choice(["a", "b", "b", "b", "c", None])) for i in range(200)]
    made += [(None, "same text again", "b")] * 100 + [(None, "another text", "b")] * 20
    docs = spark.createDataFrame(made, "doc_id long, text string, source string").repartition(5)
    result, slots = mixing.mix_sources(docs, block_words=16)
    result, slots = result.collect(), slots.collect()
    assert len(result) == len(made)
    sources = {r.source: (r.source_size, round(r.target)) for r in result}
    rank = {s: i for i, s in enumerate(sorted(sources, key=lambda s: (s is None, s or "")))}
    sized = spark.createDataFrame([(r[0], r[2], len(r[1].split()), hash(r[1])) for r in made], "doc_id long, source string, size long, row_hash long")
    for s, (size, due) in sources.items():
        mine = sorted((x for x in slots if x.source_rank == rank[s]), key=lambda x: x.slot)
        n = -(-size // 16)
        assert [x.slot for x in mine] == list(range(len(mine))) and sum(x.words for x in mine) == due
        assert [x.shard for x in mine] == sorted(x.shard for x in mine)
        for turn in range(-(-len(mine) // n)):
            blocks = [x.block for x in mine[turn * n:turn * n + n]]
            assert len(set(blocks)) == len(blocks)
        assert sum(r.taken for r in result if r.source == s) == due
        starts = sorted((r.start, r.size) for r in mixing.pack(sized).collect() if r.source == s and r["size"])
        assert [a for a, _ in starts] == [sum(b for _, b in starts[:i]) for i in range(len(starts))] and sum(b for _, b in starts) == size
    assert all(r.taken <= 3 * r.size for r in result)
    # the documents of the result's own packing, word by word
    sized = docs.selectExpr("doc_id", "source", "cast(size(filter(split(text, ' '), w -> w <> '')) as long) AS size", "xxhash64(text) AS row_hash")
    given = {}
    for x in slots:
        for w in range(x.block * 16, x.block * 16 + x.words):
            given[x.source_rank, w] = given.get((x.source_rank, w), 0) + 1
    want = [(r.doc_id or -1, r.source or "", r["size"], sum(given.get((rank[r.source], w), 0) for w in range(r.start, r.start + r["size"])))
            for r in mixing.pack(sized).collect()]
    assert sorted(want) == sorted((r.doc_id or -1, r.source or "", r["size"], r.taken) for r in result)


def test_mixing_shard_counts():
    """Multinomial: sums hold, mean and variance fit, the same for the same key."""
    draws = np.zeros((2000, 7))
    for i in range(2000):
        shard, c = mixing.shard_counts(210, 7, (1, i))
        draws[i, shard] = c
    assert (draws.sum(1) == 210).all()
    assert np.allclose(draws.mean(0), 30, atol=0.6) and np.allclose(draws.var(0), 210 / 7 * 6 / 7, rtol=0.12)
    again = mixing.shard_counts(210, 7, (1, 3))
    assert (again[1] == mixing.shard_counts(210, 7, (1, 3))[1]).all()
