"""Url filter, decontamination and classifiers against plain Python."""

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from abode.llm import decontaminate as dc
from abode.llm import quality_classifier as qc
from abode.llm import toxicity as tx
from abode.llm import url_filter as uf
from abode.llm.common import fold
from abode.llm.isotonic import pool_adjacent

SF = "/root/testdata/sf0.001"


# --- url filter ------------------------------------------------------------

def grown(rows):
    """(host, path) -> template, from the number of rows of each."""
    seg = {k: [regex.sub("[0-9]+", "{n}", s) for s in k[1][1:].split("/")] for k in rows}
    tpl = dict.fromkeys(rows, "")
    for d in range(max(map(len, seg.values()))):
        # past LEVELS a position is told by the fixed forms since then
        place = {k: (k[0], tpl[k]) if d < uf.LEVELS else (k[0], tuple(tpl[k].split("/")[:uf.LEVELS + 1]), *seg[k][uf.LEVELS:d]) for k in rows if d < len(seg[k])}
        below = defaultdict(Counter)
        for k, at in place.items():
            below[at][seg[k][d]] += rows[k]
        step = {}
        for k, at in place.items():
            c = below[at]
            wild = len(c) >= 10 and len(c) > math.sqrt(sum(c.values())) and seg[k][d] != ""
            step[k] = tpl[k] + "/" + ("*" if wild else seg[k][d])
        tpl |= step
    return tpl


def judged(marks):
    """(host, template) -> (share, support, support's share), from {(host, template): [labels, bad]}."""
    prior = sum(b for _, b in marks.values()) / max(sum(n for n, _ in marks.values()), 1)

    def around(host, t):
        cut = t.split("/")
        levels = range(1, max(len(cut) - 1, 1) + 1)
        pools = [(2 * d + 1, "/".join(cut[:d]), "".join("/" + x for x in cut[d + 1:])) for d in levels]
        return sorted([*[(2 * d, "/".join(cut[:d]), "") for d in levels], *pools])

    held = defaultdict(lambda: [0, 0])
    for (host, t), (n, b) in marks.items():
        for g in around(host, t):
            held[host, g][0] += n
            held[host, g][1] += b
    out = {}
    for (host, t), (n, b) in marks.items():
        groups = [held[host, g] for g in around(host, t)]
        own = n, b
        for g in around(host, t):
            pn, pb = held[host, g]
            if g[0] % 2 and n > 0 and pn > n:
                p = pb / pn
                if abs(b / n - (pb - b) / (pn - n)) <= uf.MERGE_Z * math.sqrt(max(p * (1 - p), 1e-4) * (1 / n + 1 / (pn - n))):
                    own = pn, pb
        share, support, firm = prior, 0, 0.0
        for gn, gb in [*groups, own]:
            share = (gb + uf.PRIOR_WEIGHT * share) / (gn + uf.PRIOR_WEIGHT)
            if gn >= uf.MIN_LABELS:
                support, firm = gn, share
        out[host, t] = share, support, firm
    return out


def test_url_filter(spark):
    rng = random.Random(11)
    pages, labels = [], []
    for i in range(1500):
        kind = rng.choice(["spam", "news", "shop", "x"])
        tail = rng.choice([f"item-{rng.randrange(99)}", rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("abcdefg"), "", "list/all"])
        if rng.random() < 0.2:  # deeper than the rounds go
            tail = f"a/b/c/{rng.choice('de')}/f/g/" + "".join(rng.choices("klmnop", k=2)) + rng.choice(["", f"/end{rng.randrange(9)}"])
        pages.append((i, f"http://h{rng.randrange(4)}.net/{kind}/{tail}" if rng.random() < 0.95 else None))
        if rng.random() < 0.4:
            labels.append((i, int(rng.random() < (0.9 if kind == "spam" else 0.05))))
    got = uf.url_filter(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int"), rules=()).collect()
    where = {i: ("", "") if u is None else (u[7:].split("/", 1)[0], "/" + u[7:].split("/", 1)[1]) for i, u in pages}
    template, marks, known = grown(Counter(where.values())), defaultdict(lambda: [0, 0]), dict(labels)
    for i, k in where.items():
        m = marks[k[0], template[k]]
        m[0] += i in known
        m[1] += known.get(i, 0)
    verdicts = judged(marks)
    assert len(got) == len(pages)
    for r in got:
        k = where[r.page_id]
        share, support, firm = verdicts[k[0], template[k]]
        assert (r.host, r.path, r.template, r.support) == (*k, template[k], support)
        assert r.bad_share == pytest.approx(share)
        assert r.verdict == ("block" if support and min(share, firm) >= uf.REJECT else "allow")
    assert {r.verdict for r in got} == {"allow", "block"}


# --- decontamination -------------------------------------------------------

def canon(text):
    t = regex.sub(dc.NAME, lambda m: "\x01p" + m[0], (text or "").replace("\x01", " ")).lower()
    t = regex.sub(dc.NUMBER, lambda m: "\x01n" + m[0], t)
    t = regex.sub(dc.UNIT, lambda m: m[1] + "\x01u" + m[2], t)
    return regex.sub(dc.PUNCTUATION, "", t).split()


def windows(words, k):
    """(place, templates, words of that reading): names as placeholders, then as plain words where that differs."""
    plain = [w[2:] if w.startswith("\x01p") else w for w in words]
    for i in range(len(words) - k + 1):
        a, b = (tuple(w[:2] if w.startswith("\x01") else w for w in x[i:i + k]) for x in (words, plain))
        yield i, a, words[i:i + k]
        if a != b:
            yield i, b, plain[i:i + k]


def test_decontamination(spark):
    """Every document of the smallest table against every benchmark item."""
    k = dc.WINDOW
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    copies = bench.selectExpr("item_id + 1000000 AS doc_id", "concat('Once more: ', replace(text, '7', '8')) AS text")
    docs = docs.select("doc_id", "text").unionByName(copies)
    items = {r.item_id: canon(r.text) for r in bench.collect() if r.text is not None}
    index = defaultdict(list)
    for item, words in items.items():
        for i, t, form in windows(words, k):
            if sum(not w.startswith("\x01") for w in form) >= k - k // 2:
                index[t].append((item, i))
    n_bad = 0
    got = {r.doc_id: r for r in dc.decontaminate(docs, bench).collect()}
    for d in docs.collect():
        words, at = canon(d.text), defaultdict(set)
        for i, t, _ in windows(words, k):
            for item, j in index.get(t, ()):
                at[item, i - j].add(j)
        best = {}
        for (item, offset), places in at.items():
            inside = {w for j in places for w in range(j, j + k)}
            before, tears = {}, []
            for p in sorted(inside):
                a, b = items[item][p], words[p + offset]
                if a.startswith("\x01") and b.startswith("\x01"):
                    if a in before and before[a][1] != b:
                        tears.append((before[a][0], p))
                    before[a] = (p, b)
            most = 0
            for start in [0, *(x + 1 for x, _ in tears)]:
                stop = min((y for x, y in tears if x >= start), default=math.inf)
                most = max(most, sum(start <= w < stop for w in inside))
            if most >= dc.MIN_WORDS or most >= dc.MIN_SHARE * len(items[item]):
                best[item] = max(most, best.get(item, 0))
        r = got[d.doc_id]
        assert (r.items, r.contaminated, r.matched_words) == (sorted(best), bool(best), max(best.values(), default=0)), d.doc_id
        n_bad += bool(best)
    assert len(got) > n_bad > len(items) // 2


# --- quality classifier ----------------------------------------------------

@pytest.mark.parametrize("sum_rows, fan", [(100_000, 64), (20, 2)])
def test_ridge_is_the_dense_solution(spark, monkeypatch, sum_rows, fan):
    """Scores from summed normal equations, at one level of sums or several, are those of a dense least-squares solution."""
    monkeypatch.setattr(qc, "SUM_ROWS", sum_rows)
    monkeypatch.setattr(qc, "FAN", fan)
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r.score for r in qc.quality_scores(docs.repartition(9), labels, features=24).collect()}
    known = {r.doc_id: r.quality for r in labels.where("quality is not null").where(fold(F.col("doc_id"), 5) != 0).collect()}
    rows = docs.select("doc_id", "text", (F.pmod(F.xxhash64("doc_id", F.lit("apart")), F.lit(4)) == 0).alias("apart")).collect()
    table = qc.byte_classes()
    x = np.array([qc.statistics(r.text, table) for r in rows])
    y = np.array([known.get(r.doc_id, -1) for r in rows], float)
    apart = np.array([r.apart for r in rows])
    fit, hold = (y >= 0) & ~apart, (y >= 0) & apart
    rng = np.random.default_rng(5)
    w, b = rng.normal(0, 1 / qc.WIDTH, (x.shape[1], 24)), rng.uniform(0, 2 * np.pi, 24)
    spread = x[fit].std(0)
    z = np.clip((x - x[fit].mean(0)) / np.where(spread > 1e-9, spread, 1), -6, 6)
    z = np.hstack([np.ones((len(z), 1)), np.cos(z @ w + b) * math.sqrt(2 / 24)])
    beta = np.linalg.lstsq(np.vstack([z[fit], math.sqrt(qc.RIDGE) * np.eye(25)]), np.r_[y[fit], np.zeros(25)], rcond=None)[0]
    raw = z @ beta
    bins = np.floor(np.clip(raw[hold], -1, 2) / qc.STEP + 0.5)
    at = np.unique(bins)
    curve = pool_adjacent(at * qc.STEP, np.array([(bins == v).sum() for v in at], float), np.array([y[hold][bins == v].sum() for v in at]))
    want = np.interp(raw, *curve)
    assert np.allclose([got[r.doc_id] for r in rows], want, atol=1e-6)


def test_pools_are_isotonic():
    """Pools of adjacent violators against the max-min formula of isotonic regression."""
    rng = np.random.default_rng(2)
    for size in (1, 2, 9, 30):
        n = rng.integers(1, 9, size).astype(float)
        good = np.floor(rng.random(size) * (n + 1))
        x, share = pool_adjacent(np.arange(size, dtype=float), n, good)
        mean = lambda i, j: good[i:j + 1].sum() / n[i:j + 1].sum()
        fit = np.array([max(min(mean(j, k) for k in range(i, size)) for j in range(i + 1)) for i in range(size)])
        pools = [np.flatnonzero(np.isclose(fit, v)) for v in np.unique(np.round(fit, 12))]
        assert np.allclose(x, [np.average(p, weights=n[p]) for p in pools])
        assert np.allclose(share, np.maximum.accumulate([(good[p].sum() + 0.5) / (n[p].sum() + 1) for p in pools]))


# --- toxicity --------------------------------------------------------------

def test_viterbi_is_the_best_reading():
    """The decoded word is the cheapest of all readings of the lattice."""
    table = tx.class_table()
    rng = np.random.default_rng(4)
    logp = np.log(rng.dirichlet(np.ones(int(table.max()) + 62), (int(table.max()) + 62, int(table.max()) + 62)))
    for token in ["h3llo", "b@d", "s-t-u", "baad", "aab00", "x.y", "i1!", "$$o", "", "---", "a*c", "zz3zz"]:
        options = tx.candidates(token)
        costs = {}
        for path in itertools.product(*options):
            a, b, cost, word = 0, 0, 0.0, ""
            for letter, extra in path:
                if letter:
                    c = int(table[ord(letter)])
                    cost, word, a, b = cost + extra - float(logp[a, b, c]), word + letter, b, c
                else:
                    cost += extra
            cost -= float(logp[a, b, 0])
            costs[word] = min(cost, costs.get(word, math.inf))
        assert costs[tx.viterbi(token, logp, table)] == pytest.approx(min(costs.values()))
