
import numpy as np

from abode.llm import toxicity
from abode.llm.decontaminate import decontaminate
from abode.llm.url_filter import UrlRule, url_filter


def verdicts(spark, urls, **more):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return {r["url"]: r for r in url_filter(pages, **more).join(pages, "page_id").collect()}


def test_rule_free_urls_are_judged_by_what_is_around_them(spark):
    """No rule fits /en/ of a .com host, and no label is on its templates."""
    urls = [f"http://bad.com/de/{i}" for i in range(20)] + ["http://bad.com/en/1", "http://bad.com/new/a/b.html", "http://bad.com"]
    urls += [f"http://even.com/{s}/{i}" for s in ("de", "fr") for i in range(20)] + ["http://even.com/en/1"]
    urls += [f"http://few.com/de/{i}" for i in range(3)] + ["http://few.com/en/1", "http://unknown.net/en/1"]
    got = verdicts(spark, urls)
    rule_free = {u: r["verdict"] for u, r in got.items() if r["rule"] is None}
    assert rule_free == {"http://bad.com/en/1": "block", "http://bad.com/new/a/b.html": "block", "http://bad.com": "block",
                         "http://even.com/en/1": "allow", "http://few.com/en/1": "allow", "http://unknown.net/en/1": "allow"}
    assert got["http://bad.com/en/1"]["template_labels"] == 0 and got["http://bad.com/en/1"]["support"] == 20


def test_a_branch_decides_before_its_host(spark):
    rules = (UrlRule("block", "a.com", "/x/bad"), UrlRule("allow", "a.com", "/y/"), UrlRule("allow", "a.com", "/x/mine/good"))
    urls = [f"http://a.com/x/bad/p{i}" for i in range(12)] + [f"http://a.com/y/p{i}" for i in range(60)]
    urls += ["http://a.com/x/free", "http://a.com/z/free", "http://a.com/x/mine/else"] + [f"http://a.com/x/mine/good{i}" for i in range(30)]
    got = verdicts(spark, urls, rules=rules)
    assert got["http://a.com/z/free"]["verdict"] == "allow" and got["http://a.com/x/mine/else"]["verdict"] == "allow"
    got = verdicts(spark, [u for u in urls if "mine" not in u], rules=rules)
    assert got["http://a.com/x/free"]["verdict"] == "block" and got["http://a.com/z/free"]["verdict"] == "allow"


ITEM = "On Monday the baker, Anna, sold eleven loaves to Tom and then Maria bought two small cakes for the old man in Rome"


def found(spark, item, *texts):
    """(contaminated, matched words) of each text."""
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r["contaminated"], r["matched_words"]) for r in sorted(decontaminate(docs, bench).collect())]


def test_copies_in_another_letter_case(spark):
    n = len(ITEM.split())
    copies = [ITEM, ITEM.upper(), ITEM.title(), ITEM.lower(), "Before. " + ITEM.swapcase() + " after", ITEM.replace("Anna", "Paula")]
    assert found(spark, ITEM, *copies) == [(True, n)] * len(copies)
    assert found(spark, ITEM.title(), *copies) == [(True, n)] * 5 + [(True, n - 5)]


def test_all_windows_of_an_alignment_count(spark):
    """Two runs of nine words, one word between them replaced, cover 18 words."""
    item = [f"word{'abcdefghijklmnopqrstuvwxyz'[i]}" for i in range(24)]
    two = [w if i in range(9) or i in range(10, 19) else "other" for i, w in enumerate(item)]
    one = [w if i < 9 else "other" for i, w in enumerate(item)]
    assert found(spark, " ".join(item), " ".join(two), " ".join(one), " ".join(item)) == [(True, 18), (False, 0), (True, 24)]


def test_an_alignment_is_cut_at_an_inconsistent_slot(spark):
    item = ("the plant runs 5 machines that each make many small parts of steel and of brass every hour "
            "until late at night so that the shop has 5 widgets left for its own staff")
    w = item.split()
    n, second = len(w), [i for i, x in enumerate(w) if x == "5"][1]
    one = w[:second] + ["9"] + w[second + 1:]
    ends = w[:14] + ["7" if i % 2 else "other" for i in range(second - 13)] + w[second + 1:]
    shape = "then 7 birds saw 7 cats and 7 dogs near 7 old houses by 7 small rivers all day long"
    many = shape.replace("7", "{}").format(1, 2, 3, 4, 5)
    assert found(spark, item, item, " ".join(one), " ".join(ends), item.replace("5", "8")) == [
        (True, n), (True, max(second, n - w.index("5") - 1)), (True, 14), (True, n)]
    assert found(spark, shape, many) == [(False, 0)]


def test_slots_between_the_windows_say_nothing(spark):
    """Both ends of the item are verbatim; another number stands in the replaced middle."""
    a, b = "we keep 5 of our old boats near the long wooden pier", "and we sail them out to the deep blue bay each spring with 5 men"
    middle = "where 5 men paint them"
    got = found(spark, f"{a} {middle} {b}", f"{a} some 6 crews wash these {b}")
    assert got == [(True, len(a.split()) + len(b.split()))]


def test_spaced_and_doubled_words_are_restored():
    weights = {"idiot": 8.0, "stupid": 8.0, "^stup": 8.0}
    model = np.log(0.5 * toxicity.smoothed(np.ones(toxicity.N ** 3)) + 0.5 * toxicity.smoothed(toxicity.lexicon_counts(weights)))
    s = toxicity.Scorer(weights, model)
    for noisy in ("a s t u p i d man", "a s t u p i d m a n", "i d i o t.", "(i d i o t)", "i d i o t, y o u", "id io t", "st up id", "i d 1 0 t.",
                  "stuupid", "iddiot", "s t u u p i d", "idioot!"):
        assert s.raw(f"the and {noisy} of") == 8.0, noisy
    assert s.raw("s t u p i d i d i o t") == 16.0
    for plain in ("a letter will do as it is", "to be or no id in it", "1 2 3 4 5 6 7", "good food, a tall tree"):
        assert s.raw(plain) == 0.0, plain
