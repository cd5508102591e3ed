from __future__ import annotations

import math
import random
from collections import Counter
from itertools import combinations

from gleanwright.llm import forms, together, vocabulary

WRITTEN = forms.representatives({chr(c): 10 for c in range(32, 127)})
ROWS = "basket string, caption string, tags array<string>"


def test_tags_of_captions_and_entries(spark):
    data = [
        ("a", "#One x#no (#Two #three! #４ä", [" #Four ", "five six", None, "#", ""]), ("b", None, None), ("c", "no tags", []), ("d", "＃Оne​\n#_u [#b]", None), ("e", "##x #", ["##y"]), ("a", "#one", None),
    ]
    got = {(r.basket, r.item) for r in together.tag_items(spark.createDataFrame(data, ROWS), WRITTEN).collect()}
    assert got == {("b", None), ("c", None)} | {("a", x) for x in ("one", "two", "three", "4ä", "four", "five six")} | {("d", "one"), ("d", "_u"), ("d", "b"), ("e", "y")}


def test_pair_counts_match_brute_force(spark):
    rng = random.Random(7)
    baskets = {f"b{k}": rng.sample("abcdefghij", rng.randrange(0, 7)) for k in range(200)}
    data = [(b, i) for b, items in baskets.items() for i in items for _ in range(rng.choice((1, 1, 2)))] + [(None, "a"), ("b1", None)]
    frame = spark.createDataFrame(data, "basket string, item string")
    single = Counter(i for items in baskets.values() for i in set(items))
    pairs = Counter(p for items in baskets.values() for p in combinations(sorted(set(items)), 2))
    frame = frame.unionAll(spark.createDataFrame([(b, None) for b in baskets], frame.schema))
    for least, block, bits in ((1, 512, 1 << 20), (20, 512, 1 << 20), (20, 2, 64), (1, 3, 64)):
        got = {(r.item_a, r.item_b): r for r in together.pair_counts(frame, least, block, bits).collect()}
        assert set(got) == {p for p, n in pairs.items() if n >= least}
        for (a, b), r in got.items():
            lift = pairs[a, b] * 200 / (single[a] * single[b])
            assert (r.n_ab, r.n_a, r.n_b) == (pairs[a, b], single[a], single[b]) and math.isclose(r.lift, lift) and math.isclose(r.pmi, math.log2(lift))
    more = frame.unionAll(spark.createDataFrame([(f"x{k}", None) for k in range(1800)], frame.schema))
    strong = {tuple(r) for r in together.strong_pairs(more, 15, 10).collect()}
    assert strong == {p for p, n in pairs.items() if n >= 15 and n * 2000 >= 10 * single[p[0]] * single[p[1]]}
    for least in (1, 2):
        assert together.pair_counts(spark.createDataFrame([], "basket string, item string"), least).collect() == []


def test_rare_items_are_left_out_before_pairing(spark):
    often = spark.createDataFrame([("a",), ("b",)], "item string")
    test = together.may_be_often("x", often, 1 << 20)
    assert spark.sql(f"SELECT filter(array('a', 'b', 'c', 'd', null), x -> {test}) AS kept").first().kept == ["a", "b"]


def test_a_basket_of_many_items(spark):
    wide = spark.createDataFrame([("w", f"i{k:05d}") for k in range(1500)] + [("v", "i00001"), ("v", "i01499")], "basket string, item string")
    got = together.pair_counts(wide, 1, 100)
    assert got.count() == 1500 * 1499 // 2 and [tuple(r)[:3] for r in got.where("n_ab > 1").collect()] == [("i00001", "i01499", 2)]


def test_terms_match_brute_force_in_any_flush(spark):
    rng = random.Random(9)
    words = ["Song", "song", "tea", "tеa", "x_y", "42", "naïve", "naïve", "rare1"]
    data = {f"r{k}": (rng.choice([None, "", " ".join(rng.choices(words, k=5))]), rng.choice([None, " ".join(rng.choices(words[:4], k=8))])) for k in range(150)}
    data["r0"] = ("only once once", None)
    rows = [(k, *v) for k, v in data.items()] + [(k, v[0], None) for k, v in list(data.items())[:40]]
    frame = spark.createDataFrame(rows, "record string, title string, body string")
    one = forms.Rewriter(WRITTEN)
    occurrences, records = Counter(), Counter()
    for title, body in data.values():
        found = [t for x in (title, body) if x for t in vocabulary.terms_of(one(x).lower())]
        occurrences.update(found)
        records.update(set(found))
    for flush in (400_000, 1):
        got = {r.term: (r.occurrences, r.records) for r in vocabulary.term_counts(frame, ["title", "body"], WRITTEN, flush, 3).collect()}
        assert got == {None: (0, 150)} | {t: (occurrences[t], records[t]) for t in occurrences}
    marks = {(r.term, r.mark) for r in vocabulary.marked(vocabulary.term_counts(frame, ["title", "body"], WRITTEN)).collect()}
    assert ("once", "rare") in marks and ("song", "common") in marks and all((m == "rare") == (records[t] == 1) or m == "common" for t, m in marks if m)
    hot = {r.term: (r.occurrences, r.records) for r in vocabulary.term_counts(frame.unionAll(frame.where("record < 'r2'")), ["title", "body"], WRITTEN).collect()}
    assert hot == got
    empty = vocabulary.term_counts(spark.createDataFrame([], frame.schema), ["title", "body"], WRITTEN)
    assert empty.collect() == [] and vocabulary.marked(empty).collect() == []
