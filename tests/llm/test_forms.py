from __future__ import annotations

import random
import unicodedata

import pytest

from gleanwright.llm import forms

LATIN = {chr(c): 10 for c in range(32, 127)}


@pytest.fixture(scope="module")
def one():
    return forms.Rewriter(forms.representatives(LATIN))


@pytest.mark.parametrize(
    ("written", "form"),
    [
        ("ｅｄｉｔｓ　＃ｔ", "edits #t"), ("señorial", "señorial"), ("oﬃce ﬁnal", "office final"), ("t​e­a﻿", "tea"), ("a b c　d", "a b c d"),
        ("a\r\nb\rc d", "a\nb\nc\nd"), ("  a \n", "a"), ("ѕһоԝ Ѕһоԝ", "show Show"), ("օνеr", "over"), ("е́", "é"), ("ї", "ï"), ("K", "K"), ("ﾊﾞ", "バ"),
        ("Straße", "Straße"), ("STRASSE", "STRASSE"), ("cafe", "cafe"), ("a  b", "a  b"), ("a\nb", "a\nb"), ("…", "…"), ("²", "²"), ("👩‍🎤", "👩‍🎤"), ("", ""), (" ​ ", ""), ("#a_1!", "#a_1!"),
    ],
)
def test_forms(one, written, form):
    assert one(written) == form
    assert one(form) == form


def test_null_and_very_long(one):
    assert one(None) is None
    assert one("ѕ" * 200_000) == "s" * 200_000


def test_classes_are_disjoint_and_transitive():
    seen: dict[str, int] = {}
    for n, group in enumerate(forms.look_alike_classes()):
        for x in group:
            assert x not in seen
            seen[x] = n
    assert seen["ο"] == seen["о"] == seen["o"] == seen["ｏ"]
    assert seen.get("I") != seen.get("l")


def test_representative_is_the_most_frequent_code_point():
    assert forms.Rewriter(forms.representatives({"а": 50, "a": 3}))("a") == "а"
    assert forms.Rewriter(forms.representatives({}))("а") == "a"


def test_random_variants_come_out_equal(one):
    rng = random.Random(2)
    swap = {v: k for k, vs in forms.SAME_SHAPE.items() for v in vs[:1]}
    back = {k: v for v, k in swap.items()}
    for _ in range(300):
        text = "".join(rng.choice("abcdefghijopqsuvwxyz ABEHKMOPT#é") for _ in range(40)).strip()
        variant = "".join(back.get(c, c) if rng.random() < 0.4 else c for c in text)
        variant = "".join(c + ("​" if rng.random() < 0.1 else "") for c in variant)
        if rng.random() < 0.5:
            variant = unicodedata.normalize("NFD", variant)
        assert one(variant) == one(text)


def test_pairs_match_brute_force(spark, one):
    rng = random.Random(4)
    spellings = ["tea", "t​ea", "tеa", "ｔｅａ", "Tea", "te a", "tea!", None, "", " "]
    data = [(f"i{rng.randrange(25)}", rng.choice(spellings)) for _ in range(120)]
    frame = spark.createDataFrame(data, "id string, text string")
    want = {(a, b) for a, x in data for b, y in data if a < b and x is not None and y is not None and x != y and one(x) == one(y)}
    written = forms.representatives(LATIN)
    for salt in (4096, 2):
        got = [tuple(r) for r in forms.look_alike_pairs(frame, written, salt).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    classes = {r.id: r for r in forms.look_alike_classes_of(frame.where("text = 'tea' OR text = 'tеa'"), written).collect()}
    assert all(r.spellings == 2 for r in classes.values())


def test_many_copies_of_one_text(spark):
    """The work follows the pairs that come out, not the square of the copies."""
    copies = spark.range(60_000).selectExpr("concat('c', id) AS id", "'tea' AS text")
    odd = spark.createDataFrame([("x", "t\u200bea"), ("y", "t\u0435a"), ("c1", "te\u0430")], "id string, text string")
    pairs = forms.look_alike_pairs(copies.unionAll(odd), forms.representatives(LATIN))
    # x and y with each copy and with each other, c1's other spelling with all of them
    assert pairs.count() == 2 * 60_000 + 1 + (60_000 - 1)


def test_counts_and_empty_table(spark):
    frame = spark.createDataFrame([("ааa",), (None,), ("ﬁ fi",)], "text string")
    counts = {r.member: r.n for r in forms.member_counts(frame).collect()}
    assert counts["а"] == 2 and counts["a"] == 1 and counts["ﬁ"] == 1
    empty = spark.createDataFrame([], "text string")
    assert forms.fit_forms(empty)["а"] == "a"
    assert forms.look_alike_pairs(spark.createDataFrame([], "id string, text string"), {"а": "a"}).collect() == []
