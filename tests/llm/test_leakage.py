from __future__ import annotations

import random

import numpy as np

from gleanwright.llm import forms, leakage
from gleanwright.llm.vocabulary import terms_of

WRITTEN = forms.representatives({chr(c): 10 for c in range(32, 127)})
DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, text string"


def longest(document, item):
    """(words, start in the document) of the longest common run."""
    best = (0, 0)
    table = [[0] * (len(item) + 1) for _ in range(len(document) + 1)]
    for i, w in enumerate(document):
        for j, v in enumerate(item):
            if w == v:
                n = table[i + 1][j + 1] = table[i][j] + 1
                best = max(best, (n, -(i - n + 1)))
    return best[0], -best[1]


def test_suffix_array():
    rng = np.random.default_rng(2)
    for _ in range(30):
        x = np.concatenate([np.append(rng.integers(1, 4, rng.integers(1, 40)), 0) for _ in range(3)]).astype(np.int32)
        order = leakage.suffix_array(x, 300)
        assert list(order) == sorted(range(len(x)), key=lambda i: list(x[i:]))


def test_leaks_match_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(12)]
    items = [(k, " ".join(rng.choices(words, k=rng.randrange(3, 30)))) for k in range(20)]
    items += [(20, items[0][1] + " tail"), (21, None), (22, "")]
    docs = []
    for k in range(60):
        text = [rng.choice(words + ["zzz"]) for _ in range(rng.randrange(0, 60))]
        if k % 3 == 0 and items[k % 20][1]:
            passage = items[k % 20][1].split()
            a = rng.randrange(0, max(1, len(passage) - 6))
            text[rng.randrange(0, len(text) + 1) : 0] = passage[a : a + rng.randrange(4, 20)]
        docs.append((k, rng.choice([" ", "\n", ", ", "* | "]).join(text).upper() if k % 2 else " ".join(text)))
    docs += [(60, None), (61, ""), (62, docs[0][1])]
    want = {}
    for d, text in docs:
        for i, item in items:
            if text and item:
                n, start = longest(terms_of(text.lower()), terms_of(item))
                if n >= 6:
                    want[d, i] = (n, start)
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    for shard in (1_000_000, 30):
        got = {(r.doc_id, r.item_id): (r.words, r.start) for r in leakage.leaks(d, i, WRITTEN, 6, shard, 400 if shard == 30 else 8_000_000).collect()}
        assert got == want and len(want) > 15
    clean = {r.doc_id for r in leakage.without_leaks(d, leakage.leaks(d, i, WRITTEN, 6)).collect()}
    assert clean == {x for x, _ in docs} - {x for x, _ in want}


def test_empty_tables(spark):
    d, i = spark.createDataFrame([(1, "a b c")], DOCS), spark.createDataFrame([(1, "a b c")], ITEMS)
    assert leakage.leaks(d.where("false"), i, WRITTEN, 2).collect() == []
    assert leakage.leaks(d, i.where("false"), WRITTEN, 2).collect() == []
    assert [tuple(r) for r in leakage.leaks(d.unionAll(d), i, WRITTEN, 2).collect()] == [(1, 1, 3, 0)]


def test_look_alikes_and_marks_do_not_hide_a_leak(spark):
    passage = "the restless meadow of jusujax holds many phrases and moved some"
    hidden = "Тhe rеstless, ｍｅａｄｏｗ of\nJusu­jax HOLDS | many — phrases and moved some!"
    d, i = spark.createDataFrame([(5, "intro " + hidden)], DOCS), spark.createDataFrame([(9, passage)], ITEMS)
    assert [tuple(r) for r in leakage.leaks(d, i, WRITTEN, 10).collect()] == [(5, 9, 11, 1)]
