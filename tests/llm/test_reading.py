from __future__ import annotations

import random

import pytest

from gleanwright.llm import forms, reading

WRITTEN = forms.representatives({chr(c): 10 for c in range(32, 127)})
EASY = ["the {0} is red and it is big", "we see a {0} on the mat", "can you like this {0} now", "he and i play with the {0}"]
HARD = ["although the {0} remains substantial, the interpretation of its distribution was questioned by every researcher", "the commission recommended that the {0} should be evaluated through independent documentation", "it would nevertheless be irresponsible to describe the {0} without appropriate measurement"]
NOUNS = ["song", "drum", "list", "market", "category", "report", "archive"]


def text_of(rng, templates, n, mark=". "):
    return mark.join(rng.choice(templates).format(rng.choice(NOUNS)).capitalize() for _ in range(n)) + "."


@pytest.fixture(scope="module")
def samples():
    rng = random.Random(1)
    return [(text_of(rng, EASY, 8), 1) for _ in range(15)] + [(text_of(rng, HARD, 5), 4) for _ in range(15)]


def test_held_out_accuracy(samples):
    model, rng = reading.train(samples), random.Random(2)
    for band, templates in ((1, EASY), (4, HARD)):
        for mark in (". ", ".\n- ", "\n"):
            assert reading.grade(text_of(rng, templates, 14, mark), model)[0] == band
    mixed = text_of(rng, HARD, 9) + " " + text_of(rng, EASY, 4)
    assert reading.grade(mixed, model)[0] == 4


def test_what_is_no_case(spark, samples):
    rng = random.Random(3)
    german = " ".join("Das Team prüfte die Liste und ergänzte noch eine Seite vor Freitag." for _ in range(12))
    docs = [
        (1, text_of(rng, EASY, 20)), (2, text_of(rng, HARD, 8)), (3, "The song is red."), (4, None), (5, ""), (6, german), (7, "#song #drum " * 60), (8, '{"a": [1, 2],\n' * 80), (9, "query,clicks\n" + "song drum,1\n" * 90),
        (10, german + " " + text_of(rng, EASY, 9)), (11, text_of(rng, EASY, 20).upper()), (12, "<p>" + text_of(rng, HARD, 8, ".</p>\n<p>") + "</p>"), (13, text_of(rng, EASY, 3000)),
    ]
    frame = spark.createDataFrame([(*d, "x") for d in docs] + [(*docs[0], "x")], "doc_id bigint, text string, band string")
    graded = spark.createDataFrame(samples + [(None, 3), ("", 2), ("Odd one here.", None)], "text string, band bigint")
    got = {r.doc_id: r.band for r in reading.reading_bands(frame, graded, WRITTEN).collect()}
    assert got == {1: 1, 2: 4, 11: 1, 12: 4, 13: 1}
    assert reading.reading_bands(frame.where("false"), graded, WRITTEN).collect() == []
    with pytest.raises(ValueError):
        reading.reading_bands(frame, graded, WRITTEN, max_samples=5)
    with pytest.raises(ValueError):
        reading.train([])
