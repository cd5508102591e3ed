from __future__ import annotations

import random
from collections import Counter, defaultdict

from gleanwright.operators import terms

DOCS = [
    (1, "The quiet song's chorus - a quiet song, loved by all.\nQuiet song"), (2, "naïve lyric-sheet über-song 42 x"), (3, None), (4, ""), (5, "the and of"), (6, "song"), (7, "'tis the well-known- lyric"), (8, "Straße straße naïve"),
]


def frame(spark, data=DOCS):
    return spark.createDataFrame(data, "doc_id bigint, text string")


def local_brute(data):
    import re

    words = []
    for _, text in sorted(data, key=lambda d: d[0]):
        for w in re.findall("[A-Za-z][A-Za-z'’-]{2,}", text or ""):
            w = w.rstrip("'-").lower()
            if w not in terms.LOCAL_STOPWORDS:
                words.append(w)
    counts = Counter(words)
    counts.update(f"{a} {b}" for a, b in zip(words, words[1:]) if a != b)
    return counts


def test_local_counts_bridge_documents(spark):
    rng = random.Random(1)
    words = ["song", "lyric", "the", "quiet", "Chorus", "demo-", "x"]
    data = DOCS + [(100 + 7 * k, " ".join(rng.choices(words, k=rng.randrange(0, 9)))) for k in range(200)]
    rng.shuffle(data)
    got = {r.phrase: (r.occurrences, r.score) for r in terms.local_counts(frame(spark, data), "doc_id", "text").collect()}
    want = local_brute(data)
    top = max(want.values())
    assert {p: n for p, (n, _) in got.items()} == want
    assert all(abs(s - n / top) <= 0.00005 for n, s in got.values())
    assert terms.local_counts(frame(spark, []), "doc_id", "text").collect() == []


def test_literal_phrases_agree_with_spans(spark):
    by_columns = Counter(tuple(r) for r in terms.literal_phrases(frame(spark), "doc_id", "text").collect())
    by_spans = Counter((k, p) for k, t in DOCS if t for p, _, _ in terms.spans_of(t, 3))
    assert by_columns == by_spans
    assert (1, "quiet song's chorus") in by_columns and (1, "song loved") not in by_columns and (7, "well-known lyric") not in by_columns and (8, "strasse strasse naïve") in by_columns


def test_spans_are_kept_in_order(spark):
    got = {r.phrase: r for r in terms.phrase_spans(frame(spark, [(k, "song song") for k in range(30)]), "doc_id", "text", 1, 20).collect()}
    assert got["song"].occurrences == 60 and [(s.key, s.start, s.end) for s in got["song"].spans][:3] == [(0, 0, 4), (0, 5, 9), (1, 0, 4)] and len(got["song"].spans) == 20


def test_hashtag_variants(spark):
    data = [(1, "#a x#b ##c #d_e (#f) https://h.example/p#g /#h &#i #1 #Straße")]
    by = defaultdict(set)
    for variant in ("plain", "skip_urls", "strict", "lettered"):
        df = frame(spark, data).select(terms.hashtags(terms.folded("text"), variant).alias("t"))
        by[variant] = set(df.first().t)
    assert by["plain"] == {"#a", "#d_e", "#f", "#h", "#i", "#1", "#strasse"}
    assert by["skip_urls"] == by["plain"] and by["strict"] == by["plain"] - {"#h", "#i"} and by["lettered"] == by["plain"] - {"#1"}


def test_visible_text_and_post_terms(spark, rows):
    text = "> quoted tempo\nSee [my demo](http://x.example/a) `code tempo` in r/music by u/someone #Tag\n\n    indented tempo\nhttps://y.example/tempo lyric"
    got = {(c, t) for c, t, _, _ in rows(terms.post_terms(frame(spark, [(1, text)]), "doc_id", "text", 1, 1))}
    assert ("hashtag", "#tag") in got and ("community-mention", "r/music") in got and ("keyword", "demo") in got and ("keyword", "lyric") in got
    assert not any(t == "tempo" or "example" in t or t == "someone" for _, t in got)
