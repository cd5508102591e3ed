"""p9_found counts words of English sentences only, whatever else a document holds."""

from __future__ import annotations

from gleanwright.llm import queries

EASY = "The song is red and it is big. We see a drum on the mat. Can you like this list now? He and I play with the song."
HARD = "Although the report remains substantial, the interpretation of its distribution was questioned by every researcher. It would nevertheless be irresponsible to describe the archive without appropriate measurement."
GERMAN = " ".join(["Das Team prüfte die Liste und ergänzte noch eine Seite vor Freitag."] * 30)


def test_english_among_more_of_another_language(spark, tmp_path):
    samples = [(n, EASY, 1) for n in range(4)] + [(n + 4, HARD, 4) for n in range(4)]
    spark.createDataFrame(samples, "sample_id bigint, text string, band bigint").write.parquet(f"{tmp_path}/graded_samples.parquet")
    docs = [(1, f"{GERMAN} {EASY} {EASY} {EASY}", "de"), (2, f"{GERMAN}\n{HARD} {HARD} {HARD}", None), (3, GERMAN, "en"), (4, f"{GERMAN} {EASY}", "de"), (5, f"{EASY} {EASY} {EASY}", "en")]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.band for r in queries.p9_found(spark, str(tmp_path)).collect()} == {1: 1, 2: 4, 5: 1}
