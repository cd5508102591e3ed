"""The registered queries of the text-corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwright.llm import bpe, forms, leakage, reading, together, vocabulary
from gleanwright.session import spread, table

MIN_SHARED, MIN_LIFT = 8, 10
LEAK_WORDS, BAND_WORDS = 10, 60


def captions(spark: SparkSession, folder: str) -> DataFrame:
    media = table(spark, folder, "media").select("id", F.col("caption").alias("text"))
    return spread(media.unionAll(table(spark, folder, "videos").select("id", F.col("caption").alias("text"))))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "text"))


def caption_forms(spark: SparkSession, folder: str) -> dict[str, str]:
    return forms.fit_forms(captions(spark, folder).select("text"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return forms.look_alike_pairs(captions(spark, folder), caption_forms(spark, folder))


def p1_classes(spark: SparkSession, folder: str) -> DataFrame:
    return forms.look_alike_classes_of(captions(spark, folder), caption_forms(spark, folder))


def tagged_rows(spark: SparkSession, folder: str) -> DataFrame:
    media = table(spark, folder, "media").select(F.concat(F.lit("media:"), "id").alias("basket"), "caption", F.lit(None).cast("array<string>").alias("tags"))
    return media.unionAll(table(spark, folder, "videos").select(F.concat(F.lit("videos:"), "id").alias("basket"), "caption", "tags"))


def _tags(spark: SparkSession, folder: str) -> DataFrame:
    return together.tag_items(spread(tagged_rows(spark, folder)), caption_forms(spark, folder))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return together.strong_pairs(_tags(spark, folder), MIN_SHARED, MIN_LIFT)


def p3_lift(spark: SparkSession, folder: str) -> DataFrame:
    return together.pair_counts(_tags(spark, folder)).drop("baskets")


def term_rows(spark: SparkSession, folder: str) -> DataFrame:
    posts = table(spark, folder, "posts").select(F.concat(F.lit("posts:"), "id").alias("record"), "title", "body")
    return posts.unionAll(table(spark, folder, "videos").select(F.concat(F.lit("videos:"), "id").alias("record"), F.lit(None).cast("string"), "caption"))


def p5_terms(spark: SparkSession, folder: str) -> DataFrame:
    rows = term_rows(spark, folder)
    written = forms.fit_forms(spread(rows).select(F.explode(F.array("title", "body")).alias("text")))
    return vocabulary.marked(vocabulary.term_counts(rows, ["title", "body"], written))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_terms(spark, folder).where(F.col("mark").isNotNull()).select("term", "mark")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encoded(documents(spark, folder), bpe.vocabulary_path())


def p8_spans(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "benchmark")
    written = forms.fit_forms(items.select("text"))  # which member is written has no bearing on equality
    return leakage.leaks(documents(spark, folder), items, written, LEAK_WORDS)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_spans(spark, folder).select("doc_id", "item_id")


def p8_clean(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that remain when those that leak a test item are removed."""
    return leakage.without_leaks(table(spark, folder, "documents").select("doc_id"), p8_spans(spark, folder))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    samples = table(spark, folder, "graded_samples")
    written = forms.fit_forms(samples.select("text"))  # the models' own spelling
    return reading.reading_bands(documents(spark, folder), samples, written, BAND_WORDS, mixed=True).select("doc_id", "band")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [p1_found, p1_classes, p3_found, p3_lift, p5_found, p5_terms, p7_ids, p8_found, p8_spans, p8_clean, p9_found]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {}
