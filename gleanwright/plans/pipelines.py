"""Queries that run through sources, sinks and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanwright.functions.text import normal
from gleanwright.session import checkpointed, shared_folder, table
from gleanwright.sources import records, texts
from gleanwright.streaming import ingest

SQL: dict[str, str] = {}


def stream_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Events replayed as a file stream into a store, delivered twice, then read by type."""
    source = table(spark, folder, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("observed_at"), "event_type", "value")
    base = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    for delivery in ("first", "second"):
        source.write.parquet(f"{base}/in/{delivery}")
        stream = spark.readStream.schema(source.schema).parquet(f"{base}/in/{delivery}")
        ingest.ingest(stream, f"{base}/store", f"{base}/log-{delivery}").awaitTermination()
    found = checkpointed(spark.read.parquet(f"{base}/store").groupBy("event_type").agg(F.count("*").alias("rows"), F.min("id").alias("first_id"), F.max("id").alias("last_id")))
    place = spark._jvm.org.apache.hadoop.fs.Path(base)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return found


SQL["stream_ingest"] = "SELECT event_type, count(*) AS rows, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY event_type"


def record_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Videos and media in the common record form, counted by what is measured."""
    videos = records.records(table(spark, folder, "videos")).withColumn("platform", F.lit("videos"))
    media = records.records(table(spark, folder, "media")).withColumn("platform", F.lit("media"))
    both = videos.unionByName(media)
    return both.groupBy("platform").agg(
        F.count("*").alias("rows"), F.count_distinct("record_id").alias("records"), F.count("author").alias("authors"), F.count("views").alias("with_views"),
        F.sum(F.col("views").cast("double")).alias("views"), F.sum(F.col("likes").cast("double")).alias("likes"), F.count("saves").alias("with_saves"),
    )


SQL["record_forms"] = """
SELECT 'videos' AS platform, count(*) AS rows, count(DISTINCT id) AS records, count(channel_id) AS authors, count(view_count) AS with_views, sum(view_count::DOUBLE) AS views, sum(like_count::DOUBLE) AS likes, count(save_count) AS with_saves FROM videos
UNION ALL SELECT 'media', count(*), count(DISTINCT id), count(owner), count(views), sum(views::DOUBLE), sum(likes::DOUBLE), count(saved) FROM media"""


def native_export_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "observed_evidence")
    found = records.native_export(rows, "phrase", "value", {"evidence_kind": "unknown"}, {"metric": "metric", "unit": "unit"})
    return found.groupBy("metric", "unit", "availability", "censored").agg(F.count("*").alias("rows"), F.count("value").alias("numbers"), F.count("label").alias("labels"), F.max("value").alias("largest"))


SQL["native_export_rows"] = r"""
WITH t AS (SELECT trim(metric) AS metric, trim(unit) AS unit, trim(value) AS v FROM observed_evidence WHERE trim(phrase) <> ''),
s AS (SELECT *, v IS NULL OR v IN ('', '-', '—', 'N/A', 'n/a') AS gone, coalesce(regexp_matches(v, '^[<>~≈]') OR regexp_full_match(v, '\d+\s*[-–]\s*\d+'), false) AS c, CASE WHEN regexp_full_match(v, '[+-]?\d+(,\d{3})*(\.\d+)?%?') THEN replace(replace(v, ',', ''), '%', '')::DOUBLE END AS n FROM t)
SELECT metric, unit, CASE WHEN gone THEN 'unavailable' ELSE 'observed' END AS availability, NOT gone AND c AS censored, count(*) AS rows, count(n) AS numbers, count(*) FILTER (WHERE NOT gone AND n IS NULL) AS labels, max(n) AS largest FROM s GROUP BY ALL"""


def visible_pages(spark: SparkSession, folder: str) -> DataFrame:
    """All documents read as pages: visible text without mark-up, and their paragraphs."""
    documents = table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", "text")
    paragraphs = texts.html_rows(documents, "doc_id", "text", "p").groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.sum(F.length("text")).alias("characters"))
    shown = documents.select("doc_id", F.length(texts.visible_html(F.col("text"))).alias("visible"))
    return shown.join(paragraphs, "doc_id", "left").select("doc_id", "visible", F.coalesce("paragraphs", F.lit(0)).alias("paragraphs"), F.coalesce("characters", F.lit(0)).alias("characters"))


def folded_sources(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select(normal(F.coalesce("lang", F.lit("?"))).alias("lang"), "source")
    return rows.groupBy("lang").agg(F.count("*").alias("documents"), F.count_distinct("source").alias("sources"))


SQL["folded_sources"] = "SELECT lower(trim(coalesce(lang, '?'))) AS lang, count(*) AS documents, count(DISTINCT source) AS sources FROM documents GROUP BY 1"

QUERIES = [stream_ingest, record_forms, native_export_rows, visible_pages, folded_sources]
