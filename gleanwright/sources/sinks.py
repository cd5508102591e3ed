"""Writers: JSON, phrase lists, tab-separated text, idempotent snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanwright.session import checkpointed


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def phrase_list(df: DataFrame, order: str) -> DataFrame:
    """One JSON array of phrases in order; for output of limited size."""
    rows = F.array_sort(F.collect_list(F.struct(order, "phrase")))
    return df.agg(F.to_json(F.transform(rows, lambda r: r["phrase"])).alias("phrases"))


def write_text(df: DataFrame, path: str) -> None:
    """phrase, tab, relationship and the score if there is one."""
    tail = F.when(F.col("score").isNotNull(), F.concat(F.lit(" ("), F.col("score"), F.lit(")"))).otherwise("")
    df.select(F.concat(F.col("phrase"), F.lit("\t"), F.col("relationship"), tail).alias("value")).write.mode("overwrite").text(path)


BUCKETS = 64  # directories of a store, by the hash of the key


def append_new(df: DataFrame, path: str, key: str = "id") -> int:
    """Appends rows whose key the store lacks, and tells how many; delivering rows again adds
    nothing.  The store is parted by the key's hash, so only the parts that a delivery touches
    are read, and of them only the key.  One writer at a time: files have no lock."""
    spark = df.sparkSession
    fresh = checkpointed(df.dropDuplicates([key]).withColumn("bucket", F.expr(f"int(pmod(xxhash64(`{key}`), {BUCKETS}))")))
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        touched = [r.bucket for r in fresh.select("bucket").distinct().collect()]  # at most BUCKETS rows
        known = spark.read.schema(f"`{key}` {dict(df.dtypes)[key]}, bucket int").parquet(path).where(F.col("bucket").isin(touched))
        fresh = fresh.join(known, ["bucket", key], "left_anti")
    found = checkpointed(fresh)
    found.select(*df.columns, "bucket").write.mode("append").partitionBy("bucket").parquet(path)
    return found.count()
