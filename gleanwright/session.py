"""Sessions and the folder for cut lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gleanwright")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it in spark.checkpoint.dir.
    Only where that is unset (tests on one machine) a folder of our own is used."""
    context = spark.sparkContext
    named = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="gleanwright-"))
        named = context.getCheckpointDir()
    return named


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts lineage in the shared folder."""
    folder = shared_folder(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, least: int = 64) -> DataFrame:
    """The rows over all cores when a scan has fewer partitions than that (a few small or
    unsplittable files) and costly work per row follows; scans of many splits stay as they are."""
    wanted = min(df.sparkSession.sparkContext.defaultParallelism, least)
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= wanted else df.repartition(wanted)


def partitioned(df: DataFrame, *keys: str) -> DataFrame:
    """The rows by key in as many partitions as the session sets for shuffles, none of which is
    joined with another for being small: costly work per row follows."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


SMALL_ROWS = 100_000  # rows of about 100 bytes that every task may hold


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Marked to be sent to every task if it has at most ``rows`` rows, which are counted first;
    a longer one is left to be joined by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
