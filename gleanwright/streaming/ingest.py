"""Continuous ingest of observations: idempotent append, late rows kept, change alerts.

The batch views read the same tables as of a time, so a late row only adds to
what later reads see.  The alert stream keeps, per watch and identity, the newest
observations in state and tells changes as they arrive, late rows included.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleanwright.operators.monitor import comparable_reason, signature
from gleanwright.sources.sinks import append_new


def ingest(stream: DataFrame, store: str, checkpoint: str, key: str = "id", now_column: str | None = None) -> StreamingQuery:
    """Appends each new observation once; rows captured after ``now_column`` are left out."""

    def write(batch: DataFrame, _: int) -> None:
        rows = batch.where(F.col("observed_at") <= F.col(now_column)) if now_column else batch
        append_new(rows, store, key)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_within(stream: DataFrame, key: str, at: str, delay: str) -> DataFrame:
    """Drops repeats that arrive within the delay, with bounded state."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, at: str, keys: list[str], width: str = "7 days", slide: str | None = None, delay: str = "1 day", start: str | None = None) -> DataFrame:
    """Counts and sums per window once the watermark has passed its end: completed periods only."""
    window = F.window(at, width, slide or width, start)
    return stream.withWatermark(at, delay).groupBy(window, *keys).agg(F.count("*").alias("rows"), F.sum("value").alias("total"))


def sessions(stream: DataFrame, at: str, keys: list[str], gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    return stream.withWatermark(at, delay).groupBy(F.session_window(at, gap), *keys).agg(F.count("*").alias("rows"))


COMPARED = ("identity", "id", "value", "availability", "approximate", "censored", "completeness", "scope", "window", "unit", "geography", "evidence_kind", "normalization_id", "period_start", "period_end")


def change_pairs(stream: DataFrame, keys: list[str], at: str, fields: list[str], keep: int = 32, idle: str | None = None) -> DataFrame:
    """(keys, before, after): structs of ``at`` and the fields of the two newest observations of a
    key, whenever a row makes them other ones; a late row does so too if it lies between them.

    State holds the ``keep`` newest observations of a key; older rows can't be of the two newest.
    Two rows of one time that differ are a conflict, and their key is silent as long as they are
    kept.  With ``idle`` (milliseconds) the state of a key without rows for so long is dropped; that
    needs a trigger that goes on, since one that ends when all is read waits for the timeouts."""
    kinds = dict(stream.dtypes)
    row = "struct<" + ", ".join(f"`{c}`: {kinds[c]}" for c in (at, *fields)) + ">"
    out = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", before string, after string"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = json.loads(state.get[0]) if state.exists else []
        told = state.get[1] if state.exists else None
        found = []
        arrived = sorted((int(m), r) for frame in frames for m, r in zip(frame["micros"], frame["row"], strict=True))
        for one in arrived:
            if list(one) in recent:
                continue
            recent = sorted([*recent, list(one)])[-keep:]
            pair = json.dumps([x[1] for x in recent[-2:]])
            clash = any(a[0] == b[0] for a, b in zip(recent, recent[1:], strict=False))
            if len(recent) > 1 and not clash and pair != told:
                found.append((*key, recent[-2][1], recent[-1][1]))
                told = pair
        state.update((json.dumps(recent), told))
        if idle is not None:
            state.setTimeoutDuration(int(idle))
        if found:
            yield pd.DataFrame(found, columns=[*keys, "before", "after"])

    plain = stream.where(F.col(at).isNotNull()).select(*keys, F.unix_micros(F.col(at).cast("timestamp")).alias("micros"), F.to_json(F.struct(at, *fields)).alias("row"))
    pairs = plain.groupBy(*keys).applyInPandasWithState(step, out, "recent string, told string", "append", "ProcessingTimeTimeout" if idle is not None else "NoTimeout")
    return pairs.select(*keys, F.from_json("before", row).alias("before"), F.from_json("after", row).alias("after"))


def change_alerts(stream: DataFrame, keys: list[str], at: str, value: str, min_change: float = 1.0, keep: int = 32, idle: str | None = None) -> DataFrame:
    """(keys, observed_at, before, after, delta): changes of at least ``min_change`` between the two
    newest observations of a key.  Rows of the whole observation schema must also be comparable
    as the monitor asks; a row without a value changes nothing."""
    whole = all(c in stream.columns for c in COMPARED)
    fields = [c for c in COMPARED if c != at] if whole else [value]
    pairs = change_pairs(stream.where(F.col(value).isNotNull()), keys, at, fields, keep, idle)
    if whole:
        pairs = pairs.where(comparable_reason("before", "after").isNull())
    delta = F.col(f"after.{value}") - F.col(f"before.{value}")
    out = pairs.select(*keys, F.col(f"after.{at}").alias("observed_at"), F.col(f"before.{value}").alias("before"), F.col(f"after.{value}").alias("after"), delta.alias("delta"))
    return out.where(F.abs("delta") >= min_change)


def conflicting(stream: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """(keys, at) of captures of one time that differ, once the watermark has passed them."""
    sig = F.xxhash64(signature(stream))
    counted = stream.withColumn("_s", sig).withWatermark(at, delay).groupBy(*keys, at).agg(F.min("_s").alias("lo"), F.max("_s").alias("hi"))
    return counted.where("lo <> hi").select(*keys, at)
