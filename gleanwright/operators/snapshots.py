"""What changed between consecutive full snapshots of a stream.

Keys of a stream get ordinals; a snapshot is then a compressed bitmap of
ordinals and, for each value column, a vector aligned with them.  Additions are
the later bitmap AND-NOT the earlier, removals the reverse, and changes come
from comparing the vectors at the common ordinals.

A stream's keys are spread over as many blocks as its rows need (the key's hash
decides, so a key stays in its block through all snapshots), and a stream that
holds a third of all rows is many blocks.  A task numbers the keys of several
blocks at once and compares the snapshots of one number with those of the next,
whatever streams they are of.  ``snapshot_changes`` compares all snapshots of a table; ``next_snapshot``
compares one new snapshot with a saved state, in which every key has had its
ordinal since it was first seen, and reads nothing else.  Of a snapshot delivered several times the rows of the latest delivery
are the snapshot.  Rows without stream, date or key take no part; rows of one
key are summarised before the comparison (``values``); a stream's first
snapshot yields nothing; a null value is a value of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanwright.session import checkpointed, small

CHUNK = 1 << 16
ARRAY_LIMIT = 4096


class Bitmap:
    """Ordinals in chunks of 65,536: a sorted array while sparse, a bit set when dense."""

    def __init__(self, ordinals: np.ndarray) -> None:
        self.chunks: dict[int, np.ndarray] = {}
        high = ordinals // CHUNK
        for chunk in np.unique(high):
            self.chunks[int(chunk)] = self._packed((ordinals[high == chunk] % CHUNK).astype(np.uint16))

    @staticmethod
    def _packed(low: np.ndarray) -> np.ndarray:
        if len(low) <= ARRAY_LIMIT:
            return np.unique(low)
        bits = np.zeros(CHUNK, dtype=np.uint8)
        bits[low] = 1
        return np.packbits(bits)

    @staticmethod
    def _bits(part: np.ndarray) -> np.ndarray:
        if part.dtype == np.uint8:
            return part
        bits = np.zeros(CHUNK, dtype=np.uint8)
        bits[part] = 1
        return np.packbits(bits)

    def _with(self, other: Bitmap, keep: bool) -> np.ndarray:
        found = []
        for chunk, part in self.chunks.items():
            theirs = other.chunks.get(chunk)
            if theirs is None:
                low = np.empty(0, dtype=np.uint16) if keep else self._low(part)
            elif part.dtype == np.uint16 and theirs.dtype == np.uint16:
                low = part[np.isin(part, theirs, assume_unique=True, invert=not keep)]
            else:
                mask = self._bits(theirs)
                low = self._low(self._bits(part) & (mask if keep else ~mask))
            found.append(low.astype(np.int64) + chunk * CHUNK)
        return np.concatenate(found) if found else np.empty(0, dtype=np.int64)

    @staticmethod
    def _low(part: np.ndarray) -> np.ndarray:
        return part if part.dtype == np.uint16 else np.flatnonzero(np.unpackbits(part)).astype(np.uint16)

    def and_not(self, other: Bitmap) -> np.ndarray:
        return self._with(other, keep=False)

    def both(self, other: Bitmap) -> np.ndarray:
        return self._with(other, keep=True)


def snapshot_list(rows: DataFrame, stream: list[str], observed: str, delivered: str, block_rows: int) -> DataFrame:
    """(stream, observed_on, delivered, at, next_on, blocks): the snapshots of each stream in
    order, with the time of the latest delivery and the number of blocks for the stream's rows."""
    found = rows.dropna(subset=[*stream, observed]).groupBy(*stream, F.col(observed).alias("observed_on")).agg(F.max(delivered).alias("delivered"), F.count("*").alias("n"))
    order = Window.partitionBy(*stream).orderBy("observed_on")
    blocks = F.ceil(F.sum("n").over(Window.partitionBy(*stream)) / block_rows).cast("int")
    return found.select(*stream, "observed_on", "delivered", F.row_number().over(order).alias("at"), F.lead("observed_on").over(order).alias("next_on"), blocks.alias("blocks"))


def snapshot_changes(rows: DataFrame, stream: list[str], observed: str, delivered: str, item: str, values: dict[str, Column], block_rows: int = 200_000) -> DataFrame:
    """(stream, observed_on DATE, item, change_kind added | removed | changed).

    ``values``: an aggregate for each compared column, over the rows of one key in a snapshot.
    The list of snapshots goes to every task if it is small; a longer one is joined by shuffle."""
    inner = [f"__s{k}" for k in range(len(stream))]  # whatever the columns are called
    rows = rows.withColumns({i: F.col(c) for i, c in zip(inner, stream, strict=True)})
    snapshots = checkpointed(snapshot_list(rows, inner, observed, delivered, block_rows))
    marks = {c: f"__{c}" for c in snapshots.columns}
    placed = snapshots.select(*[F.col(c).alias(m) for c, m in marks.items()])
    on = F.col(delivered).eqNullSafe(F.col("__delivered")) & (F.col(observed) == F.col("__observed_on"))
    for c in inner:
        on = on & (F.col(c) == F.col(marks[c]))
    # Rows without a key go on to the tasks: a filter would compute every key once more.
    current = rows.join(small(placed), on).withColumn("__block", F.expr(f"int(pmod(xxhash64(`{item}`), greatest(__blocks, 1)))"))
    # Repeated rows of a key are summed up before the shuffle, then blocks are brought together.
    place = [*[F.col(c) for c in inner], *[F.col(f"__{c}").alias(c) for c in ("block", "at", "observed_on", "next_on")], F.col(item).alias("item")]
    summed = current.groupBy(*place).agg(*[v.alias(k) for k, v in values.items()])
    facts = summed.repartition(*inner, "block").sortWithinPartitions(*inner, "block")
    names, group = list(values), [*inner, "block"]
    found = facts.mapInPandas(by_blocks(group, lambda rows, which: changes(rows, which, inner, names)), f"{_fields(facts, inner)}, observed_on date, item string, change_kind string")
    return found.select(*[F.col(i).alias(c) for i, c in zip(inner, stream, strict=True)], "observed_on", "item", "change_kind")


def _fields(rows: DataFrame, names: list[str]) -> str:
    kinds = dict(rows.dtypes)
    return ", ".join(f"`{c}` {kinds[c]}" for c in names)


def by_blocks(group: list[str], work, at_once: int = 200_000):
    """``work(rows, which)`` on whole groups of rows that follow each other with the same ``group``
    values, several at a time; ``which`` numbers the groups."""

    def numbered(rows: pd.DataFrame) -> np.ndarray:
        new = np.zeros(len(rows), dtype=bool)
        for c in group:
            values = rows[c].to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return np.cumsum(new)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < at_once:
                continue
            rows = pd.concat(held, ignore_index=True)
            which = numbered(rows)
            end = np.searchsorted(which, which[-1])  # the last group may go on
            held = [rows.iloc[end:]]
            if end:
                yield from nonempty([work(rows.iloc[:end], which[:end])])
        if held and (rows := pd.concat(held, ignore_index=True)).size:
            yield from nonempty([work(rows, numbered(rows))])

    return run


def nonempty(frames: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    if frames := [f for f in frames if len(f)]:
        yield pd.concat(frames)


class Snapshot:
    """The keys present at one time: their ordinals, and where their values stand."""

    def __init__(self, number: np.ndarray, rows: np.ndarray) -> None:
        order = np.argsort(number)
        self.number, self.rows = number[order], rows[order]
        self.bitmap = Bitmap(self.number)

    def rows_of(self, number: np.ndarray) -> np.ndarray:
        return self.rows[np.searchsorted(self.number, number)]


NONE = Snapshot(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))


def compared(earlier: Snapshot, later: Snapshot, vectors: list[tuple[np.ndarray, np.ndarray]]) -> dict[str, np.ndarray]:
    """Ordinals added, removed and changed.  vectors: (whether empty, value) of each row."""
    common = later.bitmap.both(earlier.bitmap)
    p, q = later.rows_of(common), earlier.rows_of(common)
    differs = np.zeros(len(common), dtype=bool)
    for empty, vector in vectors:
        differs |= (empty[p] != empty[q]) | (~empty[p] & ~empty[q] & (vector[p] != vector[q]))
    return {"added": later.bitmap.and_not(earlier.bitmap), "removed": earlier.bitmap.and_not(later.bitmap), "changed": common[differs]}


def _vectors(block: pd.DataFrame, names: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(block[c].isna().to_numpy(), block[c].fillna(0).to_numpy()) for c in names]


def numbers_of(which: np.ndarray, items: np.ndarray) -> np.ndarray:
    """An ordinal for each key of each block, by the order of blocks and of first sight."""
    codes, keys = pd.factorize(items)
    return pd.factorize(which * max(len(keys), 1) + codes)[0].astype(np.int64)


def changes(rows: pd.DataFrame, which: np.ndarray, stream: list[str], names: list[str]) -> pd.DataFrame:
    """Changes of whole blocks: (*stream, item, at, observed_on, next_on, *names)."""
    keyed = rows["item"].notna().to_numpy()
    rows, which = (rows, which) if keyed.all() else (rows[keyed], which[keyed])
    number, items = numbers_of(which, rows["item"].to_numpy()), rows["item"].to_numpy()
    vectors = _vectors(rows, names)
    at, observed, following = rows["at"].to_numpy(), rows["observed_on"].to_numpy(), rows["next_on"].to_numpy()
    places: list[np.ndarray] = []
    dates: list[np.ndarray] = []
    kinds: list[np.ndarray] = []

    def told(kind: str, place: np.ndarray, when: np.ndarray) -> None:
        places.append(place)
        dates.append(when)
        kinds.append(np.full(len(place), kind, dtype=object))

    by_at = np.argsort(at, kind="stable")
    known, starts = np.unique(at[by_at], return_index=True)
    taken = {int(k): Snapshot(number[r], r) for k, r in zip(known, np.split(by_at, starts[1:]), strict=True)}
    for k in sorted(taken.keys() | {k + 1 for k in taken}):
        earlier, later = taken.get(k - 1, NONE), taken.get(k, NONE)
        found = compared(earlier, later, vectors)
        for kind in ("added", "changed"):
            place = later.rows_of(found[kind])
            if k > 1:  # a stream's first snapshot yields nothing
                told(kind, place, observed[place])
        place = earlier.rows_of(found["removed"])
        place = place[~pd.isna(following[place])]  # a stream's last snapshot has none after it
        told("removed", place, following[place])
    if not places:
        return pd.DataFrame(columns=[*stream, "observed_on", "item", "change_kind"])
    place = np.concatenate(places)
    named = {c: rows[c].to_numpy()[place] for c in stream}
    return pd.DataFrame({**named, "observed_on": np.concatenate(dates), "item": items[place], "change_kind": np.concatenate(kinds)})


def new_state(delivery: DataFrame, stream: list[str], names: list[str]) -> DataFrame:
    """A state without keys, for the first delivery."""
    kinds = dict(delivery.dtypes)
    fields = f"{_fields(delivery, stream)}, item string, ordinal bigint, present boolean, " + ", ".join(f"`{c}` {kinds[c]}" for c in names)
    return delivery.sparkSession.createDataFrame([], fields)


def next_snapshot(state: DataFrame, delivery: DataFrame, stream: list[str], names: list[str], blocks: int = 64) -> DataFrame:
    """A new snapshot of some streams against the saved state: (*stream, item, ordinal, present,
    *names, observed_on, change_kind).

    delivery: one row per key, (*stream, observed_on, item, *names), of one snapshot of each of
    its streams.  All keys of the state come back with their ordinals, new keys with the next
    ones of their block.  Rows with a ``change_kind`` are the changes; without the last two
    columns all rows are the next state.  A stream without delivery stays as it is; the first
    snapshot of a stream has no change.  ``blocks`` must stay the same for one state."""
    block = F.expr(f"int(pmod(xxhash64(item), {blocks}))").alias("block")
    streams = delivery.groupBy(*stream).agg(F.max("observed_on").alias("observed_on"))
    # Whether a stream is new is told by its keys of any block.
    old = state.select(*stream).distinct().withColumn("seen", F.lit(True))
    told = streams.join(old, stream, "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    kept = state.select(*stream, block, "item", "ordinal", "present", *names).join(told, stream, "left").withColumn("at", F.lit(0))
    fresh = delivery.select(*stream, block, "item", F.lit(None).cast("bigint").alias("ordinal"), F.lit(True).alias("present"), *names).join(told, stream).withColumn("at", F.lit(1))
    rows = kept.unionByName(fresh).repartition(*stream, "block").sortWithinPartitions(*stream, "block", "at")
    columns = [*stream, "item", "ordinal", "present", *names, "observed_on", "change_kind"]
    return rows.mapInPandas(by_blocks([*stream, "block"], lambda b, which: deliveries(b, which, stream, names)[columns]), f"{_fields(rows, columns[:-1])}, change_kind string")


def deliveries(rows: pd.DataFrame, which: np.ndarray, stream: list[str], names: list[str]) -> pd.DataFrame:
    """Whole blocks of a state (at 0) with what was delivered (at 1)."""
    at, there = rows["at"].to_numpy(), rows["present"].to_numpy(dtype=bool)
    number, places = numbers_of(which, rows["item"].to_numpy()), np.arange(len(rows))
    # A key's row is that of the delivery or else the one it had, with the ordinal it had or the
    # next one of its block.
    last, held = np.zeros(number.max() + 1, dtype=np.int64), np.full(number.max() + 1, -1, dtype=np.int64)
    last[number[at == 0]] = places[at == 0]
    last[number[at == 1]] = places[at == 1]
    held[number[at == 0]] = rows["ordinal"].to_numpy()[at == 0].astype(np.int64)
    block = which[last]
    highest = pd.Series(held).groupby(block).transform("max").to_numpy()
    fresh = held < 0
    ordinal = np.where(fresh, highest + pd.Series(fresh).groupby(block).cumsum().to_numpy(), held)
    earlier, later = Snapshot(number[(at == 0) & there], places[(at == 0) & there]), Snapshot(number[at == 1], places[at == 1])
    out = rows.iloc[last]
    took_part, seen = out["observed_on"].notna().to_numpy(), out["seen"].to_numpy(dtype=object) == True  # noqa: E712
    kinds = np.full(len(last), None, dtype=object)
    for kind, keys in compared(earlier, later, _vectors(rows, names)).items():
        kinds[keys] = kind
    kinds[~(took_part & seen)] = None
    present = np.where(took_part, out["at"].to_numpy() == 1, there[last])
    return out.assign(ordinal=ordinal, present=present, change_kind=kinds)
