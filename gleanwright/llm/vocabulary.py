"""Occurrences and records of every distinct term, with marks for rare and common ones.

Repeated rows of a record are first reduced to one, with map-side combining.
Records are hash-partitioned and ordered by identifier; every term keeps a
last-seen counter (occurrences, records, last record), so no per-record set is
held.  As a record lies in one partition, partial counters add up exactly: they
are merged by term with map-side combining, and a term found in a third of all
records is a few partial rows instead of one task's whole input.  Counters of a
task are handed on and emptied at a record's end when they pass ``flush_terms``,
which bounds memory and changes no figure.

Text is taken in its one look-alike form and lower case; a term is a longest
run of letters and digits.  Repeated rows of a record are one record, whose
text in a column is the greatest of its non-null ones.  Null or empty texts
hold no terms but their records count; rows without a record count nowhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanwright.llm.forms import rewriter
from gleanwright.session import checkpointed

TERM = re.compile(r"[^\W_]+")


def terms_of(text: str) -> list[str]:
    return TERM.findall(text)


def term_counts(rows: DataFrame, columns: list[str], written: dict[str, str], flush_terms: int = 400_000, partitions: int | None = None) -> DataFrame:
    """(term, occurrences, records) over rows (record, *columns); the row with a null term has
    the number of all records as ``records``."""
    kept = rows.where(F.col("record").isNotNull())
    kept = kept.repartition(partitions, "record") if partitions else kept
    # One row per record, combined before the shuffle; the sort by record is the one of the grouping.
    single = kept.groupBy("record").agg(*[F.max(c).alias(c) for c in columns]).sortWithinPartitions("record")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = rewriter(written)
        seen: dict[str | None, list] = {}

        def handed() -> pd.DataFrame:
            out = pd.DataFrame(
                {"term": list(seen), "occurrences": [x[0] for x in seen.values()], "records": [x[1] for x in seen.values()]},
                columns=["term", "occurrences", "records"],
            )
            seen.clear()
            return out

        for batch in batches:
            total = seen.setdefault(None, [0, 0, None])
            total[1] += len(batch)
            for record, *texts in zip(batch["record"], *[batch[c] for c in columns], strict=True):
                for text in texts:
                    if not isinstance(text, str):
                        continue
                    for term in TERM.findall(one(text).lower()):
                        counter = seen.get(term)
                        if counter is None:
                            seen[term] = [1, 1, record]
                        else:
                            counter[0] += 1
                            if counter[2] != record:
                                counter[1] += 1
                                counter[2] = record
                if len(seen) > flush_terms:
                    yield handed()
        if seen:
            yield handed()

    partial = single.mapInPandas(count, "term string, occurrences bigint, records bigint")
    return partial.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked(counts: DataFrame, rare: int = 1, common_share: tuple[int, int] = (1, 5)) -> DataFrame:
    """``term_counts`` with ``mark``: ``rare`` in at most ``rare`` records, ``common`` in more than the share of
    all records, null between.  A term that is both (tiny collections) is marked twice."""
    top, bottom = common_share
    counted = checkpointed(counts)  # read twice: the number of records, and the terms
    records = counted.where("term IS NULL").agg(F.coalesce(F.sum("records"), F.lit(0)).alias("n")).first().n
    is_common = F.col("records") * bottom > records * top
    marks = F.filter(
        F.array(F.when(F.col("records") <= rare, "rare"), F.when(is_common, "common")), lambda x: x.isNotNull()
    )
    return counted.where("term IS NOT NULL").select("term", "occurrences", "records", F.explode_outer(marks).alias("mark"))
