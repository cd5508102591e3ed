"""Connectors: a paged Data Source over a fetcher, replay of saved responses, plugin registry.

A connector is a fetcher ``(seed, token) -> (rows, next_token)``.  Each seed is
a partition; pages of a seed follow each other and stop at the end.  A token met
before, or more pages than the budget, raise: a seed comes whole or not at all.  Network fetchers are
injected; here only replay of saved responses is built in.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "seed string, page int, position int, row string"


def pages(fetch: Callable[[str, str | None], tuple[list, str | None]], seed: str, budget: int) -> Iterable[tuple[int, list]]:
    token, seen = None, set()  # the first page has no token of its own
    for page in range(budget):
        rows, following = fetch(seed, token)
        yield page, rows
        if not following:
            return
        if following in seen:
            raise ValueError(f"seed {seed}: page {page} goes back to token {following}")
        seen.add(following)
        token = following
    raise ValueError(f"seed {seed} has more than {budget} pages: raise the option pages")


class Replay:
    """Serves saved responses ``<folder>/<seed>/<page>.json`` of {rows, next}."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def __call__(self, seed: str, token: str | None) -> tuple[list, str | None]:
        body = json.loads((Path(self.folder) / seed / f"{token or '0'}.json").read_text("utf-8-sig"))
        return body["rows"], body.get("next")


class _Seed(InputPartition):
    def __init__(self, seed: str) -> None:
        self.seed = seed


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.seeds = [s for s in options["seeds"].split("|") if s]
        self.budget = int(options.get("pages", "20"))
        self.fetch = FETCHERS[options.get("fetcher", "replay")](options)

    def partitions(self):
        return [_Seed(s) for s in self.seeds]

    def read(self, partition):
        for page, rows in pages(self.fetch, partition.seed, self.budget):
            for n, row in enumerate(rows):
                yield partition.seed, page, n, json.dumps(row, ensure_ascii=False, sort_keys=True)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


FETCHERS: dict[str, Callable[[dict], Callable]] = {"replay": lambda options: Replay(options["folder"])}


def read_pages(spark: SparkSession, seeds: list[str], **options: str) -> DataFrame:
    """(seed, page, position, row as JSON) of every page of the seeds."""
    spark.dataSource.register(PagedSource)
    reader = spark.read.format("paged").option("seeds", "|".join(seeds))
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


class Registry:
    """Operators by name.  Built-in names win over later ones; listing does not load them."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[str, Callable]] = {}

    def add(self, name: str, summary: str, operator: Callable) -> None:
        self.known.setdefault(name, (summary, operator))

    def get(self, name: str) -> Callable:
        if name not in self.known:
            raise KeyError(f"no operator {name}; known: {', '.join(sorted(self.known))}")
        return self.known[name][1]

    def describe(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, s) for k, (s, _) in sorted(self.known.items())], "name string, summary string")


def batch(registry: Registry, spark: SparkSession, tasks: list[dict]) -> tuple[DataFrame | None, DataFrame]:
    """Runs tasks {id, operator, options} in order: the union of their rows with ``task``, and
    a status per task.  A failed task is ``unavailable`` and stops no other, whether it fails as
    its plan is made or as its rows are read: each task's rows are written once to the shared
    folder, and read from there."""
    from pyspark.sql import functions as F

    from gleanwright.session import checkpointed

    results, status = None, []
    for task in tasks:
        try:
            rows = checkpointed(registry.get(task["operator"])(spark, **task.get("options", {})).withColumn("task", F.lit(task["id"])))
            results = rows if results is None else results.unionByName(rows, allowMissingColumns=True)
            status.append((task["id"], "ok", None))
        except Exception as e:  # noqa: BLE001 - reported, not hidden
            status.append((task["id"], "unavailable", f"{type(e).__name__}: {e}"[:500]))
    return results, spark.createDataFrame(status, "task string, status string, reason string")


def mapped_model(rows: DataFrame, column: str, output: str, load: Callable[[], Callable[[list], list]], batch_rows: int = 256) -> DataFrame:
    """Adds ``output`` from an injected model, loaded once per task (language models, encoders)."""
    fields = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)

    def run(batches):
        model = load()
        for pdf in batches:
            for start in range(0, len(pdf), batch_rows):
                part = pdf.iloc[start : start + batch_rows]
                yield part.assign(**{output: model(part[column].tolist())})

    return rows.mapInPandas(run, f"{fields}, `{output}` string")


# Words that introduce a list in a model's answer, the signs between its items, and
# the length of a usable phrase.
LIST_LABELS = ("keyword", "keywords", "related", "related concept", "related concepts", "related word", "related words")
ITEM_SIGNS = (";", ",", "|")
PHRASE_LENGTH = (2, 80)


def phrases_in_answer(answers: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, phrase): the distinct phrases of each list answer, at their first place.

    An item ends with its line, at a sign or before a number that counts the next one; labels,
    bullets and outer punctuation go, blanks become single, case is folded.  Null answers and
    items too short or too long give nothing."""
    from pyspark.sql import functions as F

    from gleanwright.functions.text import collapsed, normal

    labels = "|".join(sorted(LIST_LABELS, key=len, reverse=True)).replace(" ", r"\s+")
    bare = F.regexp_replace(F.col(text), rf"(?im)^\s*(?:{labels})\s*:", "")
    ends = "|".join([r"\R", *(f"\\Q{c}\\E" for c in ITEM_SIGNS), r"\s(?=\d+[.)]\s)"])
    items = answers.select(F.col(key), F.posexplode(F.split(bare, ends)).alias("position", "item"))
    marks = r"[\s\p{Pd}\p{Po}\p{Pi}\p{Pf}`\"'*•.)]"
    inner = F.regexp_replace(F.regexp_replace("item", r"^(?:[\s*•.)-]|\d+(?=[\d.)\s]))+", ""), f"^{marks}+|{marks}+$", "")
    shown = items.select(key, "position", normal(collapsed(inner)).alias("phrase")).where(F.length("phrase").between(*PHRASE_LENGTH))
    return shown.groupBy(key, "phrase").agg(F.min("position").alias("position")).select(key, "position", "phrase")
