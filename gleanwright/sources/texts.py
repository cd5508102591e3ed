"""Readers of text corpora, subtitles and HTML."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUFFIXES = ("txt", "md", "lrc", "csv")  # fixed values


def bounded(documents: DataFrame, text: str, max_characters: int | None = None, max_documents: int | None = None) -> DataFrame:
    """The documents; reading them raises if all together hold more than ``max_characters`` or if
    they are more than ``max_documents``."""
    size = documents.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("c"))
    over = F.lit(False)
    for bound, column in ((max_documents, "n"), (max_characters, "c")):
        if bound is not None:
            over = over | (size.select(column).scalar() > bound)
    return documents.where(F.when(~over, True).otherwise(F.raise_error(F.lit("the texts are over their bound")).cast("boolean")))


def text_files(spark: SparkSession, *paths: str, max_characters: int | None = None) -> DataFrame:
    """(source, text): one row per file of a known suffix, without byte-order mark.  A file over
    ``max_characters`` raises when read; nothing is cut.  ``bounded`` bounds them together."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(SUFFIXES) + "}").text(list(paths), wholetext=True)
    text = F.regexp_replace("value", "^﻿", "")
    if max_characters is not None:
        text = F.when(F.length(text) <= max_characters, text).otherwise(F.raise_error(F.lit(f"a text is over {max_characters} characters")))
    return raw.select(F.col("_metadata.file_path").alias("source"), text.alias("text")).dropDuplicates(["source"])


def whole_corpus(documents: DataFrame, key: str, text: str) -> DataFrame:
    """All texts as one, in key order, parted by a blank line.  One row: for small corpora only."""
    return documents.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, text))), lambda x: x[text]), "\n\n").alias("text"))


CUE = r"(?:(\d+):)?(\d{2}):(\d{2})[.,](\d{3})\s+-->\s+(?:(\d+):)?(\d{2}):(\d{2})[.,](\d{3})[^\n]*\n([\s\S]*?)(?=\n\s*\n|$)"


def subtitles(files: DataFrame) -> DataFrame:
    """(source, id, start_seconds, end_seconds, description) of the cues of (source, text);
    exact repeats of a cue are dropped, overlapping ones kept; impossible clock times give no cue."""
    text = F.regexp_replace("text", r"\r\n?", "\n")
    cues = files.select("source", F.posexplode(F.regexp_extract_all(text, F.lit(CUE), 0)).alias("at", "cue"))
    part = lambda k: F.nullif(F.regexp_extract("cue", CUE, k), F.lit(""))

    def seconds(k: int) -> Column:
        return F.coalesce(part(k).cast("double"), F.lit(0.0)) * 3600 + part(k + 1).cast("double") * 60 + part(k + 2).cast("double") + part(k + 3).cast("double") / 1000

    body = plain(F.regexp_replace(part(9), "<[^>]*>", ""))
    out = cues.where((part(2).cast("int") < 60) & (part(3).cast("int") < 60) & (part(6).cast("int") < 60) & (part(7).cast("int") < 60)).select(
        "source", "at", seconds(1).alias("start_seconds"), seconds(5).alias("end_seconds"), F.trim(body).alias("description")
    ).where("description <> '' AND end_seconds >= start_seconds")
    first = out.groupBy("source", "start_seconds", "end_seconds", "description").agg(F.min("at").alias("at"))
    return first.select("source", F.concat_ws(":", "source", "at").alias("id"), "start_seconds", "end_seconds", "description")


@F.pandas_udf(T.StringType())
def plain(values: pd.Series) -> pd.Series:
    """Character references resolved."""
    return pd.Series([unescape(v) if isinstance(v, str) else None for v in values], dtype=object)


VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNSEEN = frozenset(("script", "style", "template", "noscript"))


class _Page(HTMLParser):
    """Elements of a page with their visible text, in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements: list[dict] = []
        self.open: list[dict] = []

    @property
    def hidden(self) -> bool:
        return any(e["hidden"] for e in self.open)

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        style = "".join(a.get("style", "").lower().split())
        gone = tag in UNSEEN or "hidden" in a or a.get("aria-hidden") == "true" or "hidden" in a.get("class", "").split() or "display:none" in style or "visibility:hidden" in style
        element = {"tag": tag, "attrs": a, "text": [], "hidden": gone, "under": list(self.open)}
        self.elements.append(element)
        if tag not in VOID:
            self.open.append(element)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k]["tag"] == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        if not self.hidden:
            for e in self.open:
                e["text"].append(data)


SIMPLE = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+|\[[\w-]+(?:=[\"']?[^\"'\]]*[\"']?)?\])*)")


def _step(element: dict, step: str) -> bool:
    m = SIMPLE.fullmatch(step)
    if not m:
        raise ValueError(f"unsupported selector: {step}")
    if m[1] and m[1] != "*" and m[1].lower() != element["tag"]:
        return False
    a = element["attrs"]
    for kind, name, value in re.findall(r"([.#\[])([\w-]+)(?:=[\"']?([^\"'\]]*)[\"']?)?", m[2]):
        if kind == "." and name not in a.get("class", "").split():
            return False
        if kind == "#" and a.get("id") != name:
            return False
        if kind == "[" and (name not in a or (value and a[name] != value)):
            return False
    return True


def _matches(element: dict, steps: list[str]) -> bool:
    if not _step(element, steps[-1]):
        return False
    above, rest = element["under"], steps[:-1]
    for e in reversed(above):
        if rest and _step(e, rest[-1]):
            rest = rest[:-1]
    return not rest


def select(html: str, selector: str) -> list[tuple[str, dict]]:
    """(visible text, attributes) of elements by tag, class, id and attribute selectors, joined
    by blanks for descendants and commas for alternatives; hidden elements give nothing."""
    page = _Page()
    page.feed(html)
    page.close()
    ways = [s.split() for s in selector.split(",")]
    out = []
    for e in page.elements:
        if not e["hidden"] and not any(u["hidden"] for u in e["under"]) and any(_matches(e, w) for w in ways):
            out.append((" ".join("".join(e["text"]).split()), e["attrs"]))
    return out


def html_rows(pages: DataFrame, key: str, html: str, selector: str, attribute: str | None = None) -> DataFrame:
    """(key, position, text, attribute): elements of each page that match a selector."""
    kind = dict(pages.dtypes)[key]

    def read(batches):
        for batch in batches:
            rows = []
            for k, page in zip(batch[key], batch[html], strict=True):
                if isinstance(page, str):
                    rows += [(k, n, text, attrs.get(attribute) if attribute else None) for n, (text, attrs) in enumerate(select(page, selector), 1)]
            if rows:
                yield pd.DataFrame(rows, columns=[key, "position", "text", "attribute"])

    return pages.select(key, html).mapInPandas(read, f"{key} {kind}, position int, text string, attribute string")


def visible_html(html: Column) -> Column:
    """Visible text of pages."""

    @F.pandas_udf("string")
    def read(values: pd.Series) -> pd.Series:
        out = []
        for v in values:
            if not isinstance(v, str):
                out.append(None)
                continue
            page = _Page()
            page.feed(f"<html-root>{v}</html-root>")
            page.close()
            out.append(" ".join("".join(page.elements[0]["text"]).split()))
        return pd.Series(out, dtype=object)

    return read(html)


def page_audit(pages: DataFrame, key: str, html: str, phrase: str) -> DataFrame:
    """Title, first headings and visible text of pages with how often they hold a phrase."""
    texts = pages.select(key, visible_html(F.col(html)).alias("visible"))
    for name in ("title", "h1"):
        found = html_rows(pages, key, html, name).groupBy(key).agg(F.array_join(F.array_agg("text"), " ").alias(name))
        texts = texts.join(found, key, "left")
    literal = F.lit("\\Q" + phrase.lower() + "\\E")
    return texts.select("*", *[F.coalesce(F.regexp_count(F.lower(c), literal), F.lit(0)).alias(f"{c}_matches") for c in ("title", "h1", "visible")])
