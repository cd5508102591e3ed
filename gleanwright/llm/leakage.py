"""Evaluation passages inside a training corpus, by suffix arrays of corpus shards.

A task turns its documents into word numbers (look-alike form, lower case, runs
of letters and digits), builds the suffix array of each shard of bounded size
and binary-searches every suffix of every test item in it.  The places that
share most words with a suffix lie next to where it would stand, so the common
lengths of neighbours, taken outwards from there, give the longest verbatim
match at every place; matches of at least ``min_words`` words are leaks.  Words that no test item holds cannot be part of a match, so
only runs of at least ``min_words`` test words enter a shard; this loses no
match.  The corpus is read once and never shuffled; only leaks are.

Null and empty texts leak nothing; items of fewer than ``min_words`` words
cannot leak; items with the same passage all count; repeated rows of a
document are one document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanwright.llm.forms import rewriter
from gleanwright.llm.vocabulary import TERM


class Items:
    """Test items as word numbers, with all their suffixes of at least ``min_words`` words."""

    def __init__(self, items: list[tuple[int, str]], written: dict[str, str], min_words: int) -> None:
        one = rewriter(written)
        self.number: dict[str, int] = {}
        sequences = []
        for item, text in items:
            if isinstance(text, str):
                words = TERM.findall(one(text).lower())
                sequences.append((item, [self.number.setdefault(w, len(self.number) + 1) for w in words]))
        starts = [(item, words[k:]) for item, words in sequences for k in range(len(words) - min_words + 1)]
        starts.sort(key=lambda x: x[1][:min_words])  # those of one beginning together
        self.depth = max([min_words, *(len(w) for _, w in starts)])
        self.item = np.array([i for i, _ in starts], dtype=np.int64)
        self.suffix = np.zeros((len(starts), self.depth), dtype=np.int32)  # 0 ends a suffix
        for row, (_, words) in enumerate(starts):
            self.suffix[row, : len(words)] = words


def suffix_array(x: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``x`` in the order of the words that follow, as far as ``depth`` words.
    Prefix doubling; 0 stands for an end and sorts first."""
    rank = x.astype(np.int64)
    done = 1
    while done < depth:
        after = np.zeros_like(rank)
        after[:-done] = rank[done:]
        top = int(rank.max()) + 1
        values, rank = np.unique(rank * top + after, return_inverse=True)
        rank = rank + 1
        done *= 2
        if len(values) == len(x):
            break
    return np.argsort(rank, kind="stable")


def _windows(x: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    return x[at[:, None] + np.arange(width)]


def _bounds(x: np.ndarray, order: np.ndarray, queries: np.ndarray, above: bool) -> np.ndarray:
    """For each query row the first place in the suffix array whose words are not less than
    (``above``: greater than) the query; all queries are searched at once."""
    width = queries.shape[1]
    low, high = np.zeros(len(queries), dtype=np.int64), np.full(len(queries), len(order), dtype=np.int64)
    while (open_ := low < high).any():
        middle = (low + high) // 2
        words = _windows(x, order[np.minimum(middle, len(order) - 1)], width)
        differs = words != queries
        first = differs.argmax(axis=1)
        rows = np.arange(len(queries))
        equal = ~differs[rows, first]
        less = np.where(equal, above, words[rows, first] < queries[rows, first])
        low = np.where(open_ & less, middle + 1, low)
        high = np.where(open_ & ~less, middle, high)
    return low


def _common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many words the rows of two tables share from their beginning; 0 is no word."""
    differs = (x != y) | (x == 0)
    return np.where(differs.any(axis=1), differs.argmax(axis=1), x.shape[1])


def neighbours(padded: np.ndarray, span: np.ndarray, depth: int, rows: int = 65536) -> np.ndarray:
    """Common lengths of each two neighbours of a stretch of the suffix array."""
    blocks = [span[k : k + rows + 1] for k in range(0, max(len(span) - 1, 0), rows)]
    return np.concatenate([np.empty(0, np.int64), *(_common(_windows(padded, b[:-1], depth), _windows(padded, b[1:], depth)) for b in blocks)])


def lengths_from(spot: int, before: int, after: int, near: np.ndarray, n: int) -> np.ndarray:
    """Common length of a suffix with every place of a stretch of ``n`` places, when it would stand
    at ``spot`` and shares ``before`` and ``after`` words with the places left and right of it."""
    left = np.minimum.accumulate(np.concatenate([[before], near[: max(spot - 1, 0)][::-1]]))[::-1] if spot else np.empty(0, np.int64)
    right = np.minimum.accumulate(np.concatenate([[after], near[spot:]])) if spot < n else np.empty(0, np.int64)
    return np.concatenate([left, right]).astype(np.int64)


def shard_leaks(keys: np.ndarray, x: np.ndarray, owner: np.ndarray, place: np.ndarray, items: Items, min_words: int) -> pd.DataFrame:
    """(key, item_id, words, start): the longest match of each document and item in a shard.
    x: word numbers with 0 between runs; owner: index of the document; place: word position."""
    order = suffix_array(x, items.depth)
    padded = np.concatenate([x, np.zeros(items.depth, dtype=x.dtype)])
    heads, of_head = np.unique(items.suffix[:, :min_words], axis=0, return_inverse=True)
    of_head = of_head.ravel()
    low, high = _bounds(padded, order, heads, False), _bounds(padded, order, heads, True)
    shared = np.flatnonzero((high > low)[of_head])  # suffixes with at least min_words words in the shard
    stands = _bounds(padded, order, items.suffix[shared], False)
    found, held = [np.empty((4, 0), dtype=np.int64)], 0
    head, span, near = -1, order[:0], order[:0]
    for row, spot in zip(shared, stands, strict=True):
        if of_head[row] != head:
            head = of_head[row]
            span = order[low[head] : high[head]]
            near = neighbours(padded, span, items.depth)
        at = int(spot - low[head])
        beside = [span[k] if 0 <= k < len(span) else None for k in (at - 1, at)]
        before, after = (int(_common(_windows(padded, np.array([k]), items.depth), items.suffix[row : row + 1])[0]) if k is not None else 0 for k in beside)
        found.append(np.stack([owner[span], np.full(len(span), items.item[row]), lengths_from(at, before, after, near, len(span)), place[span]]))
        held += len(span)
        if held > 1 << 20:
            found, held = [_longest(np.concatenate(found, axis=1))], 0
    key, item, words, start = _longest(np.concatenate(found, axis=1))
    return pd.DataFrame({"key": keys[key], "item_id": item, "words": words, "start": start})


def _longest(matches: np.ndarray) -> np.ndarray:
    """The longest match of each document and item, the first of equal ones.
    Rows: document, item, words, start."""
    document, item, words, start = matches = matches[:, np.lexsort((matches[3], -matches[2], matches[1], matches[0]))]
    return matches[:, np.flatnonzero(np.concatenate([[True], (np.diff(document) != 0) | (np.diff(item) != 0)])[: len(document)])]


def leaks(corpus: DataFrame, items: DataFrame, written: dict[str, str], min_words: int = 10, shard_words: int = 1_000_000, block_characters: int = 8_000_000) -> DataFrame:
    """(doc_id, item_id, words, start) of every corpus document (doc_id, text) that holds at
    least ``min_words`` consecutive words of an item (item_id, text).

    The items are a stated query set.  They go to the tasks in blocks of at most about
    ``block_characters`` characters; each block is one pass over the corpus."""
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = int(size // block_characters) + 1
    passes = []
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block) if blocks > 1 else items
        passes.append(_one_pass(corpus, [(r.item_id, r.text) for r in part.select("item_id", "text").distinct().collect()], written, min_words, shard_words))
    union = passes[0]
    for other in passes[1:]:
        union = union.unionAll(other)
    best = F.max_by(F.struct("words", "start"), F.struct("words", -F.col("start")))
    return union.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.words", "best.start")


def _one_pass(corpus: DataFrame, items: list[tuple[int, str]], written: dict[str, str], min_words: int, shard_words: int) -> DataFrame:
    shared = corpus.sparkSession.sparkContext.broadcast(items)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tests = Items(shared.value, written, min_words)
        one, number = rewriter(written), tests.number
        keys: list[int] = []
        runs: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        places: list[np.ndarray] = []
        held = 0

        def searched() -> Iterator[pd.DataFrame]:
            out = shard_leaks(np.array(keys), np.concatenate(runs), np.concatenate(owners), np.concatenate(places), tests, min_words)
            for x in (keys, runs, owners, places):
                x.clear()
            if len(out):
                yield out.rename(columns={"key": "doc_id"}).astype({"item_id": "int64", "words": "int64", "start": "int64"})

        if not len(tests.item):
            return
        for batch in batches:
            for key, text in zip(batch["doc_id"], batch["text"], strict=True):
                if not isinstance(text, str):
                    continue
                words = np.array([number.get(w, 0) for w in TERM.findall(one(text).lower())], dtype=np.int32)
                edges = np.flatnonzero(np.diff(np.concatenate([[0], words > 0, [0]]).astype(np.int8)))
                starts, ends = edges[::2], edges[1::2]
                long = ends - starts >= min_words
                for a, b in zip(starts[long], ends[long], strict=True):
                    runs.append(np.append(words[a:b], np.int32(0)))
                    owners.append(np.full(b - a + 1, len(keys), dtype=np.int64))
                    places.append(np.append(np.arange(a, b), b))
                    held += b - a + 1
                if long.any():
                    keys.append(key)
                if held >= shard_words:
                    yield from searched()
                    held = 0
        if held:
            yield from searched()

    return corpus.select("doc_id", "text").mapInPandas(search, f"doc_id {dict(corpus.dtypes)['doc_id']}, item_id bigint, words bigint, start bigint")


def without_leaks(corpus: DataFrame, found: DataFrame) -> DataFrame:
    """The corpus without the documents that leak an item."""
    return corpus.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
