"""Byte-pair encoding of a corpus by a public vocabulary, as recursive queries in DuckDB.

Each task loads the merge table once into an in-process DuckDB.  Texts are cut
into words by the vocabulary's pattern; words not met before by the task become
token-position rows, and one recursive query contracts in every word the
left-most pair of minimum rank until no pair is left (all disjoint occurrences
of that pair in one step: a pair that holds a just-made token always ranks
higher, so the result is the same).  The query keeps one row for each byte of a
word, whatever the number of steps, so words of any length take it.  Ordered
aggregation gives the ids of each word, a lookup those of each text.  No
shuffle; a bounded memory of word ids is kept between batches.

Every byte is a token, so any text can be encoded; decoding gives it back.
Empty and null texts give an empty list.  Special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import importlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

DEFAULT_VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the public pre-tokenisation pattern of this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Every step contracts each unfinished word once; a byte whose token went into the one before it
# keeps its row without a token.  A finished word yields no row and so stays as it is.
CONTRACT = """
WITH RECURSIVE state(word, pos, tok) USING KEY (word, pos) AS (
  SELECT word, pos, tok FROM cut
  UNION ALL
  (WITH paired AS (
      SELECT word, pos, tok, lead(tok) OVER (PARTITION BY word ORDER BY pos) AS following FROM state WHERE tok IS NOT NULL
    ), ranked AS (
      SELECT p.*, m.made, min(m.made) OVER (PARTITION BY p.word) AS least FROM paired p LEFT JOIN merges m ON m.a = p.tok AND m.b = p.following
    ), hits AS (
      SELECT *, coalesce(made = least, false) AS hit FROM ranked WHERE least IS NOT NULL
    ), runs AS (
      SELECT *, row_number() OVER w - sum(hit::INT) OVER w AS run FROM hits WINDOW w AS (PARTITION BY word ORDER BY pos ROWS UNBOUNDED PRECEDING)
    ), chosen AS (
      SELECT *, hit AND (row_number() OVER (PARTITION BY word, run, hit ORDER BY pos)) % 2 = 1 AS takes FROM runs
    ), marked AS (
      SELECT *, coalesce(lag(takes) OVER (PARTITION BY word ORDER BY pos), false) AS taken FROM chosen
    )
    SELECT word, pos, CASE WHEN taken THEN NULL WHEN takes THEN least ELSE tok END AS tok FROM marked)
)
SELECT word, list(tok ORDER BY pos) AS ids FROM state WHERE tok IS NOT NULL GROUP BY word
"""


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    """Where the installed public vocabularies lie."""
    return importlib.import_module("public_tokenizers").path(name)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def merge_rows(ranks: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """(a, b, made) for every pair of tokens whose bytes together are a token."""
    rows = []
    for token, made in ranks.items():
        for cut in range(1, len(token)):
            a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
            if a is not None and b is not None:
                rows.append((a, b, made))
    return rows


class Encoder:
    """The vocabulary in one in-process DuckDB; encodes lists of words."""

    def __init__(self, path: str, memory: str = "400MB", remembered: int = 200_000) -> None:
        import duckdb
        import pyarrow as pa
        import regex

        ranks = read_ranks(path)
        self.byte_ids = [ranks[bytes([x])] for x in range(256)]
        self.pattern = regex.compile(PATTERN)
        self.pa, self.known, self.remembered = pa, {}, remembered
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": memory, "temp_directory": ""})
        merges = list(zip(*merge_rows(ranks), strict=True))
        self.db.register("merge_rows", pa.table({k: pa.array(v, pa.int32()) for k, v in zip(("a", "b", "made"), merges, strict=True)}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merge_rows")
        self.db.unregister("merge_rows")

    def learn(self, words: list[str], characters: int = 200_000) -> None:
        """Ids of new words, in blocks of bounded size."""
        block, size = [], 0
        for word in sorted(words, key=len):
            block.append(word)
            size += len(word)
            if size >= characters:
                self._learn(block)
                block, size = [], 0
        if block:
            self._learn(block)

    def _learn(self, words: list[str]) -> None:
        which, pos, tokens = [], [], []
        for k, word in enumerate(words):
            data = word.encode("utf-8", "surrogatepass")
            which.extend([k] * len(data))
            pos.extend(range(len(data)))
            tokens.extend(self.byte_ids[x] for x in data)
        pa, db = self.pa, self.db
        db.register("cut", pa.table({"word": pa.array(which, pa.int32()), "pos": pa.array(pos, pa.int32()), "tok": pa.array(tokens, pa.int32())}))
        for k, ids in db.execute(CONTRACT).fetchall():
            self.known[words[k]] = ids
        db.unregister("cut")

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        cut = [self.pattern.findall(x) if isinstance(x, str) else [] for x in texts]
        fresh = list({w for words in cut for w in words if w not in self.known})
        self.learn(fresh)
        known = self.known
        out = [[i for w in words for i in known[w]] for words in cut]
        if len(known) > self.remembered:
            known.clear()
        return out


def encoded(texts: DataFrame, path: str, key: str = "doc_id", column: str = "text", rows_at_once: int = 2000) -> DataFrame:
    """(key, ids) of each row, in the order of the text."""
    schema = f"{key} {dict(texts.dtypes)[key]}, ids array<int>"

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = None
        for batch in batches:
            encoder = encoder or Encoder(path)
            for start in range(0, len(batch), rows_at_once):
                part = batch.iloc[start : start + rows_at_once]
                yield pd.DataFrame({key: part[key].to_numpy(), "ids": encoder.encode(part[column].tolist())}, columns=[key, "ids"])

    return texts.select(key, column).mapInPandas(encode, schema)


def decode(ids: list[int], ranks: dict[bytes, int]) -> str:
    back = {v: k for k, v in ranks.items()}
    return b"".join(back[i] for i in ids).decode("utf-8", "surrogatepass")
