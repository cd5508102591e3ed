"""Text rules of the evidence model, as columns.

Four rules stay apart: ``normal`` (composed, trimmed, case-folded), ``label``
(composed, trimmed), ``collapsed`` (single blanks, case kept) and ``query_form``
(composed, lower case, single blanks).  Composition and case folding have no
built-in expression, so those run in Arrow batches; the rest is JVM-side.
Null gives null everywhere.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Joiners and apostrophes that belong to words.
WORD_EXTRA = "‌‍'’"


def _each(values: pd.Series, one) -> pd.Series:
    known: dict[str, str] = {}
    out = []
    for v in values:
        if not isinstance(v, str):
            out.append(None)
            continue
        if v not in known:
            known[v] = one(v)
        out.append(known[v])
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.StringType())
def normal(values: pd.Series) -> pd.Series:
    """Composed, trimmed, case-folded."""
    return _each(values, lambda v: unicodedata.normalize("NFC", v.strip()).casefold())


@F.pandas_udf(T.StringType())
def label(values: pd.Series) -> pd.Series:
    """Composed and trimmed; a control character or more than 4000 code points gives null."""

    def one(v: str) -> str | None:
        v = unicodedata.normalize("NFC", v.strip())
        return None if not v or len(v) > 4000 or any(unicodedata.category(c) == "Cc" for c in v) else v

    return _each(values, one)


@F.pandas_udf(T.StringType())
def _composed_query(values: pd.Series) -> pd.Series:
    return _each(values, lambda v: " ".join(unicodedata.normalize("NFC", v).lower().split()))


def query_form(value: Column) -> Column:
    """Composed, lower case, outer blanks cut, inner blanks single.  Texts of ASCII characters
    need no composition and take built-in expressions."""
    ascii_ = F.octet_length(value) == F.char_length(value)
    plain = F.trim(F.regexp_replace(F.lower(value), r"[\x09-\x0d\x1c-\x20]+", " "))
    return F.when(ascii_, plain).otherwise(_composed_query(F.when(~ascii_, value)))


def collapsed(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"[\s ]+", " "))


def words(value: Column, at_least: int = 1) -> Column:
    """Lower-case runs of letters and digits."""
    found = F.regexp_extract_all(F.lower(value), F.lit(r"[\p{L}\p{N}]+"), 0)
    return found if at_least <= 1 else F.filter(found, lambda w: F.length(w) >= at_least)


def title_form(value: Column) -> Column:
    """Words and joiners, for seed overlap."""
    return F.regexp_extract_all(F.lower(value), F.lit(rf"[\p{{L}}\p{{N}}\p{{M}}{WORD_EXTRA}]+"), 0)
