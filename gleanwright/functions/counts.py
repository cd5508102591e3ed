"""Number rules: exact counts, compact displays, censored and bounded values.

A missing measurement is null, never zero; a value such as ``<1`` or ``<100``
is censored and never becomes a number.  Invalid text gives null (use the
``*_valid`` predicates to reject such rows).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COUNT = r"^\d{1,31}(?:\.0+)?$"
# What the suffixes of compact displays stand for.
SUFFIX = {"K": 1_000, "M": 1_000_000, "B": 1_000_000_000}


def exact_count(text: Column) -> Column:
    """DECIMAL(38,0) of a nonnegative whole number; null for anything else."""
    t = F.trim(text.cast("string"))
    value = F.regexp_extract(t, r"^(\d{1,31})(?:\.0+)?$", 1)
    number = F.when(t.rlike(COUNT), value).cast("decimal(38,0)")
    return F.when(number <= F.lit("1e30").cast("decimal(38,0)"), number)


def display_count(text: Column) -> Column:
    """STRUCT(value DECIMAL(38,0), approximate BOOLEAN) of ``1,234``, ``2.1M`` or ``17``."""
    t = F.trim(text)
    factor = F.create_map(*[x for k, v in SUFFIX.items() for x in (F.lit(k), F.lit(v))])
    compact = r"^(\d+(?:\.\d+)?)\s*([KkMmBb])$"
    scaled = F.regexp_extract(t, compact, 1).try_cast("decimal(20,9)") * F.try_element_at(factor, F.upper(F.regexp_extract(t, compact, 2))).cast("decimal(12,0)")
    grouped = F.when(t.rlike(r"^\d{1,3}(?:,\d{3})+$"), F.replace(t, F.lit(","), F.lit(""))).otherwise(t)
    return F.when(t.rlike(compact), F.struct(F.floor(scaled).cast("decimal(38,0)").alias("value"), F.lit(True).alias("approximate"))).otherwise(
        F.struct(exact_count(grouped).alias("value"), F.lit(False).alias("approximate"))
    )


def is_censored(text: Column) -> Column:
    return F.coalesce(F.trim(text).rlike(r"^[<>]\s*\d"), F.lit(False))


def measured(text: Column) -> Column:
    """DOUBLE of a plain, grouped or percent number; null for labels, censored and missing values."""
    t = F.regexp_replace(F.trim(text), r"(?<=\d),(?=\d{3})|%$", "")
    return F.when(t.rlike(r"^[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?$"), t.try_cast("double"))


def missing_unless(value: Column, allowed: Column) -> Column:
    return F.when(allowed, value)


def null_if_sentinel(value: Column, from_actor: Column, sentinel: int = -1) -> Column:
    """A provider's sentinel is missing, only in that provider's rows."""
    return F.when(from_actor & (value == sentinel), None).otherwise(value)


def percent_change(before: Column, after: Column, base: str = "signed") -> Column:
    """(after - before) / base * 100; null for a zero base.  base: ``signed``, ``absolute``, or
    ``positive`` (null unless the base is above zero)."""
    under = F.abs(before) if base == "absolute" else before
    ratio = F.try_divide((after - before) * 100.0, under)
    return F.when(before > 0, ratio) if base == "positive" else ratio
