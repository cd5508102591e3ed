"""Items that appear together: pair counts, pointwise mutual information and lift.

Items of a basket are deduplicated, ordered pairs are emitted and counted with
map-side combining.  Marginals come from the same items.  A pair's figures are
exact; nothing is capped.  Pairs rarer than ``min_count`` need two items that
are each at least as frequent: a bit set of fixed size, indexed by the items'
hashes, tells where a frequent item may be, and items elsewhere are left out
before pairing (one that shares a bit with a frequent item stays and is judged
by its pairs' counts).  A basket of many items is paired block by block, and
its blocks are spread over tasks.

Null or empty baskets count in the number of baskets and give no pair; repeated
rows of a basket are merged; one item alone gives no pair.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanwright.llm.forms import rewriter
from gleanwright.session import checkpointed

HASHTAG = re.compile(r"(?:(?<=^)|(?<=[\s(\[{]))#(\w+)")


def tag_items(rows: DataFrame, written: dict[str, str]) -> DataFrame:
    """(basket, item), distinct within a row, from (basket, caption, tags); a row without
    items yields one with a null item, so that its basket counts.  Items are in the one form
    of look-alike texts and lower case."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one = rewriter(written)
        for batch in batches:
            baskets: list[str] = []
            items: list[str | None] = []
            for basket, caption, tags in zip(batch["basket"], batch["caption"], batch["tags"], strict=True):
                found: set[str] = set()
                if isinstance(caption, str) and ("#" in caption or not caption.isascii()):
                    found.update(x.lower() for x in HASHTAG.findall(one(caption)))
                if tags is not None:
                    for tag in tags:
                        if isinstance(tag, str):
                            found.add(one(tag).strip(" \n#").lower())
                found.discard("")
                baskets.extend([basket] * max(len(found), 1))
                items.extend(sorted(found) or [None])
            if baskets:
                yield pd.DataFrame({"basket": baskets, "item": items}, columns=["basket", "item"])

    return rows.select("basket", "caption", "tags").mapInPandas(read, "basket string, item string")


def may_be_often(item: str, often: DataFrame, bits: int) -> str:
    """A test, as SQL, whether ``item`` hashes to a bit that one of ``often`` (item) sets.  What
    reaches the driver is at most ``bits`` / 64 whole numbers, however many items there are."""
    place = lambda x: f"pmod(xxhash64({x}), {bits})"
    words = often.select(F.expr(place("item")).alias("p")).groupBy(F.expr("p div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(p % 64)))").alias("set"))
    filled = [0] * (bits // 64)
    for r in words.collect():
        filled[r.word] = r.set
    return f"bit_get(from_json('{json.dumps(filled)}', 'array<bigint>')[int({place(item)} div 64)], int({place(item)} % 64)) = 1"


def block_pairs(baskets: DataFrame, block: int) -> DataFrame:
    """(item_a, item_b) of every pair within sorted ``items``.  A basket of more than ``block``
    items is a row for every two of its blocks, and those rows go to tasks of their own."""
    single = baskets.where(F.size("items").between(2, block)).select(F.col("items").alias("l"), F.col("items").alias("r"), F.lit(True).alias("same"))
    cut = "transform(sequence(0, (size(items) - 1) div {n}), k -> slice(items, k * {n} + 1, {n}))".format(n=block)
    # Each block is a row; the rows that pair it with a later block carry that block alone.
    large = baskets.where(F.size("items") > block).select(F.monotonically_increasing_id().alias("basket"), F.expr(cut).alias("parts"))
    rows = large.select("basket", "parts", F.explode(F.expr("sequence(0, size(parts) - 1)")).alias("i"))
    rows = rows.select("basket", "i", F.expr("parts[i]").alias("l"), F.posexplode(F.expr("slice(parts, i + 1, size(parts))")).alias("j", "r"))
    spread = rows.repartition("basket", "i", "j").select("l", "r", (F.col("j") == 0).alias("same"))
    left = single.unionAll(spread).select(F.posexplode("l").alias("at", "item_a"), "r", "same")
    return left.select("item_a", F.explode(F.expr("if(same, slice(r, at + 2, size(r)), r)")).alias("item_b"))


def pair_counts(items: DataFrame, min_count: int = 1, block: int = 512, bits: int = 1 << 20) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, baskets, lift, pmi) of every pair of items found together
    in at least ``min_count`` records.  ``items``: (basket, item), a null item in a basket
    without any; ``baskets`` is the number of all baskets."""
    # Baskets are put together once: their number, marginals, pruning and pairs read them.
    merged = checkpointed(items.where("basket IS NOT NULL").groupBy("basket").agg(F.array_sort(F.collect_set("item")).alias("items")))
    baskets = merged.count()
    marginal = merged.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n"))
    usable = merged.select("items")
    if min_count > 1:
        usable = usable.select(F.expr(f"filter(items, x -> {may_be_often('x', marginal.where(F.col('n') >= min_count), bits)})").alias("items"))
    pairs = block_pairs(usable, block).groupBy("item_a", "item_b").agg(F.count("*").alias("n_ab")).where(F.col("n_ab") >= min_count)
    a, b = marginal.select(F.col("item").alias("item_a"), F.col("n").alias("n_a")), marginal.select(F.col("item").alias("item_b"), F.col("n").alias("n_b"))
    lift = F.col("n_ab") * F.col("baskets").cast("double") / (F.col("n_a").cast("double") * F.col("n_b"))
    joined = pairs.join(a, "item_a").join(b, "item_b").withColumn("baskets", F.lit(baskets).cast("bigint"))
    return joined.select("item_a", "item_b", "n_ab", "n_a", "n_b", "baskets", lift.alias("lift"), F.log2(lift).alias("pmi"))


def strong_pairs(items: DataFrame, min_count: int, min_lift: int) -> DataFrame:
    """(item_a, item_b) with n_ab >= min_count and n_ab * N >= min_lift * n_a * n_b, in exact whole numbers."""
    exact = F.expr(f"cast(n_ab as decimal(19,0)) * cast(baskets as decimal(19,0)) >= cast({int(min_lift)} as decimal(5,0)) * (cast(n_a as decimal(16,0)) * cast(n_b as decimal(16,0)))")
    return pair_counts(items, min_count).where(exact).select("item_a", "item_b")
