"""Ranking by embeddings: cosine search, phrase ranking, diverse selection.

A stated set of queries goes to every task; the vectors are read once.  The
diverse selections are sequential by nature.  Maximal marginal relevance ranks
all vectors of a group, in one task or, for large groups, one pick a round over
all tasks.  The maximum sum runs on a bounded candidate list (``pool`` best
rows), as its definition says.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanwright.session import checkpointed


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null for a vector without length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def query_top_k(queries: DataFrame, vectors: DataFrame, key: str, vector: str, k: int, block: int = 4096) -> DataFrame:
    """(query_id, key, similarity, place): the k most similar other vectors of each query, ties to
    the lower key.  Blocks of queries meet every vector in Arrow batches; each task keeps k rows
    per query, so the shuffle carries k rows per query and task."""
    parts = int(queries.count() // block) + 1
    passes = []
    for p in range(parts):
        held = queries.where(F.pmod(F.xxhash64(key), F.lit(parts)) == p).select(key, vector).toPandas()
        if len(held):
            passes.append(_one_block(held, vectors, key, vector, k))
    if not passes:
        return vectors.select(F.col(key).alias("query_id"), key, F.lit(0.0).alias("similarity"), F.lit(1).alias("place")).where("false")
    best = passes[0]
    for other in passes[1:]:
        best = best.unionAll(other)
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), key)
    return best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def _one_block(held: pd.DataFrame, vectors: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    shared = vectors.sparkSession.sparkContext.broadcast((held[key].to_numpy(), _unit(np.stack(held[vector].to_numpy()).astype(np.float64))))

    def search(batches):
        ids, units = shared.value
        found: list[pd.DataFrame] = []
        for batch in batches:
            batch = batch[batch[vector].notna()]
            if not len(batch):
                continue
            keys = batch[key].to_numpy()
            near = units @ _unit(np.stack(batch[vector].to_numpy()).astype(np.float64)).T
            for row, query in enumerate(ids):
                similarity = near[row]
                others = np.flatnonzero(keys != query)
                order = others[np.lexsort((keys[others], -similarity[others]))[:k]]
                found.append(pd.DataFrame({"query_id": query, key: keys[order], "similarity": similarity[order]}))
            if len(found) > 4 * len(ids):
                found = [_best(found, key, k)]
        if found and len(best := _best(found, key, k)):
            yield best

    kind = dict(vectors.dtypes)[key]
    return vectors.select(key, vector).mapInPandas(search, f"query_id {kind}, {key} {kind}, similarity double")


def _best(found: list[pd.DataFrame], key: str, k: int) -> pd.DataFrame:
    rows = pd.concat(found).sort_values(["query_id", "similarity", key], ascending=[True, False, True])
    return rows.groupby("query_id").head(k)


def _means(vectors: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, mean, rows): the sum of each group's vectors, which has its mean's direction."""
    sums = vectors.select(group, F.posexplode(vector).alias("at", "x")).groupBy(group, "at").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count("*").alias("n"))
    return sums.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda e: e["s"]).alias("mean"), F.max("n").alias("rows"))


def _nearness(vector: str) -> Column:
    return F.round(cosine(F.col(vector), F.col("mean")), 6)


def centroid_ranking(vectors: DataFrame, group: str, key: str, vector: str, k: int) -> DataFrame:
    """(group, key, similarity, place): each group's vectors nearest to its mean vector."""
    scored = vectors.join(_means(vectors, group, vector), group).select(group, key, _nearness(vector).alias("similarity"))
    order = Window.partitionBy(group).orderBy(F.col("similarity").desc_nulls_last(), key)
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def pooled(vectors: DataFrame, group: str, key: str, vector: str, pool: int) -> DataFrame:
    near = centroid_ranking(vectors, group, key, vector, pool)
    return near.join(vectors.select(group, key, vector), [group, key])


def _marginal(units: np.ndarray, relevance: np.ndarray, chosen: np.ndarray, diversity: float) -> np.ndarray:
    """Relevance less the similarity to the nearest chosen vector.  Summed row by row, so that
    equal vectors score the same whichever batch they are in."""
    nearest = np.zeros(len(units))
    for n, one in enumerate(chosen):
        similarity = (units * one).sum(axis=1)
        nearest = np.maximum(nearest, similarity) if n else similarity
    return (1 - diversity) * relevance - diversity * nearest


def mmr(vectors: DataFrame, group: str, key: str, vector: str, k: int, diversity: float = 0.5, pool: int | None = None, together: int = 10_000, block: int = 4096) -> DataFrame:
    """(group, key, place): maximal marginal relevance among all vectors of each group, ties to
    the lower key; with ``pool`` among that many nearest to the mean only.  Null vectors take no
    part; a key is picked once.

    A group of at most ``together`` rows is one task's.  Larger ones take a round per pick: each
    task offers its best row of every group, given the picks so far.  Of them ``block`` groups at
    a time go to every task, with k vectors each."""
    kinds = dict(vectors.dtypes)
    vectors = vectors.where(F.col(vector).isNotNull())
    if pool is None:
        means = _means(vectors, group, vector)
        scored = vectors.join(means, group).select(group, key, vector, F.coalesce(_nearness(vector), F.lit(0.0)).alias("similarity"), "rows")
    else:
        near = pooled(vectors, group, key, vector, pool)
        scored = near.select(group, key, vector, F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.lit(0).cast("bigint").alias("rows"))
    scored = checkpointed(scored)

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key)
        units, keys = _unit(np.stack(rows[vector].to_numpy()).astype(np.float64)), rows[key].to_numpy()
        relevance, nearest, free, chosen = rows["similarity"].to_numpy(), np.zeros(len(rows)), np.ones(len(rows), bool), []
        while len(chosen) < k and free.any():
            best = int(np.where(free, (1 - diversity) * relevance - diversity * nearest, -np.inf).argmax())
            similarity = (units * units[best]).sum(axis=1)
            nearest = np.maximum(nearest, similarity) if chosen else similarity
            free &= keys != keys[best]
            chosen.append(best)
        return pd.DataFrame({group: rows[group].iloc[0], key: keys[chosen], "place": range(1, len(chosen) + 1)})

    schema = f"{group} {kinds[group]}, {key} {kinds[key]}, place int"
    found = scored.where(F.col("rows") <= together).groupBy(group).applyInPandas(choose, schema)
    large = scored.where(F.col("rows") > together)
    names = large.select(group).distinct().count()
    parts = -(-names // block)
    for p in range(parts):
        picks = _rounds(large.where(F.pmod(F.xxhash64(group), F.lit(parts)) == p), group, key, vector, k, diversity)
        found = found.unionAll(vectors.sparkSession.createDataFrame(picks, schema))
    return found


def _rounds(rows: DataFrame, group: str, key: str, vector: str, k: int, diversity: float) -> list[tuple]:
    """(group, key, place) of the picks, one of every group in each round."""
    context, kinds = rows.sparkSession.sparkContext, dict(rows.dtypes)
    held: dict = {}
    picks: list[tuple] = []
    for place in range(1, k + 1):
        shared = context.broadcast({g: ([x for x, _ in of], np.array([v for _, v in of])) for g, of in held.items()})

        def offer(batches, shared=shared):
            best: dict = {}
            for batch in batches:
                for name, part in batch.groupby(group, sort=False):
                    keys, chosen = shared.value.get(name, ([], np.empty((0, 0))))
                    part = part[~part[key].isin(keys)].sort_values(key)
                    if not len(part):
                        continue
                    units = _unit(np.stack(part[vector].to_numpy()).astype(np.float64))
                    score = _marginal(units, part["similarity"].to_numpy(), chosen, diversity)
                    at = int(score.argmax())
                    one = (-score[at], part[key].iloc[at], units[at])
                    if name not in best or one[:2] < best[name][:2]:
                        best[name] = one
            if best:
                yield pd.DataFrame([(g, x, -s, u) for g, (s, x, u) in best.items()], columns=[group, key, "score", "unit"])

        offered = rows.mapInPandas(offer, f"{group} {kinds[group]}, {key} {kinds[key]}, score double, unit array<double>")
        order = Window.partitionBy(group).orderBy(F.col("score").desc(), key)
        first = offered.withColumn("n", F.row_number().over(order)).where("n = 1").select(group, key, "unit").collect()
        shared.unpersist()
        if not first:
            break
        for name, one, unit in first:
            held.setdefault(name, []).append((one, unit))
            picks.append((name, one, place))
    return picks


def max_sum(vectors: DataFrame, group: str, key: str, vector: str, k: int, pool: int = 20, budget: int = 200_000) -> DataFrame:
    """(group, key): of each group's ``pool`` best the k least similar to each other, by trying
    all combinations; more than ``budget`` of them raise."""
    import math

    if math.comb(pool, k) > budget:
        raise ValueError(f"{math.comb(pool, k)} combinations: lower pool or k, or raise budget")

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key)
        units = _unit(np.stack(rows[vector].to_numpy()).astype(np.float64))
        near = units @ units.T
        best = min(combinations(range(len(rows)), min(k, len(rows))), key=lambda c: sum(near[i, j] for i, j in combinations(c, 2)))
        return pd.DataFrame({group: rows[group].iloc[0], key: rows[key].to_numpy()[list(best)]})

    kinds = dict(vectors.dtypes)
    return pooled(vectors, group, key, vector, pool).groupBy(group).applyInPandas(choose, f"{group} {kinds[group]}, {key} {kinds[key]}")
