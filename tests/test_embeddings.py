"""Diverse selection ranks all vectors of a group, in one task or in rounds."""

from __future__ import annotations

import numpy as np
import pytest

from gleanwright.operators import embeddings


def brute(keys, x, k, diversity):
    unit = [v / np.linalg.norm(v) if np.linalg.norm(v) else v * 0 for v in x]
    mean = x.sum(axis=0)
    relevance = [round(float(u @ mean / np.linalg.norm(mean)), 6) for u in unit]
    picks: list[int] = []
    while len(picks) < min(k, len(x)):
        score = {n: (1 - diversity) * relevance[n] - diversity * max((float(unit[n] @ unit[p]) for p in picks), default=0) for n in range(len(x)) if n not in picks}
        top = max(score.values())
        picks.append(min((n for n in score if score[n] > top - 1e-12), key=lambda n: keys[n]))
    return [keys[n] for n in picks]


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(3)
    near = rng.normal(size=(260, 8)) * 0.1 + np.eye(8)[0]
    far = rng.normal(size=(30, 8))
    x = np.vstack([near, far, near[:2], np.zeros((1, 8)), rng.normal(size=(40, 8)), rng.normal(size=(3, 8))])
    names = ["a"] * 293 + ["b"] * 40 + ["c"] * 3
    keys = rng.permutation(len(x)).tolist()
    return names, keys, x


@pytest.mark.parametrize("diversity", [0.5, 0.8])
@pytest.mark.parametrize("bounds", [{}, {"together": 100}, {"together": 0, "block": 1}, {"together": 0}])
def test_mmr_over_all_vectors(spark, groups, diversity, bounds):
    names, keys, x = groups
    df = spark.createDataFrame([(g, i, v.tolist()) for g, i, v in zip(names, keys, x, strict=True)] + [("a", -1, None)], "g string, id bigint, v array<double>").repartition(7)
    got: dict[str, list] = {}
    for r in sorted(embeddings.mmr(df, "g", "id", "v", 5, diversity, **bounds).collect(), key=lambda r: (r.g, r.place)):
        got.setdefault(r.g, []).append((r.place, r.id))
    for g in "abc":
        own = [n for n, name in enumerate(names) if name == g]
        assert got[g] == list(enumerate(brute([keys[n] for n in own], x[own], 5, diversity), 1))
