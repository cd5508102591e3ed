"""A seed's pages come whole or raise."""

from __future__ import annotations

import json

import pytest

from gleanwright.sources import connectors


def fetcher(following):
    return lambda seed, token: ([token], following.get(token))


def test_pages_over_the_budget_raise():
    chain = {None: "1", "1": "2"}
    assert [p for p, _ in connectors.pages(fetcher(chain), "s", 3)] == [0, 1, 2]
    with pytest.raises(ValueError, match="more than 2 pages"):
        list(connectors.pages(fetcher(chain), "s", 2))


def test_repeated_tokens_raise():
    with pytest.raises(ValueError, match="goes back to token 1"):
        list(connectors.pages(fetcher({None: "1", "1": "2", "2": "1"}), "s", 20))
    with pytest.raises(ValueError, match="goes back to token 1"):
        list(connectors.pages(fetcher({None: "1", "1": "1"}), "s", 20))


def test_read_pages_is_whole_or_raises(spark, tmp_path):
    (tmp_path / "song").mkdir()
    for n in range(25):
        (tmp_path / "song" / f"{n}.json").write_text(json.dumps({"rows": [n], "next": str(n + 1) if n < 24 else None}))
    with pytest.raises(Exception, match="more than 20 pages"):
        connectors.read_pages(spark, ["song"], folder=str(tmp_path)).collect()
    assert connectors.read_pages(spark, ["song"], folder=str(tmp_path), pages="25").count() == 25
