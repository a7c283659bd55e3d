"""Plans of whole length mixes, without Spark."""

from __future__ import annotations

import collections

import numpy as np
import pytest

from termlab.llm import packing

CAPACITY = 2048


def mixes():
    r = np.random.default_rng(0)
    return {
        "mean 300": r.exponential(300, 20_000).astype(int) + 1,
        "around 100": r.normal(100, 30, 20_000).astype(int),
        "lognormal": np.exp(r.normal(5.5, 1, 20_000)).astype(int),
        "even": r.integers(1, CAPACITY + 1, 20_000),
        "one length": np.full(5000, 100),
        "two lengths": np.repeat([100, 333], 3000),
        "a few": r.integers(1, 400, 37),
        "tiny": np.full(10_000, 1),
        "full": np.full(10, CAPACITY),
    }


def counted(planned):
    found = collections.Counter()
    for pattern, n in planned:
        assert sum(x * m for x, m in pattern) <= CAPACITY
        for x, m in pattern:
            found[x] += m * n
    return found


@pytest.mark.parametrize("name", mixes())
def test_every_piece_is_planned_once_and_few_sequences_are_open(name):
    lengths = np.clip(mixes()[name], 1, CAPACITY)
    histogram = collections.Counter(lengths.tolist())
    planned = packing.plan(histogram, CAPACITY)
    assert counted(planned) == histogram
    # No fewer are possible; where no sum of lengths fills a sequence, nor for as many whole pieces in each.
    each = CAPACITY // min(histogram) if len(histogram) == 1 else None
    bound = -(-len(lengths) // each) if each else -(-int(lengths.sum()) // CAPACITY)
    assert sum(n for _, n in planned) <= bound * 1.013 + 1


@pytest.mark.parametrize("name", ["mean 300", "around 100", "one length"])
def test_short_texts_are_placed_by_the_fit(name, monkeypatch):
    """Less than a fifth of the pieces is left to plain best fit, in the plan that counts."""
    lengths = np.clip(mixes()[name], 1, CAPACITY)
    best_fit, left = packing._best_fit, []

    def watched(rest, gaps, capacity):
        out = best_fit(rest, gaps, capacity)
        left.append((sum(n for _, n in out), sum(rest.values())))
        return out

    monkeypatch.setattr(packing, "_best_fit", lambda rest, gaps, capacity: watched(dict(rest), gaps, capacity))
    packing.plan(collections.Counter(lengths.tolist()), CAPACITY)
    assert min(left, key=lambda x: x[0])[1] < 0.2 * len(lengths)
