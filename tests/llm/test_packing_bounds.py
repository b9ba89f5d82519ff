"""Bounds on packings: no packing beats them, and plans come near them."""

import itertools

import numpy as np
import pytest

from orebody.llm import packing
from orebody.llm.packing_bounds import lower_bound, plan_report, steps, thresholds


def fewest(pieces, capacity):
    """By trying all assignments, largest piece first."""
    pieces, best = sorted(pieces, reverse=True), [len(pieces)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(pieces):
            best[0] = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms) if r >= pieces[i]}.values():
            place(i + 1, [*rooms[:j], rooms[j] - pieces[i], *rooms[j + 1 :]])
        place(i + 1, [*rooms, capacity - pieces[i]])

    place(0, [])
    return best[0]


def test_no_packing_beats_the_bound():
    rng = np.random.default_rng(1)
    for _ in range(60):
        capacity = int(rng.integers(5, 30))
        pieces = rng.integers(1, capacity + 1, int(rng.integers(1, 9))).tolist()
        histogram = {n: pieces.count(n) for n in set(pieces)}
        assert -(-sum(pieces) // capacity) <= lower_bound(histogram, capacity) <= fewest(pieces, capacity)
    assert lower_bound({}) == 0 and lower_bound({packing.CAPACITY: 7}) == 7


@pytest.mark.parametrize("capacity", [7, 12])
def test_prices_are_feasible(capacity):
    """Every multiset of up to `capacity` lengths that fits is worth one at most."""
    sizes = np.arange(1, capacity + 1)
    for t, k in itertools.product([0, 1, 2, capacity // 2], [1, 2, 3, 5, 8]):
        price = dict(zip(sizes.tolist(), steps(thresholds(sizes, capacity, t), capacity, k).tolist()))
        worth = [0] * (capacity + 1)
        for room in range(1, capacity + 1):
            worth[room] = max([worth[room - 1]] + [price[n] + worth[room - n] for n in range(1, room + 1)])
        assert worth[capacity] <= k * capacity


def test_a_bound_beyond_the_tokens():
    """Pieces over half of a sequence need one each; those over a third go by twos."""
    assert lower_bound({51: 10}, 100) == 10 and lower_bound({34: 10}, 100) == 5
    got = plan_report({51: 10, 34: 10, 15: 3}, 100)
    assert got["sequences"] == packing.packing_plan({51: 10, 34: 10, 15: 3}, 100)[1] and got["sequences"] >= got["by_prices"] > 0


def test_plans_near_the_bound():
    rng = np.random.default_rng(4)
    drawn = np.clip(rng.lognormal(5.5, 1.0, 20_000).astype(int), 1, packing.CAPACITY)
    histogram = {int(n): int(c) for n, c in zip(*np.unique(drawn, return_counts=True))}
    got = plan_report(histogram)
    assert got["sequences"] == packing.packing_plan(histogram)[1] and got["gap"] <= 0.001
    assert 0 < got["lp_share"] <= 1 and got["lp"] >= got["by_tokens"] - 1e-6
