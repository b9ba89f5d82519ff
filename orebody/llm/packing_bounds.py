"""How far a packing plan is from the best there can be (operator 9).

Prices of lengths are dual feasible for the configuration linear program if no multiset of lengths that fits a sequence
is worth more than one; the total price of all pieces then bounds the sequences of any packing from below. Here prices
come from two classical families of dual feasible functions of the share s = length / capacity: steps, floor((k + 1) s) / k
(s itself where (k + 1) s is whole), and thresholds, by which lengths over capacity - t count one and those below t
nothing. Each is applied on top of the other as well: a composition is feasible again. Everything is in whole numbers.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np

from .packing import CAPACITY, ROUNDINGS, _rounded, solve_configurations

STEPS = 64


def thresholds(lengths: np.ndarray, capacity: int, t: int) -> np.ndarray:
    """Sizes again, of the same capacity: over capacity - t all of it, below t nothing. 0 <= t <= capacity / 2."""
    return np.where(lengths > capacity - t, capacity, np.where(lengths < t, 0, lengths))


def steps(lengths: np.ndarray, capacity: int, k: int) -> np.ndarray:
    """Prices in units of 1 / (k * capacity)."""
    whole = (k + 1) * lengths % capacity == 0
    return np.where(whole, k * lengths, (k + 1) * lengths // capacity * capacity)


def lower_bound(histogram: dict[int, int], capacity: int = CAPACITY) -> int:
    """No packing has fewer sequences: the best bound of all steps up to STEPS on all thresholds. histogram: length ->
    pieces of it. The thresholds tried are the lengths up to half of the capacity, at most 256 of them, evenly."""
    lengths = np.array(sorted(n for n, c in histogram.items() if c), dtype=np.int64)
    if not len(lengths):
        return 0
    counts = np.array([histogram[int(n)] for n in lengths], dtype=object)  # of any size
    half = lengths[lengths * 2 <= capacity]
    tried = [0, *half[np.unique(np.linspace(0, len(half) - 1, min(256, len(half))).astype(int))].tolist()] if len(half) else [0]
    best = 0
    for t in tried:
        sizes = thresholds(lengths, capacity, t)
        best = max(best, -(-int(counts @ sizes.astype(object)) // capacity))
        for k in range(1, STEPS + 1):
            best = max(best, -(-int(counts @ steps(sizes, capacity, k).astype(object)) // (k * capacity)))
    return best


def plan_report(histogram: dict[int, int], capacity: int = CAPACITY) -> dict[str, float]:
    """Of the plan that packing_plan makes: sequences, the bound by tokens and by prices, the gap to the better of them,
    the value of the LP's solution, and the share of the tokens that its configurations place (best fit places the rest)."""
    lengths = np.array(sorted(k for k, n in histogram.items() if n and k < capacity), dtype=np.int64)
    counts = np.array([histogram[int(k)] for k in lengths], dtype=np.int64)
    full, tokens = histogram.get(capacity, 0), int(lengths @ counts)
    x = sorted(solve_configurations(lengths, counts, capacity).items(), key=lambda kv: (-kv[1], kv[0]))
    best = None
    for waste, share in ROUNDINGS:
        _, bins = _rounded(lengths, counts, x, capacity, waste, share, full)
        if best is None or bins < best[0]:
            rest, placed = counts.copy(), 0
            for config, times in x:
                size = sum(int(lengths[i]) * k for i, k in config)
                n = min(int(times * share + 1e-9), *(int(rest[i]) // k for i, k in config))
                if n >= 1 and capacity - size <= waste:
                    placed += n * size
                    for i, k in config:
                        rest[i] -= n * k
            best = bins, placed
        if bins - full <= -(-tokens // capacity):
            break
    by_tokens, by_prices = full - (-tokens // capacity), lower_bound(histogram, capacity)
    least = max(by_tokens, by_prices)
    return {
        "sequences": best[0], "by_tokens": by_tokens, "by_prices": by_prices, "gap": float(Fraction(best[0] - least, max(1, least))),
        "lp": full + sum(times for _, times in x), "lp_share": best[1] / max(1, tokens),
    }
