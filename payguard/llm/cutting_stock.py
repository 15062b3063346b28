"""Cutting stock by column generation, on a histogram of lengths.

The problem's size is the number of distinct lengths, not of documents. A
linear program chooses how often each pattern of lengths is used; a knapsack
dynamic program over its dual prices finds the next pattern; uses are rounded
down and what is left is packed first fit, longest first.
"""

from __future__ import annotations

import numpy as np


def best_patterns(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The value of the most valuable multiset of lengths within capacity (unbounded knapsack), and patterns, a row of counts each: the best one that holds each useful length, so the best of all is among them."""
    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    useful = np.flatnonzero(prices > 1e-12)
    size, price = lengths[useful], prices[useful]
    fits = np.searchsorted(size, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        value[c] = value[c - 1]
        if fits[c]:
            got = value[c - size[: fits[c]]] + price[: fits[c]]
            k = int(got.argmax())
            if got[k] > value[c] + 1e-15:
                value[c], choice[c] = got[k], useful[k]
    patterns = np.zeros((len(useful), len(lengths)), np.int64)
    for row, first in enumerate(useful.tolist()):
        patterns[row, first] = 1
        c = capacity - int(lengths[first])
        while c > 0:
            k = int(choice[c])
            if k < 0:
                c -= 1
            else:
                patterns[row, k] += 1
                c -= int(lengths[k])
    return float(value[capacity]), patterns


def solve(lengths: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 0.0, rounds: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (a row each) and their fractional uses, whose sum is at most a share `gap` above the least, that cover the demand.

    Revised simplex over generated columns; surplus columns let a length be
    covered more often than asked. `lengths` ascend. A pattern's best value v
    at the current prices bounds the least sum from below by the current sum
    over v (Farley, 1990), and so does the demand over the capacity; the
    search ends within `gap` of the higher bound. A stop at `rounds` gives a
    cover that may not be least.
    """
    m = len(lengths)
    basis = np.diag(capacity // lengths).astype(float)
    cost, inverse = np.ones(m), np.diag(1.0 / (capacity // lengths))
    x = inverse @ demand.astype(float)
    bound = float((lengths * demand).sum()) / capacity
    pool = np.zeros((0, m))
    for _ in range(rounds):
        prices = cost @ inverse
        total = float(cost @ x)
        if total <= bound * (1 + gap) + 1e-9:
            break
        low = int(prices.argmin())
        if prices[low] < -1e-9:
            column, price = np.zeros(m), 0.0
            column[low] = -1.0
        else:
            # Patterns of an earlier pricing serve as long as one of them pays; a new pricing costs more than many exchanges.
            worth = pool @ prices
            if not len(pool) or worth.max() <= 1 + 1e-7:
                value, found = best_patterns(prices, lengths, capacity)
                bound = max(bound, total / value)
                if value <= 1 + 1e-7 or total <= bound * (1 + gap):
                    break
                pool = found.astype(float)
                worth = pool @ prices
            column, price = pool[int(worth.argmax())], 1.0
        step = inverse @ column
        up = np.flatnonzero(step > 1e-9)
        if not len(up):
            break
        ratio = x[up] / step[up]
        out = up[int(ratio.argmin())]
        theta = max(0.0, float(ratio.min()))
        x -= theta * step
        x[out] = theta
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        basis[:, out], cost[out] = column, price
    used = cost > 0
    return basis[:, used].T.round().astype(np.int64), np.maximum(x[used], 0)


#: How far above the least number of sequences the plan's linear program may end.
GAP = 0.0001


def plan(lengths: np.ndarray, demand: np.ndarray, capacity: int, gap: float = GAP) -> list[tuple[np.ndarray, int]]:
    """Whole uses: (count of each length, number of sequences) pairs that hold the demand."""
    if not len(lengths):
        return []
    patterns, uses = solve(lengths, demand, capacity, gap)
    out, left = [], demand.astype(np.int64).copy()
    for counts, use in sorted(zip(patterns, uses, strict=True), key=lambda p: -p[1]):
        whole = int(use + 1e-6)
        if whole:
            out.append((counts, whole))
            left -= counts * whole
    left = np.maximum(left, 0)
    while left.any():
        counts, room = np.zeros(len(lengths), np.int64), capacity
        for i in range(len(lengths) - 1, -1, -1):
            counts[i] = min(left[i], room // lengths[i])
            room -= counts[i] * lengths[i]
        times = int((left[counts > 0] // counts[counts > 0]).min())
        out.append((counts, times))
        left -= counts * times
    return out
