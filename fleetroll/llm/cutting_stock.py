"""Cutting stock by column generation: which mixes of lengths fill sequences, and how often to use each.

The linear program asks for the fewest sequences that hold a histogram of lengths. Its columns are patterns (how many pieces
of each length go into one sequence). Starting from patterns of one length each, a knapsack by dynamic programming over the
dual prices finds the pattern with the best reduced cost; a simplex step takes it in; until no pattern pays or ``most_steps``
is reached, which only makes the patterns less good. The program's size depends on the number of lengths, not on the data.
"""

from __future__ import annotations

import numpy as np


def price(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of lengths within the capacity, and how often it has each."""
    best = np.zeros(capacity + 1)
    taken = np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fit = np.searchsorted(lengths, room, "right")
        best[room] = best[room - 1]
        if fit:
            gain = values[:fit] + best[room - lengths[:fit]]
            k = int(gain.argmax())
            if gain[k] > best[room] + 1e-12:
                best[room], taken[room] = gain[k], k
    counts, room = np.zeros(len(lengths)), capacity
    while room > 0:
        if taken[room] < 0:
            room -= 1
        else:
            counts[taken[room]] += 1
            room -= lengths[taken[room]]
    return float(best[capacity]), counts


def patterns(
    histogram: dict[int, int], capacity: int, least_fill: int = 0, most_steps: int = 3000
) -> list[tuple[int, dict[int, int]]]:
    """(times, {length: pieces}) with whole times, rounded down; together they use no length more often than there is.

    Patterns that fill less than ``least_fill`` are left out: where there are too few short pieces to go with the long ones,
    the caller cuts pieces instead of padding sequences.
    """
    lengths = np.array(sorted(k for k, v in histogram.items() if v > 0), dtype=np.int64)
    if not len(lengths):
        return []
    demand = np.array([histogram[int(k)] for k in lengths], float)
    columns = np.diag(capacity // lengths).astype(float)
    inverse = np.diag(1.0 / np.diag(columns))
    amount = inverse @ demand
    for _ in range(most_steps):
        value, column = price(inverse.sum(axis=0), lengths, capacity)
        if value <= 1 + 1e-7:
            break
        step = inverse @ column
        can = step > 1e-9
        ratio = np.full(len(step), np.inf)
        ratio[can] = amount[can] / step[can]
        leave = int(ratio.argmin())
        moved = max(ratio[leave], 0.0)
        amount = np.maximum(amount - moved * step, 0)
        amount[leave] = moved
        columns[:, leave] = column
        row = inverse[leave] / step[leave]
        inverse -= np.outer(step, row)
        inverse[leave] = row
    whole = np.floor(amount + 1e-6).astype(np.int64)
    left = demand.astype(np.int64).copy()
    found = []
    for k in np.argsort(-whole, kind="stable"):
        pieces = columns[:, k].astype(np.int64)
        used = pieces > 0
        times = int(min(whole[k], (left[used] // pieces[used]).min())) if used.any() else 0
        if times > 0 and int((pieces * lengths).sum()) >= least_fill:
            left -= times * pieces
            found.append((times, {int(lengths[i]): int(pieces[i]) for i in np.flatnonzero(used)}))
    return found
