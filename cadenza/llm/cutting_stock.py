"""Cutting-stock by column generation on a length histogram: few numbers in, few patterns out, whatever the corpus size."""

from __future__ import annotations

import numpy as np

Pattern = tuple[dict[int, int], int]


def best_pattern(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """Unbounded knapsack by dynamic programming over the capacity: how many of each length."""
    value, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(lengths, kind="stable")
    ranked, gains = lengths[order], prices[order]
    for room in range(1, capacity + 1):
        k = int(np.searchsorted(ranked, room, side="right"))
        value[room] = value[room - 1]
        if k:
            sums = value[room - ranked[:k]] + gains[:k]
            top = int(sums.argmax())
            if sums[top] > value[room] + 1e-12:
                value[room], choice[room] = sums[top], order[top]
    out, room = np.zeros(len(lengths), np.int64), capacity
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            out[choice[room]] += 1
            room -= lengths[choice[room]]
    return out


def solve_relaxation(lengths: np.ndarray, demand: np.ndarray, capacity: int, max_rounds: int = 2000) -> tuple[np.ndarray, np.ndarray]:
    """Fewest sequences if patterns could be used in fractions: basis patterns (columns) and how often each is used.

    A revised simplex whose entering column is the pattern of best price; starts from patterns of one length each.
    """
    basis = np.diag(capacity // lengths).astype(float)
    for _ in range(max_rounds):
        prices = np.linalg.solve(basis.T, np.ones(len(lengths)))
        entering = best_pattern(lengths, prices, capacity)
        if prices @ entering <= 1 + 1e-9:
            break
        use, move = np.linalg.solve(basis, demand), np.linalg.solve(basis, entering.astype(float))
        ratio = np.where(move > 1e-9, np.maximum(use, 0) / np.where(move > 1e-9, move, 1), np.inf)
        basis[:, int(ratio.argmin())] = entering
    return basis, np.maximum(np.linalg.solve(basis, demand), 0)


def plan(histogram: dict[int, int], capacity: int, unit: int) -> list[Pattern]:
    """Patterns (length -> pieces) with a number of uses that place every piece of the histogram exactly once.

    Multiples of the unit and lengths below it are two programs, the first in units; what rounding down leaves over, a
    number that the count of lengths bounds, is filled greedily, longest first.
    """
    left = {length: n for length, n in histogram.items() if n > 0}
    patterns: list[Pattern] = []
    if whole := left.pop(capacity, 0):
        patterns.append(({capacity: 1}, whole))
    for of, step in ((lambda x: x % unit == 0, unit), (lambda x: x % unit != 0, 1)):
        lengths = np.array(sorted(x for x in left if of(x)), np.int64)
        if not len(lengths):
            continue
        basis, use = solve_relaxation(lengths // step, np.array([left[int(x)] for x in lengths], float), capacity // step)
        for column, times in zip(basis.T.round().astype(np.int64), np.floor(use + 1e-9).astype(np.int64)):
            wanted = {int(x): int(n) for x, n in zip(lengths, column) if n}
            times = min([int(times), *(left.get(x, 0) // n for x, n in wanted.items())])
            if times > 0:
                patterns.append((wanted, times))
                for x, n in wanted.items():
                    left[x] -= n * times
    while any(left.values()):
        room, taken = capacity, {}
        for x in sorted((x for x, n in left.items() if n), reverse=True):
            if n := min(left[x], room // x):
                taken[x], room = n, room - n * x
        times = min(left[x] // n for x, n in taken.items())
        patterns.append((taken, times))
        for x, n in taken.items():
            left[x] -= n * times
    return patterns
