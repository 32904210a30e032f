"""Run-length index of byte strings: a run-compressed Burrows-Wheeler transform with positions sampled at the ends of its runs,
and matching statistics streamed through it; all in numpy, many strings at a time."""

from __future__ import annotations

import numpy as np

from cadenza.llm.common import suffix_array

SEPARATOR = 0


def joined(strings: list[np.ndarray], label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The strings as numbers from 1 on, a separator after each; and where each starts and ends. Strings of different labels have no
    number in common."""
    size = np.array([len(s) for s in strings], np.int64)
    start = np.cumsum(size + 1) - size - 1
    text = np.full(int(size.sum()) + len(size), SEPARATOR, np.int32)
    inside = np.ones(len(text), bool)
    inside[start + size] = False
    text[inside] = np.concatenate(strings) + np.int32(1) + np.repeat(label.astype(np.int32) * 256, size)
    return text, start, start + size


class RunLengthIndex:
    """What is kept of the transform: where each run begins, its symbol, the text positions at its first and last row, and how its
    first row steps. A row inside a run steps as far beyond that as it stands beyond the run's first row."""

    def __init__(self, text: np.ndarray) -> None:
        self.text = text
        order = suffix_array(text)
        transform = text[order - 1]
        change = transform[1:] != transform[:-1]
        self.heads = np.flatnonzero(np.concatenate([[True], change]))
        tails = np.flatnonzero(np.concatenate([change, [True]]))
        self.symbols = transform[self.heads].astype(np.int64)
        self.first, self.last = order[self.heads], order[tails]
        self.tails = tails
        by_symbol = np.argsort(self.symbols, kind="stable")
        size = (tails - self.heads + 1)[by_symbol]
        self.steps = np.empty(len(by_symbol), np.int64)
        self.steps[by_symbol] = np.cumsum(size) - size
        #: runs by symbol and place, so that the nearest run of a symbol is one search away
        self.keys = self.symbols[by_symbol] * len(by_symbol) + by_symbol

    def _agree(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many symbols agree from a and from b on, up to `most`."""
        out, live, k = np.zeros(len(a), np.int64), np.flatnonzero(most > 0), 0
        ahead, end = np.arange(16), len(self.text) - 1
        while len(live):
            same = self.text[np.minimum(a[live, None] + k + ahead, end)] == self.text[np.minimum(b[live, None] + k + ahead, end)]
            whole = same.all(axis=1)
            out[live] = k + np.where(whole, 16, same.argmin(axis=1))
            k += 16
            live = live[whole & (most[live] > k)]
        return np.minimum(out, most)

    def matches(self, strings: list[np.ndarray], label: np.ndarray, longest: int) -> list[np.ndarray]:
        """Matching statistics: for each place of each string, how long (up to `longest`) what follows agrees with some place of the
        indexed strings of the same label.

        Streams all strings from right to left at once. A row whose transform has the next symbol steps on and the match grows by
        one. Otherwise the nearest runs of that symbol above and below give two sampled places; the match goes on at the one that
        agrees longer with the place left.
        """
        text, start, end = joined(strings, label)
        size = end - start
        out = np.zeros(len(text), np.int32)
        ends = end
        by_size = np.argsort(-size, kind="stable")
        end, size = end[by_size], size[by_size]
        row = np.zeros(len(end), np.int64)
        place = np.full(len(end), self.first[0])
        length = np.zeros(len(end), np.int64)
        n = len(self.keys)
        for k in range(int(size.max(initial=0))):
            live = int(np.searchsorted(-size, -k, side="left"))  # strings that are longer than k
            at, row, place, length = end[:live] - 1 - k, row[:live], place[:live], length[:live]
            symbol = text[at].astype(np.int64)
            run = np.searchsorted(self.heads, row, side="right") - 1
            off = np.flatnonzero(self.symbols[run] != symbol)
            if len(off):
                wanted = symbol[off] * n
                below = np.searchsorted(self.keys, wanted + run[off])
                above = below - 1
                has_below = (below < n) & (self.keys[np.minimum(below, n - 1)] < wanted + n)
                has_above = (above >= 0) & (self.keys[above] >= wanted)
                down = self.keys[np.minimum(below, n - 1)] % n
                up = self.keys[above] % n
                left, known = place[off], length[off]
                far_down = np.where(has_below, self._agree(left, self.first[down], np.where(has_below, known, 0)), -1)
                far_up = np.where(has_above, self._agree(left, self.last[up], np.where(has_above, known, 0)), -1)
                take_down = far_down >= far_up
                none = ~has_below & ~has_above  # the symbol doesn't occur: nothing matches, from any row on
                length[off] = np.where(none, -1, np.maximum(far_down, far_up))
                run[off] = np.where(none, run[off], np.where(take_down, down, up))
                row[off] = np.where(take_down, self.heads[run[off]], self.tails[run[off]])
                place[off] = np.where(take_down, self.first[run[off]], self.last[run[off]])
            row = self.steps[run] + row - self.heads[run]
            place = place - 1
            place[place < 0] = len(self.text) - 1
            length = np.minimum(length + 1, longest)
            out[at] = length
        return [out[a:b] for a, b in zip(start.tolist(), ends.tolist())]


def repeated_windows(strings: list[np.ndarray], group: np.ndarray, window: int) -> list[np.ndarray]:
    """Which windows of each string stand in an earlier string of its group too: a flag for every window.

    The strings of a group are in order, and neighbours; equal windows must be of one group. Each group is halved: one index is
    built of the earlier halves of all groups, and the later halves are streamed through it. The halves are then taken the same
    way, without the strings whose windows have all been found, until single strings are left; so a group of copies is done after
    one round, and a string is streamed at most as often as its group can be halved. Parts of one group have labels of their own.
    """
    found = [np.zeros(len(s) - window + 1, bool) for s in strings]
    member, group = np.arange(len(strings)), np.asarray(group)
    part = np.zeros(len(strings), np.int64)
    while True:
        fresh = np.concatenate([[True], (part[1:] != part[:-1]) | (group[member][1:] != group[member][:-1])])[: len(member)]
        first = np.flatnonzero(fresh)
        number = np.cumsum(fresh) - 1
        count = np.diff(np.append(first, len(member)))[number]
        later = np.arange(len(member)) - first[number] >= (count + 1) // 2
        several = count > 1
        member, part, later = member[several], part[several], later[several]
        if not len(member):
            return found
        index = RunLengthIndex(joined([strings[k] for k in member[~later].tolist()], part[~later])[0])
        done = np.zeros(len(strings), bool)
        for k, match in zip(member[later].tolist(), index.matches([strings[k] for k in member[later].tolist()], part[later], window)):
            found[k] |= match[: len(found[k])] >= window
            done[k] = found[k].all()
        # parts of a group are numbered anew, so that labels stay small
        member, part = member[~done[member]], (2 * part + later)[~done[member]]
        if len(member):
            fresh = np.concatenate([[True], (part[1:] != part[:-1]) | (group[member][1:] != group[member][:-1])])
            new_group = np.concatenate([[True], group[member][1:] != group[member][:-1]])
            number = np.cumsum(fresh) - 1
            part = number - np.maximum.accumulate(np.where(new_group, number, 0))
