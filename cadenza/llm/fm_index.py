"""An FM-index over a sequence of small integers: wavelet-tree ranks, backward search and sampled locate, all in numpy."""

from __future__ import annotations

import numpy as np

from cadenza.llm.common import suffix_array


class WaveletTree:
    """Ranks over a sequence: one bit vector with prefix counts for each bit of the symbols, most significant first."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits = bits
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        at = symbols
        for level in range(bits - 1, -1, -1):
            bit = ((at >> level) & 1).astype(bool)
            count = np.zeros(len(at) + 1, np.int32 if len(at) < (1 << 31) else np.int64)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(len(at) - int(count[-1]))
            at = np.concatenate([at[~bit], at[bit]])

    def descend(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Where each place is sent on the way down to its symbol's leaf."""
        for k, level in enumerate(range(self.bits - 1, -1, -1)):
            ones = self.ones[k][places]
            places = np.where((symbols >> level) & 1, self.zeros[k] + ones, places - ones)
        return places

    def access(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and where the place is sent."""
        symbols = np.zeros(len(places), np.int64)
        for k in range(self.bits):
            before, after = self.ones[k][places], self.ones[k][places + 1]
            bit = after > before
            symbols = (symbols << 1) | bit
            places = np.where(bit, self.zeros[k] + before, places - before)
        return symbols, places


class FMIndex:
    """Index of one shard's text; symbols are 0 .. n_symbols - 1.

    Every sample-th text position has its suffix position stored; the others are reached by stepping back in the text.
    """

    def __init__(self, text: np.ndarray, n_symbols: int, sample: int = 16) -> None:
        closed = np.concatenate([text.astype(np.int64) + 1, [0]])
        order = suffix_array(closed)
        self.size = len(closed)
        self.tree = WaveletTree(closed[order - 1], max(1, int(n_symbols).bit_length()))
        counts = np.bincount(closed, minlength=n_symbols + 1)
        self.first = np.concatenate([[0], np.cumsum(counts)])[: n_symbols + 1]
        every = np.arange(n_symbols + 1)
        self.leaf = self.tree.descend(every, np.zeros(n_symbols + 1, np.int64))
        self.sampled = order % sample == 0
        self.sample_rank = np.cumsum(self.sampled) - 1
        self.samples = order[self.sampled]

    def search(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Half-open range of suffixes that start with each pattern flat[start : start + length]."""
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), self.size, np.int64)
        for step in range(1, int(lengths.max(initial=0)) + 1):
            live = np.flatnonzero((lengths >= step) & (low < high))
            if not len(live):
                break
            symbol = flat[starts[live] + lengths[live] - step].astype(np.int64) + 1
            shift = self.first[symbol] - self.leaf[symbol]
            low[live] = self.tree.descend(symbol, low[live]) + shift
            high[live] = self.tree.descend(symbol, high[live]) + shift
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each suffix."""
        out = np.zeros(len(rows), np.int64)
        left, rows = np.arange(len(rows)), rows.copy()
        back = 0
        while len(left):
            done = self.sampled[rows]
            out[left[done]] = self.samples[self.sample_rank[rows[done]]] + back
            left, rows = left[~done], rows[~done]
            symbols, sent = self.tree.access(rows)
            rows = sent - self.leaf[symbols] + self.first[symbols]
            back += 1
        return out
