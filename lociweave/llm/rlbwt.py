"""A run-length compressed Burrows-Wheeler index with sampled run ends, and matching statistics streamed against it.

One index holds one shard of text. ``repeats`` doesn't use it on the corpus, see the README for the figures; it is exact
for what fits into one index, and here for that.
"""

from __future__ import annotations

import numpy as np

END = 0  # sentinel, smaller than all bytes, which are shifted by one


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of text (whose last symbol is the one END) in order, by doubling."""
    n, rank, k = len(text), text.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while True:
        key = rank * (n + 300)
        key[: max(0, n - k)] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        s = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
        if rank[order[-1]] == n - 1:
            return order
        k *= 2


class RunLengthIndex:
    """Runs of the transform: heads (symbols), starts, the text positions at each run's first and last row, and per symbol its runs and their ranks."""

    def __init__(self, data: bytes):
        self.text = np.concatenate([np.frombuffer(data, np.uint8).astype(np.int64) + 1, [END]])
        sa = suffix_array(self.text)
        n = len(sa)
        bwt = self.text[sa - 1]
        start = np.flatnonzero(np.concatenate([[True], bwt[1:] != bwt[:-1]]))
        self.n, self.start, self.head = n, start, bwt[start]
        last = np.append(start[1:], n) - 1
        self.size = last - start + 1
        self.first_at, self.last_at = sa[start], sa[last]
        counts = np.bincount(self.text, minlength=258)
        self.before = np.concatenate([[0], np.cumsum(counts)])[:-1]
        # Runs in order of symbol, and how many of the symbol come before each.
        self.by_symbol = np.argsort(self.head, kind="stable")
        symbols = self.head[self.by_symbol]
        self.bounds = np.searchsorted(symbols, np.arange(259))
        total = np.cumsum(self.size[self.by_symbol]) - self.size[self.by_symbol]
        first = self.bounds[symbols]
        self.rank_at = np.empty(len(start), np.int64)
        self.rank_at[self.by_symbol] = total - total[np.minimum(first, len(total) - 1)]
        self.sorted_key = symbols * (len(start) + 1) + self.by_symbol  # (symbol, run): one array to search

    @property
    def runs(self) -> int:
        return len(self.start)

    def _common(self, q: np.ndarray, at: np.ndarray, to: np.ndarray, most: int) -> np.ndarray:
        """Length of the common prefix of q[at:] (up to its END) and text[to:], at most ``most``."""
        out = np.zeros(len(at), np.int64)
        live = np.arange(len(at))
        for k in range(most):
            i, j = at[live] + k, to[live] + k
            same = (i < len(q)) & (j < self.n - 1)
            same[same] = (q[i[same]] == self.text[j[same]]) & (q[i[same]] != END)
            live = live[same]
            if not len(live):
                break
            out[live] += 1
        return out

    def matching_statistics(self, patterns: list[bytes], most: int = 50) -> list[np.ndarray]:
        """For each place of each pattern how long a prefix of the rest stands in the text, up to ``most``.

        All patterns go from right to left in step: while the symbol wanted is the one of the current run, the row follows it;
        else it jumps to the end of the run before, or the start of the one behind, that has it, whichever matches longer.
        """
        sizes = np.array([len(p) for p in patterns], np.int64)
        ends = np.cumsum(sizes + 1)
        q = np.zeros(ends[-1] if len(ends) else 0, np.int64)
        begin = ends - sizes - 1
        for p, b in zip(patterns, begin):
            q[b : b + len(p)] = np.frombuffer(p, np.uint8).astype(np.int64) + 1
        out = np.zeros(len(q), np.int64)
        row, at = np.zeros(len(sizes), np.int64), np.full(len(sizes), self.n - 1, np.int64)
        for k in range(1, int(sizes.max()) + 1 if len(sizes) else 1):
            live = np.flatnonzero(sizes >= k)
            i = begin[live] + sizes[live] - k
            c = q[i]
            run = np.searchsorted(self.start, row[live], "right") - 1
            place = np.searchsorted(self.sorted_key, c * (self.runs + 1) + run)  # first run of c from here on
            same = (self.head[run] == c)
            there = self.bounds[c + 1] > self.bounds[c]
            down = np.minimum(place, len(self.by_symbol) - 1)
            has_down = (place < self.bounds[c + 1]) & there
            up = np.maximum(place - 1, 0)
            has_up = (place - 1 >= self.bounds[c]) & there
            dr, ur = self.by_symbol[down], self.by_symbol[up]
            jump = np.flatnonzero(~same & there)
            take_up = np.zeros(len(live), bool)
            if len(jump):
                both = jump[has_down[jump] & has_up[jump]]
                take_up[jump] = has_up[jump]
                if len(both):
                    nxt = i[both] + 1
                    take_up[both] = self._common(q, nxt, self.last_at[ur[both]], most) >= self._common(q, nxt, self.first_at[dr[both]], most)
            new_row = row[live].copy()
            new_at = at[live].copy()
            r = np.where(same, run, np.where(take_up, ur, dr))
            inside = np.where(same, row[live] - self.start[run], np.where(take_up, self.size[ur] - 1, 0))
            from_ = np.where(same, at[live], np.where(take_up, self.last_at[ur], self.first_at[dr]))
            ok = same | there
            new_row[ok] = self.before[c[ok]] + self.rank_at[r[ok]] + inside[ok]
            new_at[ok] = from_[ok] - 1
            new_row[~ok], new_at[~ok] = 0, self.n - 1
            row[live], at[live] = new_row, new_at
            where = np.where(ok, np.maximum(new_at, 0), self.n - 1)
            out[i] = self._common(q, i, where, most)
        return [out[b : b + s] for b, s in zip(begin, sizes)]
