"""Polynomial prefix hashes, content-chosen anchors and segments of windows.

A *window* is ``size`` consecutive items (bytes or words).  Every window has an
*anchor*: of all ``gram``-item strings inside it the one with the smallest
hash, the leftmost of equals.  The anchor depends on the window's content
alone, so equal windows have equal anchors at equal places.  Consecutive
windows with the same anchor form a *segment*.  Counting by anchors bounds the
count of every window from above; two equal windows can only stand in
segments with equal anchor hashes.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_POS_BITS = 24


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: all input bits reach all output bits."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h = h ^ (h >> U(29))
    h = h * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


class Poly:
    """Prefix hashes of sequences modulo 2**64 for one odd base."""

    def __init__(self, which: int):
        self.base = _BASES[which]
        self.inverse = pow(self.base, -1, 1 << 64)
        with np.errstate(over="ignore"):
            self.table = mix(np.arange(1, 257, dtype=U) * U(0x2545F4914F6CDD1D) + U(which * 7919 + 1))
        self.up = np.ones(1, U)
        self.down = np.ones(1, U)

    def _powers(self, base: int, have: np.ndarray, n: int) -> np.ndarray:
        while len(have) < n:
            have = np.concatenate([have, have * U(pow(base, len(have), 1 << 64))])
        return have

    def prefix(self, values: np.ndarray) -> np.ndarray:
        n = len(values)
        if len(self.up) < n + 1:
            self.up = self._powers(self.base, self.up, n + 1)
            self.down = self._powers(self.inverse, self.down, n + 1)
        out = np.zeros(n + 1, U)
        np.cumsum(values * self.down[:n], out=out[1:])
        return out

    def span(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of items [start, end): equal for equal strings at any place."""
        return (prefix[end] - prefix[start]) * self.up[start]


_POLY: dict[int, Poly] = {}


def poly(which: int) -> Poly:
    if which not in _POLY:
        _POLY[which] = Poly(which)
    return _POLY[which]


def sliding_argmin(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive keys (by doubling)."""
    cur, span = keys, 1
    while span * 2 <= width:
        cur = np.minimum(cur[:-span], cur[span:])
        span *= 2
    rest = width - span
    return np.minimum(cur[:len(cur) - rest], cur[rest:]) if rest else cur


class Segments:
    """Segments of all windows of some sequences laid end to end.

    ``values``: one 64-bit value per item; ``bounds``: the n+1 borders of the
    sequences.  Arrays with one entry per segment: ``seq``, ``first`` (first
    window's start), ``count`` (windows), ``anchor`` (place of the anchor) and
    ``key`` (anchor hash).  Places count from the start of ``values``.
    """

    def __init__(self, values: np.ndarray, bounds: np.ndarray, size: int, gram: int):
        self.size, self.gram, self.values = size, gram, values
        self.p = poly(0).prefix(values)
        bounds = np.asarray(bounds, np.int64)
        n_windows = np.maximum(np.diff(bounds) - size + 1, 0)
        empty = np.zeros(0, np.int64)
        self.seq = self.first = self.count = self.anchor = empty
        self.key = np.zeros(0, U)
        if not n_windows.sum():
            return
        n = len(values)
        assert n < 1 << _POS_BITS
        g = mix((self.p[gram:] - self.p[:n + 1 - gram]) * poly(0).up[:n + 1 - gram])
        low = U((1 << _POS_BITS) - 1)
        keys = (g & ~low) | np.arange(len(g), dtype=U)
        at = (sliding_argmin(keys, size - gram + 1) & low).astype(np.int64)
        has = np.flatnonzero(n_windows)
        starts = np.concatenate([np.arange(bounds[i], bounds[i] + n_windows[i]) for i in has]) \
            if len(has) < 64 else _all_ranges(bounds[has], n_windows[has])
        seq = np.repeat(has, n_windows[has])
        a = at[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (a[1:] != a[:-1]) | (seq[1:] != seq[:-1])
        cut = np.flatnonzero(new)
        self.seq, self.first, self.anchor = seq[cut], starts[cut], a[cut]
        self.count = np.diff(np.append(cut, len(starts)))
        self.key = g[self.anchor]

    def content(self, only: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each chosen segment: its items, its anchor's
        place and its length."""
        start, end = self.first[only], self.first[only] + self.count[only] + self.size - 1
        shape = ((self.anchor[only] - start) * 65_536 + self.count[only]).astype(U)
        second = poly(1)
        p2 = self.second_prefix()
        return (mix(poly(0).span(self.p, start, end) + shape * U(0x9E3779B97F4A7C15)),
                mix(second.span(p2, start, end) ^ (shape * U(0x94D049BB133111EB))))

    def second_prefix(self) -> np.ndarray:
        if not hasattr(self, "p2"):
            self.p2 = poly(1).prefix(self.values)
        return self.p2

    def windows(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of the windows at ``starts``."""
        p2 = self.second_prefix()
        return (mix(poly(0).span(self.p, starts, starts + self.size)),
                mix(poly(1).span(p2, starts, starts + self.size)))


def _all_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    first = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum()), dtype=np.int64) + np.repeat(starts - first, lengths)


#: Separators of words: space, tab, newline, vertical tab, form feed, return.
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_spans(buf: np.ndarray, offsets: np.ndarray,
               separator: np.ndarray = _SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word of the rows, and the n+1 borders of
    the rows' words."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    text = buf[lo:hi]
    inside = ~separator[text]
    row_start = np.zeros(len(text) + 1, bool)
    row_start[offsets[:-1] - lo] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | row_start[1:len(text)]
    ends[:-1] &= ~inside[1:] | row_start[1:len(text)]
    start = np.flatnonzero(begins) + lo
    end = np.flatnonzero(ends) + lo + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, most: int = 500_000) -> np.ndarray:
    """64-bit hash of every word's bytes, in runs of words of bounded size."""
    out = np.empty(len(start), U)
    i, p = 0, poly(1)
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + most, side="right")))
        base = start[i]
        pre = p.prefix(p.table[buf[base:end[j - 1]]])
        out[i:j] = mix(p.span(pre, start[i:j] - base, end[i:j] - base)
                       + (end[i:j] - start[i:j]).astype(U) * U(0x9E3779B97F4A7C15))
        i = j
    return out


def segment_runs(values_of, bounds: np.ndarray, size: int, gram: int, most: int = 500_000):
    """``(Segments, place of its first item)`` over any number of items.

    ``values_of(lo, hi)`` gives the values of a range of items.  Sequences are
    taken together up to ``most`` items; a longer one is cut by its window
    starts (its pieces overlap by ``size - 1`` items, no window is lost or
    seen twice)."""
    n, i = len(bounds) - 1, 0
    while i < n:
        j = int(np.searchsorted(bounds, bounds[i] + most, side="right")) - 1
        if j > i:
            lo, hi = int(bounds[i]), int(bounds[j])
            yield Segments(values_of(lo, hi), bounds[i:j + 1] - lo, size, gram), lo, i
            i = j
            continue
        for lo in range(int(bounds[i]), max(int(bounds[i]) + 1, int(bounds[i + 1]) - size + 1), most):
            hi = min(int(bounds[i + 1]), lo + most + size - 1)
            yield Segments(values_of(lo, hi), np.array([0, hi - lo]), size, gram), lo, i
        i += 1
