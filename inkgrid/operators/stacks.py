"""Connected parts of stacks of images (pages, height, width) as numpy calls over all of a stack's pages at once.

Rows of pixels become runs as in `graphs`, which joins them over tables where a page is larger than a task should hold. Here a stack is
one line of pixels with a blank after each row and a blank row after each page, so that nothing touches across those.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Runs:
    """Maximal stretches of set pixels in reading order: where they start and end on the line of a stack of that shape."""

    starts: np.ndarray
    ends: np.ndarray
    shape: tuple[int, int, int]

    @property
    def pitch(self) -> int:
        return self.shape[2] + 1

    @property
    def page(self) -> np.ndarray:
        return self.starts // (self.pitch * (self.shape[1] + 1))

    @property
    def y(self) -> np.ndarray:
        return self.starts // self.pitch % (self.shape[1] + 1)

    @property
    def x0(self) -> np.ndarray:
        return self.starts % self.pitch

    @property
    def x1(self) -> np.ndarray:
        return self.ends % self.pitch

    def holding(self, set_: np.ndarray) -> np.ndarray:
        """The run of each set pixel of a stack; all of them lie in runs."""
        return np.searchsorted(self.starts, np.flatnonzero(_line(set_)), side="right") - 1

    def drawn(self, which: np.ndarray) -> np.ndarray:
        """The pixels of some of the runs as a stack."""
        n, h, w = self.shape
        steps = np.zeros(n * (h + 1) * (w + 1), np.int8)
        steps[self.starts[which]] = 1
        steps[self.ends[which] + 1] = -1
        return np.cumsum(steps, dtype=np.int8).reshape(n, h + 1, w + 1)[:, :h, :w] > 0

    def touching(self, diagonal: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of runs in neighbouring rows that touch, the upper one first."""
        reach = int(diagonal)
        lo = np.searchsorted(self.ends, self.starts + self.pitch - reach)
        n = np.maximum(np.searchsorted(self.starts, self.ends + self.pitch + reach, side="right") - lo, 0)
        return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)


def _line(mask: np.ndarray) -> np.ndarray:
    n, h, w = mask.shape
    wide = np.zeros((n, h + 1, w + 1), bool)
    wide[:, :h, :w] = mask
    return wide.ravel()


def runs(mask: np.ndarray) -> Runs:
    turns = np.flatnonzero(np.diff(_line(mask), prepend=False))
    return Runs(turns[::2], turns[1::2] - 1, mask.shape)


def _ends(root: np.ndarray, of: np.ndarray) -> np.ndarray:
    """What pointers lead to in the end; those asked for then point there at once. Ways among them are halved each time."""
    first = end = root[of]
    while ((on := root[end]) != end).any():
        root[of] = end = on
    root[first] = end
    return end


def _hook(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the parts of pairs, which are ends of pointers: the larger one points to the smaller one. Of those with a smaller neighbour
    all are gone after a round, so that rounds are few."""
    while len(a := a[apart := a != b]):
        lo, hi = np.minimum(a, b := b[apart]), np.maximum(a, b)
        root[hi] = lo
        a, b = np.split(_ends(root, np.concatenate([lo, hi])), 2)


def connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of n things that each one is connected with over pairs."""
    root = np.arange(n)
    _hook(root, a, b)
    return _ends(root, np.arange(n))


def parts(mask: np.ndarray) -> tuple[np.ndarray, ...]:
    """(page, x, y, w, h, pixels) of the 4-connected components of a stack."""
    found = runs(mask)
    root = connected(len(found.starts), *found.touching())
    x, y, w, h = boxes(found, root)
    own = np.flatnonzero(root == np.arange(len(root)))
    return found.page[own], x[own], y[own], w[own], h[own], np.bincount(root, found.ends - found.starts + 1, len(root))[own].astype(np.int64)


def boxes(found: Runs, root: np.ndarray) -> tuple[np.ndarray, ...]:
    """x, y, w and h of the runs with the same root, at the root's place."""
    left, right, bottom = found.x0, found.x1, found.y
    for edge, of in ((left, np.minimum), (right, np.maximum), (bottom, np.maximum)):
        of.at(edge, root, edge.copy())
    return left, found.y, right - left + 1, bottom - found.y + 1


def stable(s: np.ndarray, least: int, most: int, delta: float, top: int) -> tuple[np.ndarray, ...]:
    """(page, level, label, x, y, w, h, n, growth) of each page's steadiest dark components over all of its levels, see
    regions.stable_regions(). Levels are gone through once for all pages: neighbours join at the larger of their levels, and a
    component is known by its first pixel."""
    n_pages, h, w = s.shape
    levels, at = np.unique(np.floor(s), return_inverse=True)
    at = at.reshape(s.shape).astype(np.uint16 if len(levels) < 1 << 16 else np.int64)
    index = np.arange(s.size, dtype=np.int32 if s.size < 1 << 31 else np.int64).reshape(s.shape)
    joins = np.concatenate([np.maximum(at[:, :, 1:], at[:, :, :-1]).ravel(), np.maximum(at[:, 1:], at[:, :-1]).ravel()])
    order = np.argsort(joins, kind="stable")
    p = np.concatenate([index[:, :, :-1].ravel(), index[:, :-1].ravel()])[order]
    q = np.concatenate([index[:, :, 1:].ravel(), index[:, 1:].ravel()])[order]
    until = np.searchsorted(joins[order], np.arange(len(levels)), side="right")
    wider = np.searchsorted(levels, levels + delta, side="right") - 1
    has = np.zeros((n_pages, len(levels)), bool)
    has[np.repeat(np.arange(n_pages), h * w), at.ravel()] = True
    root, size = index.ravel().copy(), np.ones(s.size, np.int64)
    slot = np.zeros(s.size, np.int64)

    def once(x: np.ndarray) -> np.ndarray:
        """Each of some indices once, in linear time: where one stands last it finds its own place again."""
        slot[x] = place = np.arange(len(x))
        return x[slot[x] == place]

    left = index % w if w else index.ravel()
    left, bottom = left.ravel(), (index // w % h if s.size else index).ravel()
    right = left.copy()
    fresh = np.argsort(at.ravel(), kind="stable") if least <= 1 else np.zeros(0, np.int64)
    fresh_until = np.searchsorted(at.ravel()[fresh], np.arange(len(levels)), side="right")
    sized, known = np.zeros(0, np.int64), np.zeros(s.size, bool)
    waiting: dict[int, list[tuple[np.ndarray, ...]]] = {}
    found = []
    for k in range(len(levels)):
        mine = slice(until[k - 1] if k else 0, until[k])
        a, b = np.split(_ends(root, np.concatenate([p[mine], q[mine]])), 2)
        apart = a != b
        before = once(np.concatenate([a[apart], b[apart]]))
        _hook(root, a, b)
        now = _ends(root, before)
        gone = now != before
        to, gone = now[gone], before[gone]
        np.add.at(size, to, size[gone])
        for edge, of in ((left, np.minimum), (right, np.maximum), (bottom, np.maximum)):
            of.at(edge, to, edge[gone])
        more = once(np.concatenate([to, fresh[fresh_until[k - 1] if k else 0 : fresh_until[k]]]))
        more = more[(size[more] >= least) & ~known[more]]
        known[more] = True
        sized = np.concatenate([sized, more])
        sized = sized[(root[sized] == sized) & (size[sized] <= most)]
        own = sized[has[sized // (h * w), k]]
        waiting.setdefault(int(wider[k]), []).append((np.full(len(own), k), own, left[own], right[own], bottom[own], size[own]))
        for level, first, x0, x1, y1, n in waiting.pop(k, ()):
            page, label = np.divmod(first, h * w)
            y = label // w
            found.append((page, levels[level], label, x0, y, x1 - x0 + 1, y1 - y + 1, n, (size[_ends(root, first)] - n) / n))
    if not found:
        return tuple(np.zeros(0) for _ in range(9))
    rows = [np.concatenate(c) for c in zip(*found, strict=True)]
    order = np.lexsort((rows[2], rows[1], rows[8], rows[0]))
    page = rows[0][order]
    kept = order[np.arange(len(order)) - np.searchsorted(page, page) < top]
    return tuple(c[kept] for c in rows)
