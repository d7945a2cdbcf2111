"""Alignments of many pairs of sequences at a time, in numpy.

``Pairs`` holds the sequences of a batch end to end as numbers. ``edits`` finds the least
edits of all pairs by wavefronts: for each number of edits and each diagonal how far one
gets, so the work grows with the distances, not with the lengths. A cell's distance is the
first wavefront that reaches it, which is all that going back needs; the choice among the
least is that of ``align.edit_blocks``. Pairs further apart than all of ``TIERS`` are aligned
one by one there.

``matches`` finds the longest-block alignment of all pairs, as the standard matcher does:
the longest common block, the first in the first and then in the second sequence at a tie,
and again on both sides of it. What long runs of equal items two sequences share is found once
by a sample of their grams; a part's longest block is its longest run, and the runs are cut
with the parts. Parts without one are searched for runs of ``GRAM`` items in the same way,
and what is left between them item by item. Parts with too many shared runs, as in texts
that repeat themselves, are matched one by one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from itertools import chain

import numpy as np

from .align import DELETE, EQUAL, INSERT, REPLACE, Block, _steps, distance, matching_blocks

NAMES = (EQUAL, REPLACE, DELETE, INSERT)
SAME, SWAP, DROP, ADD = range(4)
#: Edits up to which pairs are aligned together: most are near, and the others start anew. Beyond, a pair is aligned for itself.
TIERS = 24, 96, 400
#: Cells of the wavefronts that are kept together, if all pairs were as far apart as can be.
WAVES = 16_000_000
#: Counts of items by pair that are kept together.
CELLS = 4_000_000
#: Different items up to which each pair has a place for all of them.
DENSE = 512
#: Edits that 64 diagonals hold, the bytes of pairs that are looked at together, and the pairs from which that is quicker than wavefronts.
NEAR = 63
BESIDE = 4_000_000
FEW = 16
LONG = 4_000
#: Pairs up to which what is left of them is aligned one by one, and runs of a text that are sought in another one by one.
ALONE = 48
SOUGHT = 64
GRAM = 4
#: Cells of a part, items of one side times those of the other, up to which they are all compared.
SMALL = 100
#: Shared runs of GRAM items of a pair, and of the pairs that are looked at together.
HITS = 200_000
TOGETHER = 4_000_000
#: Bits of a place in a sequence.
BITS = 21
NEVER = -(1 << 30)
#: Items that are compared at a time.
WINDOW = 64


def spans(first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ranges by their starts and sizes: each place's range, and the place."""
    ends = np.cumsum(sizes)
    return np.repeat(np.arange(len(first)), sizes), np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Pairs:
    """Two sides of sequences end to end: items as numbers, and where each sequence begins."""

    def __init__(self, left: Sequence[Sequence], right: Sequence[Sequence]) -> None:
        self.texts = left, right
        self.starts = [np.concatenate(([0], np.cumsum(np.fromiter(map(len, side), np.int64, len(side))))) for side in (left, right)]
        if all(isinstance(x, str) for side in (left, right) for x in side):
            self.items = [np.frombuffer("".join(side).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) for side in (left, right)]
        else:
            numbers: dict = {}
            for side in (left, right):
                numbers.update(dict.fromkeys(chain.from_iterable(side)))
            numbers = dict(zip(numbers, range(len(numbers)), strict=True))
            self.items = [np.fromiter(map(numbers.__getitem__, chain.from_iterable(side)), np.int64, int(starts[-1])) for side, starts in zip((left, right), self.starts, strict=True)]
        self.padded = [np.pad(x, WINDOW, constant_values=end) for x, end in zip(self.items, (-1, -2), strict=True)]

    def __len__(self) -> int:
        return len(self.texts[0])

    def runs(self, i: np.ndarray, j: np.ndarray, room: np.ndarray, step: int) -> np.ndarray:
        """How many items from places i and j on are equal, forwards or backwards, within the room."""
        out = np.zeros(len(i), np.int64)
        open_ = np.flatnonzero(room > 0)
        a, b = self.items
        open_ = open_[a[i[open_]] == b[j[open_]]]
        out[open_] = 1
        # from here on windows of items, which may reach beyond both ends
        a, b = self.padded
        width = 4
        while len(open_):
            at = WINDOW + np.arange(width) * step + out[open_, None] * step
            same = a[i[open_, None] + at] == b[j[open_, None] + at]
            run = np.where(same.all(1), width, same.argmin(1))
            run = np.minimum(run, room[open_] - out[open_])
            out[open_] += run
            open_ = open_[run == width]
            width = min(WINDOW, 4 * width)
        return out


# -- least edits ------------------------------------------------------------------------


class Edits:
    """Runs of one operation, pair by pair in order: ``pair``, ``op``, starts and ends ``i, i2, j, j2``."""

    def __init__(self, pairs: Pairs, pair: np.ndarray, op: np.ndarray, size: np.ndarray) -> None:
        """From steps of one or more items in order; neighbours of one operation become one run."""
        full = size > 0
        pair, op, size = pair[full], op[full], size[full]
        new = np.ones(len(pair), bool)
        new[1:] = (pair[1:] != pair[:-1]) | (op[1:] != op[:-1])
        at = np.flatnonzero(new)
        self.pair, self.op = pair[at], op[at]
        size = np.add.reduceat(size, at) if len(at) else size
        self.places = []
        for side, still in ((0, ADD), (1, DROP)):
            moved = np.where(self.op == still, 0, size)
            ends = np.cumsum(moved)
            base = pairs.starts[side][self.pair]
            self.places += [ends - moved - base, ends - base]
        self.i, self.i2, self.j, self.j2 = self.places
        self.n = len(pairs)
        self.sizes = size
        self.whole = pairs

    def counts(self) -> np.ndarray:
        """Hits, substitutions, deletions and insertions of each pair, as columns."""
        return np.bincount(self.pair * 4 + self.op, self.sizes, 4 * self.n).astype(np.int64).reshape(-1, 4)

    def kept(self, side: int) -> np.ndarray:
        """For each item of a side, end to end, whether it is in an equal run."""
        same = self.op == SAME
        edge = np.zeros(len(self.whole.items[side]) + 1, np.int64)
        base = self.whole.starts[side][self.pair[same]]
        np.add.at(edge, base + self.places[2 * side][same], 1)
        np.add.at(edge, base + self.places[2 * side + 1][same], -1)
        return np.cumsum(edge)[:-1] > 0

    def gaps(self) -> tuple[np.ndarray, np.ndarray]:
        """``align.edit_runs`` of all pairs: whose each run of edits between equal runs is, and its length."""
        off = self.op != SAME
        new = off.copy()
        new[1:] &= ~off[:-1] | (self.pair[1:] != self.pair[:-1])
        at = np.cumsum(new)[off] - 1
        sides = [np.bincount(at, (end - start)[off], int(new.sum())) for start, end in ((self.i, self.i2), (self.j, self.j2))]
        return self.pair[new], np.maximum(*sides).astype(np.int64)

    def blocks(self) -> list[list[Block]]:
        out: list[list[Block]] = [[] for _ in range(self.n)]
        for p, op, i, i2, j, j2 in zip(self.pair.tolist(), self.op.tolist(), *(x.tolist() for x in self.places), strict=True):
            out[p].append((NAMES[op], i, i2, j, j2))
        return out


class _Middles:
    """What is between the common heads and tails of pairs: where it begins, and how much of each side it is."""

    def __init__(self, pairs: Pairs) -> None:
        (a0, b0), (la, lb) = (s[:-1] for s in pairs.starts), (np.diff(s) for s in pairs.starts)
        self.pairs = pairs
        self.head = pairs.runs(a0, b0, np.minimum(la, lb), 1)
        self.tail = pairs.runs(a0 + la - 1, b0 + lb - 1, np.minimum(la, lb) - self.head, -1)
        self.i, self.j = a0 + self.head, b0 + self.head
        self.li, self.lj = la - self.head - self.tail, lb - self.head - self.tail

    def straight(self) -> tuple[np.ndarray, np.ndarray]:
        """The middles of equal length whose items differ in as many places as there are items that the other lacks, and that number.

        Both bound the least edits, so these are known, and so they are for every beginning of
        such a middle: the alignment is place by place.
        """
        some = np.flatnonzero((self.li == self.lj) & (self.li > 0))
        own, i = spans(self.i[some], self.li[some])
        j = i + (self.j - self.i)[some][own]
        a, b = self.pairs.items[0][i], self.pairs.items[1][j]
        off = a != b
        own, a, b = own[off], a[off], b[off]
        out = np.bincount(own, minlength=len(some))
        # only what differs is counted, so a pair takes cells for its own items alone
        width = int(max(a.max(initial=0), b.max(initial=0))) + 1
        cell, place = np.unique(np.concatenate((own * width + a, own * width + b)), return_inverse=True)
        left = np.bincount(place[: len(a)], minlength=len(cell)) - np.bincount(place[len(a) :], minlength=len(cell))
        tight = np.bincount(cell // width, np.maximum(left, 0), len(some)) == out
        return some[tight], out[tight]

    def differing(self, some: np.ndarray) -> np.ndarray:
        """In how many places the sides of some middles differ; -1 where they are not of one length."""
        level = self.li[some] == self.lj[some]
        own, i = spans(self.i[some[level]], self.li[some[level]])
        off = self.pairs.items[0][i] != self.pairs.items[1][i + (self.j - self.i)[some[level]][own]]
        out = np.full(len(some), -1)
        out[level] = np.bincount(own[off], minlength=int(level.sum()))
        return out

    def items(self, p: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.pairs.items
        return a[self.i[p] : self.i[p] + self.li[p]], b[self.j[p] : self.j[p] + self.lj[p]]

    def tiers(self, aligned: Callable[[np.ndarray, int], np.ndarray], deep: bool, done: np.ndarray) -> np.ndarray:
        """Aligns pairs of two middles that are not done in portions, near ones first; ``aligned`` and this return those that are further apart.

        ``deep``: whether all wavefronts of a portion are kept.
        """
        open_ = (self.li > 0) & (self.lj > 0)
        open_[done] = False
        rest = np.flatnonzero(open_)
        for far in TIERS:
            most = np.minimum(np.maximum(self.li[rest], self.lj[rest]), far) + 1
            further = [np.empty(0, np.int64)]
            for start, stop in portions(most * most if deep else 8 * most, WAVES):
                further.append(aligned(rest[start:stop], far))
            rest = np.concatenate(further)
        return rest


def _surplus(middles: _Middles, done: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, ...]]]:
    """Middles not done whose least edits are as many as the items that one side has more of: which, how many, and their steps.

    Going back, a step is taken only if that number falls by one. It is a lower bound for all
    beginnings of both sides, so a step that is passed over for a later one in the order of
    ``align.edit_blocks`` was on no least path, and if the way leads to the beginning it is
    the path that is chosen there. Where it leads to no step, nothing is said of the pair.
    """
    open_ = (middles.li > 0) & (middles.lj > 0)
    open_[done] = False
    some = np.flatnonzero(open_)
    found, sizes, steps = [np.empty(0, np.int64)], [np.empty(0, np.int64)], []
    items = [x[spans(first[some], size[some])[1]] for x, first, size in zip(middles.pairs.items, (middles.i, middles.j), (middles.li, middles.lj), strict=True)]
    present = np.zeros(max(int(x.max(initial=0)) for x in items) + 1, bool)
    for x in items:
        present[x] = True
    number, width = np.cumsum(present) - 1, int(present.sum())
    ends = [np.concatenate(([0], np.cumsum(size[some]))) for size in (middles.li, middles.lj)]
    for low, high in portions((middles.li + middles.lj)[some] + min(width, DENSE), CELLS):
        part, n = some[low:high], high - low
        # a cell for each item of a pair
        cells = [np.repeat(np.arange(0, n * width, width), size[part]) + number[x[e[low] : e[high]]] for x, e, size in zip(items, ends, (middles.li, middles.lj), strict=True)]
        own = np.repeat(np.arange(n), width) if width <= DENSE else None
        if own is None:
            own, place = np.unique(np.concatenate(cells), return_inverse=True)
            own, cells = own // width, [place[: len(cells[0])], place[len(cells[0]) :]]
        more = np.bincount(cells[0], minlength=len(own)) - np.bincount(cells[1], minlength=len(own))
        fits, edits_, way = _falling(middles, part, cells, more, own)
        found.append(part[fits])
        sizes.append(edits_[fits])
        for p, order, op, size in way:
            good = fits[p]
            p = p[good]
            steps.append((part[p], np.broadcast_to(order, good.shape)[good], op[good], size[good]))
    return np.concatenate(found), np.concatenate(sizes), steps


def _falling(middles: _Middles, part: np.ndarray, cells: list[np.ndarray], more: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
    """Of each middle of ``part`` whether steps lead to its beginning, their number, and the steps.

    ``cells``: a number for each item of both sides, end to end; ``more``: how many more of it
    the first side has; ``own``: whose it is.
    """
    pairs, n = middles.pairs, len(part)
    i0, j0, i, j = (x[part] for x in (middles.i, middles.j, middles.li, middles.lj))
    a0, b0 = np.cumsum(i) - i, np.cumsum(j) - j
    over, under = (np.bincount(own, np.maximum(x, 0), n).astype(np.int64) for x in (more, -more))
    total, fits, way, order = np.maximum(over, under), np.ones(n, bool), [], 1 << 39
    left = np.arange(n)
    while len(left) > ALONE:
        x, y = i[left], j[left]
        run = pairs.runs(i0[left] + x - 1, j0[left] + y - 1, np.minimum(x, y), -1)
        x, y = x - run, y - run
        way.append((left, order, np.full(len(left), SAME), run))
        ended = (x == 0) | (y == 0)
        if ended.any():
            way.append((left[ended], order - 1, np.where(y[ended] == 0, DROP, ADD), (x + y)[ended]))
            left, x, y = left[~ended], x[~ended], y[~ended]
        at, on = cells[0][a0[left] + x - 1], cells[1][b0[left] + y - 1]
        mine, theirs = more[at] > 0, more[on] < 0
        p, q = over[left], under[left]
        # how many each side has more without the last item of the first, of the second, of both
        p_drop, q_drop, p_add, q_add = p - mine, q + ~mine, p + ~theirs, q - theirs
        p_swap, q_swap = p_drop + ~theirs, q_drop - theirs
        least = np.maximum(p, q) - 1
        swap = np.maximum(p_swap, q_swap) == least
        drop = ~swap & (np.maximum(p_drop, q_drop) == least)
        sound = swap | drop | (np.maximum(p_add, q_add) == least)
        fits[left[~sound]] = False
        take, give = swap | drop, ~drop
        more[at[take]] -= 1
        more[on[give]] += 1
        over[left], under[left] = np.where(swap, p_swap, np.where(drop, p_drop, p_add)), np.where(swap, q_swap, np.where(drop, q_drop, q_add))
        i[left], j[left] = x - take, y - give
        left = left[sound]
        way.append((left, order - 1, np.where(swap, SWAP, np.where(drop, DROP, ADD))[sound], np.ones(len(left), np.int64)))
        order -= 2
    for p in left.tolist():
        places = zip((*pairs.items, *cells), (i0[p], j0[p], a0[p], b0[p]), (i[p], j[p], i[p], j[p]), strict=True)
        back = _falling_one(*(s[k : k + size].tolist() for s, k, size in places), int(over[p]), int(under[p]), more)
        fits[p] = back is not None
        if back:
            op, size = np.array(back).T
            way.append((np.full(len(back), p), order - np.arange(len(back)), op, size))
    return fits, total, way


def _falling_one(a: list[int], b: list[int], x: list[int], y: list[int], over: int, under: int, counted: np.ndarray) -> list[tuple[int, int]] | None:
    """The same of one pair, whose items are ``a`` and ``b`` and have the cells ``x`` and ``y``: (operation, size) on the way back, or None."""
    more = {cell: int(counted[cell]) for cell in {*x, *y}}
    i, j, back = len(a), len(b), []
    while i and j:
        start = i
        while i and j and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
        if start > i:
            back.append((SAME, start - i))
        if not i or not j:
            break
        mine, theirs, least = more[x[i - 1]] > 0, more[y[j - 1]] < 0, max(over, under) - 1
        drop, add = (over - mine, under + (not mine)), (over + (not theirs), under - theirs)
        swap = drop[0] + (not theirs), drop[1] - theirs
        for op, now in ((SWAP, swap), (DROP, drop), (ADD, add)):
            if max(now) == least:
                break
        else:
            return None
        over, under = now
        if op != ADD:
            i -= 1
            more[x[i]] -= 1
        if op != DROP:
            j -= 1
            more[y[j]] += 1
        back.append((op, 1))
    if i or j:
        back.append((DROP if i else ADD, i + j))
    return back


def _near(middles: _Middles, done: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Middles not done whose edits are at most NEAR, or as few as there are items that one side lacks, and how many.

    The columns of the distance matrix as bits, of 64 diagonals, a column of all pairs of a
    portion at a time (Hyyrö 2003). NEAR edits reach no other diagonals; more are an upper
    bound, which the lacking items meet.
    """
    li, lj = middles.li, middles.lj
    open_ = (li > 0) & (lj > 0) & (np.abs(li - lj) < NEAR)
    open_[done] = False
    some = np.flatnonzero(open_)
    some = some[np.argsort(-np.minimum(li[some], lj[some]), kind="stable")]
    numbers = [np.empty(0, np.int64)] * 2
    if len(some):
        present = np.zeros(int(max(x.max() for x in middles.pairs.items)) + 1, bool)
        for x in middles.pairs.items:
            present[x] = True
        number = np.cumsum(present) + 1
        kind = np.uint8 if number[-1] < 256 else np.int32
        numbers = [number.astype(kind)[x] for x in middles.pairs.items]
    found, far = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for low, high in portions(np.maximum(li[some], lj[some]) + 128, BESIDE):
        if high - low >= FEW:
            part = some[low:high]
            edits_ = _near_distances(middles, numbers, part)
            rest = np.flatnonzero(edits_ > NEAR)
            known = np.ones(len(part), bool)
            known[rest] = edits_[rest] == _lacking(middles, numbers, part[rest])
            far.append(edits_[known])
            found.append(part[known])
    return np.concatenate(found), np.concatenate(far)


def _lacking(middles: _Middles, numbers: list[np.ndarray], part: np.ndarray) -> np.ndarray:
    """How many items of one side the other lacks, the larger of the two numbers: at least so many edits are needed."""
    out, width = np.zeros(len(part), np.int64), int(max(x.max() for x in numbers)) + 1
    for low, high in portions(np.full(len(part), width), CELLS):
        some = part[low:high]
        counts = []
        for side, (first, size) in enumerate(((middles.i, middles.li), (middles.j, middles.lj))):
            own, at = spans(first[some], size[some])
            counts.append(np.bincount(own * width + numbers[side][at], minlength=len(some) * width).reshape(-1, width))
        more = counts[0] - counts[1]
        out[low:high] = np.maximum(np.maximum(more, 0).sum(1), np.maximum(-more, 0).sum(1))
    return out


def _near_distances(middles: _Middles, numbers: list[np.ndarray], part: np.ndarray) -> np.ndarray:
    """The least edits within 64 diagonals; ``part`` falls by the length of the shorter sides."""
    swap = middles.li[part] < middles.lj[part]
    long, short = np.maximum(middles.li[part], middles.lj[part]), np.minimum(middles.li[part], middles.lj[part])
    below = 31 + (long - short) // 2
    # a window of 64 items of the longer side moves along with the shorter; its first begins 63 - below before the items
    rows = np.zeros((len(part), int((63 - below + long).max()) + 64), numbers[0].dtype)
    columns = np.ones((int(short[0]), len(part)), numbers[0].dtype)
    for side, first in ((0, middles.i), (1, middles.j)):
        for mine, size, tall in ((swap == bool(side), long, True), (swap != bool(side), short, False)):
            own, at = spans(np.zeros(int(mine.sum()), np.int64), size[mine])
            own = np.flatnonzero(mine)[own]
            items = numbers[side][first[part[own]] + at]
            if tall:
                rows[own, 63 - below[own] + at] = items
            else:
                columns[at, own] = items
    one = np.uint64(1)
    vp = np.uint64(0xFFFFFFFFFFFFFFFF) << (63 - below).astype(np.uint64)
    vn, out = np.zeros(len(part), np.uint64), np.minimum(below, long)
    last = long - below
    open_ = np.searchsorted(-short, -np.arange(int(short[0])), side="left")
    for c, n in enumerate(open_.tolist()):
        same = np.packbits(rows[:n, c : c + 64] == columns[c, :n, None], axis=1, bitorder="little").view(np.uint64).ravel()
        p, m = vp[:n], vn[:n]
        d = (((same & p) + p) ^ p) | same | m
        hp, hm = m | ~(d | p), d & p
        rest = last[:n] - c
        bit = np.where(rest > 0, 63, np.maximum(62 + rest, 0)).astype(np.uint64)
        along = ((hp >> bit) & one).astype(np.int64) - ((hm >> bit) & one).astype(np.int64)
        out[:n] += np.where(rest > 0, 1 - (d >> bit).astype(np.int64), along)
        d >>= one
        vp[:n], vn[:n] = hm | ~(d | hp), d & hp
    return out


def _far(middles: _Middles, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of some middles that are quicker together, and their least edits: whole columns as bits, 64 items of the shorter side a word."""
    found, far = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    if len(some) >= FEW:
        items = np.concatenate([x[spans(first[some], size[some])[1]] for x, first, size in zip(middles.pairs.items, (middles.i, middles.j), (middles.li, middles.lj), strict=True)])
        present = np.zeros(int(items.max()) + 1, bool)
        present[items] = True
        number, kinds = np.cumsum(present), int(present.sum()) + 1
        words = (np.minimum(middles.li[some], middles.lj[some]) + 63) // 64
        steps = np.maximum(middles.li[some], middles.lj[some]) + words
        order = np.argsort(-steps, kind="stable")
        some = some[order]
        for low, high in portions(np.maximum(kinds * words[order], CELLS // 2000), CELLS):
            if high - low >= FEW:
                found.append(some[low:high])
                far.append(_far_distances(middles, some[low:high], number, kinds))
    return np.concatenate(found), np.concatenate(far)


def _by_columns(middles: _Middles, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some middles, in another order, and their least edits by whole columns of bits: short ones together, the others one at a time."""
    together, edits_ = _far(middles, some[np.maximum(middles.li[some], middles.lj[some]) <= LONG])
    alone = np.setdiff1d(some, together)
    return np.concatenate((together, alone)), np.concatenate((edits_, [distance(*(x.tolist() for x in middles.items(p))) for p in alone.tolist()])).astype(np.int64)


def _far_distances(middles: _Middles, part: np.ndarray, number: np.ndarray, kinds: int) -> np.ndarray:
    """The least edits of middles; ``part`` falls by the length of the longer sides and the words of the shorter ones.

    A word of a column takes what is carried from the word above it, so it is a step behind,
    and all words of all pairs take one step at a time. Kind 0 is no item; before a word's
    first column it leaves the word as it is, and after its last nothing is read of it.
    """
    n, one, last = len(part), np.uint64(1), np.uint64(63)
    swap = middles.li[part] > middles.lj[part]
    short, long = np.minimum(middles.li[part], middles.lj[part]), np.maximum(middles.li[part], middles.lj[part])
    words = (short + 63) // 64
    pair, word = spans(np.zeros(n, np.int64), words)
    top = np.cumsum(words) - words
    pad = int(words.max())
    places = np.zeros(len(pair) * kinds, np.uint64)
    columns = np.zeros((int((long + words).max()) + pad, n), np.int32)
    for side, first in ((0, middles.i), (1, middles.j)):
        for mine, size, rows in ((swap == bool(side), short, True), (swap != bool(side), long, False)):
            own, at = spans(np.zeros(int(mine.sum()), np.int64), size[mine])
            own = np.flatnonzero(mine)[own]
            kind = number[middles.pairs.items[side][first[part[own]] + at]]
            if rows:
                np.bitwise_or.at(places, (top[own] + at // 64) * kinds + kind, one << (at % 64).astype(np.uint64))
            else:
                columns[at + pad, own] = kind
    flat, start, base = columns.ravel(), (pad - word) * n + pair, np.arange(len(pair)) * kinds
    more, less = np.full(len(pair), 0xFFFFFFFFFFFFFFFF, np.uint64), np.zeros(len(pair), np.uint64)
    up, down = np.zeros(len(pair) + 1, np.uint64), np.zeros(len(pair) + 1, np.uint64)
    low, end, out = top + words - 1, ((short - 1) % 64).astype(np.uint64), short.copy()
    steps = long + words
    for t in range(int(steps[0]) - 1):
        pairs_ = int(np.searchsorted(-steps, -(t + 1), side="left"))
        k = int(low[pairs_ - 1]) + 1
        up[top[:pairs_]], down[top[:pairs_]] = one, 0
        p, m, same = more[:k], less[:k], places[base[:k] + flat[start[:k] + t * n]]
        straight = same | m
        same |= down[:k]
        level = (((same & p) + p) ^ p) | same
        right, left = m | ~(level | p), p & level
        at = low[:pairs_]
        read = (t >= words[:pairs_] - 1) & (t - words[:pairs_] + 1 < long[:pairs_])
        change = ((right[at] >> end[:pairs_]) & one).astype(np.int64) - ((left[at] >> end[:pairs_]) & one).astype(np.int64)
        out[:pairs_] += np.where(read, change, 0)
        above, below = right >> last, left >> last
        right, left = right << one | up[:k], left << one | down[:k]
        more[:k], less[:k] = left | ~(straight | right), right & straight
        up[1 : k + 1], down[1 : k + 1] = above, below
    return out


def distances(pairs: Pairs) -> np.ndarray:
    """The number of least edits of each pair: by bits where they are near, else by wavefronts of which only the last is kept."""
    middles = _Middles(pairs)
    out = np.maximum(middles.li, middles.lj)
    straight, edits_ = middles.straight()
    out[straight] = edits_
    falling, edits_, _ = _surplus(middles, straight)
    out[falling] = edits_
    done = np.zeros(len(out), bool)
    done[straight] = done[falling] = True
    near, edits_ = _near(middles, np.flatnonzero(done))
    out[near] = edits_
    done[near] = True
    # what is further apart, unless it is long, is quickest by bits one pair at a time
    far, edits_ = _by_columns(middles, np.flatnonzero(~done & (middles.li > 0) & (middles.lj > 0) & (np.maximum(middles.li, middles.lj) <= LONG)))
    out[far] = edits_
    done[far] = True
    done = np.flatnonzero(done)

    def aligned(some: np.ndarray, most: int) -> np.ndarray:
        found = _Waves(middles, some, most, False).distance
        out[some] = found
        return some[found < 0]

    for p in middles.tiers(aligned, False, done).tolist():
        out[p] = distance(*(x.tolist() for x in middles.items(p)))
    return out


def edits(pairs: Pairs) -> Edits:
    """The least edits of all pairs."""
    n, middles = len(pairs), _Middles(pairs)
    # steps of a pair are put in order by a number that falls on the way back
    found = [(np.arange(n), np.full(n, at), np.full(n, SAME), size) for at, size in ((0, middles.head), (1 << 40, middles.tail))]
    for rest, op in ((middles.li, DROP), (middles.lj, ADD)):
        lone = np.flatnonzero((rest > 0) & ((middles.li == 0) | (middles.lj == 0)))
        found.append((lone, np.ones(len(lone), np.int64), np.full(len(lone), op), rest[lone]))

    straight = middles.straight()[0]
    falling, _, steps = _surplus(middles, straight)
    done = np.concatenate((straight, falling))
    # as many edits as differing places: going back, a substitution is on a least path at each of them
    near, edits_ = _near(middles, done)
    rest = (middles.li == middles.lj) & (middles.li > 0)
    rest[done] = rest[near] = False
    for some, least in ((near, edits_), _by_columns(middles, np.flatnonzero(rest))):
        level = some[least == middles.differing(some)]
        straight, done = np.concatenate((straight, level)), np.concatenate((done, level))
    found += steps
    own, i = spans(middles.i[straight], middles.li[straight])
    same = pairs.items[0][i] == pairs.items[1][i + (middles.j - middles.i)[straight][own]]
    cut = np.flatnonzero(np.concatenate(([True], (same[1:] != same[:-1]) | (own[1:] != own[:-1])))) if len(own) else own
    found.append((straight[own[cut]], i[cut] - pairs.starts[0][straight[own[cut]]] + 1, np.where(same[cut], SAME, SWAP), np.diff(np.concatenate((cut, [len(own)])))))

    def aligned(some: np.ndarray, most: int) -> np.ndarray:
        waves = _Waves(middles, some, most, True)
        found.extend(waves.steps())
        return some[waves.distance < 0]

    for p in middles.tiers(aligned, True, done).tolist():
        steps = np.array([NAMES.index(x) for x in _steps(*middles.items(p))])
        found.append((np.full(len(steps), p), np.arange(1, len(steps) + 1), steps, np.ones(len(steps), np.int64)))
    pair, order, op, size = (np.concatenate([f[c] for f in found]) for c in range(4))
    at = np.lexsort((order, pair))
    return Edits(pairs, pair[at], op[at], size[at])


class _Waves:
    """The wavefronts of some pairs' middles up to ``most`` edits, and their distances; -1 for those further apart."""

    def __init__(self, middles: _Middles, some: np.ndarray, most: int, keep: bool) -> None:
        self.pairs, self.some = middles.pairs, some
        self.i0, self.j0, self.li, self.lj = (x[some] for x in (middles.i, middles.j, middles.li, middles.lj))
        n, goal = len(some), self.lj - self.li
        # a wave has a row for each pair that is open there, a column for each diagonal from -s to s
        last = np.zeros((n, 1), np.int32)
        self.waves, self.rows = [last], [np.arange(n)]
        self.distance = np.full(n, -1)
        open_, s = np.arange(n), 0
        while len(open_) and s < most:
            s += 1
            far = np.full((len(open_), 2 * s + 1), NEVER, np.int32)
            far[:, 1:-1] = last + 1
            far[:, :-2] = np.maximum(far[:, :-2], last + 1)
            far[:, 2:] = np.maximum(far[:, 2:], last)
            k = np.arange(-s, s + 1)
            limit = np.minimum(self.li[open_, None], self.lj[open_, None] - k).astype(np.int32)
            far = np.minimum(far, limit)
            far[(far < np.maximum(0, -k)) | (limit < 0)] = NEVER
            p, c = np.nonzero(far >= 0)
            i, own = far[p, c].astype(np.int64), open_[p]
            far[p, c] += self.pairs.runs(self.i0[own] + i, self.j0[own] + i + k[c], limit[p, c] - i, 1)
            if keep:
                self.waves.append(far)
                place = np.full(n, -1)
                place[open_] = np.arange(len(open_))
                self.rows.append(place)
            at = np.clip(goal[open_] + s, 0, 2 * s)
            done = (np.abs(goal[open_]) <= s) & (far[np.arange(len(open_)), at] >= self.li[open_])
            self.distance[open_[done]] = s
            open_, last = open_[~done], far[~done]

    def steps(self) -> list[tuple[np.ndarray, ...]]:
        """(pair, order, operation, size) of the steps, going back: a match first, then a substitution, a deletion, an insertion."""
        wave, rows, li, lj, i0, j0, some, pairs = self.waves, self.rows, self.li, self.lj, self.i0, self.j0, self.some, self.pairs
        out: list[tuple[np.ndarray, ...]] = []
        base = np.concatenate(([0], np.cumsum([w.size for w in wave])))
        flat, places = np.concatenate([w.ravel() for w in wave]), np.stack(rows)

        def reached(p: np.ndarray, s: np.ndarray, k: np.ndarray, i: np.ndarray) -> np.ndarray:
            """Whether s edits get to row i on diagonal k."""
            fits = (np.abs(k) <= s) & (s >= 0)
            at = base[np.where(fits, s, 0)] + places[np.where(fits, s, 0), p] * (2 * np.where(fits, s, 0) + 1) + np.where(fits, k + s, 0)
            return fits & (flat[at] >= i)

        left = np.flatnonzero(self.distance >= 0)
        i, j, s, order = li.copy(), lj.copy(), self.distance.copy(), 1 << 39
        while len(left):
            x, y = i[left], j[left]
            run = pairs.runs(i0[left] + x - 1, j0[left] + y - 1, np.minimum(x, y), -1)
            out.append((some[left], np.full(len(left), order), np.full(len(left), SAME), run))
            i[left] -= run
            j[left] -= run
            left = left[(i[left] > 0) | (j[left] > 0)]
            x, y, d = i[left], j[left], s[left]
            k = y - x
            op = np.where(reached(left, d - 1, k, x - 1), SWAP, np.where(reached(left, d - 1, k + 1, x - 1), DROP, ADD))
            op = np.where(y == 0, DROP, np.where(x == 0, ADD, op))
            size = np.where(y == 0, x, np.where(x == 0, y, 1))
            out.append((some[left], np.full(len(left), order - 1), op, size))
            i[left] -= np.where(op == ADD, 0, size)
            j[left] -= np.where(op == DROP, 0, size)
            s[left] -= size
            left = left[(i[left] > 0) | (j[left] > 0)]
            order -= 2
        return out


def edit_blocks(left: Sequence[Sequence], right: Sequence[Sequence]) -> list[list[Block]]:
    """``align.edit_blocks`` of each pair."""
    return edits(Pairs(left, right)).blocks()


def new_grams(pairs: Pairs, steps: Edits | None = None, size: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Of each pair, how many runs of so many items the second sequence has, and how many of those the first lacks.

    ``steps``: an alignment of the pairs; what lies within its equal runs is not looked for.
    """
    starts = pairs.starts[1]
    total, new = np.maximum(np.diff(starts) - size + 1, 0), np.zeros(len(pairs), np.int64)
    if steps is None:
        for n, (a, b) in enumerate(zip(*pairs.texts, strict=True)):
            if a != b:
                have = set(_grams(a, size))
                new[n] = total[n] - sum(map(have.__contains__, _grams(b, size)))
        return total, new
    edge = np.zeros(int(starts[-1]) + 1, np.int64)
    same = (steps.op == SAME) & (steps.sizes >= size)
    base = starts[steps.pair[same]]
    edge[base + steps.j[same]] += 1
    edge[base + steps.j2[same] - size + 1] -= 1
    open_ = np.cumsum(edge)[:-1] == 0
    # none begins among a sequence's last items
    some = total > 0
    for back in range(1, size):
        open_[starts[1:][some] - back] = False
    open_[spans(starts[:-1][~some], np.diff(starts)[~some])[1]] = False
    at = np.flatnonzero(open_)
    own = np.searchsorted(starts, at, side="right") - 1
    at, cut = (at - starts[own]).tolist(), np.searchsorted(own, np.arange(len(pairs) + 1)).tolist()
    for n, (a, b) in enumerate(zip(*pairs.texts, strict=True)):
        places = at[cut[n] : cut[n + 1]]
        if not places:
            continue
        if isinstance(a, str) and len(places) <= SOUGHT:
            new[n] = len([k for k in places if b[k : k + size] not in a])
        else:
            new[n] = len(places) - sum(map(set(_grams(a, size)).__contains__, [tuple(b[k : k + size]) for k in places]))
    return total, new


def _grams(items: Sequence, size: int) -> Iterable[tuple]:
    return zip(*(items[k:] for k in range(size)), strict=False)


# -- longest blocks ----------------------------------------------------------------------


def _codes(pairs: Pairs) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each place of both sides a number of its item, and one of the GRAM items from there on; equal numbers are equal items."""
    top, cut = int(max(x.max(initial=0) for x in pairs.items)) + 1, len(pairs.items[0])
    present = np.zeros(top, bool)
    for x in pairs.items:
        present[x] = True
    number = (np.cumsum(present) - 1).astype(np.uint64)
    both = np.concatenate([number[x] for x in pairs.items] + [np.zeros(2 * GRAM, np.uint64)])
    wide, half = np.uint64(32), np.uint64(16)
    if present.sum() >> 16:
        two = np.unique(both[:-1] << wide | both[1:], return_inverse=True)[1].astype(np.uint64)
    else:
        two = both[:-1] << half | both[1:]
    four = two[:-2] << wide | two[2:]
    return [both[:cut], both[cut:]], [four[:cut], four[cut:]]


#: Odd numbers that mix keys, and the bits of a table of keys.
MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
TABLE = 22


def _meeting(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the left whose key the right has, the first of those of the right in the last result, and how many they are."""
    high = np.uint64(64 - TABLE)
    x, y = np.arange(len(left)), np.arange(len(right))
    for _ in range(2):
        # what has no partner mostly falls out by a table
        table = np.zeros(1 << TABLE, bool)
        table[left[x] >> high] = True
        y = y[table[right[y] >> high]]
        table = np.zeros(1 << TABLE, bool)
        table[right[y] >> high] = True
        x = x[table[left[x] >> high]]
        if len(x) * 4 > len(left):
            break
    x, y = x[np.argsort(left[x])], y[np.argsort(right[y])]
    first = np.searchsorted(right[y], left[x])
    return x, first, np.searchsorted(right[y], left[x], side="right") - first, y


def _blocks_of(pairs: Pairs, part: Sequence[int]) -> np.ndarray:
    """Blocks (pair, i, j, size) of one part (pair, i, i2, j, j2)."""
    p, i, i2, j, j2 = part
    found = [(p, i + k, j + m, k2 - k) for op, k, k2, m, _ in matching_blocks(pairs.texts[0][p][i:i2], pairs.texts[1][p][j:j2]) if op == EQUAL]
    return np.array(found, np.int64).reshape(-1, 4)


def _level(pairs: Pairs, codes: tuple[list[np.ndarray], list[np.ndarray]], parts: np.ndarray, size: int, step: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Blocks of ``size + step - 1`` items and more of the parts, and the parts that have none.

    Such a run holds ``size`` items of the first sequence that begin at a multiple of
    ``step``, so only these are looked for in the second; ``size`` is 1, GRAM or twice that.
    """
    least = size + step - 1
    ends = [s[parts[:, 0]] for s in (s[:-1] for s in pairs.starts)]
    own, at, keys = [], [], []
    for side, gap in ((0, step), (1, 1)):
        room = parts[:, 2 + 2 * side] - parts[:, 1 + 2 * side]
        o, k = spans(np.zeros(len(parts), np.int64), np.maximum((room - size) // gap + 1, 0))
        k = (ends[side] + parts[:, 1 + 2 * side])[o] + k * gap
        key = codes[size >= GRAM][side][k] * MIX[0] + o.astype(np.uint64) * MIX[1]
        if size > GRAM:
            key += (codes[1][side][k + GRAM] * MIX[2]) ^ (codes[1][side][k + GRAM] >> np.uint64(29))
        key ^= key >> np.uint64(31)
        own.append(o)
        at.append(k)
        keys.append(key * MIX[2])
    x, first, hits, y = _meeting(*keys)
    of_part = np.bincount(own[0][x], hits, len(parts)).astype(np.int64)
    alone = of_part > HITS
    blocks = [_blocks_of(pairs, part) for part in parts[alone].tolist()]
    some, rest = np.flatnonzero(~alone), []
    for low, high in portions(of_part[some], TOGETHER):
        here = some[low:high]
        number = np.full(len(parts), -1)
        number[here] = np.arange(len(here))
        mine = number[own[0][x]] >= 0
        which, row = spans(first[mine], hits[mine])
        u, v = x[mine][which], y[row]
        # keys of different items may be equal
        i, j = at[0][u], at[1][v]
        sound = own[0][u] == own[1][v]
        for k in range(0, size, GRAM):
            sound &= codes[size >= GRAM][0][i + k] == codes[size >= GRAM][1][j + k]
        u, i, j = u[sound], i[sound], j[sound]
        o = own[0][u]
        part, i, j, n = _shared(number[o], i - ends[0][o], j - ends[1][o], size, step)
        if step > 1:
            o = here[part]
            a, b = ends[0][o], ends[1][o]
            back = pairs.runs(a + i - 1, b + j - 1, np.minimum(np.minimum(i - parts[o, 1], j - parts[o, 3]), step - 1), -1)
            on = pairs.runs(a + i + n, b + j + n, np.minimum(np.minimum(parts[o, 2] - i - n, parts[o, 4] - j - n), step - 1), 1)
            i, j, n = i - back, j - back, n + back + on
            long = n >= least
            part, i, j, n = part[long], i[long], j[long], n[long]
        made, left = _resolved(part, i, j, n, parts[here], least)
        blocks.append(made)
        rest.append(left)
    return blocks, np.concatenate(rest) if rest else parts[:0]


def _shared(pair: np.ndarray, i: np.ndarray, j: np.ndarray, size: int, step: int = 1) -> tuple[np.ndarray, ...]:
    """Hits (pair, i, j) of ``size`` equal items, ``step`` apart, as runs: (pair, i, j, length)."""
    key = np.sort(((pair << BITS + 1 | (j - i + (1 << BITS))) << BITS) | i)
    new = np.ones(len(key), bool)
    new[1:] = np.diff(key) != step
    at = np.flatnonzero(new)
    n = (np.diff(np.concatenate((at, [len(key)]))) - 1) * step + size
    i = key[at] & ((1 << BITS) - 1)
    j = (key[at] >> BITS & ((1 << BITS + 1) - 1)) - (1 << BITS) + i
    return key[at] >> 2 * BITS + 1, i, j, n


def _resolved(part: np.ndarray, i: np.ndarray, j: np.ndarray, n: np.ndarray, parts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Blocks (pair, i, j, size) of the parts (pair, i, i2, j, j2) by runs of ``least`` items and more, and the parts that have none.

    A run is a block, whichever are taken before it, if it neither overlaps nor crosses one
    that is as long. So all these of a part are taken at once, with those of its longest that
    would be taken one after the other, and the part is cut at each.
    """
    blocks, rest, wide = [np.empty((0, 4), np.int64)], [np.empty((0, 5), np.int64)], BITS + 1
    while len(parts):
        order = np.argsort(part << wide | i)
        part, i, j, n = part[order], i[order], j[order], n[order]
        at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.empty(0, np.int64)
        lone = np.ones(len(parts), bool)
        lone[part[at]] = False
        rest.append(parts[lone])
        if not len(at):
            break
        group = np.repeat(np.arange(len(at)), np.diff(np.concatenate((at, [len(n)]))))
        size = np.maximum.reduceat(n, at)[group]
        longest = np.flatnonzero(n == size)
        taken = np.zeros(len(n), bool)
        taken[longest] = True
        # of several the first in the first and in the second sequence, then the first of those after it
        several = longest[np.bincount(group[longest])[group[longest]] > 1]
        several = several[np.lexsort((j[several], i[several], group[several]))]
        taken[several[~np.array(_after(*(z[several].tolist() for z in (group, i, j, n))), bool)]] = False
        # and of those at least half as long each that all others are wholly before or after
        some = np.flatnonzero(2 * n >= size)
        base = group << wide
        x, x2, y, y2 = ((base + z)[some] for z in (i, i + n, j, j + n))
        clear = np.ones(len(some), bool)
        clear[1:] = (np.maximum.accumulate(x2)[:-1] <= x[1:]) & (np.maximum.accumulate(y2)[:-1] <= y[1:])
        clear[:-1] &= (x[1:] >= x2[:-1]) & (np.minimum.accumulate(y[::-1])[::-1][1:] >= y2[:-1])
        taken[some[clear]] = True
        k = np.flatnonzero(taken)
        blocks.append(np.stack((parts[part[k], 0], i[k], j[k], n[k]), 1))
        # a part has as many new ones as blocks and one more: from the end of a block or the part's beginning to the next
        first = np.searchsorted(group[k], np.arange(len(at))) + np.arange(len(at))
        after = np.arange(len(k)) + group[k] + 1
        old, new = parts[part[at]], np.empty((len(k) + len(at), 5), np.int64)
        last = np.append(first[1:], len(new)) - 1
        new[first, 1], new[first, 3], new[last, 2], new[last, 4] = old[:, 1], old[:, 3], old[:, 2], old[:, 4]
        new[after, 1], new[after, 3], new[after - 1, 2], new[after - 1, 4] = i[k] + n[k], j[k] + n[k], i[k], j[k]
        new[:, 0] = np.repeat(old[:, 0], last - first + 1)
        # what of a run is in a new part
        starts, ends = [(base + z)[k] for z in (i, j)], [(base + z + n)[k] for z in (i, j)]
        low = np.maximum(*(np.searchsorted(s, base + z, side="right") for s, z in zip(starts, (i, j), strict=True)))
        high = np.minimum(*(np.searchsorted(s, base + z + n) for s, z in zip(ends, (i, j), strict=True)))
        which, in_ = spans(low, np.maximum(high - low + 1, 0))
        part = in_ + group[which]
        skip = np.maximum(0, np.maximum(new[part, 1] - i[which], new[part, 3] - j[which]))
        i, j, n = i[which] + skip, j[which] + skip, n[which] - skip
        n = np.minimum(n, np.minimum(new[part, 2] - i, new[part, 4] - j))
        keep = n >= least
        part, i, j, n, parts = part[keep], i[keep], j[keep], n[keep], new
        # parts without items on one side hold no blocks; runs never lie in them
        full = (parts[:, 1] < parts[:, 2]) & (parts[:, 3] < parts[:, 4])
        part, parts = (np.cumsum(full) - 1)[part], parts[full]
    return np.concatenate(blocks), np.concatenate(rest)


def _after(group: list[int], i: list[int], j: list[int], n: list[int]) -> list[bool]:
    """Of runs in order: whether each is the first of its group or wholly after the last such one."""
    out, last, x, y = [], -1, 0, 0
    for g, a, b, size in zip(group, i, j, n, strict=True):
        new = g != last or (a >= x and b >= y)
        out.append(new)
        if new:
            last, x, y = g, a + size, b + size
    return out


def portions(weights: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of rows with about so much weight together."""
    ends, out, start = np.cumsum(weights), [], 0
    while start < len(weights):
        stop = max(start + 1, int(np.searchsorted(ends, most + (ends[start - 1] if start else 0), side="right")))
        out.append((start, stop))
        start = stop
    return out


def matches(left: Sequence[Sequence], right: Sequence[Sequence]) -> list[list[Block]]:
    """``align.matching_blocks`` of each pair."""
    out: list[list[Block]] = [[(EQUAL, 0, len(a), 0, len(a))] if len(a) else [] for a in left]
    other = [n for n, (a, b) in enumerate(zip(left, right, strict=True)) if a != b]
    if other:
        for n, blocks in zip(other, _matches([left[n] for n in other], [right[n] for n in other]), strict=True):
            out[n] = blocks
    return out


def _matches(left: Sequence[Sequence], right: Sequence[Sequence]) -> list[list[Block]]:
    pairs = Pairs(left, right)
    out: list[list[Block]] = [[] for _ in left]
    _opcodes(_equal(pairs), *(np.diff(s) for s in pairs.starts), out)
    return out


def replaced(left: Sequence[Sequence], right: Sequence[Sequence]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, item, item) of the items that replace one another in the longest-block alignments, place by place."""
    pairs = Pairs(left, right)
    ends = np.stack((np.arange(len(pairs)), *(np.diff(s) for s in pairs.starts), np.zeros(len(pairs), np.int64)), 1)
    rows = np.concatenate((_equal(pairs), ends))
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    # what is between an equal block, or the beginning, and the next, or the end
    start = np.zeros((len(rows), 2), np.int64)
    start[1:] = np.where(rows[1:, :1] == rows[:-1, :1], rows[:-1, 1:3] + rows[:-1, 3:], 0)
    which, at = spans(np.zeros(len(rows), np.int64), (rows[:, 1:3] - start).min(1))
    pair = rows[which, 0]
    return pair, *(x[s[pair] + start[which, side] + at] for side, (x, s) in enumerate(zip(pairs.items, pairs.starts, strict=True)))


def _equal(pairs: Pairs) -> np.ndarray:
    """Equal blocks (pair, i, j, size) of the longest-block alignments, in order."""
    done, made = _in_place(pairs)
    rest = np.flatnonzero(~done)
    if len(rest):
        found = _searched(Pairs(*([side[p] for p in rest.tolist()] for side in pairs.texts)))
        found[:, 0] = rest[found[:, 0]]
        made = np.concatenate((made, found))
        made = made[np.lexsort((made[:, 1], made[:, 0]))]
    return made


def _in_place(pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs are matched place by place, and their blocks (pair, i, j, size).

    Two sequences of one length are equal in segments. If the second has none of the items
    that the first has between them, a block lies within a segment, so the longest is a
    segment, and it is where it is unless the second has it earlier too (``_first``). That
    it has not if the first lacks the second's items between segments as well.
    """
    la, lb = (np.diff(s) for s in pairs.starts)
    done = np.zeros(len(pairs), bool)
    some = np.flatnonzero((la == lb) & (la > 0))
    own, i = spans(pairs.starts[0][some], la[some])
    j = i + (pairs.starts[1][some] - pairs.starts[0][some])[own]
    a, b = pairs.items[0][i], pairs.items[1][j]
    same = a == b
    off = np.flatnonzero(~same)
    present = np.zeros(int(max(a.max(initial=0), b.max(initial=0))) + 1, bool)
    present[a] = present[b] = True
    number, width = np.cumsum(present) - 1, max(1, int(present.sum()))
    ends = np.cumsum(la[some])
    lacks = np.ones((2, len(some)), bool)
    for low, high in portions(np.full(len(some), width), CELLS):
        part = slice(int(ends[low] - la[some[low]]), int(ends[high - 1]))
        here = off[np.searchsorted(off, part.start) : np.searchsorted(off, part.stop)]
        for side, (mine, theirs) in enumerate(((a, b), (b, a))):
            table = np.zeros((high - low) * width, bool)
            table[(own[part] - low) * width + number[theirs[part]]] = True
            lacks[side, own[here][table[(own[here] - low) * width + number[mine[here]]]]] = False
    cut = np.flatnonzero(np.concatenate(([True], (same[1:] != same[:-1]) | (own[1:] != own[:-1])))) if len(own) else own
    size = np.diff(np.concatenate((cut, [len(own)])))
    keep = same[cut]
    cut, size = cut[keep], size[keep]
    own, i = own[cut], i[cut] - pairs.starts[0][some[own[cut]]]
    sound = lacks.all(0)
    at = np.searchsorted(own, np.arange(len(some) + 1)).tolist()
    starts, stops = i.tolist(), (i + size).tolist()
    for k in np.flatnonzero(lacks[0] & ~sound).tolist():
        text = pairs.texts[1][some[k]]
        sound[k] = isinstance(text, str) and _first(text, starts[at[k] : at[k + 1]], stops[at[k] : at[k + 1]])
    done[some[sound]] = True
    mine = sound[own]
    return done, np.stack((some[own], i, i, size), 1)[mine]


def _first(text: str, starts: list[int], stops: list[int]) -> bool:
    """Whether no segment of the text is there earlier, after the last one before it that is at least as long and so was taken before."""
    before: list[tuple[int, int]] = []
    for i, i2 in zip(starts, stops, strict=True):
        while before and before[-1][1] < i2 - i:
            before.pop()
        low = before[-1][0] if before else 0
        if low < i and text.find(text[i:i2], low, i2 - 1) >= 0:
            return False
        before.append((i2, i2 - i))
    return True


def _searched(pairs: Pairs) -> np.ndarray:
    """Equal blocks (pair, i, j, size) by the runs that two sequences share."""
    la, lb = (np.diff(s) for s in pairs.starts)
    alone = np.maximum(la, lb) >= 1 << BITS
    some = np.flatnonzero(~alone & (la > 0) & (lb > 0))
    parts = np.stack((some, np.zeros_like(some), la[some], np.zeros_like(some), lb[some]), 1)
    blocks, codes = [np.empty((0, 4), np.int64)], _codes(pairs)
    blocks += [_blocks_of(pairs, (p, 0, la[p], 0, lb[p])) for p in np.flatnonzero(alone).tolist()]
    # runs of at least 15 items by a sample, then of 4, of 1; little is left for each
    for size, step in ((2 * GRAM, 2 * GRAM), (GRAM, 1)):
        made, parts = _level(pairs, codes, parts, size, step)
        blocks += made
    wide = (parts[:, 2] - parts[:, 1]) * (parts[:, 4] - parts[:, 3]) > SMALL
    blocks += _level(pairs, codes, parts[wide], 1, 1)[0] + _small(pairs, parts[~wide])
    return np.concatenate(blocks)


def _small(pairs: Pairs, parts: np.ndarray) -> list[np.ndarray]:
    """Blocks of the parts by comparing every item of one side with every one of the other."""
    (a, b), (a0, b0) = pairs.items, pairs.starts
    cells = (parts[:, 2] - parts[:, 1]) * (parts[:, 4] - parts[:, 3])
    blocks = []
    for low, high in portions(cells, TOGETHER):
        some = parts[low:high]
        which, at = spans(np.zeros(len(some), np.int64), cells[low:high])
        wide = (some[:, 4] - some[:, 3])[which]
        i, j = some[which, 1] + at // wide, some[which, 3] + at % wide
        same = a[a0[some[which, 0]] + i] == b[b0[some[which, 0]] + j]
        runs = _shared(which[same], i[same], j[same], 1)
        blocks.append(_resolved(runs[0], *runs[1:], some, 1)[0])
    return blocks


def _opcodes(made: np.ndarray, la: np.ndarray, lb: np.ndarray, out: list[list[Block]]) -> None:
    """Fills in the blocks of each pair, with what is between the equal ones; equal neighbours are one."""
    at = np.searchsorted(made[:, 0], np.arange(len(out) + 1)).tolist()
    rows = made[:, 1:].tolist()
    for p, mine in enumerate(out):
        i = j = 0
        for x, y, n in [*rows[at[p] : at[p + 1]], [int(la[p]), int(lb[p]), 0]]:
            if i < x or j < y:
                mine.append((REPLACE if i < x and j < y else DELETE if i < x else INSERT, i, x, j, y))
            if n:
                if mine and mine[-1][0] == EQUAL:
                    mine[-1] = (EQUAL, mine[-1][1], x + n, mine[-1][3], y + n)
                else:
                    mine.append((EQUAL, x, x + n, y, y + n))
            i, j = x + n, y + n
