"""Words of one text that are within two edits of words of another.

Of short lines all words are held against each other by their lengths and letters, for many
lines at a time. Words of longer ones meet by hashing: those of up to ``SHORT`` letters are filed under every form that
they have with up to two letters removed, and two words within two edits share such a form.
A longer word is filed under its thirds, one of which two edits leave as it is, if shifted
by up to two letters. What meets is checked exactly, for each two different words of a
batch once, in a band about the diagonal for many pairs at a time. So no long text's words
are all compared with all of another's.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import lru_cache
from itertools import chain, combinations

import numpy as np

MOST = 2
SHORT = 24
#: Letters up to which pairs of words are checked side by side.
SIDE_BY_SIDE = 128
#: Words of texts that are looked at together.
TOGETHER = 60_000
#: Different words of a line times those of the other, up to which all are held against each other, and how many of those together.
ALL = 20_000
BESIDE = 1_000_000
#: Bits of a form's hash; a shared one only makes a pair that is then checked.
FORM_BITS = 40
U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)


class Vocabulary:
    """The different words of a batch, by number, and what two of them are to each other."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}
        self.words: list[str] = []

    def coded(self, words: Iterable[str]) -> np.ndarray:
        words, known = list(words), len(self.words)
        self.words += [w for w in dict.fromkeys(words) if w not in self.numbers]
        self.numbers.update(zip(self.words[known:], range(known, len(self.words)), strict=True))
        return np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))

    def measured(self) -> None:
        """The lengths of all words, and their letters as 64 bits, which letters may share."""
        self.lengths = np.fromiter(map(len, self.words), np.int64, len(self.words))
        letters = np.frombuffer("".join(self.words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(U64)
        self.letters, full = np.zeros(len(self.words), U64), np.flatnonzero(self.lengths)
        if len(full):
            self.letters[full] = np.bitwise_or.reduceat(U64(1) << (letters & U64(63)), (np.cumsum(self.lengths) - self.lengths)[full])

    def beside(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, word of a, word of b) of two sides' (line, word), in order of lines, whose lengths and letters do not tell them apart."""
        size = 1 + max(int(x.max(initial=-1)) for x in (a[0], b[0]))
        na, nb = (np.bincount(x, minlength=size) for x in (a[0], b[0]))
        first, starts = np.repeat(np.cumsum(nb) - nb, na), nb[a[0]]
        ends, out, low = np.cumsum(starts), [(a[0][:0],) * 3], 0
        while low < len(ends):
            high = max(low + 1, int(np.searchsorted(ends, BESIDE + (ends[low - 1] if low else 0), side="right")))
            own, at = spread(first[low:high], first[low:high] + starts[low:high])
            left, right = a[1][low + own], b[1][at]
            keep = np.abs(self.lengths[left] - self.lengths[right]) <= MOST
            own, left, right = own[keep], left[keep], right[keep]
            x, y = self.letters[left], self.letters[right]
            keep = (np.bitwise_count(x & ~y) <= MOST) & (np.bitwise_count(y & ~x) <= MOST)
            out.append((a[0][low + own[keep]], left[keep], right[keep]))
            low = high
        return tuple(map(np.concatenate, zip(*out, strict=True)))

    def filed(self) -> None:
        """The hashed forms of all words, those of a word from ``first`` on; words of one length are hashed together."""
        self.measured()
        forms = [np.empty(0, U64)] * len(self.words)
        for n in np.unique(self.lengths[self.lengths <= SHORT]).tolist():
            some = np.flatnonzero(self.lengths == n)
            letters = self._letters(some, n).astype(U64) + U64(1)
            found = []
            for gone in range(min(MOST, n) + 1):
                places = list(combinations(range(n), n - gone))
                kept = np.array(places, np.int64).reshape(len(places), n - gone)
                found.append((letters[:, kept] * np.cumprod(np.full(n - gone, _BASE, U64))).sum(2, dtype=U64) >> U64(64 - FORM_BITS))
            for c, row in zip(some.tolist(), np.sort(np.concatenate(found, 1), 1), strict=True):
                forms[c] = row[np.concatenate(([True], row[1:] != row[:-1]))]
        sizes = np.fromiter(map(len, forms), np.int64, len(forms))
        self.first = np.concatenate(([0], np.cumsum(sizes)))
        self.forms = np.concatenate(forms) if forms else np.empty(0, U64)

    def keys(self, line: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(line, form) of each line's words in one number, and the place of the word that each is of."""
        owner, at = spread(self.first[word], self.first[word + 1])
        return (line[owner].astype(U64) << U64(FORM_BITS)) | self.forms[at], owner

    def meeting(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, word of a, word of b) of two sides' (line, word) that share a form or a third; all within two edits are among them."""
        filed, owner = self.keys(*b)
        order = np.argsort(filed, kind="stable")
        filed, owner = filed[order], owner[order]
        asked, asking = self.keys(*a)
        left, at = spread(np.searchsorted(filed, asked), np.searchsorted(filed, asked, side="right"))
        pairs = np.unique(asking[left] * len(b[0]) + owner[at])
        left, right = pairs // max(1, len(b[0])), pairs % max(1, len(b[0]))
        line, one, other = a[0][left], a[1][left], b[1][right]
        if (self.lengths > SHORT - MOST).any():
            more = [(n, *self._long(a[1][a[0] == n], b[1][b[0] == n])) for n in np.unique(a[0][self.lengths[a[1]] > SHORT - MOST]).tolist()]
            line = np.concatenate((line, *[np.full(len(x), n) for n, x, _ in more]))
            one, other = np.concatenate((one, *[x for _, x, _ in more])), np.concatenate((other, *[y for _, _, y in more]))
        return line, one, other

    def _long(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        filed: dict[tuple[int, int, str], list[int]] = {}
        for c in b.tolist():
            word = self.words[c]
            if len(word) > SHORT - MOST:
                for part, (low, high) in enumerate(_thirds(len(word))):
                    filed.setdefault((len(word), part, word[low:high]), []).append(c)
        left, right = [], []
        for c in a.tolist() if filed else ():
            word = self.words[c]
            if len(word) <= SHORT - MOST:
                continue
            for size in range(len(word) - MOST, len(word) + MOST + 1):
                for part, (low, high) in enumerate(_thirds(size)):
                    for shift in range(-MOST, MOST + 1):
                        if low + shift >= 0:
                            found = filed.get((size, part, word[low + shift : high + shift]), ())
                            left += [c] * len(found)
                            right += found
        return np.array(left, np.int64), np.array(right, np.int64)

    def within(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the words of each pair are within two edits."""
        la, lb = self.lengths[left], self.lengths[right]
        out = np.zeros(len(left), bool)
        open_ = np.abs(la - lb) <= MOST
        longest = np.maximum(la, lb)
        size = 4
        while size <= SIDE_BY_SIDE:
            some = np.flatnonzero(open_ & (longest <= size) & (longest > (size // 2 if size > 4 else 0)))
            if len(some):
                out[some] = _banded(*(self._letters(x[some], size) for x in (left, right)), la[some], lb[some])
            size *= 2
        for n in np.flatnonzero(open_ & (longest > SIDE_BY_SIDE)).tolist():
            out[n] = _within(self.words[left[n]], self.words[right[n]])
        return out

    def _letters(self, codes: np.ndarray, size: int) -> np.ndarray:
        different, place = np.unique(codes, return_inverse=True)
        text = "".join(self.words[c].ljust(size, "\0") for c in different.tolist())
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, size)[place]


def _thirds(n: int) -> list[tuple[int, int]]:
    return [(n * k // 3, n * (k + 1) // 3) for k in range(3)]


def spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ranges of places: for each place in them the range's number, and the place."""
    sizes = last - first
    at = np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    return np.repeat(np.arange(len(first)), sizes), at


def _banded(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Whether the rows of letters are within two edits: five diagonals, for all pairs at a time."""
    wide, far = 2 * MOST + 1, MOST + 1
    row = np.full((wide, len(a)), far, np.int8)
    for d in range(MOST, wide):
        row[d] = d - MOST
    out = np.zeros(len(a), bool)
    for i in range(1, a.shape[1] + 1):
        new = np.full_like(row, far)
        for d in range(wide):
            j = i + d - MOST
            if j == 0:
                new[d] = min(i, far)
            elif 0 < j <= b.shape[1]:
                best = row[d] + (a[:, i - 1] != b[:, j - 1])
                if d + 1 < wide:
                    best = np.minimum(best, row[d + 1] + 1)
                if d:
                    best = np.minimum(best, new[d - 1] + 1)
                new[d] = np.minimum(best, far)
        row = new
        ends = np.flatnonzero(la == i)
        out[ends] = row[lb[ends] - i + MOST, ends] <= MOST
    return out


def _within(a: str, b: str, most: int = MOST) -> bool:
    """The same for one pair of words: what they begin with is alike, then comes an edit."""
    if abs(len(a) - len(b)) > most:
        return False
    if not most:
        return a == b
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    else:
        return True
    a, b = a[n:], b[n:]
    return _within(a[1:], b[1:], most - 1) or _within(a[1:], b, most - 1) or _within(a, b[1:], most - 1)


#: The same words meet again and again.
_near = lru_cache(100_000)(_within)


def found_words(refs: Sequence[Sequence[str]], hyps: Sequence[Sequence[str]]) -> list[int]:
    """Of each two lists of words, how many of the first take, in order, the first unused word of the second within two edits."""
    out = _heads(refs, hyps)
    rest = [n for n, (head, a, b) in enumerate(zip(out, refs, hyps, strict=True)) if len(a) > head < len(b)]
    sides = [[side[n][out[n] :] for n in rest] for side in (refs, hyps)]
    short = [len(a) * len(b) <= ALL for a, b in zip(*sides, strict=True)]
    for kind in (True, False):
        some = [n for n, x in enumerate(short) if x == kind]
        for n, found in zip(some, _found(*([side[n] for n in some] for side in sides), kind) if some else (), strict=True):
            out[rest[n]] += found
    return out


def _found(refs: Sequence[Sequence[str]], hyps: Sequence[Sequence[str]], short: bool) -> list[int]:
    """The same of lines that are short or not."""
    words = Vocabulary()
    sides = [np.split(words.coded(chain.from_iterable(side)), np.cumsum([len(x) for x in side])[:-1]) for side in (refs, hyps)]
    words.measured() if short else words.filed()
    out: list[int] = []
    first = 0
    while first < len(sides[0]):
        # lines are looked at together as long as their forms are few
        last, room = first, TOGETHER
        while last < len(sides[0]) and (last == first or room > 0):
            room -= sum(len(side[last]) for side in sides)
            last += 1
        flat = [[np.unique(x) for x in side[first:last]] for side in sides]
        lines = [(np.repeat(np.arange(last - first), [len(x) for x in side]), np.concatenate(side)) for side in flat]
        line, left, right = words.beside(*lines) if short else words.meeting(*lines)
        n = len(words.words)
        pairs, place = np.unique(left * n + right, return_inverse=True)
        fit = words.within(pairs // max(1, n), pairs % max(1, n))[place]
        # a run for each word of a line
        line, left, right = line[fit], left[fit], right[fit]
        order = np.lexsort((left, line))
        line, left, right = line[order], left[order], right[order].tolist()
        cut = np.flatnonzero(np.concatenate(([True], (line[1:] != line[:-1]) | (left[1:] != left[:-1])))) if len(line) else line
        at, left, cut = np.searchsorted(line[cut], np.arange(last - first + 1)).tolist(), left[cut].tolist(), [*cut.tolist(), len(line)]
        for k in range(last - first):
            near = {left[m]: right[cut[m] : cut[m + 1]] for m in range(at[k], at[k + 1])}
            out.append(_taken(sides[0][first + k].tolist(), sides[1][first + k].tolist(), near))
        first = last
    return out


def _heads(refs: Sequence[Sequence[str]], hyps: Sequence[Sequence[str]]) -> list[int]:
    """With how many words two lists begin that are within two edits place by place: each of them takes the one in its place, as those before are used."""
    out = []
    for a, b in zip(refs, hyps, strict=True):
        n = min(len(a), len(b))
        if a != b:
            for k, (x, y) in enumerate(zip(a, b, strict=False)):
                if x != y and not _near(x, y):
                    n = k
                    break
        out.append(n)
    return out


def _taken(a: list[int], b: list[int], near: dict[int, list[int]]) -> int:
    places: dict[int, list[int]] = {}
    for n in range(len(b) - 1, -1, -1):
        places.setdefault(b[n], []).append(n)
    lists = {x: [places[y] for y in ys] for x, ys in near.items()}
    found = 0
    for x in a:
        free, first = None, len(b)
        for at in lists.get(x, ()):
            if at and at[-1] < first:
                free, first = at, at[-1]
        if free:
            free.pop()
            found += 1
    return found
