"""Plain versions of the operators, for small tables."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
M = (1 << 64) - 1


def words(text):
    return WORD.findall(text or "")


# -- toxicity --------------------------------------------------------------------------


def scrambled(x):
    for _ in range(2):
        x = ((x ^ x >> 32) * 0xD6E8FEB86659FD93) & M
    return x ^ x >> 32


def paired(a, b):
    return scrambled((a * 0x9E3779B97F4A7C15 + ((b << 29 | b >> 35) & M)) & M)


def buckets(text, strip, n):
    """Words, neighbours and pairs with one word between, hashed."""
    h = [xxhash.xxh3_64_intdigest(w.lower().strip(strip)) for w in words(text)]
    found = {scrambled(x) % n for x in h}
    for gap, salt in ((1, 0x51), (2, 0xA7)):
        found |= {paired(a, b ^ salt) % n for a, b in zip(h, h[gap:])}
    return found


class Ftrl:
    """FTRL-proximal with dictionaries for the coordinates."""

    def __init__(self, rows, labels, alpha=2.0, beta=1.0, l1=3.0, l2=0.01, epochs=6, seed=5):
        self.p, self.n, self.z = (alpha, beta, l1, l2), Counter(), Counter()
        draw = np.random.default_rng(seed)
        for _ in range(epochs):
            for i in draw.permutation(len(rows)):
                g = self.chance(rows[i]) - labels[i]
                for k in [*rows[i], None]:
                    w = self.weight(k)
                    step = (math.sqrt(self.n[k] + g * g) - math.sqrt(self.n[k])) / alpha
                    self.z[k] += g - step * w
                    self.n[k] += g * g

    def weight(self, k):
        alpha, beta, l1, l2 = self.p
        z, l1 = self.z[k], l1 if k is not None else 0
        return 0 if abs(z) <= l1 else -(z - math.copysign(l1, z)) / ((beta + math.sqrt(self.n[k])) / alpha + l2)

    def chance(self, row):
        total = sum(self.weight(k) for k in [*row, None])
        return 1 / (1 + math.exp(-max(-35, min(35, total))))


# -- near copies, spans ----------------------------------------------------------------


def jaccard_links(rows, threshold=0.8):
    """Rows (id, text), and by number the others with a similarity from the threshold on."""
    rows = sorted({(r[0], r[1]) for r in rows}, key=str)
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := words(t)) else set() for _, t in rows]
    links = {i: set() for i in range(len(rows))}
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j and a and len(a & b) >= threshold * len(a | b):
                links[i].add(j)
    return rows, links


def component_of(links, i):
    seen, todo = {i}, [i]
    while todo:
        new = links[todo.pop()] - seen
        seen |= new
        todo += new
    return seen


def spans(rows, window):
    """By id: (words, words removed, kept text) of its rows."""
    first, out = {}, {}
    ordered = sorted(rows, key=lambda r: (r[0], r[1] or "\U0010ffff"))
    for place, r in enumerate(ordered):
        w = words(r[1])
        for s in range(len(w) - window + 1):
            first.setdefault(tuple(w[s : s + window]), (place, s))
    for place, r in enumerate(ordered):
        w, gone = words(r[1]), set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] != (place, s):
                gone |= set(range(s, s + window))
        out.setdefault(r[0], []).append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return {k: sorted(v) for k, v in out.items()}


# -- benchmark -------------------------------------------------------------------------


def clean(text, strip):
    return [x for w in words(text) if (x := w.lower().strip(strip))]


def tiled(item, doc, least):
    """Greedy string tiling by comparing all places, again for each tile."""
    least = min(least, len(item))
    free_a, free_b, total = [True] * len(item), [True] * len(doc), 0
    while least:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and free_a[i + n] and free_b[j + n] and item[i + n] == doc[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            break
        free_a[i : i + n] = free_b[j : j + n] = [False] * n
        total += n
    return total


def leaks(docs, items, least, threshold, strip):
    """By document id: items covered to the threshold, and the best of them."""
    out = {}
    for i, text in docs:
        mine = clean(text, strip)
        covered = [(-tiled(item, mine, least) / len(item), k) for k, t in items if (item := clean(t, strip))]
        over = sorted(c for c in covered if -c[0] >= threshold)
        out[i] = (len(over), over[0][1] if over else None)
    return out


# -- mixing ----------------------------------------------------------------------------


def filled(sizes, weights=(1, 2, 3), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, total = {}, set(names), sum(sizes.values())
    while left:
        free = total - sum(target.values())
        over = {s for s in left if free * weight[s] / sum(weight[t] for t in left) > cap * sizes[s]}
        if not over:
            return target | {s: free * weight[s] / sum(weight[t] for t in left) for s in left}
        target |= {s: cap * sizes[s] for s in over}
        left -= over
    return target


def mixed(docs, worth, seed=17):
    """(id, source, words) to words taken, by drawing all documents of a source in order of their keys."""
    sizes = Counter()
    for _, s, n in docs:
        sizes[s] += n
    taken, target = {}, filled(sizes)
    for s in sizes:
        def key(d):
            u = (int(hashlib.md5(f"{seed}:{d[0]}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
            return -math.log(u) / worth.get(d[0], 1.0)

        epochs = int(target[s] / sizes[s]) if sizes[s] else 0
        rest = math.floor(target[s] - epochs * sizes[s])
        for d in sorted((d for d in docs if d[1] == s), key=key):
            part = max(0, min(d[2], rest))
            rest -= d[2]
            taken[d[0]] = epochs * d[2] + part
    return taken


# -- licenses --------------------------------------------------------------------------


def licensed(docs, notices, full, threshold, span, clean_words, file_names):
    """(id, path, text) to (license, how, directory it is from): every run of lines against every notice."""
    tokens = {i: [clean_words(line) for line in (text or "").split("\n")] for i, _, text in docs}
    df = Counter(w for lines in tokens.values() for w in {w for line in lines for w in line})

    def vector(ws):
        v = {w: n * (1 + math.log((1 + len(docs)) / (1 + df[w]))) for w, n in Counter(ws).items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    def best(ws, templates):
        v = vector(ws)
        return min((-sum(x * v.get(w, 0) for w, x in t.items()), name) for name, t in templates)

    short = [(name, vector(clean_words(t))) for name, t in notices]
    every = short + [(name, vector(clean_words(t))) for name, t in full]
    most = int(span * max(len(clean_words(t)) for _, t in notices))
    own = {}
    for i, _, _ in docs:
        lines = [x for x in tokens[i] if x]
        found = []
        for a in range(len(lines)):
            for b in range(a + 1, len(lines) + 1):
                run = [w for line in lines[a:b] for w in line]
                if b == a + 1 or len(run) <= most:
                    found.append((*best(run, short), False))
        whole = [w for line in lines for w in line]
        if whole:
            found.append((*best(whole, every), True))
        found = [f for f in found if -f[0] >= threshold]
        if found:
            score, name, _ = min(found)
            own[i] = (name, any(f[2] for f in found), score)
    speaking = {}
    for i, path, _ in docs:
        if path and i in own:
            folder, _, name = path.rpartition("/")
            if own[i][1] or re.match("[a-z]*", name.lower())[0] in file_names:
                speaking.setdefault(folder, []).append((own[i][2], own[i][0], i))
    out = {}
    for i, path, _ in docs:
        out[i] = (own[i][0], "own", None) if i in own else (None, "none", None)
        folder = path and path.rpartition("/")[0]
        while i not in own and path is not None:
            if folder in speaking:
                out[i] = (min(speaking[folder])[1], "inherited", folder)
                break
            if not folder:
                break
            folder = folder.rpartition("/")[0]
    return out
