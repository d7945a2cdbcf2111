"""Benchmark decontamination by greedy string tiling.

Tokens are words in lower case without punctuation around them. A document and a test
item that share a seed, ``least`` consecutive tokens, are candidates. A pair whose seeds
could cover enough of the item is tiled: the longest match of unmarked tokens is marked
in both, again and again, until no match of ``least`` tokens is left; matches are found
from a Karp-Rabin table of the seeds. The share of the item's tokens in tiles is the
coverage, whatever the order of the passages in the document. A document is contaminated
if an item is covered to ``threshold`` or more.

The benchmark is shipped in passes of at most ``PASS_CHARS`` characters (an item that is
longer is a pass of its own); a pass is a map over the documents without a shuffle.

Defined cases: null or empty text, null or empty item text: no match.
An item without an id counts like any other and is named ``NO_ID``. Items shorter than a
seed are matched as a whole. Repeated items count once each. Of items covered alike the
smallest id is named. No benchmark: nothing is contaminated. Repeated rows are judged
alike. Very long texts are read whole, one at a time; a tiling takes memory by the text's
length, also where text and item repeat themselves. Empty table: no rows. Other columns
pass through; those named like a result column are replaced.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, among, slices, split_words, unused, window_starts, windows

LEAST = 4
THRESHOLD = 0.5
PASS_CHARS = 4_000_000
#: Seeds of a pair that are looked at together.
PAIRS = 1_000_000
NO_ID = (1 << 63) - 1
STRIP = ".,;:!?\"'()[]{}<>|*#%&-_/\\«»“”‘’"
RESULT = "item_id long, coverage double, n_items long"


def tokens(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashed tokens of all texts and where each text's begin."""
    words, offsets = split_words(texts)
    if not len(words):
        return np.empty(0, U64), offsets
    coded = words.dictionary_encode()
    clean = [w.lower().strip(STRIP) for w in coded.dictionary.to_pylist()]
    code = coded.indices.to_numpy(zero_copy_only=False)
    full = np.fromiter(map(bool, clean), bool, len(clean))[code]
    values = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in clean), U64, len(clean))[code]
    return values[full], np.concatenate(([0], np.cumsum(full)))[offsets]


def _runs(i: np.ndarray, j: np.ndarray, n: np.ndarray, step: int) -> tuple[np.ndarray, ...]:
    """Matches that follow one another on a diagonal as one: starts in item and document, and how many."""
    if not len(i):
        return i, j, n
    order = np.lexsort((j, j - i))
    i, j, n = i[order], j[order], n[order]
    new = np.ones(len(i), bool)
    new[1:] = ((j - i)[1:] != (j - i)[:-1]) | (j[1:] > j[:-1] + n[:-1] - step + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(i)) - 1
    return i[first], j[first], (j + n)[last] - j[first]


def matches(item: np.ndarray, doc: np.ndarray, least: int, pairs: int = PAIRS) -> tuple[np.ndarray, ...]:
    """The longest matches of at least ``least`` tokens: starts in item and document, and lengths.

    Seeds are looked up in a Karp-Rabin table of the item, ``pairs`` of them at a time, and
    kept as runs on a diagonal; so repetitive texts take memory by their length.
    """
    table, found = windows(item, least), windows(doc, least)
    order = np.argsort(table, kind="stable")
    low = np.searchsorted(table[order], found, side="left")
    each = np.searchsorted(table[order], found, side="right") - low
    ends = np.cumsum(each)
    runs = [(np.empty(0, np.int64),) * 3]
    start = 0
    while start < len(found):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + pairs, side="right")))
        n = each[start:stop]
        j = np.repeat(np.arange(start, stop), n)
        i = order[np.repeat(low[start:stop], n) + np.arange(len(j)) - np.repeat(np.cumsum(n) - n, n)]
        same = np.logical_and.reduce([item[i + d] == doc[j + d] for d in range(least)])
        if same.any():
            i, j = i[same], j[same]
            runs.append(_runs(i, j, np.full(len(i), least, np.int64), least))
        start = stop
    return _runs(*(np.concatenate([r[x] for r in runs]) for x in range(3)), least)


def _without(start: np.ndarray, other: np.ndarray, n: np.ndarray, low: int, high: int, least: int) -> tuple[np.ndarray, ...]:
    """The matches without what starts from ``low`` to ``high`` on the side of ``start``: a part before and one after."""
    before = np.clip(low - start, 0, n)
    skip = np.clip(high - start, 0, n)
    clear = (skip == 0) | (before == n)
    parts = [(start, other, np.where(clear, n, before)), (start + skip, other + skip, np.where(clear, 0, n - skip))]
    start, other, n = (np.concatenate([p[x] for p in parts]) for x in range(3))
    keep = n >= least
    return start[keep], other[keep], n[keep]


def tiled(item: np.ndarray, doc: np.ndarray, least: int = LEAST) -> int:
    """Tokens of the item in the tiles of a greedy string tiling: longest first, at a tie the first in item, then document."""
    least = min(least, len(item))
    if not least or len(doc) < least:
        return 0
    i, j, n = matches(item, doc, least)
    total = 0
    while len(n):
        longest = np.flatnonzero(n == n.max())
        at = longest[np.lexsort((j[longest], i[longest]))[0]]
        a, b, size = int(i[at]), int(j[at]), int(n[at])
        total += size
        i, j, n = _without(i, j, n, a, a + size, least)
        j, i, n = _without(j, i, n, b, b + size, least)
    return total


def _matcher(items: list[tuple[int, str]], least: int, threshold: float):
    """A scalar function from text to the best item, its coverage and the number of items over the threshold."""
    ids = [i for i, _ in items]
    flat, offsets = tokens(pa.array([t for _, t in items], pa.string()))
    parts = [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    seeds: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
    for n, part in enumerate(parts):
        if width := min(least, len(part)):
            for at, h in enumerate(windows(part, width).tolist()):
                seeds[width][h].append((n, at))
    seeds = {w: dict(x) for w, x in seeds.items()}
    tables = {w: np.sort(np.fromiter(x, U64, len(x))) for w, x in seeds.items()}

    @F.arrow_udf(RESULT)
    def match(text: pa.Array) -> pa.Array:
        best, coverage, over = np.full(len(text), NO_ID, np.int64), np.zeros(len(text)), np.zeros(len(text), np.int64)
        base = 0
        for part in slices(pa.table({"t": text}), "t"):
            doc_tokens, doc_at = tokens(part.column("t"))
            covered: dict[tuple[int, int], set[int]] = defaultdict(set)
            for width, table in tables.items():
                starts = window_starts(doc_at, width)
                found = windows(doc_tokens, width)[starts] if len(starts) else np.empty(0, U64)
                hit = among(found, table)
                rows = np.searchsorted(doc_at, starts[hit], side="right") - 1
                pairs = np.unique(np.stack((rows.astype(U64), found[hit])), axis=1)
                for row, h in zip(*pairs.tolist(), strict=True):
                    for n, at in seeds[width][h]:
                        covered[row, n].update(range(at, at + width))
            for (row, n), at in covered.items():
                if len(at) < threshold * len(parts[n]):
                    continue
                share = tiled(parts[n], doc_tokens[doc_at[row] : doc_at[row + 1]], least) / len(parts[n])
                i = base + row
                over[i] += share >= threshold
                if share > coverage[i] or (share == coverage[i] and ids[n] < best[i]):
                    best[i], coverage[i] = ids[n], share
            base += part.num_rows
        return pa.StructArray.from_arrays([pa.array(best, pa.int64(), mask=coverage == 0), pa.array(coverage), pa.array(over)], names=["item_id", "coverage", "n_items"])

    return match


def _better(a: Column, b: Column) -> Column:
    """The result of two passes together."""
    first = (a["coverage"] > b["coverage"]) | ((a["coverage"] == b["coverage"]) & (b["item_id"].isNull() | (a["item_id"] <= b["item_id"])))
    return F.struct(F.when(first, a["item_id"]).otherwise(b["item_id"]).alias("item_id"), F.greatest(a["coverage"], b["coverage"]).alias("coverage"), (a["n_items"] + b["n_items"]).alias("n_items"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", least: int = LEAST, threshold: float = THRESHOLD, pass_chars: int = PASS_CHARS) -> DataFrame:
    """The documents with ``item_id`` (best covered, null below half of the threshold's seeds), ``coverage``, ``n_items`` and ``contaminated``."""
    items = benchmark.filter(F.col(item_text).isNotNull()).select(F.coalesce(F.col(item_id).cast("long"), F.lit(NO_ID)).alias("id"), F.col(item_text).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = -(-2 * total // pass_chars) if total > pass_chars else 1
    passed: list[str] = []
    out = docs.drop(*({"item_id", "coverage", "n_items", "contaminated"} - {text_col}))
    for n in range(passes):
        some = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(passes)) == n) if passes > 1 else items
        if rows := [(r["id"], r["text"]) for r in some.orderBy("id", "text").collect()]:
            passed.append(unused(out, f"__pass{n}"))
            out = out.withColumn(passed[-1], _matcher(rows, least, threshold)(F.col(text_col)))
    found = reduce(_better, map(F.col, passed)) if passed else F.lit(None).cast("struct<item_id:long,coverage:double,n_items:long>")
    best = unused(out, "__found")
    out = out.withColumn(best, found)
    out = out.withColumns({"item_id": F.col(f"{best}.item_id"), "coverage": F.coalesce(f"{best}.coverage", F.lit(0.0)), "n_items": F.coalesce(f"{best}.n_items", F.lit(0).cast("long"))})
    return out.withColumn("contaminated", (F.col("n_items") > 0).cast("int")).drop(best, *passed)
