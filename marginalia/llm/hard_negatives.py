"""Hard negatives by exact inner product search with coordinate pruning (after LEMP).

Vectors are whole numbers; a row's score is its inner product with the anchor. For each
anchor the rows of its label with the highest scores are its positives; for each positive
the negatives are the highest rows of other labels whose score is between two shares of
the positive's.

All rows are sorted by length and cut into buckets of rows alike in length, each stored
with its coordinate lists: for every coordinate of the unit vectors the rows in the order
of its value. Anchors are cut into blocks. A lower bound of what an anchor still looks for
comes from the other anchors of its block, which are rows like any. Then, for an anchor q
with bound t and a bucket of length l at most:

* t > \\|q\\| l: nothing in the bucket can do, and where that holds for all of a block, the
  bucket is not sent to it;
* else each row that can do has an angle of at most arccos(t / (\\|q\\| l)) with q, so its
  value in a coordinate lies within that angle of q's own. For the ``FOCUS`` largest
  coordinates of q the lists give those ranges by binary search; the rows of the shortest
  range that are also within the others are the candidates. Ranges are widened by a margin
  for rounding, so they only ever keep too many;
* candidates get their exact score. Where a bound is not positive, or a range holds most
  of the bucket, all its rows are candidates, and scores of many anchors are one product.

A task holds one bucket and one block of anchors. Only the best of a bucket leave it, and
they are merged by anchor. All blocks of anchors meet all buckets that pruning leaves: the
anchors are a stated set of queries against all rows.

Defined cases: rows with a null label or vector, a null or non-finite component, or a null
id take no part, nor do vectors with a squared length of 2**62 or more, whose scores might
not be whole numbers of 64 bits. Vectors meet those of the same number of components; empty
ones and zeros have the score 0. Repeated rows (same id, label and vector) count once;
rows never meet those with their own id. Ties are ordered by id. An anchor without
positives, and a positive without negatives, have no rows. Empty table: no rows. Other
columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, one_array, partitions_for

#: Rows of a bucket and anchors of a block, and the components that either has at most.
BUCKET = 4096
ANCHORS = 512
WEIGHT = 2_000_000
FOCUS = 5
MARGIN = 1e-9
#: Blocks of anchors whose headers (under 100 bytes each) are broadcast, and the parts they are dealt to beyond.
FEW_BLOCKS = 100_000
SALTS = 64
#: No bound.
NONE = -(1 << 62)
ROWS = "id long, label string, dim int, square long, anchor boolean, vector binary"
PACKED = "dim int, rows int, length double, ids binary, labels array<string>, vectors binary, lists binary"
#: Products of lengths below this are exact in double precision.
EXACT = float(1 << 52)


def prepared(vectors: DataFrame, id_col: str, label: Column, vector: Column, anchors: Column, scale: int) -> DataFrame:
    """The rows that take part: id, label, dim, squared length, whether an anchor, and floor(scale * x) as 32-bit numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    given = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("string").alias("label"), vector.cast("array<double>").alias("vector"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    given = given.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(~F.exists("vector", bad), F.lit(False)))

    def whole(batches):
        for batch in batches:
            lists = one_array(batch.column("vector"))
            lengths = np.asarray(lists.value_lengths()).astype(np.int64)
            flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False) * scale)
            ends = np.cumsum(lengths)
            sums = np.concatenate(([0], np.cumsum(np.where(np.abs(flat) < 2**31, 0, 1))))
            fits = (sums[ends] - sums[ends - lengths]) == 0
            out = []
            for i in np.flatnonzero(fits):
                v = flat[ends[i] - lengths[i] : ends[i]]
                if v @ v < 2.0**62:
                    v = v.astype(np.int64)
                    out.append((int(i), len(v), int(v @ v), v.astype(np.int32).tobytes()))
            some = batch.take(pa.array([x[0] for x in out], pa.int64()))
            columns = [some.column("id"), some.column("label"), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.int64()), some.column("anchor"), pa.array([x[3] for x in out], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "label", "dim", "square", "anchor", "vector"])

    return checkpointed(given.mapInArrow(whole, ROWS))


def packed(rows: DataFrame, most: int, lists: bool, partitions: int) -> DataFrame:
    """Rows of about one length in one: ``block`` and ``PACKED``; ``lists`` adds the coordinate lists."""
    order = ["dim", "square", "id"]

    def pack(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            done = 0
            while (size := _next(table, done, most)) and done + size < table.num_rows:
                yield _pack(table.slice(done, size), lists)
                done += size
            held = table.slice(done).to_batches()
        table = pa.Table.from_batches(held) if held else None
        done = 0
        while table is not None and done < table.num_rows:
            size = _next(table, done, most)
            yield _pack(table.slice(done, size), lists)
            done += size

    sorted_rows = rows.select("id", "label", "dim", "square", "vector").repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    return checkpointed(sorted_rows.mapInArrow(pack, PACKED).withColumn("block", F.monotonically_increasing_id()))


def _next(table: pa.Table, at: int, most: int) -> int:
    """How many rows from there on make the next block: of one number of components, and not too many."""
    if at >= table.num_rows:
        return 0
    dim = np.asarray(one_array(table.column("dim").slice(at, most)))
    here = min(most, max(1, WEIGHT // max(1, int(dim[0]))))
    other = np.flatnonzero(dim[:here] != dim[0])
    return int(other[0]) if len(other) else min(here, len(dim))


def _pack(table: pa.Table, lists: bool) -> pa.RecordBatch:
    dim, n = table.column("dim")[0].as_py(), table.num_rows
    data = b"".join(one_array(table.column("vector")).to_pylist())
    square = np.asarray(one_array(table.column("square"))).astype(float)
    order = b""
    if lists:
        units = unit(np.frombuffer(data, np.int32).reshape(n, dim).astype(float), np.sqrt(square))
        order = np.ascontiguousarray(np.argsort(units, axis=0, kind="stable").T.astype(np.uint16)).tobytes()
    labels = pa.array([one_array(table.column("label")).to_pylist()], pa.list_(pa.string()))
    ids = np.ascontiguousarray(np.asarray(one_array(table.column("id")))).tobytes()
    columns = [pa.array([dim], pa.int32()), pa.array([n], pa.int32()), pa.array([float(np.sqrt(square.max()))]), pa.array([ids], pa.binary()), labels, pa.array([data], pa.binary()), pa.array([order], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["dim", "rows", "length", "ids", "labels", "vectors", "lists"])


def unit(v: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return v / np.where(lengths > 0, lengths, 1)[:, None]


class Block:
    """An unpacked row of ``PACKED``."""

    def __init__(self, dim: int, ids: bytes, labels: list[str], vectors: bytes, lists: bytes = b"") -> None:
        self.ids = np.frombuffer(ids, np.int64)
        self.labels = np.array(labels, object)
        self.whole = np.frombuffer(vectors, np.int32).reshape(len(self.ids), dim)
        self.v = self.whole.astype(float)
        self.lengths = np.sqrt(np.einsum("ij,ij->i", self.v, self.v))
        self.most = self.lengths.max()
        self.units = unit(self.v, self.lengths)
        if lists:
            self.order = np.frombuffer(lists, np.uint16).reshape(dim, len(self.ids))
            self.sorted = np.take_along_axis(self.units.T, self.order.astype(np.int64), 1)

    def scores(self, other: Block, i: np.ndarray, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Inner products of rows i of this block with rows of the other."""
        if self.most * other.most < EXACT:
            return (self.v[i] @ other.v[rows].T).astype(np.int64)
        return self.whole[i].astype(np.int64) @ other.whole[rows].astype(np.int64).T


def candidates(anchors: Block, bound: np.ndarray, bucket: Block) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The anchors that may meet any row of the bucket, and the others that may meet some of its rows with those rows."""
    reach = anchors.lengths * bucket.most
    able = np.flatnonzero(bound <= reach * (1 + MARGIN))
    prunable = able[(bound[able] > 0) & (reach[able] > 0)]
    dim = anchors.v.shape[1]
    if not len(prunable) or not dim:
        return able, []
    q = anchors.units[prunable]
    focus = np.argsort(-np.abs(q), axis=1)[:, :FOCUS]
    own = np.arccos(np.clip(np.take_along_axis(q, focus, 1), -1, 1))
    angle = np.arccos(np.clip(bound[prunable] / reach[prunable] - MARGIN, -1, 1))[:, None]
    low = np.cos(np.minimum(own + angle, np.pi)) - MARGIN
    high = np.cos(np.maximum(own - angle, 0)) + MARGIN
    first, last = np.empty(focus.shape, np.int64), np.empty(focus.shape, np.int64)
    for f in np.unique(focus):
        at = focus == f
        first[at] = np.searchsorted(bucket.sorted[f], low[at])
        last[at] = np.searchsorted(bucket.sorted[f], high[at], side="right")
    sizes = last - first
    some = sizes.min(1) < len(bucket.ids) // 2
    out = []
    for i in np.flatnonzero(some):
        k = sizes[i].argmin()
        rows = bucket.order[focus[i, k], first[i, k] : last[i, k]].astype(np.int64)
        for j in range(focus.shape[1]):
            if j != k and len(rows):
                x = bucket.units[rows, focus[i, j]]
                rows = rows[(x >= low[i, j]) & (x <= high[i, j])]
        if len(rows):
            out.append((int(prunable[i]), rows))
    return np.setdiff1d(able, prunable[some]), out


def scored(anchors: Block, bound: np.ndarray, bucket: Block):
    """(anchor rows, bucket rows, scores) of all candidates with a score of at least the bound."""
    dense, sparse = candidates(anchors, bound, bucket)
    most = max(1, WEIGHT // len(bucket.ids))
    for at in range(0, len(dense), most):
        some = dense[at : at + most]
        s = anchors.scores(bucket, some)
        i, j = np.nonzero(s >= bound[some, None])
        yield some[i], j, s[i, j]
    for i, rows in sparse:
        s = anchors.scores(bucket, np.array([i]), rows)[0]
        kept = s >= bound[i]
        yield np.full(kept.sum(), i), rows[kept], s[kept]


def best(keys: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The places of the k best of each key, highest scores first, ties by id; equal ones once."""
    order = np.lexsort((ids, -scores, keys))
    a, b, c = keys[order], ids[order], scores[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])
    order, a = order[fresh], a[fresh]
    starts = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1]))) if len(a) else np.empty(0, np.int64)
    place = np.arange(len(a)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(a)]))))
    return order[place < k]


def kth(values: np.ndarray, keys: np.ndarray, n: int, k: int) -> np.ndarray:
    """The k-th highest value of each key below n, NONE where there are fewer."""
    order = np.lexsort((-values, keys))
    values, keys = values[order], keys[order]
    starts, ends = np.searchsorted(keys, np.arange(n)), np.searchsorted(keys, np.arange(n), side="right")
    out = np.full(n, NONE)
    full = ends - starts >= k
    out[full] = values[starts[full] + k - 1]
    return out


TARGETS = ("row", "pid", "pscore", "low", "high", "bound")
SEEDED = "ablock long, dim int, ids binary, labels array<string>, vectors binary, reach double, row binary, pid binary, pscore binary, low binary, high binary, bound binary"
FOUND = "ablock long, row long, anchor long, pid long, pscore long, id long, score long"


def codes(a: Block, b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Labels of two blocks as numbers."""
    both = pa.array(np.concatenate([a.labels, b.labels]), pa.string()).dictionary_encode().indices.to_numpy()
    return both[: len(a.ids)], both[len(a.ids) :]


def fitting(anchors: Block, targets: dict[str, np.ndarray], found, other: Block, same: bool):
    """(targets, rows of the other block, scores) of what is found (anchor rows, rows, scores) and is looked for."""
    mine, theirs = codes(anchors, other)
    # the n-th target of each anchor, or -1
    row = targets["row"]
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    slots = np.full((len(anchors.ids), nth.max() + 1 if len(nth) else 0), -1)
    slots[row, nth] = np.arange(len(row))
    for i, j, s in found:
        fit = ((mine[i] == theirs[j]) == same) & (anchors.ids[i] != other.ids[j])
        i, j, s = i[fit], j[fit], s[fit]
        for slot in slots.T:
            t = slot[i]
            at = np.flatnonzero((t >= 0) & (s >= targets["bound"][t]) & (s <= targets["high"][t]))
            yield t[at], j[at], s[at]


def bounds(anchors: Block, targets: dict[str, np.ndarray]) -> np.ndarray:
    """The least bound of each anchor's targets; one without targets admits nothing."""
    out = np.full(len(anchors.ids), -NONE)
    np.minimum.at(out, targets["row"], targets["bound"])
    return out


def seeded(ablocks: DataFrame, same: bool, k: int, low: int, high: int) -> DataFrame:
    """Blocks of anchors with their targets and ``reach``, the least length of a row that any target still admits.

    A target is a search of an anchor: for rows of its label, or, for each of its positives
    (structs row, id, score in ``found``), for rows of other labels within ``low`` and
    ``high`` hundredths of that score. Its bound is the least score that is admitted, or the
    k-th best among the anchors of the block.
    """

    def seed(batches):
        for batch in batches:
            for x in batch.to_pylist():
                block = Block(x["dim"], x["ids"], x["labels"], x["vectors"])
                if same:
                    rows = [(i, 0, 0, NONE, -NONE) for i in range(len(block.ids))]
                else:
                    rows = sorted((p["row"], p["id"], p["score"], -(-low * p["score"] // 100), high * p["score"] // 100) for p in x["found"])
                    rows = [r for r in rows if r[3] <= r[4]]
                if not rows:
                    continue
                t = {name: np.array([r[c] for r in rows], np.int64) for c, name in enumerate(TARGETS[:-1])}
                t["bound"] = np.full(len(rows), NONE)
                hits = list(fitting(block, t, scored(block, bounds(block, t), block), block, same))
                keys, scores = (np.concatenate([h[c] for h in hits]) for c in (0, 2))
                t["bound"] = np.maximum(t["low"], kth(scores, keys, len(rows), k))
                reach = float(np.where(t["bound"] > 0, t["bound"] / np.maximum(block.lengths[t["row"]], 1e-300), -np.inf).min())
                held = [pa.array([x[c]], kind) for c, kind in (("ablock", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("labels", pa.list_(pa.string())), ("vectors", pa.binary()))]
                held += [pa.array([reach]), *(pa.array([t[name].tobytes()], pa.binary()) for name in TARGETS)]
                yield pa.RecordBatch.from_arrays(held, names=["ablock", "dim", "ids", "labels", "vectors", "reach", *TARGETS])

    return checkpointed(ablocks.mapInArrow(seed, SEEDED))


def searched(blocks: DataFrame, ablocks: DataFrame, same: bool, k: int) -> DataFrame:
    """The k best rows of each target that each bucket has, as ``FOUND``."""

    def search(batches):
        last, bucket = None, None
        for batch in batches:
            for x in batch.to_pylist():
                if x["block"] != last:
                    last, bucket = x["block"], Block(x["dim"], x["bids"], x["blabels"], x["bvectors"], x["lists"])
                anchors = Block(x["dim"], x["ids"], x["labels"], x["vectors"])
                t = {name: np.frombuffer(x[name], np.int64) for name in TARGETS}
                for key, j, s in fitting(anchors, t, scored(anchors, bounds(anchors, t), bucket), bucket, same):
                    top = best(key, bucket.ids[j], s, k)
                    key, ids, s = key[top], bucket.ids[j[top]], s[top]
                    columns = [np.full(len(top), x["ablock"]), t["row"][key], anchors.ids[t["row"][key]], t["pid"][key], t["pscore"][key], ids, s]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["ablock", "row", "anchor", "pid", "pscore", "id", "score"])

    heads = ablocks.select("ablock", "dim", "reach")
    near = blocks.select("block", "dim", "length")
    if ablocks.count() <= FEW_BLOCKS:
        pairs = near.join(F.broadcast(heads), "dim")
    else:
        salted = heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        pairs = near.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int")).join(salted, ["dim", "salt"])
    pairs = pairs.filter(F.col("reach") <= F.col("length") * (1 + MARGIN)).select("block", "ablock")
    # the anchors go to the buckets, which are larger; sorted by bucket, so one is unpacked once
    pairs = pairs.join(ablocks.drop("reach", "dim"), "ablock")
    theirs = blocks.select("block", "dim", F.col("ids").alias("bids"), F.col("labels").alias("blabels"), F.col("vectors").alias("bvectors"), "lists")
    return pairs.hint("merge").join(theirs, "block").mapInArrow(search, FOUND)


def ranked(found: DataFrame, k: int, partitions: int) -> DataFrame:
    """The k best rows of each target of all buckets' best, with ``rank``."""
    key = ["ablock", "row", "pid", "pscore"]
    found = found.repartition(partitions, *key).distinct()
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "id"))
    return checkpointed(found.withColumn("rank", place).filter(F.col("rank") <= k))


def hard_negatives(vectors: DataFrame, anchors: Column, *, id_col: str = "vec_id", label: Column | None = None, vector_col: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """One row a negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` is true for the anchors. Components become floor(scale * x). Negatives have
    a score between ``low`` and ``high`` hundredths of their positive's, ends included.
    """
    rows = prepared(vectors, id_col, F.col("label") if label is None else label, F.col(vector_col), anchors, scale)
    n, asked, dim = rows.agg(F.count(F.lit(1)), F.count_if("anchor"), F.max("dim")).first()
    room = max(1, WEIGHT // max(1, dim or 1))
    blocks = packed(rows, 2 * BUCKET, True, max(1, -(-n // min(BUCKET, room))))
    chosen = rows.filter("anchor").dropDuplicates(["id", "label", "vector"])
    ablocks = packed(chosen, 2 * ANCHORS, False, max(1, -(-(asked or 0) // min(ANCHORS, room)))).withColumnRenamed("block", "ablock")

    parts = partitions_for(vectors)
    first = ranked(searched(blocks, seeded(ablocks, True, positives, low, high), True, positives), positives, parts)
    lists = first.groupBy("ablock").agg(F.collect_list(F.struct("row", "id", "score")).alias("found"))
    second = seeded(ablocks.join(lists, "ablock"), False, negatives, low, high)
    out = ranked(searched(blocks, second, False, negatives), negatives, parts)
    return out.select(F.col("anchor").alias("anchor_id"), F.col("pid").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("pscore").alias("positive_score"), F.col("score").alias("negative_score"))
