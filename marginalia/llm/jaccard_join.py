"""N-gram Jaccard self-join: a MinHash LSH forest with exact verification.

Texts become sets of runs of ``width`` words (a shorter text is one run). Each of
``TREES`` tries holds the texts under labels of ``DEEPEST`` MinHash values. The labels of a
trie are sorted over range partitions; the longest prefix that a text shares with any
other is the one it shares with a neighbour in that order.

A text starts with its longest matched prefixes and shortens them adaptively. It stops
at once if they are so short in all trees together that a text with a partner at the
threshold has such matches only with a chance of ``MISSED`` (``least_matched``). The others
shorten to the length at which a pair at the threshold shares a prefix in some tree with
the target recall (``prefix_length``); no trie node is read below it. Texts under one such
prefix are compared exactly by their sets (see ``bucket_join``: identical texts are one
class, hot nodes are cut into chunks, no pairs are written out).

The members of a hot node are shipped as what they lack of, and have beyond, the set of
one of them, the pivot: near copies differ from it in a few runs, so that the chunks a
member meets get those few numbers and not its text.

Defined cases: null text or no words: links with nothing. Repeated rows (same id, same
text) are one document; one id with several texts is several documents. Null id: a
document like any, its id is least in order. Very long texts: their sets are built whole,
one text at a time. Empty table: no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bucket_join import NULL_ID, bucket_tasks, compared, groups, node_of, paired, resolved
from .common import U64, byte_rows, checkpointed, hashed, joined, mixed, one_array, partitions_for, slices, split_words, window_starts, windows, words_of_bytes

WIDTH = 5
THRESHOLD = 0.8
TREES = 16
DEEPEST = 6
RECALL = 0.9995
#: The chance that a text with one partner at the threshold stops at once.
MISSED = 1e-4
CHUNK = 256
#: Runs of words in a chunk.
WEIGHT = 2_000_000
#: Bytes of a run's hash in a set.
HASH = 8
#: Columns of the incidence matrix that are multiplied at a time.
COLUMNS = 4096


def prefix_length(threshold: float, trees: int = TREES, recall: float = RECALL) -> int:
    """The longest prefix at which a pair at the threshold meets in some tree with the recall."""
    return next((d for d in range(DEEPEST, 0, -1) if 1 - (1 - threshold**d) ** trees >= recall), 1)


def least_matched(threshold: float, trees: int = TREES, missed: float = MISSED) -> int:
    """The matched lengths of all trees together that a pair at the threshold falls short of with a chance of ``missed`` at most."""
    each = np.array([threshold**d * (1 - threshold) for d in range(DEEPEST)] + [threshold**DEEPEST])
    total = np.ones(1)
    for _ in range(trees):
        total = np.convolve(total, each)
    return int(np.searchsorted(np.cumsum(total), missed, side="right"))


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def shingles(texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed runs of words of all texts, and where each text's begin."""
    words, offsets = split_words(texts)
    h, lengths = hashed(words), np.diff(offsets)
    starts = window_starts(offsets, width)
    values = windows(h, width)[starts] if len(starts) else np.empty(0, U64)
    row = np.searchsorted(offsets, starts, side="right") - 1
    for n in range(1, width):
        short = np.flatnonzero(lengths == n)
        if len(short):
            values = np.concatenate((values, windows(h, n)[offsets[short]] ^ U64(n)))
            row = np.concatenate((row, short))
    order = np.argsort(row, kind="stable")
    return values[order], np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(lengths)))))


def labels_of(values: np.ndarray, offsets: np.ndarray, trees: int) -> np.ndarray:
    """For each text and tree the label: ``DEEPEST`` MinHash values of 32 bits."""
    draw = np.random.default_rng(20)
    full = np.flatnonzero(np.diff(offsets))
    out = np.zeros((len(offsets) - 1, trees, DEEPEST), np.uint32)
    for tree in range(trees):
        for depth in range(DEEPEST):
            flip, odd = draw.integers(0, 1 << 63, 2, dtype=np.uint64)
            if len(full):
                out[full, tree, depth] = mixed(np.minimum.reduceat((values ^ flip) * (odd | U64(1)), offsets[full])) >> U64(32)
    return out


def nodes_of(labels: np.ndarray, trees: np.ndarray, depth: int) -> np.ndarray:
    """The trie nodes that labels of the trees are under: a hash of tree and first ``depth`` values."""
    out = trees.astype(U64)
    for d in range(depth):
        out = joined(out, mixed(labels[..., d].astype(U64)))
    return out.view(np.int64)


def as_labels(column) -> np.ndarray:
    return byte_rows(column, 4 * DEEPEST).view(">u4")


def signed(batches, width: int, trees: int):
    for batch in batches:
        for part in slices(batch, "text"):
            values, offsets = shingles(part.column("text"), width)
            labels = labels_of(values, offsets, trees).astype(">u4").reshape(part.num_rows * trees, -1)
            places = np.arange(0, len(labels) + 1, trees, dtype=np.int32)
            paths = pa.ListArray.from_arrays(places, words_of_bytes(labels.view(np.uint8)))
            yield pa.RecordBatch.from_arrays([one_array(part.column("id")), one_array(part.column("key")), pa.array(np.diff(offsets)), paths], names=["id", "key", "n", "labels"])


def _paths(batch: pa.RecordBatch) -> np.ndarray:
    """Tree and label of each row, as numbers whose common prefix tells how far labels agree."""
    return np.concatenate((np.asarray(batch.column("table"))[:, None].astype(np.int64), as_labels(batch.column("label")).astype(np.int64)), axis=1)


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many values of their labels the rows share; 0 in different trees."""
    return np.maximum(np.cumprod(a == b, axis=1).sum(1) - 1, 0)


def longest_matches(sorted_labels: DataFrame, depth: int) -> DataFrame:
    """(key, table, bucket, matched) of the rows (key, table, label) that share a prefix with another.

    ``bucket`` is the trie node of the first ``depth`` values.

    The rows are checkpointed in order of (table, label) over their partitions. The first
    and last label of each partition, a hundred bytes, go to the driver, so that neighbours
    across partitions are compared too.
    """

    def ends(batches):
        first = last = None
        for batch in batches:
            if batch.num_rows:
                paths = _paths(pa.RecordBatch.from_arrays([batch.column(c).take(pa.array([0, batch.num_rows - 1])) for c in ("table", "label")], names=["table", "label"]))
                first, last = (paths[0] if first is None else first), paths[1]
        if first is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "first": [first.tolist()], "last": [last.tolist()]})

    edges = sorted(map(tuple, sorted_labels.select("table", "label").mapInArrow(ends, "part int, first array<long>, last array<long>").collect()))
    before = {p: edges[n - 1][2] for n, (p, _, _) in enumerate(edges) if n}
    after = {p: edges[n + 1][1] for n, (p, _, _) in enumerate(edges) if n + 1 < len(edges)}

    def match(batches):
        part = TaskContext.get().partitionId()
        nothing = np.full(DEEPEST + 1, -1, np.int64)
        past, held = np.array(before.get(part, nothing)), None

        def matched(batch, following):
            paths = _paths(batch)
            around = np.concatenate((past[None], paths, following[None]))
            far = np.maximum(_shared(around[:-2], paths), _shared(paths, around[2:]))
            at = np.flatnonzero(far)
            rows = [batch.column(c).take(pa.array(at)) for c in ("key", "table")]
            node = nodes_of(paths[at, 1:], paths[at, 0], depth)
            return paths[-1], pa.RecordBatch.from_arrays([*rows, pa.array(node), pa.array(far[at].astype(np.int32))], names=["key", "table", "bucket", "matched"])

        for batch in batches:
            if batch.num_rows:
                if held is not None:
                    past, out = matched(held, _paths(batch.slice(0, 1))[0])
                    yield out
                held = batch
        if held is not None:
            yield matched(held, np.array(after.get(part, nothing)))[1]

    return sorted_labels.mapInArrow(match, "key binary, table int, bucket long, matched int")


def packed(values: np.ndarray) -> bytes:
    """Sorted distinct hashes, the first ``HASH`` bytes of each."""
    bytes_ = np.unique(values >> U64(64 - 8 * HASH)).astype(">u8").view(np.uint8)
    return bytes_.reshape(-1, 8)[:, 8 - HASH :].tobytes()


def unpacked(sketch: bytes) -> np.ndarray:
    whole = np.zeros((len(sketch) // HASH, 8), np.uint8)
    whole[:, 8 - HASH :] = np.frombuffer(sketch, np.uint8).reshape(-1, HASH)
    return whole.view(">u8").ravel().astype(U64)


def set_rows(batches, width: int, depth: int):
    """The set of each text, sorted, in place of the text; trie nodes in place of labels."""
    for batch in batches:
        for part in slices(batch, "text"):
            values, offsets = shingles(part.column("text"), width)
            sets = [packed(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            lists = one_array(part.column("labels"))
            trees = len(lists.flatten()) // max(len(lists), 1)
            nodes = nodes_of(as_labels(lists.flatten()), np.tile(np.arange(trees), len(lists)), depth)
            buckets = pa.ListArray.from_arrays(np.arange(0, len(nodes) + 1, trees, dtype=np.int32), pa.array(nodes))
            yield pa.RecordBatch.from_arrays([one_array(part.column("node")), one_array(part.column("size")), buckets, pa.array(sets, pa.binary())], names=["node", "size", "buckets", "sketch"])


SKETCH = "node binary, size long, buckets array<long>, sketch binary"


def from_pivot(batches):
    """Members of a chunk as their difference to the pivot, which is the first row of its group."""
    for table, starts in groups(batches, ("bucket", "chunk")):
        sets = [unpacked(x) for x in table.column("sketch").to_pylist()]
        own, shares, pivots, differ = [], [], [], []
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            pivot = sets[a]
            for k in range(a + 1, b):
                same = np.intersect1d(sets[k], pivot, assume_unique=True)
                own.append(k)
                shares.append(len(same))
                pivots.append(len(pivot))
                differ.append(packed(np.setxor1d(sets[k], pivot, assume_unique=True) << U64(64 - 8 * HASH)))
        kept = table.take(pa.array(own, pa.int64())).drop_columns(["member", "sketch"])
        counts = pa.array([len(sets[k]) for k in own], pa.int64())
        yield from kept.append_column("count", counts).append_column("shared", pa.array(shares, pa.int64())).append_column("pivot_count", pa.array(pivots, pa.int64())).append_column("sketch", pa.array(differ, pa.binary())).to_batches()


def alike_sets(threshold: float):
    """Finds the pairs of rows of a group with a Jaccard similarity of at least the threshold.

    A and B share |A n P| + |B n P| - |P| members and those that their differences to P
    share; where there is no pivot P is empty and the differences are the sets.
    """

    def alike(table: pa.Table, starts: np.ndarray):
        count, shared, pivot = (np.asarray(one_array(table.column(c))) for c in ("count", "shared", "pivot_count"))
        sketches = one_array(table.column("sketch"))
        sizes = np.asarray(pc.binary_length(sketches)) // HASH
        for first, last in zip(starts[:-1], starts[1:], strict=True):
            if last - first < 2:
                continue
            owner = np.repeat(np.arange(last - first), sizes[first:last])
            values = unpacked(b"".join(sketches[first:last].to_pylist()))
            common = incidence(values, owner, last - first) + shared[first:last, None] + shared[None, first:last] - pivot[first]
            both = count[first:last, None] + count[None, first:last] - common
            i, j = np.nonzero(np.triu(common >= threshold * both - 1e-9, 1))
            yield i + first, j + first

    return alike


def incidence(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many values each two owners share."""
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    common = np.zeros((n, n))
    if not len(values):
        return common
    code = np.concatenate(([0], np.cumsum(values[1:] != values[:-1])))
    several = np.bincount(code)[code] > 1
    code, owner = code[several], owner[several]
    code = np.unique(code, return_inverse=True)[1]
    for low in range(0, int(code.max(initial=-1)) + 1, COLUMNS):
        a, b = np.searchsorted(code, (low, low + COLUMNS))
        dense = np.zeros((n, int(code[b - 1]) - low + 1), np.float32)
        dense[owner[a:b], code[a:b] - low] = 1
        common += dense @ dense.T
    return common


def jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, chunk: int = CHUNK, weight: int = WEIGHT) -> DataFrame:
    """One row a document: ``doc_id``, ``text_key``, ``class_id`` (least id with the same text), ``n_links``, ``component_id`` (least id that links lead to) and ``kept``."""
    depth, least = prefix_length(threshold, trees, recall), least_matched(threshold, trees)
    n = partitions_for(docs)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("key"))

    light = checkpointed(rows.select("id", "key").distinct())
    first = light.filter("key is not null").groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("size"))
    # a class has the labels, and later the text, of the one row with its least id
    labelled = rows.mapInArrow(lambda batches: signed(batches, width, trees), "id long, key binary, n long, labels array<binary>").filter("n > 0")
    classes = labelled.join(first, ["key", "id"]).dropDuplicates(["key", "id"])
    classes = checkpointed(classes.select(node_of(F.col("id"), F.col("key")).alias("node"), "key", F.col("id").alias("class_id"), "size", "n", "labels"))

    forest = classes.select("key", F.posexplode("labels").alias("table", "label"))
    forest = checkpointed(forest.repartitionByRange(n, "table", "label", "key").sortWithinPartitions("table", "label", "key"))
    near = checkpointed(longest_matches(forest, depth))
    hopeful = near.groupBy("key").agg(F.sum("matched").alias("s")).filter(F.col("s") >= least).select("key")
    members = near.filter(F.col("matched") >= depth).join(hopeful, "key", "left_semi").join(classes.select("key", "node", "n"), "key")
    tasks = bucket_tasks(members.select("node", "table", "bucket", "n"), chunk, weight)

    wanted = tasks.select("node").distinct().join(classes, "node").select("node", "key", F.col("class_id").alias("id"), "size", "labels")
    texts = rows.join(wanted, ["key", "id"]).dropDuplicates(["key", "id"]).select("node", "size", "labels", "text")
    sets = checkpointed(texts.mapInArrow(lambda batches: set_rows(batches, width, depth), SKETCH))

    whole = {"count": F.floor(F.length("sketch") / HASH).cast("long"), "shared": F.lit(0).cast("long"), "pivot_count": F.lit(0).cast("long")}
    cold = tasks.filter("chunks = 1").drop("pivot").join(sets, "node").withColumns(whole)
    hot = tasks.filter("chunks > 1")
    chunked = hot.drop("pivot").join(sets, "node").withColumn("member", F.lit(1))
    pivots = hot.filter("node = pivot").drop("pivot").join(sets, "node").withColumns({"member": F.lit(0), "chunk": F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))})
    chunked = chunked.unionByName(pivots).repartition(n, "bucket", "chunk").sortWithinPartitions("bucket", "chunk", "member")
    fields = "node binary, table int, bucket long, chunks int, chunk int, size long, buckets array<long>, count long, shared long, pivot_count long, sketch binary"
    differing = chunked.select("node", "table", "bucket", "chunks", "chunk", "size", "buckets", "member", "sketch").mapInArrow(from_pivot, fields)
    found = compared(paired(cold.unionByName(checkpointed(differing))), alike_sets(threshold), n)
    return resolved(light, classes, found).withColumnsRenamed({"id": "doc_id", "key": "text_key"})
