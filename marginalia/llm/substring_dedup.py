"""Substring dedup: repeated runs of words are found by difference-cover anchors.

Two equal windows of ``window`` words start at positions i and j. A difference cover D
modulo a period P has, for every i and j, a shift k < P with (i + k) mod P and (j + k)
mod P both in D. So hashing the short anchor windows that start at positions in D modulo
P is enough: every pair of equal windows shares an anchor at the same shift. Only windows
around a repeated anchor are then extended to their full width and compared.

Documents are dealt into blocks by id, about ``BLOCK_BYTES`` of input each; the blocks are
one exchange that all three passes read.

1. Each block sends its distinct anchor hashes to buckets of hashes; a bucket answers
   each block with those that another block has too.
2. Each block extends the windows around repeated anchors and sends, for each distinct
   one (96 bits), its document to buckets; a bucket answers every block but the
   owner of the first.
3. Each block marks the words of windows that a bucket answered or that start earlier
   within the block, and keeps the rest.

A block sends a hash once however often it has it, so a passage in a third of all
documents costs one entry for each block, and nothing is ever paired.

Defined cases: null or empty text: no words, nothing removed, null or empty kept text.
Fewer words than a window: kept. Null id: after all other ids, in an order that
their texts fix. Rows with the same id: one after the other in order of text, so of exact
repeats the later one goes. Ids are
integers. Words are joined by one space in the kept text, also where none is removed. Very
long texts are hashed whole, and are one row of their block. Empty table: no rows. Other
columns pass through; those named like a result column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, among, hashed, input_bytes, mixed, one_array, partitions_for, split_words, window_starts, windows

BLOCK_BYTES = 600_000
PARTITION_BYTES = 8_000_000
BUCKET_BYTES = 2_000_000
LAST_ID = np.iinfo(np.int64).max
#: Perfect difference sets: every remainder is the difference of two members.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
LEAST_ANCHOR = 5
#: Entries of payloads: 96 bits of a window's hash, and the document's id.
PLACE = np.dtype([("a", "u8"), ("b", "u4"), ("id", "i8")])
PAIR = np.dtype([("a", "u8"), ("b", "u4")])


def cover_for(window: int) -> tuple[int, np.ndarray, int]:
    """Period, its cover as a mask, and the anchor's width for windows of that many words."""
    period = max(p for p in COVERS if p == 1 or window - p + 1 >= LEAST_ANCHOR)
    mask = np.zeros(period, bool)
    mask[list(COVERS[period])] = True
    return period, mask, window - period + 1


class _Block:
    """The words of one block in order of (id, text), and its windows."""

    def __init__(self, table: pa.Table, window: int):
        self.window = window
        self.table = table.take(pc.sort_indices(table, sort_keys=[("id", "ascending"), ("text", "ascending")]))
        self.ids = one_array(pc.fill_null(self.table.column("id").cast(pa.int64()), LAST_ID)).to_numpy(zero_copy_only=False)
        self.words, self.offsets = split_words(self.table.column("text"))
        self.first = hashed(self.words)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the windows at cover positions."""
        period, cover, width = cover_for(self.window)
        starts = window_starts(self.offsets, width)
        lengths = np.maximum(np.diff(self.offsets) - width + 1, 0)
        starts = starts[cover[(starts - np.repeat(self.offsets[:-1], lengths)) % period]]
        return starts, windows(self.first, width)[starts]

    def full(self, near: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Starts and 96-bit hashes of the full windows, or of those that hold a marked anchor."""
        starts = window_starts(self.offsets, self.window)
        if near is not None:
            period = cover_for(self.window)[0]
            sums = np.concatenate(([0], np.cumsum(near)))
            starts = starts[sums[starts + period] > sums[starts]]
        out = np.empty(len(starts), PAIR)
        if len(starts):
            out["a"] = windows(self.first, self.window)[starts]
            out["b"] = windows(mixed(self.first ^ U64(0xA5A5A5A5A5A5A5A5)), self.window)[starts] >> U64(32)
        return starts, out


def _packed(entries: np.ndarray) -> bytes:
    """Column by column: neighbouring windows have the same document, so ids compress."""
    return b"".join(entries[name].tobytes() for name in entries.dtype.names) if entries.dtype.names else entries.tobytes()


def _unpacked(payload: bytes, dtype: np.dtype | type) -> np.ndarray:
    dtype = np.dtype(dtype)
    if not dtype.names:
        return np.frombuffer(payload, dtype)
    out, at = np.empty(len(payload) // dtype.itemsize, dtype), 0
    for name in dtype.names:
        out[name] = np.frombuffer(payload, dtype[name], len(out), at)
        at += out[name].nbytes
    return out


def _dealt(block: int, keys: np.ndarray, payload: np.ndarray, buckets: int) -> pa.Table:
    """One row for each bucket with its share of the payload."""
    bucket = (keys % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    found, at = np.unique(bucket[order], return_index=True)
    parts = np.split(payload[order], at[1:]) if len(found) else []
    return pa.table({"__bucket": pa.array(found, pa.int32()), "__block": pa.array(np.full(len(found), block), pa.int32()), "payload": pa.array([_packed(p) for p in parts], pa.binary())})


def _gathered(batches, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Payloads of a partition in one array, and the block each entry is from."""
    blocks, values = [], []
    for batch in batches:
        for block, payload in zip(batch.column("__block").to_pylist(), batch.column("payload").to_pylist(), strict=True):
            values.append(_unpacked(payload, dtype))
            blocks.append(np.full(len(values[-1]), block, np.int32))
    return (np.concatenate(blocks), np.concatenate(values)) if values else (np.empty(0, np.int32), np.empty(0, dtype))


def _answers(blocks: np.ndarray, values: np.ndarray):
    order = np.argsort(blocks, kind="stable")
    found, at = np.unique(blocks[order], return_index=True)
    for i, part in enumerate(np.split(values[order], at[1:]) if len(found) else []):
        yield pa.RecordBatch.from_arrays([pa.array([found[i]], pa.int32()), pa.array([_packed(part)], pa.binary())], names=["__block", "payload"])


def _shared(batches):
    """Anchor hashes that more than one block sent."""
    blocks, values = _gathered(batches, U64)
    order = np.argsort(values, kind="stable")
    same = values[order][1:] == values[order][:-1]
    repeated = order[np.concatenate((same, [False])) | np.concatenate(([False], same))] if len(order) else order
    yield from _answers(blocks[repeated], values[repeated])


def _later(batches):
    """Full windows of all blocks but the one with the first document."""
    blocks, values = _gathered(batches, PLACE)
    # blocks decide between rows without an id
    order = np.lexsort((blocks, values["id"], values["b"], values["a"]))
    v = values[order]
    later = order[1:][(v["a"][1:] == v["a"][:-1]) & (v["b"][1:] == v["b"][:-1])]
    out = np.empty(len(later), PAIR)
    out["a"], out["b"] = values["a"][later], values["b"][later]
    yield from _answers(blocks[later], out)


def _answered(table: pa.Table, dtype) -> np.ndarray:
    parts = [_unpacked(x, dtype) for x in table.column("payload").to_pylist()]
    return np.sort(np.concatenate(parts)) if parts else np.empty(0, dtype)


def _repeats(pairs: np.ndarray) -> np.ndarray:
    """Marks entries equal to one before them."""
    out = np.zeros(len(pairs), bool)
    order = np.argsort(pairs["a"], kind="stable")
    same = pairs["a"][order][1:] == pairs["a"][order][:-1]
    some = np.sort(order[np.concatenate((same, [False])) | np.concatenate(([False], same))]) if len(order) else order
    order = np.lexsort((some, pairs["b"][some], pairs["a"][some]))
    v = pairs[some[order]]
    out[some[order][1:][(v["a"][1:] == v["a"][:-1]) & (v["b"][1:] == v["b"][:-1])]] = True
    return out


def _among_pairs(pairs: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Membership of 96-bit values in a sorted table of them."""
    out = np.zeros(len(pairs), bool)
    at = np.searchsorted(table["a"], pairs["a"])
    open_ = np.flatnonzero(at < len(table))
    while len(open_):
        row = table[at[open_]]
        same = row["a"] == pairs["a"][open_]
        out[open_[same & (row["b"] == pairs["b"][open_])]] = True
        open_ = open_[same & (row["b"] != pairs["b"][open_])]
        at[open_] += 1
        open_ = open_[at[open_] < len(table)]
    return out


def remove_repeated_spans(docs: DataFrame, *, window: int = 20, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """The documents (``with_text=False``: less the original text) with ``kept_text``, ``n_words`` and ``n_removed``."""
    docs = docs.drop(*({"kept_text", "n_words", "n_removed"} - {id_col, text_col}))
    n = partitions_for(docs, PARTITION_BYTES)
    # from the input's size alone: a block sends at most one row to each bucket
    size = min(input_bytes(docs), n * PARTITION_BYTES)
    buckets, n_blocks = max(16, size // BUCKET_BYTES), max(16, size // BLOCK_BYTES)
    # rows without an id are dealt out by their text, so they may be any number
    dealt_by = F.when(F.col(id_col).isNull(), F.xxhash64(text_col)).otherwise(F.xxhash64(id_col))
    others = [c for c in docs.columns if c != text_col]
    dealt = docs.select(F.pmod(dealt_by, F.lit(n_blocks)).cast("int").alias("__block"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(*[F.col(f"`{c}`") for c in others]).alias("row")).repartition(n, "__block")
    sent, answer = "__bucket int, __block int, payload binary", "__block int, payload binary"

    def send_anchors(key, table):
        found = np.unique(_Block(table, window).anchors()[1])
        return _dealt(key[0].as_py(), found, found, buckets)

    def send_windows(key, table, answers):
        block = _Block(table, window)
        at, anchors = block.anchors()
        values, counts = np.unique(anchors, return_counts=True)
        marked = np.zeros(len(block.first), bool)
        marked[at[among(anchors, _answered(answers, U64)) | among(anchors, values[counts > 1])]] = True
        starts, pairs = block.full(marked)
        keep = ~_repeats(pairs)
        starts, pairs = starts[keep], pairs[keep]
        row = np.searchsorted(block.offsets, starts, side="right") - 1
        out = np.empty(len(starts), PLACE)
        # documents with one id are in one block, so ids decide between blocks
        out["a"], out["b"], out["id"] = pairs["a"], pairs["b"], block.ids[row]
        return _dealt(key[0].as_py(), out["a"], out, buckets)

    def keep_rest(key, table, answers):
        block = _Block(table, window)
        starts, pairs = block.full()
        gone = starts[_repeats(pairs) | _among_pairs(pairs, _answered(answers, PAIR))]
        edge = np.zeros(len(block.first) + 1, np.int64)
        edge[gone] += 1
        edge[gone + window] -= 1
        kept = np.cumsum(edge)[:-1] == 0
        sums = np.concatenate(([0], np.cumsum(kept)))[block.offsets]
        lists = pa.ListArray.from_arrays(pa.array(sums, pa.int32()), block.words.filter(pa.array(kept)).cast(pa.string()))
        text = pc.if_else(one_array(pc.is_valid(block.table.column("text"))), pc.binary_join(lists, " "), None)
        out = block.table.drop_columns(["__block", "id"] if with_text else ["__block", "id", "text"])
        out = out.append_column("kept_text", text).append_column("n_words", pa.array(np.diff(block.offsets)))
        return out.append_column("n_removed", pa.array(np.diff(block.offsets) - np.diff(sums)))

    blocks = dealt.groupBy("__block")
    shared = blocks.applyInArrow(send_anchors, sent).repartition(n, "__bucket").mapInArrow(_shared, answer).repartition(n, "__block")
    later = blocks.cogroup(shared.groupBy("__block")).applyInArrow(send_windows, sent).repartition(n, "__bucket").mapInArrow(_later, answer).repartition(n, "__block")
    fields = [f for f in dealt.schema if f.name == "row" or (with_text and f.name == "text")]
    schema = T.StructType([*sorted(fields, key=lambda f: f.name != "text"), T.StructField("kept_text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    out = blocks.cogroup(later.groupBy("__block")).applyInArrow(keep_rest, schema)
    names = [F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns if with_text or c != text_col]
    return out.select(*names, "kept_text", "n_words", "n_removed")
