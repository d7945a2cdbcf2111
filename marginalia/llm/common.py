"""Words, hashes and blocks shared by the training-corpus operators.

A word is a maximal run of characters other than space and U+0009..U+000D. Word and
window hashes are computed a slice of documents at a time with Arrow and numpy, so the
memory of a Python worker does not depend on the size of a partition.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 3_000_000
U64 = np.uint64


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share.

    Where none is set, one of its own if driver and executors are one process, else an error:
    a folder of one machine is of no use to the others.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="marginalia-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def input_bytes(df: DataFrame) -> int:
    """Spark's size estimate of a frame: file sizes for a table that is read."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions_for(df: DataFrame, per_partition: int = 8_000_000, most: int = 100_000) -> int:
    """Shuffle partitions that hold about ``per_partition`` bytes of the input each."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # an estimate without statistics is Long.MaxValue; the session's setting decides then
    size = input_bytes(df)
    return least if size > 1 << 60 else max(least, min(most, -(-size // per_partition)))


#: A key with more than one in so many rows is heavy, so there are fewer heavy keys than this.
HEAVY_KEYS = 4096
LEAST_HEAVY = 64


def heavy_limit(rows: int) -> int:
    return max(LEAST_HEAVY, rows // HEAVY_KEYS)


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", rows: int | None = None) -> DataFrame:
    """``left`` joined to ``right`` (one row a key), though one key may hold much of ``left``.

    The heavy keys, fewer than ``HEAVY_KEYS``, are joined by broadcast where their rows are;
    rows with a null key have no partner and are not dealt out. ``left`` is read several
    times.
    """
    known = left.filter(F.col(key).isNotNull())
    limit = heavy_limit(left.count() if rows is None else rows)
    heavy = checkpointed(known.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > limit).select(key))
    if heavy.isEmpty():
        out = known.join(right, key, how)
    else:
        hot = known.join(F.broadcast(heavy), key, "left_semi").join(F.broadcast(right.join(F.broadcast(heavy), key, "left_semi")), key, how)
        out = hot.unionByName(known.join(F.broadcast(heavy), key, "left_anti").join(right, key, how))
    return out.unionByName(left.filter(F.col(key).isNull()), allowMissingColumns=True) if how == "left" else out


def unused(df: DataFrame, name: str) -> str:
    """The name, longer by underscores until no column of the frame has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def learns(doc_id: str = "doc_id"):
    """True for rows that a classifier may learn from: crc32(id as text) mod 5 is not 0."""
    return (F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5) != 0


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(~learns(doc_id), F.lit(False))


def slices(table: pa.Table | pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator:
    """Row slices of about ``limit`` bytes of text each; a longer text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(table.column(column)), 0)
    if isinstance(sizes, pa.ChunkedArray):
        sizes = sizes.combine_chunks()
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield table.slice(start, stop - start)
        start = stop


def one_array(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def split_words(texts) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts in one array, and where each text's words begin (one more offset than texts)."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(one_array(texts).cast(pa.large_string()), "")))
    lists = one_array(lists)
    flat = lists.flatten()
    offsets = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))))
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not full.all():
        kept = np.concatenate(([0], np.cumsum(full)))
        offsets, flat = kept[offsets], flat.filter(pa.array(full))
    return one_array(flat), offsets


_POWER = 0x9E3779B97F4A7C17
_BYTES = np.random.default_rng(64).integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_tables: list[np.ndarray] = [np.empty(0, U64), np.empty(0, U64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the hash's base and of its inverse modulo 2**64."""
    if len(_tables[0]) < n:
        n = max(n, 1 << 16)
        for i, base in enumerate((_POWER, pow(_POWER, -1, 1 << 64))):
            steps = np.full(n, base, U64)
            steps[0] = 1
            _tables[i] = np.cumprod(steps)
    return _tables


def hashed(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word: polynomials in its bytes from one running sum over all bytes."""
    n = len(words)
    out = np.empty(n, U64)
    if not n:
        return out
    wide = pa.types.is_large_string(words.type)
    _, places, data = words.buffers()
    ends = np.frombuffer(places, np.int64 if wide else np.int32)[words.offset : words.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + SLICE_BYTES, side="right")) - 1)
        at = ends[start : stop + 1] - ends[start]
        power, inverse = _powers(int(at[-1]) + 1)
        sums = np.zeros(at[-1] + 1, U64)
        np.cumsum(_BYTES[data[ends[start] : ends[stop]]] * power[: at[-1]], out=sums[1:])
        values = (sums[at[1:]] - sums[at[:-1]]) * inverse[at[:-1]]
        out[start:stop] = mixed(values + np.diff(at).astype(U64) * U64(0xC2B2AE3D27D4EB4F))
        start = stop
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the sequence a, b from the hashes of its parts."""
    return mixed(a * U64(0x9E3779B97F4A7C15) + ((b << U64(29)) | (b >> U64(35))))


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive values, by doubling; len(h) - width + 1 values."""
    if len(h) < width:
        return np.empty(0, U64)
    done, have, power, size = None, 0, h, 1
    while width:
        if width & size:
            done = power if done is None else joined(done[: len(power) - have], power[have:])
            have += size
            width -= size
        if width:
            power = joined(power[:-size], power[size:])
            size *= 2
    return done


def window_starts(offsets: np.ndarray, width: int) -> np.ndarray:
    """Positions in the flat word array at which a window lies within one text."""
    lengths = np.diff(offsets)
    counts = np.maximum(lengths - width + 1, 0)
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets[:-1] - (ends - counts), counts)


def among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Membership of values in a sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


def binary(parts: list[np.ndarray]) -> pa.Array:
    return pa.array([x.tobytes() for x in parts], pa.binary())


def words_of_bytes(values: np.ndarray) -> pa.Array:
    """The rows of a byte matrix as binaries."""
    n, width = values.shape
    places = np.arange(0, (n + 1) * width, width, dtype=np.int32) if width else np.zeros(n + 1, np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def byte_rows(column, width: int) -> np.ndarray:
    """Binaries of one length as a byte matrix."""
    return np.frombuffer(b"".join(one_array(column).to_pylist()), np.uint8).reshape(-1, width)
