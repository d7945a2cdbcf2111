"""Embedding near-dedup: Euclidean p-stable hashing with exact cosine checks.

Vectors are normalised, so a cosine c is a distance sqrt(2 - 2c). A hash is
floor((a . v + b) / w) with a drawn from the normal distribution, which is 2-stable, so
how often two vectors share it depends on their distance alone. ``k`` hashes make a
bucket, and there are as many tables as give a pair at the threshold the target recall.
``k`` grows with the logarithm of the table so that a bucket holds about ``STRANGERS``
unrelated vectors at any size. Pairs in a bucket are checked by their cosine in double
precision (see ``bucket_join``: identical vectors are one class, hot buckets are cut into
chunks, no pairs are written out).

Defined cases: null or empty vectors, zero vectors and those with a null or non-finite
component link with nothing. Vectors of different lengths never link. Repeated rows (same
id and vector) are one vector; different vectors of one id are a row each, kept if that id is
their component's. Null id: a vector like any. Empty table: no rows. Other
columns are not read, whatever their names. Very long vectors are rows like any.
"""

from __future__ import annotations

from math import ceil, erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bucket_join import NULL_ID, PAIRS, bucket_tasks, compared, node_of, paired, resolved
from .common import U64, checkpointed, joined, mixed, one_array, partitions_for

THRESHOLD = 0.95
RECALL = 0.995
WIDTH = 1.5
STRANGERS = 16
CHUNK = 256
#: Components of the vectors in a chunk.
WEIGHT = 2_000_000
#: Members up to which the pairs of buckets are checked side by side.
FEW = 48


def shares(distance: float, width: float = WIDTH) -> float:
    """How likely one hash of two vectors at that distance is the same."""
    t = width / distance
    return erf(t / sqrt(2)) - 2 / (sqrt(2 * pi) * t) * (1 - exp(-t * t / 2))


def plan(rows: int, threshold: float, recall: float) -> tuple[int, int]:
    """Hashes a bucket and tables for so many vectors."""
    k = max(2, ceil(log(max(rows, 2) / STRANGERS) / -log(shares(sqrt(2))))) if rows > STRANGERS else 2
    near = shares(max(sqrt(max(2 - 2 * threshold, 0)), 1e-6)) ** k
    return k, ceil(log(1 - recall) / log(1 - near)) if near < 1 else 1


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def alike_vectors(threshold: float):
    """Finds the pairs of rows of a group with a cosine of at least the threshold."""

    def checked(v, i, j):
        for at in range(0, len(i), PAIRS):
            a, b = i[at : at + PAIRS], j[at : at + PAIRS]
            near = np.einsum("ij,ij->i", v[a], v[b]) >= threshold
            yield a[near], b[near]

    def alike(table: pa.Table, starts: np.ndarray):
        lists = one_array(table.column("vector"))
        lengths = np.asarray(lists.value_lengths())
        flat, at = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lengths)))
        sizes = np.diff(starts)
        for dim in np.unique(lengths):
            here = np.flatnonzero(lengths == dim)
            raw = flat[at[here][:, None] + np.arange(dim)]
            v = np.zeros((len(lengths), dim)) if len(here) < len(lengths) else raw
            v[here] = unit(raw / np.abs(raw).max(1, keepdims=True))
            # rows of other lengths are zero here, so no pair with one is near
            for size in np.unique(sizes[sizes > 1]):
                first = starts[:-1][sizes == size]
                if size <= FEW:
                    a, b = np.triu_indices(size, 1)
                    most = max(1, PAIRS // len(a))
                    for n in range(0, len(first), most):
                        some = first[n : n + most, None]
                        yield from checked(v, (some + a).ravel(), (some + b).ravel())
                else:
                    for x in first:
                        i, j = np.nonzero(np.triu(v[x : x + size] @ v[x : x + size].T >= threshold, 1))
                        yield i + x, j + x

    return alike


def near_duplicate_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL, chunk: int = CHUNK, weight: int = WEIGHT) -> DataFrame:
    """One row a vector: ``id``, ``key``, ``class_id``, ``n_links``, ``component_id`` and ``kept``."""
    n = partitions_for(vectors)
    vector = F.col(vector_col).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    sound = F.coalesce((F.size(vector) > 0) & ~F.exists(vector, bad) & F.exists(vector, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.when(sound, vector).alias("vector"))
    text = F.concat_ws(",", F.transform("vector", lambda x: (x + F.lit(0.0)).cast("string")))
    rows = rows.withColumn("key", F.when(F.col("vector").isNotNull(), F.unhex(F.md5(text)))).dropDuplicates(["id", "key"])
    rows = checkpointed(rows)
    light = rows.select("id", "key")
    classes = rows.filter("key is not null").groupBy("key").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("size"), F.first("vector").alias("vector"))
    classes = checkpointed(classes.withColumn("node", node_of(F.col("class_id"), F.col("key"))))
    k, tables = plan(classes.count(), threshold, recall)

    def bucketed(batches):
        for batch in batches:
            lists = one_array(batch.column("vector"))
            lengths = np.asarray(lists.value_lengths())
            flat, starts = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lengths)))
            out = np.zeros((len(lengths), tables), U64)
            for dim in np.unique(lengths):
                here = np.flatnonzero(lengths == dim)
                raw = flat[starts[here][:, None] + np.arange(dim)]
                # scaled first, so that squares of extreme components stay finite
                v = unit(raw / np.abs(raw).max(1, keepdims=True))
                draw = np.random.default_rng(int(dim))
                for table in range(tables):
                    a, b = draw.normal(size=(int(dim), k)), draw.uniform(0, WIDTH, k)
                    cells = np.floor((v @ a + b) / WIDTH).astype(np.int64).view(U64)
                    label = np.full(len(here), U64(table * 100_003 + int(dim)))
                    for j in range(k):
                        label = joined(label, mixed(cells[:, j]))
                    out[here, table] = label
            buckets = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, tables), pa.int32()), pa.array(out.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, buckets], names=[*batch.schema.names, "buckets"])

    hashed = checkpointed(classes.select("node", "key", "class_id", "size", "vector").mapInArrow(bucketed, "node binary, key binary, class_id long, size long, vector array<double>, buckets array<long>"))
    members = hashed.select("node", F.size("vector").cast("long").alias("n"), F.posexplode("buckets").alias("table", "bucket"))
    tasks = bucket_tasks(members, chunk, weight).drop("pivot")
    found = compared(paired(tasks.join(hashed.select("node", "size", "buckets", "vector"), "node")), alike_vectors(threshold), n)
    # vectors that share an id are different rows of one name, so the id decides what is kept
    return resolved(light, hashed, found).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
