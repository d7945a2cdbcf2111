"""Similarity self-joins over hashed buckets, without writing out pairs.

A class is all rows with the same content, named by a node: its least id and its content
in bytes that sort by the id. Each class has a bucket in some of several tables. All pairs
of classes in a bucket are compared exactly, inside a task, and a pair counts in the first
table in which it shares a bucket, so pairs need not be made distinct.

A bucket whose members are those of another bucket is looked at once. A bucket of more
than ``chunk`` classes, or of more than ``weight`` of content, is cut into chunks that are
compared two at a time.
Buckets are sorted within partitions and walked, so a task holds one bucket, or two
chunks, and a batch. It returns one row for each class that has links there: to how many
rows it links, and the least node of its part of the link graph. Components follow by
stars over those rows; as a node sorts by its id, its root tells the component's id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_rows, checkpointed, one_array, spread_join, words_of_bytes
from .components import components

NULL_ID = -(1 << 63)
#: Bytes of a node: 8 of the id, 16 of the content's digest.
NODE = 24
FOUND = "node binary, links long, least binary"
#: Pairs that are looked at together.
PAIRS = 200_000


def node_of(class_id: Column, key: Column) -> Column:
    """The id's bytes in an order that is the numbers', then the content's digest."""
    return F.concat(F.unhex(F.lpad(F.hex(class_id.bitwiseXOR(F.lit(NULL_ID))), 16, "0")), key)


def id_of(node: Column) -> Column:
    return (F.conv(F.hex(F.substring(node, 1, 8)), 16, 10).cast("decimal(20,0)") - F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("long")


def bucket_tasks(members: DataFrame, chunk: int, weight: int) -> DataFrame:
    """(node, table, bucket, chunk, chunks, pivot) of members (node, table, bucket, n) in the buckets worth a look.

    ``pivot`` is the least node of the bucket; a bucket's number names its table too.
    """
    members = checkpointed(members)
    held = members.groupBy("bucket").agg(F.first("table").alias("table"), F.count(F.lit(1)).alias("m"), F.sum("n").alias("w"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"), F.min("node").alias("pivot"))
    held = held.filter("m > 1").groupBy("m", "x", "y").agg(F.min(F.struct("table", "bucket", "w", "pivot")).alias("f"))
    chunks = F.greatest(F.ceil(F.col("m") / chunk), F.ceil(F.col("f.w") / weight)).cast("int")
    held = checkpointed(held.select("f.bucket", "f.pivot", chunks.alias("chunks")))
    out = spread_join(members.select("node", "table", "bucket"), held, "bucket", "inner")
    return checkpointed(out.withColumn("chunk", F.pmod(F.xxhash64(F.lit(2), "node"), F.col("chunks")).cast("int")))


def paired(chunked: DataFrame) -> DataFrame:
    """Each chunk with each other of its bucket: adds left and right."""
    out = chunked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return out.withColumns({"left": F.least("chunk", "other"), "right": F.greatest("chunk", "other")}).drop("other", "chunks")


def groups(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of rows sorted by ``by``, and where each group begins (one more than groups)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(c)) for c in by]
        starts = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
        new = held and any(np.asarray(held[-1].column(c))[-1] != v[0] for c, v in zip(by, columns, strict=True))
        if new or len(starts):
            last = int(starts[-1]) if len(starts) else 0
            yield _cut([*held, batch.slice(0, last)], by)
            held = [batch.slice(last)]
        else:
            held.append(batch)
    if held:
        yield _cut(held, by)


def _cut(batches: list[pa.RecordBatch], by: tuple[str, ...]) -> tuple[pa.Table, np.ndarray]:
    table = pa.Table.from_batches(batches).combine_chunks()
    columns = [np.asarray(one_array(table.column(c))) for c in by]
    change = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return table, np.concatenate(([0], np.flatnonzero(change) + 1, [table.num_rows]))


def _counted(members: pa.Table, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Link counts and least linked nodes of the alike pairs of rows that meet here first."""
    n = members.num_rows
    size = np.asarray(one_array(members.column("size")))
    lists = one_array(members.column("buckets"))
    buckets = lists.flatten().to_numpy().reshape(n, -1)
    table, chunk = (np.asarray(one_array(members.column(c))) for c in ("table", "chunk"))
    two = np.asarray(one_array(members.column("left"))) != np.asarray(one_array(members.column("right")))
    earlier = np.arange(buckets.shape[1])
    links, kept = np.zeros(n, np.int64), []
    for i, j in pairs:
        for at in range(0, len(i), PAIRS):
            a, b = i[at : at + PAIRS], j[at : at + PAIRS]
            fresh = ~((buckets[a] == buckets[b]) & (earlier < table[a, None])).any(1) & ~(two[a] & (chunk[a] == chunk[b]))
            a, b = a[fresh], b[fresh]
            np.add.at(links, a, size[b])
            np.add.at(links, b, size[a])
            kept.append((a, b))
    a, b = (np.concatenate([k[x] for k in kept]) if kept else np.empty(0, np.int64) for x in (0, 1))
    nodes = byte_rows(members.column("node"), NODE)
    order = np.lexsort(nodes.view(">u8").T[::-1])
    least = np.empty(n, np.int64)
    least[order] = np.arange(n)
    before = None
    while before is None or (least != before).any():
        before = least.copy()
        np.minimum.at(least, a, before[b])
        np.minimum.at(least, b, before[a])
        least = np.minimum(least, least[order[least]])
    linked = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([words_of_bytes(nodes[linked]), pa.array(links[linked]), words_of_bytes(nodes[order[least[linked]]])], names=["node", "links", "least"])


def compared(tasks: DataFrame, alike: Callable[[pa.Table, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]], partitions: int) -> DataFrame:
    """(node, links, least) of tasks (node, table, bucket, chunk, left, right, size, buckets and what ``alike`` reads).

    ``alike`` gets whole groups and where they begin, and yields the pairs of rows of one
    group that are alike.
    """
    by = ("bucket", "left", "right")

    def compare(batches):
        for table, starts in groups(batches, by):
            yield _counted(table, alike(table, starts))

    return checkpointed(tasks.repartition(partitions, *by).sortWithinPartitions(*by).mapInArrow(compare, FOUND))


def resolved(rows: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """Per row (id, key): class_id, n_links, component_id and kept.

    ``classes`` has node, key, class_id (least id) and size. Rows of no class link with nothing.
    """
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("u"), F.col("least").alias("v")))
    ids = classes.select("node", "key", "class_id", "size").join(links, "node", "left").join(roots, "node", "left")
    root = F.coalesce("root", "node")
    ids = checkpointed(ids.select("key", "class_id", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), id_of(root).alias("component_id"), (root == F.col("node")).alias("leads")))
    shown = lambda c: F.when(c != NULL_ID, c)
    return spread_join(rows.select("id", "key"), ids, "key").select(
        shown(F.col("id")).alias("id"),
        "key",
        shown(F.coalesce("class_id", "id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        shown(F.coalesce("component_id", "id")).alias("component_id"),
        F.coalesce(F.col("leads") & (F.col("id") == F.col("component_id")), F.lit(True)).alias("kept"),
    )
