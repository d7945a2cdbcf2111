"""Merkle manifest of a dataset: a tree of digests for each group, and one over the groups.

Every row is a leaf: the SHA-256 of its fields (see ``leaf_digest``). The leaves of a group
stand in order; every ``arity`` consecutive nodes become their parent, the digest of their
digests as hexadecimal text, until one is left, the group's subroot. The subroots, ordered
by group, are the leaves of one more tree, whose last node is the root. A proof is, for
each level from a leaf up, the siblings on its left and on its right; ``fold`` goes from
a leaf and its proof to a root.

A level is one equijoin of the nodes with themselves. The node in slot zero of a run
computes the indices of its siblings, its own XOR 1 in a binary tree and its own plus the
slots' offsets otherwise, and the nodes with those indices are joined to it; then it emits
the parent and the digests of the run, from which every member's siblings can be read. So
each node is moved once a level, however many siblings it has. Trees of all groups grow in
the same joins, and leave them at their subroot. Proofs are handed down over runs, whose
members share all that is above, so a leaf's own row gets its proof only at the end.

Places are counted without sorting a group in one task: rows are sorted over range
partitions, and a group's rows before a partition are added up from the partitions' counts.

Defined cases: null field: ``-`` in the leaf. Null group: a group of its own, the first.
Null order column: before all others; ties are ordered by leaf, so equal rows may change
places but no digest does. Repeated rows: each is a leaf. A single leaf is its subroot, a
single subroot the root; its proof is empty. Empty or very long texts are hashed whole. Empty
table: no rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, partitions_for

ARITY = 16
#: Rows of counts by group and partition up to which they are broadcast (under 10 MB).
SMALL = 100_000
#: Bytes of input a partition of the sorted leaves, which are far smaller than their texts.
LEAVES_BYTES = 32_000_000


def leaf_digest(fields: Sequence[Column]) -> Column:
    """SHA-256 of the fields as 32 bytes: ``-`` for null, else UTF-8 byte count, ``:`` and value."""
    parts = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def as_text(digests: Column) -> Column:
    """Digests in a binary as lower-case hexadecimal text."""
    return F.lower(F.hex(digests))


def fold(leaf: Column, path: Column) -> Column:
    """The root, as 32 bytes, that a leaf's digest has with the siblings of its proof."""
    up = lambda node, step: F.unhex(F.sha2(as_text(F.concat(step["left"], node, step["right"])), 256))
    return F.aggregate(path, leaf, up)


def proof_digest(path: Column) -> Column:
    """SHA-256, as hexadecimal text, of all siblings of a proof, from the leaf up and left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda step: as_text(F.concat(step["left"], step["right"])))), 256)


def numbered(rows: DataFrame, partitions: int) -> DataFrame:
    """The rows (tree, sort, digest, ...) with ``idx``, the place within the tree by sort and digest, and ``size``, the rows of the tree.

    Nulls come first; rows that tie come in any order.
    """
    order = [F.col(c).asc_nulls_first() for c in ("tree", "sort", "digest")]
    # rows that tie are dealt out too: which of them comes first does not matter
    spread = rows.withColumn("tie", F.monotonically_increasing_id())
    at = spread.repartitionByRange(partitions, *order, "tie").sortWithinPartitions(*order)
    at = checkpointed(at.drop("tie").withColumn("row", F.monotonically_increasing_id()))
    at = at.withColumn("part", F.shiftright("row", 33))
    counts = at.groupBy("tree", "part").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    mine = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(mine.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = checkpointed(counts.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(mine).alias("size")))
    out = at.join(F.broadcast(counts) if counts.count() <= SMALL else counts, ["tree", "part"])
    return out.withColumn("idx", F.col("row") + F.col("shift")).drop("sort", "row", "part", "shift")


def sibling_runs(nodes: DataFrame, arity: int) -> DataFrame:
    """(tree, idx, size, digests[, carried]) of each run of the nodes (tree, idx, size, digest[, carry]).

    ``idx`` and ``size`` are the parent's and its level's; ``digests`` are the run's in one
    binary, ``carried`` an array, both in the order of the slots.
    """
    slot_zero = nodes.filter(F.col("idx") % arity == 0).select("tree", F.col("idx").alias("head"))
    if arity == 2:
        siblings = F.array(F.col("head"), F.col("head").bitwiseXOR(F.lit(1).cast("long")))
    else:
        siblings = F.transform(F.sequence(F.lit(0), F.lit(arity - 1)), lambda slot: F.col("head") + slot)
    met = slot_zero.select("tree", "head", F.explode(siblings).alias("idx")).join(nodes, ["tree", "idx"])
    held = ["carry"] if "carry" in nodes.columns else []
    runs = met.groupBy("tree", "head").agg(F.max("size").alias("size"), F.array_sort(F.collect_list(F.struct("idx", "digest", *held))).alias("run"))
    digests = F.unhex(F.concat_ws("", F.transform("run", lambda x: F.hex(x["digest"]))))
    carried = [F.transform("run", lambda x: x["carry"]).alias("carried") for _ in held]
    return runs.select("tree", F.floor(F.col("head") / arity).alias("idx"), F.ceil(F.col("size") / arity).alias("size"), digests.alias("digests"), *carried)


def grown(leaves: DataFrame, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """The runs of each level from the leaves up, and the last node (tree, digest) of each tree."""
    levels: list[DataFrame] = []
    tops = leaves.filter("size = 1").select("tree", "digest")
    nodes, longest = leaves.filter("size > 1"), leaves.agg(F.max("size")).first()[0] or 0
    while longest > 1:
        levels.append(checkpointed(sibling_runs(nodes, arity)))
        nodes = levels[-1].select("tree", "idx", "size", F.unhex(F.sha2(as_text(F.col("digests")), 256)).alias("digest"))
        tops = tops.unionByName(nodes.filter("size = 1").select("tree", "digest"))
        nodes, longest = nodes.filter("size > 1"), -(-longest // arity)
    return levels, checkpointed(tops)


def proved(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame, arity: int) -> DataFrame:
    """(tree, digest, carry, path, top) of the leaves of grown trees.

    ``tops`` (tree, path, top) has what is above the last node of each tree.
    """
    slot = F.col("slot") * 32
    step = F.struct(F.substring("digests", F.lit(1), slot).alias("left"), F.substring("digests", slot + 33, F.octet_length("digests")).alias("right"))
    above = tops.select("tree", F.lit(0).cast("long").alias("idx"), F.lit(True).alias("last"), "path", "top")
    met = leaves.filter("size = 1").join(tops, "tree").select("tree", "digest", "carry", "path", "top")
    handed = above
    for level, runs in reversed(list(enumerate(levels))):
        under = runs.withColumn("last", F.col("size") == 1).join(handed, ["tree", "idx", "last"])
        if level:
            slots = F.explode(F.sequence(F.lit(0), F.shiftright(F.octet_length("digests"), 5) - 1)).alias("slot")
            under = under.select("tree", "idx", "digests", "path", "top", slots)
            under = under.select("tree", (F.col("idx") * arity + F.col("slot")).alias("idx"), F.lit(False).alias("last"), F.concat(F.array(step), "path").alias("path"), "top")
            handed = checkpointed(under.unionByName(above))
        else:
            under = under.select("tree", "digests", "path", "top", F.posexplode("carried").alias("slot", "carry"))
            met = met.unionByName(under.select("tree", F.substring("digests", slot + 1, F.lit(32)).alias("digest"), "carry", F.concat(F.array(step), "path").alias("path"), "top"))
    return met


def merkle_manifest(docs: DataFrame, fields: Sequence[Column], *, group: Column, order: Column, carry: Mapping[str, Column], arity: int = ARITY) -> DataFrame:
    """One row a document: ``carry``, ``leaf``, ``subroot``, ``root`` and ``path``.

    ``carry`` is a struct of the named columns, which come along with the leaf. ``leaf``,
    ``subroot`` and ``root`` are hexadecimal text; ``path`` is the proof, an array from the
    leaf up of the siblings' digests, each a binary of 32 bytes a digest: ``left`` and
    ``right``. Groups are ordered by their text.
    """
    if arity < 2:
        raise ValueError("a tree needs an arity of at least 2")
    n = partitions_for(docs, LEAVES_BYTES)
    # the mark keeps a null group apart, and before all others
    tree = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))
    held = F.struct(*[column.alias(name) for name, column in carry.items()])
    leaves = checkpointed(docs.select(tree.alias("tree"), order.alias("sort"), leaf_digest(fields).alias("digest"), held.alias("carry")))
    leaves = checkpointed(numbered(leaves, n))
    levels, subroots = grown(leaves, arity)

    named = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("sort"), "digest", F.struct(F.col("tree").alias("of")).alias("carry"))
    named = checkpointed(numbered(named, partitions_for(docs, LEAVES_BYTES)))
    top_levels, tops = grown(named, arity)
    root = tops.first()
    step = "array<struct<left:binary,right:binary>>"
    start = tops.select("tree", F.array().cast(step).alias("path"), F.lit(None).cast("binary").alias("top"))
    over = checkpointed(proved(named, top_levels, start, arity).select(F.col("carry.of").alias("tree"), "path", F.col("digest").alias("top")))

    out = proved(leaves, levels, over, arity)
    known = F.lit(bytes(root["digest"]) if root else None).cast("binary")
    return out.select("carry", as_text(F.col("digest")).alias("leaf"), as_text(F.col("top")).alias("subroot"), as_text(known).alias("root"), "path")
