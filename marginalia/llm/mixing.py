"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sizes are words. The targets share out all words by source weight; a target stops at
``most_epochs`` times its source, and what is over is shared again by weight. A source's
documents are first taken whole as many times as complete epochs fit. The rest of the
target is drawn without replacement: each document has the key ``-ln(u) / quality``, keys
are taken in ascending order, and the prefix sum of sizes stops at the budget; the
document on the edge gives only the words that are still wanted.

No source is ever sorted as a whole. A source's range of keys is cut into ``BINS``, the
bins are summed, and the one that holds the edge is cut again, until it has no more than
``ROWS`` rows (or one key); only those are ordered. So it does not matter how the keys lie
or how large the source is. What is joined back to the documents has one row per source;
the sources themselves, one row each, are filled in one task and should be thousands at
most.

Defined cases: null text or no words: size 0, takes 0. Null source: a source of its own,
last in order. Null id: drawn with the key of the empty id. Repeated rows: each counts;
rows that tie on the edge key share what is left in proportion to their size. Very long
texts: only their words are counted. Empty table: no rows. Other columns are passed
through, whatever their names; those named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

ROWS = 100
BINS = 64
#: Sources whose targets (under 100 bytes each, and their names) are broadcast.
FEW_SOURCES = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(id_col: Column, seed: int) -> Column:
    """A number in (0, 1) fixed by the id and the seed: 52 bits of an MD5 digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_epochs: int = 3) -> DataFrame:
    """(source, source_size) with the target of each source, all words shared out.

    Sources are filled like connected vessels: in ascending order of cap per weight, the
    first source whose cap is not under the common level fixes the level for the rest.
    """
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = Window.orderBy("cap_per_weight", "place").rowsBetween(Window.unboundedPreceding, -1)
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    out = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    out = out.withColumn("weight", F.element_at(cycle, ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("long"))
    out = out.withColumn("cap", F.col("source_size") * most_epochs)
    out = out.withColumn("cap_per_weight", F.col("cap") / F.col("weight"))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(filled), F.lit(0))
    heavy = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filled), F.lit(0))
    out = out.withColumn("level_here", left / heavy)
    out = out.withColumn("level", F.min(F.when(F.col("level_here") <= F.col("cap_per_weight"), F.struct("cap_per_weight", "place", "level_here"))).over(everything)["level_here"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    return out.select("source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = None, source_col: str = "source", quality: Column | None = None, weights: tuple[int, ...] = (1, 2, 3), most_epochs: int = 3, seed: int = 17) -> DataFrame:
    """The documents with ``size``, ``source_size``, ``target`` and ``taken``.

    ``quality`` is a column of positive weights (null or not positive: 1). ``size_col``
    holds sizes counted beforehand; without it the words of ``text_col`` are counted.
    """
    worth = F.lit(1.0) if quality is None else F.when(quality > 0, quality.cast("double")).otherwise(1.0)
    size = word_count(F.col(text_col)) if size_col is None else F.coalesce(F.col(size_col), F.lit(0)).cast("long")
    # a document's own columns travel in one, so that their names are free
    kept = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept] or [F.lit(0)]).alias("row"), F.col(source_col).alias("__source"), size.alias("size"), (-F.log(uniform(F.col(id_col), seed)) / worth).alias("__key"))
    light = checkpointed(keyed.select(F.col("__source").alias("source"), "size", "__key"))
    measures = [F.sum("size").alias("bin_size"), F.count(F.lit(1)).alias("n"), F.min("__key").alias("low"), F.max("__key").alias("high")]
    sources = checkpointed(light.groupBy("source").agg(*measures).withColumnRenamed("bin_size", "source_size"))

    goal = targets(sources.select("source", "source_size"), weights, most_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = goal.withColumn("epochs", epochs).withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")))
    goal = checkpointed(goal)

    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    edge = sources.alias("s").join(goal.alias("g"), same("s.source", "g.source")).filter("s.source_size > 0")
    edge = checkpointed(edge.select(F.col("s.source").alias("of"), "low", "high", "n", F.lit(0).cast("long").alias("before"), "rest"))
    near = light
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    while not edge.filter((F.col("n") > ROWS) & (F.col("low") < F.col("high"))).isEmpty():
        near = near.select("source", "size", "__key").join(edge, same("source", "of")).filter(F.col("__key").between(F.col("low"), F.col("high")))
        place = F.when(F.col("low") < F.col("high"), F.floor((F.col("__key") - F.col("low")) / (F.col("high") - F.col("low")) * BINS)).otherwise(0)
        near = checkpointed(near.withColumn("bin", F.least(place, F.lit(BINS - 1))))
        binned = near.groupBy("source", "bin", "before", "rest").agg(*measures)
        binned = binned.withColumn("before", F.col("before") + F.coalesce(F.sum("bin_size").over(upto), F.lit(0)))
        found = binned.filter((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("bin_size") > F.col("rest")))
        edge = checkpointed(found.select(F.col("source").alias("of"), "low", "high", "n", "before", "rest"))
    near = near.select("source", "size", "__key").join(edge, same("source", "of")).filter(F.col("__key").between(F.col("low"), F.col("high")))
    near = near.groupBy("source", "__key", "before", "rest").agg(F.sum("size").alias("tied"))
    run = Window.partitionBy("source").orderBy("__key").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("before", F.col("before") + F.coalesce(F.sum("tied").over(run), F.lit(0)))
    near = near.filter((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("tied") > F.col("rest")))
    near = near.select("source", F.col("__key").alias("edge_key"), "tied", (F.col("rest") - F.col("before")).alias("wanted"))

    goal = goal.alias("g").join(near.alias("n"), F.col("g.source").eqNullSafe(F.col("n.source")), "left")
    goal = checkpointed(goal.select(F.col("g.source").alias("of"), "source_size", "target", "epochs", "rest", "edge_key", "tied", "wanted"))
    part = (
        F.when(F.col("edge_key").isNull(), 0)
        .when(F.col("__key") < F.col("edge_key"), F.col("size"))
        .when(F.col("__key") == F.col("edge_key"), F.floor(F.col("wanted") * F.col("size") / F.col("tied")))
        .otherwise(0)
    )
    # a source may hold any share of the documents, so they stay where they are
    out = keyed.join(F.broadcast(goal) if goal.count() <= FEW_SOURCES else goal, F.col("__source").eqNullSafe(F.col("of")))
    taken = (F.col("epochs") * F.col("size") + part).cast("long")
    return out.select(*[F.col(f"row.`{c}`") for c in kept], "size", "source_size", "target", taken.alias("taken"))
