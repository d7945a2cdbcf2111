"""Joins, sets and rankings that reports are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows up to which the pipelines or views of a run are broadcast.
SMALL_ROWS = 10_000


def small(df: DataFrame) -> DataFrame:
    """Broadcast if it has few rows; beyond that Spark chooses."""
    return F.broadcast(df) if len(df.take(SMALL_ROWS + 1)) <= SMALL_ROWS else df


def every_combination(documents: DataFrame, views: DataFrame, pipelines: DataFrame) -> DataFrame:
    """A row for each view, pipeline and document; views and pipelines are run settings, few by nature."""
    return documents.crossJoin(small(views)).crossJoin(small(pipelines))


def complete_cases(values: DataFrame, by: list[str], unit: str = "doc_id", name: str = "pipeline", value: str = "value") -> DataFrame:
    """Rows of units for which every name of the group has a value; a unit has a row a name, so few rows."""
    known = values.filter(F.col(value).isNotNull())
    k = known.groupBy(*by).agg(F.countDistinct(name).alias("__k"))
    named = known.withColumn("__n", F.size(F.collect_set(name).over(Window.partitionBy(*by, unit))))
    return named.join(small(k), by).filter("__n = __k").select(*values.columns)


def multiset_matches(left: DataFrame, right: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows of left with ``matched``: each row of right can be used once, first come first served."""
    n = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return left.withColumn("__nth", nth).join(n, keys, "left").withColumn("matched", F.coalesce(F.col("__nth") <= F.col("__n"), F.lit(False))).drop("__nth", "__n")


def multiset_overlap(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, kept): how often a key is in left, and how many of those right has too."""
    a, b = (d.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)) for d, n in ((left, "n"), (right, "m")))
    return a.join(b, keys, "left").select(*keys, "n", F.least("n", F.coalesce("m", F.lit(0))).alias("kept"))


def compare_runs(a: DataFrame, b: DataFrame, keys=("pipeline", "view", "metric")) -> DataFrame:
    """value_a, value_b and delta (b - a where both are there) of every key of either run."""
    x, y = (d.select(*keys, F.col("value").alias(n)) for d, n in ((a, "value_a"), (b, "value_b")))
    return x.join(y, list(keys), "full").withColumn("delta", F.col("value_b") - F.col("value_a"))


def ranking(values: DataFrame, by: list[str], name: str = "pipeline", value: str = "value") -> DataFrame:
    """place by value, rows without one last, at a tie by name."""
    return values.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_last(), name)))


def leaders(values: DataFrame, by: list[str], name: str = "pipeline", value: str = "value") -> DataFrame:
    """The best of each group, the runner-up and how far it is behind."""
    order = Window.partitionBy(*by).orderBy(value, name)
    known = values.filter(F.col(value).isNotNull())
    placed = known.select(*by, name, value, F.row_number().over(order).alias("place"), F.lead(name).over(order).alias("runner_up"), (F.lead(value).over(order) - F.col(value)).alias("behind"))
    return placed.filter("place = 1").drop("place")


def best_each(values: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """All rows that share the lowest value of their group."""
    return values.withColumn("__m", F.min(value).over(Window.partitionBy(*by))).filter(F.col(value) == F.col("__m")).drop("__m")


def wide(values: DataFrame, rows: list[str], column: str, names: list[str], value: str = "value") -> DataFrame:
    return values.groupBy(*rows).pivot(column, names).agg(F.first(value))


def pareto_front(points: DataFrame, name: str, x: str, y: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Points that no other is at least as good as in both and better in one, both to be low.

    One sort by x and a running minimum of y: a point survives if its y is the least of its
    x and below all y of smaller x.
    """
    known = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    least = known.groupBy(*by, x).agg(F.min(y).alias("__y"))
    before = Window.partitionBy(*by).orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    front = least.withColumn("__b", F.min("__y").over(before)).filter(F.col("__b").isNull() | (F.col("__y") < F.col("__b")))
    return known.join(front.select(*by, x, F.col("__y").alias(y)), [*by, x, y], "left_semi").select(*by, name, x, y)


def signatures(misses: DataFrame, word: str = "word", name: str = "pipeline", count: str = "n") -> DataFrame:
    """Words grouped by the exact set of names that miss them."""
    sets = misses.groupBy(word).agg(F.array_sort(F.collect_set(name)).alias("names"), F.sum(count).alias("n"))
    return sets.groupBy("names").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("misses"))


def unseen(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not in ``done``."""
    return rows.join(done.select(*keys), keys, "left_anti")


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one of the tables has, with its ``side``."""
    one = lambda a, b, side: a.select(*keys).distinct().join(b.select(*keys), keys, "left_anti").withColumn("side", F.lit(side))
    return one(left, right, "left").unionByName(one(right, left, "right"))


def unique_names(rows: DataFrame, name: str, order: str) -> DataFrame:
    """The second ``X`` becomes ``X #2``."""
    nth = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return rows.withColumn("__nth", nth).withColumn(name, F.when(F.col("__nth") > 1, F.concat(F.col(name), F.lit(" #"), F.col("__nth").cast("string"))).otherwise(F.col(name))).drop("__nth")


def ordered_distinct(rows: DataFrame, name: str, order: str) -> DataFrame:
    return rows.groupBy(name).agg(F.min(order).alias("first")).orderBy("first", name)
