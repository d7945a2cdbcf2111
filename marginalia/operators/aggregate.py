"""Aggregates over the fact table of scores (view, pipeline, doc_id, metric, value, weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUP = ("view", "pipeline", "metric")


def micro_value(value: str = "value", weight: str = "weight") -> Column:
    """Sum of value times weight over sum of weights, of the rows with a value; null if they weigh nothing."""
    w = F.coalesce(F.col(weight), F.lit(0))
    total = F.sum(F.when(F.col(value).isNotNull(), w))
    return F.when(total != 0, F.sum(F.col(value) * w) / total)


def micro(scores: DataFrame, by=GROUP) -> DataFrame:
    """value and support (rows with a value, those of no weight included)."""
    return scores.groupBy(*by).agg(micro_value().alias("value"), F.count("value").alias("support"))


def macro(scores: DataFrame, by=GROUP) -> DataFrame:
    return scores.groupBy(*by).agg(F.avg("value").alias("value"), F.count("value").alias("support"))


def dispersion(scores: DataFrame, by=GROUP) -> DataFrame:
    return scores.groupBy(*by).agg(F.min("value").alias("lowest"), F.percentile("value", 0.5).alias("median"), F.avg("value").alias("mean"), F.max("value").alias("highest"))


def composition(documents: DataFrame, stratum: str = "stratum") -> DataFrame:
    """Documents and share of each stratum; the total is one row, joined to the groups."""
    groups = documents.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"))
    return groups.crossJoin(F.broadcast(groups.agg(F.sum("n").alias("total")))).select(stratum, "n", (F.col("n") / F.col("total")).alias("share"))


def place_bin(x: Column) -> Column:
    """A number that grows with x, the same for values within half a percent of each other."""
    size = lambda v: F.floor(F.log(v) * 256) + 200_000
    return F.when(x > 0, size(x)).when(x < 0, -size(-x)).otherwise(F.lit(0).cast("long"))


def rank_sums(counted: DataFrame, by: list[str], x: str, n: str, **weights: Column) -> DataFrame:
    """Over the values of each group, counted by value: ``total``, and for each weight the sum of weight * mean rank of the value.

    Ranks are summed within bins of values, and the bins' results, a few thousand a group,
    are put together; so no group is sorted as a whole. ``ties`` is the sum of t^3 - t.
    """
    inside = Window.partitionBy(*by, "__bin").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    rows = counted.withColumn("__bin", place_bin(F.col(x)))
    rank = F.coalesce(F.sum(n).over(inside), F.lit(0)) + (F.col(n) + 1) / F.lit(2.0)
    rows = rows.withColumn("__rank", rank)
    t = F.col(n).cast("double")
    parts = {f"__w_{k}": F.sum(w).alias(f"__w_{k}") for k, w in weights.items()} | {f"__r_{k}": F.sum(w * F.col("__rank")).alias(f"__r_{k}") for k, w in weights.items()}
    bins = rows.groupBy(*by, "__bin").agg(F.sum(n).alias("__n"), F.sum(t * t * t - t).alias("__t"), *parts.values())
    below = Window.partitionBy(*by).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("__b", F.coalesce(F.sum("__n").over(below), F.lit(0)))
    sums = [F.sum(F.col(f"__r_{k}") + F.col("__b") * F.col(f"__w_{k}")).alias(f"ranked_{k}") for k in weights]
    return bins.groupBy(*by).agg(F.sum("__n").alias("total"), F.sum("__t").alias("ties"), *[F.sum(f"__w_{k}").alias(k) for k in weights], *sums)


def counted_values(values: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, value, n): known values counted by value, so that ties are one row."""
    return values.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


def gini(values: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Gini index of each group; negatives count as 0, an empty sum gives 0."""
    return counted_gini(counted_values(values, value, by), value, by)


def counted_gini(counted: DataFrame, value: str, by: list[str]) -> DataFrame:
    rows = counted.groupBy(*by, F.greatest(F.col(value), F.lit(0.0)).alias("__x")).agg(F.sum("n").alias("__n"))
    # the ranks of tied values sum up to their number times the mean rank
    out = rank_sums(rows, by, "__x", "__n", s=F.col("__x") * F.col("__n"))
    raw = 2 * F.col("ranked_s") / (F.col("total") * F.col("s")) - (F.col("total") + 1) / F.col("total")
    return out.select(*by, F.when(F.col("s") == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))).alias("gini"))


def percentiles(values: DataFrame, value: str, by: list[str], points=(0.5, 0.75, 0.9, 0.95, 0.99)) -> DataFrame:
    """Exact percentiles with linear interpolation, one column each."""
    ps = F.percentile(value, F.array(*map(F.lit, points)))
    return values.groupBy(*by).agg(ps.alias("p")).select(*by, *[F.col("p")[i].alias(f"p{round(100 * x)}") for i, x in enumerate(points)])


def best_of(rows: DataFrame, by: list[str], value: str, name: str, highest: bool = True) -> DataFrame:
    """The name with the best value, at a tie the smallest."""
    v = -F.col(value) if highest else F.col(value)
    best = F.min(F.when(F.col(value).isNotNull(), F.struct(v.alias("v"), F.col(name).alias("name"))))
    return rows.groupBy(*by).agg(best.alias("b")).select(*by, F.col("b.name").alias(name), (-F.col("b.v") if highest else F.col("b.v")).alias(value))


def top(rows: DataFrame, k: int, *order: Column, by: list[str] | None = None) -> DataFrame:
    """The first k rows, of the table or of each group, with their place."""
    if by is None:
        rows = rows.orderBy(*order).limit(k)
        return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= k)


def first_samples(rows: DataFrame, by: list[str], item: str, order: list[str], k: int) -> DataFrame:
    """The first k items of each group in order, as an array."""
    kept = top(rows, k, *map(F.col, order), by=by)
    return kept.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", item))), lambda x: x[item]).alias("samples"))


def collected_samples(rows: DataFrame, by: list[str], item: str, k: int) -> DataFrame:
    """The first k distinct items of each group in their own order."""
    kept = top(rows.select(*by, item).distinct(), k, F.col(item), by=by)
    return kept.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("samples"))
