"""Comparison of pipelines by ranks, and of runs over time."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed_values import RANK_CRITICAL
from ..functions.text import iso_timestamp
from .aggregate import rank_sums
from .relational import complete_cases

LEAST_CASES = 6


def critical_value(k: int, alpha: float = 0.05) -> tuple[float, bool]:
    """The critical value for k competitors, and whether it is beyond the table; straight lines between entries."""
    if k < 2:
        raise ValueError("two competitors at least")
    at = sorted(RANK_CRITICAL)
    q = [RANK_CRITICAL[n][alpha == 0.01] for n in at]
    if k <= at[-1]:
        return float(np.interp(k, at, q)), False
    return q[-1] + (q[-1] - q[-2]) / (at[-1] - at[-2]) * (k - at[-1]), True


def _units(values: DataFrame, by: list[str], unit: str, name: str, value: str) -> DataFrame:
    """One row a unit: its names with values and ranks, ``xs``, and the sorted ``names``. A unit has a row a name."""
    known = values.filter(F.col(value).isNotNull())
    units = known.groupBy(*by, unit).agg(F.collect_list(F.struct(F.col(value).alias("v"), F.col(name).alias("n"))).alias("__xs"))
    count = lambda test: F.size(F.filter("__xs", test))

    def ranked(x):
        tied = count(lambda y: y["v"] == x["v"])
        rank = count(lambda y: y["v"] < x["v"]) + (tied + 1) / F.lit(2.0)
        return F.struct(x["n"].alias("name"), x["v"].alias("value"), rank.alias("rank"), (tied * tied - 1).cast("double").alias("ties"))

    return units.select(*by, unit, F.transform("__xs", ranked).alias("xs"), F.array_sort(F.transform("__xs", lambda x: x["n"])).alias("names"))


def ranks(values: DataFrame, by: list[str], unit: str = "doc_id", name: str = "pipeline", value: str = "value") -> DataFrame:
    """Average rank of each name within each unit for which all have a value; the smallest is 1."""
    cases = complete_cases(values, by, unit, name, value)
    rows = _units(cases, by, unit, name, value).select(*by, unit, F.explode("xs").alias("x"))
    return rows.select(*by, unit, F.col("x.name").alias(name), F.col("x.value").alias(value), F.col("x.rank").alias("rank"))


def rank_totals(values: DataFrame, by: list[str], unit: str = "doc_id", name: str = "pipeline", value: str = "value") -> DataFrame:
    """Over the complete cases, for each name: sum of ranks ``s``, cases ``n``, ``ties``, and how many names ``k``.

    One pass: units are summed by the set of names they have, and the few sets that lack one
    are left out at the end.
    """
    rows = _units(values, by, unit, name, value).select(*by, "names", F.explode("xs").alias("x"))
    sums = rows.groupBy(*by, "names", F.col("x.name").alias(name)).agg(F.sum("x.rank").alias("s"), F.count(F.lit(1)).alias("n"), F.sum("x.ties").alias("ties"))
    every = F.size(F.array_distinct(F.flatten(F.collect_set("names").over(Window.partitionBy(*by)))))
    return sums.withColumn("k", every.cast("long")).filter(F.size("names") == F.col("k")).drop("names")


def mean_ranks(values: DataFrame, by: list[str], unit: str = "doc_id", name: str = "pipeline", value: str = "value") -> DataFrame:
    """mean_rank and n of each name, with the critical distance of its group (from three names and six cases on)."""
    means = rank_totals(values, by, unit, name, value).filter((F.col("k") >= 2) & (F.col("n") >= LEAST_CASES))
    means = means.select(*by, name, (F.col("s") / F.col("n")).alias("mean_rank"), "n", "k")
    return means.withColumn("critical_distance", F.when(F.col("k") >= 3, critical_column(F.col("k")) * F.sqrt(F.col("k") * (F.col("k") + 1) / (6.0 * F.col("n")))))


def critical_column(k: Column, alpha: float = 0.05) -> Column:
    """critical_value as an expression: the table's pieces as straight lines."""
    at = sorted(RANK_CRITICAL)
    out = F.lit(None).cast("double")
    for low, high in zip(at[:-1], at[1:], strict=True):
        a, b = (RANK_CRITICAL[n][alpha == 0.01] for n in (low, high))
        piece = F.lit(a) + (k - low) * ((b - a) / (high - low))
        out = F.when(k >= low, piece).otherwise(out)
    return out


def rank_gaps(means: DataFrame, by: list[str], name: str = "pipeline") -> DataFrame:
    """Every two names with the gap of their mean ranks, significant if above the critical distance."""
    a = means.select(*by, F.col(name).alias("a"), F.col("mean_rank").alias("ra"), "critical_distance")
    b = means.select(*by, F.col(name).alias("b"), F.col("mean_rank").alias("rb"))
    pairs = (a.join(b, by) if by else a.crossJoin(F.broadcast(b))).filter("a < b").withColumn("gap", F.abs(F.col("ra") - F.col("rb")))
    return pairs.select(*by, "a", "b", "gap", (F.col("gap") > F.col("critical_distance")).alias("significant"))


def tied_groups(means: DataFrame, by: list[str], name: str = "pipeline") -> DataFrame:
    """Runs of names, in order of rank, within the critical distance of the run's first.

    Folded over the ordered names of a group; those are the pipelines of one comparison.
    """
    placed = means.groupBy(*by, "critical_distance").agg(F.array_sort(F.collect_list(F.struct("mean_rank", F.col(name).alias("name")))).alias("xs"))
    empty = F.array().cast("array<struct<start:double,names:array<string>>>")

    def step(done, x):
        last = F.try_element_at(done, F.lit(-1))
        joins = last.isNotNull() & (x["mean_rank"] - last["start"] <= F.col("critical_distance"))
        grown = F.struct(last["start"].alias("start"), F.concat(last["names"], F.array(x["name"])).alias("names"))
        new = F.struct(x["mean_rank"].alias("start"), F.array(x["name"]).alias("names"))
        return F.when(joins, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(done, F.array(new)))

    groups = F.aggregate("xs", empty, step)
    return placed.filter("critical_distance is not null").select(*by, F.posexplode(groups).alias("group", "g")).select(*by, "group", "g.names")


def draws(n: int, seed: int, size: int = 1 << 16):
    """Arrays of numbers below n, drawn one after the other as the standard library's generator does."""
    key = random.Random(seed).getstate()[1]
    bits = np.random.MT19937()
    bits.state = {"bit_generator": "MT19937", "state": {"key": np.array(key[:-1], np.uint32), "pos": key[-1]}}
    while True:
        some = bits.random_raw(size) >> np.uint64(32 - n.bit_length())
        yield some[some < n].astype(np.int64)


def resampled_means(xs: np.ndarray, rounds: int, seed: int) -> np.ndarray:
    """Means of as many resamples, each of as many values as there are."""
    sums, at, left, n = np.zeros(rounds), 0, len(xs), len(xs)
    for some in draws(n, seed):
        while len(some):
            now, some = some[:left], some[left:]
            sums[at] += xs[now].sum()
            left -= len(now)
            if not left:
                at, left = at + 1, n
                if at == rounds:
                    return sums / n


def bootstrap(values: DataFrame, by: list[str], value: str = "value", order: str = "doc_pos", rounds: int = 1000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """Percentile interval of the mean of each group, resampled in document order with a fixed seed.

    A group is the values of one pipeline and metric, and is resampled as a whole: its
    intervals are those of one sequence of draws. It takes the memory of its values.
    """

    def interval(key, pdf):
        xs = pdf.sort_values(order, kind="stable")[value].to_numpy(float)
        means = np.sort(resampled_means(xs, rounds, seed))
        at = [min(max(round(q * (rounds - 1)), 0), rounds - 1) for q in ((1 - level) / 2, (1 + level) / 2)]
        return pd.DataFrame([(*key, xs.mean(), means[at[0]], means[at[1]], len(xs))])

    known = values.filter(F.col(value).isNotNull()).select(*by, order, value)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in known.select(*by).schema)
    return known.groupBy(*by).applyInPandas(interval, f"{fields}, mean double, lower double, upper double, n long")


def chi_square_tail(x: float, freedom: int) -> float:
    """P(X >= x), by the series or the continued fraction of the incomplete gamma function."""
    a, half = freedom / 2, x / 2
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(half) - half - math.lgamma(a))
    if half < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-16:
            n += 1
            term *= half / n
            total += term
        return max(0.0, 1 - total * scale)
    b, c = half + 1 - a, 1e300
    d = 1 / b
    out = d
    for i in range(1, 1000):
        step = -i * (i - a)
        b += 2
        d, c = 1 / (step * d + b), b + step / c
        out *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return out * scale


def friedman(values: DataFrame, by: list[str], unit: str = "doc_id", name: str = "pipeline", value: str = "value") -> DataFrame:
    """Friedman's statistic with the correction for ties, and its p-value; from three names on."""
    sums = rank_totals(values, by, unit, name, value)
    out = sums.groupBy(*by).agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.max("n").alias("n"), F.max("k").alias("k"), F.sum("ties").alias("ties"))
    k, n = F.col("k"), F.col("n")
    raw = 12.0 / (n * k * (k + 1)) * F.col("ss") - 3 * n * (k + 1)
    even = 1 - F.col("ties") / (n * (k * k * k - k))
    out = out.filter((k >= 3) & (n >= LEAST_CASES)).withColumn("chi2", F.when(even > 0, raw / even))

    @F.pandas_udf("double")
    def tail(x: pd.Series, freedom: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(a) else chi_square_tail(a, int(b)) for a, b in zip(x, freedom, strict=True)], dtype="float64")

    return out.select(*by, "n", "k", "chi2", tail("chi2", k - 1).alias("p"))


def signed_rank_tail(n: int, low: float, cases: int, ties: float) -> float:
    """Two-sided p of the smaller rank sum of n differences: exact for up to 50 without ties or zeros, else normal."""
    if n <= 50 and not ties and n == cases:
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for r in range(1, n + 1):
            ways[r:] += ways[:-r].copy()
        return min(1.0, float(2 * ways[: int(low) + 1].sum() / 2**n))
    spread = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return math.erfc(abs(low - n * (n + 1) / 4) / math.sqrt(spread) / math.sqrt(2)) if spread else 1.0


def wilcoxon(values: DataFrame, by: list[str], a: str, b: str, unit: str = "doc_id", name: str = "pipeline", value: str = "value") -> DataFrame:
    """Signed-rank test between two names of each group: cases ``n``, ``statistic`` and ``p`` (null for few cases or no difference).

    Differences are counted by size and ranked in bins (see ``rank_sums``).
    """
    known = values.filter(F.col(name).isin(a, b) & F.col(value).isNotNull())
    both = known.groupBy(*by, unit).agg(*[F.max(F.when(F.col(name) == x, F.col(value))).alias(c) for x, c in ((a, "__a"), (b, "__b"))])
    gaps = both.select(*by, (F.col("__a") - F.col("__b")).alias("g")).filter("g is not null")
    sizes = gaps.groupBy(*by, F.abs("g").alias("size")).agg(F.count(F.lit(1)).alias("t"), F.count_if(F.col("g") > 0).alias("up"))
    # a difference of nothing has no rank, but is a case
    zero = F.col("size") == 0
    sizes = sizes.withColumns({"__zeros": F.when(zero, F.col("t")).otherwise(0), "t": F.when(zero, 0).otherwise(F.col("t"))})
    out = rank_sums(sizes, by, "size", "t", up=F.col("up"), zeros=F.col("__zeros"))

    @F.pandas_udf("double")
    def tail(n: pd.Series, low: pd.Series, cases: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series([None if not a or pd.isna(b) else signed_rank_tail(int(a), b, int(c), d) for a, b, c, d in zip(n, low, cases, ties, strict=True)], dtype="float64")

    cases = F.col("total") + F.col("zeros")
    tested = (cases >= LEAST_CASES) & (F.col("total") > 0)
    low = F.when(tested, F.least(F.col("ranked_up"), F.col("total") * (F.col("total") + 1) / 2 - F.col("ranked_up")))
    out = out.select(*by, cases.alias("n"), "total", "ties", low.alias("statistic"))
    return out.select(*by, "n", "statistic", tail("total", "statistic", "n", "ties").alias("p"))


# -- time ------------------------------------------------------------------------------


def trend(series: DataFrame, by: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """Least-squares slope a day, intercept at the first point and R2 (1 for a constant series)."""
    first = F.min(ts).over(Window.partitionBy(*by))
    days = series.filter(F.col(value).isNotNull()).withColumn("__d", (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(first.cast("timestamp"))) / F.lit(86_400_000_000.0))
    out = days.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.regr_slope(value, "__d").alias("slope"), F.regr_intercept(value, "__d").alias("intercept"), F.regr_r2(value, "__d").alias("r2"), F.min(value).alias("__a"), F.max(value).alias("__b"))
    flat = F.col("__a") == F.col("__b")
    out = out.filter((F.col("n") >= 2) & F.col("slope").isNotNull())
    return out.select(*by, "n", F.when(flat, 0.0).otherwise(F.col("slope")).alias("slope"), F.when(flat, F.col("__a")).otherwise(F.col("intercept")).alias("intercept"), F.when(flat, 1.0).otherwise(F.greatest(F.lit(0.0), F.col("r2"))).alias("r2"))


def change_point(series: DataFrame, by: list[str], order: list[str], value: str = "value", alpha: float = 0.05) -> DataFrame:
    """Pettitt's test: the boundary at which the ranks before and after differ most.

    U(t) = 2 * (sum of the first t ranks) - t * (n + 1), up to sign, so one ranking and one
    running sum replace all comparisons of pairs.
    """
    rank = F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / F.lit(2.0)
    group = Window.partitionBy(*by)
    ordered = Window.partitionBy(*by).orderBy(*order)
    upto = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = series.filter(F.col(value).isNotNull()).withColumn("__r", rank).withColumns({"t": F.row_number().over(ordered), "n": F.count(F.lit(1)).over(group), "__s": F.sum("__r").over(upto), "__v": F.sum(value).over(upto), "__all": F.sum(value).over(group)})
    u = F.abs(2 * F.col("__s") - F.col("t") * (F.col("n") + 1))
    rows = rows.filter("t < n").withColumn("u", u)
    best = rows.groupBy(*by).agg(F.min(F.struct((-F.col("u")).alias("u"), "t", "n", "__v", "__all")).alias("b"))
    k, n, t = -F.col("b.u"), F.col("b.n"), F.col("b.t")
    p = F.least(F.lit(1.0), 2 * F.exp(-6.0 * k * k / (n * n * n + n * n)))
    before, after = F.col("b.__v") / t, (F.col("b.__all") - F.col("b.__v")) / (n - t)
    return best.select(*by, n.alias("n"), t.alias("boundary"), k.alias("u"), p.alias("p"), (p <= alpha).alias("significant"), before.alias("mean_before"), after.alias("mean_after"), (after - before).alias("delta"))


def series_insight(history: DataFrame, by: list[str]) -> DataFrame:
    """Trend of each series of (by, run_id, completed_at, value) and, where its level shifts significantly, the first run after.

    Times are ISO text, UTC where they name no zone; rows whose time can't be read are left out.
    """
    rows = history.withColumn("ts", iso_timestamp(F.col("completed_at").cast("string"))).filter("ts is not null")
    place = F.row_number().over(Window.partitionBy(*by).orderBy("ts", "run_id"))
    shift = change_point(rows, by, ["ts", "run_id"]).filter("significant").select(*by, "boundary")
    at = rows.filter(F.col("value").isNotNull()).withColumn("__n", place).join(shift, by).filter(F.col("__n") == F.col("boundary") + 1).select(*by, F.col("run_id").alias("shift_run"))
    return trend(rows, by).join(at, by, "left")


def last_two(history: DataFrame, by: list[str], order: list[str], value: str = "value", threshold: float = 0.0, higher_is_better: bool = False) -> DataFrame:
    """The latest two values of each series, their difference and whether it is for the worse beyond the threshold."""
    up = Window.partitionBy(*by).orderBy(*order)
    rows = history.withColumns({"previous": F.lag(value).over(up), "__last": F.lead(F.lit(1)).over(up)}).filter(F.col("__last").isNull() & F.col("previous").isNotNull())
    delta = F.col(value) - F.col("previous")
    return rows.select(*by, "previous", F.col(value).alias("latest"), delta.alias("delta"), ((-delta if higher_is_better else delta) > threshold).alias("worse"))


def history_series(history: DataFrame, pipeline: str, view: str, metric: str) -> DataFrame:
    return history.filter((F.col("pipeline") == pipeline) & (F.col("view") == view) & (F.col("metric") == metric)).orderBy("completed_at", "run_id")
