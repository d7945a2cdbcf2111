"""What reports show: relations over scores, regions and histories."""

from __future__ import annotations

import re
from html import escape

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from ..functions.align import EQUAL, Block
from ..functions.batch_align import matches
from .aggregate import micro
from .metrics import by_slices
from .relational import leaders, small


def score_table(scores: DataFrame, names: list[tuple[str, str]]) -> DataFrame:
    """A row a document, a column ``pipeline_metric`` for each of the names."""
    one = [F.max(F.when((F.col("pipeline") == p) & (F.col("metric") == m), F.col("value"))).alias(f"{p}_{m}") for p, m in names]
    return scores.groupBy("view", "doc_id").agg(*one)


def ordered_engines(scores: DataFrame, metric: str = "cer") -> DataFrame:
    """Engines of each document by rate, then name: (view, doc_id, place, pipeline, value)."""
    rows = scores.filter((F.col("metric") == metric) & F.col("value").isNotNull())
    order = Window.partitionBy("view", "doc_id").orderBy("value", "pipeline")
    return rows.select("view", "doc_id", F.row_number().over(order).alias("place"), "pipeline", "value")


def worst_first(scores: DataFrame, metric: str = "cer") -> DataFrame:
    """Documents by their highest rate, the worst first, those without one last: (doc_id, worst) in order."""
    value = F.when(F.col("metric") == metric, F.col("value"))
    return scores.groupBy("doc_id").agg(F.max(value).alias("worst")).orderBy(F.desc_nulls_last("worst"), "doc_id")


def share_of_top(values: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Each value and its share of its group's largest, as the length of a bar."""
    top = F.max(value).over(Window.partitionBy(*by))
    return values.withColumns({"top": top, "bar": F.when(top > 0, F.col(value) / top).otherwise(0.0)})


def class_table(counted: DataFrame, classes: list[str], name: str = "pipeline", label: str = "class", n: str = "n") -> DataFrame:
    """A row a pipeline: its errors, and the share of each class."""
    total = F.sum(n)
    return counted.groupBy(name).agg(total.alias("errors"), *[(F.coalesce(F.sum(F.when(F.col(label) == c, F.col(n))), F.lit(0)) / total).alias(c) for c in classes])


def report_header(scores: DataFrame, documents: DataFrame) -> DataFrame:
    """Exact numbers of engines, views, metrics and documents, and of strata."""
    head = scores.agg(*[F.countDistinct(c).alias(a) for c, a in (("pipeline", "engines"), ("view", "views"), ("metric", "metrics"), ("doc_id", "documents"))])
    return head.crossJoin(F.broadcast(documents.agg(F.countDistinct("stratum").alias("strata"))))


def corpus_summary(documents: DataFrame, by: str = "corpus") -> DataFrame:
    """Documents, those with a reference, and pages of each corpus."""
    return documents.groupBy(by).agg(F.count(F.lit(1)).alias("documents"), F.count_if("has_reference").alias("with_reference"), F.sum("pages").alias("pages"))


def first_strata(scores: DataFrame, order: str) -> DataFrame:
    """The stratum of each document in its first row."""
    return scores.filter("stratum is not null").groupBy("doc_id").agg(F.min_by("stratum", order).alias("stratum"))


def engine_profiles(scores: DataFrame, calibrated: DataFrame, classes: DataFrame, k: int = 100) -> DataFrame:
    """One row an engine: error rate, support, its ``k`` worst rates in order, calibration error and commonest class."""
    rates = scores.filter((F.col("metric") == "cer") & F.col("value").isNotNull())
    place = F.row_number().over(Window.partitionBy("pipeline").orderBy(F.desc("value"), "doc_id"))
    worst = rates.withColumn("__n", place).filter(F.col("__n") <= k).groupBy("pipeline").agg(F.reverse(F.array_sort(F.collect_list("value"))).alias("worst"))
    common = classes.groupBy("pipeline").agg(F.min(F.struct((-F.col("n")).alias("n"), "class"))["class"].alias("commonest"))
    out = micro(rates, ["pipeline"]).join(worst, "pipeline", "left")
    return out.join(calibrated.select("pipeline", "ece"), "pipeline", "left").join(common, "pipeline", "left")


def verdicts(means: DataFrame, tied: DataFrame, tested: DataFrame, level: float = 0.05) -> DataFrame:
    """What can be said of each view's leader and runner-up.

    ``means``: view, pipeline, value; ``tied``: view, names of groups that the post-hoc test
    can't part (a view it was not run for has none); ``tested``: view, p. A tie of the two
    overrides the raw p, a post-hoc test without one confirms; else p decides.
    """
    pairs = leaders(means, ["view"])
    groups = tied.groupBy("view").agg(F.collect_list("names").alias("groups"))
    out = pairs.join(small(groups), "view", "left").join(small(tested.select("view", "p")), "view", "left")
    same = F.exists("groups", lambda g: F.array_contains(g, F.col("pipeline")) & F.array_contains(g, F.col("runner_up")))
    verdict = F.when(F.col("runner_up").isNull(), "alone").when(same, "tie").when(F.col("groups").isNotNull(), "confirmed").when(F.col("p").isNull(), "unknown").when(F.col("p") < level, "significant").otherwise("not_separable")
    return out.select("view", "pipeline", "value", "runner_up", "behind", "p", verdict.alias("verdict"))


MARKED = pa.struct([("ref", pa.string()), ("hyp", pa.string())])


#: What ``escape`` replaces.
SPECIAL = re.compile("[&<>\"']")


def _marked(ref: str, hyp: str, blocks: list[Block]) -> tuple[str, str]:
    left, right = [], []
    special = SPECIAL.search(ref) or SPECIAL.search(hyp)
    for op, i, i2, j, j2 in blocks:
        a, b = ref[i:i2], hyp[j:j2]
        if special:
            a, b = escape(a), escape(b)
        left.append(a if op == EQUAL or not a else f"<del>{a}</del>")
        right.append(b if op == EQUAL or not b else f"<ins>{b}</ins>")
    return "".join(left), "".join(right)


@F.arrow_udf(from_arrow_type(MARKED))
def marked_texts(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """Both texts as HTML, what only one of them has marked as deleted or inserted."""

    def rows(refs: list[str], hyps: list[str]) -> pa.Array:
        sides = zip(*map(_marked, refs, hyps, matches(refs, hyps)), strict=True) if refs else ((), ())
        return pa.StructArray.from_arrays([pa.array(x, pa.string()) for x in sides], fields=list(MARKED))

    return by_slices(rows, ref, hyp)


def recent_history(history: DataFrame, k: int = 1000) -> DataFrame:
    """The latest records, newest first."""
    return history.orderBy(F.desc("completed_at"), "run_id", "pipeline", "view", "metric").limit(k)


def measured_pairs(history: DataFrame) -> DataFrame:
    """The views and metrics there is a history of."""
    return history.select("view", "metric").distinct().orderBy("view", "metric")


def page_extents(regions: DataFrame, by: list[str]) -> DataFrame:
    """Width and height of pages: as declared, else as far as boxes reach."""
    reach = lambda at, size: F.max(F.col(f"bbox.{at}") + F.col(f"bbox.{size}"))
    return regions.groupBy(*by).agg(F.coalesce(F.max("page_width"), reach("x", "width")).alias("width"), F.coalesce(F.max("page_height"), reach("y", "height")).alias("height"))


def two_stage_triples(references: DataFrame, outputs: DataFrame) -> DataFrame:
    """(pipeline, doc_id, ref, raw, corrected) of the pipelines that have a corrected output of some document; what is missing is empty."""
    kinds = outputs.groupBy("pipeline", "doc_id").agg(*[F.max(F.when(F.col("artifact_type") == k, F.col("content"))).alias(c) for k, c in (("raw_text", "raw"), ("corrected_text", "corrected"))])
    two = outputs.filter("artifact_type = 'corrected_text'").select("pipeline").distinct()
    rows = references.crossJoin(small(two)).join(kinds, ["pipeline", "doc_id"], "left")
    return rows.select("pipeline", "doc_id", "doc_pos", "ref", *[F.coalesce(c, F.lit("")).alias(c) for c in ("raw", "corrected")])


def system_texts(references: DataFrame, outputs: DataFrame) -> DataFrame:
    """(pipeline, doc_id, doc_pos, ref, raw, corrected) of all pipelines, whether they correct or not; corrected is null where there is none."""
    kinds = outputs.groupBy("pipeline", "doc_id").agg(*[F.max(F.when(F.col("artifact_type") == k, F.col("content"))).alias(c) for k, c in (("raw_text", "raw"), ("corrected_text", "corrected"))])
    return references.crossJoin(small(outputs.select("pipeline").distinct())).join(kinds, ["pipeline", "doc_id"], "left")


# -- measures across engines -----------------------------------------------------------

CROSS_ENGINE: dict = {}


def cross_engine_metric(name: str):
    """Registers a function from complete cases (view, metric, doc_id, pipeline, value) to (view, metric, value, support)."""

    def register(f):
        CROSS_ENGINE[name] = f
        return f

    return register


@cross_engine_metric("friedman")
def _friedman(scores: DataFrame) -> DataFrame:
    from .statistics import friedman

    return friedman(scores, ["view", "metric"]).select("view", "metric", F.col("p").alias("value"), F.col("n").alias("support"))


@cross_engine_metric("wilcoxon")
def _wilcoxon(scores: DataFrame) -> DataFrame:
    """Where exactly two engines are compared."""
    from .statistics import wilcoxon

    two = scores.filter("value is not null").groupBy("view", "metric").agg(F.min("pipeline").alias("__a"), F.countDistinct("pipeline").alias("__k")).filter("__k = 2")
    named = scores.join(small(two), ["view", "metric"]).withColumn("pipeline", F.when(F.col("pipeline") == F.col("__a"), "a").otherwise("b"))
    return wilcoxon(named, ["view", "metric"], "a", "b").select("view", "metric", F.col("p").alias("value"), F.col("n").alias("support"))


@cross_engine_metric("spread")
def _spread(scores: DataFrame) -> DataFrame:
    """Mean distance of a document's best and worst engine."""
    each = scores.filter("value is not null").groupBy("view", "metric", "doc_id").agg((F.max("value") - F.min("value")).alias("d"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    return each.groupBy("view", "metric").agg(F.avg("d").alias("value"), F.count(F.lit(1)).alias("support"))


def cross_engine(scores: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(metric ``view:metric:name``, value, support) of the registered functions, in order of name."""
    out = None
    for name in sorted(CROSS_ENGINE if names is None else names):
        rows = CROSS_ENGINE[name](scores).select(F.concat_ws(":", "view", "metric", F.lit(name)).alias("metric"), "value", F.col("support").cast("long").alias("support"))
        out = rows if out is None else out.unionByName(rows)
    return out


# -- costs -----------------------------------------------------------------------------


def with_tariffs(pipelines: DataFrame, tariffs: DataFrame, on: str | None = None) -> DataFrame:
    """Pipelines (pipeline, kind, model) with per_million_in, per_million_out, per_page and ``basis``.

    A tariff (kind, model, paid, valid_until, three prices) of the model counts first, then
    that of the kind (model null). Kinds that are paid and have none get null prices and the
    reason ``unknown tariff``; a tariff past its date is ``outdated``.
    """
    prices = ("per_million_in", "per_million_out", "per_page")
    t = small(tariffs)
    exact = t.filter("model is not null").select("kind", "model", *[F.col(c).alias(f"__m_{c}") for c in (*prices, "valid_until")], F.lit(True).alias("__m"))
    kinds = t.filter("model is null").select("kind", *[F.col(c).alias(f"__k_{c}") for c in (*prices, "valid_until", "paid")], F.lit(True).alias("__k"))
    out = pipelines.join(exact, ["kind", "model"], "left").join(kinds, "kind", "left")
    pick = lambda c: F.when(F.col("__m"), F.col(f"__m_{c}")).otherwise(F.col(f"__k_{c}"))
    found = F.col("__m") | F.col("__k") & F.coalesce(*[F.col(f"__k_{c}") for c in prices]).isNotNull()
    basis = F.when(F.coalesce(found, F.lit(False)), F.when(pick("valid_until") < F.coalesce(F.lit(on).cast("date"), F.current_date()), "outdated").otherwise("tariff")).when(F.coalesce(F.col("__k_paid"), F.lit(False)), "unknown tariff").otherwise("machine")
    return out.select("pipeline", "kind", "model", *[pick(c).alias(c) for c in prices], basis.alias("basis"))
