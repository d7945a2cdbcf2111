"""A run: documents x views x pipelines to pairs, scores, aggregates and analyses."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.normalize import PROFILES, Profile, newline_preserved, prepare
from ..operators import aggregate, analyses, layout, reports, statistics
from ..operators.metrics import METRIC_PROFILES, Metric, score
from ..operators.relational import small
from ..schema import TEXT_TYPES
from ..sources.readers import confidence_tokens
from ..sources.xml_layout import layout_text

#: Candidates in order of preference; others follow by name.
PREFERENCE = ("corrected_text", "raw_text")
TEXT_LIKE = (*TEXT_TYPES,)


@dataclass(frozen=True)
class View:
    """A lens: what it takes from either side, how both are prepared, and what is measured."""

    name: str
    profile: Profile | None = None
    char_exclude: str = ""
    gt_type: str = "raw_text"
    candidates: tuple[str, ...] = ("corrected_text", "raw_text")
    projections: Mapping[str, str] = field(default_factory=dict)
    metrics: tuple[str, ...] = METRIC_PROFILES["standard"]
    archaic: str = fixed.ARCHAIC_CORE


def default_views(gt_types: Iterable[str], metrics: tuple[str, ...] = METRIC_PROFILES["standard"]) -> list[View]:
    """A text view for raw references, another for reference texts; the text view if there is neither."""
    kinds = set(gt_types)
    views = [View("text", PROFILES["nfc"], metrics=metrics)] if "raw_text" in kinds or "reference_text" not in kinds else []
    return views + [View("reference_text", PROFILES["nfc"], gt_type="reference_text", metrics=metrics)] * ("reference_text" in kinds)


def projected(kind: str, wanted: str, content, projections: Mapping[str, str]):
    """The content as the wanted type: itself, by a projection, or null."""
    same = kind == wanted or (kind in TEXT_LIKE and wanted in TEXT_LIKE)
    if same:
        return content
    how = projections.get(kind)
    if how == "layout_to_text":
        return layout_text(F.encode(content, "UTF-8"))
    return content if how == "identity" else F.lit(None).cast("string")


def candidates(outputs: DataFrame, view: View) -> DataFrame:
    """(pipeline, doc_id, hyp): of the outputs the view takes the one it prefers."""
    kinds = [k for k in PREFERENCE if k in view.candidates] + sorted(set(view.candidates) - set(PREFERENCE))
    rank = F.coalesce(*[F.when(F.col("artifact_type") == k, n) for n, k in enumerate(kinds)])
    best = outputs.withColumn("__r", rank).filter("__r is not null").groupBy("pipeline", "doc_id").agg(F.min(F.struct("__r", "artifact_type", "content")).alias("b"))
    texts = [F.when(F.col("b.artifact_type") == k, projected(k, "raw_text", F.col("b.content"), view.projections)) for k in kinds]
    return best.select("pipeline", "doc_id", F.coalesce(*texts).alias("hyp"))


def references(ground_truth: DataFrame, view: View) -> DataFrame:
    """(doc_id, ref): the reference of the view's type, else the first that can be projected to it."""
    kinds = [view.gt_type, *[k for k in view.projections if k != view.gt_type]]
    rank = F.coalesce(*[F.when(F.col("gt_type") == k, n) for n, k in enumerate(kinds)])
    best = ground_truth.withColumn("__r", rank).filter("__r is not null").groupBy("doc_id").agg(F.min(F.struct("__r", "gt_type", "content")).alias("b"))
    texts = [F.when(F.col("b.gt_type") == k, projected(k, view.gt_type, F.col("b.content"), view.projections)) for k in kinds]
    return best.select("doc_id", F.coalesce(*texts).alias("ref"))


def pairs(documents: DataFrame, ground_truth: DataFrame, outputs: DataFrame, views: Iterable[View]) -> DataFrame:
    """Prepared texts of every view, pipeline and document; a missing side is null."""
    pipelines = outputs.select("pipeline").distinct()
    stratum = F.col("stratum")
    if "metadata" in documents.columns:
        stratum = F.coalesce(stratum, F.try_element_at("metadata", F.lit("stratum")))
    every = documents.select("doc_id", "doc_pos", stratum.alias("stratum")).crossJoin(small(pipelines))
    out = None
    for view in views:
        rows = every.join(references(ground_truth, view), "doc_id", "left").join(candidates(outputs, view), ["pipeline", "doc_id"], "left")
        texts = [prepare(F.col(c), view.profile, view.char_exclude).alias(c) for c in ("ref", "hyp")]
        rows = rows.select(F.lit(view.name).alias("view"), "pipeline", "doc_id", "doc_pos", "stratum", *texts)
        out = rows if out is None else out.unionByName(rows)
    return out


def _references(documents: DataFrame, ground_truth: DataFrame, views: Iterable[View]) -> DataFrame:
    """(view, doc_id, ref): the prepared reference of each view and document."""
    out = None
    for view in views:
        rows = documents.select("doc_id").join(references(ground_truth, view), "doc_id")
        rows = rows.select(F.lit(view.name).alias("view"), "doc_id", prepare(F.col("ref"), view.profile, view.char_exclude).alias("ref"))
        out = rows if out is None else out.unionByName(rows)
    return out


@dataclass(frozen=True)
class Run:
    pairs: DataFrame
    scores: DataFrame
    aggregates: DataFrame
    analyses: Mapping[str, DataFrame]


def _kept(df: DataFrame, folder: str | None, name: str) -> DataFrame:
    """Computed once: written to the run's folder, or persisted where it has none."""
    if folder is None:
        return df.persist()
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.parquet(f"{folder}/{name}")


def token_confidences(outputs: DataFrame, references: DataFrame) -> DataFrame:
    """(pipeline, doc_id, pos, text, confidence, correct) from the outputs' sidecars of confidences."""
    rows = outputs.filter("artifact_type = 'confidences'").select("pipeline", "doc_id", F.posexplode(confidence_tokens(F.col("content"))).alias("pos", "t"))
    return analyses.matched_tokens(rows.select("pipeline", "doc_id", "pos", "t.*"), references)


def entity_pairs(ground_truth: DataFrame, outputs: DataFrame) -> DataFrame:
    """(pipeline, doc_id, ref, hyp): entities of the references beside those of the outputs."""
    ref = ground_truth.filter("gt_type = 'entities'").select("doc_id", layout.parse_entities(F.col("content")).alias("ref")).filter("ref is not null")
    hyp = outputs.filter("artifact_type = 'entities'").select("pipeline", "doc_id", layout.parse_entities(F.col("content")).alias("hyp"))
    return ref.join(hyp, "doc_id")


def _verdicts(scored: DataFrame, means: DataFrame) -> DataFrame:
    rates = scored.filter("metric = 'cer'")
    tied = statistics.tied_groups(means.filter("metric = 'cer'"), ["view"])
    tested = reports.cross_engine(rates, ["friedman", "wilcoxon"]).filter("value is not null").select(F.split("metric", ":")[0].alias("view"), F.col("value").alias("p"))
    return reports.verdicts(aggregate.micro(rates, ["view", "pipeline"]), tied, tested)


def run(
    documents: DataFrame,
    ground_truth: DataFrame,
    outputs: DataFrame,
    views: Iterable[View],
    metrics: Mapping[str, Metric] | None = None,
    *,
    usage: DataFrame | None = None,
    tariffs: DataFrame | None = None,
    images: DataFrame | None = None,
    folder: str | None = None,
    sink: Callable[[DataFrame], None] | None = None,
) -> Run:
    """Plans of a run. Pairs and scores are computed once (see ``_kept``), the analyses when they are read or written.

    ``sink`` gets the outputs before anything is compared, to write what is to be kept of them.
    """
    views = list(views)
    if sink is not None:
        sink(outputs)
    prepared = _kept(pairs(documents, ground_truth, outputs, views), folder, "pairs")
    scored = None
    for view in views:
        rows = score(prepared.filter(F.col("view") == view.name), view.metrics, metrics, view.archaic)
        scored = rows if scored is None else scored.unionByName(rows)
    scored = _kept(scored, folder, "scores")
    both = prepared.filter("ref is not null and hyp is not null")
    plain = documents.select("doc_id", "doc_pos").join(ground_truth.filter("gt_type = 'raw_text'").select("doc_id", F.col("content").alias("ref")), "doc_id")
    triples = reports.two_stage_triples(plain, outputs)
    lined = [v.name for v in views if newline_preserved(v.profile, v.char_exclude)]
    lines = analyses.aligned_lines(both.filter(F.col("view").isin(lined)))
    # a row a view and document, so that the texts of all pipelines are not gathered for it
    referenced = _references(documents, ground_truth, views)
    by_rank = statistics.mean_ranks(scored, ["view", "metric"])
    found = {
        "confusions": analyses.confusions(both),
        "worst_lines": analyses.worst_lines(both),
        "hardest_documents": analyses.hardest_documents(scored),
        "taxonomy": analyses.taxonomy(both),
        "word_errors": analyses.word_errors(both),
        "modernisation": analyses.modernisation(both),
        "rare_token_recall": analyses.rare_token_recall(both, references=referenced),
        "complementarity": analyses.complementarity(both),
        "divergence": analyses.jensen_shannon(analyses.taxonomy(both), ["view"], "pipeline", "class", "n"),
        "structured_data": analyses.structured_data(both),
        "philology": analyses.philology(both),
        "roman": analyses.roman_numerals(both),
        "lines": analyses.line_summary(lines),
        "line_heatmap": analyses.line_heatmap(lines),
        "ranks": by_rank,
        "rank_gaps": statistics.rank_gaps(by_rank, ["view", "metric"]),
        "tied_groups": statistics.tied_groups(by_rank, ["view", "metric"]),
        "intervals": statistics.bootstrap(scored, ["view", "metric", "pipeline"]),
        "document_texts": analyses.document_texts(both, scored),
        "conformity": analyses.conformity(scored),
        "cross_engine": reports.cross_engine(scored),
        "verdicts": _verdicts(scored, by_rank),
        "correction": analyses.correction(triples),
        "worst_regressions": analyses.worst_regressions(triples),
        "calibration": analyses.calibration(token_confidences(outputs, plain), ["pipeline"]),
        "entities": analyses.entity_scores(layout.entity_counts(entity_pairs(ground_truth, outputs), ["pipeline"]), ["pipeline", "label"]),
    }
    if usage is not None:
        none = usage.sparkSession.createDataFrame([], "pipeline string, per_million_in double, per_million_out double, per_page double")
        first = scored.filter(F.col("view") == views[0].name)
        found["economics"] = analyses.economics(usage, first, none if tariffs is None else tariffs)
        found["marginal_cost"] = analyses.marginal_cost(found["economics"])
    if images is not None:
        found["images"] = layout.image_quality(images)
        found["image_summary"] = layout.image_summary(found["images"])
    return Run(prepared, scored, aggregate.micro(scored), found)
