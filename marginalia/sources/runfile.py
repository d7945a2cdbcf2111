"""Run files: what is evaluated, by which pipelines and through which views, as YAML.

Unknown fields are refused, paths must lie under the file's folder, and references must be
there. Outputs are replayed: a step whose adapter is ``precomputed:<label>`` stands for the
files ``<document>.<label>.txt`` beside the images.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.normalize import PROFILES, Profile, profile_from
from ..plans.evaluate import View
from .readers import precomputed_outputs, text_files

FIELDS = {
    "run": {"run_id", "corpus", "pipelines", "adapter_kwargs", "evaluation"},
    "corpus": {"name", "documents", "metadata"},
    "document": {"id", "image_uri", "ground_truths", "metadata"},
    "ground truth": {"type", "uri"},
    "pipeline": {"name", "description", "initial_inputs", "steps"},
    "evaluation": {"views"},
    "view": {"name", "description", "candidate_types", "projection", "projections_by_source_type", "normalization_profile", "char_exclude", "metric_names", "ignored_dimensions", "warnings"},
}


class RunFileError(ValueError):
    """A run file that can't be read or does not describe a run."""


@dataclass(frozen=True)
class RunFile:
    run_id: str
    corpus: str
    documents: tuple[dict, ...]
    pipelines: tuple[dict, ...]
    settings: Mapping[str, Mapping]
    views: tuple[View, ...]


def _checked(kind: str, value) -> dict:
    if not isinstance(value, dict):
        raise RunFileError(f"{kind}: an object is expected")
    if unknown := set(value) - FIELDS[kind]:
        raise RunFileError(f"{kind}: unknown fields {sorted(unknown)}")
    return value


def confined(path: str, base: Path, there: bool = False) -> str:
    """The path under the folder, as a whole; one that leads out of it, or is missing where it must be there, is refused."""
    whole = (base / path).resolve()
    if not whole.is_relative_to(base.resolve()):
        raise RunFileError(f"{path!r} leads out of the run's folder")
    if there and not whole.is_file():
        raise RunFileError(f"{path!r} is missing")
    return str(whole)


def view_from(settings: Mapping, profiles: Mapping[str, Profile] = PROFILES) -> View:
    """A view; a projection by source counts first, the default one if its source is a candidate."""
    v = _checked("view", settings)
    if not v.get("name") or not v.get("candidate_types"):
        raise RunFileError("view: name and candidate_types are needed")
    profile = v.get("normalization_profile")
    if isinstance(profile, str) and profile not in profiles:
        raise RunFileError(f"view {v['name']!r}: unknown profile {profile!r}")
    found = profile_from(profile, v["name"]) if isinstance(profile, dict) else profile and profiles[profile]
    how = {}
    if default := v.get("projection"):
        how[default["source_type"]] = default.get("name", "identity")
    how |= {k: p.get("name", "identity") if isinstance(p, dict) else p for k, p in (v.get("projections_by_source_type") or {}).items()}
    given = {"metrics": tuple(v["metric_names"])} if v.get("metric_names") else {}
    return View(v["name"], found or None, v.get("char_exclude") or "", candidates=tuple(v["candidate_types"]), projections=how, **given)


def load_run(path: str | Path, base: str | Path | None = None) -> RunFile:
    path = Path(path)
    base = Path(base) if base else path.parent
    try:
        raw = yaml.safe_load(path.read_text(encoding="utf-8"))
    except (OSError, yaml.YAMLError) as problem:
        raise RunFileError(f"unreadable run file: {problem}") from problem
    run = _checked("run", raw)
    corpus = _checked("corpus", run.get("corpus"))
    documents = []
    for d in corpus.get("documents") or ():
        _checked("document", d)
        image = d.get("image_uri") and confined(d["image_uri"], base)
        truths = [_checked("ground truth", t) for t in d.get("ground_truths") or ()]
        documents.append({"id": str(d["id"]), "image": image, "metadata": d.get("metadata") or {}, "truths": [(t["type"], confined(t["uri"], base, there=True)) for t in truths]})
    if len({d["id"] for d in documents}) < len(documents):
        raise RunFileError("corpus: documents of the same id")
    pipelines = tuple(_checked("pipeline", p) for p in run.get("pipelines") or ())
    evaluation = _checked("evaluation", run.get("evaluation") or {})
    return RunFile(str(run.get("run_id") or path.stem), str(corpus.get("name") or path.stem), tuple(documents), pipelines, run.get("adapter_kwargs") or {}, tuple(view_from(v) for v in evaluation.get("views") or ()))


def labels_of(pipeline: Mapping) -> list[tuple[str, str]]:
    """(label, artifact type) of the replayed steps of a pipeline."""
    out = []
    for step in pipeline.get("steps") or ():
        kind, _, label = str(step.get("adapter_name", "")).partition(":")
        if kind == "precomputed" and label:
            out.append((label, next(iter(step.get("output_types") or ("raw_text",)))))
    return out


def tables(spark: SparkSession, run: RunFile) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, references and outputs of a run; texts are read by Spark from the files named."""
    rows = [(d["id"], n, d["metadata"].get("stratum"), d["image"], {k: str(v) for k, v in d["metadata"].items()}) for n, d in enumerate(run.documents)]
    documents = spark.createDataFrame(rows, schema.DOCUMENTS)
    truths = [(d["id"], kind, f"file://{uri}") for d in run.documents for kind, uri in d["truths"]]
    named = spark.createDataFrame(truths, "doc_id string, gt_type string, uri string")
    none = spark.createDataFrame([], "path string, name string, content string")
    files = none
    for folder in sorted({t[2].rpartition("/")[0] for t in truths}):
        files = files.unionByName(text_files(spark, folder))
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    read = named.join(files.select(plain(F.col("path")).alias("path"), "content"), plain(F.col("uri")) == F.col("path")).select("doc_id", "gt_type", "content")
    folders = sorted({str(Path(d["image"]).parent) for d in run.documents if d["image"]})
    outputs = spark.createDataFrame([], schema.OUTPUTS)
    for p in run.pipelines:
        for label, kind in labels_of(p):
            for folder in folders:
                found = precomputed_outputs(spark, folder, [label])
                outputs = outputs.unionByName(found.withColumns({"pipeline": F.lit(p["name"]), "artifact_type": F.lit(kind)}).select(*outputs.columns))
    return documents, read, outputs.join(documents.select("doc_id"), "doc_id", "left_semi").select(*outputs.columns)
