"""Command line: ``python -m marginalia run | compare | history | demo``."""

from __future__ import annotations

import argparse
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .operators import relational, reports, statistics
from .operators.metrics import HCPR, METRIC_PROFILES, registry
from .plans import evaluate, resume
from .sources import readers, runfile, sinks
from .sources.history_store import History

#: Documents of the demo: id, stratum, reference and what two engines read, the second also corrected.
DEMO = (
    ("page_1", "manuscript", "Icy commence le livre", {"one": ("Icy commence le liure", None), "two": ("Icy commence le livre", "Icy commence le livre")}),
    ("page_2", "manuscript", "maiſtre Pierre", {"one": ("maistre Pierre", None), "two": ("maiſtre Pierre", "maistre Pierre")}),
    ("page_3", "print", "imprimé à Lyon en 1521", {"one": ("imprime a Lyon en 1521", None), "two": ("imprimé à Lyon en 1527", "imprimé à Lyon en 1521")}),
    ("page_4", "print", "chapitre IV\nDu bon gouuernement", {"one": ("chapitre IV\nDu bon gouvernement", None), "two": ("chapitre VI\nDu bon gouuernement", "chapitre IV\nDu bon gouuernement")}),
    ("page_5", "print", "achevé le 3 may 1532", {"one": ("acheve le 3 may 1582", None), "two": ("achevé le 3 may 1532", "achevé le 3 may 1532")}),
)
#: Seconds and tokens of each page in the demo.
DEMO_USAGE = {"one": (1.5, None, None), "two": (6.0, 1200, 300)}
DEMO_TARIFFS = (("two", 3.0, 15.0, 0.0),)


def demo_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    documents = spark.createDataFrame([(d, n, s, None, None) for n, (d, s, _, _) in enumerate(DEMO)], schema.DOCUMENTS)
    truths = spark.createDataFrame([(d, "raw_text", t) for d, _, t, _ in DEMO], schema.GROUND_TRUTH)
    kinds = ("raw_text", "corrected_text")
    outputs = spark.createDataFrame([(p, d, kind, t) for d, _, _, each in DEMO for p, texts in each.items() for kind, t in zip(kinds, texts, strict=True) if t is not None], schema.OUTPUTS)
    return documents, truths, outputs


def demo_views() -> list[evaluate.View]:
    """The texts as they are, and with differences of case and of old letters set aside."""
    return [evaluate.View("text", evaluate.PROFILES["nfc"]), evaluate.View("heritage", evaluate.PROFILES["heritage"], metrics=METRIC_PROFILES["essentiel"])]


def write(run: evaluate.Run, args: argparse.Namespace, run_id: str, corpus: str) -> None:
    sinks.write_result(args.output, aggregates=run.aggregates, scores=run.scores, **run.analyses)
    if args.csv:
        sinks.write_csv(run.aggregates, run.scores, args.csv)
    if args.history:
        when = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
        rows = sinks.history_records(run.aggregates, run_id, "1970-01-01", corpus, args.version).withColumn("completed_at", F.to_timestamp(when))
        History(rows.sparkSession, args.history).upsert(rows)


def printed(rows: DataFrame) -> None:
    """All rows, tab by tab; they come from the executors a partition at a time."""
    print(*rows.columns, sep="\t")
    for row in rows.toLocalIterator():
        print(*("" if x is None else x for x in row), sep="\t")


def table_from(spark: SparkSession, path: str | None, columns: str) -> DataFrame | None:
    """A table of JSON lines or Parquet files with the given columns; None without a path."""
    if not path:
        return None
    return spark.read.schema(columns).json(path) if path.rstrip("/").endswith((".json", ".jsonl")) else spark.read.schema(columns).parquet(path)


def run_file(spark: SparkSession, args: argparse.Namespace) -> None:
    spec = runfile.load_run(args.config)
    documents, truths, outputs = runfile.tables(spark, spec)
    if args.resume_dir:
        units = documents.select("doc_id", "image_uri").crossJoin(relational.small(spark.createDataFrame([(p["name"],) for p in spec.pipelines], "pipeline string")))
        units = readers.with_images(spark, units)
        settings = {p["name"]: json.dumps([p, spec.settings], sort_keys=True, default=str) for p in spec.pipelines}
        produce = lambda left: outputs.join(left.select("pipeline", "doc_id"), ["pipeline", "doc_id"], "left_semi")
        outputs = resume.resumed(units, args.resume_dir, produce, args.version, settings)
    kinds = {kind for d in spec.documents for kind, _ in d["truths"]}
    usage = table_from(spark, args.usage, schema.USAGE)
    tariffs = table_from(spark, args.tariffs, "pipeline string, per_million_in double, per_million_out double, per_page double")
    images = table_from(spark, args.images, "doc_id string, pixels array<double>, width int")

    def sink(outputs: DataFrame) -> None:
        plain = documents.select("doc_id", "doc_pos").join(truths.filter("gt_type = 'raw_text'").select("doc_id", F.col("content").alias("ref")), "doc_id")
        sinks.write_jsonl(sinks.system_records(reports.system_texts(plain, outputs), spec.corpus, args.language), args.system_records)

    made = evaluate.run(documents, truths, outputs, spec.views or evaluate.default_views(kinds), usage=usage, tariffs=tariffs, images=images, sink=sink if args.system_records else None)
    write(made, args, spec.run_id, spec.corpus)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="marginalia")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, text in (("run", "evaluate what a run file describes"), ("demo", "evaluate a small built-in corpus")):
        one = commands.add_parser(name, help=text)
        if name == "run":
            one.add_argument("config")
            one.add_argument("--resume-dir", help="store of finished units; those in it are not run again")
            one.add_argument("--system-records", help="folder for the texts of each system as JSON lines")
            one.add_argument("--language", default="fr", help="language named in the system records")
            one.add_argument("--usage", help="seconds and tokens of the units, JSON lines or Parquet")
            one.add_argument("--tariffs", help="prices of the pipelines, JSON lines or Parquet")
            one.add_argument("--images", help="grey images of the documents, Parquet")
        one.add_argument("-o", "--output", required=True, help="folder of the result")
        one.add_argument("--csv", help="folder of the CSV export")
        one.add_argument("--history", help="history to add the run to, in place of an earlier run of its name")
        one.add_argument("--version", default="0", help="version of the code, for the history and for resuming")
    compare = commands.add_parser("compare", help="differences of two results")
    compare.add_argument("a")
    compare.add_argument("b")
    history = commands.add_parser("history", help="series of a pipeline, or what has become worse")
    history.add_argument("path")
    history.add_argument("--view", default="text")
    history.add_argument("--metric", default="cer")
    history.add_argument("--pipeline")
    history.add_argument("--threshold", type=float, default=0.0)
    args = parser.parse_args(argv)

    spark = SparkSession.builder.appName("marginalia").getOrCreate()
    if args.command == "demo":
        usage = spark.createDataFrame([(p, d, *DEMO_USAGE[p]) for d, _, _, each in DEMO for p in each], schema.USAGE)
        tariffs = spark.createDataFrame(list(DEMO_TARIFFS), "pipeline string, per_million_in double, per_million_out double, per_page double")
        write(evaluate.run(*demo_tables(spark), demo_views(), usage=usage, tariffs=tariffs), args, f"demo-{uuid.uuid4().hex[:8]}", "demo")
    elif args.command == "run":
        run_file(spark, args)
    elif args.command == "compare":
        a, b = (readers.read_result(spark, p, "aggregates") for p in (args.a, args.b))
        printed(relational.compare_runs(a, b).orderBy("view", "metric", "pipeline"))
    else:
        rows = readers.read_history(spark, args.path)
        if args.pipeline:
            printed(statistics.history_series(rows, args.pipeline, args.view, args.metric))
        else:
            metric = registry([HCPR]).get(args.metric)
            one = rows.filter((F.col("view") == args.view) & (F.col("metric") == args.metric))
            worse = statistics.last_two(one, ["pipeline"], ["completed_at", "run_id"], threshold=args.threshold, higher_is_better=bool(metric and metric.higher_is_better)).filter("worse")
            printed(worse.orderBy("pipeline"))


if __name__ == "__main__":
    main()
