"""Writers: results as CSV, JSON and JSON lines, and the run history."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import slug
from ..schema import HISTORY_KEY

#: What the line with a table's columns begins with.
F_SCHEMA = "columns "
CSV_COLUMNS = ("scope", "view", "pipeline", "document_id", "metric", "value", "support")


def result_rows(aggregates: DataFrame, scores: DataFrame) -> DataFrame:
    """Aggregates, then documents, with the columns of the CSV export and ``seq`` for its order."""
    first = aggregates.select(F.lit("aggregate").alias("scope"), "view", "pipeline", F.lit(None).cast("string").alias("document_id"), "metric", "value", F.col("support").cast("long").alias("support"), F.lit(0).alias("seq"), F.lit(0).alias("doc_pos"))
    second = scores.select(F.lit("document").alias("scope"), "view", "pipeline", F.col("doc_id").cast("string").alias("document_id"), "metric", "value", F.col("weight").cast("long").alias("support"), F.lit(1).alias("seq"), "doc_pos")
    return first.unionByName(second)


def write_csv(aggregates: DataFrame, scores: DataFrame, path: str) -> None:
    rows = result_rows(aggregates, scores).orderBy("seq", "view", "pipeline", "doc_pos", "document_id", "metric")
    rows.select(*CSV_COLUMNS).write.mode("overwrite").csv(path, header=True, nullValue="")


def system_records(triples: DataFrame, corpus: str, language: str) -> DataFrame:
    """(pipeline, doc_id, json) of documents with a reference; a missing output is the empty text, the system's is the corrected or else the raw."""
    rows = triples.filter("ref is not null")
    text = lambda c: F.struct(F.coalesce(c, F.lit("")).alias("transcription_unit"))
    record = F.struct(
        F.struct(F.lit(corpus).alias("corpus"), F.col("doc_id").cast("string").alias("document_id"), F.lit(language).alias("language")).alias("document_metadata"),
        text(F.col("ref")).alias("ground_truth"),
        text(F.col("raw")).alias("ocr_hypothesis"),
        text(F.coalesce("corrected", "raw")).alias("ocr_postcorrection_output"),
    )
    return rows.select("pipeline", "doc_id", "doc_pos", F.to_json(record).alias("json"))


def write_jsonl(records: DataFrame, path: str) -> None:
    """A folder for each pipeline, whose files are in order of documents; a pipeline may be many tasks."""
    named = records.withColumn("pipeline", slug(F.col("pipeline")))
    named.repartitionByRange("pipeline", "doc_pos").sortWithinPartitions("pipeline", "doc_pos").select("pipeline", "json").write.mode("overwrite").partitionBy("pipeline").text(path)


def history_records(aggregates: DataFrame, run_id: str, completed_at: str, corpus: str, code_version: str) -> DataFrame:
    rows = aggregates.filter("value is not null")
    given = [F.lit(run_id).alias("run_id"), F.to_timestamp(F.lit(completed_at)).alias("completed_at"), F.lit(corpus).alias("corpus"), F.lit(code_version).alias("code_version")]
    return rows.select(*given, "pipeline", "view", "metric", "value")


def upserted(history: DataFrame, new: DataFrame, key=HISTORY_KEY) -> DataFrame:
    """The history with new records in place of those with the same key."""
    return history.join(new.select(*key), list(key), "left_anti").unionByName(new)


def write_result(path: str, **tables: DataFrame) -> None:
    """A folder of JSON lines, one for each row of each table, in order of kind and row, and one a table with its columns."""
    columns = [(kind, 2, f"{F_SCHEMA}{json.dumps([[f.name, f.dataType.simpleString()] for f in df.schema])}") for kind, df in sorted(tables.items())]
    rows = result_json(**tables)
    every = rows.unionByName(rows.sparkSession.createDataFrame(columns, "kind string, schema_version int, json string"))
    every.orderBy("kind", "json").select(F.to_json(F.struct("kind", "schema_version", "json")).alias("value")).write.mode("overwrite").text(path)


def result_json(**tables: DataFrame) -> DataFrame:
    """(kind, json): the rows of each table as JSON, schema version 2."""
    parts = [df.select(F.lit(kind).alias("kind"), F.lit(2).alias("schema_version"), F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("json")) for kind, df in sorted(tables.items())]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
