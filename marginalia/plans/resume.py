"""Resuming a run: finished units are found by the key of what made them.

A unit is a pipeline's work on one document. ``resumed`` takes what the store has of the
units that are whole and produces only the rest, whose outputs it saves; a run that stops
half-way has lost the units that were not saved, and no others.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.text import canonical_hash
from ..operators.relational import unseen

STORE = "unit_key string, pipeline string, doc_id string, artifact_type string, content string, n_artifacts int"


def unit_keys(units: DataFrame, code_version: str, settings: Mapping[str, str]) -> DataFrame:
    """Units (pipeline, doc_id, image) with ``unit_key``; null where the image can't be read.

    The key is a hash of the code's version, the pipeline's settings (JSON by pipeline), the
    document, and the size and hash of its image; another of any of these is another unit.
    """
    made = F.create_map(*[F.lit(x) for pair in sorted(settings.items()) for x in pair]) if settings else F.create_map().cast("map<string,string>")
    key = canonical_hash(F.lit(code_version).alias("code"), F.col("pipeline").alias("pipeline"), made[F.col("pipeline")].alias("settings"), F.col("doc_id").alias("doc"), F.octet_length("image").alias("size"), F.sha2("image", 256).alias("sha"))
    return units.withColumn("unit_key", F.when(F.col("image").isNotNull(), key))


def save(outputs: DataFrame, path: str) -> None:
    """Appends outputs (unit_key, pipeline, doc_id, artifact_type, content) to the store with how many artifacts their unit has."""
    counted = outputs.groupBy("unit_key").agg(F.count(F.lit(1)).cast("int").alias("n_artifacts"))
    outputs.filter("unit_key is not null").join(counted, "unit_key").select(*[c.split()[0] for c in STORE.split(", ")]).write.mode("append").parquet(path)


def finished(spark: SparkSession, path: str) -> DataFrame:
    """Outputs of the units that are whole: all their artifacts are there and have content."""
    try:
        rows = spark.read.schema(STORE).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], STORE)
    # of a unit that was saved twice the later artifacts are the same ones
    rows = rows.dropDuplicates(["unit_key", "artifact_type"])
    whole = rows.groupBy("unit_key").agg(F.count("content").alias("n"), F.max("n_artifacts").alias("m")).filter("n = m").select("unit_key")
    return rows.join(whole, "unit_key", "left_semi")


def split(units: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outputs of the units that are finished, units still to run)."""
    keys = units.filter("unit_key is not null").select("unit_key").distinct()
    return done.join(keys, "unit_key", "left_semi"), unseen(units, done.select("unit_key").distinct(), ["unit_key"])


def resumed(units: DataFrame, path: str, produce: Callable[[DataFrame], DataFrame], code_version: str, settings: Mapping[str, str]) -> DataFrame:
    """Outputs of the units (pipeline, doc_id, image): stored ones, and those that ``produce`` makes of the others.

    ``produce`` gets the units still to run and returns their outputs (pipeline, doc_id,
    artifact_type, content). Units whose image can't be read are produced each time.
    """
    spark = units.sparkSession
    keyed = unit_keys(units, code_version, settings)
    _, left = split(keyed, finished(spark, path))
    made = produce(left.select(*units.columns)).join(left.select("pipeline", "doc_id", "unit_key"), ["pipeline", "doc_id"])
    names = ["pipeline", "doc_id", "artifact_type", "content"]
    save(made, path)
    done, _ = split(keyed, finished(spark, path))
    # what has no key, or no whole unit in the store, is not there
    loose = made.join(done.select("unit_key").distinct(), "unit_key", "left_anti")
    return done.select(*names).unionByName(loose.select(*names))
