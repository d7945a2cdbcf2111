"""Training-corpus pipeline: five stages over ``documents``, each an operator of ``marginalia.llm``.

``STAGES`` lists them as (name, function); a function takes (spark, docs, sf_dir) and
returns the documents its stage keeps, with the columns of ``documents``. ``run`` applies
them in order and writes the result of each as Parquet, which the next one reads; so no
stage is computed twice and a lost executor costs tasks of one stage only. The last stage
returns the mix: its documents with their sizes, the target of their source and the words
taken. What a stage wrote is removed when the next one is written.

Defined cases: a stage that is given an empty table returns one. Documents with null or
empty text are kept until the mix, which takes nothing of them. Repeated rows (same id and
text) are one document from the second stage on. At a tie the least id stays: of equally
near copies, of repeated passages, of rows with one key in the mix (which share what is
left). Very long texts pass whole through every stage. Extra columns are kept up to the
mix, also those named like a column that an operator adds: a stage returns the columns it
was given.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import decontaminate, jaccard_join, mixing, queries, substring_dedup, toxicity
from marginalia.llm.common import checkpointed, read, shared_folder

#: SQL can't express the stages; a test holds the whole against a plain version of each.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of these documents, does not call toxic."""
    model = queries.toxicity_model(spark, docs, sf_dir, False)
    return docs.filter(toxicity.scorer(model)(F.col("text")) < 0.5)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the least id."""
    kept = jaccard_join.jaccard_join(docs.select("doc_id", "text")).filter("kept").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"))
    docs = docs.withColumn("__text_key", jaccard_join.text_key(F.col("text")))
    found = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("__text_key").eqNullSafe(F.col("__key")), "left_semi")
    return found.dropDuplicates(["doc_id", "__text_key"]).drop("__text_key")


def drop_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the runs of 20 words that stand earlier in the corpus; texts without any are unchanged."""
    found = substring_dedup.remove_repeated_spans(docs.select("doc_id", "text", F.struct(*docs.columns).alias("__row")))
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return found.select(*[new.get(c, F.col("__row")[c]).alias(c) for c in docs.columns])


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    found = decontaminate.find_leaks(docs.select("text", F.struct(*docs.columns).alias("__row")), read(spark, sf_dir, "benchmark"))
    return found.filter("contaminated = 0").select("__row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: document, source, sizes, the source's target, words taken."""
    sized = docs.select("doc_id", "lang", "source", mixing.word_count(F.col("text")).alias("size"))
    weighed = checkpointed(queries.with_quality(spark, sized, sf_dir))
    mixed = mixing.mix_sources(weighed, size_col="size", quality=F.col("__quality")).filter("taken > 0")
    return mixed.select("doc_id", "lang", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("substring_dedup", drop_repeated_spans),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("source_mix", mix),
]


def removed(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder, last = read(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for n, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{n}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            removed(spark, last)
        last = path
    return docs
