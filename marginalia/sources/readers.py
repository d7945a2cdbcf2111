"""Readers of corpora, outputs, histories and catalogues."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions.text import plain_text
from ..operators.layout import parse_entities
from .history_store import History
from .sinks import F_SCHEMA
from .xml_layout import ROWS, layout_rows, layout_text

#: Folders of one run's images.
MOST_FOLDERS = 10_000
#: Endings of reference files, the first that is there counts.
REFERENCE_ENDINGS = (".gt.txt", ".txt", ".gt.xml", ".xml")
IMAGE_ENDINGS = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".webp")


def _file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, content) of whole files, without byte order marks and with newlines only."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("name"), plain_text(F.col("value")).alias("content"))


def precomputed_outputs(spark: SparkSession, path: str, labels: Iterable[str]) -> DataFrame:
    """Outputs from ``<document>.<label>.txt``."""
    files = text_files(spark, path)
    parts = [files.filter(F.col("name").endswith(f".{label}.txt")).select(F.lit(label).alias("pipeline"), F.expr(f"substr(name, 1, length(name) - {len(label) + 5})").alias("doc_id"), F.lit("raw_text").alias("artifact_type"), "content") for label in labels]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def stem(name: Column, endings: Iterable[str]) -> Column:
    """The name without the longest of the endings it has, null without any."""
    out = F.lit(None).cast("string")
    for ending in sorted(endings, key=len):
        out = F.when(F.lower(name).endswith(ending), F.substring(name, F.lit(1), F.length(name) - len(ending))).otherwise(out)
    return out


def paired_ground_truth(files: DataFrame) -> DataFrame:
    """(doc_id, image, reference): each image with the reference of its stem by priority; without one, null.

    ``files`` has name and content (text; XML is read as layout).
    """
    images = files.withColumn("doc_id", stem(F.col("name"), IMAGE_ENDINGS)).filter("doc_id is not null").select("doc_id", F.col("name").alias("image"))
    given = files.withColumn("doc_id", stem(F.col("name"), REFERENCE_ENDINGS)).filter("doc_id is not null")
    rank = F.lit(len(REFERENCE_ENDINGS))
    for n, ending in reversed(list(enumerate(REFERENCE_ENDINGS))):
        if ending in (".txt", ".xml"):
            longer = f".gt{ending}"
            rank = F.when(F.lower("name").endswith(ending) & ~F.lower("name").endswith(longer), n).otherwise(rank)
        else:
            rank = F.when(F.lower("name").endswith(ending), n).otherwise(rank)
    best = given.groupBy("doc_id").agg(F.min(F.struct(rank.alias("rank"), "name", "content")).alias("b"))
    text = F.when(F.lower("b.name").endswith(".xml"), layout_text(F.encode("b.content", "UTF-8"))).otherwise(F.col("b.content"))
    return images.join(best, "doc_id", "left").select("doc_id", "image", text.alias("reference"))


def confidence_tokens(content: Column) -> Column:
    """Tokens of a JSON list, an empty array if it can't be read."""
    return F.coalesce(F.from_json(content, schema.TOKENS), F.array().cast(schema.TOKENS))


def percent_confidences(tokens: Column) -> Column:
    """Confidences from 0 to 100 as shares; negative ones and blank words are left out."""
    kept = F.filter(tokens, lambda t: (t["confidence"] >= 0) & (F.trim(t["text"]) != ""))
    return F.transform(kept, lambda t: F.struct(t["text"].alias("text"), F.least(t["confidence"] / 100, F.lit(1.0)).alias("confidence")))


def representation(content: Column, kind: Column) -> Column:
    """What an artifact's content is: text, xml, json or entities."""
    text = kind.isin(*schema.TEXT_TYPES, "reference_text")
    return F.when(text, "text").when(kind == "entities", "entities").when(F.ltrim(content).startswith("<"), F.when(F.lower(F.substring(content, 1, 4096)).rlike("pcgts|pagecontent"), "pagexml").otherwise("alto")).otherwise("json")


def represented(content: Column, kind: Column) -> Column:
    """An artifact's content as what it is: ``text``, ``layout`` (rows of regions) or ``entities``; null in the other fields."""
    what, none = representation(content, kind), F.lit(None)
    xml = layout_rows(F.when(what.isin("alto", "pagexml"), F.encode(content, "UTF-8")))
    rows = F.coalesce(xml, F.from_json(F.when(what == "json", content), ROWS))
    return F.struct(F.when(what == "text", content).otherwise(none).alias("text"), rows.alias("layout"), parse_entities(F.when(what == "entities", content)).alias("entities"))


def read_tariffs(spark: SparkSession, path: str) -> DataFrame:
    """Prices (kind, model, paid, valid_until, per_million_in, per_million_out, per_page) from JSON lines of those names; a price of a kind has no model."""
    return spark.read.schema("kind string, model string, paid boolean, valid_until date, per_million_in double, per_million_out double, per_page double").json(path)


def manifest_pages(manifests: DataFrame, content: str = "content", *keep: str) -> DataFrame:
    """Canvases of presentation manifests of either version: position, label and image address; those without one are left out."""
    v = F.try_parse_json(F.col(content))
    three = F.try_variant_get(v, "$.items", "array<variant>")
    two = F.try_variant_get(v, "$.sequences[0].canvases", "array<variant>")
    rows = manifests.select(*keep, F.posexplode(F.coalesce(three, two)).alias("pos", "c"))
    get = lambda *paths: F.coalesce(*[F.try_variant_get("c", p, "string") for p in paths])
    label = get("$.label.none[0]", "$.label.fr[0]", "$.label.en[0]", "$.label")
    image = get("$.items[0].items[0].body.id", "$.images[0].resource['@id']")
    return rows.select(*keep, "pos", label.alias("label"), image.alias("image")).filter("image is not null")


def layer_transcriptions(lines: DataFrame, layer: str, content: str = "content") -> DataFrame:
    """Text of one layer from JSON lines of a transcription service: (doc_id, order, content with ``transcriptions``)."""
    kind = "array<struct<transcription:string,content:string>>"
    chosen = F.filter(F.from_json(F.get_json_object(content, "$.transcriptions"), kind), lambda t: t["transcription"] == layer)
    rows = lines.select("doc_id", "order", F.get(chosen, F.lit(0))["content"].alias("text")).filter("text is not null")
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order", "text"))), lambda x: x["text"]), "\n").alias("content"))


def catalogue_search(own: DataFrame, found: DataFrame, query: str, k: int) -> DataFrame:
    """Entries (id, title, description, languages) that hold the query, curated ones first, each id once."""
    both = own.withColumn("source", F.lit(0)).unionByName(found.withColumn("source", F.lit(1)))
    needle = query.lower()
    holds = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(needle)), F.lit(False))
    kept = both.filter(holds(F.col("title")) | holds(F.col("description")) | holds(F.col("id")) | F.coalesce(F.exists("languages", holds), F.lit(False)))
    first = F.row_number().over(Window.partitionBy("id").orderBy("source", "title"))
    return kept.withColumn("__n", first).filter("__n = 1").drop("__n").orderBy("source", "id").limit(k)


def dataset_pages(spark: SparkSession, path: str, limit: int | None = None, most_bytes: int = 50_000_000) -> DataFrame:
    """Pages (image, ground_truth) of a Parquet data set; its columns must be there, oversize images are left out."""
    pages = spark.read.parquet(path)
    if missing := {"image", "ground_truth"} - set(pages.columns):
        raise ValueError(f"columns missing: {sorted(missing)}")
    pages = pages.filter(F.octet_length("image") <= most_bytes)
    return pages if limit is None else pages.limit(limit)


def with_images(spark: SparkSession, units: DataFrame) -> DataFrame:
    """The units (doc_id, image_uri, ...) with the bytes of their ``image``; null where there is none."""
    folders = [r[0] for r in units.select(F.regexp_extract("image_uri", r"^(.*)/[^/]*$", 1).alias("f")).filter("f <> ''").distinct().limit(MOST_FOLDERS + 1).collect()]
    if len(folders) > MOST_FOLDERS:
        raise ValueError(f"images of a run lie in more than {MOST_FOLDERS} folders")
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    files = spark.createDataFrame([], "file string, image binary")
    if folders:
        images = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{{{','.join(IMAGE_ENDINGS)}}}")
        files = images.load(sorted(folders)).select(plain(F.col("path")).alias("file"), F.col("content").alias("image"))
    return units.withColumn("file", plain(F.col("image_uri"))).join(files, "file", "left").drop("file", "image_uri")


def read_result(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A table of a result that ``write_result`` wrote, with its columns and types."""
    lines = spark.read.text(path).select(F.from_json("value", "kind string, schema_version int, json string").alias("x")).select("x.*").filter(F.col("kind") == kind)
    head = lines.filter(F.col("json").startswith(F_SCHEMA)).select("json", "schema_version").first()
    if head is None:
        raise ValueError(f"no table {kind!r} in {path}")
    columns = ", ".join(f"`{name}` {kind_}" for name, kind_ in json.loads(head["json"].removeprefix(F_SCHEMA)))
    return lines.filter(~F.col("json").startswith(F_SCHEMA)).select(F.from_json("json", columns).alias("r")).select("r.*")


def page_stream(spark: SparkSession, path: str, limit: int | None = None, most_bytes: int = 50_000_000, files_per_batch: int = 10) -> DataFrame:
    """The pages of ``dataset_pages`` as a stream that ends after ``limit`` pages."""
    columns = spark.read.parquet(path).schema
    if missing := {"image", "ground_truth"} - set(columns.names):
        raise ValueError(f"columns missing: {sorted(missing)}")
    pages = spark.readStream.schema(columns).option("maxFilesPerTrigger", files_per_batch).parquet(path).filter(F.octet_length("image") <= most_bytes)
    return pages if limit is None else pages.limit(limit)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The records of a ``History``, or of a plain Parquet folder of them."""
    rows = History(spark, path).latest()
    return spark.read.schema(schema.HISTORY).parquet(path) if rows is None else rows.select(*[c.split()[0] for c in schema.HISTORY.split(", ")])
