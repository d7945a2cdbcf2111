"""Corpora from archives, manifests, catalogues and folders of layouts."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import LAYOUT_ROW
from .readers import IMAGE_ENDINGS, text_files

# Limits of an archive, what it may hold, and how images begin.
ARCHIVE_BYTES, TOTAL_BYTES, FILE_BYTES, ENTRIES = 25 << 20, 200 << 20, 25 << 20, 1000
SUFFIXES = (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".txt", ".xml")
MAGIC = (b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff", b"II*\x00", b"MM\x00*")
SAFE_NAME = re.compile(r"[A-Za-z0-9_.\-]+")
ARK = r"^(?:ark:/)?/*([0-9]+/[A-Za-z0-9_.\-]+)/*$"


def archive_entries(data: bytes) -> list[tuple[str, bytes]] | str:
    """Names and contents of a sound archive, or what is wrong with it."""
    if len(data) > ARCHIVE_BYTES:
        return "too large"
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        return "no archive"
    entries = [e for e in archive.infolist() if not e.is_dir() and "__MACOSX" not in e.filename.split("/") and not e.filename.split("/")[-1].startswith("._")]
    if not entries:
        return "empty"
    if len(entries) > ENTRIES:
        return "too many entries"
    found: dict[str, bytes] = {}
    total = 0
    for e in entries:
        name = e.filename.split("/")[-1]
        if e.filename.startswith("/") or "\\" in e.filename or ".." in e.filename.split("/") or not SAFE_NAME.fullmatch(name):
            return f"unsafe name: {e.filename}"
        if not name.lower().endswith(SUFFIXES):
            return f"not allowed: {name}"
        if name in found:
            return f"twice: {name}"
        with archive.open(e) as source:
            content = source.read(FILE_BYTES + 1)
        total += len(content)
        if len(content) > FILE_BYTES or total > TOTAL_BYTES:
            return f"too large: {name}"
        if name.lower().endswith(IMAGE_ENDINGS) and not content.startswith(MAGIC):
            return f"no image: {name}"
        found[name] = content
    return list(found.items())


def archives(files: DataFrame) -> DataFrame:
    """(path, name, content, problem) of the archives (path, content); one with a problem has one row and no entries.

    An archive is at most ``TOTAL_BYTES`` unpacked, so a task holds one at a time.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                found = archive_entries(data.as_py() or b"")
                rows = [(None, None, found)] if isinstance(found, str) else [(n, c, None) for n, c in found]
                names, contents, problems = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array(names, pa.string()), pa.array(contents, pa.binary()), pa.array(problems, pa.string())], names=["path", "name", "content", "problem"])

    return files.select("path", "content").mapInArrow(unpack, "path string, name string, content binary, problem string")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    return archives(spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path))


def ark_name(ark: Column) -> Column:
    """``authority/name`` of an ARK in any of its forms; null if malformed."""
    return F.nullif(F.regexp_extract(F.trim(ark), ARK, 1), F.lit(""))


def folio_number(image: Column) -> Column:
    """The number in an image's address (``/f12/``), which tells the page; null without one."""
    return F.nullif(F.regexp_extract(image, r"/f(\d+)/", 1), F.lit("")).cast("int")


def imported_pages(pages: DataFrame, gt_type: str = "raw_text", by: tuple[str, ...] = (), limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents ``page_0001`` .. and their references from pages (by, pos, image, and content where there is a text).

    Pages are numbered within the manifest or data set they are from.
    """
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(*by).orderBy("pos"))
    rows = pages.filter("image is not null").withColumn("__n", n)
    rows = rows if limit is None else rows.filter(F.col("__n") <= limit)
    rows = rows.withColumn("doc_id", F.format_string("page_%04d", "__n"))
    documents = rows.select(*by, "doc_id", (F.col("__n") - 1).alias("doc_pos"), F.col("image").alias("image_uri"))
    if "content" not in pages.columns:
        return documents, documents.limit(0).select(*by, "doc_id", F.lit(gt_type).alias("gt_type"), F.lit("").alias("content"))
    return documents, rows.filter("content is not null").select(*by, "doc_id", F.lit(gt_type).alias("gt_type"), "content")


def region_texts(spark: SparkSession, path: str, label: str) -> DataFrame:
    """(doc_id, region_id, text) of the maps ``<document>.<label>.regions.json``; those that don't parse give none."""
    ending = f".{label}.regions.json"
    files = text_files(spark, path).filter(F.col("name").endswith(ending))
    parsed = F.from_json("content", "map<string,string>")
    return files.select(F.expr(f"substr(name, 1, length(name) - {len(ending)})").alias("doc_id"), F.explode(parsed).alias("region_id", "text"))


def precomputed_layouts(spark: SparkSession, path: str) -> DataFrame:
    """Layout rows of the files ``<document>.layout.json``, lists of regions in reading order."""
    files = text_files(spark, path).filter(F.col("name").endswith(".layout.json"))
    rows = F.from_json("content", T.ArrayType(LAYOUT_ROW))
    return files.select(F.expr("substr(name, 1, length(name) - 12)").alias("doc_id"), F.inline(rows))


def chained_pages(starts: DataFrame, pages: DataFrame, most: int = 10_000) -> DataFrame:
    """(start, n, url, content) of the pages (url, content) that follow from each start by their ``next`` links.

    Links to another host end a chain. All chains advance together, a join a step, so the
    steps are the longest chain's pages and at most ``most``.
    """
    host = lambda c: F.regexp_extract(c, r"^[a-z]+://([^/?#]*)", 1)
    known = pages.select("url", "content", F.get_json_object("content", "$.next").alias("next")).dropDuplicates(["url"])
    at = starts.select(F.col("url").alias("start"), "url").join(known, "url").withColumn("n", F.lit(0))
    found = [at]
    while len(found) < most:
        step = found[-1].filter("next is not null").filter(host(F.col("next")) == host(F.col("start"))).select("start", F.col("next").alias("url"), (F.col("n") + 1).alias("n"))
        at = step.join(known, "url").select(*found[0].columns).persist()
        if at.isEmpty():
            break
        found.append(at)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("start", "n", "url", "content")


def layout_json(rows: list[dict]) -> str:
    return json.dumps(rows, ensure_ascii=False)
