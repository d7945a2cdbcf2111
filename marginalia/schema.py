"""Schemas of the tables an evaluation reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

DOCUMENTS = "doc_id string, doc_pos int, stratum string, image_uri string, metadata map<string,string>"
GROUND_TRUTH = "doc_id string, gt_type string, content string"
OUTPUTS = "pipeline string, doc_id string, artifact_type string, content string"
PAIRS = "view string, pipeline string, doc_id string, doc_pos int, stratum string, ref string, hyp string"
SCORES = "view string, pipeline string, doc_id string, doc_pos int, metric string, value double, weight long"
USAGE = "pipeline string, doc_id string, duration_seconds double, tokens_in long, tokens_out long"
HISTORY = "run_id string, completed_at timestamp, corpus string, code_version string, pipeline string, view string, metric string, value double"
HISTORY_KEY = ("run_id", "pipeline", "view", "metric")
TOKENS = "array<struct<text:string,confidence:double>>"

ARTIFACT_TYPES = ("image", "raw_text", "corrected_text", "reference_text", "alto", "pagexml", "layout", "entities", "alignment", "readability", "confidences", "usage")
TEXT_TYPES = ("raw_text", "corrected_text")

POINT = T.StructType([T.StructField(n, T.LongType()) for n in ("x", "y")])
BOX = T.StructType([T.StructField(n, T.LongType()) for n in ("x", "y", "width", "height")])
LAYOUT_ROW = T.StructType(
    [
        T.StructField("page_no", T.IntegerType()),
        T.StructField("page_width", T.LongType()),
        T.StructField("page_height", T.LongType()),
        T.StructField("region_id", T.StringType()),
        T.StructField("parent_id", T.StringType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("dfs_pos", T.IntegerType()),
        T.StructField("leaf", T.BooleanType()),
        T.StructField("region_type", T.StringType()),
        T.StructField("bbox", BOX),
        T.StructField("polygon", T.ArrayType(POINT)),
        T.StructField("lines", T.ArrayType(T.StringType())),
        T.StructField("confidences", T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("confidence", T.DoubleType())]))),
    ]
)
