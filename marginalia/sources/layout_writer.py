"""ALTO and PAGE files from layout rows: the other way round from ``xml_layout``.

A document's rows are its regions in depth-first order; what the reader takes from a file
the writer puts back, so reading what was written gives the same rows (points and boxes of
whole numbers, confidences of ALTO words).
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import LAYOUT_ROW

# Name spaces of the formats; ALTO also goes without one.
ALTO = {"v2": "http://www.loc.gov/standards/alto/ns-v2#", "v3": "http://www.loc.gov/standards/alto/ns-v3#", "v4": "http://www.loc.gov/standards/alto/ns-v4#", "none": None}
PAGE = "http://schema.primaresearch.org/PAGE/gts/pagecontent/2019-07-15"


def _points(polygon: list[dict], between: str, inside: str) -> str:
    return between.join(f"{p['x']}{inside}{p['y']}" for p in polygon)


def _pages(rows: list[dict]) -> list[list[dict]]:
    pages: dict[int, list[dict]] = {}
    for row in sorted(rows, key=lambda r: r["dfs_pos"]):
        pages.setdefault(row["page_no"], []).append(row)
    return [pages[n] for n in sorted(pages)]


def _sized(node: ET.Element, row: dict, width: str, height: str) -> None:
    for name, value in ((width, row["page_width"]), (height, row["page_height"])):
        if value is not None:
            node.set(name, str(value))


def alto_text(rows: list[dict], version: str = "v4", unit: str | None = None) -> str:
    """Canonical XML of a version of ALTO; ``unit`` names what positions are measured in."""
    if version not in ALTO:
        raise ValueError(f"ALTO has the versions {', '.join(ALTO)}, not {version!r}")
    root = ET.Element("alto", {"xmlns": ALTO[version]} if ALTO[version] else {})
    if unit is not None:
        ET.SubElement(ET.SubElement(root, "Description"), "MeasurementUnit").text = unit
    layout = ET.SubElement(root, "Layout")
    for n, page_rows in enumerate(_pages(rows), 1):
        page = ET.SubElement(layout, "Page", ID=f"page_{n}")
        _sized(page, page_rows[0], "WIDTH", "HEIGHT")
        nodes = {None: ET.SubElement(page, "PrintSpace")}
        for row in page_rows:
            kind = row["region_type"] if row["region_type"] in ("TextBlock", "ComposedBlock", "Illustration", "GraphicalElement") else "TextBlock" if row["lines"] or row["leaf"] else "ComposedBlock"
            node = nodes[row["region_id"]] = ET.SubElement(nodes[row["parent_id"]], kind, ID=row["region_id"])
            if box := row["bbox"]:
                for name, key in (("HPOS", "x"), ("VPOS", "y"), ("WIDTH", "width"), ("HEIGHT", "height")):
                    node.set(name, str(box[key]))
            if row["polygon"]:
                ET.SubElement(ET.SubElement(node, "Shape"), "Polygon", POINTS=_points(row["polygon"], " ", ","))
            sure = list(row["confidences"] or ())
            for line in row["lines"] or ():
                text = ET.SubElement(node, "TextLine")
                for word in line.split(" ") if line else ():
                    string = ET.SubElement(text, "String", CONTENT=word)
                    if sure and sure[0]["text"] == word:
                        string.set("WC", repr(sure.pop(0)["confidence"]))
    return ET.canonicalize(ET.tostring(root, encoding="unicode"))


def page_text(rows: list[dict], namespace: str = PAGE) -> str:
    """Canonical XML of PAGE in a name space."""
    root = ET.Element("PcGts", xmlns=namespace)
    for page_rows in _pages(rows):
        page = ET.SubElement(root, "Page")
        _sized(page, page_rows[0], "imageWidth", "imageHeight")
        tops = [r for r in page_rows if r["parent_id"] is None]
        order = ET.SubElement(ET.SubElement(page, "ReadingOrder"), "OrderedGroup", id="order")
        for n, row in enumerate(tops):
            ET.SubElement(order, "RegionRefIndexed", index=str(n), regionRef=row["region_id"])
        nodes = {None: page}
        for row in page_rows:
            kind = row["region_type"] or "TextRegion"
            region = kind.endswith("Region")
            node = nodes[row["region_id"]] = ET.SubElement(nodes[row["parent_id"]], kind if region else "TextRegion", id=row["region_id"])
            if not region:
                node.set("type", kind)
            points = row["polygon"] or [{"x": b["x"] + w, "y": b["y"] + h} for b in [row["bbox"]] if b for w, h in ((0, 0), (b["width"], 0), (b["width"], b["height"]), (0, b["height"]))]
            if points:
                ET.SubElement(node, "Coords", points=_points(points, " ", ","))
            for line in row["lines"] or ():
                equivalent = ET.SubElement(ET.SubElement(node, "TextLine"), "TextEquiv")
                ET.SubElement(equivalent, "Unicode").text = line
    return ET.canonicalize(ET.tostring(root, encoding="unicode"))


def layout_writer(write: Callable[..., str], **settings):
    """An Arrow function from layout rows to a file's text by ``alto_text`` or ``page_text`` with their settings."""

    @F.arrow_udf(T.StringType())
    def text(rows: pa.Array) -> pa.Array:
        return pa.array([None if r is None else write(r, **settings) for r in rows.to_pylist()], pa.string())

    return text


alto_column, page_column = layout_writer(alto_text), layout_writer(page_text)


def gathered(regions: DataFrame, *by: str) -> DataFrame:
    """One row a document with its layout rows, ``rows``; a document's regions are few."""
    return regions.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("dfs_pos", F.struct(*[f.name for f in LAYOUT_ROW.fields]).alias("r")))).alias("__s")).select(*by, F.transform("__s", lambda x: x["r"]).alias("rows"))


def with_texts(regions: DataFrame, texts: DataFrame, *by: str) -> DataFrame:
    """Layout rows with the lines of the texts (by, region_id, text); a region without one keeps its own."""
    lines: Column = F.split("text", "\n")
    out = regions.join(texts.select(*by, "region_id", "text"), [*by, "region_id"], "left")
    return out.withColumn("lines", F.when(F.col("text").isNotNull(), lines).otherwise(F.col("lines"))).drop("text")
