"""ALTO and PAGE files to flat rows of regions.

Files are read as ``binaryFile``; each becomes an array of regions in depth-first order
with their lines, so the recursive tree is flat from then on. Files with a document type
declaration, and files that do not parse, give null and are counted by the caller.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..schema import LAYOUT_ROW

ROWS = T.ArrayType(LAYOUT_ROW)
DOCTYPE = re.compile(rb"<!doctype", re.IGNORECASE)


def local(node: ET.Element) -> str:
    return node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""


def points(text: str | None) -> list[dict] | None:
    """``x,y x,y`` or ``x y x y`` as whole points, null if malformed."""
    try:
        numbers = [int(float(x)) for x in (text or "").replace(",", " ").split()]
    except (ValueError, OverflowError):
        return None
    if not numbers or len(numbers) % 2:
        return None
    return [{"x": x, "y": y} for x, y in zip(numbers[::2], numbers[1::2], strict=True)]


def whole(text: str | None) -> int | None:
    try:
        return int(float(text))
    except (TypeError, ValueError, OverflowError):
        return None


def _share(text: str | None) -> float | None:
    try:
        return min(max(float(text), 0.0), 1.0)
    except (TypeError, ValueError):
        return None


class _Rows:
    def __init__(self):
        self.rows: list[dict] = []
        self.unnamed = 0

    def add(self, page: tuple, parent: dict | None, region_id: str | None, **values) -> dict:
        if not region_id:
            self.unnamed += 1
            region_id = f"region_{self.unnamed}"
        row = {"page_no": page[0], "page_width": page[1], "page_height": page[2], "region_id": region_id, "parent_id": parent and parent["region_id"], "depth": parent["depth"] + 1 if parent else 0, "dfs_pos": len(self.rows), "leaf": True, "lines": [], "confidences": []} | values
        if parent:
            parent["leaf"] = False
        self.rows.append(row)
        return row


def _alto_line(line: ET.Element, row: dict) -> None:
    words = []
    for s in line:
        if local(s) != "String":
            continue
        half, text = s.get("SUBS_TYPE"), s.get("CONTENT") or ""
        words.append(text)
        sure = _share(s.get("WC"))
        if sure is not None and text and half != "HypPart2":
            row["confidences"].append({"text": text, "confidence": sure})
    row["lines"].append(" ".join(w for w in words if w))


def _alto_block(node: ET.Element, page: tuple, parent: dict | None, out: _Rows) -> None:
    kind = local(node)
    if kind not in ("TextBlock", "ComposedBlock", "Illustration", "GraphicalElement"):
        return
    box = [whole(node.get(k)) for k in ("HPOS", "VPOS", "WIDTH", "HEIGHT")]
    shape = next((points(p.get("POINTS")) for s in node if local(s) == "Shape" for p in s if local(p) == "Polygon"), None)
    bbox = None if None in box else dict(zip(("x", "y", "width", "height"), box, strict=True))
    row = out.add(page, parent, node.get("ID"), region_type=kind, bbox=bbox, polygon=shape)
    for child in node:
        if local(child) == "TextLine":
            _alto_line(child, row)
        else:
            _alto_block(child, page, row, out)


def alto_rows(root: ET.Element) -> list[dict]:
    out = _Rows()
    for n, page in enumerate(x for x in root.iter() if local(x) == "Page"):
        size = (n, whole(page.get("WIDTH")), whole(page.get("HEIGHT")))
        for space in page:
            if local(space) == "PrintSpace":
                for block in space:
                    _alto_block(block, size, None, out)
    return out.rows


def _page_text(node: ET.Element) -> str:
    """The reading with the lowest index, else the words."""
    readings = [(whole(t.get("index")) or 0, n, "".join(u.text or "" for u in t if local(u) == "Unicode")) for n, t in enumerate(c for c in node if local(c) == "TextEquiv")]
    if readings:
        return min(readings)[2]
    return " ".join(t for w in node if local(w) == "Word" if (t := _page_text(w)))


def _page_region(node: ET.Element, page: tuple, parent: dict | None, out: _Rows) -> None:
    shape = next((points(c.get("points")) for c in node if local(c) == "Coords"), None)
    row = out.add(page, parent, node.get("id"), region_type=node.get("type") or local(node), bbox=None, polygon=shape)
    for child in node:
        if local(child) == "TextLine":
            row["lines"].append(_page_text(child))
        elif local(child).endswith("Region"):
            _page_region(child, page, row, out)


def _declared_order(page: ET.Element) -> list[str]:
    """Region ids in reading order: groups by index, depth first."""

    def walk(node: ET.Element) -> list[str]:
        parts = [c for c in node if local(c).startswith(("RegionRef", "OrderedGroup", "UnorderedGroup"))]
        parts.sort(key=lambda c: whole(c.get("index")) or 0)
        return [x for c in parts for x in ([c.get("regionRef")] if local(c).startswith("RegionRef") else walk(c))]

    return [x for order in page if local(order) == "ReadingOrder" for x in walk(order) if x]


def page_rows(root: ET.Element) -> list[dict]:
    """Regions with those of the declared order first, then the rest as they stand."""
    out = _Rows()
    for n, page in enumerate(x for x in root.iter() if local(x) == "Page"):
        size = (n, whole(page.get("imageWidth")), whole(page.get("imageHeight")))
        place = {r: i for i, r in enumerate(_declared_order(page))}
        regions = [c for c in page if local(c).endswith("Region")]
        for region in sorted(regions, key=lambda c: place.get(c.get("id"), len(place))):
            _page_region(region, size, None, out)
    return out.rows


def parse(content: bytes | None) -> list[dict] | None:
    if not content or DOCTYPE.search(content):
        return None
    try:
        root = ET.fromstring(content)
    except ET.ParseError:
        return None
    return (page_rows if local(root).lower() in ("pcgts", "pagecontent") else alto_rows)(root)


@F.arrow_udf(ROWS)
def layout_rows(content: pa.Array) -> pa.Array:
    kind = to_arrow_type(ROWS)
    return pa.array([parse(c) for c in content.to_pylist()], kind)


def regions(files: DataFrame, content: str = "content", *keep: str) -> DataFrame:
    """One row a region of the files that parse."""
    return files.select(*keep, F.inline(layout_rows(F.col(content))))


def text_of(rows: list[dict]) -> str:
    """Text of a layout: lines and sub-regions by newline, top regions by a blank line, empty ones left out."""
    tops: list[list[str]] = []
    for row in rows:
        if not row["depth"]:
            tops.append([])
        tops[-1] += [line for line in row["lines"] if line]
    return "\n\n".join("\n".join(lines) for lines in tops if lines)


@F.arrow_udf(T.StringType())
def layout_text(content: pa.Array) -> pa.Array:
    parsed = (parse(c) for c in content.to_pylist())
    return pa.array([None if rows is None else text_of(rows) for rows in parsed], pa.string())
