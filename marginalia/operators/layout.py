"""Regions, boxes, entities and images: what is matched per document in a fixed order."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from ..functions import batch_align
from ..functions.align import DELETE, Block, edit_blocks
from .aggregate import first_samples
from .metrics import TOGETHER, with_distance

IOU = 0.5
BOX = pa.list_(pa.float64())


def relative_box(region: Column, width: Column, height: Column) -> Column:
    """[x0, y0, x1, y1] as shares of the page, from a bbox (x, y, width, height) or else a polygon; null without a page size."""
    box, points = region["bbox"], region["polygon"]
    side = lambda f, k: f(F.transform(points, lambda p: p[k]))
    edges = F.when(box.isNotNull(), F.array(box["x"], box["y"], box["x"] + box["width"], box["y"] + box["height"])).when(F.size(points) > 0, F.array(side(F.array_min, "x"), side(F.array_min, "y"), side(F.array_max, "x"), side(F.array_max, "y")))
    sized = (width > 0) & (height > 0)
    return F.when(sized, F.transform(edges, lambda v, i: v / F.when(i % 2 == 0, width).otherwise(height)))


def box_overlap(a, b) -> float:
    width, height = (min(a[k + 2], b[k + 2]) - max(a[k], b[k]) for k in (0, 1))
    shared = max(0.0, width) * max(0.0, height)
    area = sum((x[2] - x[0]) * (x[3] - x[1]) for x in (a, b)) - shared
    return shared / area if area > 0 else 0.0


def matched_boxes(refs, hyps, least: float = IOU) -> int:
    """Each box of the reference in turn takes the free box that overlaps it most, the later one at a tie."""
    free = dict(enumerate(hyps))
    n = 0
    for ref in refs:
        value, at = max(((box_overlap(ref, h), k) for k, h in free.items()), default=(0.0, -1))
        if at >= 0 and value >= least:
            del free[at]
            n += 1
    return n


@F.arrow_udf(from_arrow_type(pa.int64()))
def box_matches(refs: pa.Array, hyps: pa.Array) -> pa.Array:
    return pa.array([None if a is None else matched_boxes(a, b or []) for a, b in zip(refs.to_pylist(), hyps.to_pylist(), strict=True)], pa.int64())


def region_detection(boxes: DataFrame, by: list[str]) -> DataFrame:
    """F1 of boxes per group from (by, side ref or hyp, pos, box); weight is the number of boxes of the reference."""
    ordered = lambda side: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("pos", "box")))), lambda x: x["box"])
    docs = boxes.filter(F.col("box").isNotNull()).groupBy(*by).agg(ordered("ref").alias("refs"), ordered("hyp").alias("hyps")).filter(F.size("refs") > 0)
    docs = docs.withColumn("tp", box_matches("refs", "hyps"))
    f1 = F.when(F.col("tp") > 0, 2 * F.col("tp") / (F.size("refs") + F.size("hyps"))).otherwise(0.0)
    return docs.select(*by, f1.alias("value"), F.size("refs").cast("long").alias("weight"))


def region_cer(ref: DataFrame, hyp: DataFrame, by: list[str]) -> DataFrame:
    """Edits over characters of the reference's regions by id; a region the other side lacks is all edits."""
    both = ref.select(*by, "region_id", F.col("text").alias("a")).join(hyp.select(*by, "region_id", F.col("text").alias("b")), [*by, "region_id"], "left")
    text = lambda c: F.coalesce(c, F.lit(""))
    out = with_distance(both, "edits", text("a"), text("b")).groupBy(*by).agg(F.sum("edits").alias("edits"), F.sum(F.length(text("a"))).alias("weight"))
    return out.filter("weight > 0").select(*by, (F.col("edits") / F.col("weight")).alias("value"), F.col("weight").cast("long").alias("weight"))


# -- entities --------------------------------------------------------------------------

ENTITIES = "struct<text:string,entities:array<struct<label:string,start:int,end:int,text:string>>>"
KINDS = ("tp", "fp", "fn")
LABEL_COUNTS = pa.struct([("label", pa.string()), *[(k, pa.int64()) for k in KINDS]])
ENTITY_COUNTS = pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string()), ("text", pa.string()), ("start", pa.int64())]))


def parse_entities(content: Column) -> Column:
    """Entities of a JSON object; null for anything else, and for spans that run backwards."""
    parsed = F.from_json(content, ENTITIES)
    sound = F.forall(parsed["entities"], lambda e: (e["start"] >= 0) & (e["start"] <= e["end"]))
    return F.when(F.coalesce(sound, F.lit(False)), parsed)


def position_map(ref: str, hyp: str) -> list[int]:
    """For each place in the hypothesis, and its end, the place in the reference."""
    return _positions(edit_blocks(ref, hyp), len(ref))


def _positions(blocks: list[Block], end: int) -> list[int]:
    out: list[int] = []
    for op, i, i2, j, j2 in blocks:
        if op != DELETE:
            out += [min(i + k, i2) for k in range(j2 - j)]
    return [*out, end]


def _moved(blocks: list[Block], end: int, places: Iterable[int]) -> list[int]:
    """``position_map`` at some places of the hypothesis, the last one for those beyond it."""
    runs = [(j, i, i2) for op, i, i2, j, _ in blocks if op != DELETE]
    starts, size = [j for j, _, _ in runs], blocks[-1][4] if blocks else 0
    out = []
    for place in places:
        if place >= size:
            out.append(end)
        else:
            j, i, i2 = runs[bisect_right(starts, place) - 1]
            out.append(min(i + place - j, i2))
    return out


def entity_outcomes(ref: dict, hyp: dict, least: float = IOU) -> list[dict]:
    """Each entity as found, missed or spurious; spans of the hypothesis are first moved to the reference."""
    return _outcomes(ref, hyp, edit_blocks(ref["text"] or "", hyp["text"] or ""), least)


def _outcomes(ref: dict, hyp: dict, blocks: list[Block], least: float = IOU) -> list[dict]:
    spans = [(e["label"], e["start"], e["end"]) for e in ref["entities"]]
    places = _moved(blocks, len(ref["text"] or ""), [e[k] for e in hyp["entities"] for k in ("start", "end")])
    moved = [(e["label"], a, max(a, b)) for e, a, b in zip(hyp["entities"], places[::2], places[1::2], strict=True)]
    links = []
    # both sides by their starts, so that only spans that overlap are compared
    order = sorted(range(len(moved)), key=lambda j: moved[j][1])
    starts, widest = [moved[j][1] for j in order], max((b - a for _, a, b in moved), default=0)
    for i, (x, a, b) in enumerate(spans):
        for j in order[bisect_left(starts, a - widest) : bisect_right(starts, b)] if least > 0 else range(len(moved)):
            y, c, d = moved[j]
            shared = max(0, min(b, d) - max(a, c))
            union = b - a + d - c - shared
            if x.casefold() == y.casefold() and union > 0 and shared / union >= least:
                links.append((-shared / union, i, j))
    left, right = set(), set()
    for _, i, j in sorted(links):
        if i not in left and j not in right:
            left.add(i)
            right.add(j)
    rows = [{"label": spans[i][0], "kind": "tp" if i in left else "fn", "text": e["text"], "start": e["start"]} for i, e in enumerate(ref["entities"])]
    return rows + [{"label": moved[j][0], "kind": "fp", "text": e["text"], "start": e["start"]} for j, e in enumerate(hyp["entities"]) if j not in right]


def outcomes(refs: list[dict], hyps: list[dict]) -> list[list[dict]]:
    """``entity_outcomes`` of a batch; only pairs with entities on both sides are aligned, all together.

    Spans of a hypothesis meet none where the reference has no entities, and labels stay.
    """
    both = [n for n, (a, b) in enumerate(zip(refs, hyps, strict=True)) if a["entities"] and b["entities"]]
    blocks: list[list[Block]] = [[] for _ in refs]
    for n, found in zip(both, batch_align.edit_blocks([refs[n]["text"] or "" for n in both], [hyps[n]["text"] or "" for n in both]), strict=True):
        blocks[n] = found
    return list(map(_outcomes, refs, hyps, blocks))


def _portions(ref: pa.Array, hyp: pa.Array) -> list[tuple[int, int]]:
    """Ranges of rows whose texts are looked at together."""
    sizes = [pc.fill_null(pc.binary_length(pc.struct_field(c, "text")), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (ref, hyp)]
    return batch_align.portions(sum(sizes) + 1, TOGETHER)


def _by_portions(ref: pa.Array, hyp: pa.Array) -> Iterable[list[dict] | None]:
    none = {"text": "", "entities": []}
    for start, stop in _portions(ref, hyp):
        left, right = (c.slice(start, stop - start).to_pylist() for c in (ref, hyp))
        there = [n for n, a in enumerate(left) if a is not None]
        found = iter(outcomes([left[n] for n in there], [right[n] or none for n in there]))
        yield from (None if a is None else next(found) for a in left)


@F.arrow_udf(from_arrow_type(ENTITY_COUNTS))
def entity_rows(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    return pa.array(list(_by_portions(ref, hyp)), ENTITY_COUNTS)


#: Entities of one side of a pair times those of the other, up to which all are compared at once, and how many of those together.
ALL = 10_000
BESIDE = 1_000_000


class _Spans:
    """Entities of one side of a batch end to end: whose they are, labels as numbers, starts and ends."""

    def __init__(self, side: pa.Array, names: dict[str | None, int]) -> None:
        there, entities = side.is_valid(), pc.struct_field(side, "entities")
        self.texts = pc.fill_null(pc.struct_field(side, "text"), "")
        sizes = pc.fill_null(pc.if_else(there, pc.list_value_length(entities), 0), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        found = entities.filter(pc.and_(there, entities.is_valid())).flatten()
        labels = pc.struct_field(found, "label").dictionary_encode()
        known = np.array([names.setdefault(x, len(names)) for x in labels.dictionary.to_pylist()] + [names.setdefault(None, len(names))], np.int64)
        self.own, self.label = np.repeat(np.arange(len(sizes)), sizes), known[pc.fill_null(labels.indices, -1).to_numpy(zero_copy_only=False)]
        self.start, self.end = (pc.struct_field(found, c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "end"))
        self.sizes, self.first = sizes, np.cumsum(sizes) - sizes

    def moved(self, ref: _Spans) -> None:
        """Puts the starts and ends where they are in the texts of the reference, of pairs with entities on both sides."""
        both = np.flatnonzero((self.sizes > 0) & (ref.sizes > 0))
        left, right = (side.texts.take(pa.array(both)).to_pylist() for side in (ref, self))
        number = np.full(len(self.sizes), -1)
        number[both] = np.arange(len(both))
        mine = np.flatnonzero(number[self.own] >= 0)
        places = [x[mine] for x in (self.start, self.end)]
        own = number[self.own[mine]]
        size, last = (np.fromiter(map(len, side), np.int64, len(both)) for side in (right, left))
        other = np.array([a != b for a, b in zip(left, right, strict=True)], bool)
        out = [np.where(x >= size[own], last[own], x) for x in places]
        if other.any():
            some = np.flatnonzero(other)
            pairs = batch_align.Pairs(*([side[n] for n in some.tolist()] for side in (left, right)))
            steps = batch_align.edits(pairs)
            runs = np.flatnonzero(steps.op != batch_align.DROP)
            begins = pairs.starts[1][steps.pair[runs]] + steps.j[runs]
            number = np.cumsum(other) - 1
            for x, moved in zip(places, out, strict=True):
                at = np.flatnonzero(other[own] & (x < size[own]))
                base = pairs.starts[1][number[own[at]]]
                run = runs[np.searchsorted(begins, base + x[at], side="right") - 1]
                moved[at] = np.minimum(steps.i[run] + x[at] - steps.j[run], steps.i2[run])
        self.start[mine], self.end[mine] = out[0], np.maximum(*out)


def _links(ref: _Spans, hyp: _Spans, fold: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Entities of both sides that are taken for one another: those that share most first, then by place."""
    many, parts, found = ref.sizes * hyp.sizes > ALL, [], []
    each = np.where(many, 0, hyp.sizes)[ref.own]
    for low, high in batch_align.portions(each, BESIDE):
        which, at = batch_align.spans(hyp.first[ref.own[low:high]], each[low:high])
        parts.append((low + which, at))
    for n in np.flatnonzero(many).tolist():
        # of many entities only those whose places overlap are compared
        ours, theirs = (np.arange(side.first[n], side.first[n] + side.sizes[n]) for side in (ref, hyp))
        theirs = theirs[np.argsort(hyp.start[theirs], kind="stable")]
        widest = int((hyp.end - hyp.start)[theirs].max())
        low = np.searchsorted(hyp.start[theirs], ref.start[ours] - widest)
        which, at = batch_align.spans(low, np.maximum(np.searchsorted(hyp.start[theirs], ref.end[ours], side="right") - low, 0))
        parts.append((ours[which], theirs[at]))
    for i, j in parts:
        shared = np.maximum(0, np.minimum(ref.end[i], hyp.end[j]) - np.maximum(ref.start[i], hyp.start[j]))
        union = ref.end[i] - ref.start[i] + hyp.end[j] - hyp.start[j] - shared
        part = shared / np.maximum(union, 1)
        keep = (fold[ref.label[i]] == fold[hyp.label[j]]) & (union > 0) & (part >= least)
        found.append((part[keep], i[keep], j[keep]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    part, i, j = map(np.concatenate, zip(*found, strict=True))
    lone = (np.bincount(i, minlength=len(ref.own))[i] == 1) & (np.bincount(j, minlength=len(hyp.own))[j] == 1)
    rest = np.flatnonzero(~lone)
    rest = rest[np.lexsort((j[rest], i[rest], -part[rest], ref.own[i[rest]]))]
    left, right, taken = set(), set(), []
    for n, x, y in zip(rest.tolist(), i[rest].tolist(), j[rest].tolist(), strict=True):
        if x not in left and y not in right:
            left.add(x)
            right.add(y)
            taken.append(n)
    taken = np.concatenate((np.flatnonzero(lone), np.array(taken, np.int64)))
    return i[taken], j[taken]


def _label_counts(refs: pa.Array, hyps: pa.Array) -> pa.Array:
    """Of each pair a row for each label: its entities found, spurious and missed, as ``outcomes`` has them."""
    there, names = refs.is_valid(), {}
    ref, hyp = (_Spans(pc.if_else(there, side, pa.scalar(None, side.type)), names) for side in (refs, hyps))
    hyp.moved(ref)
    i, j = _links(ref, hyp, _folded(list(names)), IOU)
    wide = max(1, len(names))
    ours, theirs = (side.own * wide + side.label for side in (ref, hyp))
    key, at = np.unique(np.concatenate((ours, theirs)), return_inverse=True)
    ours, theirs = at[: len(ours)], at[len(ours) :]
    count = lambda x: np.bincount(x, minlength=len(key))
    tp = count(ours[i])
    labels = pa.array(list(names), pa.string()).take(pa.array(key % wide))
    counts = {"tp": tp, "fp": count(theirs) - count(theirs[j]), "fn": count(ours) - tp}
    rows = pa.StructArray.from_arrays([labels, *(pa.array(counts[k], pa.int64()) for k in KINDS)], fields=list(LABEL_COUNTS))
    ends = np.concatenate(([0], np.cumsum(np.bincount(key // wide, minlength=len(refs)))))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows, type=pa.list_(LABEL_COUNTS))


def _folded(names: list[str | None]) -> np.ndarray:
    """Labels that differ in case alone have one number."""
    numbers: dict = {}
    return np.array([numbers.setdefault(x if x is None else x.casefold(), len(numbers)) for x in names], np.int64)


@F.arrow_udf(from_arrow_type(pa.list_(LABEL_COUNTS)))
def entity_sums(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    """Entities of each label found, spurious and missed; a row a label, not an entity."""
    parts = [_label_counts(*(c.slice(start, stop - start) for c in (ref, hyp))) for start, stop in _portions(ref, hyp)]
    return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(LABEL_COUNTS))


def entity_counts(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, label, tp, fp, fn) from pairs of entity sets ``ref`` and ``hyp``."""
    rows = pairs.select(*by, F.inline(entity_sums("ref", "hyp")))
    return rows.groupBy(*by, "label").agg(*[F.sum(k).alias(k) for k in KINDS])


def entity_samples(pairs: DataFrame, by: list[str], k: int = 10) -> DataFrame:
    """The first ``k`` missed and spurious entities of each group, by document and place; pairs have ``doc_pos``."""
    rows = pairs.select(*by, "doc_pos", F.inline(entity_rows("ref", "hyp"))).filter("kind <> 'tp'")
    return first_samples(rows, [*by, "kind"], "text", ["doc_pos", "start", "text"], k)


# -- images ----------------------------------------------------------------------------

QUALITY = pa.struct([(n, pa.float64()) for n in ("sharpness", "noise", "contrast", "rotation")])


def image_measures(grey: np.ndarray) -> dict[str, float]:
    """Sharpness, noise and contrast from 0 to 1 and the skew in degrees of a grey image."""
    height, width = grey.shape
    inner = grey
    if min(height, width) >= 3:
        around = grey[:-2, 1:-1] + grey[2:, 1:-1] + grey[1:-1, :-2] + grey[1:-1, 2:]
        inner = around - 4 * grey[1:-1, 1:-1]
    noise = 0.0
    if min(height, width) >= 2:
        noise = float(np.median(np.concatenate([np.abs(np.diff(grey, axis=k)).ravel() for k in (1, 0)])))
    dark, light = np.percentile(grey, (5, 95))
    contrast = float(np.clip((light - dark) / (light + dark), 0, 1)) if light + dark > 0 else 0.0
    return {"sharpness": min(1.0, float(np.var(inner)) / 500), "noise": min(1.0, noise / 30), "contrast": contrast, "rotation": skew(grey)}


def skew(grey: np.ndarray, most: int = 5) -> float:
    """The whole angle at which rows, cut along it, differ most in their sums; the first at a tie."""
    height, width = grey.shape
    if min(height, width) < 20:
        return 0.0
    rows = grey[:: max(1, height // 100)]
    rest = np.cumsum(rows[:, ::-1], axis=1)[:, ::-1]
    at = np.arange(len(rows))
    angles = range(-most, most + 1)
    spread = [float(np.var(rest[at, np.clip(np.round(at * math.tan(math.radians(a))).astype(int), 0, width - 1)])) for a in angles]
    return float(angles[int(np.argmax(spread))])


@F.arrow_udf(from_arrow_type(QUALITY))
def image_quality_struct(pixels: pa.Array, width: pa.Array) -> pa.Array:
    rows = [None if p is None or not w or not p else image_measures(np.array(p, float).reshape(-1, w)) for p, w in zip(pixels.to_pylist(), width.to_pylist(), strict=True)]
    return pa.array(rows, QUALITY)


def image_quality(images: DataFrame, pixels: str = "pixels", width: str = "width") -> DataFrame:
    """Measures, composite and tier of grey images given as rows of pixels from 0 to 255."""
    q = images.withColumn("q", image_quality_struct(pixels, width)).select(*[c for c in images.columns if c != pixels], "q.*").filter("sharpness is not null")
    score = 0.4 * F.col("sharpness") + 0.3 * F.col("contrast") + 0.2 * (1 - F.col("noise")) + 0.1 * F.greatest(F.lit(0.0), 1 - F.abs("rotation") / 10)
    q = q.withColumn("quality", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
    return q.withColumn("tier", F.when(F.col("quality") >= 0.7, "good").when(F.col("quality") >= 0.4, "medium").otherwise("poor"))


def image_summary(measures: DataFrame) -> DataFrame:
    names = ("sharpness", "noise", "contrast", "rotation", "quality")
    return measures.agg(F.count(F.lit(1)).alias("n"), *[F.bround(F.avg(c), 4).alias(c) for c in names], *[F.count_if(F.col("tier") == t).alias(t) for t in ("good", "medium", "poor")])
