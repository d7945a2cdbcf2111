"""Document metrics: (ref, hyp) to a value and a weight.

A metric is a pair of columns over ``ref``, ``hyp`` and, where a path through the edit
matrix is needed, two structs that one Arrow function each computes for a batch of pairs:
``chars`` and ``words``, which hold what the chosen metrics read. Distances alone use the built-in. A value is null where the
metric does not apply; a weight is what the value is a share of.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from ..functions import fixed_values as fixed
from ..functions import batch_align, scanners, word_index
from ..functions.normalize import PROFILES
from ..functions.text import safe_ratio

#: What the structs hold, by what a metric reads of them.
PARTS = {
    "chars": ("h", "s", "d", "i"),
    "marks": ("marks", "marks_kept"),
    "glyphs": ("glyphs", "glyphs_kept"),
    "archaic": ("archaic", "archaic_kept", "archaic_out", "archaic_true"),
    "grams": ("grams", "grams_new"),
    "words": ("h", "s", "d", "i"),
    "found": ("found",),
}
SEQUENCES = "total long, strict long, value long"


def _flagged(items: np.ndarray, wanted: Callable[[str], bool]) -> np.ndarray:
    """Which characters are wanted; each different one is looked at once."""
    different, place = np.unique(items, return_inverse=True)
    return np.fromiter((wanted(chr(c)) for c in different), bool, len(different))[place]


def _by_text(starts: np.ndarray, flags: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(flags)))
    return sums[starts[1:]] - sums[starts[:-1]]


def char_measures(refs: list[str], hyps: list[str], parts: Iterable[str], archaic: frozenset[str] = frozenset()) -> list[np.ndarray]:
    """The columns of ``parts`` of all pairs, from one alignment of the whole batch."""
    parts = list(parts)
    other = [n for n, (a, b) in enumerate(zip(refs, hyps, strict=True)) if a != b]
    if len(other) < len(refs) and set(parts) <= {"chars", "grams"}:
        # of equal texts nothing is to be found
        sizes = np.fromiter(map(len, refs), np.int64, len(refs))
        whole = {"h": sizes, "grams": np.maximum(sizes - 2, 0)}
        out = [whole[c].copy() if c in whole else np.zeros(len(refs), np.int64) for p in parts for c in PARTS[p]]
        for column, found in zip(out, char_measures([refs[n] for n in other], [hyps[n] for n in other], parts) if other else (), strict=False):
            column[other] = found
        return out
    pairs, out = batch_align.Pairs(refs, hyps), []
    steps = batch_align.edits(pairs) if set(parts) - {"grams"} else None
    kept = cache(lambda side: steps.kept(side))

    def share(side: int, wanted: Callable[[str], bool]) -> list[np.ndarray]:
        flags = _flagged(pairs.items[side], wanted)
        return [_by_text(pairs.starts[side], flags), _by_text(pairs.starts[side], flags & kept(side))]

    for part in parts:
        if part == "chars":
            out += list(steps.counts().T)
        elif part == "marks":
            out += share(0, scanners.is_diacritic_target)
        elif part == "glyphs":
            out += share(0, scanners.is_medieval_glyph)
        elif part == "archaic":
            out += share(0, archaic.__contains__) + share(1, archaic.__contains__)
        elif part == "grams":
            out += batch_align.new_grams(pairs, steps)
    return out


def word_edits(left: list[list[str]], right: list[list[str]]) -> np.ndarray:
    """Hits, substitutions, deletions and insertions of all pairs, as columns.

    Lists of one length take as many edits as they have places that differ, if none of the
    words there is on both sides; only the others are aligned.
    """
    out, others = np.zeros((4, len(left)), np.int64), []
    for n, (a, b) in enumerate(zip(left, right, strict=True)):
        if a == b:
            out[0, n] = len(a)
            continue
        if len(a) == len(b):
            off = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
            if {x for x, _ in off}.isdisjoint([y for _, y in off]):
                out[:2, n] = len(a) - len(off), len(off)
                continue
        others.append(n)
    if others:
        out[:, others] = batch_align.edits(batch_align.Pairs(*([side[n] for n in others] for side in (left, right)))).counts().T
    return out


def word_measures(refs: list[str], hyps: list[str], parts: Iterable[str]) -> list:
    """The columns of ``parts`` of all pairs, and the number of words of the reference."""
    # engines mostly share a reference
    split = cache(str.split)
    left = [split(t) for t in refs]
    right = [x if a == b else b.split() for x, a, b in zip(left, refs, hyps, strict=True)]
    out: list = []
    for part in parts:
        if part == "words":
            out += list(word_edits(left, right))
        elif part == "found":
            out.append(word_index.found_words(left, right))
    return [*out, [len(x) for x in left]]


def nfc_measures(refs: list[str], hyps: list[str], shared: bool = False) -> list[list[int | None]]:
    """Least edits of the composed texts, a long s read as s, and the length of the reference.

    ``shared``: nothing of texts in printable ASCII, which are composed as they are.
    """
    out: list[list[int | None]] = [[None] * len(refs) for _ in range(2)]
    some = [n for n, (a, b) in enumerate(zip(refs, hyps, strict=True)) if not (shared and all(t.isascii() and t.isprintable() for t in (a, b)))]
    left, right = ([PROFILES["nfc"].apply(side[n]).replace("ſ", "s") for n in some] for side in (refs, hyps))
    for n, a, edits in zip(some, left, batch_align.distances(batch_align.Pairs(left, right)).tolist() if some else (), strict=True):
        out[0][n], out[1][n] = edits, len(a)
    return out


def _sequence_row(ref: str, hyp: str) -> tuple:
    rows = scanners.sequence_counts(ref, hyp)
    return tuple(sum(r[k] for r in rows) for k in ("n_total", "n_strict", "n_value"))


#: Bytes of text that are aligned together.
TOGETHER = 2_000_000


def by_slices(rows: Callable[..., pa.Array], *columns: pa.Array, size: int = TOGETHER) -> pa.Array:
    """``rows`` of the values where no column is null, a slice of about ``size`` bytes at a time; null elsewhere."""
    there, sizes = np.ones(len(columns[0]), bool), np.zeros(len(columns[0]), np.int64)
    for c in columns:
        there &= np.asarray(c.is_valid())
        sizes += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    columns, ends, out, start = [c.filter(pa.array(there)) for c in columns], np.cumsum(sizes[there]), [], 0
    while start < len(ends) or not out:
        stop = max(start + 1, int(np.searchsorted(ends, size + (ends[start - 1] if start else 0), side="right")))
        out.append(rows(*(c.slice(start, stop - start).to_pylist() for c in columns)))
        start = stop
    return pa.concat_arrays(out).take(pa.array(np.cumsum(there) - 1, pa.int64(), mask=~there))


def text_slices(batch: pa.RecordBatch, size: int = TOGETHER) -> Iterable[list[list]]:
    """The columns of a batch of strings as lists, about ``size`` bytes at a time."""
    ends = np.cumsum(sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns))
    start = 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, size + (ends[start - 1] if start else 0), side="right")))
        yield [c.slice(start, stop - start).to_pylist() for c in batch.columns]
        start = stop


def batch_function(measures: Callable[[list[str], list[str]], list], names: Sequence[str]):
    """An Arrow function over (ref, hyp) whose struct's columns are found for a whole batch; null if either text is."""
    kind = pa.struct([(n, pa.int64()) for n in names])

    @F.arrow_udf(from_arrow_type(kind))
    def measure(ref: pa.Array, hyp: pa.Array) -> pa.Array:
        def rows(refs: list[str], hyps: list[str]) -> pa.Array:
            columns = measures(refs, hyps) if refs else [[]] * len(names)
            return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=list(kind))

        return by_slices(rows, ref, hyp)

    return measure


def pair_function(row: Callable[[str, str], tuple], schema: str):
    """The same by a function of one pair."""
    names = [part.split()[0] for part in schema.split(", ")]
    return batch_function(lambda a, b: list(zip(*map(row, a, b), strict=True)), names)


def list_function(rows: Callable[[str, str], Iterable[dict]], kind: pa.DataType):
    """An Arrow function over (ref, hyp) that returns an array of structs, to be exploded."""
    return batch_list_function(lambda a, b: map(rows, a, b), kind)


def batch_list_function(rows: Callable[[list[str], list[str]], Iterable[Iterable[dict]]], kind: pa.DataType):
    """The same by a function of all pairs of a batch."""

    @F.arrow_udf(from_arrow_type(pa.list_(kind)))
    def measure(ref: pa.Array, hyp: pa.Array) -> pa.Array:
        return by_slices(lambda refs, hyps: pa.array([list(x) for x in rows(refs, hyps)], pa.list_(kind)), ref, hyp)

    return measure


@dataclass(frozen=True)
class Metric:
    name: str
    higher_is_better: bool
    needs: str
    value: Callable[[], Column]
    weight: Callable[[], Column]
    inputs: tuple[str, str] = ("raw_text", "raw_text")
    description: str = ""


def _share(part: str, whole: str, turned: bool = False):
    """part / whole, or what is missing of it; null if there is nothing to share."""
    a, b = F.col(part), F.col(whole)
    return safe_ratio(b - a if turned else a, b)


def _edit_rate(edits: Column, length: Column) -> Column:
    return F.when(length > 0, edits / length).when(edits == 0, 0.0).when(edits > 0, 1.0)


#: Cells of a distance matrix, in a band, up to which the built-in is quicker than wavefronts.
BAND_CELLS = 2_000


@F.arrow_udf(from_arrow_type(pa.int64()))
def batch_distance(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    return by_slices(lambda a, b: pa.array(batch_align.distances(batch_align.Pairs(a, b)), pa.int64()), ref, hyp, size=3 * TOGETHER)


def with_distance(rows: DataFrame, name: str, ref: Column, hyp: Column) -> DataFrame:
    """Adds the least edits between two texts.

    Equal texts take none. Short ones are left to the built-in, in a band about the diagonal
    as wide as one edit in sixteen characters; all others, and those further apart, go
    through the wavefronts of a batch.
    """
    band = (F.length(ref) / 16).cast("int") + 8
    fits = F.length(ref).cast("long") * (2 * band + 1) <= BAND_CELLS
    near = F.when(ref == hyp, 0).when(fits, F.call_function("levenshtein", ref, hyp, band))
    rows = rows.withColumns({"__near": near, "__ref": ref, "__hyp": hyp})
    far = F.col("__near").isNull() | (F.col("__near") < 0)
    rows = rows.withColumn(name, F.coalesce(F.when(~far, F.col("__near").cast("long")), batch_distance(F.when(far, F.col("__ref")), F.when(far, F.col("__hyp")))))
    return rows.drop("__near", "__ref", "__hyp")


def _rate(part: Callable[[], Column], whole: Callable[[], Column]):
    """part / whole; with nothing on the reference side 0 or 1."""
    return lambda: F.when(whole() > 0, part() / whole()).when(part() == 0, 0.0).when(part() > 0, 1.0)


_word_edits = lambda: F.col("words.s") + F.col("words.d") + F.col("words.i")
_word_total = lambda: F.col("words.h") + _word_edits()
_char_edits = lambda: F.col("chars.s") + F.col("chars.d") + F.col("chars.i")
_char_total = lambda: F.col("chars.h") + _char_edits()
_col = lambda name: lambda: F.col(name)


#: Registered by default; hcpr is there on request.
METRICS = {
    m.name: m
    for m in (
        Metric("cer", False, "edits", lambda: _edit_rate(F.col("edits"), F.length("ref")), lambda: F.length("ref")),
        Metric("cer_diplo", False, "nfc", lambda: _edit_rate(F.col("edits_nfc"), F.col("length_nfc")), lambda: F.col("length_nfc")),
        Metric("wer", False, "words", _rate(_word_edits, _col("words.n")), _col("words.n")),
        Metric("mer", False, "words", lambda: F.coalesce(safe_ratio(_word_edits(), _word_total()), F.when(_word_total() == 0, 0.0)), _word_total),
        Metric("del_rate", False, "words", _rate(_col("words.d"), _col("words.n")), _col("words.n")),
        Metric("ins_rate", False, "words", _rate(_col("words.i"), _col("words.n")), _col("words.n")),
        Metric("cmer", False, "chars", lambda: F.coalesce(safe_ratio(_char_edits(), _char_total()), F.when(_char_total() == 0, 0.0)), _char_total),
        Metric("diacritic_err", False, "marks", lambda: _share("chars.marks_kept", "chars.marks", True), _col("chars.marks")),
        Metric("mufi_err", False, "glyphs", lambda: _share("chars.glyphs_kept", "chars.glyphs", True), _col("chars.glyphs")),
        Metric("air", False, "archaic", lambda: _share("chars.archaic_true", "chars.archaic_out", True), _col("chars.archaic_out")),
        Metric("searchability", True, "found", lambda: _share("words.found", "words.n"), _col("words.n")),
        Metric("hallucination", False, "grams", lambda: _share("chars.grams_new", "chars.grams"), _col("chars.grams")),
        Metric("numseq_strict", True, "seqs", lambda: _share("seqs.strict", "seqs.total"), _col("seqs.total")),
        Metric("numseq_value", True, "seqs", lambda: _share("seqs.value", "seqs.total"), _col("seqs.total")),
    )
}
HCPR = Metric("hcpr", True, "archaic", lambda: _share("chars.archaic_kept", "chars.archaic"), _col("chars.archaic"))
METRIC_PROFILES = {
    "standard": ("cer", "wer", "mer", "searchability", "hallucination", "air"),
    "essentiel": ("cer", "wer", "mer"),
    "philologie": ("cer", "cer_diplo", "mer", "diacritic_err", "mufi_err", "air"),
}


def registry(extra: Iterable[Metric] = ()) -> dict[str, Metric]:
    """The default metrics with others added or in their place; a new mapping each time."""
    return METRICS | {m.name: m for m in extra}


def for_input_types(reference: str, hypothesis: str, metrics: dict[str, Metric] | None = None) -> list[Metric]:
    """The metrics that compare artifacts of these types, in order of name."""
    return [m for _, m in sorted((METRICS if metrics is None else metrics).items()) if m.inputs == (reference, hypothesis)]


def chosen(names: Iterable[str], metrics: dict[str, Metric] | None = None) -> list[Metric]:
    metrics = METRICS if metrics is None else metrics
    if unknown := [n for n in names if n not in metrics]:
        raise KeyError(f"unknown metrics: {unknown}")
    return [metrics[n] for n in dict.fromkeys(names)]


def measured(pairs: DataFrame, needs: set[str], archaic: str = fixed.ARCHAIC_CORE) -> DataFrame:
    """The pairs with the structs that the metrics need, each computed once."""
    signs, texts = frozenset(archaic), (F.col("ref"), F.col("hyp"))
    if parts := [p for p in ("chars", "marks", "glyphs", "archaic", "grams") if p in needs]:
        pairs = pairs.withColumn("chars", batch_function(lambda a, b: char_measures(a, b, parts, signs), [c for p in parts for c in PARTS[p]])(*texts))
    if words := [p for p in ("words", "found") if p in needs]:
        pairs = pairs.withColumn("words", batch_function(lambda a, b: word_measures(a, b, words), [*[c for p in words for c in PARTS[p]], "n"])(*texts))
    if "seqs" in needs:
        pairs = pairs.withColumn("seqs", pair_function(_sequence_row, SEQUENCES)(F.col("ref"), F.col("hyp")))
    if "chars" in needs:
        pairs = pairs.withColumn("edits", _char_edits())
    elif "edits" in needs:
        pairs = with_distance(pairs, "edits", *texts)
    if "nfc" in needs:
        shared = "edits" in pairs.columns
        pairs = pairs.withColumn("nfc", batch_function(lambda a, b: nfc_measures(a, b, shared), ["edits", "length"])(*texts))
        plain = [F.col("edits"), F.length("ref")] if shared else []
        pairs = pairs.withColumns({"edits_nfc": F.coalesce("nfc.edits", *plain[:1]), "length_nfc": F.coalesce("nfc.length", *plain[1:])}).drop("nfc")
    return pairs


def score(pairs: DataFrame, names: Iterable[str], metrics: dict[str, Metric] | None = None, archaic: str = fixed.ARCHAIC_CORE) -> DataFrame:
    """The fact table: a row for each pair and metric with value and weight, null where it does not apply."""
    wanted = chosen(names, metrics)
    kept = [c for c in pairs.columns if c not in ("ref", "hyp")]
    wide = measured(pairs, {m.needs for m in wanted}, archaic)
    both = F.col("ref").isNotNull() & F.col("hyp").isNotNull()
    one = [F.struct(F.lit(m.name).alias("metric"), F.when(both, m.value()).cast("double").alias("value"), F.when(both & m.value().isNotNull(), m.weight()).cast("long").alias("weight")) for m in wanted]
    return wide.select(*kept, F.inline(F.array(*one)))
