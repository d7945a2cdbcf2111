"""License scans: TF-IDF cosine to templates, then inheritance from the nearest directory.

Texts are compared with license templates: sparse vectors of word counts times idf,
cosine. Lines, and runs of consecutive lines of up to ``SPAN`` times the longest notice's
words, are compared with notices, so a notice may be wrapped and have comment marks; the
text as a whole is also compared with the licenses' full texts. idf comes from document
frequencies over the whole corpus. A first pass keeps what could reach the threshold if
its other words had the least idf there is, 1, which loses none over the threshold; then
the frequencies of the kept words are looked up and the cosine is exact.

A file states a license if a run of lines (a header) or the whole text (a licence file)
reaches ``threshold``. A licence file, by its name or by its whole text, speaks for its
directory.
A file that states none inherits from the nearest directory above it that has one: paths
are exploded to their ancestors, joined by equality and the longest wins; a file has few
ancestors, and one row a directory is joined to them.

Defined cases: null or empty text: states nothing, may inherit. Null path: inherits
nothing. Several licenses in a text, or several licence files in a directory: the highest
cosine, then the first name, then the smallest id. Repeated rows: each gets its result.
Very long texts are read whole, in slices of their own. Empty table: no rows. Other columns
are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from functools import cached_property
from math import log, sqrt
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, one_array, slices, split_words, spread_join

THRESHOLD = 0.8
SPAN = 1.5
STRIP = ".,;:!?\"'()[]{}<>|*#%&/\\"
FILE_NAMES = ("license", "licence", "copying", "notice")

# Notices by which licenses are customarily stated, with their identifiers.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "This work is released into the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("proprietary", "All rights reserved."),
)


def full_texts() -> tuple[tuple[str, str], ...]:
    """The full texts of licenses, by identifier."""
    return tuple((p.stem, p.read_text()) for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt")))


def cleaned(word: str) -> str:
    """A word without the marks around it; nothing if only hyphens are left."""
    w = word.lower().strip(STRIP)
    return w if w.strip("-") else ""


def words(text: str) -> list[str]:
    return [w for w in map(cleaned, re.split(r"[ \t-\r]+", text)) if w]


def _tokens(texts) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Text and word number of every token, and the words by number."""
    flat, offsets = split_words(texts)
    coded = flat.dictionary_encode()
    clean = [cleaned(w) for w in coded.dictionary.to_pylist()]
    number = {w: i for i, w in enumerate(dict.fromkeys(w for w in clean if w))}
    word = np.array([number.get(w, -1) for w in clean], np.int64)[coded.indices.to_numpy(zero_copy_only=False)] if clean else np.empty(0, np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    return row[word >= 0], word[word >= 0], list(number)


def _reaching(weights: Weights, row, word, clean: list[str], texts: int, threshold: float, notices: bool) -> np.ndarray:
    """The rows whose cosine to a template (a notice) can reach the threshold, from their tokens."""
    if not len(row):
        return np.empty(0, np.int64)
    numbers, matrix = weights.matrices[notices]
    known = np.array([numbers.get(w, -1) for w in clean])
    idf = np.array([weights.idf.get(w, weights.unseen) for w in clean])
    pairs, n = np.unique(row * len(clean) + word, return_counts=True)
    row, word = pairs // len(clean), pairs % len(clean)
    values = n * idf[word]
    size = np.bincount(row, values**2, texts)
    # a cosine can't be higher than the share of the weight in template words
    may = (np.bincount(row, values**2 * (known[word] >= 0), texts) >= threshold**2 * size - 1e-9) & (size > 0)
    at = np.flatnonzero(may[row] & (known[word] >= 0))
    rows, first = np.unique(row[at], return_index=True)
    if not len(rows):
        return rows
    best = np.zeros(len(rows))
    for lo in range(0, matrix.shape[1], 8):
        dots = np.add.reduceat(values[at, None] * matrix[known[word[at]], lo : lo + 8], first)
        best = np.maximum(best, dots.max(axis=1))
    return rows[best >= threshold * np.sqrt(size[rows]) - 1e-9]


def _may_match(weights: Weights, texts, threshold: float) -> np.ndarray:
    row, word, clean = _tokens(texts)
    return _reaching(weights, row, word, clean, len(texts), threshold, False)


NO_WORDS: Mapping[str, float] = {}


@dataclass(frozen=True)
class Weights:
    """idf of words, and the templates as unit vectors; how many of them, the first, are notices.

    ``counted`` has the document frequencies of all words (word, n) of ``rows`` documents.
    """

    idf: dict[str, float]
    unseen: float
    templates: tuple[tuple[str, dict[str, float]], ...]
    notices: int | None = None
    span: int = 0
    rows: int = 0
    counted: DataFrame | None = field(default=None, compare=False)

    @cached_property
    def matrices(self) -> dict[bool, tuple[dict[str, int], np.ndarray]]:
        """Words by number and their weight in each template: of all, and of the notices."""
        out = {}
        for notices, some in ((False, self.templates), (True, self.templates[: self.notices])):
            numbers = {w: i for i, w in enumerate(sorted({w for _, t in some for w in t}))}
            matrix = np.zeros((len(numbers), len(some)))
            for k, (_, t) in enumerate(some):
                for w, x in t.items():
                    matrix[numbers[w], k] = x
            out[notices] = numbers, matrix
        return out

    @cached_property
    def postings(self) -> dict[str, list[tuple[int, float]]]:
        out = defaultdict(list)
        for k, (_, t) in enumerate(self.templates):
            for w, x in t.items():
                out[w].append((k, x))
        return dict(out)

    def idf_of(self, n: int) -> float:
        return 1 + log((1 + self.rows) / (1 + n))

    def vector(self, tokens: list[str], more: Mapping[str, float] = NO_WORDS) -> dict[str, float]:
        v = {w: n * self.idf.get(w, more.get(w, self.unseen)) for w, n in Counter(tokens).items()}
        size = sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    def best(self, tokens: list[str], more: Mapping[str, float] = NO_WORDS) -> tuple[float, str] | None:
        """The nearest template and its cosine; ``more`` has the idf of words that are in none."""
        scores = [0.0] * len(self.templates)
        for w, x in sorted(self.vector(tokens, more).items()):
            for k, y in self.postings.get(w, ()):
                scores[k] += x * y
        score, name = min((-x, name) for x, (name, _) in zip(scores, self.templates, strict=True))
        return (-score, name)


def fit(docs: DataFrame, templates=TEMPLATES, full=None, *, text_col: str = "text") -> Weights:
    """Document frequencies of all words over all documents, and the templates weighted by them."""
    every = (*templates, *(full_texts() if full is None else full))

    def count(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                row, word, clean = _tokens(part.column("text"))
                n = np.bincount(np.unique(row * len(clean) + word) % len(clean), minlength=len(clean)) if len(row) else []
                yield pa.RecordBatch.from_arrays([pa.array([*clean, None], pa.string()), pa.array([*n, part.num_rows], pa.int64())], names=["word", "n"])

    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = checkpointed(counted)
    vocabulary = sorted({w for _, t in every for w in words(t)})
    df = {r["word"]: r["n"] for r in counted.filter(F.col("word").isNull() | F.col("word").isin(vocabulary)).collect()}
    span = int(SPAN * max((len(words(t)) for _, t in templates), default=0))
    weights = Weights({}, 1.0, (), len(templates), span, df.get(None, 0), counted)
    weights = replace(weights, idf={w: weights.idf_of(df.get(w, 0)) for w in vocabulary})
    return replace(weights, templates=tuple((name, weights.vector(words(t))) for name, t in every))


def _runs(owner: np.ndarray, ends: np.ndarray, known: np.ndarray, span: int):
    """(first line, one after the last) of the runs of lines of one text with at most ``span`` tokens, by number of lines.

    A line without a known word at an end only lowers the cosine, so runs begin and end with one.
    """
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    first = np.flatnonzero(known)
    size = 1
    while len(first):
        last = first + size - 1
        yield first[known[last]], last[known[last]] + 1
        first = first[last + 1 < len(owner)]
        last = first + size
        first = first[(owner[last] == owner[first]) & (ends[last] - starts[first] <= span)]
        size += 1


def candidates(weights: Weights, threshold: float):
    """A scalar function from text to what may reach the threshold: runs of lines, and the whole text."""

    @F.arrow_udf("array<struct<text: string, whole: boolean>>")
    def near(text: pa.Array) -> pa.Array:
        out: list[list[dict]] = []
        for part in slices(pa.table({"t": text}), "t"):
            texts = pc.fill_null(one_array(part.column("t")), "")
            lists = pc.split_pattern(texts, "\n")
            lines, of = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
            kept: list[list[dict]] = [[] for _ in range(len(texts))]
            row, word, clean = _tokens(lines)
            if len(row):
                line, starts = np.unique(row, return_index=True)
                ends, owner = np.append(starts[1:], len(row)), of[line]
                numbers, _ = weights.matrices[True]
                has = np.logical_or.reduceat(np.array([w in numbers for w in clean])[word], starts)
                for a, b in _runs(owner, ends, has, weights.span):
                    lengths = ends[b - 1] - starts[a]
                    at = np.repeat(starts[a] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
                    for k in _reaching(weights, np.repeat(np.arange(len(a)), lengths), word[at], clean, len(a), threshold, True).tolist():
                        kept[owner[a[k]]].append({"text": " ".join(lines[int(x)].as_py() for x in line[a[k] : b[k]]), "whole": False})
                for k in _reaching(weights, of[row], word, clean, len(texts), threshold, False).tolist():
                    kept[k].append({"text": texts[k].as_py(), "whole": True})
            out += kept
        return pa.array(out, pa.list_(pa.struct([("text", pa.string()), ("whole", pa.bool_())])))

    return near


def counted_words(weights: Weights, near: DataFrame) -> DataFrame:
    """(__n, __words): the document frequencies of the words of each row's candidates that no template has.

    Words and frequencies meet by a join, in which common words stay where they are.
    """
    known = frozenset(weights.idf)

    def others(batches):
        for batch in batches:
            rows, found = [], []
            for n, text in zip(batch.column("__n").to_pylist(), batch.column("text").to_pylist(), strict=True):
                new = sorted(set(words(text or "")) - known)
                rows += [n] * len(new)
                found += new
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(found, pa.string())], names=["__n", "word"])

    asked = near.select("__n", F.explode("__near.text").alias("text")).mapInArrow(others, "__n long, word string")
    met = spread_join(checkpointed(asked), weights.counted, "word", "inner")
    return met.groupBy("__n").agg(F.collect_set(F.struct("word", "n")).alias("__words"))


def stated_license(weights: Weights, threshold: float):
    """A scalar function from candidates and their words' frequencies to the license a text states: name, score, and whether the whole text is it."""

    @F.arrow_udf("struct<name: string, score: double, whole: boolean>")
    def state(near: pa.Array, counts: pa.Array) -> pa.Array:
        out = []
        for some, known in zip(near.to_pylist(), counts.to_pylist(), strict=True):
            more = {x["word"]: weights.idf_of(x["n"]) for x in known or ()}
            found = [(*weights.best(words(x["text"]), more), x["whole"]) for x in some or ()]
            found = [(-score, name, whole) for score, name, whole in found if score >= threshold]
            score, name, _ = min(found, default=(None, None, False))
            out.append({"name": name, "score": score and -score, "whole": any(x[2] for x in found)})
        return pa.array(out, pa.struct([("name", pa.string()), ("score", pa.float64()), ("whole", pa.bool_())]))

    return state


def scan_licenses(docs: DataFrame, weights: Weights, *, id_col: str = "doc_id", text_col: str = "text", path: Column, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with ``path``, ``stated``, ``score``, ``license``, ``from_dir`` and ``how`` (own, inherited or none)."""
    local = replace(weights, counted=None)
    near = candidates(local, threshold)(F.col(text_col))
    near = checkpointed(docs.select(id_col, path.alias("__path"), near.alias("__near"), F.monotonically_increasing_id().alias("__n")))
    some = F.size("__near") > 0
    judged = near.filter(some).join(counted_words(weights, near.filter(some)), "__n", "left")
    judged = judged.select(id_col, "__path", stated_license(local, threshold)(F.col("__near"), F.col("__words")).alias("__found"))
    light = checkpointed(judged.unionByName(near.filter(~F.coalesce(some, F.lit(False))).select(id_col, "__path"), allowMissingColumns=True))
    steps = F.split("__path", "/")
    name = F.regexp_extract(F.lower(F.element_at(steps, -1)), r"^[a-z]*", 0)
    speaks = F.col("__found.name").isNotNull() & (F.col("__found.whole") | name.isin(*FILE_NAMES))
    folder = F.array_join(F.slice(steps, 1, F.size(steps) - 1), "/")
    rank = F.struct((-F.col("__found.score")).alias("s"), F.col("__found.name").alias("name"), F.col(id_col).alias("id"))
    speaking = light.filter(speaks).groupBy(folder.alias("dir")).agg(F.min(rank)["name"].alias("name"))
    # only files that state nothing look above them; each folder asks once
    asking = light.filter(F.col("__found.name").isNull() & F.col("__path").isNotNull()).select(folder.alias("folder")).distinct()
    parts = F.split("folder", "/")
    above = asking.withColumn("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))))
    nearest = above.join(speaking, "dir").groupBy("folder").agg(F.max(F.struct(F.length("dir").alias("n"), "dir", "name")).alias("near"))
    got = light.withColumn("folder", folder).join(nearest, "folder", "left")
    own = F.col("__found.name")
    return got.select(
        id_col,
        F.col("__path").alias("path"),
        own.alias("stated"),
        F.col("__found.score").alias("score"),
        F.coalesce(own, F.col("near.name")).alias("license"),
        F.when(own.isNull(), F.col("near.dir")).alias("from_dir"),
        F.when(own.isNotNull(), "own").when(F.col("near.name").isNotNull(), "inherited").otherwise("none").alias("how"),
    )
