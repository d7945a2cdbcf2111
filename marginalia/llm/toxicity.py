"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hash buckets of its words, of neighbouring pairs and
of pairs with one word between; words are lower-cased and stripped of punctuation. FTRL
keeps a rate for each coordinate and L1 leaves few weights, so the model is the list of
buckets that are not 0 and travels with the scoring function.

The model is fitted on a documented sample: of each class at most ``SAMPLE_ROWS`` labelled
documents in hash order of their id, none longer than ``SAMPLE_CHARS`` characters. Scoring
reads every whole text, in a map without a shuffle. One task trains on the sample.

Defined cases: null or empty text: the score of the bias alone. Conflicting labels of a
document: toxic if any says so. No labels: every score is that of the prior of no toxic
document seen (below 0.5). Repeated rows are scored alike. Very long texts are scored
whole, one at a time. Empty table: no rows. Other columns pass through; those named like a
result column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, joined, mixed, slices, split_words

SAMPLE_ROWS = 8_000
SAMPLE_CHARS = 10_000
BUCKETS = 1 << 20
STRIP = ".,;:!?\"'()[]{}<>|*#%&-_/\\"


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram and skip-gram, repeats included."""
    import xxhash

    words, offsets = split_words(texts)
    if not len(words):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    coded = words.dictionary_encode()
    clean = [w.lower().strip(STRIP) for w in coded.dictionary.to_pylist()]
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in clean), U64, len(clean))[coded.indices.to_numpy(zero_copy_only=False)]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    rows, grams = [row], [mixed(h)]
    for gap, salt in ((1, 0x51), (2, 0xA7)):
        same = row[:-gap] == row[gap:]
        rows.append(row[:-gap][same])
        grams.append(joined(h[:-gap][same], h[gap:][same] ^ U64(salt)))
    return np.concatenate(rows), (np.concatenate(grams) % U64(BUCKETS)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    buckets: np.ndarray
    weights: np.ndarray
    bias: float


#: What nothing is learnt from.
NONE = Model(np.empty(0, np.int64), np.empty(0, np.float32), -4.0)


def ftrl(rows: list[np.ndarray], labels: np.ndarray, *, alpha: float = 2.0, beta: float = 1.0, l1: float = 3.0, l2: float = 0.01, epochs: int = 6, seed: int = 5) -> Model:
    """Fit on lists of distinct buckets; the last coordinate is the bias, free of L1."""
    n, z = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    order = np.random.default_rng(seed)
    penalty = np.full(BUCKETS + 1, l1)
    penalty[-1] = 0
    if not len(rows) or not labels.any():
        return NONE

    def weight(at):
        return np.where(np.abs(z[at]) <= penalty[at], 0, -(z[at] - np.sign(z[at]) * penalty[at]) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at = np.append(rows[i], BUCKETS)
            w = weight(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[i]
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    every = weight(np.arange(BUCKETS + 1))
    kept = np.flatnonzero(every[:-1])
    return Model(kept, every[kept].astype(np.float32), float(every[-1]))


def fit(docs: DataFrame, labels: DataFrame, *, learns: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """``learns`` restricts the labels (a condition on the id column)."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    known = known if learns is None else known.filter(learns)
    known = known.groupBy(id_col).agg(F.max(label_col).alias("__label"))
    first = [known.filter(side).orderBy(F.xxhash64(F.col(id_col)), id_col).limit(sample_rows) for side in (F.col("__label") > 0, F.col("__label") <= 0)]
    # at most 2 * sample_rows pairs of numbers are broadcast
    rows = docs.select(id_col, text_col).filter(F.col(text_col).isNotNull() & (F.length(text_col) <= sample_chars)).join(F.broadcast(first[0].union(first[1])), id_col)
    place = F.xxhash64(F.col(id_col))
    rows = rows.orderBy(place, id_col, text_col).limit(2 * sample_rows).select(place.alias("place"), F.col(text_col).alias("text"), "__label")

    def train(batches):
        places, labels, edges, parts = [], [], [np.zeros(1, np.int64)], [np.empty(0, np.int32)]
        for batch in batches:
            for part in slices(batch, "text"):
                row, bucket = features(part.column("text"))
                pairs = np.unique(row * BUCKETS + bucket)
                edges.append(edges[-1][-1] + np.searchsorted(pairs, (np.arange(part.num_rows) + 1) * BUCKETS))
                parts.append((pairs % BUCKETS).astype(np.int32))
                places += part.column("place").to_pylist()
                labels += part.column("__label").to_pylist()
        flat, edge = np.concatenate(parts), np.concatenate(edges)
        order = np.argsort(np.array(places, np.int64), kind="stable")
        model = ftrl([flat[edge[i] : edge[i + 1]] for i in order], np.minimum(np.array(labels, float), 1)[order])
        yield pa.RecordBatch.from_arrays([pa.array([model.buckets.astype(np.int64).tobytes()], pa.binary()), pa.array([model.weights.astype(np.float32).tobytes()], pa.binary()), pa.array([model.bias], pa.float64())], names=["buckets", "weights", "bias"])

    # the sample is bounded, so one task trains on it, and the driver sees the weights alone
    found = rows.coalesce(1).mapInArrow(train, "buckets binary, weights binary, bias double").first()
    return Model(np.frombuffer(found["buckets"], np.int64), np.frombuffer(found["weights"], np.float32), found["bias"]) if found else NONE


def scorer(model: Model):
    """A scalar function from text to the probability of toxicity."""
    buckets, weights, bias = model.buckets, model.weights, model.bias

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        dense = np.zeros(BUCKETS, np.float32)
        dense[buckets] = weights
        out = np.full(len(text), bias)
        start = 0
        for part in slices(pa.table({"text": text}), "text"):
            row, bucket = features(part.column("text"))
            hit = dense[bucket] != 0
            pairs = np.unique(row[hit] * BUCKETS + bucket[hit])
            out[start : start + part.num_rows] += np.bincount(pairs // BUCKETS, dense[pairs % BUCKETS], part.num_rows)
            start += part.num_rows
        return pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))))

    return score


def score_toxicity(docs: DataFrame, model: Model, *, text_col: str = "text") -> DataFrame:
    """The documents with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on)."""
    scored = docs.withColumn("score", scorer(model)(F.col(text_col)))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
