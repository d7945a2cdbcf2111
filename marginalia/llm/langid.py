"""Language ID: cross-parsing against a suffix automaton of labelled text per language.

A text is parsed greedily into the longest phrases that occur in a language's sample; the
automaton accepts exactly the substrings of the sample, so a phrase ends where it has no
transition. Phrases are normalised to bits a character, phrases * log2(sample length) /
characters, and the language that needs fewest wins (at a tie the smaller name).

Texts are lower-cased and runs of characters other than letters are one space. A text is
parsed in blocks of ``BLOCK`` characters, a phrase never spans two (which adds at most one
phrase a block, in every language alike), and the blocks of up to ``TOGETHER`` characters
advance together through a transition table, one numpy step a character; so a text of any
length takes the memory of its characters and of one such group.

The sample is documented: whole documents in hash order of the id, none longer than
``SAMPLE_DOC_CHARS``, until ``SAMPLE_CHARS`` characters a language are reached (fewer when
there are more than ``FULL_LANGUAGES`` languages; the ``MOST_LANGUAGES`` with most rows are
learnt, so a dirty column can't make the samples large). Workers get the samples and build the
automata themselves, once. Every text is then parsed whole, in a map without a shuffle.

Defined cases: null text or no letter: ``und`` with score 0. No labelled text: ``und``
with score 0 for all. One language: it, with score 1. Rows with a null language teach
nothing. Repeated rows are judged alike. Very long texts are parsed whole. Empty table: no
rows. Other columns pass through; those named like a result column are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

SAMPLE_CHARS = 40_000
SAMPLE_DOC_CHARS = 20_000
FULL_LANGUAGES = 12
MOST_LANGUAGES = 256
BLOCK = 256
TOGETHER = 2_000_000
SLICE = 2_000_000
UNSEEN, PAD = 0, 1
_built: dict[tuple, list[_Parser]] = {}


def simplified(text: str) -> str:
    return re.sub(r"[\W\d_]+", " ", text.lower()).strip()


class _Parser:
    """Transition table of the suffix automaton of one sample."""

    def __init__(self, sample: str):
        letters = {c: i + 2 for i, c in enumerate(sorted(set(sample)))}
        moves: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in map(letters.__getitem__, sample):
            new = len(moves)
            moves.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in moves[p]:
                moves[p][c] = new
                p = link[p]
            if p >= 0:
                q = moves[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    twin = len(moves)
                    moves.append(dict(moves[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and moves[p].get(c) == q:
                        moves[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
        self.width = len(letters) + 2
        table = np.full((len(moves), self.width), -1, np.int32)
        for state, out in enumerate(moves):
            table[state, list(out)] = list(out.values())
        table[0, PAD] = 0
        self.table, self.root = table.ravel(), table[0].copy()
        self.codes = np.zeros(0x110000, np.uint8 if self.width <= 256 else np.uint16)
        for c, i in letters.items():
            self.codes[ord(c)] = i
        self.bits = np.log2(len(sample) + 1)

    def phrases(self, chars: np.ndarray, real: np.ndarray) -> np.ndarray:
        """Phrases of each column; ``real`` is False where a column has ended."""
        codes = np.where(real, self.codes[chars], PAD).astype(np.int32)
        state = np.zeros(chars.shape[1], np.int32)
        count = np.zeros(chars.shape[1], np.int64)
        for row in codes:
            after = self.table[state * self.width + row]
            ended = np.flatnonzero(after < 0)
            again = self.root[row[ended]]
            count[ended] += (state[ended] != 0).astype(np.int64) + (again < 0)
            after[ended] = np.maximum(again, 0)
            state = after
        return count + (state != 0)


def _parsers(samples: tuple[tuple[str, str], ...]) -> list[_Parser]:
    if samples not in _built:
        _built.clear()
        _built[samples] = [_Parser(text) for _, text in samples]
    return _built[samples]


def _pieces(clean: list[str]):
    """Texts in lists of (row, characters) of about ``TOGETHER`` characters; a longer text in several, cut between blocks."""
    some, size = [], 0
    most = TOGETHER // BLOCK * BLOCK
    for row, text in enumerate(clean):
        for at in range(0, len(text), most):
            some.append((row, text[at : at + most]))
            size += len(some[-1][1])
            if size >= TOGETHER:
                yield some
                some, size = [], 0
    if some:
        yield some


def bits_a_character(texts: list[str | None], parsers: list[_Parser]) -> np.ndarray:
    """One row a text, one column a language."""
    clean = [simplified(t or "") for t in texts]
    out = np.zeros((len(clean), len(parsers)))
    for some in _pieces(clean):
        sizes = np.array([len(t) for _, t in some], np.int64)
        flat = np.frombuffer("".join(t for _, t in some).encode("utf-32-le", "surrogatepass"), np.uint32)
        blocks = -(-sizes // BLOCK)
        row = np.repeat([r for r, _ in some], blocks)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = np.repeat(np.cumsum(sizes) - sizes, blocks) + nth * BLOCK
        size = np.minimum(BLOCK, np.repeat(sizes, blocks) - nth * BLOCK)
        step = np.arange(BLOCK)[:, None]
        real = step < size
        chars = flat[np.where(real, start + step, 0)]
        for k, parser in enumerate(parsers):
            out[:, k] += np.bincount(row, parser.phrases(chars, real), len(clean)) * parser.bits
    return out / np.maximum([len(t) for t in clean], 1)[:, None]


def fit(docs: DataFrame, *, learns: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_chars: int = SAMPLE_CHARS) -> tuple[tuple[str, str], ...]:
    """(language, sample) in order of language."""
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    known = known if learns is None else known.filter(learns)
    counts = {r[0]: r[1] for r in known.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(MOST_LANGUAGES).collect()}
    if not counts:
        return ()
    budget = sample_chars * min(1.0, FULL_LANGUAGES / len(counts))
    # enough documents of 200 characters; the hash decides which
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col(lang_col) == lang, min(1.0, budget / 200 / n)).otherwise(share)
    place = F.pmod(F.xxhash64(F.col(id_col), F.lit(3)), F.lit(1_000_003)) / 1_000_003.0
    rows = known.filter((place < share) & (F.length(text_col) <= SAMPLE_DOC_CHARS)).select(lang_col, text_col, id_col, place.alias("__place"))
    size = F.sum(F.length(text_col)).over(_by(lang_col, "__place", id_col, text_col))
    rows = rows.withColumn("__before", size - F.length(text_col)).filter(F.col("__before") < budget)
    found: dict[str, list[str]] = {}
    for r in rows.orderBy(lang_col, "__place", id_col, text_col).select(lang_col, text_col).collect():
        found.setdefault(r[0], []).append(simplified(r[1]))
    return tuple((lang, sample) for lang in sorted(found) if (sample := "\n".join(found[lang])[: int(budget)].strip()))


def _by(lang_col, *order):
    from pyspark.sql import Window

    # a window over a sample of a bounded number of rows a language
    return Window.partitionBy(lang_col).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def identify_languages(docs: DataFrame, samples: tuple[tuple[str, str], ...], *, text_col: str = "text") -> DataFrame:
    """The documents with ``lang_pred`` and ``score``, the margin by which the runner-up needs more bits."""
    names = np.array([lang for lang, _ in samples], object)

    @F.arrow_udf("lang string, score double")
    def judge(text: pa.Array) -> pa.Array:
        langs, scores = [], []
        for part in slices(pa.table({"t": text}), "t", SLICE) if len(names) else ():
            bits = bits_a_character(part.column("t").to_pylist(), _parsers(samples))
            order = np.argsort(bits, axis=1, kind="stable")
            best = np.take_along_axis(bits, order[:, :1], 1)[:, 0]
            second = np.take_along_axis(bits, order[:, 1:2], 1)[:, 0] if len(names) > 1 else np.full(len(best), np.inf)
            langs += names[order[:, 0]].tolist()
            scores.append(1 - np.divide(best, second, out=np.ones_like(best), where=second > 0))
        if not len(names):
            langs, scores = ["und"] * len(text), [np.zeros(len(text))]
        score = np.concatenate(scores) if scores else np.empty(0)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=["lang", "score"])

    known = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    out = docs.withColumn("__judged", judge(F.col(text_col)))
    out = out.withColumn("lang_pred", F.when(known, F.col("__judged.lang")).otherwise("und"))
    return out.withColumn("score", F.when(known, F.col("__judged.score")).otherwise(0.0)).drop("__judged")
