"""Corpus analyses over prepared pairs (view, pipeline, doc_id, doc_pos, ref, hyp) and over scores.

What needs a path through an alignment is one Arrow function that returns rows; all
counting, ranking and joining is DataFrame work. An analysis that does not apply returns
no rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Sequence
from functools import cache, lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from ..functions import batch_align, scanners
from ..functions.align import EQUAL, REPLACE, Block, edit_runs
from ..functions.text import ascii_tokens, excerpt, f1, line_array, quality_gain, safe_ratio, token_array, zero_safe_ratio
from . import aggregate, relational
from .metrics import batch_function, batch_list_function, by_slices, list_function, text_slices, with_distance

KEY = ["view", "pipeline"]
GONE = "∅"
TOKENS = re.compile(r"\w+(?:['’\-]\w+)*")


def _strings(*names: str) -> pa.DataType:
    return pa.struct([(n, pa.string()) for n in names])


def exploded(pairs: DataFrame, rows: Column, *keep: str) -> DataFrame:
    return pairs.select(*keep, F.inline(rows))


# -- word alignments -----------------------------------------------------------------


#: Of pairs in groups (their numbers, first and second items): each group's rows, and how often.
Found = Callable[[list[int], list[Sequence], list[Sequence]], Iterable[tuple[int, tuple, int]]]


def by_blocks(rows: Callable[[Sequence, Sequence, list[Block]], Iterable[tuple[tuple, int]]]) -> Found:
    """What ``rows`` finds in the longest-block alignment of each pair."""

    def found(groups: list[int], left: list[Sequence], right: list[Sequence]) -> Iterable[tuple[int, tuple, int]]:
        for group, a, b, blocks in zip(groups, left, right, batch_align.matches(left, right), strict=True):
            for row, n in rows(a, b, blocks):
                yield group, row, n

    return found


def _confusions(groups: list[int], left: list[str], right: list[str]) -> Iterable[tuple[int, tuple, int]]:
    """Characters that replace one another, counted over all pairs at once; a character has 21 bits."""
    pair, a, b = batch_align.replaced(left, right)
    key, n = np.unique(np.array(groups, np.int64)[pair] << 42 | a << 21 | b, return_counts=True)
    low = (1 << 21) - 1
    return zip((key >> 42).tolist(), zip(map(chr, (key >> 21 & low).tolist()), map(chr, (key & low).tolist())), n.tolist())


#: Class of the error between two words; the same words meet again and again.
_pair_class = lru_cache(200_000)(scanners.word_pair_class)


def _classes(a: list[str], b: list[str], blocks: list[Block]) -> Iterable[tuple[tuple, int]]:
    for op, i, i2, j, j2 in blocks:
        if op == EQUAL:
            continue
        if i2 - i == 1 == j2 - j:
            yield (_pair_class(a[i], b[j]),), 1
            continue
        left, right = a[i:i2], b[j:j2]
        if left and right and "".join(left) == "".join(right):
            yield ("segmentation",), max(len(left), len(right))
            continue
        yield from zip(zip(map(_pair_class, left, right)), repeat(1))
        if len(left) != len(right):
            yield ("lacuna" if len(left) > len(right) else "insertion",), abs(len(left) - len(right))


def _tokens(text: str) -> list[str]:
    # the pattern finds the same in ASCII whether it is lower-cased before or after
    return TOKENS.findall(text.lower()) if text.isascii() else [t.lower() for t in TOKENS.findall(text)]


def _rewritten(a: list[str], b: list[str], blocks: list[Block]) -> Iterable[tuple[tuple, int]]:
    """Each token of the reference that is not kept, with the form it was given."""
    for op, i, i2, j, j2 in blocks:
        if op != EQUAL:
            for n in range(i, i2):
                yield (a[n], b[j + n - i] if n - i < j2 - j else GONE), 1


#: Different rows that are counted in a task before they are handed on.
COUNTED = 200_000


def counted_rows(pairs: DataFrame, items: Callable[[str], Sequence], rows: Found, names: Sequence[str], kept: bool = False, alike: Callable[[str, str], bool] = str.__eq__) -> DataFrame:
    """(view, pipeline, names, n): what ``rows`` finds in the longest-block alignments of pairs of items, counted in the task and then by row.

    ``kept``: items of the first texts that the second keep are counted too, as rows whose
    second name is null. ``alike``: texts whose items are the same without looking at them.
    """

    def counts(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        found: dict[tuple, Counter] = {}
        have: dict[tuple, Counter] = {}

        def out() -> pa.RecordBatch:
            lines = [(*key, *row, n) for key, counted in found.items() for row, n in counted.items()]
            for key, counted in have.items():
                for (item, *_), n in found.get(key, {}).items():
                    counted[item] -= n
                lines += [(*key, item, None, n) for item, n in counted.items() if n]
            found.clear()
            have.clear()
            kinds = [*[pa.string()] * (len(KEY) + len(names)), pa.int64()]
            columns = zip(*lines, strict=True) if lines else [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*KEY, *names, "n"])

        for batch in batches:
            for view, pipeline, refs, hyps in text_slices(batch):
                groups, left, right, known, numbers = [], [], [], cache(items), {}
                for key, a, b in zip(zip(view, pipeline, strict=True), refs, hyps, strict=True):
                    same = alike(a, b)
                    if kept:
                        have.setdefault(key, Counter()).update(known(a))
                    if not same:
                        groups.append(numbers.setdefault(key, len(numbers)))
                        left.append(known(a))
                        right.append(items(b))
                counters = [found.setdefault(key, Counter()) for key in numbers]
                for group, row, n in rows(groups, left, right):
                    counters[group][row] += n
                if sum(map(len, found.values())) + sum(map(len, have.values())) > COUNTED:
                    yield out()
        yield out()

    given = pairs.select(*KEY, "ref", "hyp").filter("ref is not null and hyp is not null")
    schema = ", ".join([*[f"{c} string" for c in (*KEY, *names)], "n long"])
    return given.mapInArrow(counts, schema).groupBy(*KEY, *names).agg(F.sum("n").alias("n"))


def confusions(pairs: DataFrame, k: int = 10) -> DataFrame:
    """The most frequent character confusions of each pipeline; equal texts have none."""
    counted = counted_rows(pairs.filter(F.col("ref") != F.col("hyp")), str, _confusions, ["expected", "observed"])
    return aggregate.top(counted, k, F.desc("n"), F.col("expected"), F.col("observed"), by=KEY)


def taxonomy(pairs: DataFrame) -> DataFrame:
    """Errors of each class, and their share of the pipeline's."""
    counted = counted_rows(pairs.filter(F.col("ref") != F.col("hyp")), str.split, by_blocks(_classes), ["class"])
    return counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*KEY)))


def _same_tokens(a: str, b: str) -> bool:
    """Whether it is plain that two texts have the same tokens."""
    return a == b or (len(a) == len(b) and a.isascii() and b.isascii() and a.lower() == b.lower())


def token_forms(pairs: DataFrame, kept: bool = False) -> DataFrame:
    """(view, pipeline, token, form, n): tokens of the references by the form they were given; null if kept."""
    return counted_rows(pairs, _tokens, by_blocks(_rewritten), ["token", "form"], kept, _same_tokens)


def jensen_shannon(counted: DataFrame, by: list[str], name: str, label: str, n: str) -> DataFrame:
    """Divergence in bits between the distributions of every two names of a group."""
    total = counted.groupBy(*by, name).agg(F.sum(n).alias("__t"))
    labels = counted.select(*by, label).distinct()
    full = total.join(labels, by) if by else total.crossJoin(labels)
    full = full.join(counted.groupBy(*by, name, label).agg(F.sum(n).alias("__n")), [*by, name, label], "left")
    tiny = 1e-12
    p = full.withColumn("p", F.coalesce("__n", F.lit(0)) / F.col("__t") + tiny)
    p = p.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy(*by, name))).select(*by, name, label, "p")
    a, b = p.withColumnsRenamed({name: "a", "p": "pa"}), p.withColumnsRenamed({name: "b", "p": "pb"})
    m = (F.col("pa") + F.col("pb")) / 2
    part = (F.col("pa") * F.log2(F.col("pa") / m) + F.col("pb") * F.log2(F.col("pb") / m)) / 2
    out = a.join(b, [*by, label]).filter("a < b").groupBy(*by, "a", "b").agg(F.sum(part).alias("js"))
    return out.withColumn("js", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("js"))))


def word_errors(pairs: DataFrame, k: int = 50) -> DataFrame:
    """Words missed, by pipeline, with the form most often produced and who else misses them."""
    each = token_forms(pairs).groupBy(*KEY, "token").agg(F.sum("n").alias("n"), F.min(F.struct((-F.col("n")).alias("c"), "form"))["form"].alias("form"))
    pipelines = pairs.groupBy("view").agg(F.countDistinct("pipeline").alias("pipelines")).filter("pipelines > 1")
    # by windows over one table: joined to an aggregate of itself, pairs were aligned twice
    word = Window.partitionBy("view", "token")
    words = each.withColumns({"total": F.sum("n").over(word), "missed_by": F.count(F.lit(1)).over(word)})
    place = F.dense_rank().over(Window.partitionBy("view").orderBy(F.desc("total"), "token"))
    words = words.withColumn("place", place).filter(F.col("place") <= k).join(pipelines, "view")
    kind = F.when(F.col("missed_by") == F.col("pipelines"), "universal").when(F.col("missed_by") == 1, "engine_specific").otherwise("partial")
    return words.select("view", "token", "pipeline", "n", "form", "total", kind.alias("group"), "place")


def modernisation(pairs: DataFrame, k: int = 20, variants: int = 5) -> DataFrame:
    """Tokens most often rewritten, with their commonest forms."""
    # all by windows over one table: as a join of two aggregates of it, pairs were aligned for each
    by = [*KEY, "token"]
    total = lambda n: F.sum(n).over(Window.partitionBy(*by))
    counted = token_forms(pairs, kept=True).withColumns({"n_total": total("n"), "n_modernised": total(F.when(F.col("form").isNotNull(), F.col("n")).otherwise(0))})
    forms = counted.filter("form is not null").withColumn("rate", F.col("n_modernised") / F.col("n_total"))
    place = F.dense_rank().over(Window.partitionBy(*KEY).orderBy(F.desc("rate"), F.desc("n_total"), "token"))
    forms = forms.withColumn("place", place).filter(F.col("place") <= k)
    forms = forms.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "form"))).filter(F.col("nth") <= variants)
    each = F.transform(F.array_sort(F.collect_list(F.struct("nth", "form", "n"))), lambda x: F.struct(x["form"], x["n"]))
    return forms.groupBy(*by, "n_total", "n_modernised", "rate", "place").agg(each.alias("variants"))


# -- tokens as multisets -------------------------------------------------------------


#: Token columns that a pattern gives as well: there texts go to Python, which are smaller than lists of tokens.
PATTERNS = {ascii_tokens: "[A-Za-z0-9_]+"}
_TOKEN = pa.struct([("token", pa.string()), ("n", pa.int64()), ("kept", pa.int64())])
#: Rows that are taken from Arrow at a time.
ROWS = 512


def _given(tokens: Callable[[Column], Column], name: str) -> Column:
    return F.col(name) if tokens in PATTERNS else tokens(F.col(name))


def _finder(tokens: Callable[[Column], Column]) -> Callable[[object], Sequence[str]]:
    """What gives the tokens of a value of ``_given``."""
    find = re.compile(PATTERNS[tokens]).findall if tokens in PATTERNS else list
    return lambda x: () if x is None else find(x)


def _values(*columns: pa.Array) -> Iterable[tuple]:
    for start in range(0, len(columns[0]), ROWS):
        yield from zip(*(c.slice(start, ROWS).to_pylist() for c in columns), strict=True)


def _kept(ours: Counter, theirs: Sequence[str]) -> list[int]:
    """Of each distinct token, how many of ours they have too."""
    have = Counter(theirs)
    return [min(n, have[t]) for t, n in ours.items()]


def multiset_rows(find: Callable[[object], Sequence[str]]):
    """Each distinct token of the first side: how often it is there, and how many of those the second has too."""

    @F.arrow_udf(from_arrow_type(pa.list_(_TOKEN)))
    def rows(ours: pa.Array, theirs: pa.Array) -> pa.Array:
        ends, names, n, kept = [0], [], [], []
        for a, b in _values(ours, theirs):
            counted = Counter(find(a))
            names += counted
            n += counted.values()
            kept += _kept(counted, find(b))
            ends.append(len(names))
        fields = [pa.array(names, pa.string()), pa.array(n, pa.int64()), pa.array(kept, pa.int64())]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(_TOKEN)), type=pa.list_(_TOKEN))

    return rows


def kept_tokens(pairs: DataFrame, tokens=token_array) -> DataFrame:
    """(view, doc_id, pipeline, token, n, kept): tokens of the reference and how many the hypothesis has too."""
    return pairs.select("view", "doc_id", "pipeline", F.inline(multiset_rows(_finder(tokens))(_given(tokens, "ref"), _given(tokens, "hyp"))))


def _recall(sums: DataFrame) -> DataFrame:
    return sums.withColumn("recall", F.col("kept") / F.col("n"))


_SUMS = pa.struct([("n", pa.int64()), ("kept", pa.int64())])


def multiset_sums(find: Callable[[object], Sequence[str]]):
    """Tokens of the first side, and how many of those the second has too."""

    @F.arrow_udf(from_arrow_type(_SUMS))
    def sums(ours: pa.Array, theirs: pa.Array) -> pa.Array:
        n, kept = [], []
        for a, b in _values(ours, theirs):
            a = find(a)
            n.append(len(a))
            kept.append(sum(_kept(Counter(a), find(b))))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(kept, pa.int64())], fields=list(_SUMS))

    return sums


def token_recall(pairs: DataFrame, tokens=token_array) -> DataFrame:
    # pipelines without tokens are left out after the sums: a filter on a function's result would call it twice
    rows = pairs.select(*KEY, multiset_sums(_finder(tokens))(_given(tokens, "ref"), _given(tokens, "hyp")).alias("x"))
    return _recall(rows.groupBy(*KEY).agg(F.sum("x.n").alias("n"), F.sum("x.kept").alias("kept")).filter("n > 0"))


_BEST = pa.struct([("n", pa.int64()), ("oracle", pa.int64()), ("best", pa.int64())])
_PART = pa.struct([("pipeline", pa.string()), ("n", pa.int64()), ("kept", pa.int64())])


def _best_of(find: Callable[[object], Sequence[str]], doc: list[dict]) -> tuple[int, int, list[tuple[str, int, int]]]:
    """Of a document's pipelines: tokens, tokens that some pipeline kept, and the name, tokens and kept tokens of each."""
    most, saved, each, known = {}, {}, [], {}
    for row in doc:
        # pipelines mostly share one reference
        key = row["ref"] if isinstance(row["ref"], str) else id(row["ref"])
        if key not in known:
            known[key] = Counter(find(row["ref"]))
            for t, n in known[key].items():
                most[t] = max(most.get(t, 0), n)
        ours = known[key]
        kept = _kept(ours, find(row["hyp"]))
        for t, k in zip(ours, kept, strict=True):
            if k > saved.get(t, 0):
                saved[t] = k
        each.append((row["pipeline"], ours.total(), sum(kept)))
    return sum(most.values()), sum(saved.values()), each


def best_rows(find: Callable[[object], Sequence[str]]):
    """Of each document with tokens one row: tokens, tokens that some pipeline kept, tokens of the best one."""

    @F.arrow_udf(from_arrow_type(pa.list_(_BEST)))
    def rows(docs: pa.Array) -> pa.Array:
        out = []
        for (doc,) in _values(docs):
            n, oracle, each = _best_of(find, doc)
            out.append([{"n": n, "oracle": oracle, "best": max((kept for _, _, kept in each), default=0)}] if n else [])
        return pa.array(out, pa.list_(_BEST))

    return rows


def oracle_rows(find: Callable[[object], Sequence[str]]):
    """Of each document tokens and kept tokens of each pipeline, and under no name of all of them together."""

    @F.arrow_udf(from_arrow_type(pa.list_(_PART)))
    def rows(docs: pa.Array) -> pa.Array:
        out = []
        for (doc,) in _values(docs):
            n, oracle, each = _best_of(find, doc)
            out.append([dict(zip(("pipeline", "n", "kept"), x, strict=True)) for x in ((None, n, oracle), *each)])
        return pa.array(out, pa.list_(_PART))

    return rows


def _documents(pairs: DataFrame, tokens) -> DataFrame:
    """One row a document with what its tokens are found in, a pipeline at a time."""
    one = F.struct("pipeline", _given(tokens, "ref").alias("ref"), _given(tokens, "hyp").alias("hyp"))
    return pairs.groupBy("view", "doc_id").agg(F.collect_list(one).alias("each"))


def complementarity_by_doc(pairs: DataFrame, tokens=token_array) -> DataFrame:
    """Per document: tokens, tokens that some pipeline kept, tokens that its best pipeline kept."""
    return _documents(pairs, tokens).select("view", "doc_id", F.inline(best_rows(_finder(tokens))("each")))


def complementarity(pairs: DataFrame, tokens=token_array) -> DataFrame:
    """Recall of an oracle that picks each token's best pipeline, of the best single one, and the gap; one pass."""
    rows = _documents(pairs, tokens).select("view", F.inline(oracle_rows(_finder(tokens))("each")))
    sums = _recall(rows.groupBy(*KEY).agg(F.sum("n").alias("n"), F.sum("kept").alias("kept")).filter("n > 0"))
    single = F.min(F.when(F.col("pipeline").isNotNull(), F.struct((-F.col("recall")).alias("r"), "pipeline")))
    out = sums.groupBy("view").agg(F.max(F.when(F.col("pipeline").isNull(), F.col("recall"))).alias("oracle_recall"), single.alias("s"))
    out = out.select("view", "oracle_recall", F.col("s.pipeline").alias("best_pipeline"), (-F.col("s.r")).alias("best_recall"))
    gap = F.greatest(F.lit(0.0), F.col("oracle_recall") - F.col("best_recall"))
    return out.withColumns({"gap": gap, "relative_gap": F.when(1 - F.col("best_recall") > 1e-12, gap / (1 - F.col("best_recall"))).otherwise(0.0)})


def complementary_documents(pairs: DataFrame, k: int = 20, tokens=token_array) -> DataFrame:
    docs = complementarity_by_doc(pairs, tokens).withColumn("gap", (F.col("oracle") - F.col("best")) / F.col("n"))
    return aggregate.top(docs, k, F.desc("gap"), F.col("doc_id"), by=["view"])


def one_per_document(pairs: DataFrame) -> DataFrame:
    """(view, doc_id, ref): the reference of each document once, where there is no table of them."""
    return pairs.groupBy("view", "doc_id").agg(F.min("ref").alias("ref"))


def rare_tokens(references: DataFrame, most: int = 2, tokens=token_array, text: str = "ref") -> DataFrame:
    """Tokens that the references (a row a document) have at most so often."""
    return references.select("view", F.explode(tokens(F.col(text))).alias("token")).groupBy("view", "token").agg(F.count(F.lit(1)).alias("freq")).filter(F.col("freq") <= most)


_COUNTS = "view string, pipeline string, token string, n long, kept long"


def batch_counts(find: Callable[[object], Sequence[str]]):
    """Tokens of the first side of each batch of (view, pipeline, ref, hyp): how often, and how many of those the second sides have too."""

    def counts(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            have: dict[tuple, Counter] = {}
            lost: dict[tuple, Counter] = {}
            for view, pipeline, ref, hyp in _values(*batch.columns):
                key, a = (view, pipeline), find(ref)
                have.setdefault(key, Counter()).update(a)
                if ref != hyp:
                    lost.setdefault(key, Counter()).update(Counter(a) - Counter(find(hyp)))
            rows = [(*key, t, n, n - lost.get(key, {}).get(t, 0)) for key, counted in have.items() for t, n in counted.items()]
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in _COUNTS.split(", ")])

    return counts


def _rare_counts(pairs: DataFrame, most: int, tokens, references: DataFrame | None) -> DataFrame:
    """(view, pipeline, token, n, kept) of the rare tokens; counted by token, first in each batch, before they are looked up."""
    given = pairs.select(*KEY, _given(tokens, "ref").alias("ref"), _given(tokens, "hyp").alias("hyp"))
    counted = given.mapInArrow(batch_counts(_finder(tokens)), _COUNTS).groupBy(*KEY, "token").agg(F.sum("n").alias("n"), F.sum("kept").alias("kept"))
    return counted.join(rare_tokens(one_per_document(pairs) if references is None else references, most, tokens), ["view", "token"], "left_semi")


def rare_token_recall(pairs: DataFrame, most: int = 2, tokens=token_array, references: DataFrame | None = None) -> DataFrame:
    return _recall(_rare_counts(pairs, most, tokens, references).groupBy(*KEY).agg(F.sum("n").alias("n"), F.sum("kept").alias("kept")))


def missed_rare_tokens(pairs: DataFrame, most: int = 2, k: int = 20, tokens=token_array, references: DataFrame | None = None) -> DataFrame:
    return aggregate.collected_samples(_rare_counts(pairs, most, tokens, references).filter("kept < n"), KEY, "token", k)


new_grams = batch_function(lambda refs, hyps: list(batch_align.new_grams(batch_align.Pairs(refs, hyps))), ["grams", "new"])


def hallucination(pairs: DataFrame) -> DataFrame:
    """Trigrams of the hypotheses that their references lack.

    Counted within a pair, so that trigrams, many times the text, are never shuffled.
    """
    rows = pairs.select(*KEY, new_grams("ref", "hyp").alias("g"))
    out = rows.groupBy(*KEY).agg(F.sum("g.grams").alias("grams"), F.sum("g.new").alias("new"))
    return out.withColumn("value", safe_ratio(F.col("new"), F.col("grams")))


# -- lines ---------------------------------------------------------------------------


def lines_by_index(pairs: DataFrame) -> DataFrame:
    """Lines of the reference that are not empty, with the hypothesis' line of the same number and its error rate."""
    ours = pairs.select("view", "pipeline", "doc_id", F.posexplode(line_array(F.col("ref"))).alias("line", "ref_line"), line_array(F.col("hyp")).alias("__h")).filter("ref_line <> ''")
    theirs = ours.withColumn("hyp_line", F.coalesce(F.get("__h", F.col("line")), F.lit(""))).drop("__h")
    return with_distance(theirs, "edits", F.col("ref_line"), F.col("hyp_line")).withColumn("cer", F.col("edits") / F.length("ref_line")).drop("edits")


def worst_lines(pairs: DataFrame, k: int = 5) -> DataFrame:
    rows = lines_by_index(pairs).filter("cer > 0").withColumns({c: excerpt(F.col(c)) for c in ("ref_line", "hyp_line")})
    return aggregate.top(rows, k, F.desc("cer"), F.col("pipeline"), F.col("doc_id"), F.col("line"), by=["view"])


def _line_rates(refs: list[str], hyps: list[str]) -> list[list[dict]]:
    """Place and capped error rate of each line of each reference; lines, and then their texts, are aligned for the whole batch."""
    left, right = ([t.splitlines() for t in side] for side in (refs, hyps))
    ours, theirs = [], []
    for a, b, blocks in zip(left, right, batch_align.edit_blocks(left, right), strict=True):
        with_line: list[str] = [""] * len(a)
        for op, i, i2, j, _ in blocks:
            if op in (EQUAL, REPLACE):
                with_line[i:i2] = b[j : j + i2 - i]
        ours += a
        theirs += with_line
    ours, theirs = ([unicodedata.normalize("NFC", t.strip()) for t in side] for side in (ours, theirs))
    # equal lines have no edits, and those that an empty side decides need none
    known = {pair: min(1.0, 1.0 * len(pair[1])) if not pair[0] else float(pair[0] != pair[1]) for pair in zip(ours, theirs, strict=True)}
    open_ = [(x, y) for x, y in known if x and y and x != y]
    for (x, y), n in zip(open_, batch_align.distances(batch_align.Pairs([x for x, _ in open_], [y for _, y in open_])).tolist() if open_ else (), strict=True):
        known[x, y] = min(n / len(x), 1.0)
    rates = map(known.__getitem__, zip(ours, theirs, strict=True))
    return [[{"place": n / len(a), "cer": next(rates)} for n in range(len(a))] for a in left]


line_rates = batch_list_function(_line_rates, pa.struct([("place", pa.float64()), ("cer", pa.float64())]))


def aligned_lines(pairs: DataFrame) -> DataFrame:
    """Capped error rate of each line of the reference, lines aligned as a sequence, with its place from 0 to 1."""
    return exploded(pairs, line_rates(F.col("ref"), F.col("hyp")), *KEY, "doc_id")


def line_summary(lines: DataFrame, thresholds=(0.3, 0.5, 1.0)) -> DataFrame:
    """Lines are counted by their rate once; all figures of a pipeline come from those counts."""
    counted = aggregate.counted_values(lines, "cer", KEY)
    n = F.sum("n")
    catastrophic = [(F.sum(F.when(F.col("cer") >= t, F.col("n")).otherwise(0)) / n).alias(f"over_{round(100 * t)}") for t in thresholds]
    points = (0.5, 0.75, 0.9, 0.95, 0.99)
    out = counted.groupBy(*KEY).agg(n.alias("n_lines"), (F.sum(F.col("cer") * F.col("n")) / n).alias("mean"), *catastrophic, F.percentile("cer", F.array(*map(F.lit, points)), F.col("n")).alias("p"))
    out = out.select(*[c for c in out.columns if c != "p"], *[F.col("p")[i].alias(f"p{round(100 * x)}") for i, x in enumerate(points)])
    return out.join(aggregate.counted_gini(counted, "cer", KEY), KEY)


def line_heatmap(lines: DataFrame, bins: int = 10) -> DataFrame:
    """Mean error rate by place in the document; empty bins are there with null."""
    binned = lines.groupBy(*KEY, F.least(F.floor(F.col("place") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.avg("cer").alias("mean"))
    every = lines.select(*KEY).distinct().select(*KEY, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(binned, [*KEY, "bin"], "left")


# -- marks, numerals, sequences --------------------------------------------------------

_MARK = pa.struct([("marker", pa.string()), ("n_total", pa.int64()), ("n_strict", pa.int64()), ("n_expanded", pa.int64())])
MARK_ROWS = {
    "abbreviations": list_function(scanners.abbreviation_counts, _MARK),
    "early_modern": list_function(scanners.early_print_counts, _MARK),
    "modern_archives": list_function(scanners.archive_counts, _MARK),
}
numeral_rows = list_function(scanners.numeral_counts, pa.struct([("form", pa.string()), ("value", pa.int64()), ("status", pa.string())]))
sequence_rows = list_function(scanners.sequence_counts, pa.struct([("category", pa.string()), ("n_total", pa.int64()), ("n_strict", pa.int64()), ("n_value", pa.int64()), ("lost", pa.list_(pa.string()))]))


def philology(pairs: DataFrame) -> DataFrame:
    """How marks of the references come back, by family and mark."""
    rows = [exploded(pairs, f(F.col("ref"), F.col("hyp")), *KEY).withColumn("family", F.lit(name)) for name, f in MARK_ROWS.items()]
    out = rows[0].unionByName(rows[1]).unionByName(rows[2]).groupBy(*KEY, "family", "marker").agg(*[F.sum(c).alias(c) for c in ("n_total", "n_strict", "n_expanded")])
    return out.withColumns({"strict": F.col("n_strict") / F.col("n_total"), "expanded": F.col("n_expanded") / F.col("n_total")})


def roman_numerals(pairs: DataFrame) -> DataFrame:
    return exploded(pairs, numeral_rows(F.col("ref"), F.col("hyp")), *KEY).groupBy(*KEY, "status").agg(F.count(F.lit(1)).alias("n"))


def lost_numerals(pairs: DataFrame, k: int = 12) -> DataFrame:
    rows = pairs.select(*KEY, "doc_pos", F.posexplode(numeral_rows(F.col("ref"), F.col("hyp"))).alias("at", "x")).filter("x.status = 'lost'").select(*KEY, "doc_pos", "at", "x.form")
    return aggregate.first_samples(rows, KEY, "form", ["doc_pos", "at"], k)


def structured_data(pairs: DataFrame, k: int = 12) -> DataFrame:
    """Years, folios, amounts and regnal years found again, as written and by value, with lost forms."""
    rows = pairs.select(*KEY, "doc_pos", F.inline(sequence_rows(F.col("ref"), F.col("hyp"))))
    by = [*KEY, "category"]
    out = rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n_total", "n_strict", "n_value")])
    lost = rows.select(*by, "doc_pos", F.posexplode("lost").alias("at", "form"))
    out = out.join(aggregate.first_samples(lost, by, "form", ["doc_pos", "at"], k), by, "left")
    return out.withColumns({"strict": F.col("n_strict") / F.col("n_total"), "value": F.col("n_value") / F.col("n_total")})


# -- texts and rankings ----------------------------------------------------------------


def hardest_documents(scores: DataFrame, k: int = 5, metric: str = "cer") -> DataFrame:
    docs = scores.filter((F.col("metric") == metric) & F.col("value").isNotNull()).groupBy("view", "doc_id").agg(F.avg("value").alias("mean_cer"))
    return aggregate.top(docs, k, F.desc("mean_cer"), F.col("doc_id"), by=["view"])


def document_texts(pairs: DataFrame, scores: DataFrame, k: int = 20, size: int = 8000) -> DataFrame:
    """Texts of the documents with the highest mean error rate, cut for display."""
    worst = hardest_documents(scores, k)
    cut = [F.substring(c, 1, size).alias(c) for c in ("ref", "hyp")]
    return pairs.join(F.broadcast(worst), ["view", "doc_id"]).select("view", "doc_id", "pipeline", "place", "mean_cer", *cut)


# -- calibration -----------------------------------------------------------------------


def matched_tokens(tokens: DataFrame, references: DataFrame) -> DataFrame:
    """Tokens (pipeline, doc_id, pos, text, confidence) with ``correct``: each word of the reference confirms one."""
    words = references.select("doc_id", F.explode(F.filter(F.split("ref", r"(?U)\s+"), lambda w: w != "")).alias("text"))
    n = words.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("__n"))
    nth = F.row_number().over(Window.partitionBy("pipeline", "doc_id", "text").orderBy("pos"))
    return tokens.withColumn("__nth", nth).join(n, ["doc_id", "text"], "left").withColumn("correct", F.coalesce(F.col("__nth") <= F.col("__n"), F.lit(False)).cast("int")).drop("__n", "__nth")


def calibration_bins(tokens: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    b = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    return tokens.groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence"), F.avg("correct").alias("accuracy"))


def calibration(tokens: DataFrame, by: list[str]) -> DataFrame:
    """Expected and largest gap between confidence and accuracy."""
    gap = F.abs(F.col("accuracy") - F.col("confidence"))
    return calibration_bins(tokens, by).groupBy(*by).agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"), F.max(gap).alias("mce"), F.sum("n").alias("n"))


# -- correction ------------------------------------------------------------------------

CORRECTION = "raw_edits long, raw_total long, sys_edits long, sys_total long, sys_insertions long, change_edits long, change_total long, ref_length long, sys_length long, correct_before long, undone long"


ABSORBED = ("errors_before", "errors_after", "corrected", "introduced", "kept_wrong")


def _beside(words: list[str], others: list[str], blocks: list[Block]) -> list[str | None]:
    """What each word is aligned with."""
    out: list[str | None] = [None] * len(words)
    for op, i, i2, j, _ in blocks:
        if op in (EQUAL, REPLACE):
            out[i:i2] = others[j : j + i2 - i]
    return out


def correction_rows(refs: list[str], raws: list[str], fixed: list[str]) -> list[dict]:
    """The measures of each triple; every two of its texts are aligned for the whole batch."""
    align = lambda a, b: batch_align.edits(batch_align.Pairs(a, b))
    steps = align(refs, fixed)
    raw, result, change = align(refs, raws).counts(), steps.counts(), align(raws, fixed).counts()
    total = lambda c: (c[:, 1:].sum(1), c.sum(1))
    numbers = [*total(raw), *total(result), result[:, 3], *total(change)]
    words, before, after = ([t.split() for t in side] for side in (refs, raws, fixed))
    blocks = [batch_align.edit_blocks(words, side) for side in (before, after)]
    out = []
    for n, (a, b, c) in enumerate(zip(words, before, after, strict=True)):
        was, now = _beside(a, b, blocks[0][n]), _beside(a, c, blocks[1][n])
        kept = [k for k, w in enumerate(a) if was[k] == w]
        undone = [{"reference": a[k][:64], "corrected": (now[k] or GONE)[:64]} for k in kept if now[k] != a[k]]
        row = [*(int(x[n]) for x in numbers), len(refs[n]), len(fixed[n]), len(kept), len(undone)]
        out.append(dict(zip((p.split()[0] for p in CORRECTION.split(", ")), row, strict=True)) | {"samples": undone})
    for row, found in zip(out, steps.blocks(), strict=True):
        row["runs"] = edit_runs(found)
    return out


_CORRECTION_KIND = pa.struct([*[(p.split()[0], pa.int64()) for p in CORRECTION.split(", ")], ("runs", pa.list_(pa.int64())), ("samples", pa.list_(_strings("reference", "corrected")))])


@F.arrow_udf(from_arrow_type(_CORRECTION_KIND))
def correction_row(ref: pa.Array, raw: pa.Array, sys: pa.Array) -> pa.Array:
    return by_slices(lambda *texts: pa.array(correction_rows(*texts), _CORRECTION_KIND), ref, raw, sys)


def correction_by_doc(triples: DataFrame) -> DataFrame:
    """(pipeline, doc_id, doc_pos, ref, raw, corrected); a missing output is the empty text."""
    texts = [F.coalesce(c, F.lit("")) for c in ("ref", "raw", "corrected")]
    rows = triples.withColumns({"missing_raw": F.col("raw").isNull(), "missing_corrected": F.col("corrected").isNull(), "c": correction_row(*texts)})
    return _rates(rows.select("pipeline", "doc_id", "doc_pos", "missing_raw", "missing_corrected", "c.*"))


def _rates(rows: DataFrame) -> DataFrame:
    rows = rows.withColumns({"cmer_raw": zero_safe_ratio(F.col("raw_edits"), F.col("raw_total")), "cmer_sys": zero_safe_ratio(F.col("sys_edits"), F.col("sys_total"))})
    return rows.withColumns({"delta": F.col("cmer_sys") - F.col("cmer_raw"), "pcis": quality_gain(1 - F.col("cmer_sys"), 1 - F.col("cmer_raw"))})


def _kept_words(left: list[list[str]], right: list[list[str]]) -> list[np.ndarray]:
    """Whether each word of the first lists is aligned with itself; as ``word_edits`` finds, only some lists have to be aligned."""
    out: list[np.ndarray] = [np.empty(0, bool)] * len(left)
    others = []
    for n, (a, b) in enumerate(zip(left, right, strict=True)):
        kept = [x == y for x, y in zip(a, b, strict=False)]
        if len(a) == len(b) and (all(kept) or {x for x, k in zip(a, kept, strict=True) if not k}.isdisjoint([y for y, k in zip(b, kept, strict=True) if not k])):
            out[n] = np.array(kept, bool)
        else:
            others.append(n)
    if others:
        pairs = batch_align.Pairs(*([side[n] for n in others] for side in (left, right)))
        for n, kept in zip(others, np.split(batch_align.edits(pairs).kept(0), pairs.starts[0][1:-1]), strict=True):
            out[n] = kept
    return out


def _lacking(want: list[str], have: list[str]) -> Counter:
    """Words that one list has more often, and how much more often."""
    if want == have:
        return Counter()
    off = [(x, y) for x, y in zip(want, have, strict=False) if x != y]
    ours, theirs = [x for x, _ in off] + want[len(have) :], [y for _, y in off] + have[len(want) :]
    return Counter(ours) if set(ours).isdisjoint(theirs) else Counter(ours) - Counter(theirs)


def _absorbed(before: Counter, after: Counter) -> tuple[int, ...]:
    """Of words that are missing before and after a correction: the sums named in ``ABSORBED``."""
    was, now, still = before.total(), after.total(), sum(min(n, after[w]) for w, n in before.items() if w in after)
    return was, now, was - still, now - still, still


_SUMMED = [p.split()[0] for p in CORRECTION.split(", ")]


def correction_columns(refs: list[str], raws: list[str], fixed: list[str]) -> tuple[list, list[list[dict]]]:
    """Of each triple the numbers of ``correction_rows``, and of ``absorbed``, as columns; and how often it has runs of each length."""
    align = lambda a, b: batch_align.edits(batch_align.Pairs(a, b))
    steps = align(refs, fixed)
    raw, result, change = align(refs, raws).counts(), steps.counts(), align(raws, fixed).counts()
    total = lambda c: (c[:, 1:].sum(1), c.sum(1))
    words, before, after = ([t.split() for t in side] for side in (refs, raws, fixed))
    kept = list(zip(_kept_words(words, before), _kept_words(words, after), strict=True))
    counts = [[int(was.sum()) for was, _ in kept], [int((was & ~now).sum()) for was, now in kept]]
    columns = [*total(raw), *total(result), result[:, 3], *total(change), [len(t) for t in refs], [len(t) for t in fixed], *counts]
    lost = [_absorbed(_lacking(a, b), _lacking(a, c)) for a, b, c in zip(words, before, after, strict=True)]
    runs: list[list[dict]] = [[] for _ in refs]
    pair, length = steps.gaps()
    key, n = np.unique(pair << 32 | length, return_counts=True)
    for p, run, times in zip((key >> 32).tolist(), (key & 0xFFFFFFFF).tolist(), n.tolist(), strict=True):
        runs[p].append({"run": run, "times": times})
    return [*columns, *(list(zip(*lost, strict=True)) or [()] * len(ABSORBED))], runs


@cache
def _correction_numbers():
    runs = pa.list_(pa.struct([("run", pa.int64()), ("times", pa.int64())]))
    kind = pa.struct([*[(c, pa.int64()) for c in (*_SUMMED, *ABSORBED)], ("runs", runs)])

    @F.arrow_udf(from_arrow_type(kind))
    def numbers(ref: pa.Array, raw: pa.Array, sys: pa.Array) -> pa.Array:
        def rows(*texts: list[str]) -> pa.Array:
            columns, found = correction_columns(*texts)
            return pa.StructArray.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(found, runs)], fields=list(kind))

        return by_slices(rows, ref, raw, sys)

    return numbers


def correction(triples: DataFrame, catastrophic: float = 0.10, overedit: float = 2.0, heavy: float = 0.10, long_run: int = 20) -> DataFrame:
    """What a second stage changes: better, worse, how much, and how much it rewrites; each triple is looked at once."""
    texts = [F.coalesce(c, F.lit("")) for c in ("ref", "raw", "corrected")]
    docs = triples.select("pipeline", F.col("raw").isNull().alias("missing_raw"), F.col("corrected").isNull().alias("missing_corrected"), _correction_numbers()(*texts).alias("c"))
    docs = _rates(docs.select("pipeline", "missing_raw", "missing_corrected", "c.*"))
    # a row for the document, and one for each length of its runs, which has nothing else
    one = F.array(F.struct(F.lit(None).cast("long").alias("run"), F.lit(None).cast("long").alias("times")))
    numbers = [c for c in docs.columns if c not in ("pipeline", "runs")]
    docs = docs.select("pipeline", *numbers, F.inline(F.concat(one, "runs")))
    docs = docs.select("pipeline", "run", "times", F.col("run").isNull().alias("whole"), *[F.when(F.col("run").isNull(), F.col(c)).alias(c) for c in numbers])
    s, n = (lambda c: F.sum(c)), F.count_if("whole")
    share = lambda cond: F.count_if(cond) / n
    ccr = zero_safe_ratio(F.col("change_edits"), F.col("change_total"))
    out = docs.groupBy("pipeline").agg(
        n.alias("n_documents"),
        F.count_if("missing_raw").alias("n_missing_raw"),
        F.count_if("missing_corrected").alias("n_missing_corrected"),
        share(F.col("delta") < 0).alias("improvement_rate"),
        share(F.col("delta") > 0).alias("regression_rate"),
        share(F.col("delta") == 0).alias("no_change_rate"),
        F.count_if(F.col("delta") > catastrophic).alias("n_catastrophic"),
        F.avg("pcis").alias("pcis_macro"),
        F.percentile("pcis", 0.5).alias("pcis_median"),
        F.count_if(F.abs("pcis") > 1).alias("n_pcis_extreme"),
        safe_ratio(s("change_edits"), s("change_total")).alias("ccr"),
        safe_ratio(s("raw_edits"), s("raw_total")).alias("cmer_raw"),
        safe_ratio(s("sys_edits"), s("sys_total")).alias("cmer_corrected"),
        safe_ratio(s("sys_length"), s("ref_length")).alias("length_ratio"),
        F.count_if((F.col("cmer_raw") > 0) & (ccr / F.col("cmer_raw") > overedit)).alias("n_overedited"),
        safe_ratio(s("sys_insertions"), s("sys_total")).alias("char_ins_ratio"),
        F.count_if(zero_safe_ratio(F.col("sys_insertions"), F.col("sys_total")) > heavy).alias("n_hallucination_heavy"),
        s("correct_before").alias("n_correct_ocr_words"),
        s("undone").alias("n_over_normalized"),
        F.percentile("run", 0.5, F.col("times")).alias("edit_run_median"),
        F.max("run").alias("edit_run_max"),
        (s(F.when(F.col("run") > long_run, F.col("run") * F.col("times")).otherwise(0)) / s(F.col("run") * F.col("times"))).alias("edit_run_share"),
        *[s(c).alias(c) for c in ABSORBED],
    )
    last = ("edit_run_median", "edit_run_max", "edit_run_share", *ABSORBED)
    first = [c for c in out.columns if c not in last]
    out = out.withColumns({"pref_score": F.col("improvement_rate") - F.col("regression_rate"), "change_ratio": safe_ratio(F.col("ccr"), F.col("cmer_raw")), "over_normalization": safe_ratio(F.col("n_over_normalized"), F.col("n_correct_ocr_words"))})
    return _absorption_rates(out.select(*first, "pref_score", "change_ratio", "over_normalization", *last))


@F.arrow_udf(from_arrow_type(pa.struct([(c, pa.int64()) for c in ABSORBED])))
def absorbed(ref: pa.Array, raw: pa.Array, corrected: pa.Array) -> pa.Array:
    """Words of the reference, as multisets, that are missing before and after a correction."""
    out = []
    for texts in zip(ref.to_pylist(), raw.to_pylist(), corrected.to_pylist(), strict=True):
        want, had, has = ((t or "").split() for t in texts)
        out.append(dict(zip(ABSORBED, _absorbed(_lacking(want, had), _lacking(want, has)), strict=True)))
    return pa.array(out, pa.struct([(c, pa.int64()) for c in ABSORBED]))


def absorption(triples: DataFrame) -> DataFrame:
    """Words of the references that are missing before and after, counted within the document."""
    rows = triples.select("pipeline", absorbed("ref", "raw", "corrected").alias("a"))
    return _absorption_rates(rows.groupBy("pipeline").agg(*[F.sum(f"a.{c}").alias(c) for c in ABSORBED]))


def _absorption_rates(sums: DataFrame) -> DataFrame:
    return sums.withColumns({"correction_rate": safe_ratio(F.col("corrected"), F.col("errors_before")), "introduction_rate": safe_ratio(F.col("introduced"), F.col("errors_after")), "net_improvement": F.col("corrected") - F.col("introduced")})


def worst_regressions(triples: DataFrame, k: int = 10) -> DataFrame:
    docs = correction_by_doc(triples).filter("delta > 0").select("pipeline", "doc_id", "cmer_raw", "cmer_sys", "delta")
    return aggregate.top(docs, k, F.desc("delta"), F.col("doc_id"), by=["pipeline"])


# -- costs -----------------------------------------------------------------------------


def economics(usage: DataFrame, scores: DataFrame, tariffs: DataFrame, hourly: float = 0.08, seconds_per_error: float = 5.0) -> DataFrame:
    """Cost, errors, speed and fronts of each pipeline.

    ``tariffs``: pipeline, per_million_in, per_million_out, per_page; a pipeline without
    one is costed by machine time alone.
    """
    total = usage.groupBy("pipeline").agg(F.count(F.lit(1)).alias("pages"), F.sum("duration_seconds").alias("duration"), *[F.nullif(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)).alias(c) for c in ("tokens_in", "tokens_out")])
    errors = scores.filter("metric = 'cer'").groupBy("pipeline").agg(aggregate.micro_value().alias("cer"), F.sum(F.col("value") * F.coalesce("weight", F.lit(0))).alias("errors"))
    out = total.join(errors, "pipeline", "left").join(tariffs, "pipeline", "left")
    part = lambda a, b: F.coalesce(F.col(a) * F.col(b), F.lit(0.0))
    cost = F.col("duration") / 3600 * hourly + (part("tokens_in", "per_million_in") + part("tokens_out", "per_million_out")) / 1e6 + part("pages", "per_page")
    out = out.withColumn("cost", cost)
    return out.select(
        "pipeline",
        "pages",
        "duration",
        "cer",
        "errors",
        "cost",
        safe_ratio(F.col("pages") * 3600, F.col("duration")).alias("pages_per_hour"),
        safe_ratio(F.col("pages") * 3600, F.col("duration") + F.col("errors") * seconds_per_error).alias("effective_pages_per_hour"),
    )


def marginal_cost(costs: DataFrame) -> DataFrame:
    """Extra cost for each error that a dearer pipeline saves against the cheapest."""
    cheapest = costs.filter("cost is not null").agg(F.min(F.struct("cost", "pipeline", "errors")).alias("c"))
    both = costs.crossJoin(F.broadcast(cheapest))
    saved = F.col("c.errors") - F.col("errors")
    return both.select("pipeline", "cost", "errors", F.when((saved > 0) & (F.col("pipeline") != F.col("c.pipeline")), (F.col("cost") - F.col("c.cost")) / saved).alias("per_error_saved"))


# -- conformity ------------------------------------------------------------------------


def conformity(scores: DataFrame, view: str = "hipe", raw: str = "raw", heritage: str = "heritage") -> DataFrame:
    """Micro and macro error rates of a view, and how far the raw and heritage views are from it."""
    micro = aggregate.micro(scores, ["view", "pipeline", "metric"])
    value = lambda v, m, n: micro.filter((F.col("view") == v) & (F.col("metric") == m)).select("pipeline", F.col("value").alias(n))
    mine = scores.filter(F.col("view") == view)
    macro = mine.groupBy("pipeline").agg(*[F.avg(F.when(F.col("metric") == m, F.col("value"))).alias(f"{m}_macro") for m in ("cmer", "mer")], F.count_if((F.col("metric") == "cmer") & F.col("value").isNull()).alias("n_missing"))
    out = value(view, "cmer", "cmer_micro").join(value(view, "mer", "mer_micro"), "pipeline", "left").join(macro, "pipeline")
    out = out.join(value(raw, "cmer", "__raw"), "pipeline", "left").join(value(heritage, "cmer", "__her"), "pipeline", "left")
    return out.withColumns({"delta_norm": F.col("__raw") - F.col("cmer_micro"), "delta_heritage": F.col("__her") - F.col("cmer_micro")}).drop("__raw", "__her")


def entity_scores(counted: DataFrame, by: list[str]) -> DataFrame:
    """Precision, recall and F1 of counts (tp, fp, fn)."""
    out = counted.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    out = out.withColumns({"precision": zero_safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": zero_safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", f1(F.col("precision"), F.col("recall")))
