"""Alignments and word searches of whole batches against those of one pair at a time."""

import random
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginalia.functions import align, batch_align, scanners, word_index
from marginalia.operators import analyses, layout, metrics, reports
from marginalia.plans import catalogue


def text(rng, letters, n):
    return "".join(rng.choice(letters) for _ in range(n))


def spoilt(rng, x, letters, times):
    x = list(x)
    for _ in range(times):
        kind, at = rng.random(), rng.randrange(len(x) + 1)
        if kind < 0.35 or at == len(x):
            x.insert(at, rng.choice(letters))
        elif kind < 0.7:
            del x[at]
        else:
            x[at] = rng.choice(letters)
    return "".join(x)


def batch(seed):
    """Near and far pairs, empty ones, texts that repeat themselves."""
    rng = random.Random(seed)
    left, right = [], []
    for _ in range(rng.choice([1, 7, 40])):
        letters = rng.choice(["ab", "abcdefgh", "abc def", "é🙂ſx "])
        a = text(rng, letters, rng.choice([0, 1, 2, 5, 20, 60, 150]))
        b = spoilt(rng, a, letters, rng.choice([0, 1, 3, 10, 30])) if rng.random() < 0.8 else text(rng, letters, rng.choice([0, 1, 7, 30]))
        left.append(a)
        right.append(b)
    return left, right


@pytest.mark.parametrize("seed", range(25))
def test_edits_of_a_batch_are_those_of_each_pair(seed, monkeypatch):
    if seed % 3 == 0:
        monkeypatch.setattr(batch_align, "TIERS", (2, 5))
    if seed % 4 == 0:
        monkeypatch.setattr(batch_align, "WAVES", 50)
    left, right = batch(seed)
    for a, b in ((left, right), ([x.split() for x in left], [x.split() for x in right])):
        assert batch_align.edit_blocks(a, b) == [align.edit_blocks(x, y) for x, y in zip(a, b, strict=True)]
    assert batch_align.distances(batch_align.Pairs(left, right)).tolist() == [align.distance(x, y) for x, y in zip(left, right, strict=True)]
    steps = batch_align.edits(batch_align.Pairs(left, right))
    assert list(map(tuple, steps.counts().tolist())) == [align.counts(align.edit_blocks(x, y)) for x, y in zip(left, right, strict=True)]
    for side in (0, 1):
        each = [align.positions_kept([(op, *((i, i2, j, j2) if side == 0 else (j, j2, i, i2))) for op, i, i2, j, j2 in align.edit_blocks(x, y)]) for x, y in zip(left, right, strict=True)]
        assert steps.kept(side).tolist() == np.concatenate(each).tolist()


def test_edits_far_apart_and_none():
    rng = random.Random(3)
    left, right = [text(rng, "abcd", 900), "x" * 700, ""], [text(rng, "abcd", 700), "y" * 900, ""]
    assert batch_align.edit_blocks(left, right) == [align.edit_blocks(x, y) for x, y in zip(left, right, strict=True)]
    assert batch_align.distances(batch_align.Pairs(left, right)).tolist() == [align.distance(x, y) for x, y in zip(left, right, strict=True)]
    assert batch_align.edit_blocks([], []) == [] and batch_align.matches([], []) == []


@pytest.mark.parametrize("seed", range(25))
def test_matches_of_a_batch_are_those_of_the_standard_matcher(seed, monkeypatch):
    if seed % 3 == 0:
        monkeypatch.setattr(batch_align, "HITS", 40)
    if seed % 4 == 0:
        monkeypatch.setattr(batch_align, "TOGETHER", 200)
    left, right = batch(seed + 100)
    for a, b in ((left, right), ([x.split() for x in left], [x.split() for x in right])):
        assert batch_align.matches(a, b) == [SequenceMatcher(None, x, y, autojunk=False).get_opcodes() for x, y in zip(a, b, strict=True)]


def test_new_grams_are_counted_by_pair():
    left, right = batch(7)
    grams = lambda t: [t[i : i + 3] for i in range(len(t) - 2)]
    n, new = batch_align.new_grams(batch_align.Pairs(left, right))
    assert n.tolist() == [len(grams(b)) for b in right]
    assert new.tolist() == [sum(g not in grams(a) for g in grams(b)) for a, b in zip(left, right, strict=True)]


def greedy(ref, hyp):
    """Words of the reference that take the first unused word within two edits."""
    used, found = set(), 0
    for word in ref:
        for n, other in enumerate(hyp):
            if n not in used and align.distance(word, other) <= 2:
                used.add(n)
                found += 1
                break
    return found


@pytest.mark.parametrize("seed", range(12))
def test_found_words_are_those_of_the_greedy_rule(seed, monkeypatch):
    rng = random.Random(seed)
    if seed % 2:
        monkeypatch.setattr(word_index, "TOGETHER", 10)
    words = [text(rng, "abc", rng.choice([1, 2, 3, 4, 6, 22, 23, 24, 25, 26, 40, 130])) for _ in range(10)]
    refs = [[rng.choice(words) for _ in range(rng.randrange(14))] for _ in range(15)]
    hyps = [[spoilt(rng, rng.choice(words), "abcd", rng.randrange(4)) or "a" for _ in range(rng.randrange(14))] for _ in range(15)]
    assert word_index.found_words(refs, hyps) == [greedy(a, b) for a, b in zip(refs, hyps, strict=True)]


def test_words_meet_by_forms_not_all_with_all():
    rng = random.Random(1)
    words = word_index.Vocabulary()
    a, b = (np.unique(words.coded([text(rng, "abcdefghijklmnopqrstuvwxyz", rng.randint(7, 12)) for _ in range(1500)])) for _ in range(2))
    words.filed()
    line, left, _ = words.meeting((np.zeros(len(a), np.int64), a), (np.zeros(len(b), np.int64), b))
    assert len(left) < 0.01 * len(a) * len(b) and len(line) == len(left)


def test_only_what_is_asked_for_is_measured(spark):
    pairs = spark.createDataFrame([("v", "p", 1, "une ſi belle", "une si bele"), ("v", "p", 2, None, "x"), ("v", "p", 3, "", "")], "view string, pipeline string, doc_id long, ref string, hyp string")
    wide = metrics.measured(pairs, {"marks"})
    assert wide.schema["chars"].dataType.names == ["marks", "marks_kept"]
    assert metrics.measured(pairs, {"found"}).schema["words"].dataType.names == ["found", "n"]
    rows = {(r.doc_id, r.metric): (r.value, r.weight) for r in metrics.score(pairs, ("wer", "searchability", "cmer", "air", "hcpr", "hallucination"), metrics.registry([metrics.HCPR])).collect()}
    assert rows[1, "wer"] == (2 / 3, 3) and rows[1, "searchability"] == (1.0, 3) and rows[1, "cmer"] == (2 / 12, 12)
    assert rows[1, "hcpr"] == (0.0, 1) and rows[2, "cmer"] == (None, None) and rows[3, "wer"] == (0.0, 0)
    assert rows[1, "hallucination"][1] == len("une si bele") - 2


def test_batches_are_cut_and_nulls_kept(monkeypatch):
    monkeypatch.setattr(metrics, "TOGETHER", 20)
    texts = ["abc", None, "é" * 50, "", "xyz", "abc"]
    sizes = metrics.by_slices(lambda a, b: pa.array([len(x) + len(y) for x, y in zip(a, b, strict=True)], pa.int64()), pa.array(texts), pa.array(texts[::-1]))
    assert sizes.to_pylist() == [6, None, 50, 50, None, 6]
    none = metrics.by_slices(lambda a, b: pa.array([1 for _ in a], pa.int64()), pa.array([None, "x"], pa.string()), pa.array(["x", None], pa.string()))
    assert none.to_pylist() == [None, None]


def test_corrections_of_a_batch(spark):
    rng = random.Random(9)
    refs = [text(rng, "abc  d", 60) for _ in range(30)]
    raws, fixed = ([spoilt(rng, x, "abc d", n) for x in refs] for n in (8, 3))
    for ref, raw, sys, row in zip(refs, raws, fixed, analyses.correction_rows(refs, raws, fixed), strict=True):
        h, s, d, i = align.counts(align.edit_blocks(ref, sys))
        assert (row["sys_edits"], row["sys_total"], row["sys_insertions"]) == (s + d + i, h + s + d + i, i)
        assert row["raw_edits"] == align.distance(ref, raw) and row["change_edits"] == align.distance(raw, sys)
        assert row["runs"] == align.edit_runs(align.edit_blocks(ref, sys))
        assert len(row["samples"]) == row["undone"] <= row["correct_before"] <= len(ref.split())


def test_signs_are_shared_out_by_text():
    left, right = ["éa", "", "ñ☉ꝑ"], ["ea", "x", "ñꝑ"]
    marks, kept = metrics.char_measures(left, right, ["marks"])
    assert marks.tolist() == [1, 0, 1] and kept.tolist() == [0, 0, 1]
    glyphs = metrics.char_measures(left, right, ["glyphs"])[0].tolist()
    assert glyphs == [sum(map(scanners.is_medieval_glyph, t)) for t in left]


def in_place(seed):
    """Texts whose letters are replaced one by one: by letters they lack (as capitals), by ones they have, by ones of neither side."""
    rng = random.Random(seed)
    left, right = [], []
    for _ in range(200):
        a = text(rng, rng.choice(["abAB", "abc ABC", "aBbb, .", "é🙂ſx,"]), rng.choice([0, 1, 4, 9, 16, 40]))
        left.append(a)
        right.append(rng.choice([str.lower, str.upper, lambda x: x.replace(",", "·"), lambda x: x.replace("B", "b").replace("A", "b")])(a))
    return left, right


@pytest.mark.parametrize("seed", range(8))
def test_places_are_matched_as_the_standard_matcher_does(seed, monkeypatch):
    if seed % 2:
        monkeypatch.setattr(batch_align, "CELLS", 40)
    left, right = in_place(seed)
    for a, b in ((left, right), ([list(x) for x in left], [list(x) for x in right])):
        assert batch_align.matches(a, b) == [SequenceMatcher(None, x, y, autojunk=False).get_opcodes() for x, y in zip(a, b, strict=True)]


def test_a_segment_that_is_there_earlier_is_not_matched_in_place():
    # "a" between the capitals is first in "Ba", whose B becomes a
    left, right = ["xyBaCzz", "ba,ba", ""], ["xyaaczz", "ba·ba", ""]
    assert not batch_align._first("xyaaczz", [0, 3, 5], [2, 4, 7])
    assert batch_align._in_place(batch_align.Pairs(left, right))[0].tolist() == [False, True, False]
    assert batch_align.matches(left, right) == [SequenceMatcher(None, x, y, autojunk=False).get_opcodes() for x, y in zip(left, right, strict=True)]


def test_no_runs_are_sought_where_places_suffice(monkeypatch):
    rng = random.Random(2)
    left = [". ".join(text(rng, "abcdefghijklmnopqrst, ", 40).capitalize() for _ in range(20)) for _ in range(30)]
    monkeypatch.setattr(batch_align, "_searched", None)
    for right in (list(map(str.lower, left)), [x.replace(",", "·") for x in left]):
        assert all("".join(a[i:i2] for op, i, i2, _, _ in m if op == "equal") == "".join(x for x, y in zip(a, b, strict=True) if x == y) for a, b, m in zip(left, right, batch_align.matches(left, right), strict=True))


@pytest.mark.parametrize("seed", range(8))
def test_confusions_of_a_batch_are_those_of_each_pair(seed):
    both = [batch(seed + 50), in_place(seed)]
    left, right = (sum((x[side] for x in both), []) for side in (0, 1))
    groups = [n % 3 for n in range(len(left))]
    found = {(g, *row): n for g, row, n in analyses._confusions(groups, left, right)}
    want = {}
    for g, a, b in zip(groups, left, right, strict=True):
        for op, i, i2, j, j2 in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
            if op == "replace":
                for x, y in zip(a[i:i2], b[j:j2]):
                    want[g, x, y] = want.get((g, x, y), 0) + 1
    assert found == want


def test_repetitive_texts_are_resolved_in_few_sweeps(monkeypatch):
    sweeps, after = [], batch_align._after
    monkeypatch.setattr(batch_align, "_after", lambda *runs: sweeps.append(len(runs[0])) or after(*runs))
    left, right = ["thun er " * 60, "ab1cd2" * 40], ["hn er" * 60, "ab3cd45" * 40]
    assert batch_align.matches(left, right) == [SequenceMatcher(None, x, y, autojunk=False).get_opcodes() for x, y in zip(left, right, strict=True)]
    assert len(sweeps) < 25


@pytest.mark.parametrize("seed", range(12))
def test_runs_taken_together_are_those_taken_in_turn(seed, monkeypatch):
    rng = random.Random(seed)
    if seed % 2:
        monkeypatch.setattr(batch_align, "SMALL", 0)
    left = ["".join(rng.choice(["un ", "the ", "x", "rn", "ab"]) for _ in range(rng.choice([5, 40, 120]))) for _ in range(60)]
    right = [x.replace("u", "n").replace(" th", " ") if rng.random() < 0.5 else x[len(x) // 3 :].replace("rn", "m") + x[: len(x) // 3] for x in left]
    assert batch_align.matches(left, right) == [SequenceMatcher(None, x, y, autojunk=False).get_opcodes() for x, y in zip(left, right, strict=True)]


def test_only_special_signs_are_escaped_and_marks_are_put_by_pair(spark):
    rows = spark.createDataFrame([(1, "a,b", "a·b"), (2, "a<b, \"c'", "a<b· \"c'"), (3, "", ""), (4, None, "x"), (5, "ab", "")], "n int, ref string, hyp string")
    found = {r.n: r.m and tuple(r.m) for r in rows.select("n", reports.marked_texts("ref", "hyp").alias("m")).collect()}
    assert found == {1: ("a<del>,</del>b", "a<ins>·</ins>b"), 2: ("a&lt;b<del>,</del> &quot;c&#x27;", "a&lt;b<ins>·</ins> &quot;c&#x27;"), 3: ("", ""), 4: None, 5: ("<del>ab</del>", "")}


def engines(seed, size=60):
    """Lines as engines spoil them: joined letters, confused ones, lost beginnings of words."""
    rng = random.Random(seed)
    words = ["the", "thin", "run", "corn", "urn", "unum", "horn", "a", "Nun", "then", "burnt", "though"]
    left = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 6, 30]))) for _ in range(size)]
    ways = [lambda x: x.replace("rn", "m"), lambda x: x.replace("u", "n").replace(" th", " "), lambda x: x.replace("m", "rn").replace("n", "nn"), str.lower]
    return left, [rng.choice(ways)(x) for x in left]


@pytest.mark.parametrize("seed", range(12))
def test_pairs_by_surplus_are_aligned_as_each_pair_is(seed, monkeypatch):
    if seed % 2:
        monkeypatch.setattr(batch_align, "ALONE", 0)
    if seed % 3 == 0:
        monkeypatch.setattr(batch_align, "DENSE", 2)
    if seed % 4 == 0:
        monkeypatch.setattr(batch_align, "CELLS", 300)
    left, right = (sum(x, []) for x in zip(engines(seed), batch(seed + 300), in_place(seed), strict=True))
    for a, b in ((left, right), ([x.split() for x in left], [x.split() for x in right])):
        want = [align.edit_blocks(x, y) for x, y in zip(a, b, strict=True)]
        assert batch_align.edit_blocks(a, b) == want
        assert batch_align.distances(batch_align.Pairs(a, b)).tolist() == [sum(align.counts(x)[1:]) for x in want]


def test_no_wavefronts_where_one_side_has_more_items(monkeypatch):
    left = ["burnt corn and the thin horn " * n for n in range(1, 80)]
    monkeypatch.setattr(batch_align, "_Waves", None)
    monkeypatch.setattr(batch_align, "_steps", None)
    for right in ([x.replace("rn", "m") for x in left], [x.replace("u", "n").replace(" th", " ") for x in left]):
        assert batch_align.edit_blocks(left, right) == [align.edit_blocks(x, y) for x, y in zip(left, right, strict=True)]


@pytest.mark.parametrize("seed", range(6))
def test_new_grams_are_sought_outside_equal_runs(seed, monkeypatch):
    if seed % 2:
        monkeypatch.setattr(batch_align, "SOUGHT", 1)
    left, right = (sum(x, []) for x in zip(engines(seed), batch(seed), strict=True))
    pairs = batch_align.Pairs(left, right)
    for found, want in zip(batch_align.new_grams(pairs, batch_align.edits(pairs)), batch_align.new_grams(pairs), strict=True):
        assert found.tolist() == want.tolist()
    assert [x.tolist() for x in metrics.char_measures(left, right, ["chars", "grams"])] == [
        *map(list, zip(*(align.counts(align.edit_blocks(a, b)) for a, b in zip(left, right, strict=True)), strict=True)),
        *(x.tolist() for x in batch_align.new_grams(pairs)),
    ]


@pytest.mark.parametrize("seed", range(8))
def test_word_measures_are_those_of_each_pair(seed, monkeypatch):
    monkeypatch.setattr(word_index, "ALL", (0, 40, 20_000)[seed % 3])
    monkeypatch.setattr(word_index, "BESIDE", (10, 1_000_000)[seed % 2])
    left, right = (sum(x, []) for x in zip(engines(seed), batch(seed), strict=True))
    *counts, found, n = metrics.word_measures(left, right, ["words", "found"])
    words = [(a.split(), b.split()) for a, b in zip(left, right, strict=True)]
    assert list(zip(*(c.tolist() for c in counts), strict=True)) == [align.counts(align.edit_blocks(a, b)) for a, b in words]
    assert found == [greedy(a, b) for a, b in words] and n == [len(a) for a, _ in words]


def test_short_lines_are_not_filed_by_forms(monkeypatch):
    monkeypatch.setattr(word_index.Vocabulary, "filed", None)
    assert word_index.found_words([["though", "ab", "tough", "xyzzy"]], [["ongh", "ab", "tough", "qqqqq"]]) == [3]


def test_forms_are_measured_once_where_they_change_nothing(spark):
    rows = [("v", "p", 1, "corn", "com"), ("v", "p", 2, "café ſ", "café s"), ("v", "p", 3, None, "x"), ("v", "p", 4, "a​b", "ab"), ("v", "p", 5, "", "x")]
    pairs = spark.createDataFrame(rows, "view string, pipeline string, doc_id long, ref string, hyp string")
    names = ("cer", "cer_diplo", "cmer")
    found = {(r.doc_id, r.metric): (r.value, r.weight) for r in metrics.score(pairs, names).collect()}
    for name in ("cer", "cer_diplo"):
        assert {k: v for k, v in found.items() if k[1] == name} == {(r.doc_id, r.metric): (r.value, r.weight) for r in metrics.score(pairs, (name,)).collect()}
    assert found[1, "cer"] == found[1, "cer_diplo"] == (0.5, 4) and found[2, "cer_diplo"] == (0.0, 6) and found[3, "cer_diplo"] == (None, None) and found[4, "cer_diplo"] == (0.0, 2)


@pytest.mark.parametrize("seed", range(4))
def test_corrections_in_columns_are_those_in_rows(seed):
    rng = random.Random(seed)
    refs, raws = (sum(x, []) for x in zip(engines(seed), batch(seed), strict=True))
    fixed = [rng.choice([x, y, x.replace("u", "n"), spoilt(rng, x, "ab the", 3)]) for x, y in zip(refs, raws, strict=True)]
    columns, runs = analyses.correction_columns(refs, raws, fixed)
    rows = analyses.correction_rows(refs, raws, fixed)
    names = [*analyses._SUMMED, *analyses.ABSORBED]
    for n, row in enumerate(rows):
        found = {c: int(x[n]) for c, x in zip(names, columns, strict=True)}
        assert {c: found[c] for c in analyses._SUMMED} == {c: row[c] for c in analyses._SUMMED}
        assert sorted(r["run"] for r in runs[n] for _ in range(r["times"])) == sorted(row["runs"])
        want, had, has = (Counter(t[n].split()) for t in (refs, raws, fixed))
        gaps = [(max(0, k - had[w]), max(0, k - has[w])) for w, k in want.items()]
        assert [found[c] for c in analyses.ABSORBED] == [sum(f(a, b) for a, b in gaps) for f in (lambda a, b: a, lambda a, b: b, lambda a, b: max(0, a - b), lambda a, b: max(0, b - a), min)]
    assert [len(x) for x in analyses.correction_columns([], [], [])[0]] == [0] * len(names)


def test_a_correction_is_one_pass_over_the_triples(spark):
    rows = [("p", "a b c", "A b c", "a b d"), ("p", "x", "x", "x"), ("p", "une rue", None, "nne rne"), ("q", "y", "y", None)]
    triples = spark.createDataFrame([(p, str(n), n, *t) for n, (p, *t) in enumerate(rows)], "pipeline string, doc_id string, doc_pos int, ref string, raw string, corrected string")
    out = analyses.correction(triples)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("numbers(") == 1
    p, q = out.orderBy("pipeline").collect()
    assert (p.n_documents, p.n_missing_raw, p.n_missing_corrected, p.no_change_rate) == (3, 1, 0, 2 / 3)
    assert (p.edit_run_median, p.edit_run_max, p.edit_run_share) == (1.0, 1, 0.0) and (q.edit_run_max, q.n_missing_corrected, q.errors_after) == (1, 1, 1)
    none = analyses.correction(triples.filter("doc_id = '1'")).first()
    assert (none.edit_run_median, none.edit_run_max, none.edit_run_share, none.n_documents) == (None, None, None, 1)


@pytest.mark.parametrize("times", [1, 400])
def test_pairs_of_one_length_take_no_wavefronts_where_all_places_are_substituted(monkeypatch, times):
    # n is on both sides where the sides differ, so nothing is known by counting
    ref = "Nun und Nur unter Umen an der Burg " * times
    monkeypatch.setattr(batch_align, "_Waves", None)
    monkeypatch.setattr(batch_align, "_steps", None)
    for left, right in (([ref.lower()], [ref.replace("u", "n")]), ([ref.lower()] * 20, [ref.replace("u", "n")] * 20)) if times == 1 else (([ref.lower()], [ref.replace("u", "n")]),):
        off = sum(x != y for x, y in zip(left[0], right[0], strict=True))
        assert batch_align.edits(batch_align.Pairs(left, right)).counts()[0].tolist() == [len(ref) - off, off, 0, 0]
        if times == 1:
            assert batch_align.edit_blocks(left, right) == [align.edit_blocks(x, y) for x, y in zip(left, right, strict=True)]


@pytest.mark.parametrize("seed", range(10))
def test_entities_counted_in_columns_are_those_of_each_pair(seed, monkeypatch):
    if seed % 2:
        monkeypatch.setattr(layout, "ALL", 6)
        monkeypatch.setattr(layout, "BESIDE", 5)
    rng = random.Random(seed)
    refs, hyps = (sum(x, []) for x in zip(engines(seed), batch(seed), strict=True))
    hyps = [x if rng.random() < 0.3 else y for x, y in zip(refs, hyps, strict=True)]

    def side(t):
        spans = [(rng.choice(["PER", "per", "LOC", "Straße", "STRASSE"]), a, a + rng.choice([0, 1, 3, 9])) for a in (rng.randrange(len(t) + 3) for _ in range(rng.choice([0, 1, 3, 12])))]
        return rng.choice([{"text": t, "entities": [{"label": x, "start": a, "end": b, "text": t[a:b]} for x, a, b in spans]}] * 9 + [None])

    left, right = ([side(t) for t in texts] for texts in (refs, hyps))
    kind = pa.struct([("text", pa.string()), ("entities", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())])))])
    a, b = (pa.array([None, *x, None], kind).slice(1, len(x)) for x in (left, right))
    found = [{r["label"]: [r[k] for k in layout.KINDS] for r in rows} for rows in layout._label_counts(a, b).to_pylist()]
    want = []
    for x, y in zip(left, right, strict=True):
        counted = {}
        for r in layout.entity_outcomes(x, y or {"text": "", "entities": []}) if x else ():
            counted.setdefault(r["label"], [0, 0, 0])[layout.KINDS.index(r["kind"])] += 1
        want.append(counted)
    assert found == want
    assert layout._label_counts(a.slice(0, 0), b.slice(0, 0)).to_pylist() == []


def test_entities_of_texts_are_not_turned_into_rows(spark, tiny, monkeypatch):
    rows = spark.createDataFrame([("p", "Jean va", "Jean va")], "pipeline string, ref string, hyp string")
    span = F.array(F.struct(F.lit("PER").alias("label"), F.lit(0).alias("start"), F.lit(4).alias("end"), F.lit("Jean").alias("text")))
    pairs = rows.select("pipeline", *[F.struct(F.col(c).alias("text"), span.alias("entities")).alias(c) for c in ("ref", "hyp")])
    assert [tuple(r) for r in layout.entity_counts(pairs, ["pipeline"]).collect()] == [("p", "PER", 1, 0, 0)]
    plan = catalogue.queries()["entity_scores"](spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("position(") == 2
