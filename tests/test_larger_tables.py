"""What makes work grow: how often functions run, what they are given, and what they hand on."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from marginalia.functions import align, batch_align, normalize, word_index
from marginalia.functions.align import distance, edit_blocks
from marginalia.functions.text import ascii_tokens, token_array
from marginalia.operators import analyses, layout


def test_near_and_straight_distances_take_no_wavefronts(monkeypatch):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("abcdEFGH mnru") for _ in range(rnd.randrange(100, 400))) for _ in range(60)]
    others = [[t.lower() for t in texts], [t.replace("u", "n").replace("rn", "m") for t in texts], [t[:50] + t[60:] for t in texts]]
    pairs = [(a, b) for side in others for a, b in zip(texts, side, strict=True)]
    monkeypatch.setattr(batch_align, "_Waves", None)
    found = batch_align.distances(batch_align.Pairs(*map(list, zip(*pairs, strict=True))))
    assert found.tolist() == [distance(list(a), list(b)) for a, b in pairs]


def test_straight_pairs_are_aligned_as_one_by_one(monkeypatch):
    monkeypatch.setattr(batch_align, "_Waves", None)
    texts = ["Aus dem Archiv", "abAB", "", "Q"]
    assert batch_align.edit_blocks(texts, [t.lower() for t in texts]) == [edit_blocks(t, t.lower()) for t in texts]


def test_token_functions_are_given_texts_and_run_once(spark):
    rows = [("text", p, d, r, h) for d, r in ((1, "en u En 3"), (2, "..."), (3, None)) for p, h in (("a", "en u"), ("b", "en n En"))]
    pairs = spark.createDataFrame(rows, "view string, pipeline string, doc_id int, ref string, hyp string")
    for build in (analyses.token_recall, analyses.complementarity_by_doc, analyses.complementarity, analyses.rare_token_recall):
        plan = build(pairs, tokens=ascii_tokens)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") + plan.count("MapInArrow") == 1, plan
    assert analyses.complementarity_by_doc(pairs, ascii_tokens).collect() == [("text", 1, 4, 3, 2)]
    for tokens in (ascii_tokens, token_array):
        assert {r.pipeline: (r.n, r.kept) for r in analyses.token_recall(pairs, tokens).collect()} == {"a": (4, 2), "b": (4, 2)}


def test_effects_of_profiles_hand_on_no_texts(spark):
    texts = spark.createDataFrame([(t,) for t in ("Été­ ſ", "plain", None)], "text string")
    out = texts.select(F.inline(normalize.effects(F.col("text"), [normalize.PROFILES["nfc"], normalize.PROFILES["no_diacritics"]])))
    assert "string" not in dict(out.drop("profile").dtypes).values()
    assert {(r.profile, r.changed, r.chars) for r in out.collect()} == {("nfc", True, 5), ("nfc", False, 5), ("nfc", None, None), ("no_diacritics", True, 5), ("no_diacritics", False, 5), ("no_diacritics", None, None)}


def test_words_in_place_are_not_filed(monkeypatch):
    monkeypatch.setattr(word_index.Vocabulary, "meeting", lambda self, left, right: pytest.fail("looked up") if len(left[0]) else [left[0][:0]] * 3)
    assert word_index.found_words([["ab", "corn", "x"], ["y"]], [["ab", "com", "x"], ["y", "z"]]) == [3, 1]


def test_tokens_are_aligned_once_and_counted_in_the_task(spark):
    rows = [("text", p, d, r, h) for d, (r, h) in enumerate([("Les roys sçavent", "les rois sçavent"), ("Du ROY, l’eau", "du roy, l’eau"), (None, "x"), ("le roy", "le")]) for p in ("a", "b")]
    pairs = spark.createDataFrame(rows, "view string, pipeline string, doc_id int, ref string, hyp string")
    for build in (analyses.modernisation, analyses.word_errors, analyses.confusions, analyses.taxonomy):
        plan = build(pairs)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan, plan
    out = {(r.token, r.n_total, r.n_modernised, r.place, tuple(map(tuple, r.variants))) for r in analyses.modernisation(pairs).filter("pipeline = 'a'").collect()}
    assert out == {("roys", 1, 1, 1, (("rois", 1),)), ("roy", 2, 1, 2, (("∅", 1),))}
    forms = analyses.token_forms(pairs.filter("pipeline = 'b'"), kept=True)
    assert {(r.token, r.form): r.n for r in forms.collect()} == {("les", None): 1, ("sçavent", None): 1, ("roys", "rois"): 1, ("du", None): 1, ("roy", None): 1, ("roy", "∅"): 1, ("l’eau", None): 1, ("le", None): 1}


def test_equal_blocks_of_repetitive_texts_are_found_in_one_sweep(monkeypatch):
    calls, longest = [], align._Matcher._longest
    monkeypatch.setattr(align._Matcher, "_longest", lambda self, *part: calls.append(part) or longest(self, *part))
    a = "Erteung " * 120
    b = a.replace("u", "n")
    found = batch_align.matches([a * 4, "same"], [b * 4, "same"])
    assert len(calls) < 20 and found[1] == [("equal", 0, 4, 0, 4)]
    assert "".join((a * 4)[i:i2] for op, i, i2, _, _ in found[0] if op == "equal") == "".join((b * 4)[j:j2] for op, _, _, j, j2 in found[0] if op == "equal")
    assert align.matching_blocks(a, b) == SequenceMatcher(None, a, b, autojunk=False).get_opcodes()


def test_runs_are_sought_by_a_sample_of_grams(monkeypatch):
    rnd, sizes, meeting = random.Random(4), [], batch_align._meeting
    monkeypatch.setattr(batch_align, "_meeting", lambda left, right: sizes.append(len(left)) or meeting(left, right))
    a = "".join(rnd.choice("abcdefghijklmnop ") for _ in range(4000))
    b = a[:1000] + "A" + a[1001:3000] + a[3002:]
    assert batch_align.matches([a], [b])[0] == SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    assert sizes[0] == 500 and sum(sizes[1:]) < 50


def test_entities_are_aligned_in_batches_and_only_where_both_sides_have_some(monkeypatch):
    monkeypatch.setattr(layout, "edit_blocks", None)
    seen, aligned = [], batch_align.edit_blocks
    monkeypatch.setattr(batch_align, "edit_blocks", lambda a, b: seen.append(len(a)) or aligned(a, b))
    one = lambda text, *spans: {"text": text, "entities": [{"label": "PER", "start": a, "end": b, "text": text[a:b]} for a, b in spans]}
    refs = [one("le Roy dort", (3, 6)), one("Anne", (0, 4)), one("rien"), one("Anne et Jean", (0, 4), (8, 12))]
    hyps = [one("oh le Roy dort", (6, 9)), one("anne"), one("Rien", (0, 4)), one("Anna et  Jean", (9, 13), (0, 4), (2, 3))]
    found = [[(r["kind"], r["text"]) for r in rows] for rows in layout.outcomes(refs, hyps)]
    assert seen == [2] and found == [[("tp", "Roy")], [("fn", "Anne")], [("fp", "Rien")], [("tp", "Anne"), ("tp", "Jean"), ("fp", "n")]]


def test_lines_of_a_batch_are_measured_together(monkeypatch):
    calls, distances = [], batch_align.distances
    monkeypatch.setattr(batch_align, "distances", lambda pairs: calls.append(len(pairs)) or distances(pairs))
    refs, hyps = ["un\ndeux\n\ntrois", "un", "", "\nx"], ["un\n\ntroiz", "um", "x", "y\nx"]
    rows = analyses._line_rates(refs, hyps)
    assert [[round(r["cer"], 6) for r in doc] for doc in rows] == [[0.0, 1.0, 0.0, 0.2], [0.5], [], [1.0, 0.0]] and len(calls) == 1
    assert [r["place"] for r in rows[0]] == [0.0, 0.25, 0.5, 0.75]


@pytest.mark.parametrize("seed", range(3))
def test_distances_of_far_pairs_are_taken_together(seed, monkeypatch):
    rnd = random.Random(seed)
    text = lambda n: "".join(rnd.choice("abcdefgh ijk·é") for _ in range(n))
    sizes = [1, 63, 64, 65, 128, 129, 200, 310]
    left, right = ([text(rnd.choice(sizes)) for _ in range(80)] for _ in range(2))
    want = [distance(a, b) for a, b in zip(left, right, strict=True)]
    monkeypatch.setattr(batch_align, "distance", None)
    monkeypatch.setattr(batch_align, "CELLS", 4_000_000 >> 4 * seed)
    monkeypatch.setattr(batch_align, "FEW", 1)
    if seed:
        monkeypatch.setattr(batch_align, "_near", lambda middles, done: (done[:0], done[:0]))
    assert batch_align.distances(batch_align.Pairs(left, right)).tolist() == want
