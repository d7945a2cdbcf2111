"""Pure functions: alignment, normalisation, scanners, tests of ranks."""

import math
import random
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.functions import align, scanners, word_index
from marginalia.functions.normalize import PROFILES, newline_preserved, profile_from
from marginalia.operators import statistics
from marginalia.operators.layout import box_overlap, entity_outcomes, image_measures, matched_boxes, position_map

TEXT = st.text(alphabet="abcé ", max_size=30)


def matrix(a, b):
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    return d


def path(a, b):
    d, i, j, out = matrix(a, b), len(a), len(b), []
    while i or j:
        if i and j and a[i - 1] == b[j - 1]:
            step = "equal"
        elif i and j and d[i][j] == d[i - 1][j - 1] + 1:
            step = "replace"
        elif i and d[i][j] == d[i - 1][j] + 1:
            step = "delete"
        else:
            step = "insert"
        out.append(step)
        i, j = i - (step != "insert"), j - (step != "delete")
    return out[::-1]


@given(TEXT, TEXT)
@settings(max_examples=200, deadline=None)
def test_alignment_is_that_of_the_matrix(a, b):
    assert align.distance(a, b) == matrix(a, b)[-1][-1]
    assert align._steps(*align.coded(a, b)) == path(a, b)
    blocks = align.edit_blocks(a, b)
    h, s, d, i = align.counts(blocks)
    assert s + d + i == matrix(a, b)[-1][-1] and h + s + d == len(a) and h + s + i == len(b)
    assert all(a[i:i2] == b[j:j2] for op, i, i2, j, j2 in blocks if op == "equal")


def test_long_sequences_are_halved(monkeypatch):
    monkeypatch.setattr(align, "BITS", 500)
    rng = random.Random(2)
    for _ in range(60):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 120))) for _ in range(2))
        h, s, d, i = align.counts(align.edit_blocks(a, b))
        assert s + d + i == matrix(a, b)[-1][-1]


def test_blocks_runs_and_positions():
    blocks = align.edit_blocks("le chat noir", "le chien noir")
    assert align.edit_runs(blocks) == [3]
    assert align.positions_kept(align.edit_blocks("abc", "xbc")).tolist() == [False, True, True]
    assert align.counts(align.edit_blocks([], ["a"])) == (0, 0, 0, 1)
    assert align.matching_blocks("ab", "ab") == SequenceMatcher(None, "ab", "ab").get_opcodes()


@pytest.mark.parametrize(
    ("profile", "text", "expected"),
    [
        ("nfc", "é", "é"),
        ("nfkc", "ﬁn", "fin"),
        ("caseless", "Straße", "strasse"),
        ("minimal", "aſſez", "assez"),
        ("no_diacritics", "éàü", "eau"),
        ("flat_text", " a \n\t b ", "a b"),
        ("keep_line_breaks", "a  b \n c\n\n", "a b\nc"),
        ("no_punctuation", "a,b.", "a b "),
        ("no_apostrophes", "l'eau d’or", "leau dor"),
        ("medieval_french", "uy", "vi"),
        ("early_modern_french", "ỹ&", "ynet"),
        ("medieval_latin", "ꝗ", "que"),
        ("hipe", "Œuvre—\nſch aͤ, x_y", "oeuvresch ä x y"),
        ("heritage", "Œuvre aͤ", "œuvre ä"),
        ("nfc", "a​b­c\td", "abc\td"),
    ],
)
def test_profiles(profile, text, expected):
    assert PROFILES[profile].apply(text) == expected


def test_profiles_from_settings():
    assert len(PROFILES) == 14
    assert profile_from({"nfc": False, "diplomatic": {"a": "b", "ab": "x"}}).apply("aba") == "xb"
    assert profile_from({"caseless": True, "exclude_chars": ["Q", "xx"]}).apply("aqQ") == "a"
    with pytest.raises(ValueError, match="unknown"):
        profile_from({"nope": 1})
    with pytest.raises(ValueError):
        profile_from({"whitespace": "odd"})
    assert newline_preserved(None) and not newline_preserved(PROFILES["hipe"]) and not newline_preserved(None, "\n")


@pytest.mark.parametrize(("text", "value"), [("XIV", 14), ("viij", 8), ("IIII", 4), ("IIIII", None), ("IC", None), ("VV", None), ("MCMXC", 1990), ("", None), ("abc", None), ("xiV", 14)])
def test_roman_values(text, value):
    assert scanners.roman_value(text) == value


def test_numeral_status():
    status = lambda form, text: scanners.numeral_status(form, scanners.roman_value(form), text)
    assert [status("XIV", t) for t in ("le XIV.", "le xiv", "an 14", "an 140", "XIVe")] == ["strict_preserved", "case_changed", "converted_to_arabic", "lost", "lost"]
    assert status("viij", "viii") == "j_dropped"


def test_sequences():
    found = scanners.sequences("En 1515, fol. 12 r; 3,5 livres, l'an III et 2 Sols. an de grâce MCCC")
    assert ("year", "1515", "1515") in found and ("foliation", "fol. 12 r", "12r") in found
    assert {k for c, _, k in found if c == "currency"} == {"3.5|livre", "2|sol"}
    assert {k for c, _, k in found if c == "regnal"} == {"3", "1300"}
    assert scanners.sequences("3 ſols")[0][2] == "3|sol"
    rows = {r["category"]: r for r in scanners.sequence_counts("1515 1515 fol. 3", "1515 f. 3")}
    assert (rows["year"]["n_total"], rows["year"]["n_strict"], rows["year"]["lost"]) == (2, 1, ["1515"])
    assert (rows["foliation"]["n_strict"], rows["foliation"]["n_value"]) == (0, 1)


def test_marks():
    row = {r["marker"]: r for r in scanners.abbreviation_counts("ꝑ ꝑ ⁊", "ꝑ per and")}
    assert (row["ꝑ"]["n_total"], row["ꝑ"]["n_strict"], row["ꝑ"]["n_expanded"]) == (2, 1, 2) and row["⁊"]["n_expanded"] == 0
    row = {r["marker"]: r for r in scanners.early_print_counts("ſi ſon & ã", "si ſon & ã")}
    assert (row["long_s"]["n_total"], row["long_s"]["n_strict"]) == (2, 1) and row["nasal_tildes"]["n_strict"] == 1
    assert scanners.early_print_counts("plain", "x") == []
    assert scanners.archive_marks("M. Dr S.A.R. arr.acher arr. pp. 3") == {"M.": 1, "Dr": 1, "S.A.R.": 1, "arr.": 1, "pp.": 1}
    row = {r["marker"]: r for r in scanners.archive_counts("Mme X, vol. 2", "Madame X, vol. 2")}
    assert (row["civility_titles"]["n_strict"], row["civility_titles"]["n_expanded"], row["bibliographic"]["n_strict"]) == (0, 1, 1)


@pytest.mark.parametrize(("a", "b", "name"), [("Le", "le", "case"), ("été", "ete", "diacritic"), ("œuf", "oeuf", "ligature"), ("modern", "modem", "visual"), ("chat", "chien", "other")])
def test_word_pair_classes(a, b, name):
    assert scanners.word_pair_class(a, b) == name


@given(st.text("ab", max_size=6), st.text("ab", max_size=6))
@settings(deadline=None)
def test_words_within_two_edits(a, b):
    assert word_index._within(a, b) == (align.distance(a, b) <= 2)


def test_found_words_take_the_first_free():
    assert word_index.found_words([["chat", "chat", "xyzzy"], []], [["chut", "abcdef"], ["a"]]) == [1, 0]
    assert word_index.found_words([], []) == []


def test_critical_values():
    assert statistics.critical_value(3) == (2.343, False)
    assert statistics.critical_value(22)[0] == pytest.approx(3.5896)
    value, beyond = statistics.critical_value(60)
    assert beyond and value == pytest.approx(3.945 + 10 * (3.945 - 3.858) / 10)


def test_tail_of_chi_square():
    assert statistics.chi_square_tail(5.991464547, 2) == pytest.approx(0.05, rel=1e-8)
    assert statistics.chi_square_tail(7.814727903, 3) == pytest.approx(0.05, rel=1e-8)
    assert statistics.chi_square_tail(30.0, 4) == pytest.approx(4.894e-6, rel=1e-3)
    assert statistics.chi_square_tail(0.0, 3) == 1.0


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1000])
def test_draws_are_those_of_the_standard_library(n):
    import random

    import numpy as np

    one = random.Random(42)
    assert np.concatenate([x for x, _ in zip(statistics.draws(n, 42, 500), range(4))])[:300].tolist() == [one.randint(0, n - 1) for _ in range(300)]
    xs, one = np.arange(n) / 7, random.Random(5)
    assert statistics.resampled_means(xs, 20, 5).tolist() == pytest.approx([sum(xs[one.randint(0, n - 1)] for _ in range(n)) / n for _ in range(20)])


def test_tail_of_signed_ranks():
    assert statistics.signed_rank_tail(6, 0, 6, 0) == pytest.approx(2 / 64)
    # the normal form for nine differences, one more being none
    assert statistics.signed_rank_tail(9, 18, 10, 6) == pytest.approx(math.erfc(4.5 / math.sqrt(9 * 10 * 19 / 24 - 6 / 48) / math.sqrt(2)))


def test_boxes():
    assert box_overlap((0, 0, 2, 2), (1, 0, 3, 2)) == pytest.approx(1 / 3)
    assert box_overlap((0, 0, 0, 0), (0, 0, 0, 0)) == 0
    refs = [(0, 0, 2, 2), (0, 0, 2, 2.2)]
    assert matched_boxes(refs, [(0, 0, 2, 2)]) == 1 and matched_boxes(refs, []) == 0
    assert matched_boxes([(0, 0, 1, 1)], [(0, 0, 1, 0.4)]) == 0


def test_entities_move_with_the_text():
    assert position_map("ab", "xab") == [0, 0, 1, 2]
    ref = {"text": "Jean va", "entities": [{"label": "PER", "start": 0, "end": 4, "text": "Jean"}]}
    hyp = {"text": "le Jean va", "entities": [{"label": "per", "start": 3, "end": 7, "text": "Jean"}, {"label": "LOC", "start": 8, "end": 10, "text": "va"}]}
    assert sorted((r["kind"], r["text"]) for r in entity_outcomes(ref, hyp)) == [("fp", "va"), ("tp", "Jean")]


def test_image_measures():
    import numpy as np

    flat = image_measures(np.full((30, 30), 128.0))
    assert flat["sharpness"] == flat["noise"] == flat["contrast"] == 0
    lines = np.tile(np.repeat([0.0, 255.0], 4), 8)[:, None] * np.ones((1, 40))
    assert image_measures(lines)["sharpness"] == 1 and image_measures(lines)["contrast"] == 1
    assert image_measures(np.array([[7.0]]))["rotation"] == 0


def test_matching_blocks_are_those_of_the_standard_matcher():
    rng = random.Random(3)
    for n in [*range(60), 700, 1500]:
        a = "".join(rng.choices("abcu ", k=n))
        b = "".join(c for c in a.replace("u", "n") if rng.random() > 0.05) + "".join(rng.choices("abcu ", k=n % 7))
        for x, y in ((a, b), (b, a), (a.split(), b.split()), (a, a[::-1])):
            for small in (0, align._Matcher.SMALL):
                matcher = align._Matcher(None, x, y, autojunk=False)
                matcher.SMALL = small
                assert matcher.get_opcodes() == SequenceMatcher(None, x, y, autojunk=False).get_opcodes()
