"""Scanners for numerals, numeric sequences and marks; pure functions of texts."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Mapping

import ahocorasick

from . import fixed_values as fixed
from .align import edit_blocks, positions_kept

_YEAR, _FOLIATION, _REGNAL = (re.compile(p) for p in (fixed.YEAR, fixed.FOLIATION, fixed.REGNAL))
_CURRENCY = re.compile(fixed.CURRENCY, re.IGNORECASE)
_NUMERAL = re.compile(fixed.NUMERAL)


def roman_value(text: str) -> int | None:
    """Value of a Roman numeral (either case, a final j is an i), null if implausible."""
    digits = text.upper()
    digits = digits[:-1] + "I" if digits.endswith("J") else digits
    if not digits or set(digits) - set(fixed.ROMAN) or any(run in digits for run in fixed.ROMAN_RUNS):
        return None
    total = 0
    for here, after in zip(digits, digits[1:] + "\0", strict=True):
        value, next_value = fixed.ROMAN[here], fixed.ROMAN.get(after, 0)
        if value < next_value:
            if here + after not in fixed.ROMAN_PAIRS:
                return None
            value = -value
        total += value
    return total if total > 0 else None


def numerals(text: str, least: int = 2) -> list[tuple[str, int]]:
    found = ((m[0], roman_value(m[0])) for m in _NUMERAL.finditer(text) if len(m[0]) >= least)
    return [(form, value) for form, value in found if value is not None]


def numeral_status(form: str, value: int, text: str) -> str:
    """How a numeral of the reference comes back in a text."""

    def there(x: str) -> bool:
        return re.search(f"(?<![A-Za-z]){re.escape(x)}(?![A-Za-z])", text) is not None

    if there(form):
        return "strict_preserved"
    if there(form.swapcase()):
        return "case_changed"
    swap = {"i": "j", "j": "i", "I": "J", "J": "I"}
    other = form[:-1] + swap.get(form[-1], form[-1])
    if other != form and (there(other) or there(other.swapcase())):
        return "j_dropped"
    return "converted_to_arabic" if re.search(rf"(?<!\d){value}(?!\d)", text) else "lost"


def sequences(text: str) -> list[tuple[str, str, str]]:
    """(category, form, key) of years, folios, amounts and regnal years.

    A long s in a unit is read as s, so that every unit the pattern takes has a key.
    """
    out = [("year", m[0], m[1]) for m in _YEAR.finditer(text)]
    out += [("foliation", m[0], re.sub(r"\s", "", m[1]) + (m[2] or "").lower()) for m in _FOLIATION.finditer(text)]
    out += [("currency", m[0], f"{m[1].replace(',', '.')}|{fixed.UNITS[m[2].lower().replace('ſ', 's')]}") for m in _CURRENCY.finditer(text)]
    for m in _REGNAL.finditer(text):
        value = int(m[1]) if m[1].isdigit() else roman_value(m[1])
        if value is not None:
            out.append(("regnal", m[0], str(value)))
    return out


def sequence_counts(ref: str, hyp: str) -> list[dict]:
    """Per category of the reference: total, forms and keys found again (as multisets), and lost forms."""
    theirs = sequences(hyp)
    out = []
    for category in fixed.SEQUENCES:
        ours = [s for s in sequences(ref) if s[0] == category]
        if not ours:
            continue
        forms, keys = (Counter(s[i] for s in theirs if s[0] == category) for i in (1, 2))
        strict = sum((Counter(s[1] for s in ours) & forms).values())
        lost = []
        for _, form, key in ours:
            if keys[key] > 0:
                keys[key] -= 1
            else:
                lost.append(form)
        out.append({"category": category, "n_total": len(ours), "n_strict": strict, "n_value": len(ours) - len(lost), "lost": lost})
    return out


def abbreviation_counts(ref: str, hyp: str) -> list[dict]:
    """Signs of the reference: kept as such, or as such or developed, wherever they are."""
    ref, hyp = (unicodedata.normalize("NFC", t) for t in (ref, hyp))
    out = []
    for sign, developed in fixed.ABBREVIATIONS.items():
        n = ref.count(sign)
        if n:
            kept = min(n, hyp.count(sign))
            words = len(re.findall(rf"\b(?:{'|'.join(developed)})\b", hyp, re.IGNORECASE))
            out.append({"marker": sign, "n_total": n, "n_strict": kept, "n_expanded": min(n, kept + words)})
    return out


def early_print_counts(ref: str, hyp: str) -> list[dict]:
    """Marks of early prints that stand at their place in the text."""
    ref, hyp = (unicodedata.normalize("NFC", t) for t in (ref, hyp))
    if not any(c in ref for forms in fixed.EARLY_PRINT.values() for c in forms):
        return []
    kept = positions_kept(edit_blocks(ref, hyp))
    out = []
    for name, forms in fixed.EARLY_PRINT.items():
        at = [i for i, c in enumerate(ref) if c in forms]
        if at:
            n = int(sum(kept[i] for i in at))
            out.append({"marker": name, "n_total": len(at), "n_strict": n, "n_expanded": n})
    return out


def _plain_word(text: str) -> bool:
    return text.isascii() and text.isalnum()


def _in_word(c: str) -> bool:
    return c == "_" or c.isalnum()


_BEFORE, _AFTER = (re.compile(f"[{signs}]").match for signs in (fixed.BEFORE_DOTTED, fixed.AFTER_DOTTED))


class MarkScanner:
    """All marks and all their developed forms in one automaton each, so a text is read once, however many there are.

    A mark with a dot stands between the start or an opening sign and the end or a closing
    one, a plain word between word boundaries, any other mark anywhere. Of occurrences of one
    mark that overlap the first counts; of marks that overlap the one that begins first, and
    of those the longest. Developed forms are found in any case.
    """

    def __init__(self, marks: Mapping[str, Mapping[str, tuple[str, ...]]]) -> None:
        self.marks = [(mark, category) for category, some in marks.items() for mark in some]
        self.forms = [(mark, form.lower()) for some in marks.values() for mark, forms in some.items() for form in forms]
        self.automata = self._automaton([m for m, _ in self.marks]), self._automaton([f for _, f in self.forms])

    @staticmethod
    def _automaton(texts: list[str]) -> ahocorasick.Automaton:
        """Numbers of the texts by the texts; equal texts share an entry."""
        numbers: dict[str, list[int]] = {}
        for n, text in enumerate(texts):
            numbers.setdefault(text, []).append(n)
        out = ahocorasick.Automaton()
        for text, some in numbers.items():
            out.add_word(text, (len(text), some))
        out.make_automaton()
        return out

    @staticmethod
    def _stands(text: str, start: int, end: int, dotted: bool) -> bool:
        before, after, found = text[start - 1 : start] if start else "", text[end : end + 1], text[start:end]
        if dotted and "." in found:
            return (not before or _BEFORE(before) is not None) and (not after or _AFTER(after) is not None)
        return not _plain_word(found) or not (before and _in_word(before)) and not (after and _in_word(after))

    def found(self, text: str) -> Counter:
        """How often each mark is in the text."""
        spans, last = [], {}
        for at, (size, numbers) in self.automata[0].iter(text):
            start, n = at + 1 - size, numbers[0]
            if start >= last.get(n, 0) and self._stands(text, start, at + 1, True):
                last[n] = at + 1
                spans.append((start, -at - 1, n))
        out, free = Counter(), 0
        for start, end, n in sorted(spans):
            if start >= free:
                out[self.marks[n][0]] += 1
                free = -end
        return out

    def developed(self, text: str) -> Counter:
        """How often each mark is developed in the text, by any of its forms."""
        text = text.lower() if len(text.lower()) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        out, last = Counter(), {}
        for at, (size, numbers) in self.automata[1].iter(text):
            start = at + 1 - size
            if start >= last.get(numbers[0], 0) and self._stands(text, start, at + 1, False):
                last[numbers[0]] = at + 1
                out.update(self.forms[n][0] for n in numbers)
        return out


_ARCHIVES = MarkScanner(fixed.ARCHIVES)


def archive_marks(text: str) -> Counter:
    """Abbreviations in a text; of those that overlap the first, and of those the longest."""
    return _ARCHIVES.found(text)


def archive_counts(ref: str, hyp: str) -> list[dict]:
    """Per category of the reference: marks kept as such, or as such or developed."""
    ours = _ARCHIVES.found(ref)
    if not ours:
        return []
    theirs, forms = _ARCHIVES.found(hyp), None
    out: dict[str, list[int]] = {}
    for mark, category in _ARCHIVES.marks:
        if n := ours[mark]:
            kept = min(n, theirs[mark])
            if kept < n and forms is None:
                forms = _ARCHIVES.developed(hyp)
            row = out.setdefault(category, [0, 0, 0])
            for i, value in enumerate((n, kept, min(n, kept + (forms[mark] if kept < n else 0)))):
                row[i] += value
    return [{"marker": c, "n_total": a, "n_strict": b, "n_expanded": d} for c, (a, b, d) in out.items()]


def numeral_counts(ref: str, hyp: str) -> list[dict]:
    return [{"form": form, "value": value, "status": numeral_status(form, value, hyp)} for form, value in numerals(ref)]


def is_diacritic_target(c: str) -> bool:
    return any(unicodedata.category(x) == "Mn" for x in unicodedata.normalize("NFD", c))


def is_medieval_glyph(c: str) -> bool:
    return c in fixed.GLYPH_LETTERS or any(a <= ord(c) <= b for a, b in fixed.GLYPH_RANGES)


def without_marks(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))


def word_pair_class(ref: str, hyp: str) -> str:
    """Class of the error that turns one word into another."""

    def spelt_out(t: str) -> str:
        for sign, letters in fixed.LIGATURES:
            t = t.replace(sign, letters)
        return t

    def seen(t: str) -> str:
        t = t.lower()
        for shape, like in fixed.LOOKALIKES:
            t = t.replace(shape, like)
        return t

    views = (("case", str.lower), ("diacritic", without_marks), ("ligature", spelt_out), ("visual", seen))
    return next((name for name, view in views if view(ref) == view(hyp)), "other")
