"""Normalisation profiles for transcriptions.

A profile applies its levers in one frozen order: invisible characters, Unicode form, case
folding (and the form again), excluded characters, diplomatic table, non-word characters,
diacritics, white space. Unicode tables have no counterpart in Spark SQL, so a profile is
one Arrow function over a batch; a profile without Unicode levers stays in the JVM.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, fields
from functools import cached_property
from pathlib import Path

import pyarrow as pa
import yaml
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from . import fixed_values as fixed

FORMS = ("none", "NFC", "NFD", "NFKC", "NFKD")
SPACES = ("none", "intra_line", "flat")


#: Runs of characters that may be invisible, or marks: what is not in them needs no look at its category.
_MAYBE_INVISIBLE = re.compile("[\x00-\x08\x0e-\x1f\x7f-\x9f\xad\u0600-\U0010ffff]+")
_MAYBE_MARKS = re.compile("[\u0300-\U0010ffff]+")


def _without(runs: re.Pattern, text: str, *categories: str) -> str:
    return runs.sub(lambda m: "".join(c for c in m[0] if unicodedata.category(c) not in categories), text)


@dataclass(frozen=True)
class Profile:
    name: str
    unicode_form: str = "NFC"
    caseless: bool = False
    strip_invisible: bool = True
    exclude_chars: str = ""
    exclude_mode: str = "delete"
    table: Mapping[str, str] = field(default_factory=dict)
    non_word_to_space: bool = False
    strip_diacritics: bool = False
    whitespace: str = "none"
    description: str = ""

    def __post_init__(self):
        if self.unicode_form not in FORMS or self.whitespace not in SPACES or self.exclude_mode not in ("delete", "space"):
            raise ValueError(f"profile {self.name!r}: unknown form, white space or exclusion mode")

    def _form(self, text: str) -> str:
        return text if self.unicode_form == "none" or text.isascii() else unicodedata.normalize(self.unicode_form, text)

    @cached_property
    def _excluded(self) -> dict[int, str | None]:
        chars = self.exclude_chars
        if self.caseless:
            chars += "".join(f for c in chars if len(f := c.casefold()) == 1)
        return dict.fromkeys(map(ord, chars), " " if self.exclude_mode == "space" else None)

    @cached_property
    def _longest_first(self) -> re.Pattern | None:
        keys = sorted(self.table, key=len, reverse=True)
        return re.compile("|".join(map(re.escape, keys))) if keys else None

    def apply(self, text: str) -> str:
        if self.strip_invisible:
            text = _without(_MAYBE_INVISIBLE, text, "Cf", "Cc")
        text = self._form(text)
        if self.caseless:
            text = self._form(text.casefold())
        if self.exclude_chars:
            text = text.translate(self._excluded)
        if self._longest_first:
            text = self._longest_first.sub(lambda m: self.table[m[0]], text)
        if self.non_word_to_space:
            text = re.sub(r"[^\w]", " ", text)
        if self.strip_diacritics and not text.isascii():
            text = self._form(_without(_MAYBE_MARKS, unicodedata.normalize("NFD", text), "Mn"))
        if self.whitespace == "flat":
            text = " ".join(text.split())
        elif self.whitespace == "intra_line":
            text = "\n".join(" ".join(line.split()) for line in text.splitlines()).strip("\n")
        return text

    def column(self, text: Column) -> Column:
        profile = self

        @F.arrow_udf("string")
        def normalised(values: pa.Array) -> pa.Array:
            return pa.array([v if v is None else profile.apply(v) for v in values.to_pylist()], pa.string())

        return normalised(text)


_EFFECT = pa.struct([("profile", pa.string()), ("changed", pa.bool_()), ("chars", pa.int64())])
#: Texts that are looked at together.
ROWS = 256


def effects(text: Column, profiles: Iterable[Profile]) -> Column:
    """A row for each profile: whether it changes the text, and the characters left; the texts it makes are not kept."""
    profiles = tuple(profiles)

    @F.arrow_udf(from_arrow_type(pa.list_(_EFFECT)))
    def measured(values: pa.Array) -> pa.Array:
        parts = []
        for start in range(0, max(1, len(values)), ROWS):
            out = []
            for v in values.slice(start, ROWS).to_pylist():
                made = [(p.name, None if v is None else p.apply(v)) for p in profiles]
                out.append([{"profile": n, "changed": m if m is None else m != v, "chars": m if m is None else len(m)} for n, m in made])
            parts.append(pa.array(out, pa.list_(_EFFECT)))
        return pa.concat_arrays(parts)

    return measured(text)


def profile_from(settings: Mapping, name: str = "custom") -> Profile:
    """A profile from settings; ``nfc`` (bool) and ``diplomatic`` are accepted for the form and the table."""
    known = {f.name for f in fields(Profile)}
    given = dict(settings)
    if "nfc" in given:
        given["unicode_form"] = "NFC" if given.pop("nfc") else "none"
    if "diplomatic" in given:
        given["table"] = given.pop("diplomatic") or {}
    if unknown := set(given) - known:
        raise ValueError(f"unknown settings of a profile: {sorted(unknown)}")
    given["exclude_chars"] = "".join(c for c in given.get("exclude_chars") or "" if len(c) == 1)
    return Profile(**{"name": name} | given)


def load_profiles(path: str) -> dict[str, Profile]:
    """Profiles from a YAML file: name to settings."""
    given = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if not isinstance(given, dict):
        raise ValueError(f"{path}: names with settings are expected")
    return {name: profile_from(settings or {}, name) for name, settings in given.items()}


PROFILES = {
    p.name: p
    for p in (
        Profile("nfc"),
        Profile("nfkc", unicode_form="NFKC"),
        Profile("caseless", caseless=True),
        Profile("minimal", table=fixed.LONG_S),
        Profile("no_diacritics", strip_diacritics=True),
        Profile("flat_text", whitespace="flat"),
        Profile("keep_line_breaks", whitespace="intra_line"),
        Profile("no_punctuation", exclude_chars=fixed.PUNCTUATION, exclude_mode="space"),
        Profile("no_apostrophes", exclude_chars="'’"),
        Profile("medieval_french", table=fixed.FRENCH_MEDIEVAL),
        Profile("early_modern_french", table=fixed.FRENCH_EARLY_MODERN),
        Profile("medieval_latin", table=fixed.LATIN_MEDIEVAL),
        Profile("hipe", unicode_form="none", caseless=True, table=fixed.CONFORMITY, non_word_to_space=True, whitespace="flat"),
        Profile("heritage", unicode_form="none", caseless=True, table=fixed.REJOINED, non_word_to_space=True, whitespace="flat"),
    )
}


def prepare(text: Column, profile: Profile | None, char_exclude: str = "") -> Column:
    """The profile, then the view's own exclusions."""
    out = text if profile is None else profile.column(text)
    return F.translate(out, char_exclude, "") if char_exclude else out


def newline_preserved(profile: Profile | None, char_exclude: str = "") -> bool:
    """Whether lines survive preparation, so that line analyses make sense."""
    text = profile.apply("a\nb") if profile else "a\nb"
    return "\n" in text and "\n" not in char_exclude
