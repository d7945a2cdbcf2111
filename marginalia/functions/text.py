"""Column functions on text that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE_ENDS = "\\r\\n|[\\n\\r\\x0B\\f\\x1c-\\x1e\\x85\\u2028\\u2029]"


def plain_text(text: Column) -> Column:
    """Text of a file: no byte order marks, line ends as newlines."""
    return F.regexp_replace(F.regexp_replace(text, "^﻿+", ""), "\r\n?", "\n")


def strip_invisible(text: Column) -> Column:
    return F.regexp_replace(text, r"[\p{Cf}\p{Cc}&&[^\t\n\r\f\x0B]]", "")


def word_array(text: Column) -> Column:
    """Words between white space, Unicode spaces included."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def token_array(text: Column) -> Column:
    """Lower-case word tokens with inner apostrophes and hyphens."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?U)(\w+(?:['’\-]\w+)*)"), 1), lambda t: F.lower(t))


def ascii_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("([A-Za-z0-9_]+)"), 1)


def line_array(text: Column) -> Column:
    """Lines without their ends; no empty line after the last end."""
    lines = F.split(text, LINE_ENDS)
    last_empty = F.element_at(lines, -1) == ""
    return F.when(last_empty, F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def char_ngrams(text: Column, n: int = 3) -> Column:
    """Runs of n characters; characters are taken apart once, so the work is in proportion to the text."""
    letters = grams = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    for k in range(1, n):
        # beyond the end a letter is null, and so is the run
        grams = F.zip_with(grams, F.slice(letters, F.lit(k + 1), F.length(text)), lambda x, y: F.concat(x, y))
    return F.filter(grams, lambda x: x.isNotNull())


def excerpt(text: Column, size: int = 160) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size - 1), F.lit("…"))).otherwise(text)


def substring_count(text: Column, part: str) -> Column:
    """Occurrences that do not overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def whole_word_count(text: Column, words: tuple[str, ...]) -> Column:
    return F.regexp_count(text, F.lit(r"(?iU)\b(?:" + "|".join(words) + r")\b"))


def lookalike(text: Column, pairs) -> Column:
    """Replacements one after the other, each on the result of the last."""
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a.cast("double") / b)


def zero_safe_ratio(a: Column, b: Column) -> Column:
    return F.coalesce(safe_ratio(a, b), F.lit(0.0))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def slug(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)[^\w.\-]+", "_")


def f1(precision: Column, recall: Column) -> Column:
    return zero_safe_ratio(2 * precision * recall, precision + recall)


def iso_timestamp(text: Column) -> Column:
    """ISO-8601 text, UTC where no zone is given, null if malformed."""
    return F.try_to_timestamp(text)


def days_since(ts: Column, origin: Column) -> Column:
    return (F.unix_micros(ts) - F.unix_micros(origin)) / F.lit(86_400_000_000.0)


def quality_gain(new: Column, old: Column) -> Column:
    """(new - old) / old; from nothing, the new quality within -1 and 1."""
    return F.when(old != 0, (new - old) / old).otherwise(clamp(new, -1.0, 1.0))


def canonical_hash(*columns: Column) -> Column:
    """SHA-256 of a canonical JSON of the columns."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
