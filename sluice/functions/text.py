"""Text normalisation as Column expressions.

Canonical forms are made in Arrow batches: a chain of passes in the JVM takes
several times as long, as each of its patterns looks at every character and the
text is made anew after each.  Single passes and tests stay in the JVM.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The ranges of invisible characters, and of digits beyond \p{Nd}.
ZERO_WIDTH = "[​-‏‪-‮⁠-⁯﻿]"
DIGITS = r"[\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿❶-❾➀-➈➊-➒]"
SPACE = r"[\s\u0085   -     　\x1c-\x1f]"
WORD = r"[\p{L}\p{N}_]"
#: White space beyond `\s`, asked of characters that are not printable ASCII.
_ODD_SPACE = f"[^ -~](?<=[{SPACE}&&\\S])"

_FULL = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
_HALF = "".join(map(chr, range(0x21, 0x7F))) + " "
#: Characters that NFKC leaves alone, or that `_FULL` maps: ASCII, Latin letters, the common CJK block, some CJK
#: punctuation, full-width forms and the older pictographs.
_SAFE = (
    "^[\\x00-\\x7f¡-§©«-®°±¶·»¿-ıĴ-ľŁ-ňŊ-ž"
    "‐‒-‖‘-‣  　-】一-鿼！-～\\x{1f300}-\\x{1f64f}\\x{1f680}-\\x{1f6c5}]*$"
)


@F.arrow_udf(StringType())
def _nfkc(column: pa.Array) -> pa.Array:
    return pa.array([None if x is None else unicodedata.normalize("NFKC", x) for x in column.to_pylist()], pa.string())


def strip_zero_width(text: Column) -> Column:
    """Without invisible and directional characters."""
    return F.regexp_replace(text, ZERO_WIDTH, "")


def strip_emoji(text: Column) -> Column:
    """Without symbols of category So; skin tones and joiners stay."""
    return F.regexp_replace(text, r"\p{So}", "")


def is_safe(text: Column) -> Column:
    """Whether `nfkc` needs no more than a translation."""
    return text.rlike(_SAFE)


def nfkc(text: Column, safe: Column | None = None) -> Column:
    """Compatibility form. safe: `is_safe` of the text, where it is known."""
    safe = is_safe(text) if safe is None else safe
    narrow = F.when(text.rlike("[！-～　]"), F.translate(text, _FULL, _HALF)).otherwise(text)
    return F.coalesce(F.when(safe, narrow), _nfkc(F.when(~safe, text)))


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    # Nested classes are slow in a chain of passes, so they are left to texts that need them.
    plain = F.regexp_replace(text, r"\s+", " ")
    return F.trim(F.when(plain.rlike(_ODD_SPACE), F.regexp_replace(plain, f"{SPACE}+", " ")).otherwise(plain))


def strip_digits(text: Column) -> Column:
    """Without digits of any kind; one look at a character tells for those of ASCII."""
    return F.regexp_replace(text, rf"[0-9[\x{{80}}-\x{{10ffff}}&&{DIGITS}]]", "")


def each(f: Callable[[str], str]) -> Callable[[Column], Column]:
    """A function of texts as one of columns, in Arrow batches; null of null."""

    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if x is None else f(x) for x in column.to_pylist()], pa.string())

    return F.arrow_udf(run, StringType())


_BY_CATEGORY: dict[str, list[str]] = {c: [] for c in ("So", "Nd", "No", "Nl")}
for _c in filter(str.isprintable, map(chr, range(0x80, 0x20000))):  # these categories have none beyond
    if (_found := _BY_CATEGORY.get(unicodedata.category(_c))) is not None:
        _found.append(_c)
_BY_CATEGORY["Nd"] += "0123456789"


def of_category(name: str) -> frozenset[str]:
    """All characters of a general category: So, Nd, No or Nl."""
    return frozenset(_BY_CATEGORY[name])


_INVISIBLE = re.compile(ZERO_WIDTH)
_SYMBOLS = of_category("So")
#: As `DIGITS` has them; those beyond \p{Nd} are below U+2800.
_DIGITS = of_category("Nd") | frozenset(re.findall(DIGITS.replace(r"\p{Nd}", ""), "".join(map(chr, range(0x2800)))))
_GONE = _SYMBOLS | _DIGITS
_ASCII_DIGITS = dict.fromkeys(b"0123456789")


def bare_text(text: str) -> str:
    """Without invisible characters, as `strip_zero_width`."""
    return text if text.isascii() else _INVISIBLE.sub("", text)


def _without(text: str, chars: frozenset[str]) -> str:
    # A text has few distinct ones, and big classes are slow in patterns.
    for c in chars & set(text):
        text = text.replace(c, "")
    return text


def plain_text(text: str) -> str:
    """Without symbols and digits, runs of white space as one space: `strip_emoji`, `strip_digits` and `squeeze`."""
    text = text.translate(_ASCII_DIGITS) if text.isascii() else _without(text, _GONE)
    return " ".join(text.split())


def normalized(text: str) -> str:
    text = bare_text(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        # `plain_text` takes symbols away, too; before that, only the form of a last sigma depends on them.
        if "Σ" in text:
            text = _without(text, _SYMBOLS)
    return plain_text(text.lower())


#: The canonical form that content is compared in: compatibility form, lower case, no symbols, no digits.
normalize = each(normalized)


#: Characters at a text's beginning that are asked first.
HEAD = 256


def _has(text: Column, pattern: str) -> Column:
    """Whether a text has what most have at once, so that few are read to their end. The pattern must not look at what is around it."""
    return F.substring(text, 1, HEAD).rlike(pattern) | text.rlike(pattern)


def is_punctuation_only(clean: Column) -> Column:
    """Whether a normalised text has no letter and no number; true for an empty one."""
    return ~_has(clean, r"[\p{L}\p{N}]")


def mention_count(text: Column) -> Column:
    """@names of three or more word characters that do not follow a word character."""
    return F.when(~F.contains(text, F.lit("@")), 0).otherwise(F.regexp_count(text, F.lit(rf"@(?<!{WORD}@){WORD}{{3,}}")).cast("int"))


def is_low_entropy_text(clean: Column) -> Column:
    """Too little to be a phrase of its own: under three CJK characters and under four ASCII letters or digits."""
    return ~_has(clean, "(?s)(?:[一-鿿][^一-鿿]*){3}|(?:[a-zA-Z0-9][^a-zA-Z0-9]*){4}")


def display_name(first: Column, last: Column) -> Column:
    """Non-empty parts joined by a space."""
    return F.concat_ws(" ", F.nullif(first, F.lit("")), F.nullif(last, F.lit("")))


def number_text(value: Column) -> Column:
    """A double as Python and SQL engines write it: an exponent below 1e-4 and from 1e16 on only, where Java has one below 1e-3 and from 1e7 on. Digits are Java's."""
    java = value.cast("string")
    form = lambda group: F.regexp_extract(java, r"^(-?)(\d)\.(\d+)E(-?\d+)$", group)
    first, rest, e = form(2), F.regexp_replace(form(3), "0+$", ""), form(4).try_cast("int")
    digits = F.concat(first, rest)
    scientific = F.concat(first, F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""), F.lit("e"), F.when(e < 0, "-").otherwise("+"), F.lpad(F.abs(e).cast("string"), F.greatest(F.lit(2), F.length(F.abs(e).cast("string"))), F.lit("0")))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
    whole = F.rpad(digits, F.greatest(e + 1, F.length(digits)), F.lit("0"))
    large = F.concat(F.substring(whole, F.lit(1), e + 1), F.lit("."), F.coalesce(F.nullif(F.substring(whole, e + 2, F.length(whole)), F.lit("")), F.lit("0")))
    return F.when(e.isNull(), java).otherwise(F.concat(form(1), F.when((e < -4) | (e >= 16), scientific).when(e < 0, small).otherwise(large)))
