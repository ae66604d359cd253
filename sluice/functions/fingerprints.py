"""Structural skeletons, hashes, trigrams and SimHash."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import text as T

# Patterns of links, addresses and tokens, and the skeletons that say nothing.
URL = rf"(?i)(?<!{T.WORD})(?:https?://|www\.)[^\s<>()\[\]{{}}\"']+"
EMAIL = rf"(?i)(?<!{T.WORD}){T.WORD}[\p{{L}}\p{{N}}_.+-]*@[\p{{L}}\p{{N}}_.-]+\.[a-z]{{2,}}\b"
MENTION = rf"(?<!{T.WORD})@{T.WORD}{{3,}}"
TOKEN = "[一-鿿]+|[a-z_ſı]+|[^ ]"
WORDS = "(?<![a-z_ſı])[a-z_]+(?![a-z_ſı])"
PLACEHOLDERS = ("<url>", "<email>", "<mention>", "<w>")
# `URL`, `EMAIL`, `MENTION` and `WORDS` for lower-case text: they match the same.
_LOW_URL = rf"(?:h(?<!{T.WORD}h)ttps?://|w(?<!{T.WORD}w)ww\.)[^\s<>()\[\]{{}}\"']+"
_LOW_EMAIL = rf"{T.WORD}(?<!{T.WORD}{T.WORD})[\p{{L}}\p{{N}}_.+-]*+@[\p{{L}}\p{{N}}_.-]+\.[a-z]{{2,}}\b"
_LOW_MENTION = rf"@(?<!{T.WORD}@){T.WORD}{{3,}}"
_LOW_WORDS = "[a-z_](?<![a-z_ſı][a-z_])[a-z_]*+(?![a-z_ſı])"
#: What stands for the placeholders in between: noncharacters, which no text has.
MARKS = ("\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3")
LOW_ENTROPY_SKELETONS = (
    "<url>", "<mention>", "<email>", "<w>", "<url> <w>", "<w> <url>", "<url> <mention>", "<mention> <url>", "<url> <url>",
    "<w> <mention>", "<mention> <w>", "<email> <w>", "<w> <email>",
)


def digest(value: str) -> str:
    """The hash of a string, on the driver."""
    return hashlib.sha256(value.encode()).hexdigest()[:32]


EMPTY_HASH = digest("")
LOW_ENTROPY_HASHES = tuple(map(digest, LOW_ENTROPY_SKELETONS))
SENTINELS = (EMPTY_HASH, *LOW_ENTROPY_HASHES)


def stable_hash(value: Column) -> Column:
    """First 32 hex digits of SHA-256."""
    return F.substring(F.sha2(value, 256), 1, 32)


#: Where a word ends for the JVM, before numbers that are no digits, too.
_END = rf"(?:(?!\w)|(?=[{''.join(sorted(T.of_category('No') | T.of_category('Nl')))}]))"


def _python(pattern: str) -> re.Pattern[str]:
    """A pattern as Python writes it: the same word characters, and white space of ASCII."""
    return re.compile(pattern.replace(T.WORD, r"\w").replace(r"\p{L}\p{N}_", r"\w").replace(r"\s", r" \t-\r").replace(r"\b", _END))


_URLS, _EMAILS, _MENTIONS = map(_python, (_LOW_URL, _LOW_EMAIL, _LOW_MENTION))
#: Words with single spaces between them, which are one placeholder.
_WORD_RUNS = re.compile(rf"{_LOW_WORDS}(?: [a-z_]++(?![a-z_ſı]))*")
_REPEATED = re.compile(f"([<{''.join(MARKS)}])(?: *\\1)+")
_TOKENS = re.compile(TOKEN)


def _shape(text: str) -> str:
    x = T.bare_text(text).lower()
    if "://" in x or "www." in x:
        x = _URLS.sub(f" {MARKS[0]} ", x)
    if "@" in x:
        x = _MENTIONS.sub(f" {MARKS[2]} ", _EMAILS.sub(f" {MARKS[1]} ", x))
    x = T.plain_text(x)
    if "<" in x:  # a text's own placeholders, too
        for name, mark in zip(PLACEHOLDERS[:3], MARKS, strict=False):
            x = x.replace(name, mark)
    x = _REPEATED.sub(r"\1", _WORD_RUNS.sub(MARKS[3], x))
    x = " ".join(_TOKENS.findall(x))
    for name, mark in zip(PLACEHOLDERS, MARKS, strict=True):
        x = x.replace(mark, name)
    return x


#: Shape of a text: CJK runs and punctuation as they are, words as <w>, carriers as <url>, <email>, <mention>.
#: Placeholders are single noncharacters until the end, and a run of words is one match.
skeleton = T.each(_shape)


def content_hash(text: Column) -> Column:
    return stable_hash(T.normalize(text))


def skeleton_hash(text: Column) -> Column:
    return stable_hash(skeleton(text))


def is_low_entropy_skeleton(value: Column) -> Column:
    """Whether a skeleton is one of the known empty shapes, or keeps under three characters without tokens and punctuation."""
    # Punctuation that runs up to a token takes its first sign along, so that later tokens leave a letter each.
    few = lambda text, cut="": F.length(F.regexp_replace(text, rf"<\w+>|{cut}[^\p{{L}}\p{{N}}]+", "")) < 3
    # What a beginning keeps, less a token that it cuts, the whole keeps, too; most keep enough there.
    return value.isin(*LOW_ENTROPY_SKELETONS) | (few(F.substring(value, 1, T.HEAD), r"<\w*$|") & few(value))


def low_shape(rows: DataFrame) -> Column:
    """Whether a row's skeleton says nothing: its column low_shape, where rows have one, so that skeletons needn't be moved."""
    return F.col("low_shape") if "low_shape" in rows.columns else is_low_entropy_skeleton(F.col("skeleton"))


def meaningful(value: Column) -> Column:
    """Whether a fingerprint's value is not that of an empty or empty-shaped text."""
    return value.isNotNull() & ~value.isin(*SENTINELS)


def trigrams(clean: Column) -> Column:
    """Sliding trigrams of a normalised text without its spaces; a shorter one whole; none of an empty one."""
    x = F.regexp_replace(clean, f"{T.SPACE}+", "")
    n = F.length(x)
    whole = F.when(n == 0, F.array().cast("array<string>")).when(n <= 3, F.array(x))
    return whole.otherwise(F.regexp_extract_all(x, F.lit(r"(?s)(?![\x{DC00}-\x{DFFF}])(?=(.{3}))"), F.lit(1)))


def simhash(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, simhash (unsigned decimal text) of each row.

    A bit is set where more trigrams have it than have not, repeated ones
    counted as often.  Arrow batches, no shuffle: a worker hashes a trigram
    once and remembers it, and a block of texts is one product of their counts
    of trigrams with the trigrams' bits.
    """
    return df.select(key, simhash_of(T.normalize(F.coalesce(F.col(text), F.lit("")))).alias("simhash"))


def simhash_of(clean: Column) -> Column:
    """SimHash of a normalised text."""
    return _simhash(F.regexp_replace(clean, f"{T.SPACE}+", ""))


#: Trigrams whose hashes a worker remembers; beyond, it forgets all and starts again.
KEPT_GRAMS = 1 << 20
_HASHES: dict[int, int] = {}


def _gram_hash(code: int) -> int:
    """Last 64 bits of the SHA-256 of the characters in a code of 21 bits each, the last character in the lowest."""
    if code not in _HASHES:
        if len(_HASHES) >= KEPT_GRAMS:
            _HASHES.clear()
        chars = [(code >> 42) & 0x1FFFFF, (code >> 21) & 0x1FFFFF, code & 0x1FFFFF]
        gram = "".join(chr(c - 1) for c in chars if c)
        _HASHES[code] = int.from_bytes(hashlib.sha256(gram.encode()).digest()[-8:], "big")
    return _HASHES[code]


def simhashes(texts: list[str]) -> np.ndarray:
    """SimHash of each text as it is, without regard to spaces."""
    units = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64) + 1  # 0 is no character
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(size) - size
    count = np.where(size > 3, size - 2, (size > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(texts)), count)
    at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)
    last = np.repeat(begin + size, count)
    code = np.zeros(len(at), np.int64)
    for k in range(3):
        inside = at + k < last
        code = np.where(inside, (code << 21) | units[np.minimum(at + k, max(len(units) - 1, 0))], code) if len(units) else code
    grams, which = np.unique(code, return_inverse=True)
    hashes = np.fromiter(map(_gram_hash, grams.tolist()), np.uint64, len(grams))
    signs = (((hashes[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.float64) * 2 - 1).reshape(-1, 64)
    counts = np.bincount(owner * max(len(grams), 1) + which, minlength=len(texts) * max(len(grams), 1)).reshape(len(texts), -1).astype(np.float64)
    votes = counts[:, : len(grams)] @ signs
    return ((votes > 0).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64)


@F.arrow_udf(StringType())
def _simhash(column: pa.Array) -> pa.Array:
    texts, out, i = column.to_pylist(), [], 0
    while i < len(texts):
        j, chars = i, 0
        while j < len(texts) and (j == i or (chars + len(texts[j]) <= 1 << 16 and j - i < 64)):
            chars += len(texts[j])
            j += 1
        out += map(str, simhashes(texts[i:j]).tolist())
        i = j
    return pa.array(out, pa.string())
