"""Phrase candidates of a message and their hashes."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from . import fingerprints as P
from . import text as T

LIMIT, LEAST, MOST = 256, 3, 12


def phrase_hash(text: Column) -> Column:
    """Hash of a phrase's normalised text; null for an empty one."""
    clean = T.normalize(text)
    return F.when(clean != "", P.stable_hash(F.concat(F.lit("phrase:"), clean)))


_RUNS = re.compile("[一-鿿]{3,}|[a-z_]{4,}")


def _found(texts: tuple[str | None, ...]) -> list[str]:
    found: dict[str, None] = {}
    for text in filter(None, texts):
        found[text] = None
        for run in _RUNS.findall(text):
            if len(found) >= LIMIT:
                break
            found[run] = None
            # A run is all CJK or all Latin, so its first character tells which.
            if run >= "一":
                for size in range(LEAST, min(MOST, len(run)) + 1):
                    # Only distinct n-grams count to the limit, so none is left out before they are known.
                    found |= dict.fromkeys(run[i : i + size] for i in range(len(run) - size + 1))
                    if len(found) >= LIMIT:
                        break
    return list(found)[:LIMIT]


@F.arrow_udf(ArrayType(StringType()))
def _candidates(*clean: pa.Array) -> pa.Array:
    return pa.array(map(_found, zip(*(c.to_pylist() for c in clean), strict=True)), pa.list_(pa.string()))


def candidates(*clean: Column) -> Column:
    """Distinct phrases of normalised texts in order, at most 256: each whole text, its CJK runs of three or more
    characters and Latin runs of four or more, each followed, for CJK, by all its n-grams of 3 to 12, short ones first."""
    return _candidates(*clean)


def lookup_hashes(phrases: Column) -> Column:
    """Hashes of the phrases long enough to mean something."""
    kept = F.filter(phrases, lambda p: ~T.is_low_entropy_text(p))
    return F.array_distinct(F.transform(kept, lambda p: P.stable_hash(F.concat(F.lit("phrase:"), p))))


@dataclass(frozen=True)
class Known:
    """Which values may be known: a Bloom filter of bits, two a value, told by a column's test or within a task.

    A value's places come from its CRC-32, which the JVM and Python have alike.
    """

    table: bytes
    places: int

    @staticmethod
    def slots(value: Column, places: int) -> list[Column]:
        h = F.crc32(value)
        return [h % places, F.shiftright(h * MIX, SHIFT) % places]

    def __contains__(self, value: str) -> bool:
        h = zlib.crc32(value.encode())
        a, b = h % self.places, (h * MIX >> SHIFT) % self.places
        return bool(self.table[a >> 3] >> (a & 7) & self.table[b >> 3] >> (b & 7) & 1)

    def __call__(self, value: Column) -> Column:
        """The test as an expression; for tables of a few MB, as they go into the plan with six bits a byte."""
        bits = np.unpackbits(np.frombuffer(self.table, np.uint8), bitorder="little")[: self.places].reshape(-1, 6)
        literal = F.lit(bytes((bits << np.arange(6, dtype=np.uint8)).sum(1, dtype=np.uint8) + 64))  # 64 and six bits: a character of ASCII
        tests = [F.call_function("shiftright", F.ascii(F.substring(literal, (F.floor(s / 6) + 1).cast("int"), F.lit(1)).cast("string")), (s % 6).cast("int")).bitwiseAND(1) == 1 for s in self.slots(value, self.places)]
        return tests[0] & tests[1]


#: A 32-bit number times `MIX`, less its lowest bits, is another of 35 bits, below 2**63 in between.
MIX, SHIFT = 1_640_531_527, 28

#: As `text.is_low_entropy_text` has it.
_TELLING = re.compile("(?:[一-鿿][^一-鿿]*){3}|(?:[a-zA-Z0-9][^a-zA-Z0-9]*){4}")
#: Phrases whose values a task remembers, and their longest; beyond, it forgets all and starts again.
KEPT_PHRASES, KEPT_LENGTH = 1 << 18, 64
KEYS = ArrayType(StructType([StructField("type", StringType()), StructField("value", StringType())]))


def _value(phrase: str) -> str | None:
    return P.digest(f"phrase:{phrase}") if _TELLING.search(phrase) else None


def _wanted(known: Known | None) -> Callable[[str], str | None]:
    """A phrase's value, if it means something and may be known."""
    kept: dict[str, str | None] = {}

    def of(phrase: str) -> str | None:
        if phrase in kept:
            return kept[phrase]
        value = _value(phrase)
        value = value if value is None or known is None or value in known else None
        if len(phrase) <= KEPT_LENGTH:
            if len(kept) >= KEPT_PHRASES:
                kept.clear()
            kept[phrase] = value
        return value

    return of


def lookup_keys(skeleton: Column, content: Column, clean: Column, *more: Column, known: Known | None = None) -> Column:
    """Array of (type, value): a skeleton's and a content's hash (null: none) and the phrases' of a normalised text and of `more`, in this order.

    Only those that may be `known`, where that is given. In Arrow batches: most
    phrases recur, and a task hashes and tests each once.
    """

    def run(skeleton: pa.Array, content: pa.Array, *texts: pa.Array) -> pa.Array:
        wanted = _wanted(known)
        types: list[str] = []
        values: list[str] = []
        ends = [0]
        for shape, whole, first, *others in zip(*(c.to_pylist() for c in (skeleton, content, *texts)), strict=True):
            for kind, value in (("skeleton", shape), ("content", whole)):
                if value is not None and (known is None or value in known):
                    types.append(kind)
                    values.append(value)
            found = [v for p in _found((first, *(T.normalized(t) for t in others if t))) if (v := wanted(p)) is not None]
            types += ["phrase"] * len(found)
            values += found
            ends.append(len(values))
        both = pa.StructArray.from_arrays([pa.array(types, pa.string()), pa.array(values, pa.string())], names=["type", "value"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), both)

    return F.arrow_udf(run, KEYS)(skeleton, content, clean, *more)
