"""URL filters: a Bloom filter cascade over the corpus's complete key universe.

Keys are a host, or one of its parent domains, and the beginning of a path.
Listed keys are the host lists' and the rules'.  Level 1 holds the listed keys,
level 2 the unlisted keys of the corpus that level 1 takes for listed, level 3
the listed keys that level 2 takes, and so on until no level errs: a key of
the universe is then judged exactly, with filters alone and no join.

Sizes.  Only the listed keys (checked against `MAX_LISTED`) and the first
level's false positives come to the driver.  Level 1 gets so low an error rate
that the expected false positives are fewer than the listed keys, and their
number is checked too, so what is broadcast is bounded by the lists, not by
the corpus.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, free_name, table, written

MAX_LISTED = 2_000_000

#: (verdict, host, beginning of the path); the longest rule that fits wins.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Hosts blocked, with their subdomains, where no rule fits.
BLOCKED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
BLOCKED_HOSTS = tuple(f"{name}.example.{top}" for name in BLOCKED_NAMES for top in ("com", "net", "org"))


@dataclass(frozen=True)
class Bloom:
    """A Bloom filter; `salt` makes the levels of a cascade err independently."""

    bits: np.ndarray
    probes: int
    salt: int

    @staticmethod
    def of(keys: Iterable[str], error: float, salt: int) -> Bloom:
        keys = list(keys)
        size = max(64, math.ceil(-len(keys) * math.log(error) / math.log(2) ** 2))
        made = Bloom(np.zeros(-(-size // 8) * 8, bool), max(1, round(-math.log2(error))), salt)
        for key in keys:
            made.bits[made.places(key)] = True
        return made

    def places(self, key: str) -> list[int]:
        digest = hashlib.blake2b(key.encode(), digest_size=16, salt=self.salt.to_bytes(8, "little")).digest()
        a, b = int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little") | 1
        return [(a + k * b) % len(self.bits) for k in range(self.probes)]

    def __contains__(self, key: str) -> bool:
        return all(self.bits[i] for i in self.places(key))


@dataclass(frozen=True)
class Cascade:
    """Alternate levels of listed keys and of false positives."""

    levels: tuple[Bloom, ...]

    def __contains__(self, key: str) -> bool:
        for k, level in enumerate(self.levels):
            if key not in level:
                return k % 2 == 1
        return len(self.levels) % 2 == 1


def build_cascade(universe: DataFrame, listed: Iterable[str]) -> Cascade:
    """Exact for every key of `universe` (one string column of distinct keys)."""
    spark, listed = universe.sparkSession, set(listed)
    if len(listed) > MAX_LISTED:
        raise ValueError(f"{len(listed)} listed keys; a cascade is broadcast and takes {MAX_LISTED} at most")
    if not listed:
        return Cascade(())
    total = universe.count()
    error = min(0.5, 0.7 * len(listed) / max(1, total))
    first = Bloom.of(listed, error, 1)
    sent = spark.sparkContext.broadcast((first, frozenset(listed)))

    def wrong(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom, known = sent.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([k for k in batch.column(0).to_pylist() if k not in known and k in bloom], pa.string())], names=["key"])

    most = 8 * len(listed) + 1000
    taken = [r.key for r in universe.mapInArrow(wrong, "key string").limit(most + 1).collect()]
    if len(taken) > most:
        raise RuntimeError("the first level errs more often than it should")
    levels, inside, outside = [first], sorted(listed), taken
    while outside:
        level = Bloom.of(outside, 0.5, len(levels) + 1)
        levels.append(level)
        inside, outside = outside, [k for k in inside if k in level]
    return Cascade(tuple(levels))


def url_parts(url: str) -> tuple:
    """Columns host and path of the column `url`; both empty for null or without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _domains(host: str, labels: int, length: int) -> list[str]:
    """The host and its parent domains, longest first, of those of at most so many labels and characters."""
    last = host.rsplit(".", labels)[-labels:]
    return [d for i in range(len(last)) if len(d := ".".join(last[i:])) <= length] if labels else []


def candidate_keys(host: str, path: str, depths: tuple[int, ...], labels: int, length: int) -> list[str]:
    """Every key that could list this url: hosts alone, and hosts with the first `depths` characters of the path; hosts longer than any listed one are left out."""
    return [f"{d}{path[:n]}" for d in _domains(host, labels, length) for n in (0, *depths) if n <= len(path)] if host else []


def filter_urls(df: DataFrame, url: str = "url", rules: tuple = RULES, blocked_hosts: tuple[str, ...] = BLOCKED_HOSTS) -> DataFrame:
    """Adds host, path, rule (null if none fits) and verdict to each row.

    A null url, one without :// and one without a host have no keys and are
    allowed.  Ties between rules of one length go to the first by code point.
    Columns of these names in `df` are replaced, all others stay; every row
    stays, and equal urls have equal verdicts, however long; an empty table
    gives no rows.  A batch judges each of its hosts and beginnings of paths
    once.
    """
    bounded_batches(df.sparkSession)
    host, path = url_parts(f"`{url}`")
    parts = df.withColumn("host", host).withColumn("path", path)
    depths = tuple(sorted({len(p) for _, _, p in rules}))
    named = {f"{h}{p}": (verdict, f"{h}{p}") for verdict, h, p in rules}
    listed = {*named, *blocked_hosts}
    hosts = [*(h for _, h, _ in rules), *blocked_hosts]
    most = max((h.count(".") + 1 for h in hosts), default=0), max(map(len, hosts), default=0)

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {k for h, p in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k in candidate_keys(h, p, depths, *most)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["key"])

    deepest = max(depths, default=0)
    heads = parts.select("host", F.substring("path", 1, deepest).alias("path")).distinct()
    universe = written(heads.mapInArrow(keys_of, "key string").distinct(), "url-keys")
    sent = parts.sparkSession.sparkContext.broadcast((build_cascade(universe, listed), named))

    def judge(hosts, paths):
        cascade, named = sent.value
        known: dict[tuple[str, str], tuple[str | None, str]] = {}
        rule, verdict = [], []
        for head in zip(hosts.to_pylist(), paths.to_pylist(), strict=True):
            if head not in known:
                hits = [k for k in candidate_keys(*head, depths, *most) if k in cascade]
                fits = sorted((k for k in hits if k in named), key=lambda k: (-len(k), k))
                known[head] = (named[fits[0]][1] if fits else None, named[fits[0]][0] if fits else "block" if hits else "allow")
            rule.append(known[head][0])
            verdict.append(known[head][1])
        return pa.StructArray.from_arrays([pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["rule", "verdict"])

    judged, at = F.arrow_udf(judge, "rule string, verdict string")("host", F.substring("path", 1, deepest)), free_name(parts, "judged")
    return parts.withColumn(at, judged).withColumn("rule", F.col(f"{at}.rule")).withColumn("verdict", F.col(f"{at}.verdict")).drop(at)


def op6_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on every page's url."""
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    rules = ", ".join(f"('{h}{p}', '{h}', '{p}', '{v}')" for v, h, p in RULES)
    hosts = ", ".join(f"('{h}')" for h in BLOCKED_HOSTS)
    return f"""
WITH rests AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
rules(rule, rule_host, rule_path, verdict) AS (VALUES {rules}),
blocked(name) AS (VALUES {hosts}),
fits AS (
  SELECT page_id, arg_min(rule, (-length(rule), rule)) AS rule, arg_min(verdict, (-length(rule), rule)) AS verdict
  FROM parts, rules
  WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id),
bad AS (SELECT DISTINCT page_id FROM parts, blocked WHERE host = name OR ends_with(host, '.' || name))
SELECT p.page_id, p.host, p.path, f.rule,
       coalesce(f.verdict, CASE WHEN b.page_id IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM parts p LEFT JOIN fits f USING (page_id) LEFT JOIN bad b ON b.page_id = p.page_id
"""


SQL = {"op6_url_cascade": _sql()}
