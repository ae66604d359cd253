"""Canonical forms made in Arrow batches, against the single passes they stand for."""

import random

from pyspark.sql import functions as F

from sluice.functions import fingerprints as P
from sluice.functions import phrases as R
from sluice.functions import text as T

from .test_passes import PIECES


def test_normalize_is_its_passes_in_turn_and_costs_one_of_them(spark):
    g = random.Random(7)
    more = [*PIECES, "​", "ＦＲ", "Ⓐ", "ΑΣ", "é", "ﬁ", "🅰"]
    texts = ["".join(g.choice(more) for _ in range(g.randrange(14))) for _ in range(4000)]
    x = F.col("x")
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "x string").repartition(4).select("x", T.normalize(x).alias("got"), P.skeleton(x).alias("shape"))
    # A chain of patterns in the JVM made a text canonical several times over.
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace") == 0
    passes = T.squeeze(T.strip_digits(F.lower(T.strip_emoji(T.nfkc(T.strip_zero_width(x))))))
    assert rows.where(~F.col("got").eqNullSafe(passes)).count() == 0
    assert rows.where("x is null and (got is not null or shape is not null)").count() == 0


def test_names_after_letters_beyond_the_basic_plane_are_no_mentions(spark):
    rows = spark.createDataFrame([("𝒜@abc",), ("中@abc",), ("!@abc ab cdſ ef gh, ab",)], "x string").select(P.skeleton(F.col("x")).alias("v"))
    assert [r.v for r in rows.collect()] == ["𝒜 @ <w>", "中 @ <w>", "! <mention> <w> cdſ <w> , <w>"]


def test_simhash_is_the_one_of_the_canonical_text(spark):
    rows = spark.createDataFrame([(1, "ＦＲＥＥ 🚀 money 12"), (2, "free money"), (3, None)], "k int, x string")
    got = {r.k: r.simhash for r in P.simhash(rows, "k", "x").collect()}
    assert got[1] == got[2] and got[3] == "0"


def test_phrases_stop_at_the_limit_as_if_all_were_made(spark):
    g = random.Random(2)
    texts = [" ".join("".join(g.choice("日赚过万收钱ab_") for _ in range(g.randrange(40))) for _ in range(g.randrange(9))) for _ in range(300)] + ["".join(g.choice("日赚过万收钱") for _ in range(90)) for _ in range(5)]

    def every(text):
        found = [text] if text else []
        for run in R._RUNS.findall(text):
            found += [run, *(run[i : i + n] for n in range(3, 13) for i in range(len(run) - n + 1) if run >= "一")]
        return list(dict.fromkeys(found))[:256]

    rows = spark.createDataFrame([(t,) for t in texts], "x string").select("x", R.candidates(F.col("x")).alias("v")).collect()
    assert all(r.v == every(r.x) for r in rows) and any(len(r.v) == 256 for r in rows)
