"""Numbers as text."""

import shutil

from pyspark.sql import functions as F

from sluice.functions.text import number_text
from sluice.plans import QUERIES, SQL

from .oracle import compare

SF = "/root/testdata/sf0.001"


def test_number_text_is_what_python_writes(spark):
    values = [0.0, 50.0, 100.0, 0.001, 0.0001, 1e-4 * 1.5, 9.090909090900823e-05, 1e-5, 1e-10, 2.5e-300, -0.0005, -1e-7, 1e6, 1e7, 12345678.25, 123456789012345.0, 1e15, 1e16, 1.5e16, 2.5e17, -1e17]
    rows = spark.createDataFrame([(v,) for v in [*values, None]], "v double").select("v", number_text(F.col("v")).alias("t")).collect()
    assert [r.t for r in rows] == [None if r.v is None else repr(r.v) for r in rows]


def test_payload_of_senders_with_hardly_any_reputation(spark, tmp_path):
    """Balances just above the least, as large tables have them: reputations below 1e-3."""
    sf = tmp_path / "sf"
    shutil.copytree(SF, sf, ignore=shutil.ignore_patterns("customer.parquet"))
    customers = spark.read.parquet(f"{SF}/customer.parquet")
    customers.withColumn("c_acctbal", F.expr("-1000 + (c_custkey % 12) / 100.0D").cast("double")).toPandas().to_parquet(sf / "customer.parquet")
    compare(spark, str(sf), QUERIES["llm_payload"], SQL["llm_payload"])
