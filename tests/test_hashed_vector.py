import pytest
from pyspark.sql import functions as F

from ledgerleaf.operators import releases


def test_digests_are_made_once_a_row(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "t string").select(releases.hashed_vector(F.col("t"), 4).alias("v"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("sha2(") == 1
    assert all(sum(x * x for x in r.v) == pytest.approx(1) for r in rows.collect())
