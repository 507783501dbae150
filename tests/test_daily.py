"""Daily facts are summed in parts whose size does not grow with the tables."""

import pytest
from compare import spark_rows

from shelfcast.catalog import fixtures as fx

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("of", [str, fx.BySupplier])
def test_daily_facts_are_dealt_by_their_lines(spark, monkeypatch, of):
    """Twice the lines are twice the parts, whatever the session's shuffle partitions are."""
    whole = fx.derive_daily(spark, of(SF_DIR))
    lines = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()
    monkeypatch.setattr(fx, "ROWS_A_TASK", -(-lines // 30))
    dealt = fx.derive_daily(spark, of(SF_DIR))
    assert dealt.rdd.getNumPartitions() == 30
    assert spark_rows(dealt) == spark_rows(whole)
