"""Every registered query against its DuckDB oracle (row count, columns, value hash),
and the driver's smoke entry point."""

import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import __spark_entry__ as E  # noqa: E402
import tools_check  # noqa: E402
from canlens.plans import registry  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["ordinal", "can_id", "message_name", "signal_index", "signal_name", "raw_value",
                          "value", "unit", "value_description"]


def test_every_query_has_an_oracle():
    assert set(registry.QUERIES) == set(registry.ORACLES)
    assert set(registry.QUERIES) <= set(E.queries()) and set(registry.ORACLES) <= set(E.oracle_sql())


def test_registry_against_duckdb(spark):
    res = tools_check.main(SF, only=set(registry.QUERIES), spark=spark, verbose=False)
    bad = {k: v for k, v in res.items() if v != "OK"}
    assert not bad, bad
