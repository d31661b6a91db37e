import importlib
import sys

import pytest

SF = "/root/testdata/sf0.001"


def test_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert {"p2_found", "p3_found", "p5_found"} <= set(e.queries())
    assert e.entry(spark).columns


@pytest.mark.parametrize("name", ["m3_moving_long_avg", "m3_diff", "case_errors_share", "matrix_json", "prom_rate"])
def test_queries_run(spark, name):
    import __spark_entry__ as e

    assert e.queries()[name](spark, SF).count() >= 0


def test_entry_without_the_optional_package(monkeypatch):
    for m in [m for m in sys.modules if m.startswith("tidegrid.llm")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setitem(sys.modules, "tidegrid.llm", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    e = importlib.import_module("__spark_entry__")
    assert "p2_found" in e.queries() and not any(n.startswith(("p1_", "p4_", "p6_", "p7_", "p8_")) for n in e.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")
