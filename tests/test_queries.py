"""Registered queries against their SQL, on the smallest test set, and the shape of their plans."""

import pyarrow as pa
import pytest

import __spark_entry__ as entry
import check
from velum.plans.catalog import CATALOG
from velum.plans.oracle import ORACLES

SF = "/root/testdata/sf0.001"
@pytest.fixture(scope="module")
def database():
    return check.database(SF)


@pytest.mark.parametrize("name", list(CATALOG))
def test_equals_sql(spark, database, name):
    got = entry.queries()[name](spark, SF).toArrow()
    assert check.compare(got, check.answer(database, entry.oracle_sql()[name])) == "ok"


def test_every_query_has_sql():
    assert set(CATALOG) == set(ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_comparison_sees_nulls_types_and_rows():
    def table(values, type_):
        return pa.table({"x": pa.array(values, type_)})

    assert check.compare(table([1, None], pa.int64()), table([None, 1], pa.int64())) == "ok"
    assert check.compare(table([""], pa.string()), table([""], pa.large_string())) == "ok"
    for a, b in (
        (table([""], pa.string()), table([None], pa.string())),
        (table([1], pa.int64()), table([1], pa.int32())),
        (table([1.0], pa.float64()), table([1], pa.int64())),
        (table([1, 1], pa.int64()), table([1], pa.int64())),
    ):
        assert check.compare(a, b) != "ok"


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_detector_and_masking_do_not_shuffle(spark):
    for name in ("analyze", "mask_items", "shift_dates"):
        plan = CATALOG[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
        assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
