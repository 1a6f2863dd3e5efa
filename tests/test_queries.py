"""Every profile query against its SQL on the smallest tables; those without SQL must give rows."""

import re

import pytest
from conftest import canonical

from locusframe.plans.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    if name not in ORACLES:
        assert rows
        return
    found = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(found.columns)
    assert canonical(rows, df.columns) == canonical(found.fetchall(), found.columns)


#: Operators that pair tables; none of them may do so without a key or by a constant one.
PAIRING = ["peaks_above", "call_alleles", "allele_confusion", "decode_hid_values", "bp_to_pixel", "marker_windows", "adjust_panel", "nearest_allele", "nearest_peak", "segmentation_mask", "best_ladder", "resample_profile"]


@pytest.mark.parametrize("name", PAIRING)
def test_plan_stays_in_the_jvm_and_joins_by_keys(spark, sf, name):
    df = QUERIES[name](spark, sf)
    execution = df._jdf.queryExecution()
    plan, logical = execution.executedPlan().toString(), execution.analyzed().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "Python" not in plan
    for column in re.findall(r"Join \w+, \((\w+#\d+) = (\w+#\d+)\)", logical):
        for side in column:  # a key that is a literal makes a cross join
            assert not re.search(rf"(?<![#\w])(\d+|true|null) AS {side}\b", logical), (name, side)


def test_entry_points():
    import __spark_entry__ as entry

    assert set(ORACLES) <= set(entry.oracle_sql()) and set(QUERIES) <= set(entry.queries())
