"""Groups that may be as large as the table are never one row, one buffer or one task."""

import pytest

from loomwright.operators import relational as R
from loomwright.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_indices_per_class_are_rows(spark):
    rows = [(("a", "b", None)[i % 3 if i % 5 else 0], (i * 37) % 1000) for i in range(1000)]
    got = R.indices_per_class(spark.createDataFrame(rows, "label string, i long"), "label", "i")
    assert got.columns == ["label", "ordinal", "i"]
    found = {}
    for r in sorted(got.collect(), key=lambda r: r.ordinal):
        found.setdefault(r.label, []).append((r.ordinal, r.i))
    assert found == {x: list(enumerate(sorted(i for y, i in rows if y == x))) for x in ("a", "b", None)}


@pytest.mark.parametrize("name", ["indices_per_class", "nested_min_max", "ordinal_then_filter"])
def test_no_group_is_gathered(spark, name):
    plan = catalogue.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_" not in plan and "row_number()" not in plan
