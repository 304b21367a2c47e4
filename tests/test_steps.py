"""Steps that several later ones read are made once."""

import pytest
from conftest import SF

from folioframe.plans import catalog


@pytest.mark.parametrize("name", ["merged_items", "greedy_dedup", "line_chain", "merged_blocks", "cell_report", "unified_flow"])
def test_items_are_made_once(spark, name):
    """Numbering the items of a page deals and sorts the whole table: no later step does it anew."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Window [" in line and "l_linestatus" in line]
