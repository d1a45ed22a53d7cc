"""What the plans read and move."""

import os

import pytest

from quarryframe import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no data")


def _plan(spark, name):
    return catalogue.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["glob_filter", "language_tag", "longest_prefix_module", "rebuild_scope", "lookup_completeness", "source_not_indexed", "cache_victims", "active_scan"])
def test_content_is_not_read(spark, name):
    plan = _plan(spark, name)
    assert "ReadSchema" in plan
    assert "content:string" not in plan


@pytest.mark.parametrize("name", ["coverage_basis", "scan_coverage", "line_count", "literal_contains"])
def test_content_is_not_moved(spark, name):
    lines = catalogue.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString().split("\n")
    # below the reduction the text is turned into what is asked of it
    assert any("contains(" in x.lower() or "length(" in x or "sha2(" in x for x in lines)
    assert not any("v, content#" in x for x in lines)
