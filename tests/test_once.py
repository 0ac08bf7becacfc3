"""Sides are judged once for all that is asked of them."""

import pytest

from pagemend import queries
from pagemend.operators import health


@pytest.fixture
def judged(monkeypatch):
    """The numbers of sides of the reports that were asked for, in order."""
    seen = []
    monkeypatch.setattr(health, "side_health", lambda h, s, sides, *a, f=health.side_health: (seen.append(sides), f(h, s, sides, *a))[1])
    return seen


def test_rescued_sides_judges_only_the_collapsed_again(spark, sf, judged):
    rows = queries.rescued_sides(spark, sf).count()
    assert [x.count() for x in judged] == [spark.read.parquet(f"{sf}/documents.parquet").count(), rows]


def test_merged_lines_judges_once_and_cuts_the_plan(spark, sf, judged):
    out = queries.merged_lines(spark, sf)
    assert len(judged) == 1
    assert out._jdf.queryExecution().optimizedPlan().toString().count("benchmark") == 0 and "dictionary_ratio" not in out._jdf.queryExecution().optimizedPlan().toString()
