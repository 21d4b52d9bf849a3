"""Connected components, by rounds and in one task."""

from __future__ import annotations

import pytest

from peakloom.llm import graph


@pytest.mark.parametrize("local_rows", [0, 3, 500_000])
def test_components(spark, local_rows):
    edges = [(5, 4), (4, 3), (3, 9), (20, 21), (21, 20), (7, 7), (-4, 30), (30, 8), (40, 30), (None, 1), (2, None)]
    got = graph.components(spark.createDataFrame(edges, "a long, b long"), local_rows=local_rows)
    assert dict(map(tuple, got.collect())) == {3: 3, 4: 3, 5: 3, 9: 3, 20: 20, 21: 20, -4: -4, 30: -4, 8: -4, 40: -4} and got.count() == 10


def test_small_graphs_take_few_jobs(spark):
    n = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    before = n()
    graph.components(spark.range(60).selectExpr("id AS a", "id + 1 AS b"))
    assert n() - before <= 6
