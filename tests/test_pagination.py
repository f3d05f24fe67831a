"""Trials of pagination meet by aggregation alone."""

from martlens.operators import state


def test_pagination_has_no_join(spark):
    """A join's side of ids was sent to the tasks whole, through the driver."""
    rows = [(r, "page", "page", p, f"{i}{'x' if p == 2 and r == 1 else ''}") for r in (1, 2) for p in (1, 2) for i in range(3)] + [(2, "offset", "start", 1, "a"), (2, "offset", "start", 2, "b"), (3, "page", "page", 2, "c"), (3, "page", "page", 1, "")]
    out = state.detect_pagination(spark.createDataFrame(rows, "recipe long, style string, param string, page int, id string"))
    assert sorted(map(tuple, out.collect())) == [(1, "page", "page"), (2, "offset", "start")]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
