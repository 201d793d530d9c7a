"""Paths and cycles of any length."""

from corvane.operators import graph, series


def test_paths_longer_than_six_hops(spark):
    e = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(9)] + [("n3", "n1"), ("n9", "n9")], "source_id string, target_id string")
    assert [tuple(r) for r in graph.shortest_path(e, "n0", "n9").collect()] == [(9, ">".join(f"n{i}" for i in range(10)))]
    assert graph.shortest_path(e, "n0", "n9", most=6).count() == graph.shortest_path(e, "n9", "n0").count() == 0
    assert [tuple(r) for r in graph.shortest_path(e, "n2", "n2").collect()] == [(0, "n2")]


def test_cycles_longer_than_thirteen_steps(spark):
    e = spark.createDataFrame([(i, (i + 1) % 16) for i in range(16)] + [(20, 3), (30, 30)], "a int, b int")
    assert dict(tuple(r) for r in series.shortest_cycles(e).collect()) == {**dict.fromkeys(range(16), 16), 30: 1}
