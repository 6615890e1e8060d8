"""Written tables and their folders."""

import os

from marketloom.llm.common import released, written
from marketloom.llm.components import components
from marketloom.session import shared_root


def test_released_tables_are_gone(spark):
    kept, gone = written(spark.range(5), "kept"), written(spark.range(7), "gone")
    folders = [os.path.dirname(df.inputFiles()[0].removeprefix("file://").removeprefix("file:")) for df in (kept, gone)]
    released(gone, spark.range(3))
    assert [os.path.exists(f) for f in folders] == [True, False] and kept.count() == 5
    released(gone)


def test_components_leave_only_their_last_edges(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (7, 7), (None, 3)]
    before = set(os.listdir(shared_root(spark)))
    got = components(spark.createDataFrame(edges, "a long, b long"), "a", "b")
    assert {r.node: r.component for r in got.collect()} == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    left = set(os.listdir(shared_root(spark))) - before
    assert len(left) == 1 and all(name.startswith("edges") for name in left)
