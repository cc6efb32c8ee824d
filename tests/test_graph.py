"""Constraint graphs on hand-computed cases."""

import pytest

from canopy.operators import graph


def frame(spark, rows, names):
    return spark.createDataFrame(rows, ", ".join(f"{n} bigint" for n in names.split()))


def test_union_find(spark):
    own = {r["vertex"]: r["root"] for r in graph.cliques(frame(spark, [(i,) for i in range(10)], "vertex"), frame(spark, [(1, 2), (2, 3)], "a b")).collect()}
    assert own[1] == own[2] == own[3] == 1 and own[0] == 0 and len(own) == 10


def test_components_of_nothing(spark):
    assert graph.components(frame(spark, [], "a b")).count() == 0


def test_long_path_and_star(spark):
    path = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1200)]
    own = {r["vertex"]: r["root"] for r in graph.components(frame(spark, path, "a b")).collect()}
    assert {own[i] for i in range(201)} == {0} and {own[i] for i in range(1000, 1200)} == {1000}


@pytest.fixture(scope="module")
def clique(spark):
    own = graph.cliques(frame(spark, [(i,) for i in range(5)], "vertex"), frame(spark, [(0, 1), (1, 2)], "a b"))
    return own, graph.root_cuts(own, frame(spark, [(2, 3), (3, 4)], "a b"))


def test_clique_graph(clique):
    own, cuts = clique
    members = {}
    for r in own.collect():
        members.setdefault(r["root"], set()).add(r["vertex"])
    assert members == {0: {0, 1, 2}, 3: {3}, 4: {4}}
    assert graph.partitioned(own, cuts, 0, 3) and not graph.partitioned(own, cuts, 0, 1)
    assert graph.connected(own, 0, 2) and not graph.connected(own, 0, 4)


def test_merge_then_connected(spark):
    own = graph.cliques(frame(spark, [(i,) for i in range(5)], "vertex"), frame(spark, [(0, 1), (1, 2), (1, 4)], "a b"))
    assert graph.connected(own, 0, 4)


def test_conflict(spark, clique):
    own, _ = clique
    assert [tuple(r) for r in graph.conflicts(own, frame(spark, [(0, 1), (0, 3)], "a b")).collect()] == [(0, 1)]


def test_indexed_representatives(spark):
    own = graph.cliques(frame(spark, [(3,), (1,), (0,), (4,), (2,)], "vertex"), frame(spark, [(0, 1), (0, 3)], "a b"))
    assert {r["vertex"]: r["root"] for r in own.collect()} == {0: 0, 1: 0, 3: 0, 2: 2, 4: 4}


def test_two_layers(spark):
    parents = frame(spark, [(10 * p + i, p) for p in (1, 2, 3) for i in (1, 2, 3)], "vertex parent")
    above = graph.cliques(frame(spark, [(1,), (2,), (3,)], "vertex"), frame(spark, [], "a b"))
    above_cuts = graph.root_cuts(above, frame(spark, [(1, 2)], "a b"))
    own = graph.cliques(parents.select("vertex"), frame(spark, [(12, 13)], "a b"))
    cuts = graph.layered_cuts(own, frame(spark, [(11, 12), (21, 22)], "a b"), parents, above, above_cuts)
    part = lambda u, v: graph.partitioned(own, cuts, u, v)
    assert part(11, 12) and part(11, 13) and part(11, 21) and part(11, 22) and part(12, 21)
    assert not part(12, 13) and graph.connected(own, 12, 13)
    assert not part(11, 31)
    assert {(r["root"], r["parent"], r["ok"]) for r in graph.clique_parents(own, parents).collect()} >= {(12, 1, True), (31, 3, True)}


def test_siblings_and_pruning(spark):
    own = graph.merge_siblings(frame(spark, [(5, 0), (7, 0), (9, 1)], "vertex parent"))
    assert {(r["vertex"], r["root"]) for r in own.collect()} == {(5, 5), (7, 5), (9, 9)}
    cuts = graph.root_cuts(own, frame(spark, [(7, 9)], "a b"))
    assert graph.pruned(own, cuts).count() == 3
    assert graph.pruned(own, graph.root_cuts(own, frame(spark, [], "a b"))).count() == 0
