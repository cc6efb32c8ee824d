"""Constraint graphs as edge tables: components (merges), cuts between them, layers of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopy.sources.scratch import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (a, b). Large star: neighbours above a vertex move to its least neighbour. Small: those below.
    Neither makes more rows than there are edges; equal rows may remain."""
    both = edges.union(edges.select("b", "a")) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b")


def roots(edges: DataFrame, scratch: Scratch, rounds: int = 100, rows: int | None = None) -> DataFrame:
    """edges: (a, b), two comparable non-null columns of one type. Returns (vertex, root) of every
    vertex but the roots themselves; a root is the least vertex of its component.

    rows: about how many edges there are at most, if that is known (see Scratch.keep).

    Each step groups by key with partial aggregates and joins the least neighbour back, so a vertex
    with a third of all edges is never gathered into one task. Every round is written to the shared
    folder, which cuts lineage; only a count and a checksum of the edges reach the driver.
    """
    held = scratch.keep(edges.select("a", "b").where("a <> b").distinct(), rows)
    rows, mark = held.count(), None
    for _ in range(rounds):
        if not rows:
            return held.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
        after = scratch.keep(_star(_star(held, True), False).distinct(), rows)
        seen = after.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        scratch.drop(held)
        held, rows = after, seen["n"]
        if (seen["n"], seen["x"]) == mark:
            return held.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
        mark = (seen["n"], seen["x"])
    raise RuntimeError("components did not settle")


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b): (vertex, root) of every vertex that an edge touches; root is the least of its component."""
    scratch = Scratch(edges.sparkSession, "graph")
    kept = scratch.keep(edges.select("a", "b").distinct())
    vertices = kept.select(F.col("a").alias("vertex")).union(kept.select("b")).distinct()
    return vertices.join(roots(kept, scratch), "vertex", "left").select("vertex", F.coalesce("root", "vertex").alias("root"))


def cliques(vertices: DataFrame, merges: DataFrame) -> DataFrame:
    """(vertex, root) of all vertices: what merges join, represented by its least member."""
    own = components(merges)
    return vertices.select("vertex").distinct().join(own, "vertex", "left").select("vertex", F.coalesce("root", "vertex").alias("root"))


def root_cuts(own: DataFrame, cuts: DataFrame) -> DataFrame:
    """(a, b): distinct cut edges between roots, in both directions; a row with a = b is a conflict."""
    left, right = own.select(F.col("vertex").alias("a"), F.col("root").alias("ra")), own.select(F.col("vertex").alias("b"), F.col("root").alias("rb"))
    one = cuts.select("a", "b").join(left, "a").join(right, "b").select("ra", "rb")
    return one.union(one.select("rb", "ra")).distinct().toDF("a", "b")


def conflicts(own: DataFrame, cuts: DataFrame) -> DataFrame:
    """Cuts inside one clique."""
    left, right = own.select(F.col("vertex").alias("a"), F.col("root").alias("ra")), own.select(F.col("vertex").alias("b"), F.col("root").alias("rb"))
    return cuts.select("a", "b").join(left, "a").join(right, "b").where("ra = rb").select("a", "b")


def layered_cuts(own: DataFrame, cuts: DataFrame, parents: DataFrame, parent_roots: DataFrame, parent_cuts: DataFrame) -> DataFrame:
    """Cut edges between roots of a layer: its own, and between children of cliques that the layer above cuts apart.

    own: (vertex, root) of this layer; parents: (vertex, parent); parent_roots: (vertex, root) above; parent_cuts:
    (a, b) between roots above. Adjacency is between distinct roots, so a clique counts once however many members it has.
    """
    up = parent_roots.select(F.col("vertex").alias("parent"), F.col("root").alias("up"))
    above = own.join(parents, "vertex").join(up, "parent").select("root", "up").distinct()
    left, right = above.select(F.col("up").alias("a"), F.col("root").alias("ra")), above.select(F.col("up").alias("b"), F.col("root").alias("rb"))
    inherited = parent_cuts.join(left, "a").join(right, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    return root_cuts(own, cuts).union(inherited).distinct()


def layered_degrees(own: DataFrame, cuts: DataFrame, groups: DataFrame) -> DataFrame:
    """(root, neighbours): of each root, how many it is cut from, where besides cuts all roots of different groups are
    apart, as children of parents of different groups are. Those pairs are counted, never made.

    own: (vertex, root); cuts: (a, b) between vertices; groups: (root, g), one row for each root that has a group.
    """
    sizes = groups.groupBy("g").agg(F.count("*").alias("m"))
    others = sizes.select("g", (F.sum("m").over(Window.partitionBy()) - F.col("m")).alias("others"))  # a row for each group
    far = groups.join(others, "g").select("root", F.col("others").alias("n"))
    near = within_groups(root_cuts(own, cuts), groups).groupBy(F.col("a").alias("root")).agg(F.count("*").alias("n"))
    return far.union(near).groupBy("root").agg(F.sum("n").alias("neighbours")).where("neighbours > 0")


def within_groups(cuts: DataFrame, groups: DataFrame) -> DataFrame:
    """Cuts (a, b) between roots that do not lie in two different groups."""
    left, right = groups.select(F.col("root").alias("a"), F.col("g").alias("ga")), groups.select(F.col("root").alias("b"), F.col("g").alias("gb"))
    return cuts.join(left, "a", "left").join(right, "b", "left").where("not coalesce(ga <> gb, false)").select("a", "b")


def merge_siblings(parents: DataFrame) -> DataFrame:
    """(vertex, root): vertices of one parent form a clique; no components needed."""
    return parents.join(parents.groupBy("parent").agg(F.min("vertex").alias("root")), "parent").select("vertex", "root")


def clique_parents(own: DataFrame, parents: DataFrame) -> DataFrame:
    """(root, parent, ok): a clique's parent, and whether its members agree; parent 0 is a parent like any other."""
    return own.join(parents, "vertex", "left").groupBy("root").agg(F.max("parent").alias("parent"), (F.count_distinct("parent") <= 1).alias("ok"))


def pruned(own: DataFrame, cuts: DataFrame) -> DataFrame:
    """Members of cliques that some cut touches."""
    return own.join(cuts.select(F.col("a").alias("root")).distinct(), "root", "left_semi").select("vertex", "root")


def partitioned(own: DataFrame, cuts: DataFrame, u: int, v: int) -> bool:
    """Whether a cut (between roots) separates the cliques of two vertices."""
    two = own.where(F.col("vertex").isin(u, v))
    left, right = two.where(F.col("vertex") == u).select(F.col("root").alias("a")), two.where(F.col("vertex") == v).select(F.col("root").alias("b"))
    return not cuts.join(left, "a", "left_semi").join(right, "b", "left_semi").isEmpty()


def connected(own: DataFrame, u: int, v: int) -> bool:
    return own.where(F.col("vertex").isin(u, v)).select("root").distinct().count() == 1
