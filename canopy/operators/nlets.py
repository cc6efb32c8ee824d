"""Anchors with positives and negatives, picked by stable hashes instead of a random stream.

A group's rows are numbered in hash order, and an anchor picks the number that its own hash gives,
so a pick is an equality join and no group is gathered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions.names import hashed
from canopy.operators.graph import within_groups

#: Ranges of the hash that the members of one group are numbered in, so that a large group is not one task.
RANGES = 1024


def _numbered(rows: DataFrame, group: str, seed: int) -> DataFrame:
    """rows with `__i`, the place in the group from 0, and `__n`, its size."""
    w = Window.partitionBy(group)
    return rows.withColumn("__i", F.row_number().over(w.orderBy(hashed(F.col("id"), seed), "id")) - 1).withColumn("__n", F.count("*").over(w))


def positives(rows: DataFrame, group: str = "label", seed: int = 0) -> DataFrame:
    """(id, positive): another member of the group; a lone member is its own."""
    own = _numbered(rows.select("id", group), group, seed)
    step = F.when(F.col("__n") > 1, 1 + hashed(F.col("id"), seed + 1) % (F.col("__n") - 1)).otherwise(0)
    asked = own.select("id", group, ((F.col("__i") + step) % F.col("__n")).alias("__i"))
    return asked.join(own.select(group, "__i", F.col("id").alias("positive")), [group, "__i"]).select("id", "positive")


def negatives(rows: DataFrame, group: str = "label", seed: int = 0, within: str | None = None) -> DataFrame:
    """(id, negative): a uniformly picked other group, then a uniformly picked member of it.

    within: a column that both must share, as in a negative of the same species. Anchors without
    another group get no row.
    """
    scope = [within] if within else []
    one = F.lit(0) if not within else None
    base = rows.select("id", group, *scope)
    if one is not None:
        base, scope = base.withColumn("__s", one), ["__s"]
    groups = base.groupBy(*scope, group).agg(F.min("id").alias("__low"), F.count("*").alias("__m"))
    w = Window.partitionBy(*scope)
    groups = groups.withColumn("__g", F.row_number().over(w.orderBy("__low")) - 1).withColumn("__k", F.count("*").over(w))
    placed = base.join(groups.select(*scope, group, "__g", "__k"), [*scope, group]).where("__k > 1")
    other = (F.col("__g") + 1 + hashed(F.col("id"), seed + 2) % (F.col("__k") - 1)) % F.col("__k")
    asked = placed.select("id", *scope, other.alias("__g")).join(groups.select(*scope, "__g", F.col(group).alias("__other"), "__m"), [*scope, "__g"])
    asked = asked.select("id", *scope, "__other", (hashed(F.col("id"), seed + 3) % F.col("__m")).alias("__i"))
    part = Window.partitionBy(*scope, group).orderBy(hashed(F.col("id"), seed), "id")
    members = base.select(*scope, F.col(group).alias("__other"), F.col("id").alias("negative"), (F.row_number().over(part) - 1).alias("__i"))
    return asked.join(members, [*scope, "__other", "__i"]).select("id", "negative")


def onelets(rows: DataFrame) -> DataFrame:
    return rows.select("id")


def pairs(rows: DataFrame, group: str = "label", seed: int = 0) -> DataFrame:
    return positives(rows, group, seed)


def triplets(rows: DataFrame, group: str = "label", seed: int = 0, within: str | None = None) -> DataFrame:
    """(id, positive, negative)."""
    return positives(rows, group, seed).join(negatives(rows, group, seed, within), "id")


def quadlets(rows: DataFrame, group: str = "label", seed: int = 0) -> DataFrame:
    """(id, positive, anchor_negative, negative): negative is the positive of the negative anchor."""
    t = triplets(rows, group, seed).withColumnRenamed("negative", "anchor_negative")
    return t.join(positives(rows, group, seed).toDF("anchor_negative", "negative"), "anchor_negative").select("id", "positive", "anchor_negative", "negative")


#: The n-lets that a loss needs, by the start of its name.
BY_LOSS = {"softmax": onelets, "ntxent": pairs, "offline": triplets, "online": quadlets, "distillation": triplets, "mae_mse": onelets}


def for_loss(loss: str) -> Callable[..., DataFrame]:
    """What builds the n-lets of a loss."""
    fits = [name for name in BY_LOSS if loss.startswith(name)]
    if not fits:
        raise ValueError(f"no n-lets are known for loss {loss}; it must start with {', '.join(BY_LOSS)}")
    return BY_LOSS[max(fits, key=len)]


def cross_encounter(rows: DataFrame, group: str = "label", video: str = "individual_video_id", seed: int = 0, hard: bool = False) -> DataFrame:
    """(id, positive): a member seen in another video, unless the group has only one video (then another member).

    hard: groups with one video give no rows. The members of a group are ordered by video, and an anchor
    jumps past its own video's members.
    """
    w = Window.partitionBy(group)
    own = rows.select("id", group, video)
    placed = own.withColumn("__i", F.row_number().over(w.orderBy(video, hashed(F.col("id"), seed), "id")) - 1).withColumn("__n", F.count("*").over(w))
    v = Window.partitionBy(group, video)
    placed = placed.withColumn("__m", F.count("*").over(v)).withColumn("__first", F.min("__i").over(v))
    several = F.col("__m") < F.col("__n")
    if hard:
        placed = placed.where(several)
    jump = hashed(F.col("id"), seed + 1)
    outside = (F.col("__first") + F.col("__m") + jump % (F.col("__n") - F.col("__m"))) % F.col("__n")
    inside = F.when(F.col("__n") > 1, (F.col("__i") + 1 + jump % (F.col("__n") - 1)) % F.col("__n")).otherwise(F.col("__i"))
    asked = placed.select("id", group, F.when(several, outside).otherwise(inside).alias("__i"))
    return asked.join(placed.select(group, "__i", F.col("id").alias("positive")), [group, "__i"]).select("id", "positive")


def clique_negatives(own: DataFrame, cuts: DataFrame, seed: int = 0) -> DataFrame:
    """(id, negative): own (vertex, root), cuts (a, b) between roots, both ways. Uniform over all members of all adjacent cliques.

    Each adjacent clique owns a range of the anchor's draws, as long as it has members.
    """
    ranges = _ranges(own, cuts)
    totals = ranges.select("a", "total").distinct()
    asked = own.join(totals, own["root"] == totals["a"]).select("vertex", "a", (hashed(F.col("vertex"), seed + 1) % F.col("total")).alias("draw"))
    return _hit(asked, own, ranges, seed)


def _ranges(own: DataFrame, cuts: DataFrame) -> DataFrame:
    """(a, b, low, high, total): the range of draws of a that falls to the adjacent root b, and how many draws a has."""
    sizes = own.groupBy("root").agg(F.count("*").alias("m"))
    upto = Window.partitionBy("a").orderBy("b")
    return cuts.join(sizes.withColumnRenamed("root", "b"), "b").withColumn("high", F.sum("m").over(upto)).withColumn("low", F.col("high") - F.col("m")).withColumn("total", F.sum("m").over(Window.partitionBy("a")))


def _hit(asked: DataFrame, own: DataFrame, ranges: DataFrame, seed: int) -> DataFrame:
    """(id, negative) of asked (vertex, a, draw): the member that the draw falls to."""
    w = Window.partitionBy("root").orderBy(hashed(F.col("vertex"), seed), "vertex")
    members = own.select("root", "vertex", (F.row_number().over(w) - 1).alias("__i"))
    hit = asked.join(ranges.select("a", "b", "low", "high"), "a").where("draw >= low and draw < high").select("vertex", F.col("b").alias("root"), (F.col("draw") - F.col("low")).alias("__i"))
    return hit.join(members.withColumnRenamed("vertex", "negative"), ["root", "__i"]).select(F.col("vertex").alias("id"), "negative")


def layered_negatives(own: DataFrame, cuts: DataFrame, groups: DataFrame, seed: int = 0) -> DataFrame:
    """(id, negative): as clique_negatives, where besides cuts all roots of different groups are cut apart, as children of
    parents of different groups are. groups: (root, g), one row for each root that has a group.

    Members are numbered group after group, so a draw from all other groups is a number outside the anchor's own
    range, and one equality join: the pairs of roots are never made.
    """
    part = F.floor(hashed(F.col("vertex"), seed) * RANGES / (1 << 32)).alias("__k")
    placed = own.join(groups, "root").select("root", "vertex", "g", part)
    parts = placed.groupBy("g", "__k").agg(F.count("*").alias("m"))
    before = Window.orderBy("g", "__k").rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES rows for each group
    parts = parts.withColumn("low", F.coalesce(F.sum("m").over(before), F.lit(0))).withColumn("every", F.sum("m").over(Window.partitionBy()))
    within = Window.partitionBy("g", "__k").orderBy(hashed(F.col("vertex"), seed), "vertex")
    members = placed.join(parts, ["g", "__k"]).select(F.col("vertex").alias("negative"), (F.col("low") + F.row_number().over(within) - 1).alias("place"))
    span = parts.groupBy("g").agg(F.min("low").alias("start"), F.sum("m").alias("m"), F.max("every").alias("every"))
    far = groups.join(span, "g").select("root", "start", "m", (F.col("every") - F.col("m")).alias("far"))
    ranges = _ranges(own, within_groups(cuts, groups))
    near = ranges.select(F.col("a").alias("root"), F.col("total").alias("near")).distinct()
    asked = own.join(far, "root", "left").join(near, "root", "left").na.fill(0, ["far", "near"]).where("far + near > 0")
    asked = asked.withColumn("draw", hashed(F.col("vertex"), seed + 1) % (F.col("far") + F.col("near")))
    place = F.when(F.col("draw") < F.col("start"), F.col("draw")).otherwise(F.col("draw") + F.col("m")).alias("place")
    outer = asked.where("draw < far").select(F.col("vertex").alias("id"), place).join(members, "place").select("id", "negative")
    inner = asked.where("draw >= far").select("vertex", F.col("root").alias("a"), (F.col("draw") - F.col("far")).alias("draw"))
    return outer.union(_hit(inner, own, ranges, seed))


def first_of(rows: DataFrame, group: str, order: str) -> DataFrame:
    """One row id of each group, the first in an order."""
    return rows.groupBy(group).agg(F.min_by("id", order).alias("id"))


def batches(rows: DataFrame, rank: Column, size: int, drop_last: bool, total: int) -> DataFrame:
    """rows with the number of their batch; an incomplete last batch may go."""
    out = rows.withColumn("batch", F.floor(rank / size).cast("bigint"))
    return out.where(F.col("batch") < total // size) if drop_last else out
