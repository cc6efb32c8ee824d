"""Embedding analytics: nearest neighbours, distances, triplets, prototypes, de-duplication.

Neighbours come from blocks: rows fall into blocks by a hash, each query row is sent to every block
once, and one task scores one block of queries against one block of candidates with a matrix
product and keeps the k best of each. The work is that of all pairs; no pair is ever a row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions.names import hashed
from canopy.operators.graph import components

#: Rows in one block, about.
BLOCK = 4096


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def angular(a: Column, b: Column) -> Column:
    """(1 - cos) / 2, between 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 - cosine(a, b)) / 2))


def normalised(v: Column) -> Column:
    return F.transform(v, lambda x: F.try_divide(x, F.sqrt(dot(v, v))))


def _matrix(table: pa.Table) -> np.ndarray:
    flat = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(table), -1).astype(float)


def _measure(metric: str) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)

    def square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.maximum((a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1), 0)

    return {"squared": square, "euclidean": lambda a, b: np.sqrt(square(a, b)), "cosine": lambda a, b: 1 - unit(a) @ unit(b).T}[metric]


def nearest(queries: DataFrame, candidates: DataFrame, k: int, metric: str = "euclidean", differ: str | None = None, same: str | None = None, own: bool = False, below: float | None = None) -> DataFrame:
    """(id, rank, neighbour, d): the k nearest candidates of every query, ties to the smaller id.

    Both have id (bigint) and v (array<double>) and, where named, the columns differ (neighbours
    must not share its value, as cross-video search asks) and same (they must). own: a row may be its
    own neighbour. below: only distances under it count. Rows with a null vector take no part.
    """
    extra = [c for c in (differ, same) if c]
    n = candidates.count()
    blocks = max(1, -(-n // BLOCK))
    key = [same] if same else []
    q = queries.where("v is not null").select(F.col("id").cast("bigint").alias("id"), "v", *extra)
    c = candidates.where("v is not null").select(F.col("id").cast("bigint").alias("id"), "v", *extra)
    q = q.withColumn("qb", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    c = c.withColumn("cb", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(blocks)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    q, c = (x.select(*(F.col(n).alias(n) for n in x.columns)) for x in (q, c))  # apart from a common origin
    measure = _measure(metric)

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if len(left) and len(right):
            d = measure(_matrix(left), _matrix(right))
            lid, rid = left["id"].to_numpy(), right["id"].to_numpy()
            if not own:
                d[lid[:, None] == rid] = np.inf
            if differ:
                lv, rv = np.array(left[differ].to_pylist(), object), np.array(right[differ].to_pylist(), object)
                d[lv[:, None] == rv] = np.inf
            if below is not None:
                d[d >= below] = np.inf
            order = np.lexsort((np.broadcast_to(rid, d.shape), d), axis=1)[:, :k]
            best = np.take_along_axis(d, order, axis=1)
            rows, cols = np.nonzero(np.isfinite(best))
            out = [lid[rows], rid[order[rows, cols]], best[rows, cols]]
        return pa.table({"id": pa.array(out[0], pa.int64()), "neighbour": pa.array(out[1], pa.int64()), "d": pa.array(out[2], pa.float64())})

    found = q.groupBy("qb", "cb", *key).cogroup(c.groupBy("qb", "cb", *key)).applyInArrow(match, "id bigint, neighbour bigint, d double")
    w = Window.partitionBy("id").orderBy("d", "neighbour")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("id", "rank", "neighbour", "d")


def prototypes(rows: DataFrame, label: str = "label") -> DataFrame:
    """label, v: the mean vector of each class, by position; NaN counts as 0."""
    parts = rows.select(label, F.posexplode("v").alias("pos", "x"))
    means = parts.groupBy(label, "pos").agg(F.avg(F.nanvl("x", F.lit(0.0))).alias("x"))
    return means.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v"))


def _by_prototype(rows: DataFrame, label: str, scale: float) -> tuple[DataFrame, Column, Column]:
    """(id, label, s), the greatest of s, and the sum of exponentials above it; s: scaled cosine with each class's mean, and the class, negated."""
    p = prototypes(rows, label).select(F.col(label).alias("predicted"), F.col("v").alias("pv"))
    means = p.agg(F.collect_list(F.struct("predicted", "pv")).alias("p"))
    scored = rows.join(F.broadcast(means)).select("id", label, F.transform("p", lambda s: F.struct((cosine(F.col("v"), s["pv"]) * scale).alias("s"), (-s["predicted"]).alias("o"))).alias("s"))
    top = F.array_max("s")
    return scored, top, F.aggregate("s", F.lit(0.0), lambda a, x: a + F.exp(x["s"] - top["s"]))


def classify_by_prototype(rows: DataFrame, label: str = "label", scale: float = 64.0) -> DataFrame:
    """id, label, predicted, probability: softmax over cosines with the class means, which are one row per class."""
    scored, top, total = _by_prototype(rows, label, scale)
    return scored.select("id", label, (-top["o"]).alias("predicted"), (1 / total).alias("probability"))


def prototype_loss(rows: DataFrame, label: str = "label", scale: float = 64.0) -> DataFrame:
    """One row (loss): the mean over rows of the cross entropy of their class under the softmax of classify_by_prototype."""
    scored, top, total = _by_prototype(rows, label, scale)
    own = F.filter("s", lambda x: x["o"] == -F.col(label))[0]["s"]
    return scored.select((top["s"] + F.log(total) - own).alias("x")).agg(F.avg("x").alias("loss"))


def mixup(rows: DataFrame, lam: float, batch: int, seed: int = 0) -> DataFrame:
    """(id, partner, label, other, v): each row of a batch of so many consecutive ids mixed with another of the batch.

    v is lam of the row's and the rest of its partner's, and so is the target of the classes label and other. Partners
    are the batch's rows in hash order. A batch meets in one array, which its size bounds; its rows share dimensions.
    """
    own = rows.withColumn("__r", F.struct("id", "label", "v"))
    sets = own.groupBy(F.floor(F.col("id") / batch)).agg(
        F.array_sort(F.collect_list("__r")).alias("a"),
        F.array_sort(F.collect_list(F.struct(hashed(F.col("id"), seed).alias("h"), F.col("id").alias("i"), F.col("__r").alias("r")))).alias("b"),
    )
    pair = sets.select(F.explode(F.arrays_zip("a", F.col("b.r").alias("b"))).alias("x")).select("x.a", "x.b")
    mixed = F.zip_with("a.v", "b.v", lambda p, q: p * lam + q * (1 - lam))
    return pair.select("a.id", F.col("b.id").alias("partner"), "a.label", F.col("b.label").alias("other"), mixed.alias("v"))


def triplets(rows: DataFrame, margin: float, kind: str = "soft", cross_video: str | None = None, batch: int = 1 << 62) -> DataFrame:
    """(a, p, n, d_ap, d_an): valid triplets of rows (id, label, v), within batches of so many consecutive ids.

    soft: all; semi: 0 < d_an - d_ap < margin; hard: each anchor's farthest positive and nearest
    negative. cross_video names a column in which anchor and positive must differ. For soft and semi
    the triplets of a batch are cubic in its size by definition; over batches all is linear. The batch is
    the equality key of both joins.
    """
    rows = rows.withColumn("batch", F.floor(F.col("id") / batch))
    extra = [cross_video] if cross_video else []
    side = lambda s: rows.select(*(F.col(c).alias(f"{s}_{c}") for c in ("id", "batch", "label", "v", *extra)))
    a, p, n = side("a"), side("p"), side("n")
    positive = (F.col("a_batch") == F.col("p_batch")) & (F.col("a_label") == F.col("p_label")) & (F.col("a_id") != F.col("p_id"))
    if cross_video:
        positive = positive & (F.col(f"a_{cross_video}") != F.col(f"p_{cross_video}"))
    ap = a.join(p, positive).select("a_id", "a_label", "a_v", "p_id", F.sqrt(squared_l2(F.col("a_v"), F.col("p_v"))).alias("d_ap"))
    an = a.select(*(F.col(f"a_{c}").alias(f"x_{c}") for c in ("id", "batch", "label", "v"))).join(n, (F.col("x_batch") == F.col("n_batch")) & (F.col("x_label") != F.col("n_label"))).select("x_id", "n_id", F.sqrt(squared_l2(F.col("x_v"), F.col("n_v"))).alias("d_an"))
    if kind == "hard":
        ap = ap.groupBy("a_id").agg(F.max(F.struct("d_ap", -F.col("p_id"))).alias("m")).select("a_id", (-F.col("m.col2")).alias("p_id"), F.col("m.d_ap").alias("d_ap"))
        an = an.groupBy("x_id").agg(F.min(F.struct("d_an", "n_id")).alias("m")).select("x_id", "m.n_id", "m.d_an")
    found = ap.join(an, F.col("a_id") == F.col("x_id")).select(F.col("a_id").alias("a"), F.col("p_id").alias("p"), F.col("n_id").alias("n"), "d_ap", "d_an")
    if kind == "semi":
        gap = F.col("d_an") - F.col("d_ap")
        found = found.where((gap > 0) & (gap < margin))
    return found


def triplet_loss(found: DataFrame, margin: float) -> DataFrame:
    """One row: triplets, loss (mean of relu(d_ap - d_an + margin)), mean distances; zeros where there are none."""
    loss = F.greatest(F.lit(0.0), F.col("d_ap") - F.col("d_an") + margin)
    n = F.count("*")
    return found.agg(n.alias("n"), *(F.coalesce(F.sum(c), F.lit(0.0)).alias(f"s{i}") for i, c in enumerate((loss, F.col("d_ap"), F.col("d_an"))))).select("n", *((F.col(f"s{i}") / (F.col("n") + 1e-16)).alias(c) for i, c in enumerate(("loss", "d_p", "d_n"))))


def self_duplicates(rows: DataFrame, threshold: float, neighbours: int = 9, keep: int = 5) -> DataFrame:
    """(id, root, kept): components of near vectors (squared distance of unit vectors under threshold, among the
    nearest `neighbours` that include the row itself); the first `keep` of each stay."""
    unit = rows.select("id", normalised(F.col("v")).alias("v"))
    found = nearest(unit, unit, neighbours - 1, "squared", below=threshold)
    own = components(found.select(F.col("id").alias("a"), F.col("neighbour").alias("b")))
    every = rows.select("id").join(own, rows["id"] == own["vertex"], "left").select("id", F.coalesce("root", "id").alias("root"))
    place = F.row_number().over(Window.partitionBy("root").orderBy("id"))
    return every.select("id", "root", (place <= keep).alias("kept"))


def without_near(source: DataFrame, reference: DataFrame, threshold: float, neighbours: int = 9) -> DataFrame:
    """Rows of source with no reference row nearer than threshold. Every edge would touch a reference row, so
    being in a component with one is the same as having an edge, and an anti join is enough."""
    s, r = (x.select("id", normalised(F.col("v")).alias("v")) for x in (source, reference))
    near = nearest(s, r, neighbours, "squared", below=threshold).select("id").distinct()
    return source.join(near, "id", "left_anti")


def with_negatives(kept: DataFrame, negatives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids, pairs): kept ids (id) and, for each of them that has negatives (id, negative) but none that is kept, its first one;
    and the negatives that lie within these ids."""
    inside = negatives.join(kept, "id", "left_semi").join(kept.select(F.col("id").alias("negative")), "negative", "left_semi").select("id").distinct()
    lacking = negatives.join(kept, "id", "left_semi").join(inside, "id", "left_anti")
    every = kept.union(lacking.groupBy("id").agg(F.min("negative").alias("n")).select("n")).distinct()
    pairs = negatives.join(every, "id", "left_semi").join(every.select(F.col("id").alias("negative")), "negative", "left_semi")
    return every, pairs.select("id", "negative")
