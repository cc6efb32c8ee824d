"""Classification metrics from predictions, and the k-nearest-neighbour evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopy.operators.vectors import nearest
from canopy.sources.scratch import Scratch


def votes(found: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, predicted, n, first): how many neighbours each class has, and the rank of the nearest; classes without any have no row."""
    named = found.join(labels.select(F.col("id").alias("neighbour"), F.col("label").alias("predicted")), "neighbour")
    return named.groupBy("id", "predicted").agg(F.count("*").alias("n"), F.min("rank").alias("first"))


def auroc(seen: DataFrame, rows: DataFrame) -> DataFrame:
    """One row (auroc): the mean over classes of the area under the one-against-rest curve of their votes, ties as a half.
    Classes that no row or every row has take no part.

    Rows are counted by class and votes, and what has no vote for a class is the remainder, so the matrix of rows and
    classes is never made.
    """
    level = seen.join(rows.select("id", "label"), "id").groupBy(F.col("predicted").alias("c"), "n").agg(F.count_if(F.col("label") == F.col("predicted")).alias("pos"), F.count_if(F.col("label") != F.col("predicted")).alias("neg"))
    support = rows.groupBy(F.col("label").alias("c")).agg(F.count("*").alias("p")).join(F.broadcast(rows.agg(F.count("*").alias("t")))).where("p < t")  # one row
    held = level.groupBy("c").agg(F.sum("pos").alias("vp"), F.sum("neg").alias("vn"))
    none = support.join(held, "c", "left").na.fill(0, ["vp", "vn"]).select("c", F.lit(0).cast("bigint").alias("n"), (F.col("p") - F.col("vp")).alias("pos"), (F.col("t") - F.col("p") - F.col("vn")).alias("neg"))
    below = Window.partitionBy("c").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    won = F.col("pos") * (F.coalesce(F.sum("neg").over(below), F.lit(0)) + F.col("neg") / 2)
    area = level.union(none).withColumn("won", won).groupBy("c").agg(F.sum("won").alias("won")).join(support, "c")
    return area.agg(F.avg(F.col("won") / (F.col("p") * (F.col("t") - F.col("p")))).alias("auroc"))


def ranked_votes(found: DataFrame, labels: DataFrame) -> DataFrame:
    """votes() with `place`, from 1: classes by votes; of equally voted ones, that of the nearer neighbour comes first."""
    return votes(found, labels).withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "first")))


def vote(found: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """(id, predicted, p): the class with most of the k votes; of equally voted ones, that of the nearest neighbour."""
    return ranked_votes(found, labels).where("place = 1").select("id", "predicted", (F.col("n") / k).alias("p"))


def confusion(rows: DataFrame) -> DataFrame:
    """label, support, tp, fp, fn by class, over rows (label, predicted)."""
    true = rows.groupBy("label").agg(F.count("*").alias("support"), F.count_if(F.col("label") == F.col("predicted")).alias("tp"))
    said = rows.groupBy(F.col("predicted").alias("label")).agg(F.count("*").alias("said"))
    both = true.join(said, "label", "full_outer").na.fill(0)
    return both.select("label", "support", "tp", (F.col("said") - F.col("tp")).alias("fp"), (F.col("support") - F.col("tp")).alias("fn"))


def scores(rows: DataFrame, average: str = "weighted") -> DataFrame:
    """One row: accuracy, f1, precision. average: micro, macro (over classes seen or said) or weighted by support."""
    c = confusion(rows)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    each = c.select("support", zero(F.try_divide(tp, tp + fn)).alias("recall"), zero(F.try_divide(tp, tp + fp)).alias("precision"), zero(F.try_divide(2 * tp, 2 * tp + fp + fn)).alias("f1"), tp, fp)
    if average == "micro":
        share = F.sum("tp") / F.sum("support")
        return each.agg(share.alias("accuracy"), share.alias("f1"), share.alias("precision"))
    weight = F.col("support") if average == "weighted" else F.lit(1)
    mean = lambda x: (F.sum(F.col(x) * weight) / F.sum(weight))
    return each.agg(mean("recall").alias("accuracy"), mean("f1").alias("f1"), mean("precision").alias("precision"))


def cross_video_rows(rows: DataFrame, least: int = 3) -> DataFrame:
    """Rows with at least `least` images of their individual in other videos."""
    every, own = F.count("*").over(Window.partitionBy("label")), F.count("*").over(Window.partitionBy("individual_video_id"))
    return rows.withColumn("__n", every - own).where(F.col("__n") >= least).drop("__n")


def knn(rows: DataFrame, k: int = 5, average: str = "weighted", metric: str = "euclidean", with_train: bool = False, cross_video: bool = False, use_filter: bool = False) -> DataFrame:
    """One row: accuracy, accuracy_top5, f1, precision of k-nearest-neighbour classification of the val rows.

    rows: id, label, partition, individual_video_id, v. Rows with any null go. k is at most the
    number of classes. with_train: train rows are neighbours too, never scored. cross_video:
    neighbours come from other videos, and only rows with 3 images elsewhere are scored; where fewer
    than k neighbours are left, they alone vote. use_filter: only classes with k div 2 + 2 val rows are scored.
    Top 5 means that the class is among the five with most votes (see ranked_votes), and equals the accuracy where k < 5.
    """
    rows = rows.na.drop("any")
    own = rows.where("partition = 'val'")
    pool = rows.where("partition in ('val', 'train')") if with_train else own
    use = min(k, pool.select("label").distinct().count())
    found = nearest(own, pool, use, metric, differ="individual_video_id" if cross_video else None)
    scored = own.select("id", "label", "individual_video_id")
    if cross_video:
        seen = cross_video_rows(pool.select("id", "label", "individual_video_id")).select("id")
        scored = scored.join(seen, "id", "left_semi")
    if use_filter:
        big = own.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= k // 2 + 2).select("label")
        scored = scored.join(big, "label", "left_semi")
    return _evaluated(found, scored, pool, k, average)


def _evaluated(found: DataFrame, scored: DataFrame, pool: DataFrame, k: int, average: str) -> DataFrame:
    """One row: accuracy, accuracy_top5, f1, precision of the rows scored (id, label), from their neighbours."""
    ranked = scored.select("id", "label").join(ranked_votes(found, pool), "id")
    out = scores(ranked.where("place = 1"), average)
    if k < 5:
        return out.select("accuracy", F.col("accuracy").alias("accuracy_top5"), "f1", "precision")
    hit = ranked.groupBy("id").agg(F.max(((F.col("place") <= 5) & (F.col("predicted") == F.col("label"))).cast("int")).alias("hit"))
    top = hit.agg(F.avg("hit").alias("accuracy_top5"))
    return out.join(F.broadcast(top)).select("accuracy", "accuracy_top5", "f1", "precision")  # one row


def knn_grid(rows: DataFrame, scratch: Scratch, ks: tuple[int, ...] = (1, 5), averages: tuple[str, ...] = ("weighted", "macro"), metrics: tuple[str, ...] = ("euclidean", "cosine")) -> DataFrame:
    """A row (metric, k, average, accuracy, accuracy_top5, f1, precision) for each choice; neighbours are found once for
    each metric and kept in scratch, whatever the number of choices."""
    rows = rows.na.drop("any")
    own = rows.where("partition = 'val'").select("id", "label", "v")
    classes = own.select("label").distinct().count()
    each = []
    for metric in metrics:
        found = scratch.keep(nearest(own, own, min(max(ks), classes), metric))
        for k in ks:
            near = found.where(F.col("rank") <= min(k, classes))
            for average in averages:
                each.append(_evaluated(near, own, own, k, average).select(F.lit(metric).alias("metric"), F.lit(k).alias("k"), F.lit(average).alias("average"), "*"))
    return reduce(DataFrame.unionAll, each)


def knn_folds(rows: DataFrame, k: int = 5, average: str = "weighted") -> DataFrame:
    """Means over folds of knn() inside each fold. The fold is a key like any other: the folds share no neighbours."""
    own = rows.where("partition = 'val'").na.drop("any")
    use = min(k, own.select("label").distinct().count())
    found = nearest(own, own, use, same="fold")
    judged = own.select("id", "label", "fold").join(vote(found, own, use), "id")
    each = [scores(judged.where(F.col("fold") == r["fold"]), average) for r in own.select("fold").distinct().orderBy("fold").collect()]  # a handful
    out = each[0]
    for x in each[1:]:
        out = out.unionAll(x)
    return out.agg(*(F.avg(c).alias(c) for c in ("accuracy", "f1", "precision")))


def knn_negatives(rows: DataFrame, negatives: DataFrame, k: int = 5) -> DataFrame:
    """(id, label, predicted, hit5): neighbours of a row come from its class and that class's negatives.

    negatives: (label, negative). Classes with k candidates or fewer, or without a second label, are
    skipped. The mode of the votes wins, ties to the smaller label; hit5: the label is among the first 5.
    """
    allowed = negatives.select("label", F.col("negative").alias("other")).union(negatives.select("label", "label")).distinct()
    pool = rows.select("id", F.col("label").alias("other"), "v").join(allowed, "other").select("id", F.col("label").alias("scope"), "other", "v")
    big = pool.groupBy("scope").agg(F.count("*").alias("n"), F.count_distinct("other").alias("m")).where(f"n > {k} and m >= 2").select("scope")
    own = rows.select("id", F.col("label").alias("scope"), "v").join(big, "scope", "left_semi")
    found = nearest(own, pool.select("id", "scope", "v"), max(k, 5), same="scope")
    named = found.join(rows.select(F.col("id").alias("neighbour"), F.col("label").alias("said")), "neighbour").join(rows.select("id", "label"), "id")
    votes = named.where(f"rank <= {k}").groupBy("id", "label", "said").agg(F.count("*").alias("n"))
    w = Window.partitionBy("id").orderBy(F.desc("n"), "said")
    first = votes.withColumn("__i", F.row_number().over(w)).where("__i = 1").select("id", "label", F.col("said").alias("predicted"))
    hit = named.where("rank <= 5").groupBy("id").agg(F.max((F.col("said") == F.col("label")).cast("int")).alias("hit5"))
    return first.join(hit, "id")


def misclassified(found: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(id, label, predicted, neighbours, distances) of rows whose vote is wrong."""
    lists = found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbour", "d"))).alias("x")).select("id", F.transform("x", lambda s: s["neighbour"]).alias("neighbours"), F.transform("x", lambda s: s["d"]).alias("distances"))
    return rows.select("id", "label").join(vote(found, rows, k), "id").where("predicted <> label").join(lists, "id").select("id", "label", "predicted", "neighbours", "distances")
