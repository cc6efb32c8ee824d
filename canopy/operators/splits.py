"""Train, validation and test splits; folds; integrity of open-set splits.

Orders are stable hashes of ids, so a split is the same however the data are partitioned. Splits are
tables (id, partition), never lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions.names import hashed
from canopy.operators.mining import with_rank


def split_sizes(n: Column, val: int, test: int, folds: bool = False) -> tuple[Column, Column, Column]:
    """Sizes of train, val and test for n items and percentages: truncated, at least 1 unless folds; train has the rest."""
    least = F.lit(0 if folds else 1)
    v, t = (F.greatest(F.floor(n * p / 100), least).cast("bigint") for p in (val, test))
    return n - v - t, v, t


def hash_ranks(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    """df with `rank` (from 0) in hash order and `n`, the number of rows; ranges of hashes are ranked apart and summed up."""
    h = hashed(F.col(id_col), seed)
    keyed = df.withColumn("__h", h).withColumn("__b", F.floor(h / (1 << 22)))
    sizes = keyed.groupBy("__b").agg(F.count("*").alias("__m"))
    before = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # over at most 1024 ranges
    base = sizes.select("__b", F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__base"), F.sum("__m").over(Window.partitionBy(F.lit(0))).alias("n"))
    inner = F.row_number().over(Window.partitionBy("__b").orderBy("__h", id_col)) - 1
    return keyed.join(F.broadcast(base), "__b").withColumn("rank", F.col("__base") + inner).drop("__b", "__h", "__base")


def by_percentage(df: DataFrame, train: int, val: int, id_col: str = "video_id", seed: int = 0) -> DataFrame:
    """(id, partition): shares in hash order, truncated; test gets the rest."""
    r = hash_ranks(df.select(id_col), id_col, seed)
    a, b = F.floor(F.col("n") * train / 100), F.floor(F.col("n") * val / 100)
    return r.select(id_col, F.when(F.col("rank") < a, "train").when(F.col("rank") < a + b, "val").otherwise("test").alias("partition"))


def by_time(df: DataFrame, train_until: str, val_until: str, id_col: str = "video_id", column: str = "start_time") -> DataFrame:
    """(id, partition): by the time of a row, bounds exclusive; rows without a time take no part."""
    t = F.col(column)
    a, b = (F.lit(x).cast("timestamp_ntz") for x in (train_until, val_until))
    return df.where(t.isNotNull()).select(id_col, F.when(t < a, "train").when(t < b, "val").otherwise("test").alias("partition"))


def by_camera(df: DataFrame, train: list[int], val: list[int], id_col: str = "video_id") -> DataFrame:
    """(id, partition): whole cameras; the rest are test."""
    c = F.col("camera_id")
    return df.select(id_col, F.when(c.isin(train), "train").when(c.isin(val), "val").otherwise("test").alias("partition"))


def custom(df: DataFrame, train: Column, val: Column, test: Column, id_col: str = "video_id") -> DataFrame:
    """(id, partition): by three conditions; of those that a row meets the first holds, and a row that meets none takes
    no part. One pass instead of a query for each partition that leaves out what the others took."""
    part = F.when(train, "train").when(val, "val").when(test, "test")
    return df.select(id_col, part.alias("partition")).where("partition is not null")


def closed_set(images: DataFrame, val: int, test: int, id_col: str = "image_id", label: str = "label", least: int = 3, seed: int = 0) -> DataFrame:
    """(id, partition): the first `least` images of every individual train; the others go, in hash order, to val, test, and train."""
    w = Window.partitionBy(label).orderBy(hashed(F.col(id_col), seed), id_col)
    ranked = images.select(id_col, label).withColumn("__first", F.row_number().over(w) <= least)
    rest = hash_ranks(ranked.where("not __first").select(id_col), id_col, seed + 1)
    total = images.count()
    _, v, t = split_sizes(F.lit(total), val, test)
    named = rest.select(id_col, F.when(F.col("rank") < v, "val").when(F.col("rank") < v + t, "test").otherwise("train").alias("partition"))
    return ranked.where("__first").select(id_col, F.lit("train").alias("partition")).union(named)


def open_set(images: DataFrame, val: int, test: int, id_col: str = "image_id", label: str = "label", seed: int = 0) -> DataFrame:
    """(id, partition): whole individuals, in the hash order of their first image: val, then test, then train."""
    first = images.groupBy(label).agg(F.min(F.struct(hashed(F.col(id_col), seed).alias("h"), F.col(id_col).alias("i"))).alias("f"))
    ranked = with_rank(first.select(label, "f.h", "f.i"), "h", "i").withColumn("__r", F.col("rank") - 1)
    ranked = ranked.join(F.broadcast(first.agg(F.count("*").alias("__n"))))  # one row
    _, v, t = split_sizes(F.col("__n"), val, test)
    named = ranked.select(label, F.when(F.col("__r") < v, "val").when(F.col("__r") < v + t, "test").otherwise("train").alias("partition"))
    return images.select(id_col, label).join(named, label).select(id_col, "partition")


def equal_folds(images: DataFrame, k: int, id_col: str = "image_id", seed: int = 0) -> DataFrame:
    """(id, fold): k slices of equal size in hash order; what is left over goes to the last."""
    r = hash_ranks(images.select(id_col), id_col, seed)
    return r.select(id_col, F.least(F.floor(F.col("rank") / F.greatest(F.floor(F.col("n") / k), F.lit(1))), F.lit(k - 1)).cast("int").alias("fold"))


def balanced_folds(images: DataFrame, k: int, train_share: float = 0.8, id_col: str = "image_id", label: str = "label") -> DataFrame:
    """(id, fold): whole individuals. Largest first, each round gives one to each of the k folds (the fold with
    fewest individuals, then fewest images) and one to test (fold -1), until train_share of them are placed; the rest are test.

    The greedy loop runs over one count for each individual, not over images.
    """
    counts = sorted(((r[label], r["n"]) for r in images.groupBy(label).agg(F.count("*").alias("n")).collect()), key=lambda x: (-x[1], str(x[0])))
    held = [[0, 0, i] for i in range(k)]
    placed: dict = {}
    limit, at = int(len(counts) * train_share), 0
    while at < limit:
        for _ in range(k):
            if at >= limit:
                break
            fold = min(held)
            fold[0] += 1
            fold[1] += counts[at][1]
            placed[counts[at][0]] = fold[2]
            at += 1
        if at < limit:
            placed[counts[at][0]] = -1
            at += 1
    rows = [(x, placed.get(x, -1)) for x, _ in counts]
    kind = images.schema[label].dataType.simpleString()
    named = images.sparkSession.createDataFrame(rows, f"{label} {kind}, fold int")
    return images.select(id_col, label).join(named, label).select(id_col, "fold")


def fold_view(rows: DataFrame, val_fold: int, fold: str = "fold") -> DataFrame:
    """rows with a partition: one fold validates, the others train, a negative one tests."""
    f = F.col(fold)
    return rows.withColumn("partition", F.when(f < 0, "test").when(f == val_fold, "val").otherwise("train"))


def leaks(rows: DataFrame, label: str = "label", part: str = "partition") -> DataFrame:
    """(label, parts): individuals in more than one part."""
    return rows.groupBy(label).agg(F.sort_array(F.collect_set(part)).alias("parts")).where(F.size("parts") > 1)


def proprietary(rows: DataFrame, part: str, label: str = "label") -> DataFrame:
    """Individuals that only one partition has."""
    return rows.where(F.col("partition") == part).select(label).distinct().join(rows.where(F.col("partition") != part).select(label).distinct(), label, "left_anti")


def integrity(images: DataFrame, boxes: DataFrame) -> DataFrame:
    """images (image_id, label, partition), boxes (image_id, subject): images that show their own subject, moved so that
    no image in train or val shows a subject of test alone, and none in train one of val alone."""
    own = images.join(boxes.select("image_id", F.col("subject").alias("label")).distinct(), ["image_id", "label"], "left_semi")
    only_test, only_val = proprietary(own, "test"), proprietary(own, "val")
    shown = boxes.select("image_id", F.col("subject").alias("label"))
    to_test = shown.join(only_test, "label", "left_semi").select("image_id").distinct().withColumn("__t", F.lit(True))
    to_val = shown.join(only_val, "label", "left_semi").select("image_id").distinct().withColumn("__v", F.lit(True))
    moved = own.join(to_test, "image_id", "left").join(to_val, "image_id", "left")
    part = F.when(F.col("__t") & F.col("partition").isin("train", "val"), "test").when(F.col("__v") & (F.col("partition") == "train"), "val").otherwise(F.col("partition"))
    return moved.select("image_id", "label", part.alias("partition"))


def merged(one: DataFrame, two: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """(union by name, labels that both have); the second should be empty."""
    return one.unionByName(two, allowMissingColumns=True), one.select(label).intersect(two.select(label))
