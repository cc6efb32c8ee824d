"""Pairs that must differ (negatives), and the association of boxes with tracked boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions import geometry


#: Keys that the left rows of a pair of groups are dealt over, so that no two groups meet in one task.
SLICES = 64
#: Videos of one camera in a block.
BLOCK = 256


def tracking_spans(tff: DataFrame) -> DataFrame:
    """video_id, tracking_id, first and last frame."""
    return tff.where("tracking_id is not null").groupBy("video_id", "tracking_id").agg(F.min("frame_nr").alias("min_frame"), F.max("frame_nr").alias("max_frame"))


def overlapping_trackings(tff: DataFrame) -> DataFrame:
    """(left_id, right_id): trackings of one video that are on screen at the same time, closed intervals, left < right.

    The video is the equality key; a video has few trackings, so the rest is a residual condition.
    """
    s = tracking_spans(tff)
    left = s.select("video_id", F.col("tracking_id").alias("left_id"), F.col("min_frame").alias("l0"), F.col("max_frame").alias("l1"))
    right = s.select("video_id", F.col("tracking_id").alias("right_id"), F.col("min_frame").alias("r0"), F.col("max_frame").alias("r1"))
    return left.join(right, "video_id").where("left_id < right_id and l0 <= r1 and r0 <= l1").select("left_id", "right_id")


def group_negatives(features: DataFrame, key: str = "video_id", value: str = "value", batch: int | None = None) -> DataFrame:
    """(left_id, right_id), left < right: rows of different groups.

    With a batch size, pairs stay within consecutive batches of ids: the batch is the key, and since its size is bounded
    the rest is a residual condition; the plan is linear. Without, pairs of groups, which are few, are made first and expanded by equality
    joins; the left rows of a pair of groups are dealt over SLICES keys, and the right ones go to each of them.
    """
    rows = features.select(F.col(key).alias("id"), F.col(value).alias("g"))
    if batch:
        # the batch number of an id needs its global rank, counted over ranges of ids instead of in one task
        own = with_rank(rows, "id").select("id", "g", F.floor((F.col("rank") - 1) / batch).alias("b"))
        left, right = (own.select("b", F.col("id").alias(f"{x}_id"), F.col("g").alias(f"{x}_g")) for x in ("left", "right"))
        return left.join(right, "b").where("left_id < right_id and left_g <> right_g").select("left_id", "right_id")
    groups = rows.select("g").distinct().withColumn("__k", F.pmod(F.xxhash64("g"), F.lit(1)))  # a key that is not folded away, so that the join stays an equality join
    pairs = groups.withColumnRenamed("g", "lg").join(groups.withColumnRenamed("g", "rg"), "__k").where("lg <> rg").drop("__k")
    left = rows.select(F.col("id").alias("left_id"), F.col("g").alias("lg"), F.pmod(F.xxhash64("id"), F.lit(SLICES)).cast("int").alias("s"))
    right = rows.select(F.col("id").alias("right_id"), F.col("g").alias("rg"), F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))).alias("s"))
    return left.join(pairs, "lg").join(right, ["rg", "s"]).where("left_id < right_id").select("left_id", "right_id")


def group_negative_sums(features: DataFrame, key: str = "video_id", value: str = "value", width: int = 1 << 16) -> DataFrame:
    """One row (n, sl, sr): the number of pairs that group_negatives makes, and the sums of their left and right
    ids; ids are distinct. An id is left of the larger ids, and right of the smaller ones, of other groups.

    Places are counted inside ranges of ids, as in with_rank, and the ranges' sizes are summed up by group.
    """
    rows = features.where(F.col(value).isNotNull()).select(F.col(key).alias("id"), F.col(value).alias("g"), F.floor(F.col(key) / width).alias("k"))
    sizes = rows.groupBy("g", "k").agg(F.count("*").alias("m"))
    whole = rows.groupBy("k").agg(F.count("*").alias("m"))
    before = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    own = sizes.select("g", "k", F.coalesce(F.sum("m").over(before.partitionBy("g")), F.lit(0)).alias("gb"), F.sum("m").over(Window.partitionBy("g")).alias("gn"))
    every = whole.select("k", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("b"), F.sum("m").over(Window.partitionBy()).alias("n"))
    below = F.col("b") + F.row_number().over(Window.partitionBy("k").orderBy("id")) - 1
    of_own = F.col("gb") + F.row_number().over(Window.partitionBy("k", "g").orderBy("id")) - 1
    placed = rows.join(every, "k").join(own, ["g", "k"]).select("id", "n", "gn", below.alias("below"), of_own.alias("of_own"))
    smaller = F.col("below") - F.col("of_own")
    larger = (F.col("n") - 1 - F.col("below")) - (F.col("gn") - 1 - F.col("of_own"))
    wide = F.col("id").cast("decimal(19,0)")  # the sums pass 64 bits
    return placed.agg(F.coalesce(F.sum(smaller), F.lit(0)).alias("n"), F.sum(F.when(larger > 0, wide * larger.cast("decimal(18,0)"))).alias("sl"), F.sum(F.when(smaller > 0, wide * smaller.cast("decimal(18,0)"))).alias("sr"))


def with_rank(df: DataFrame, *order: str, width: int = 1 << 16) -> DataFrame:
    """df with `rank`, its place (from 1) in the order of columns, the first a number.

    Rows are ranked inside ranges of the first column, and the ranges' sizes are summed up: no
    window runs over the whole table in one task.
    """
    bucket = F.floor(F.col(order[0]) / width).alias("__bucket")
    sized = df.select("*", bucket)
    sizes = sized.groupBy("__bucket").agg(F.count("*").alias("__n"))
    base = sizes.select("__bucket", F.coalesce(F.sum("__n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    inner = F.row_number().over(Window.partitionBy("__bucket").orderBy(*order))
    return sized.join(base, "__bucket").select(*df.columns, (inner + F.col("__base")).alias("rank"))


def travel_negatives(video: DataFrame, camera: DataFrame, km_per_hour: float) -> DataFrame:
    """(left_id, right_id), left < right: videos of different cameras too far apart for the time between them.

    Videos meet over spans of time twice as long as the longest travel that there can be, whatever their cameras: one
    goes to its own span, and as a guest to the next, if travel reaches it. So a shuffled row is made for a video, not
    for its every trip. There it meets blocks, the ids and times of at most BLOCK videos of one camera that follow each
    other in time; blocks out of reach are passed over, and the others are unfolded into pairs under the exact condition.
    The table of camera pairs is small and carries the travel time, which is the same both ways: each pair of cameras
    stands there once. In one span the video of the smaller camera meets the other's, and guests are earlier than the
    videos they meet, so no two videos meet twice. Times are counted from a common origin, once for each video.
    """
    c = camera.where("latitude is not null and longitude is not null").select("camera_id", "latitude", "longitude")
    one_c, other_c = (c.select(*(F.col(x).alias(p + x) for x in c.columns)) for p in ("a_", "b_"))
    km = geometry.great_circle_km(F.col("a_latitude"), F.col("a_longitude"), F.col("b_latitude"), F.col("b_longitude"))
    trips = one_c.join(other_c, F.col("a_camera_id") < F.col("b_camera_id")).select("a_camera_id", "b_camera_id", (km / F.lit(float(km_per_hour))).alias("travel"))
    longest = 3.1416 * geometry.EARTH_KM / km_per_hour
    micros = F.timestamp_diff("MICROSECOND", F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"), F.col("start_time"))
    v = video.where("start_time is not null and video_id is not null").join(c.select("camera_id"), "camera_id", "left_semi").select("video_id", "camera_id", micros.alias("t"))
    span = lambda hours: F.floor((F.col("t") / F.lit(3.6e9) + hours) / (2 * longest))
    # a fixed number of partitions: the pairs are many more than the rows that they are made of, which look few enough to be put together
    parts = max(int(video.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * video.sparkSession.sparkContext.defaultParallelism)
    one = v.select(span(0.0).alias("span"), F.col("video_id").alias("a"), F.col("camera_id").alias("a_camera"), F.col("t").alias("at")).repartition(parts, "span")
    met = v.select(F.explode(F.sequence(span(0.0), span(longest))).alias("span"), "*").withColumn("guest", F.col("span") != span(0.0)).repartition(parts, "span")
    block = F.floor((F.row_number().over(Window.partitionBy("span", "guest", "camera_id").orderBy("t")) - 1) / BLOCK)
    gathered = (F.collect_list("video_id").alias("ids"), F.collect_list("t").alias("times"), F.min("t").alias("first"), F.max("t").alias("last"))
    other = met.withColumn("block", block).groupBy("span", "guest", F.col("camera_id").alias("b_camera"), "block").agg(*gathered)
    near = one.join(other, "span").where((F.col("a_camera") < F.col("b_camera")) | (F.col("guest") & (F.col("a_camera") > F.col("b_camera"))))
    near = near.join(trips, (F.least("a_camera", "b_camera") == F.col("a_camera_id")) & (F.greatest("a_camera", "b_camera") == F.col("b_camera_id")))
    hours = lambda x, y: (F.col(x) - F.col(y)) / F.lit(3.6e9)
    reached = near.where((F.col("travel") > hours("first", "at")) & (F.col("travel") > hours("at", "last")))
    pairs = reached.select("a", "at", "travel", "times", F.posexplode("ids").alias("i", "b"))
    apart = F.abs(F.col("at") - F.get("times", F.col("i"))) / F.lit(3.6e9)
    return pairs.where((F.col("a") != F.col("b")) & (F.col("travel") > apart)).select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"))


_BOX = ("tracking_frame_feature_id", "bbox_x_center_n", "bbox_y_center_n", "bbox_width_n", "bbox_height_n")


def box_pairs(tracked: DataFrame, untracked: DataFrame, threshold: float) -> DataFrame:
    """(tracked_id, untracked_id, ios): boxes of one frame whose intersection covers more than threshold of the smaller."""
    left = tracked.select("video_id", "frame_nr", *(F.col(c).alias(f"l_{c}") for c in _BOX))
    right = untracked.select("video_id", "frame_nr", *(F.col(c).alias(f"r_{c}") for c in _BOX))
    ios = geometry.over_smallest("l_", "r_")
    met = left.join(right, ["video_id", "frame_nr"]).withColumn("ios", ios).where(F.col("ios") > threshold)
    return met.select(F.col("l_tracking_frame_feature_id").alias("tracked_id"), F.col("r_tracking_frame_feature_id").alias("untracked_id"), "ios")


def one_to_one(pairs: DataFrame) -> DataFrame:
    """Pairs in which both sides have no other partner."""
    n = pairs.dropDuplicates(["tracked_id", "untracked_id"])
    both = n.withColumn("__l", F.count("*").over(Window.partitionBy("tracked_id"))).withColumn("__r", F.count("*").over(Window.partitionBy("untracked_id")))
    return both.where("__l = 1 and __r = 1").drop("__l", "__r")


def associate(tracked: DataFrame, untracked: DataFrame, threshold: float) -> DataFrame:
    """untracked with the tracking of its one partner, or none; what it had before is reset."""
    pairs = one_to_one(box_pairs(tracked, untracked, threshold)).select(F.col("untracked_id").alias("tracking_frame_feature_id"), F.col("tracked_id").alias("__t"))
    own = tracked.select(F.col("tracking_frame_feature_id").alias("__t"), F.col("tracking_id"))
    return untracked.drop("tracking_id").join(pairs.join(own, "__t").drop("__t"), "tracking_frame_feature_id", "left")


def best_overlap(targets: DataFrame, boxes: DataFrame) -> DataFrame:
    """For each target the box of its frame that shares the largest area with it (ties: smallest id), and that area."""
    left = targets.select("video_id", "frame_nr", *(F.col(c).alias(f"l_{c}") for c in _BOX))
    right = boxes.select("video_id", "frame_nr", *(F.col(c).alias(f"r_{c}") for c in _BOX))
    met = left.join(right, ["video_id", "frame_nr"]).withColumn("shared", geometry.intersection("l_", "r_")).where("shared > 0")
    first = Window.partitionBy("l_tracking_frame_feature_id").orderBy(F.desc("shared"), "r_tracking_frame_feature_id")
    return met.withColumn("__n", F.row_number().over(first)).where("__n = 1").select(F.col("l_tracking_frame_feature_id").alias("target_id"), F.col("r_tracking_frame_feature_id").alias("box_id"), "shared")
