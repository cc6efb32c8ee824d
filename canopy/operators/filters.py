"""Filters as functions from DataFrame to DataFrame, for use with df.transform.

Id lists may be Python collections (small) or DataFrames; the latter become semi and anti joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions import names

Step = Callable[[DataFrame], DataFrame]
Ids = Iterable[int] | DataFrame


def in_ids(column: str, ids: Ids, keep: bool = True) -> Step:
    def step(df: DataFrame) -> DataFrame:
        if isinstance(ids, DataFrame):
            return df.join(ids.select(F.col(ids.columns[0]).alias(column)).distinct(), column, "left_semi" if keep else "left_anti")
        found = F.col(column).isin(list(ids))
        return df.where(found if keep else ~found)

    return step


def video(video_id: int) -> Step:
    return lambda df: df.where(F.col("video_id") == video_id)


def videos(ids: Ids) -> Step:
    return in_ids("video_id", ids)


def not_videos(ids: Ids) -> Step:
    return in_ids("video_id", ids, keep=False)


def cameras(ids: Ids) -> Step:
    return in_ids("camera_id", ids)


def associated(df: DataFrame) -> DataFrame:
    return df.where("tracking_id is not null")


def cached(df: DataFrame) -> DataFrame:
    return df.where("cached")


def min_count(n: int) -> Step:
    """Rows of trackings with at least n rows among those that earlier filters left; untracked rows go."""
    return lambda df: df.where("tracking_id is not null").withColumn("__n", F.count("*").over(Window.partitionBy("tracking_id"))).where(F.col("__n") >= n).drop("__n")


def body_with_face(every: DataFrame) -> Step:
    """Bodies that have a frontal face in the same frame of their tracking, among all features (not just filtered ones)."""
    faces = every.where("feature_type = 'face_90'").select("tracking_id", "frame_nr")
    return lambda df: df.where("feature_type = 'body'").join(faces, ["tracking_id", "frame_nr"], "left_semi")


def feature_types(types: Iterable[str], every: DataFrame | None = None) -> Step:
    """One of the types. `body_with_face` among them stands alone: the other types are then ignored."""
    types = list(types)
    if "body_with_face" in types:
        if every is None:
            raise ValueError("body_with_face needs all features")
        return body_with_face(every)
    return lambda df: df.where(F.col("feature_type").isin(types))


def confidence(least: float) -> Step:
    return lambda df: df.where(F.col("confidence") >= least)


def bbox(min_width: int | None = None, max_width: int | None = None, min_height: int | None = None, max_height: int | None = None) -> Step:
    """Inclusive bounds in pixels; None leaves a side open."""
    bounds = ((min_width, "bbox_width", 1), (max_width, "bbox_width", -1), (min_height, "bbox_height", 1), (max_height, "bbox_height", -1))

    def step(df: DataFrame) -> DataFrame:
        for bound, column, sign in bounds:
            if bound is not None:
                df = df.where(F.col(column) >= bound if sign > 0 else F.col(column) <= bound)
        return df

    return step


def version(name: str) -> Step:
    return lambda df: df.where(F.col("version") == name)


def hours(wanted: Iterable[int | None], column: str = "start_time") -> Step:
    """Hour of day; None among the hours lets unknown times through."""
    wanted = list(wanted)
    known = [h for h in wanted if h is not None]

    def step(df: DataFrame) -> DataFrame:
        c = F.hour(column).isin(known)
        return df.where(c | F.col(column).isNull() if None in wanted else c)

    return step


def dates(low: str, high: str, allow_none: bool = False, column: str = "start_time") -> Step:
    """Inclusive at both ends."""
    c = F.col(column).between(F.lit(low).cast("timestamp_ntz"), F.lit(high).cast("timestamp_ntz"))
    return lambda df: df.where(c | F.col(column).isNull() if allow_none else c)


def seconds() -> Column:
    """Whole seconds of a video, rounded half to even; 0 where the frame rate is 0."""
    return F.when(F.col("fps") != 0, F.rint(F.col("frames") / F.col("fps"))).otherwise(0).cast("int")


def length(least: int, most: int) -> Step:
    return lambda df: df.where(seconds().between(least, most))


def without_used(images: DataFrame, name: str = "file_name", key: str = "base_name") -> Step:
    """Videos from which no image was cut; key holds the lower-case base name of a video."""
    used = images.select(names.source_video(F.col(name)).alias(key)).distinct()
    return lambda df: df.join(used, key, "left_anti")


def least_rows(n: int, *columns: str) -> Step:
    """Rows of groups with at least n rows."""
    return lambda df: df.withColumn("__n", F.count("*").over(Window.partitionBy(*columns))).where(F.col("__n") >= n).drop("__n")


def in_order(seed: int, id_col: str = "video_id") -> tuple[Column, Column]:
    """A stable pseudo-random order."""
    return names.hashed(F.col(id_col), seed), F.col(id_col)


def exactly_one(df: DataFrame) -> DataFrame:
    """df, which must have one row; reads at most two."""
    n = len(df.limit(2).take(2))
    if n != 1:
        raise LookupError("no row" if not n else "more than one row")
    return df
