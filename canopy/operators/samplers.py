"""Per-tracking samplers: all windows but the two that are sequential by nature."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions import names


def equidistant(df: DataFrame, n: int, group: str = "tracking_id", order: tuple[str, ...] = ("frame_nr", "tracking_frame_feature_id")) -> DataFrame:
    """All rows of a group of at most n; else every interval-th, n of them, interval = (rows - 1) div (n - 1)."""
    w = Window.partitionBy(group)
    ranked = df.withColumn("__i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count("*").over(w))
    if n == 1:
        keep = F.col("__i") == 0
    else:
        step = F.floor((F.col("__n") - 1) / (n - 1))
        keep = (F.col("__n") <= n) | ((F.col("__i") % step == 0) & (F.floor(F.col("__i") / step) < n))
    return ranked.where(keep).drop("__i", "__n")


def random(df: DataFrame, n: int, seed: int = 0, group: str = "tracking_id", id_col: str = "tracking_frame_feature_id") -> DataFrame:
    """Up to n rows of each group, by a stable hash order."""
    w = Window.partitionBy(group).orderBy(names.hashed(F.col(id_col), seed), id_col)
    return df.withColumn("__i", F.row_number().over(w)).where(F.col("__i") <= n).drop("__i")


def stride(df: DataFrame, least: int, most: int, group: str = "tracking_id", order: tuple[str, ...] = ("frame_nr", "tracking_frame_feature_id")) -> DataFrame:
    """Groups of at least `least` rows, at every (rows div most)-th row, `most` of them; none where that is 0."""
    w = Window.partitionBy(group)
    ranked = df.withColumn("__i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count("*").over(w)).withColumn("__s", F.floor(F.col("__n") / most))
    return ranked.where((F.col("__n") >= least) & (F.col("__s") > 0)).where((F.col("__i") % F.col("__s") == 0) & (F.col("__i") / F.col("__s") < most)).drop("__i", "__n", "__s")


def movement(df: DataFrame, n: int, side: float, seed: int = 0) -> DataFrame:
    """Rows of trackings that move: rows fall greedily, in frame order, into buckets around the first
    row of each; trackings with one bucket give nothing, others one row of up to n buckets, by hash order.

    A tracking is one object in one video, so its rows fit in a task.
    """
    if not 0 < side < 1:
        raise ValueError("side must be between 0 and 1")

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["frame_nr", "tracking_frame_feature_id"], ignore_index=True)
        heads: list[tuple[float, float]] = []
        bucket = np.empty(len(pdf), int)
        for i, (x, y) in enumerate(zip(pdf["bbox_x_center_n"], pdf["bbox_y_center_n"])):
            at = next((b for b, (hx, hy) in enumerate(heads) if abs(x - hx) <= side and abs(y - hy) <= side), len(heads))
            if at == len(heads):
                heads.append((x, y))
            bucket[i] = at
        if len(heads) < 2:
            return pdf.iloc[:0]
        order = (pdf["tracking_frame_feature_id"] * 2654435761 + seed) % 4294967296
        one = pdf.assign(__b=bucket, __h=order).sort_values(["__h", "tracking_frame_feature_id"]).drop_duplicates("__b").head(n)
        return one.drop(columns=["__b", "__h"])

    return df.where("tracking_id is not null").groupBy("tracking_id").applyInPandas(pick, df.schema)


def farthest(df: DataFrame, n: int, vector: str = "v", group: str = "tracking_id", id_col: str = "tracking_frame_feature_id") -> DataFrame:
    """Max-min sample by cosine distance: the first row (by id), then always the row farthest from those taken (ties: smaller id)."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col, ignore_index=True)
        if len(pdf) <= n:
            return pdf
        x = np.stack(pdf[vector].to_numpy()).astype(float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        taken, least = [0], 1 - x @ x[0]
        while len(taken) < n:
            least[taken] = -1
            at = int(np.argmax(np.round(least, 12)))
            taken.append(at)
            least = np.minimum(least, 1 - x @ x[at])
        return pdf.iloc[sorted(taken)]

    return df.groupBy(group).applyInPandas(pick, df.schema)


def random_frame(video: DataFrame, seed: int = 0, id_col: str = "video_id") -> DataFrame:
    """video with `frame_nr`, one of its frames (from 0) by a stable hash; videos without frames give nothing."""
    return video.where("frames > 0").withColumn("frame_nr", F.pmod(names.hashed(F.col(id_col), seed), F.col("frames")))


def first(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n rows, or all if there are fewer."""
    return df.orderBy(*order).limit(n)
