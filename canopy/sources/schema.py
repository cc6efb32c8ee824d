"""The ten relational tables: fixed types, keys, and row checks that split good rows from bad."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Column lists by table.
SCHEMAS: dict[str, str] = {
    "camera": "camera_id bigint not null, name string not null, latitude double, longitude double",
    "video": "video_id bigint not null, version string not null, absolute_path string not null, camera_id bigint not null, start_time timestamp_ntz, width int not null, height int not null, fps double not null, target_output_fps int not null, frames int not null",
    "video_feature": "video_feature_id bigint not null, video_id bigint not null, feature_type string not null, value string not null",
    "tracking": "tracking_id bigint not null, video_id bigint not null",
    "tracking_feature": "tracking_feature_id bigint not null, tracking_id bigint not null, feature_type string not null, value string not null",
    "tracking_frame_feature": "tracking_frame_feature_id bigint not null, video_id bigint not null, tracking_id bigint, frame_nr int not null, bbox_x_center_n double not null, bbox_y_center_n double not null, bbox_width_n double not null, bbox_height_n double not null, bbox_width int not null, bbox_height int not null, confidence double not null, feature_type string not null, cached boolean not null",
    "video_relationship": "video_relationship_id bigint not null, left_video_id bigint not null, right_video_id bigint not null, edge string not null, reason string not null, created_by string not null",
    "tracking_relationship": "tracking_relationship_id bigint not null, left_tracking_id bigint not null, right_tracking_id bigint not null, edge string not null, reason string not null, created_by string not null",
    "task": "task_id bigint not null, video_id bigint not null, task_type string not null, task_subtype string not null, status string not null, retries int not null, updated_at timestamp_ntz not null",
    "task_key_value": "task_key_value_id bigint not null, task_id bigint not null, key string not null, value string not null",
}


def struct(table: str) -> StructType:
    """The type of a table's rows; needs a running session."""
    return StructType.fromDDL(SCHEMAS[table])


TASK_STATUS = ("pending", "processing", "completed", "failed")


def _between(c: str, low: float, high: float) -> Column:
    return F.col(c).isNull() | F.col(c).between(low, high)


#: Checks by table: reason to condition that a good row meets (null conditions count as failed).
CHECKS: dict[str, dict[str, Column]] = {}


def checks(table: str) -> dict[str, Column]:
    """Built on demand, since columns need a running session."""
    if not CHECKS:
        unit = {f"{c} in [0,1]": F.col(c).between(0, 1) for c in ("bbox_x_center_n", "bbox_y_center_n", "bbox_width_n", "bbox_height_n", "confidence")}
        CHECKS.update(
            camera={"latitude": _between("latitude", -90, 90), "longitude": _between("longitude", -180, 180)},
            video={
                "fps above target": F.col("fps") > F.col("target_output_fps"),
                "frames": F.col("frames") > 0,
                "version": F.try_to_date("version", "yyyy-MM-dd").isNotNull() & F.col("version").rlike(r"^\d{4}-\d{2}-\d{2}$"),
            },
            tracking_frame_feature=unit,
            task={"status": F.col("status").isin(*TASK_STATUS), "retries": F.col("retries") >= 0},
            video_relationship={"order": F.col("left_video_id") < F.col("right_video_id")},
            tracking_relationship={"order": F.col("left_tracking_id") < F.col("right_tracking_id")},
        )
    return CHECKS.get(table, {})


def judged(df: DataFrame, table: str) -> DataFrame:
    """df with `failed`, the reasons for which a row is bad (empty if it is good)."""
    each = [F.when(F.coalesce(ok, F.lit(False)), F.lit(None)).otherwise(F.lit(why)) for why, ok in checks(table).items()]
    return df.withColumn("failed", F.array_compact(F.array(*each)) if each else F.array().cast("array<string>"))


def split_valid(df: DataFrame, table: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows with reasons)."""
    seen = judged(df, table)
    return seen.where(F.size("failed") == 0).drop("failed"), seen.where(F.size("failed") > 0)


def path_ok(path: Column) -> Column:
    """Absolute, and a video by its extension."""
    return path.startswith("/") & F.lower(path).rlike(r"\.(mp4|avi)$")
