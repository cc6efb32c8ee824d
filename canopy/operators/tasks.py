"""The task table: which tasks may run, claims and outcomes, progress, resets, and what to delete when."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (type, subtype) of the tasks that a new video gets.
NEW = (("track", ""), ("predict", "body"), ("predict", "face_90"), ("correlate", "face_90"), ("visualize", ""))


def eligible(task: DataFrame, task_type: str, now: Column, timeout_hours: int = 1, retries: int = 1) -> DataFrame:
    """Tasks of a type that wait, or hang in processing for longer than the timeout, or failed; the latter two with retries left."""
    again = F.col("retries") < retries
    late = F.timestamp_diff("MICROSECOND", F.col("updated_at"), now) > timeout_hours * 3_600_000_000
    return task.where(F.col("task_type") == task_type).where((F.col("status") == "pending") | ((F.col("status") == "processing") & late & again) | ((F.col("status") == "failed") & again))


def progress(task: DataFrame) -> DataFrame:
    """(task_type, task_subtype, total, completed), with a row of each type's totals (null subtype)."""
    done = F.count_if(F.col("status") == "completed")
    by_type = task.rollup("task_type", "task_subtype").agg(F.count("*").alias("total"), done.alias("completed"), F.grouping_id().alias("__g"))
    return by_type.where("__g < 3").select("task_type", F.when(F.col("__g") == 0, F.col("task_subtype")).alias("task_subtype"), "total", "completed")


def reset_dependents(task: DataFrame, provider: str, dependent: str) -> DataFrame:
    """task, with dependents of retried providers set back to pending."""
    retried = task.where((F.col("task_type") == provider) & (F.col("retries") > 0)).select("video_id").distinct().withColumn("__r", F.lit(True))
    hit = (F.col("task_type") == dependent) & F.col("__r").isNotNull()
    return task.join(retried, "video_id", "left").withColumn("status", F.when(hit, "pending").otherwise(F.col("status"))).drop("__r")


def fan_out(video: DataFrame) -> DataFrame:
    """(video_id, task_type, task_subtype, status, retries): the tasks of new videos."""
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("task_type"), F.lit(s).alias("task_subtype")) for t, s in NEW))).alias("t")
    return video.select("video_id", each).select("video_id", "t.task_type", "t.task_subtype", F.lit("pending").alias("status"), F.lit(0).alias("retries"))


def mark_cached(tff: DataFrame, done: DataFrame) -> DataFrame:
    """tff with cached set where done holds the id."""
    d = done.select(F.col(done.columns[0]).alias("tracking_frame_feature_id")).distinct().withColumn("__d", F.lit(True))
    return tff.join(d, "tracking_frame_feature_id", "left").withColumn("cached", F.coalesce("__d", "cached")).drop("__d")


def add_missing(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """existing and those rows of new whose key it lacks."""
    return existing.unionByName(new.dropDuplicates([key]).join(existing.select(key), key, "left_anti").select(existing.columns))


def claim(task: DataFrame, task_type: str, subtype: str, now: Column, n: int, timeout_hours: int = 24, retries: int = 0) -> DataFrame:
    """task, with the first n eligible tasks of a type and subtype (by id) in processing since now; one that had been
    tried has one retry more. A table has one writer at a time, so n workers share one claim instead of locking rows."""
    own = eligible(task, task_type, now, timeout_hours, retries).where(F.col("task_subtype") == subtype)
    taken = own.select("task_id").orderBy("task_id").limit(n).withColumn("__c", F.lit(True))
    mine = F.col("__c").isNotNull()
    again = F.when(mine & (F.col("status") != "pending"), 1).otherwise(0)
    out = task.join(F.broadcast(taken), "task_id", "left")  # n rows
    return out.withColumns({"retries": F.col("retries") + again, "status": F.when(mine, "processing").otherwise(F.col("status")), "updated_at": F.when(mine, now).otherwise(F.col("updated_at"))}).drop("__c")


def finish(task: DataFrame, outcome: DataFrame) -> DataFrame:
    """task after outcomes (task_id, ok): tasks in processing are completed or, if any outcome is bad, failed."""
    o = outcome.groupBy("task_id").agg(F.min("ok").alias("__ok"))
    ended = (F.col("status") == "processing") & F.col("__ok").isNotNull()
    status = F.when(ended, F.when(F.col("__ok"), "completed").otherwise("failed")).otherwise(F.col("status"))
    return task.join(o, "task_id", "left").withColumn("status", status).drop("__ok")


def reset_cached(tff: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """tff with cached unset for ids from low up to high, exclusive; for all rows without bounds. One rewrite needs no batches."""
    c = F.col("tracking_frame_feature_id")
    hit = (F.lit(True) if low is None else c >= low) & (F.lit(True) if high is None else c < high)
    return tff.withColumn("cached", F.col("cached") & ~hit)


def deletion_plan(runs: DataFrame, path: Column, made: Column, reasons: Column, days: int) -> DataFrame:
    """(at, path, reasons) of the runs that have reasons: they go so many days after they were made."""
    out = runs.select(F.timestamp_add("DAY", F.lit(days), made).alias("at"), path.alias("path"), reasons.alias("reasons"))
    return out.where(F.size("reasons") > 0)
