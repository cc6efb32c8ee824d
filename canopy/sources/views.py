"""The domain tables, as views over the star-schema test tables.

Each view is one SQL text; `{h}` and `{d}` are the only parts that differ between dialects, so an
oracle can build the same views from the same text.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Dialect parts of Spark: an interval of o_orderkey % 24 hours; whole hours since 2024-01-01.
SPARK = {"h": "make_dt_interval(0, cast(o_orderkey%24 as int))", "d": "timestampdiff(HOUR, timestamp_ntz'2024-01-01', ts)"}

CAMERA = """select n_nationkey camera_id, n_name as name,
 case when n_nationkey%5=4 then null else cast((n_nationkey*37)%181-90 as double) end latitude,
 case when n_nationkey%5=4 then null else cast((n_nationkey*53)%361-180 as double) end longitude from {nation}"""
VIDEO = """select o_orderkey video_id, '2024-04-18' as version, c_nationkey camera_id,
 case when o_orderkey%17=0 then null else o_orderdate + {h} end start_time,
 cast(25+(o_orderkey%3)*5 as double) fps, 10 target_output_fps, cast(floor(o_totalprice/100) as int)+1 frames
 from {orders} join {customer} on o_custkey=c_custkey"""
VIDEO_FEATURE = """select o_orderkey video_id, 'social_group' feature_type, c_mktsegment as value
 from {orders} join {customer} on o_custkey=c_custkey where o_orderkey%11<>0"""
TFF = """select tracking_frame_feature_id, video_id, tracking_id, frame_nr, bbox_x_center_n, bbox_y_center_n, bbox_width_n, bbox_height_n,
  cast(floor(bbox_width_n*1920) as int) bbox_width, cast(floor(bbox_height_n*1080) as int) bbox_height, confidence, feature_type, cached
 from (select *, row_number() over (partition by video_id,tracking_id,frame_nr,feature_type order by tracking_frame_feature_id) rn
  from (select event_id tracking_frame_feature_id, user_id video_id,
   case when event_id%13=0 then null else user_id*1000+blk*10+event_id%3 end tracking_id, frame_nr,
   case when event_type in ('click','view') then 'body' when event_type in ('signup','purchase') then 'face_90' else 'face_45' end feature_type,
   cast(250+(event_id*7919)%500 as double)/1000 bbox_x_center_n, cast(250+(event_id*104729)%500 as double)/1000 bbox_y_center_n,
   cast(100+(event_id*31)%400 as double)/1000 bbox_width_n, cast(100+(event_id*17)%400 as double)/1000 bbox_height_n,
   least(value/500, cast(1 as double)) confidence, event_id%7<>0 cached
   from (select event_id, user_id, event_type, value, cast(floor({d}/12) as int)*2 frame_nr, cast(floor({d}/240) as int) blk from {events}) e) r) q
 where rn=1 or tracking_id is null"""
EMB = """select vec_id, label, case when vec_id%5=0 then 'train' else 'val' end as partition,
 concat(label,'_',vec_id%7) individual_video_id, vec_id%4 fold, embedding from {embeddings}"""
#: File names as cameras write them: <GROUP><NN>_<CAM>_<YYYYMMDD>_<clip>.png, every ninth of a solitary.
IMAGE = """select event_id image_id, concat(case when event_id%9=0 then concat('S', cast(user_id%50 as string)) else concat(case user_id%3 when 0 then 'AP' when 1 then 'BG' else 'CL' end, lpad(cast(user_id%20 as string), 2, '0')) end,
  '_R', lpad(cast(event_id%25 as string), 3, '0'), '_2024', lpad(cast(1+event_id%12 as string), 2, '0'), lpad(cast(1+event_id%28 as string), 2, '0'), '_', cast(event_id%400 as string), '.png') as file_name,
  100+event_id%900 as width, 100+(event_id*7)%700 as height, case event_id%10 when 0 then 'test' when 1 then 'val' else 'train' end as split from {events}"""
TASK = """select video_id*5+n as task_id, video_id, t as task_type, s as task_subtype,
  case video_id%4 when 0 then 'pending' when 1 then 'processing' when 2 then 'completed' else 'failed' end status, cast(video_id%3 as int) retries, updated_at
 from (select o_orderkey video_id, o_orderdate updated_at from {orders}) v
 join (select 0 as n, 'track' as t, '' as s union all select 1, 'predict', 'body' union all select 2, 'predict', 'face_90' union all select 3, 'correlate', 'face_90' union all select 4, 'visualize', '') k on true"""
VIEWS = {"camera": CAMERA, "video": VIDEO, "video_feature": VIDEO_FEATURE, "tff": TFF, "emb": EMB, "image": IMAGE, "task": TASK}


class Views:
    """Lazy frames of the domain views over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _view(self, name: str) -> DataFrame:
        text = VIEWS[name]
        used = [t for t in ("nation", "orders", "customer", "events", "embeddings") if "{" + t + "}" in text]
        text = text.replace("{h}", SPARK["h"]).replace("{d}", SPARK["d"])
        return self.spark.sql(text, **{t: self.table(t) for t in used})

    camera = cached_property(lambda self: self._view("camera"))
    video = cached_property(lambda self: self._view("video"))
    video_feature = cached_property(lambda self: self._view("video_feature"))
    tff = cached_property(lambda self: self._view("tff"))
    emb = cached_property(lambda self: self._view("emb"))
    image = cached_property(lambda self: self._view("image"))
    task = cached_property(lambda self: self._view("task"))

    @cached_property
    def tracking(self) -> DataFrame:
        return self.tff.where("tracking_id is not null").select("tracking_id", "video_id").distinct()

    @cached_property
    def vectors(self) -> DataFrame:
        """Embeddings as doubles: vec_id, label, partition, individual_video_id, fold, v."""
        return self.emb.withColumn("v", F.col("embedding").cast("array<double>")).drop("embedding")

