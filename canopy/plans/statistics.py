"""Queries of descriptive statistics, scalar functions and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions import colors, geometry, names
from canopy.operators import filters, mining, nlets, samplers, splits, stats
from canopy.plans.registry import query
from canopy.sources.views import Views

ID = "tracking_frame_feature_id"
_LABEL = "upper(split_part(file_name, '_', 1))"


def _images(v: Views) -> DataFrame:
    f = F.col("file_name")
    return v.image.select("image_id", "file_name", "width", "height", F.col("split").alias("partition"), names.individual(f).alias("label"), names.part(f, 2).alias("cam"), names.recorded(f).alias("day"), names.clip(f).alias("clip"))


@query("select video_id, tracking_id, min(frame_nr) as min_frame, max(frame_nr) as max_frame from tff where tracking_id is not null group by all")
def tracking_summary(v: Views) -> DataFrame:
    return mining.tracking_spans(v.tff)


@query("select n, count(*) as groups from (select v.video_id, count(t.tracking_id) as n from video v left join tracking t using (video_id) group by 1) group by 1")
def h_tracklets(v: Views) -> DataFrame:
    return stats.count_histogram(v.video, v.tracking, "video_id")


@query("select camera_id, count(*) as tracklets from tracking join video using (video_id) group by 1")
def tracklets_per_camera(v: Views) -> DataFrame:
    return v.tracking.join(v.video.select("video_id", "camera_id"), "video_id").groupBy("camera_id").agg(F.count("*").alias("tracklets"))


@query("select name, count(*) as videos from video join camera using (camera_id) group by 1 order by 2 desc, 1")
def videos_per_camera(v: Views) -> DataFrame:
    counts = v.video.groupBy("camera_id").agg(F.count("*").alias("videos"))  # aggregated before the join
    return counts.join(v.camera, "camera_id").select("name", "videos").orderBy(F.desc("videos"), "name")


@query("select camera_id, round(avg(frames/fps), 6) as seconds from video group by 1")
def avg_duration(v: Views) -> DataFrame:
    return v.video.groupBy("camera_id").agg(F.round(F.avg(F.col("frames") / F.col("fps")), 6).alias("seconds"))


@query("select cast(floor(frames/fps/10)*10 as bigint) as bin, count(*) as videos from video group by 1")
def h_duration(v: Views) -> DataFrame:
    return stats.durations(v.video)


@query("select cast(floor((hour(start_time)*60+minute(start_time))/15) as bigint) as bin, count(*) as videos from video where start_time is not null group by 1")
def h_time_of_day(v: Views) -> DataFrame:
    return stats.quarter_hours(v.video)


@query("select cast(start_time as date) as day, count(*) filter (where latitude is not null) as placed, count(*) filter (where latitude is null) as unplaced from video join camera using (camera_id) where year(start_time) > 1993 group by 1")
def h_date_by_position(v: Views) -> DataFrame:
    joined = v.video.where(F.year("start_time") > 1993).join(v.camera, "camera_id")
    return joined.groupBy(F.to_date("start_time").alias("day")).agg(F.count_if(F.col("latitude").isNotNull()).alias("placed"), F.count_if(F.col("latitude").isNull()).alias("unplaced"))


@query("select max(tracking_frame_feature_id) as id from tff")
def max_id(v: Views) -> DataFrame:
    return v.tff.agg(F.max(ID).alias("id"))


@query(f"select split, count(*) as images, count(distinct {_LABEL}) as individuals, count(distinct split_part(file_name, '_', 2)) as cameras, count(distinct split_part(file_name, '_', 3)) as days, min(split_part(file_name, '_', 3)) as first_day, max(split_part(file_name, '_', 3)) as last_day from image group by grouping sets ((split), ())")
def dataset_card(v: Views) -> DataFrame:
    own = v.image.select("split", names.individual(F.col("file_name")).alias("i"), names.part(F.col("file_name"), 2).alias("c"), names.part(F.col("file_name"), 3).alias("d"))
    return own.rollup("split").agg(F.count("*").alias("images"), F.count_distinct("i").alias("individuals"), F.count_distinct("c").alias("cameras"), F.count_distinct("d").alias("days"), F.min("d").alias("first_day"), F.max("d").alias("last_day"))


@query(f"select videos, count(*) as individuals from (select {_LABEL} as i, count(distinct concat(split_part(file_name, '_', 2), split_part(file_name, '_', 3))) as videos from image group by 1) group by 1")
def h_videos_per_id(v: Views) -> DataFrame:
    own = _images(v).groupBy("label").agg(F.count_distinct("cam", "day").alias("videos"))
    return own.groupBy("videos").agg(F.count("*").alias("individuals"))


@query(f"select videos, cast(sum(images) as bigint) as images from (select {_LABEL} as i, count(*) as images, count(distinct concat(split_part(file_name, '_', 2), split_part(file_name, '_', 3))) as videos from image group by 1) group by 1")
def images_by_videos(v: Views) -> DataFrame:
    own = _images(v).groupBy("label").agg(F.count("*").alias("images"), F.count_distinct("cam", "day").alias("videos"))
    return own.groupBy("videos").agg(F.sum("images").alias("images"))


@query(f"select split_part(file_name, '_', 2) as cam, count(*) as images, count(distinct {_LABEL}) as individuals from image group by 1")
def per_camera(v: Views) -> DataFrame:
    return _images(v).groupBy("cam").agg(F.count("*").alias("images"), F.count_distinct("label").alias("individuals"))


@query(f"select label, array_to_string(list_sort(list(distinct partition)), ',') as parts from (select {_LABEL} as label, split as partition from image where width < 400) group by 1 having count(distinct partition) > 1")
def openset_leak(v: Views) -> DataFrame:
    rows = v.image.where("width < 400").select(names.individual(F.col("file_name")).alias("label"), F.col("split").alias("partition"))
    return splits.leaks(rows).withColumn("parts", F.array_join("parts", ","))


@query("select case when vec_id < 50 then 'low' when vec_id < 300 then 'middle' else 'high' end as category, count(*) as n from emb group by 1")
def id_category(v: Views) -> DataFrame:
    return v.emb.groupBy(F.when(F.col("vec_id") < 50, "low").when(F.col("vec_id") < 300, "middle").otherwise("high").alias("category")).agg(F.count("*").alias("n"))


@query("select cast(floor(width/100)*100 as bigint) as x, cast(floor(height/100)*100 as bigint) as y, count(*) as n from image group by 1, 2")
def h2d_size(v: Views) -> DataFrame:
    return stats.grid(v.image, "width", "height")


@query(f"select round(avg(n), 6) as mean, cast(median(n) as double) as median, round(stddev_pop(n), 6) as std, min(n) as low, max(n) as high, cast(quantile_cont(n, 0.25) as double) as p25, cast(quantile_cont(n, 0.75) as double) as p75 from (select {_LABEL} as i, count(*) as n from image group by 1)")
def describe_counts(v: Views) -> DataFrame:
    own = _images(v).groupBy("label").agg(F.count("*").alias("n"))
    return stats.describe(own, "n").withColumn("mean", F.round("mean", 6)).withColumn("std", F.round("std", 6))


@query(f"select i, count(distinct age) as ages from (select {_LABEL} as i, case when image_id % 3 <> 0 then image_id % 7 end as age from image) group by 1")
def ages_per_id(v: Views) -> DataFrame:
    return v.image.groupBy(names.individual(F.col("file_name")).alias("i")).agg(F.count_distinct(F.when(F.col("image_id") % 3 != 0, F.col("image_id") % 7)).alias("ages"))


@query(f"select i, count(distinct camera) > 1 as differs, min_by(camera, image_id) as first_camera from (select {_LABEL} as i, image_id, nullif(split_part(file_name, '_', 2), 'R000') as camera from image) where camera is not null group by 1")
def consistency(v: Views) -> DataFrame:
    own = v.image.select("image_id", names.individual(F.col("file_name")).alias("i"), F.nullif(names.part(F.col("file_name"), 2), F.lit("R000")).alias("camera")).where("camera is not null")
    return own.groupBy("i").agg((F.count_distinct("camera") > 1).alias("differs"), F.min_by("camera", "image_id").alias("first_camera"))


@query(f"select {_LABEL} as i, count(*) filter (where image_id % 3 = 0) as young, count(*) filter (where image_id % 3 = 1) as grown, count(*) filter (where image_id % 3 = 2) as old from image group by 1")
def pivot_age(v: Views) -> DataFrame:
    age = F.element_at(F.array(F.lit("young"), F.lit("grown"), F.lit("old")), (F.col("image_id") % 3 + 1).cast("int"))
    return v.image.select(names.individual(F.col("file_name")).alias("i"), age.alias("age")).groupBy("i").pivot("age", ["young", "grown", "old"]).count().na.fill(0)


@query("select images, count(*) as videos from (select video_id, count(*) as images from tff group by 1) group by 1")
def bristol_stats(v: Views) -> DataFrame:
    return v.tff.groupBy("video_id").agg(F.count("*").alias("images")).groupBy("images").agg(F.count("*").alias("videos"))


#: Cameras, which are the nations.
_CAMERAS = range(25)
_UPTO = ", ".join(f"cast(coalesce(sum(n) filter (where camera_id <= {i}), 0) as bigint) as c{i}" for i in _CAMERAS)


@query(f"with c as (select camera_id, cast(floor(date_diff('day', date '1970-01-01', cast(start_time as date))/14) as bigint) as slice, count(*) as n from video where start_time is not null group by 1, 2) select slice, {_UPTO} from c group by 1")
def resample_pivot(v: Views) -> DataFrame:
    slice_ = F.floor(F.date_diff(F.to_date("start_time"), F.lit("1970-01-01").cast("date")) / 14).alias("slice")
    wide = v.video.where("start_time is not null").groupBy(slice_).pivot("camera_id", list(_CAMERAS)).count().na.fill(0)
    upto = lambda i: sum((F.col(str(j)) for j in range(1, i + 1)), F.col("0"))
    return wide.select("slice", *(upto(i).alias(f"c{i}") for i in _CAMERAS))


@query("select camera_id, cast(start_time as date) as day, min(start_time) as first, max(start_time) as last, date_diff('minute', min(start_time), max(start_time)) as span from video where start_time is not null group by 1, 2")
def day_span(v: Views) -> DataFrame:
    own = v.video.where("start_time is not null").groupBy("camera_id", F.to_date("start_time").alias("day")).agg(F.min("start_time").alias("first"), F.max("start_time").alias("last"))
    return own.withColumn("span", F.timestamp_diff("MINUTE", F.col("first"), F.col("last")))


@query("select label, count(*) as n from emb group by 1")
def class_distribution(v: Views) -> DataFrame:
    return v.emb.groupBy("label").agg(F.count("*").alias("n"))


@query("select 'knn/' || m as key, round(avg(v), 6) as value from (select 'accuracy' as m, fold, avg(label) as v from emb group by all union all select 'f1', fold, max(label) from emb group by all) group by 1")
def kfold_avg(v: Views) -> DataFrame:
    by = v.emb.groupBy("fold").agg(F.avg("label").alias("accuracy"), F.max("label").cast("double").alias("f1"))
    rows = by.select(F.concat(F.lit("fold-"), F.col("fold").cast("string"), F.lit("/knn/")).alias("p"), F.expr("stack(2, 'accuracy', accuracy, 'f1', f1) as (m, v)"))
    return rows.groupBy(F.regexp_replace(F.concat("p", "m"), r"^fold-\d+/", "").alias("key")).agg(F.round(F.avg("v"), 6).alias("value"))


@query("select vec_id, label, max(label) over (order by vec_id rows between unbounded preceding and current row) as best from emb")
def best_metric(v: Views) -> DataFrame:
    return stats.running_max(v.emb.select("vec_id", "label"), "vec_id", "label").withColumnRenamed("running", "best")


@query("select camera_id, max_by(video_id, start_time) as video_id from (select camera_id, start_time, max(video_id) as video_id from video where start_time is not null group by 1, 2) group by 1")
def latest(v: Views) -> DataFrame:
    return v.video.where("start_time is not null").groupBy("camera_id").agg(F.max(F.struct("start_time", "video_id")).alias("m")).select("camera_id", "m.video_id")


@query(f"""with s as (select {_LABEL} as i, split_part(file_name, '_', 2) as cam, cast(regexp_replace(regexp_replace(split_part(file_name, '_', 4), '\\.[^.]*$', ''), '[^0-9]', '', 'g') as int) as clip from image),
g as (select *, case when clip - lag(clip) over (partition by i, cam order by clip) > 20 then 1 else 0 end as new from s),
t as (select *, sum(new) over (partition by i, cam order by clip range unbounded preceding) as session from g)
select i, cam, cast(session as bigint) as session, count(*) as images, min(clip) as first_clip from t group by 1, 2, 3""")
def sessionize(v: Views) -> DataFrame:
    own = _images(v).select(F.col("label").alias("i"), "cam", "clip")
    return stats.sessions(own, ("i", "cam"), F.col("clip"), 20).groupBy("i", "cam", "session").agg(F.count("*").alias("images"), F.min("clip").alias("first_clip"))


@query("select video_id, frames from (select *, rank() over (order by frames desc) as r from video) where r <= 10")
def topk_ties(v: Views) -> DataFrame:
    return stats.with_ties(v.video.select("video_id", "frames"), 10, "frames")


@query("select tracking_frame_feature_id, tracking_id, confidence from (select *, row_number() over (partition by tracking_id order by confidence desc, tracking_frame_feature_id) as r from tff where tracking_id is not null) where r = 1")
def crop_max_conf(v: Views) -> DataFrame:
    best = v.tff.where("tracking_id is not null").groupBy("tracking_id").agg(F.max(F.struct("confidence", (-F.col(ID)).alias("i"))).alias("m"))
    return best.select((-F.col("m.i")).alias(ID), "tracking_id", "m.confidence")


@query("select tracking_id, case when max(confidence) >= 0.5 then 'bbox' else 'low_confidence' end as verdict from tff where tracking_id is not null group by 1 union all select video_id, 'missing' from video where video_id not in (select video_id from tff)")
def crop_triage(v: Views) -> DataFrame:
    seen = v.tff.where("tracking_id is not null").groupBy("tracking_id").agg(F.when(F.max("confidence") >= 0.5, "bbox").otherwise("low_confidence").alias("verdict"))
    return seen.unionAll(v.video.transform(filters.not_videos(v.tff.select("video_id"))).select("video_id", F.lit("missing")))


@query("select tracking_frame_feature_id, case label when 0 then 'body' when 1 then 'face' else 'other' end as name from tff join emb on vec_id = tracking_frame_feature_id")
def crop_explode(v: Views) -> DataFrame:
    kinds = F.create_map(F.lit(0), F.lit("body"), F.lit(1), F.lit("face"))
    return v.tff.join(v.emb.select(F.col("vec_id").alias(ID), "label"), ID).select(ID, F.coalesce(F.try_element_at(kinds, F.col("label")), F.lit("other")).alias("name"))


# --- orders and samples --------------------------------------------------------------------------------------------


@query("select video_id from video order by (video_id*2654435761+5)%4294967296, video_id limit 20")
def o_random(v: Views) -> DataFrame:
    return v.video.orderBy(*filters.in_order(5)).limit(20).select("video_id")


@query("select video_id, start_time from video order by start_time nulls last, video_id")
def o_time(v: Views) -> DataFrame:
    return v.video.select("video_id", "start_time").orderBy(F.asc_nulls_last("start_time"), "video_id")


@query("select video_id from video where camera_id = 3 order by video_id limit 15")
def l_count(v: Views) -> DataFrame:
    return v.video.transform(filters.cameras([3])).orderBy("video_id").limit(15).select("video_id")


@query("select tracking_frame_feature_id from tff where cached order by tracking_frame_feature_id limit 50")
def l_forced(v: Views) -> DataFrame:
    return v.tff.transform(filters.cached).select(ID).orderBy(ID).limit(50)


@query(f"select {_LABEL} as i, count(*) as images from image group by 1 order by 2 desc, 1 limit 10")
def topn(v: Views) -> DataFrame:
    return v.image.groupBy(names.individual(F.col("file_name")).alias("i")).agg(F.count("*").alias("images")).orderBy(F.desc("images"), "i").limit(10)


@query("select image_id, row_number() over (order by (image_id*2654435761+3)%4294967296, image_id) - 1 as rank from image")
def permute(v: Views) -> DataFrame:
    return splits.hash_ranks(v.image.select("image_id"), "image_id", 3).select("image_id", F.col("rank").cast("bigint").alias("rank"))


@query("select video_id from video where frames > 500 order by (video_id*2654435761+42)%4294967296, video_id limit 10")
def s_videos(v: Views) -> DataFrame:
    return v.video.where("frames > 500").orderBy(*filters.in_order(42)).limit(10).select("video_id")


@query("select tracking_frame_feature_id from (select *, row_number() over (partition by tracking_id order by (tracking_frame_feature_id*2654435761+9)%4294967296, tracking_frame_feature_id) as r from tff where tracking_id is not null) where r <= 4")
def s_random(v: Views) -> DataFrame:
    return samplers.random(v.tff.transform(filters.associated), 4, 9).select(ID)


@query("select tracking_frame_feature_id from (select *, row_number() over (partition by tracking_id order by frame_nr, tracking_frame_feature_id) - 1 as i, count(*) over (partition by tracking_id) as n from tff where tracking_id is not null) where n <= 3 or (i % ((n-1)//2) = 0 and i // ((n-1)//2) < 3)")
def s_equidistant(v: Views) -> DataFrame:
    return samplers.equidistant(v.tff.transform(filters.associated), 3).select(ID)


@query("select video_id, ((video_id*2654435761+7)%4294967296) % frames as frame_nr from video where frames > 0")
def s_random_frame(v: Views) -> DataFrame:
    return samplers.random_frame(v.video, 7).select("video_id", "frame_nr")


@query("select image_id from image where split = 'val' order by image_id limit 100")
def l_val_cap(v: Views) -> DataFrame:
    return samplers.first(v.image.where("split = 'val'").select("image_id"), 100, "image_id")


@query("select image_id, image_id // 32 as batch from image order by batch, image_id limit 500")
def l_first_of_batches(v: Views) -> DataFrame:
    return samplers.first(v.image.select("image_id", F.floor(F.col("image_id") / 32).alias("batch")), 500, "batch", "image_id")


@query()
def s_movement(v: Views) -> DataFrame:
    return samplers.movement(v.tff, 3, 0.2).select(ID, "tracking_id")


@query()
def s_farthest(v: Views) -> DataFrame:
    rows = v.tff.transform(filters.associated).join(v.vectors.select(F.col("vec_id").alias(ID), "v"), ID)
    return samplers.farthest(rows.select(ID, "video_id", "v"), 4, group="video_id").select(ID, "video_id")


@query("select image_id, label from (select *, row_number() over (partition by label order by image_id) as r from hashed_image) where r = 1")
def any_image(v: Views) -> DataFrame:
    return nlets.first_of(_images(v).select(F.col("image_id").alias("id"), "label"), "label", "id").select(F.col("id").alias("image_id"), "label")


@query("select split_part(file_name, '_', 1) as label, min(cast(substring(split_part(file_name, '_', 3), 5, 2) as int)) as first_month, substring(split_part(file_name, '_', 1), 1, 2) as prefix from image group by 1")
def prefix_group(v: Views) -> DataFrame:
    own = v.image.select(names.part(F.col("file_name"), 1).alias("label"), F.substring(names.part(F.col("file_name"), 3), 5, 2).cast("int").alias("m"))
    return own.groupBy("label").agg(F.min("m").alias("first_month")).withColumn("prefix", F.substring("label", 1, 2))


@query("select tracking_frame_feature_id, nr from (select tracking_frame_feature_id, frame_nr as nr, row_number() over (partition by tracking_id order by frame_nr, tracking_frame_feature_id) as r from tff where tracking_id is not null) where r between 2 and 4")
def track_frames(v: Views) -> DataFrame:
    named = v.tff.transform(filters.associated).select(ID, "tracking_id", F.split(F.concat_ws("-", F.col("video_id").cast("string"), F.col("tracking_id").cast("string"), F.col("frame_nr").cast("string")), "-")[2].cast("int").alias("nr"))
    r = F.row_number().over(Window.partitionBy("tracking_id").orderBy("nr", ID))
    return named.withColumn("r", r).where("r between 2 and 4").select(ID, "nr")


@query("select video_id from video where start_time + to_days(1) < timestamp '1995-06-01'")
def schedule_due(v: Views) -> DataFrame:
    return v.video.where("start_time + interval 1 day < timestamp_ntz'1995-06-01'").select("video_id")


# --- splits ---------------------------------------------------------------------------------------------------------

_RANKED = "select *, row_number() over (order by h, image_id) - 1 as r, count(*) over () as n from hashed_image"


@query("select video_id, case when r < floor(n*70/100) then 'train' when r < floor(n*70/100) + floor(n*15/100) then 'val' else 'test' end as partition from (select video_id, row_number() over (order by (video_id*2654435761)%4294967296, video_id) - 1 as r, count(*) over () as n from video)")
def split_percentage(v: Views) -> DataFrame:
    return splits.by_percentage(v.video, 70, 15)


@query("select video_id, case when start_time < timestamp '1995-01-01' then 'train' when start_time < timestamp '1996-01-01' then 'val' else 'test' end as partition from video where start_time is not null")
def split_time(v: Views) -> DataFrame:
    return splits.by_time(v.video, "1995-01-01 00:00:00", "1996-01-01 00:00:00")


@query("select video_id, case when camera_id in (0, 1, 2, 3, 4, 5) then 'train' when camera_id in (6, 7) then 'val' else 'test' end as partition from video")
def split_camera(v: Views) -> DataFrame:
    return splits.by_camera(v.video, [0, 1, 2, 3, 4, 5], [6, 7])


@query("select video_id, case when camera_id < 12 and start_time < timestamp '1996-01-01' then 'train' when start_time < timestamp '1997-01-01' then 'val' when camera_id >= 6 then 'test' end as partition from video where (camera_id < 12 and start_time < timestamp '1996-01-01') or start_time < timestamp '1997-01-01' or camera_id >= 6")
def split_custom(v: Views) -> DataFrame:
    t = F.col("start_time")
    before = lambda x: t < F.lit(x).cast("timestamp_ntz")
    return splits.custom(v.video, (F.col("camera_id") < 12) & before("1996-01-01"), before("1997-01-01"), F.col("camera_id") >= 6)


@query("select n, n - greatest(cast(floor(n*10/100) as bigint), 1) - greatest(cast(floor(n*25/100) as bigint), 1) as train, greatest(cast(floor(n*10/100) as bigint), 1) as val, greatest(cast(floor(n*25/100) as bigint), 1) as test from (select unnest(range(1, 200)) as n)")
def compute_split(v: Views) -> DataFrame:
    a, b, c = splits.split_sizes(F.col("n"), 10, 25)
    return v.spark.range(1, 200).toDF("n").select("n", a.alias("train"), b.alias("val"), c.alias("test"))


@query("""with f as (select *, row_number() over (partition by label order by h, image_id) <= 3 as keep from hashed_image),
r as (select *, row_number() over (order by h1, image_id) - 1 as r from f where not keep),
s as (select greatest(floor(count(*)*10/100), 1) as v, greatest(floor(count(*)*20/100), 1) as t from hashed_image)
select image_id, 'train' as partition from f where keep union all select image_id, case when r < v then 'val' when r < v + t then 'test' else 'train' end from r, s""")
def split_closed(v: Views) -> DataFrame:
    return splits.closed_set(_images(v), 10, 20)


@query("""with i as (select label, h, image_id, row_number() over (partition by label order by h, image_id) as k from hashed_image),
f as (select label, row_number() over (order by h, image_id) - 1 as r, count(*) over () as n from i where k = 1)
select h.image_id, case when r < greatest(floor(n*10/100), 1) then 'val' when r < greatest(floor(n*10/100), 1) + greatest(floor(n*20/100), 1) then 'test' else 'train' end as partition from hashed_image h join f using (label)""")
def split_open(v: Views) -> DataFrame:
    return splits.open_set(_images(v), 10, 20)


@query(f"select image_id, cast(least(floor(r / greatest(floor(n/5), 1)), 4) as int) as fold from ({_RANKED})")
def kfold_closed(v: Views) -> DataFrame:
    return splits.equal_folds(_images(v), 5)


@query()
def kfold_open(v: Views) -> DataFrame:
    return splits.balanced_folds(_images(v), 4)


@query("select vec_id, case when fold < 0 then 'test' when fold = 2 then 'val' else 'train' end as partition from emb")
def kfold_view(v: Views) -> DataFrame:
    return splits.fold_view(v.emb.select("vec_id", "fold"), 2).select("vec_id", "partition")


@query("select split as partition, count(*) as n from image group by 1")
def split_stats(v: Views) -> DataFrame:
    return v.image.groupBy(F.col("split").alias("partition")).agg(F.count("*").alias("n"))


@query("""with b as (select image_id, label as subject from hashed_image where image_id % 11 <> 0 union all select image_id, concat(label, 'X') from hashed_image where image_id % 17 = 0),
o as (select i.image_id, i.label, i.split from hashed_image i where exists (select 1 from b where b.image_id = i.image_id and b.subject = i.label)),
t as (select distinct label from o where split = 'test' except select label from o where split <> 'test'),
v as (select distinct label from o where split = 'val' except select label from o where split <> 'val')
select image_id, label, case when split in ('train', 'val') and image_id in (select image_id from b where subject in (select label from t)) then 'test' when split = 'train' and image_id in (select image_id from b where subject in (select label from v)) then 'val' else split end as partition from o""")
def integrity(v: Views) -> DataFrame:
    own = _images(v).select("image_id", "label", "partition")
    boxes = own.where("image_id % 11 <> 0").select("image_id", F.col("label").alias("subject")).unionAll(own.where("image_id % 17 = 0").select("image_id", F.concat("label", F.lit("X"))))
    return splits.integrity(own, boxes)


# --- scalar functions -------------------------------------------------------------------------------------------------


@query("select tracking_frame_feature_id, cast(trunc((bbox_x_center_n-bbox_width_n/2)*1920) as int) as x0, cast(trunc((bbox_y_center_n-bbox_height_n/2)*1080) as int) as y0, cast(trunc((bbox_x_center_n+bbox_width_n/2)*1920) as int) as x1, cast(trunc((bbox_y_center_n+bbox_height_n/2)*1080) as int) as y1 from tff")
def bbox_corners(v: Views) -> DataFrame:
    c = geometry.corners(*(F.col(f"bbox_{x}_n") for x in ("x_center", "y_center", "width", "height")), F.lit(1920), F.lit(1080))
    return v.tff.select(ID, *(x.alias(n) for x, n in zip(c, ("x0", "y0", "x1", "y1"))))


@query("select tracking_frame_feature_id, cast(trunc(bbox_width/bbox_width_n) as int) as w, cast(trunc(bbox_height/bbox_height_n) as int) as h from tff")
def bbox_dims(v: Views) -> DataFrame:
    return v.tff.select(ID, (F.col("bbox_width") / F.col("bbox_width_n")).cast("int").alias("w"), (F.col("bbox_height") / F.col("bbox_height_n")).cast("int").alias("h"))


@query("select tracking_frame_feature_id, round(least(greatest(bbox_width_n*1920, bbox_height_n*1080), 2*bbox_x_center_n*1920, 2*(1-bbox_x_center_n)*1920, 2*bbox_y_center_n*1080, 2*(1-bbox_y_center_n)*1080), 6) as side from tff")
def bbox_square(v: Views) -> DataFrame:
    side = geometry.squared_side(*(F.col(f"bbox_{x}_n") for x in ("x_center", "y_center", "width", "height")), F.lit(1920), F.lit(1080))
    return v.tff.select(ID, F.round(side, 6).alias("side"))


@query("select l.tracking_frame_feature_id as a, r.tracking_frame_feature_id as b, round(greatest(0, least(l.bbox_x_center_n+l.bbox_width_n/2, r.bbox_x_center_n+r.bbox_width_n/2) - greatest(l.bbox_x_center_n-l.bbox_width_n/2, r.bbox_x_center_n-r.bbox_width_n/2)) * greatest(0, least(l.bbox_y_center_n+l.bbox_height_n/2, r.bbox_y_center_n+r.bbox_height_n/2) - greatest(l.bbox_y_center_n-l.bbox_height_n/2, r.bbox_y_center_n-r.bbox_height_n/2)) / least(l.bbox_width_n*l.bbox_height_n, r.bbox_width_n*r.bbox_height_n), 6) as ios from tff l join tff r on l.tracking_id = r.tracking_id and l.tracking_frame_feature_id < r.tracking_frame_feature_id")
def ios(v: Views) -> DataFrame:
    own = v.tff.where("tracking_id is not null")
    left, right = (own.select("tracking_id", *(F.col(c).alias(p + c) for c in (ID, "bbox_x_center_n", "bbox_y_center_n", "bbox_width_n", "bbox_height_n"))) for p in ("l_", "r_"))
    return left.join(right, "tracking_id").where(f"l_{ID} < r_{ID}").select(F.col(f"l_{ID}").alias("a"), F.col(f"r_{ID}").alias("b"), F.round(geometry.over_smallest("l_", "r_"), 6).alias("ios"))


@query("select tracking_id, min(bbox_width*bbox_height) as smallest, round(max(bbox_x_center_n+bbox_width_n/2) - min(bbox_x_center_n-bbox_width_n/2), 6) as union_width from tff where tracking_id is not null group by 1")
def box_ops(v: Views) -> DataFrame:
    x, w = F.col("bbox_x_center_n"), F.col("bbox_width_n")
    return v.tff.transform(filters.associated).groupBy("tracking_id").agg(F.min(F.col("bbox_width") * F.col("bbox_height")).alias("smallest"), F.round(F.max(x + w / 2) - F.min(x - w / 2), 6).alias("union_width"))


@query("select tracking_frame_feature_id, round((bbox_x_center_n*1920 - bbox_width/2)/1920, 9) as left_n, round(bbox_width/1920, 9) as w from tff")
def yolo_convert(v: Views) -> DataFrame:
    row = F.array(F.lit(0.0), F.col("confidence"), (F.col("bbox_x_center_n") * 1920 - F.col("bbox_width") / 2) / 1920, F.col("bbox_width") / 1920)
    box = F.slice(row, 3, 2)
    return v.tff.select(ID, F.round(box[0], 9).alias("left_n"), F.round(box[1], 9).alias("w"))


_HASHED = """h1 as (select tracking_frame_feature_id, tracking_id, xor(tracking_id >> 16, tracking_id)::hugeint * 73244475 as h from tff),
h2 as (select tracking_frame_feature_id, tracking_id, xor(h >> 16, h) * 73244475 as h from h1), h3 as (select tracking_frame_feature_id, tracking_id, xor(h >> 16, h & 4294967295::hugeint) as h from h2)"""


@query(f"with {_HASHED} select tracking_frame_feature_id, cast(h as varchar) as h from h3")
def jenkins(v: Views) -> DataFrame:
    return v.tff.select(ID, colors.jenkins_hash(F.col("tracking_id")).cast("string").alias("h"))


@query(f"""with {_HASHED}, c as (select tracking_frame_feature_id, cast(h % 360 as double) / 360 * 6 as x, case when (h // 360) % 2 = 0 then 0.7::double else 1::double end as s from h3),
d as (select *, cast(floor(x) as int) as i, 0.9::double as v, 0.9::double * (1 - s) as p, 0.9::double * (1 - s * (x - floor(x))) as q, 0.9::double * (1 - s * (1 - (x - floor(x)))) as t from c)
select tracking_frame_feature_id, cast(coalesce(trunc([p, p, t, v, v, q][i + 1] * 255), 0) as int) as b, cast(coalesce(trunc([t, v, v, q, p, p][i + 1] * 255), 0) as int) as g, cast(coalesce(trunc([v, q, p, p, t, v][i + 1] * 255), 255) as int) as r from d""")
def id_color(v: Views) -> DataFrame:
    return v.tff.select(ID, colors.of_id(F.col("tracking_id")).alias("c")).select(ID, "c.b", "c.g", "c.r")


@query("select epoch, round(case when epoch < 5 then 1e-5 + (1e-3-1e-5)*epoch/5 else 1e-4 + (1e-3-1e-4)*(1+cos(pi()*(epoch-5)/45))/2 end, 9) as cosine, round(case when epoch < 5 then 1e-5 + (1e-3-1e-5)*epoch/5 else 1e-3 + (1e-4-1e-3)*(epoch-5)/45 end, 9) as linear, round(case when epoch < 5 then 1e-5 + (1e-3-1e-5)*epoch/5 else 1e-3 * power(0.9, epoch-5) end, 9) as exponential from (select unnest(range(0, 50)) as epoch)")
def lr_schedule(v: Views) -> DataFrame:
    e, warm = F.col("epoch"), F.lit(1e-5) + F.lit(1e-3 - 1e-5) * F.col("epoch") / 5
    after = {"cosine": F.lit(1e-4) + F.lit(1e-3 - 1e-4) * (1 + F.cos(F.pi() * (e - 5) / 45)) / 2, "linear": F.lit(1e-3) + F.lit(1e-4 - 1e-3) * (e - 5) / 45, "exponential": F.lit(1e-3) * F.pow(F.lit(0.9), e - 5)}
    return v.spark.range(0, 50).toDF("epoch").select("epoch", *(F.round(F.when(e < 5, warm).otherwise(x), 9).alias(n) for n, x in after.items()))


@query("select image_id, cast((greatest(width, height) - width) // 2 as bigint) as left_pad, cast(greatest(width, height) - width - (greatest(width, height) - width) // 2 as bigint) as right_pad from image")
def square_pad(v: Views) -> DataFrame:
    gap = F.greatest("width", "height") - F.col("width")
    return v.image.select("image_id", F.floor(gap / 2).alias("left_pad"), (gap - F.floor(gap / 2)).alias("right_pad"))


@query("select image_id, cast(round_even(width * least(1.0, 300.0 / greatest(width, height)), 0) as int) as w, cast(round_even(height * least(1.0, 300.0 / greatest(width, height)), 0) as int) as h from image")
def resize_dims(v: Views) -> DataFrame:
    scale = F.least(F.lit(1.0), F.lit(300.0) / F.greatest("width", "height"))
    return v.image.select("image_id", F.rint(F.col("width") * scale).cast("int").alias("w"), F.rint(F.col("height") * scale).cast("int").alias("h"))


@query("select image_id, width % 7 + width % 3 as area, width % 5 + width % 7 + 4 + width % 3 as total, case when width % 5 > 0 then 0 when width % 7 > 0 then 1 end as first from image")
def rle_area(v: Views) -> DataFrame:
    rle = F.array(F.col("width") % 5, F.col("width") % 7, F.lit(4), F.col("width") % 3).cast("array<int>")
    mask = geometry.rle_mask(rle)
    first = F.when(F.col("width") % 5 > 0, 0).when(F.col("width") % 7 > 0, 1)
    return v.image.select("image_id", geometry.rle_area(rle).cast("bigint").alias("area"), F.size(mask).cast("bigint").alias("total"), F.when(first.isNotNull(), F.try_element_at(mask, F.lit(1))).cast("int").alias("first"))


@query(f"select image_id, {_LABEL} as individual, concat(upper(split_part(file_name, '_', 1)), upper(split_part(file_name, '_', 2)), split_part(file_name, '_', 3)) as individual_video from image")
def id_parse(v: Views) -> DataFrame:
    f = F.col("file_name")
    return v.image.select("image_id", names.individual(f).alias("individual"), names.individual_video(f).alias("individual_video"))


@query("select vec_id, cast(fold as int) as fold from emb")
def fold_parse(v: Views) -> DataFrame:
    return v.emb.select("vec_id", names.fold_number(F.concat(F.lit("dataset-fold-"), F.col("fold").cast("string"))).alias("fold"))


@query(f"select image_id, case when length({_LABEL}) <> 4 then 'SOLITARY' else substring({_LABEL}, 1, 2) end as grp, split_part(file_name, '_', 2) as cam, cast(strptime(split_part(file_name, '_', 3), '%Y%m%d') as date) as day, image_id % 400 as clip from image")
def filename_parse(v: Views) -> DataFrame:
    own = _images(v)
    return own.select("image_id", names.group_of(F.col("label")).alias("grp"), "cam", "day", F.col("clip").cast("bigint").alias("clip"))


@query("select video_id, case video_id % 3 when 0 then 'AB' when 1 then null else null end as code from video")
def social_group(v: Views) -> DataFrame:
    folder = F.concat(F.lit("cam_"), F.col("camera_id").cast("string"), F.when(F.col("video_id") % 3 == 0, " AB").when(F.col("video_id") % 3 == 1, " XX").otherwise(" abc"))
    return v.video.select("video_id", names.social_group(folder).alias("code"))


@query("select image_id, strptime(concat(split_part(file_name, '_', 3), ' ', lpad(cast(1+image_id%12 as varchar), 2, '0'), ':30 PM'), '%Y%m%d %I:%M %p') as taken from image")
def meta_parse(v: Views) -> DataFrame:
    text = F.concat(names.part(F.col("file_name"), 3), F.lit(" "), F.lpad((1 + F.col("image_id") % 12).cast("string"), 2, "0"), F.lit(":30 PM"))
    return v.image.select("image_id", F.to_timestamp_ntz(text, F.lit("yyyyMMdd hh:mm a")).alias("taken"))


@query("select video_id, case when video_id % 2 = 0 then cast(frames as varchar) end as created from video")
def json_path(v: Views) -> DataFrame:
    text = F.when(F.col("video_id") % 2 == 0, F.concat(F.lit('{"format":{"tags":{"creation_time":"'), F.col("frames").cast("string"), F.lit('"}}}'))).otherwise('{"format":{}}')
    return v.video.select("video_id", F.get_json_object(text, "$.format.tags.creation_time").alias("created"))


@query("select camera_id, 'team' as entity, concat('p', camera_id) as project, name as run from camera where name not like '% %'")
def url_parse(v: Views) -> DataFrame:
    path = F.split(F.parse_url(F.concat(F.lit("https://host.example/team/p"), F.col("camera_id").cast("string"), F.lit("/runs/"), "name", F.lit("?x=1")), F.lit("PATH")), "/")
    return v.camera.where("name not like '% %'").select("camera_id", path[1].alias("entity"), path[2].alias("project"), path[4].alias("run"))


@query("select 'val/fold-' || fold || '/' || m as key, n as value from (select fold, 'rows' as m, count(*) as n from emb group by 1 union all select fold, 'classes', count(distinct label) from emb group by 1)")
def metric_keys(v: Views) -> DataFrame:
    by = v.emb.groupBy("fold").agg(F.count("*").alias("rows"), F.count_distinct("label").alias("classes"))
    long = by.unpivot("fold", ["rows", "classes"], "m", "value")
    return long.select(F.concat_ws("/", F.lit("val"), F.concat(F.lit("fold-"), F.col("fold").cast("string")), "m").alias("key"), "value")
