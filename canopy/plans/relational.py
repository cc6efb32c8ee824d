"""Queries of scans, filters, joins, tasks and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.functions import geometry, names
from canopy.operators import filters, mining, samplers, tasks
from canopy.plans.registry import query
from canopy.plans.selection import Selection
from canopy.sources import readers, schema
from canopy.sources.views import Views

ID = "tracking_frame_feature_id"


@query("select camera_id, name, latitude, longitude from camera")
def scan_camera(v: Views) -> DataFrame:
    return v.camera


@query("select video_id, version, camera_id, start_time, fps, target_output_fps, frames from video")
def scan_video(v: Views) -> DataFrame:
    return v.video


@query("select * from tff")
def scan_tff(v: Views) -> DataFrame:
    return v.tff


@query("select vec_id, label, list_sum(embedding::double[]) > 0 as positive from emb")
def scan_embeddings(v: Views) -> DataFrame:
    return v.vectors.select("vec_id", "label", (F.aggregate("v", F.lit(0.0), lambda s, x: s + x) > 0).alias("positive"))


@query("select name, cast(replace(lat, ',', '.') as double) as latitude from (select rtrim(concat(lower(name), 'xx'), 'x') as name, replace(cast(latitude/4 as varchar), '.', ',') as lat from camera)")
def csv_locale(v: Views) -> DataFrame:
    raw = v.camera.select(F.concat(F.lower("name"), F.lit("xx")).alias("name"), F.regexp_replace((F.col("latitude") / 4).cast("string"), r"\.", ",").alias("lat"))
    return raw.select(F.rtrim("name", F.lit("x")).alias("name"), readers.decimal_comma(F.col("lat")).alias("latitude"))


@query("select camera_id, rtrim(concat(name, 'xx'), 'x') as name from camera")
def str_rstrip(v: Views) -> DataFrame:
    return v.camera.select("camera_id", F.rtrim(F.concat("name", F.lit("xx")), F.lit("x")).alias("name"))


@query("select frames, min(video_id) as video_id from video group by frames having count(*) = 1")
def lookup_unique(v: Views) -> DataFrame:
    return readers.unique_lookup(v.video.select("frames", "video_id"), "frames", "video_id")


@query("select video_id, 'start' as key, cast(frames as varchar) as value from video union all select video_id, 'v', version from video")
def json_map(v: Views) -> DataFrame:
    text = v.video.select("video_id", F.to_json(F.struct(F.col("frames").cast("string").alias("start"), F.col("version").alias("v"))).alias("j"))
    return text.select("video_id", F.explode(readers.json_map(F.col("j"))).alias("key", "value"))


@query("select tracking_frame_feature_id as id, 0 as frame, bbox_width_n as w from tff where feature_type = 'body'")
def json_posexplode(v: Views) -> DataFrame:
    box = F.struct((F.col("feature_type") == "body").cast("int").alias("class"), F.col(ID).alias("id"), F.lit(0.5).alias("center_x"), F.lit(0.5).alias("center_y"), F.col("bbox_width_n").alias("w"), F.lit(0.5).alias("h"))
    text = v.tff.select(F.to_json(F.array(F.array(box))).alias("labels"))
    frames = text.select(F.posexplode(readers.tracked_boxes(F.col("labels"))).alias("frame", "boxes")).select("frame", F.explode("boxes").alias("b"))
    return frames.where("b.class = 1").select(F.col("b.id").cast("bigint").alias("id"), "frame", F.col("b.w").alias("w"))


@query("select image_id, 'eye' as label, width % 50 as box_left, width % 50 + 20 as box_right, width % 7 + 3 as area from image where width % 3 = 0")
def xml_boxes(v: Views) -> DataFrame:
    mask = F.format_string('<image name="%s"><mask label="eye" left="%d" width="20" rle="2, %d, 1, 3"/></image>', "file_name", F.col("width") % 50, F.col("width") % 7)
    none = F.format_string('<image name="%s"></image>', "file_name")
    parsed = v.image.select("image_id", F.from_xml(F.when(F.col("width") % 3 == 0, mask).otherwise(none), "_name string, mask array<struct<_label:string,_left:int,_width:int,_rle:string>>").alias("x"))
    one = parsed.select("image_id", F.explode("x.mask").alias("m"))
    rle = F.split(F.col("m._rle"), r",\s*").cast("array<int>")
    return one.select("image_id", F.col("m._label").alias("label"), F.col("m._left").cast("bigint").alias("box_left"), (F.col("m._left") + F.col("m._width")).cast("bigint").alias("box_right"), geometry.rle_area(rle).cast("bigint").alias("area"))


@query("select tracking_frame_feature_id as id, round(bbox_x_center_n, 3) as x, round(bbox_width_n, 3) as w from tff where tracking_frame_feature_id % 10 <> 0")
def parse_yolo(v: Views) -> DataFrame:
    line = F.when(F.col(ID) % 10 != 0, F.concat_ws(" ", F.lit("0"), *(F.format_string("%.3f", c) for c in ("bbox_x_center_n", "bbox_y_center_n", "bbox_width_n", "bbox_height_n")))).otherwise("  ")
    return v.tff.select(F.col(ID).alias("id"), readers.yolo_row(line).alias("b")).where("b is not null").select("id", F.col("b")[1].alias("x"), F.col("b")[3].alias("w"))


@query("select camera_id, name as n, cast(case when camera_id % 2 = 0 then -1 else camera_id end as int) as eye from camera")
def parse_kv(v: Views) -> DataFrame:
    line = F.concat(F.lit("name "), F.col("name"), F.lit(" eye "), F.when(F.col("camera_id") % 2 == 0, "Inf").otherwise(F.col("camera_id").cast("string")))
    pairs = v.camera.select("camera_id", "name", readers.key_values(F.regexp_replace(line, r"^name .* eye", "eye")).alias("m"))
    return pairs.select("camera_id", F.col("name").alias("n"), F.col("m")["eye"].cast("int").alias("eye"))


@query("select image_id, split_part(file_name, '_', 1) as label from image")
def label_from_name(v: Views) -> DataFrame:
    return v.image.select("image_id", names.label_of(F.col("file_name")).alias("label"))


@query("select image_id, concat('fold-', image_id % 5, split_part(file_name, '_', 1)) as label from image")
def label_from_fold(v: Views) -> DataFrame:
    return v.image.select("image_id", F.concat(F.lit("fold-"), (F.col("image_id") % 5).cast("string"), names.part(F.col("file_name"), 1)).alias("label"))


@query("select image_id, lower(replace(concat(image_id, '_', 'My ', file_name), ' ', '_')) as name, split as label from image")
def reformat_name(v: Views) -> DataFrame:
    path = F.concat(F.lit("/data/"), F.col("split"), F.lit("/My "), F.col("file_name"))
    parts = F.split(path, "/")
    return v.image.select("image_id", F.lower(F.replace(F.concat(F.col("image_id").cast("string"), F.lit("_"), F.element_at(parts, -1)), F.lit(" "), F.lit("_"))).alias("name"), F.element_at(parts, -2).alias("label"))


@query("select image_id as id, label, 'a' as origin from (select image_id, split_part(file_name, '_', 1) as label from image) union all select vec_id, cast(label as varchar), null from emb where label <> 3")
def union_by_name(v: Views) -> DataFrame:
    one = v.image.select(F.col("image_id").alias("id"), names.part(F.col("file_name"), 1).alias("label"), F.lit("a").alias("origin"))
    two = v.emb.where("label <> 3").select(F.col("label").cast("string").alias("label"), F.col("vec_id").alias("id"))
    return one.unionByName(two, allowMissingColumns=True)


@query("select video_id, frames from video where fps >= 1 and frames >= 1 and frames < 2000")
def ingest_validate(v: Views) -> DataFrame:
    return v.video.where("fps >= 1 and frames >= 1").where("frames < 2000").select("video_id", "frames")


@query("select video_id, concat_ws(',', case when not (case when video_id % 23 = 0 then 0 else fps end > target_output_fps) then 'fps above target' end, case when video_id % 19 = 0 then 'frames' end) as failed from video")
def ingest_split(v: Views) -> DataFrame:
    """Good videos and those put aside, with the reasons."""
    odd = v.video.withColumns({"fps": F.when(F.col("video_id") % 23 == 0, 0.0).otherwise(F.col("fps")), "frames": F.when(F.col("video_id") % 19 == 0, 0).otherwise(F.col("frames"))})
    good, bad = schema.split_valid(odd, "video")
    return good.select("video_id", F.lit("").alias("failed")).unionAll(bad.select("video_id", F.array_join("failed", ",").alias("failed")))


@query("select video_id, t as task_type, s as task_subtype, 'pending' as status, 0 as retries from video join (select 'track' as t, '' as s union all select 'predict', 'body' union all select 'predict', 'face_90' union all select 'correlate', 'face_90' union all select 'visualize', '') k on true")
def task_fanout(v: Views) -> DataFrame:
    return tasks.fan_out(v.video)


@query("select camera_id, name from camera where camera_id < 10 union all select camera_id, concat('new ', name) from camera where camera_id >= 10")
def upsert_anti(v: Views) -> DataFrame:
    return tasks.add_missing(v.camera.where("camera_id < 10").select("camera_id", "name"), v.camera.select("camera_id", F.concat(F.lit("new "), "name").alias("name")), "camera_id")


@query("select tracking_frame_feature_id, cached or tracking_frame_feature_id % 3 = 0 as cached from tff")
def update_flag(v: Views) -> DataFrame:
    return tasks.mark_cached(v.tff, v.tff.where(f"{ID} % 3 = 0").select(ID)).select(ID, "cached")


@query("""select camera_id, concat('{"camera_id":', camera_id, ',"name":"', name, '"}') as j from camera""")
def to_json(v: Views) -> DataFrame:
    return v.camera.select("camera_id", F.to_json(F.struct("camera_id", "name")).alias("j"))


@query("select tracking_frame_feature_id, concat(cast(case feature_type when 'body' then 0 when 'face_45' then 1 else 2 end as varchar), ' ', printf('%.6f', bbox_x_center_n), ' ', printf('%.6f', bbox_width_n)) as line from tff")
def yolo_export(v: Views) -> DataFrame:
    classes = v.tff.agg(F.sort_array(F.collect_set("feature_type")).alias("c"))  # a few names
    return v.tff.join(F.broadcast(classes)).select(ID, F.format_string("%d %.6f %.6f", F.array_position("c", F.col("feature_type")) - 1, "bbox_x_center_n", "bbox_width_n").alias("line"))


@query("select tracking_frame_feature_id, concat('0 ', printf('%.3f', bbox_x_center_n), ' ', printf('%.3f', bbox_width_n)) as line from tff")
def yolo_class0(v: Views) -> DataFrame:
    line = F.concat_ws(" ", "feature_type", F.format_string("%.3f", "bbox_x_center_n"), F.format_string("%.3f", "bbox_width_n"))
    parts = F.split(line, " ")
    return v.tff.select(ID, F.concat(F.lit("0 "), F.array_join(F.slice(parts, F.lit(2), F.size(parts)), " ")).alias("line"))


@query("select i.image_id, f.tracking_frame_feature_id from image i join tff f on i.image_id = f.tracking_frame_feature_id")
def join_annotations(v: Views) -> DataFrame:
    return v.image.select("image_id", names.stem(F.col("file_name")).alias("s"), F.col("image_id").alias("k")).join(v.tff.select(ID), F.col("k") == F.col(ID)).select("image_id", ID)


# --- filters ---------------------------------------------------------------------------------------------------


@query("select video_id from video where version = '2024-04-18'")
def video_ids(v: Views) -> DataFrame:
    return v.video.transform(filters.version("2024-04-18")).select("video_id")


@query("select camera_id from camera")
def camera_ids(v: Views) -> DataFrame:
    return v.camera.select("camera_id")


@query("select cast(tracking_frame_feature_id as varchar) as id, concat('crops/', tracking_frame_feature_id%256, '/', tracking_frame_feature_id%65536, '/', tracking_frame_feature_id, '.png') as image_path, tracking_id as class_label from tff where tracking_id is not null")
def contrastive_images(v: Views) -> DataFrame:
    return v.tff.transform(filters.associated).select(F.col(ID).cast("string").alias("id"), names.crop_path("crops", F.col(ID)).alias("image_path"), F.col("tracking_id").alias("class_label"))


@query("select * from tff where video_id = 7")
def f_video(v: Views) -> DataFrame:
    return v.tff.transform(filters.video(7))


@query("select tracking_frame_feature_id from tff where video_id in (select video_id from video where camera_id < 5)")
def f_videos_in(v: Views) -> DataFrame:
    return v.tff.transform(filters.videos(v.video.where("camera_id < 5").select("video_id"))).select(ID)


@query("select tracking_frame_feature_id from tff where tracking_id is not null")
def f_associated(v: Views) -> DataFrame:
    return v.tff.transform(filters.associated).select(ID)


@query("select tracking_frame_feature_id from tff where cached")
def f_cached(v: Views) -> DataFrame:
    return v.tff.transform(filters.cached).select(ID)


@query("select t.* from tff t join (select tracking_id from tff group by tracking_id having count(*) >= 5) c on t.tracking_id = c.tracking_id")
def f_min_count(v: Views) -> DataFrame:
    return v.tff.transform(filters.min_count(5))


@query("select tracking_frame_feature_id from tff where feature_type in ('face_45', 'face_90')")
def f_feature_type(v: Views) -> DataFrame:
    return v.tff.transform(filters.feature_types(["face_45", "face_90"])).select(ID)


@query("select b.tracking_frame_feature_id from tff b join tff f on b.tracking_id = f.tracking_id and b.frame_nr = f.frame_nr where b.feature_type = 'body' and f.feature_type = 'face_90'")
def f_body_with_face(v: Views) -> DataFrame:
    return v.tff.transform(filters.feature_types(["body_with_face", "face_45"], v.tff)).select(ID)


@query("select tracking_frame_feature_id from tff where confidence >= 0.5")
def f_confidence(v: Views) -> DataFrame:
    return v.tff.transform(filters.confidence(0.5)).select(ID)


@query("select tracking_frame_feature_id from tff where bbox_width between 300 and 800 and bbox_height >= 200")
def f_bbox(v: Views) -> DataFrame:
    return v.tff.transform(filters.bbox(min_width=300, max_width=800, min_height=200)).select(ID)


@query("select tracking_frame_feature_id from tff where video_id in (3, 5, 8) and feature_type = 'body' and tracking_id is not null")
def f_load(v: Views) -> DataFrame:
    return v.tff.transform(filters.videos([3, 5, 8])).transform(filters.feature_types(["body"])).transform(filters.associated).select(ID)


@query("select video_id, version from video where version = '2024-04-18'")
def f_version(v: Views) -> DataFrame:
    return v.video.transform(filters.version("2024-04-18")).select("video_id", "version")


@query("select video_id from video where hour(start_time) in (6, 7, 8) or start_time is null")
def f_hour(v: Views) -> DataFrame:
    return v.video.transform(filters.hours([6, 7, 8, None])).select("video_id")


@query("select video_id from video where start_time between timestamp '1995-01-01' and timestamp '1996-06-30 12:00:00'")
def f_date(v: Views) -> DataFrame:
    return v.video.transform(filters.dates("1995-01-01 00:00:00", "1996-06-30 12:00:00")).select("video_id")


@query("select video_id, cast(round_even(frames/fps, 0) as int) as seconds from video where cast(round_even(frames/fps, 0) as int) between 10 and 40")
def f_length(v: Views) -> DataFrame:
    return v.video.transform(filters.length(10, 40)).select("video_id", filters.seconds().alias("seconds"))


@query("select video_id from video where camera_id in (1, 2, 3)")
def f_camera(v: Views) -> DataFrame:
    return v.video.transform(filters.cameras([1, 2, 3])).select("video_id")


@query("select video_id from video where video_id not in (select video_id from tff)")
def f_not_in(v: Views) -> DataFrame:
    return v.video.transform(filters.not_videos(v.tff.select("video_id"))).select("video_id")


@query("select base_name from (select distinct lower(concat('r', lpad(cast(camera_id as varchar), 3, '0'), '_2024', lpad(cast(1+video_id%12 as varchar), 2, '0'), '01_', cast(video_id%400 as varchar))) as base_name from video) where base_name not in (select lower(concat(split_part(file_name, '_', 2), '_', split_part(file_name, '_', 3), '_', substring(regexp_replace(split_part(file_name, '_', 4), '\\.[^.]*$', ''), 1, 3))) from image)")
def f_delete_used(v: Views) -> DataFrame:
    base = F.lower(F.concat(F.lit("r"), F.lpad(F.col("camera_id").cast("string"), 3, "0"), F.lit("_2024"), F.lpad((1 + F.col("video_id") % 12).cast("string"), 2, "0"), F.lit("01_"), (F.col("video_id") % 400).cast("string")))
    return v.video.select(base.alias("base_name")).distinct().transform(filters.without_used(v.image))


@query("select video_id from video where video_id not in (select video_id from video where frames > 1000)")
def f_unprocessed(v: Views) -> DataFrame:
    return v.video.select("video_id").transform(filters.not_videos(v.video.where("frames > 1000").select("video_id")))


@query("select vec_id, label from emb where partition = 'val'")
def emb_partition(v: Views) -> DataFrame:
    return v.emb.where("partition = 'val'").na.drop("any").select("vec_id", "label")


@query("select video_id, camera_id from video where camera_id in (select camera_id from video group by camera_id having count(*) > 60)")
def class_min(v: Views) -> DataFrame:
    return v.video.select("video_id", "camera_id").transform(filters.least_rows(61, "camera_id"))


@query("select camera_id, name from camera where name <> 'FRANCE'")
def f_neq(v: Views) -> DataFrame:
    return v.camera.where("name <> 'FRANCE'").select("camera_id", "name")


@query("select vec_id from (select *, count(*) over (partition by label) - count(*) over (partition by individual_video_id) as n from emb) where n >= 45")
def crossencounter_filter(v: Views) -> DataFrame:
    from canopy.operators.metrics import cross_video_rows

    return cross_video_rows(v.emb, 45).select("vec_id")


@query("select vec_id, not (count(*) over (partition by label) - count(*) over (partition by individual_video_id) > 45) as removed from emb")
def removed_mask(v: Views) -> DataFrame:
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy("label")) - F.count("*").over(Window.partitionBy("individual_video_id"))
    return v.emb.select("vec_id", (~(n > 45)).alias("removed"))


@query("""select tracking_frame_feature_id from (select *, row_number() over (partition by tracking_id order by frame_nr, tracking_frame_feature_id) - 1 as i, count(*) over (partition by tracking_id) as n from tff where tracking_id is not null)
 where n >= 4 and n // 3 > 0 and i % greatest(n // 3, 1) = 0 and i // greatest(n // 3, 1) < 3""")
def stride_sample(v: Views) -> DataFrame:
    return samplers.stride(v.tff.transform(filters.associated), 4, 3).select(ID)


@query("""select video_id, concat_ws(',', case when frames < 300 then 'short' end, case when start_time is null then 'untimed' end) as reasons from video where (frames < 300 or start_time is null) and camera_id <> 4""")
def rule_reasons(v: Views) -> DataFrame:
    why = F.array_compact(F.array(F.when(F.col("frames") < 300, "short"), F.when(F.col("start_time").isNull(), "untimed")))
    return v.video.withColumn("r", why).where((F.size("r") > 0) & (F.col("camera_id") != 4)).select("video_id", F.array_join("r", ",").alias("reasons"))


# --- joins ----------------------------------------------------------------------------------------------------


@query("select video_id, name, latitude from video join camera using (camera_id)")
def j_video_camera(v: Views) -> DataFrame:
    return v.video.join(v.camera, "camera_id").select("video_id", "name", "latitude")


@query("select tracking_id from tracking where video_id in (select video_id from video)")
def j_trackings(v: Views) -> DataFrame:
    return v.tracking.transform(filters.videos(v.video.select("video_id"))).select("tracking_id")


@query("select l.tracking_id as left_id, r.tracking_id as right_id from spans l join spans r on l.video_id = r.video_id and l.tracking_id < r.tracking_id and l.f0 <= r.f1 and r.f0 <= l.f1")
def j_overlap(v: Views) -> DataFrame:
    return mining.overlapping_trackings(v.tff)


@query("with f as (select video_id as id, row_number() over (order by video_id) - row_number() over (partition by value order by video_id) as smaller, count(*) over () - count(*) over (partition by value) as other from video_feature where value is not null) select cast(sum(smaller) as bigint) as n, cast(sum(id * (other - smaller)) as varchar) as sl, cast(sum(id * smaller) as varchar) as sr from f")
def j_social(v: Views) -> DataFrame:
    """The number of pairs and the sums of their ids, which pass 64 bits; from ranks, without making the pairs."""
    return mining.group_negative_sums(v.video_feature).select("n", F.col("sl").cast("string").alias("sl"), F.col("sr").cast("string").alias("sr"))


@query("with b as (select video_id, value, (row_number() over (order by video_id) - 1) // 200 as k from video_feature) select l.video_id as left_id, r.video_id as right_id from b l join b r on l.k = r.k and l.video_id < r.video_id and l.value <> r.value")
def j_social_batched(v: Views) -> DataFrame:
    return mining.group_negatives(v.video_feature, batch=200)


_TRIPS = """with c as (select * from camera where latitude is not null),
trips as (select a.camera_id as ca, b.camera_id as cb, 6371*acos(greatest(-1, least(1, sin(radians(a.latitude))*sin(radians(b.latitude)) + cos(radians(a.latitude))*cos(radians(b.latitude))*cos(radians(a.longitude)-radians(b.longitude))))) as km from c a join c b on a.camera_id <> b.camera_id)"""


@query(_TRIPS + " select l.video_id as left_id, r.video_id as right_id from video l join trips on ca = l.camera_id join video r on cb = r.camera_id and l.video_id < r.video_id and km/100 > abs(date_diff('microsecond', l.start_time, r.start_time))/3.6e9")
def j_travel(v: Views) -> DataFrame:
    return mining.travel_negatives(v.video, v.camera, 100.0)


@query(_TRIPS + " select ca, cb, round(km, 6) as km from trips")
def great_circle(v: Views) -> DataFrame:
    c = v.camera.where("latitude is not null")
    a, b = c.alias("a"), c.alias("b")
    km = geometry.great_circle_km(F.col("a.latitude"), F.col("a.longitude"), F.col("b.latitude"), F.col("b.longitude"))
    return a.join(b, F.col("a.camera_id") != F.col("b.camera_id")).select(F.col("a.camera_id").alias("ca"), F.col("b.camera_id").alias("cb"), F.round(km, 6).alias("km"))


@query("select video_id, round(abs(date_diff('microsecond', timestamp '1995-01-01', start_time))/3.6e9, 6) as hours from video")
def time_diff(v: Views) -> DataFrame:
    return v.video.select("video_id", F.round(geometry.hours_apart(F.lit("1995-01-01 00:00:00").cast("timestamp_ntz"), F.col("start_time")), 6).alias("hours"))


_SIDES = """greatest(0, least(l.bbox_x_center_n+l.bbox_width_n/2, r.bbox_x_center_n+r.bbox_width_n/2) - greatest(l.bbox_x_center_n-l.bbox_width_n/2, r.bbox_x_center_n-r.bbox_width_n/2))
 * greatest(0, least(l.bbox_y_center_n+l.bbox_height_n/2, r.bbox_y_center_n+r.bbox_height_n/2) - greatest(l.bbox_y_center_n-l.bbox_height_n/2, r.bbox_y_center_n-r.bbox_height_n/2))"""
_IOS = f"{_SIDES} / least(l.bbox_width_n*l.bbox_height_n, r.bbox_width_n*r.bbox_height_n)"
_PAIRS = f"with p as (select l.tracking_frame_feature_id as tracked_id, r.tracking_frame_feature_id as untracked_id, l.tracking_id, {_IOS} as ios from tff l join tff r on l.video_id = r.video_id and l.frame_nr = r.frame_nr where l.feature_type = 'body' and l.tracking_id is not null and r.feature_type = 'face_90')"


def _sides(v: Views) -> tuple[DataFrame, DataFrame]:
    return v.tff.where("feature_type = 'body' and tracking_id is not null"), v.tff.where("feature_type = 'face_90'")


@query(_PAIRS + " select tracked_id, untracked_id, round(ios, 6) as ios from p where ios > 0.3")
def j_ios(v: Views) -> DataFrame:
    return mining.box_pairs(*_sides(v), 0.3).withColumn("ios", F.round("ios", 6))


@query(_PAIRS + ", q as (select *, count(*) over (partition by tracked_id) as a, count(*) over (partition by untracked_id) as b from p where ios > 0.3) select tracked_id, untracked_id from q where a = 1 and b = 1")
def correlate_1to1(v: Views) -> DataFrame:
    return mining.one_to_one(mining.box_pairs(*_sides(v), 0.3)).select("tracked_id", "untracked_id")


@query(_PAIRS + ", q as (select *, count(*) over (partition by tracked_id) as a, count(*) over (partition by untracked_id) as b from p where ios > 0.3) select f.tracking_frame_feature_id, q.tracking_id from tff f left join q on q.untracked_id = f.tracking_frame_feature_id and a = 1 and b = 1 where feature_type = 'face_90'")
def correlate_update(v: Views) -> DataFrame:
    return mining.associate(*_sides(v), 0.3).select(ID, "tracking_id")


@query(f"select target_id, box_id, round(shared, 6) as shared from (select l.tracking_frame_feature_id as target_id, r.tracking_frame_feature_id as box_id, {_SIDES} as shared, row_number() over (partition by l.tracking_frame_feature_id order by {_SIDES} desc, r.tracking_frame_feature_id) as i from tff l join tff r on l.video_id = r.video_id and l.frame_nr = r.frame_nr where l.feature_type = 'face_90' and r.feature_type = 'body') where i = 1 and shared > 0")
def best_overlap(v: Views) -> DataFrame:
    return mining.best_overlap(v.tff.where("feature_type = 'face_90'"), v.tff.where("feature_type = 'body'")).withColumn("shared", F.round("shared", 6))


@query("select tracking_frame_feature_id, e.label from tff join emb e on e.vec_id = tracking_frame_feature_id")
def j_embedding(v: Views) -> DataFrame:
    return v.tff.join(v.emb.select(F.col("vec_id").alias(ID), "label"), ID).select(ID, "label")


@query("with i as (select upper(split_part(file_name, '_', 1)) as id, count(*) as images, count(distinct split_part(file_name, '_', 3)) as days from image group by 1), n as (select upper(split_part(file_name, '_', 1)) as id, count(distinct split_part(file_name, '_', 2)) as cameras from image group by 1) select * from i join n using (id)")
def j_images_videos(v: Views) -> DataFrame:
    own = v.image.select(names.individual(F.col("file_name")).alias("id"), names.part(F.col("file_name"), 2).alias("cam"), names.part(F.col("file_name"), 3).alias("day"))
    return own.groupBy("id").agg(F.count("*").alias("images"), F.count_distinct("day").alias("days")).join(own.groupBy("id").agg(F.count_distinct("cam").alias("cameras")), "id")


@query("with a as (select month(start_time) as m, count(*) as videos from video where start_time is not null group by 1), b as (select cast(substring(split_part(file_name, '_', 3), 5, 2) as int) as m, count(*) as images from image group by 1) select cast(coalesce(a.m, b.m) as int) as m, coalesce(videos, 0) as videos, coalesce(images, 0) as images from a full join b on a.m = b.m")
def j_full_outer(v: Views) -> DataFrame:
    a = v.video.where("start_time is not null").groupBy(F.month("start_time").alias("m")).agg(F.count("*").alias("videos"))
    b = v.image.groupBy(F.substring(names.part(F.col("file_name"), 3), 5, 2).cast("int").alias("m")).agg(F.count("*").alias("images"))
    return a.join(b, "m", "full_outer").na.fill(0, ["videos", "images"])


@query("""with neg as (select a.vec_id as id, b.vec_id as negative from emb a join emb b on b.vec_id in (a.vec_id + 1, a.vec_id + 7) and b.label <> a.label),
kept as (select vec_id as id from emb where partition = 'val'),
usable as (select distinct n.id from neg n join kept k on n.id = k.id join kept m on n.negative = m.id),
added as (select min(negative) as id from neg join kept using (id) where id not in (select id from usable) group by neg.id),
every as (select id from kept union select id from added)
select n.id, n.negative from neg n join every a on n.id = a.id join every b on n.negative = b.id""")
def curate_ssl(v: Views) -> DataFrame:
    from canopy.operators.vectors import with_negatives

    own = v.emb.select(F.col("vec_id").alias("id"), "label", F.explode(F.array(F.col("vec_id") + 1, F.col("vec_id") + 7)).alias("negative"))
    neg = own.join(v.emb.select(F.col("vec_id").alias("negative"), F.col("label").alias("l")), "negative").where("label <> l").select("id", "negative")
    return with_negatives(v.emb.where("partition = 'val'").select(F.col("vec_id").alias("id")), neg)[1]


# --- tasks ----------------------------------------------------------------------------------------------------


@query("select task_type, task_subtype, count(*) as total, count(*) filter (where status = 'completed') as completed from task group by 1, 2 union all select task_type, null, count(*), count(*) filter (where status = 'completed') from task group by 1")
def task_progress(v: Views) -> DataFrame:
    return tasks.progress(v.task)


@query("select min(updated_at) as first_update from task join video using (video_id) where version = '2024-04-18'")
def task_first_update(v: Views) -> DataFrame:
    return v.task.join(v.video.transform(filters.version("2024-04-18")).select("video_id"), "video_id").agg(F.min("updated_at").alias("first_update"))


@query("select distinct task_type, task_subtype from task")
def task_types(v: Views) -> DataFrame:
    return v.task.select("task_type", "task_subtype").distinct()


@query("select task_id from task where task_type = 'predict' and (status = 'pending' or (status = 'processing' and date_diff('microsecond', updated_at, timestamp '1998-01-01') > 3600000000 and retries < 2) or (status = 'failed' and retries < 2))")
def tasks_eligible(v: Views) -> DataFrame:
    return tasks.eligible(v.task, "predict", F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"), 1, 2).select("task_id")


@query("with r as (select distinct video_id as retried from task where task_type = 'predict' and retries > 0) select task_id, case when task_type = 'correlate' and retried is not null then 'pending' else status end as status from task left join r on video_id = retried")
def tasks_reset(v: Views) -> DataFrame:
    return tasks.reset_dependents(v.task, "predict", "correlate").select("task_id", "status")


_CLAIMED = "(select task_id as taken from task where task_type = 'predict' and task_subtype = 'body' and (status = 'pending' or (status = 'processing' and date_diff('microsecond', updated_at, timestamp '1998-01-01') > 86400000000 and retries < 2) or (status = 'failed' and retries < 2)) order by task_id limit 64)"
_NOW = "1998-01-01 00:00:00"


@query(f"select task_id, case when taken is not null then 'processing' else status end as status, case when taken is not null and status <> 'pending' then retries + 1 else retries end as retries, case when taken is not null then timestamp '1998-01-01' else cast(updated_at as timestamp) end as updated_at from task left join {_CLAIMED} on task_id = taken")
def tasks_claim(v: Views) -> DataFrame:
    return tasks.claim(_stamped(v), "predict", "body", F.lit(_NOW).cast("timestamp_ntz"), 64, retries=2).select("task_id", "status", "retries", "updated_at")


def _stamped(v: Views) -> DataFrame:
    return v.task.withColumn("updated_at", F.col("updated_at").cast("timestamp_ntz"))


@query("select task_id, case when status = 'processing' and task_id % 3 <> 0 then case when task_id % 5 = 0 then 'failed' else 'completed' end else status end as status from task")
def tasks_finish(v: Views) -> DataFrame:
    return tasks.finish(v.task, v.task.where("task_id % 3 <> 0").select("task_id", (F.col("task_id") % 5 != 0).alias("ok"))).select("task_id", "status")


@query("select tracking_frame_feature_id, cached and not (tracking_frame_feature_id >= 200 and tracking_frame_feature_id < 700) as cached from tff")
def reset_range(v: Views) -> DataFrame:
    return tasks.reset_cached(v.tff, 200, 700).select(ID, "cached")


@query("""select concat('{"at":', coalesce('"' || strftime(start_time + interval 30 day, '%Y-%m-%dT%H:%M:%S.000') || '"', 'null'), ',"path":"v/', video_id, '","reasons":[', concat_ws(',', case when frames < 300 then '"short"' end, case when start_time is null then '"untimed"' end), ']}') as target from video where frames < 300 or start_time is null""")
def deletion_plan(v: Views) -> DataFrame:
    why = F.array_compact(F.array(F.when(F.col("frames") < 300, "short"), F.when(F.col("start_time").isNull(), "untimed")))
    plan = tasks.deletion_plan(v.video, F.concat(F.lit("v/"), "video_id"), F.col("start_time"), why, 30)
    return plan.select(F.to_json(F.struct("at", "path", "reasons"), {"ignoreNullFields": "false"}).alias("target"))


# --- set operations ---------------------------------------------------------------------------------------------


@query("select distinct split_part(file_name, '_', 1) as subject from image where split = 'test'")
def subjects(v: Views) -> DataFrame:
    return v.image.where("split = 'test'").select(F.upper(F.split(F.lower("file_name"), r"[_\s-]", 2)[0]).alias("subject")).distinct()


@query("select distinct width as label from image where split = 'test' except select width from image where split <> 'test'")
def proprietary(v: Views) -> DataFrame:
    from canopy.operators.splits import proprietary as only

    return only(v.image.select(F.col("width").alias("label"), F.col("split").alias("partition")), "test")


@query("(select vec_id as id, 'left' as side from emb where vec_id >= 100 except select event_id, 'left' from events where event_id between 50 and 450) union all (select event_id, 'right' from events where event_id between 50 and 450 except select vec_id, 'right' from emb where vec_id >= 100)")
def set_equal(v: Views) -> DataFrame:
    a, b = v.emb.where("vec_id >= 100").select(F.col("vec_id").alias("id")), v.table("events").where("event_id between 50 and 450").select(F.col("event_id").alias("id"))
    return a.exceptAll(b).withColumn("side", F.lit("left")).union(b.exceptAll(a).withColumn("side", F.lit("right")))


@query("select concat(label, '__', vec_id) as name, partition from emb where vec_id % 2 = 0 union all select concat(label, '__', vec_id), partition from emb where vec_id % 2 = 1")
def merge_splits(v: Views) -> DataFrame:
    from canopy.operators.splits import merged

    one = v.emb.select(F.concat("label", F.lit("__"), "vec_id").alias("name"), "partition", "vec_id")
    return merged(one.where("vec_id % 2 = 0"), one.where("vec_id % 2 = 1"), "name")[0].select("name", "partition")


@query("select vec_id as id, 0 as dsid from emb union all select event_id, 1 from events")
def union_dsid(v: Views) -> DataFrame:
    return v.emb.select(F.col("vec_id").alias("id"), F.lit(0).alias("dsid")).unionAll(v.table("events").select("event_id", F.lit(1)))


@query("select name from camera except select name from camera where camera_id % 3 = 0")
def todo_minus_done(v: Views) -> DataFrame:
    return v.camera.select("name").subtract(v.camera.where("camera_id % 3 = 0").select("name"))


@query("select vec_id, label, 'train' as partition from emb where fold = 0 union all select vec_id, label, 'val' from emb where fold = 1")
def union_partition(v: Views) -> DataFrame:
    own = v.emb.select("vec_id", "label", "fold")
    return own.where("fold = 0").drop("fold").withColumn("partition", F.lit("train")).unionByName(own.where("fold = 1").drop("fold").withColumn("partition", F.lit("val")))


@query("select vec_id, cast(case label when 8 then 9 when 7 then 9 else label end as int) as label from emb")
def replace_map(v: Views) -> DataFrame:
    return v.emb.select("vec_id", "label").replace({8: 9, 7: 9}, subset=["label"])


# --- selection and data quality -------------------------------------------------------------------------------------

_SELECTED = """select * from (select *, count(*) over (partition by tracking_id) as n from tff where video_id between 0 and 99 and cached and tracking_id is not null and feature_type in ('body', 'face_90') and confidence >= 0.1 and bbox_width >= 200) where n >= 5"""


@query(f"select tracking_frame_feature_id, video_id, tracking_id, frame_nr, feature_type from (select *, row_number() over (partition by tracking_id order by frame_nr, tracking_frame_feature_id) - 1 as i from ({_SELECTED})) where n <= 3 or (i % ((n-1)//2) = 0 and i // ((n-1)//2) < 3)")
def tff_selection(v: Views) -> DataFrame:
    return Selection(feature_types=("body", "face_90"), min_confidence=0.1, min_width=200, min_count=5, sampler="equidistant", n=3).run(v.tff, list(range(100)))


@query("select tracking_frame_feature_id, frame_nr, squared from tff join (select true as squared union all select false) s on true where cached = false")
def crop_tasks(v: Views) -> DataFrame:
    return v.tff.where("not cached").select(ID, "frame_nr", F.explode(F.array(F.lit(False), F.lit(True))).alias("squared"))


@query("select f.frame_nr, count(t.tracking_frame_feature_id) as features from (select unnest(generate_series(0, 20, 2)) as frame_nr) f left join (select * from tff where video_id = 7) t on t.frame_nr = f.frame_nr group by all")
def frame_features(v: Views) -> DataFrame:
    frames = v.spark.range(0, 21, 2).select(F.col("id").alias("frame_nr"))
    return frames.join(v.tff.transform(filters.video(7)).select(F.col("frame_nr").cast("bigint").alias("frame_nr"), ID), "frame_nr", "left").groupBy("frame_nr").agg(F.count(ID).alias("features"))


@query("select camera_id, coalesce(latitude between -90 and 90, true) and coalesce(longitude between -60 and 60, true) as ok from camera")
def validate_camera(v: Views) -> DataFrame:
    return schema.judged(v.camera.withColumn("longitude", F.col("longitude") * 3), "camera").select("camera_id", (F.size("failed") == 0).alias("ok"))


@query("select count(*) as good from tff where bbox_x_center_n between 0 and 1 and bbox_width_n between 0 and 1 and confidence between 0 and 1")
def validate_tff(v: Views) -> DataFrame:
    return schema.split_valid(v.tff, "tracking_frame_feature")[0].agg(F.count("*").alias("good"))


@query("select video_id, fps > 28 as ok from video")
def validate_version(v: Views) -> DataFrame:
    odd = v.video.withColumn("version", F.when(F.col("fps") > 28, F.col("version")).otherwise("2024-13-01"))
    return schema.judged(odd, "video").select("video_id", (F.size("failed") == 0).alias("ok"))
