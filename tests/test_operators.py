"""Hand-computed cases and edges of the operators that SQL checks cover less well."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from canopy.functions import geometry, names
from canopy.operators import filters, metrics, mining, nlets, samplers, splits, stats, vectors
from canopy.plans.selection import Selection
from canopy.sources import readers, schema


def vecs(spark, values, labels):
    return spark.createDataFrame([(i, [float(x)], lab, str(i % 3)) for i, (x, lab) in enumerate(zip(values, labels))], "id bigint, v array<double>, label int, individual_video_id string")


def test_soft_triplets_are_the_valid_ones(spark):
    rows = vecs(spark, [3.0, 0.5, 0.5, -0.5], [0, 0, 1, 1])
    found = vectors.triplets(rows, 1.0)
    assert found.count() == 8
    x = [3.0, 0.5, 0.5, -0.5]
    want = np.mean([max(0, abs(x[r["a"]] - x[r["p"]]) - abs(x[r["a"]] - x[r["n"]]) + 1) for r in found.collect()])
    assert vectors.triplet_loss(found, 1.0).first()["loss"] == pytest.approx(want)


def test_hard_triplets(spark):
    found = vectors.triplets(vecs(spark, [0.3, 1.0, 0.25, -0.5], [0, 0, 1, 1]), 1.0, "hard")
    assert {(r["a"], r["p"], r["n"]) for r in found.collect()} == {(0, 1, 2), (1, 0, 2), (2, 3, 0), (3, 2, 0)}


def test_semi_hard_triplets(spark):
    found = vectors.triplets(vecs(spark, [0.3, 1.0, 0.25, 0.5], [0, 0, 1, 1]), 1.0, "semi")
    assert {(r["a"], r["p"], r["n"]) for r in found.collect()} == {(1, 0, 2), (2, 3, 1), (3, 2, 1)}


def test_no_triplets_have_no_loss(spark):
    got = vectors.triplet_loss(vectors.triplets(vecs(spark, [1.0, 2.0], [0, 0]), 1.0), 1.0).first()
    assert (got["n"], got["loss"]) == (0, 0.0)


def test_nearest_excludes_self_and_breaks_ties_by_id(spark):
    rows = vecs(spark, [0.0, 1.0, -1.0, 5.0], [0, 0, 0, 0])
    got = vectors.nearest(rows, rows, 2).where("id = 0").orderBy("rank").collect()
    assert [r["neighbour"] for r in got] == [1, 2]


def test_nearest_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 7)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 3))
    rows = spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(x)], "id bigint, v array<double>")
    got = {(r["id"], r["rank"]): r["neighbour"] for r in vectors.nearest(rows, rows, 3).collect()}
    d = np.linalg.norm(x[:, None] - x[None], axis=2) + np.diag([np.inf] * 40)
    assert got == {(i, k + 1): int(j) for i in range(40) for k, j in enumerate(np.argsort(d[i], kind="stable")[:3])}


def test_perfect_classes_score_one(spark):
    rows = vecs(spark, [0, 0.1, 0.2, 9, 9.1, 9.2], [0, 0, 0, 1, 1, 1]).withColumn("partition", F.lit("val"))
    got = metrics.knn(rows, 1).first()
    assert tuple(got) == (1.0, 1.0, 1.0, 1.0)


def test_scores_of_unseen_classes(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "label int, predicted int")
    assert metrics.scores(rows, "micro").first()["accuracy"] == pytest.approx(2 / 3)
    assert metrics.scores(rows, "macro").first()["accuracy"] == pytest.approx(0.75)


def test_dedup_keeps_the_first(spark):
    rows = spark.createDataFrame([(i, [1.0, 0.001 * i]) for i in range(8)] + [(100, [0.0, 1.0])], "id bigint, v array<double>")
    got = {r["id"]: (r["root"], r["kept"]) for r in vectors.self_duplicates(rows, 0.08).collect()}
    assert all(got[i] == (0, i < 5) for i in range(8)) and got[100] == (100, True)


def tff(spark, rows):
    return spark.createDataFrame(rows, "tracking_frame_feature_id bigint, tracking_id bigint, frame_nr int, bbox_x_center_n double, bbox_y_center_n double")


def test_movement_needs_two_places(spark):
    still = [(i, 1, i, 0.5, 0.5) for i in range(5)]
    moving = [(10 + i, 2, i, 0.1 * i, 0.5) for i in range(5)]
    got = samplers.movement(tff(spark, still + moving), 2, 0.15).collect()
    assert len(got) == 2 and {r["tracking_id"] for r in got} == {2}
    with pytest.raises(ValueError):
        samplers.movement(tff(spark, still), 2, 1.5)


def test_equidistant_edges(spark):
    rows = tff(spark, [(i, 1, i, 0.5, 0.5) for i in range(10)] + [(20, 2, 0, 0.5, 0.5)])
    got = {r["tracking_frame_feature_id"] for r in samplers.equidistant(rows, 4).collect()}
    assert got == {0, 3, 6, 9, 20}
    assert {r["frame_nr"] for r in samplers.equidistant(rows, 1).collect()} == {0}


def test_farthest(spark):
    rows = spark.createDataFrame([(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.1]), (2, 1, [0.0, 1.0]), (3, 1, [-1.0, 0.0])], "tracking_frame_feature_id bigint, tracking_id bigint, v array<double>")
    assert {r["tracking_frame_feature_id"] for r in samplers.farthest(rows, 2).collect()} == {0, 3}


def test_with_rank_is_global(spark):
    rows = spark.createDataFrame([(i * 37 % 1000,) for i in range(1000)], "id bigint")
    got = mining.with_rank(rows, "id", width=64).collect()
    assert all(r["rank"] == r["id"] + 1 for r in got)


def test_unknown_group_pairs(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "video_id bigint, value string")
    assert {tuple(r) for r in mining.group_negatives(rows).collect()} == {(1, 2), (2, 3)}


def test_box_without_area_matches_nothing(spark):
    row = spark.createDataFrame([(0.5, 0.5, 0.0, 0.1)], "l_bbox_x_center_n double, l_bbox_y_center_n double, l_bbox_width_n double, l_bbox_height_n double")
    for c in row.columns:
        row = row.withColumn(c.replace("l_", "r_"), F.col(c))
    assert row.select(geometry.over_smallest("l_", "r_").alias("x")).first()["x"] is None


def test_same_place_is_no_distance(spark):
    p = F.lit(33.333333333)
    assert spark.range(1).select(geometry.great_circle_km(p, p, p, p).alias("x")).first()["x"] == pytest.approx(0, abs=1e-3)


def test_folds_are_balanced_and_whole(spark):
    rows = spark.createDataFrame([(i, f"x{i % 23}") for i in range(400)], "image_id bigint, label string")
    got = splits.balanced_folds(rows, 4).join(rows, "image_id").groupBy("label").agg(F.count_distinct("fold").alias("n")).where("n > 1")
    assert got.count() == 0


def test_quadlets_and_lone_classes(spark):
    rows = spark.createDataFrame([(i, i // 3, f"v{i % 2}") for i in range(10)], "id bigint, label bigint, individual_video_id string")
    own = {r["id"]: r["label"] for r in rows.collect()}
    got = nlets.quadlets(rows).collect()
    assert len(got) == 10
    for r in got:
        assert own[r["positive"]] == own[r["id"]] and own[r["anchor_negative"]] != own[r["id"]] and own[r["negative"]] == own[r["anchor_negative"]]
        assert (r["positive"] == r["id"]) == (own[r["id"]] == 3)


def test_selection_rejects_unknown_samplers():
    with pytest.raises(ValueError):
        Selection(sampler="best")


def test_exactly_one(spark):
    assert filters.exactly_one(spark.range(1)).count() == 1
    for n in (0, 2):
        with pytest.raises(LookupError):
            filters.exactly_one(spark.range(n))


def test_describe_matches_numpy(spark):
    x = [3, 1, 4, 1, 5, 9, 2, 6]
    got = stats.describe(spark.createDataFrame([(v,) for v in x], "n int"), "n").first()
    assert got["std"] == pytest.approx(np.std(x)) and got["p25"] == np.percentile(x, 25) and got["median"] == np.median(x)


def test_readers(spark, tmp_path):
    (tmp_path / "cams.csv").write_text("Name;Lat;Lon\nR001xx;1,5;-2,25\n")
    got = readers.read_camera_csv(spark, str(tmp_path / "cams.csv")).first()
    assert tuple(got) == ("R001", 1.5, -2.25)
    (tmp_path / "a.xml").write_text('<annotations><image name="i.png" width="9" height="9"><mask label="x" rle="1, 2" left="3" top="4" width="2" height="1"/></image><image name="none.png" width="9" height="9"/></annotations>')
    row = readers.read_xml_images(spark, str(tmp_path / "a.xml")).collect()
    assert [(r["name"], r["label"], r["left"], r["right"], r["rle"]) for r in row] == [("i.png", "x", 3, 5, [1, 2])]
    (tmp_path / "b.txt").write_text("0 0.5 0.5 0.1 0.1\n\n")
    assert readers.read_yolo(spark, str(tmp_path / "b.txt")).select("box").collect()[0]["box"] == [0.0, 0.5, 0.5, 0.1, 0.1]
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "v.mp4").write_bytes(b"x")
    (tmp_path / "sub" / ".h.mp4").write_bytes(b"x")
    assert readers.list_files(spark, str(tmp_path)).count() == 1


def test_quarantine(spark):
    rows = spark.createDataFrame([(1, "a", 10.0, None), (2, "b", 95.0, 1.0), (3, "c", None, 181.0)], "camera_id bigint, name string, latitude double, longitude double")
    good, bad = schema.split_valid(rows, "camera")
    assert [r["camera_id"] for r in good.collect()] == [1]
    assert {r["camera_id"]: r["failed"] for r in bad.collect()} == {2: ["latitude"], 3: ["longitude"]}
    assert len(schema.SCHEMAS) == 10 and all(schema.struct(t).fields for t in schema.SCHEMAS)


def test_names(spark):
    row = pd.DataFrame({"n": ["AP01_R012_20240502_123.png", "S5_R1_20241301_7b.png"]})
    got = spark.createDataFrame(row).select(names.group_of(names.individual(F.col("n"))).alias("g"), names.recorded(F.col("n")).alias("d"), names.clip(F.col("n")).alias("c"), names.source_video(F.col("n")).alias("v")).collect()
    assert [r["g"] for r in got] == ["AP", "SOLITARY"] and got[1]["d"] is None and [r["c"] for r in got] == [123, 7] and got[0]["v"] == "r012_20240502_123"


def test_plans_keep_their_shape(spark):
    from canopy.sources.views import Views

    v = Views(spark, "/root/testdata/sf0.001")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    social = plan(mining.group_negatives(v.video_feature))
    assert "CartesianProduct" not in social and "NestedLoop" not in social
    assert "WindowGroupLimit" in plan(samplers.random(v.tff.where("tracking_id is not null"), 3))
    assert "ReadSchema: struct<n_nationkey:int>" in plan(v.camera.select("camera_id"))


def test_travel_negatives_meet_once_and_compare_numbers(spark):
    rng = np.random.default_rng(4)
    camera = pd.DataFrame({"camera_id": range(6), "latitude": [0.0, 0.0, 40.0, -80.0, 0.0, None], "longitude": [0.0, 1.0, 100.0, -170.0, 0.0, 5.0]})
    start = pd.Timestamp("2024-03-01") + pd.to_timedelta(rng.integers(0, 400 * 3600, 80), unit="s")
    video = pd.DataFrame({"video_id": rng.permutation(80), "camera_id": rng.integers(0, 6, 80), "start_time": start.where(rng.random(80) > 0.1)})
    rows = spark.createDataFrame([(int(r.video_id), int(r.camera_id), None if pd.isna(r.start_time) else str(r.start_time)) for r in video.itertuples()], "video_id bigint, camera_id int, start_time string")
    rows = rows.withColumn("start_time", F.col("start_time").cast("timestamp_ntz"))
    cameras = spark.createDataFrame([(int(i), None if pd.isna(a) else a, b) for i, a, b in camera.itertuples(index=False)], "camera_id int, latitude double, longitude double")
    found = mining.travel_negatives(rows, cameras, 100.0)
    at = {i: (np.radians(a), np.radians(b)) for i, a, b in camera.dropna().itertuples(index=False)}
    want = []
    for x in video.dropna().itertuples():
        for y in video.dropna().itertuples():
            if x.video_id < y.video_id and x.camera_id != y.camera_id and {x.camera_id, y.camera_id} <= set(at):
                (a, b), (c, d) = at[x.camera_id], at[y.camera_id]
                km = 6371 * np.arccos(np.clip(np.sin(a) * np.sin(c) + np.cos(a) * np.cos(c) * np.cos(b - d), -1, 1))
                if km / 100 > abs((x.start_time - y.start_time).total_seconds()) / 3600:
                    want.append((x.video_id, y.video_id))
    assert len(want) > 100 and sorted(map(tuple, found.collect())) == sorted(want)
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x]
    assert any("a_camera_id" in x and "< b_camera_id" in x for x in joins)  # a pair of cameras stands there once
    assert not any("timestampdiff" in x.lower() for x in joins)  # no timestamps are subtracted for each pair


def dealt_rows(plan):
    """Rows that an executed plan deals over sequences of keys."""
    kind = plan.getClass().getSimpleName()
    inside = plan.executedPlan() if kind == "AdaptiveSparkPlanExec" else plan.plan() if kind.endswith("QueryStageExec") else None
    children = [inside] if inside is not None else [plan.children().apply(i) for i in range(plan.children().size())]
    own = plan.metrics().apply("numOutputRows").value() if kind == "GenerateExec" and "explode(sequence(" in plan.toString().splitlines()[0] else 0
    return own + sum(map(dealt_rows, children))


def test_travel_negatives_deal_videos_and_not_trips(spark, monkeypatch):
    rng = np.random.default_rng(5)
    places = [(0.0, 0.0), (0.0, 0.0), (10.0, 20.0), (-40.0, 100.0), (80.0, -170.0), (-5.0, -160.0), (5.0, 20.0)]
    hours = np.concatenate([rng.integers(0, 2400, 500), np.full(100, 1200), rng.integers(1190, 1210, 100)])
    cam = rng.integers(0, 7, 700)
    ids = rng.permutation(700)
    cameras = spark.createDataFrame([(i, *at) for i, at in enumerate(places)], "camera_id int, latitude double, longitude double")
    rows = spark.createDataFrame([(int(i), int(c), int(h)) for i, c, h in zip(ids, cam, hours)], "video_id bigint, camera_id int, h int")
    rows = rows.select("video_id", "camera_id", F.expr("timestamp_ntz'1999-12-01' + make_dt_interval(0, h)").alias("start_time"))
    lat, lon = np.radians(np.array(places)[cam]).T
    cos = np.sin(lat)[:, None] * np.sin(lat) + np.cos(lat)[:, None] * np.cos(lat) * np.cos(lon[:, None] - lon)
    travel = 6371 * np.arccos(np.clip(cos, -1, 1)) / 100
    met = (travel > np.abs(hours[:, None] - hours)) & (cam[:, None] != cam) & (ids[:, None] < ids)
    want = sorted((int(ids[i]), int(ids[j])) for i, j in zip(*np.nonzero(met)))
    for block in (256, 3):  # blocks that hold a camera's span, and many that do not
        monkeypatch.setattr(mining, "BLOCK", block, raising=False)
        found = mining.travel_negatives(rows, cameras, 100.0)
        assert sorted(map(tuple, found.collect())) == want and len(want) > 10_000
        assert 700 <= dealt_rows(found._jdf.queryExecution().executedPlan()) <= 2 * 700
