"""Colours, sinks, sources of tables, claims of tasks, and samplers and folds against brute force."""

import colorsys
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.functions import colors
from canopy.operators import metrics, nlets, samplers, splits, tasks, vectors
from canopy.sources import readers, sinks
from canopy.sources.scratch import Scratch


def jenkins(key):
    x = ((key >> 16) ^ key) * colors.MULTIPLIER
    x = ((x >> 16) ^ x) * colors.MULTIPLIER
    return (x >> 16) ^ (x & 0xFFFFFFFF)


def test_hash_and_colours_of_large_ids(spark):
    keys = [0, 1, 359, 65535, 65536, 123456789, 2**31, 2**35 + 12345, 2**36 - 1, *np.random.default_rng(1).integers(0, 2**36, 200).tolist()]
    rows = spark.createDataFrame([(k,) for k in [*keys, None]], "id bigint").select("id", colors.jenkins_hash(F.col("id")).alias("h"), colors.of_id(F.col("id")).alias("c")).collect()
    for r in rows:
        if r["id"] is None:
            assert tuple(r["c"]) == (0, 0, 255)
            continue
        h = jenkins(r["id"])
        assert int(r["h"]) == h
        rgb = colorsys.hsv_to_rgb(h % 360 / 360, max(0.7, h // 360 % 2), 0.9)
        assert tuple(r["c"]) == tuple(int(x * 255) for x in reversed(rgb))


def test_claims_hand_out_different_tasks(spark):
    task = spark.createDataFrame([(1, "predict", "body", "pending", 0), (2, "predict", "body", "failed", 0), (3, "predict", "body", "failed", 1), (4, "track", "", "pending", 0), (5, "predict", "body", "pending", 0)], "task_id int, task_type string, task_subtype string, status string, retries int").withColumn("updated_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    now = F.lit("2024-01-01 01:00:00").cast("timestamp_ntz")
    one = tasks.claim(task, "predict", "body", now, 2, retries=1)
    assert {(r["task_id"], r["retries"]) for r in one.where("status = 'processing'").collect()} == {(1, 0), (2, 1)}
    two = tasks.claim(one, "predict", "body", now, 2, retries=1)
    assert {r["task_id"] for r in two.where("status = 'processing'").collect()} == {1, 2, 5}
    done = tasks.finish(two, spark.createDataFrame([(1, True), (2, True), (2, False), (4, True)], "task_id int, ok boolean"))
    assert {r["task_id"]: r["status"] for r in done.collect()} == {1: "completed", 2: "failed", 3: "failed", 4: "pending", 5: "processing"}
    assert tasks.claim(task.limit(0), "predict", "body", now, 2).count() == 0


def test_sinks_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a.png", "train"), (2, "b.png", "val"), (3, None, "train")], "id int, name string, partition string")
    sinks.write_manifest(rows, f"{tmp_path}/m")
    back = spark.read.schema(rows.schema).parquet(f"{tmp_path}/m")
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in rows.collect()}
    assert back.where("partition = 'val'").count() == 1 and (tmp_path / "m" / "partition=train").is_dir()
    with pytest.raises(Exception, match="exists"):
        sinks.write_manifest(rows, f"{tmp_path}/m")
    sinks.write_json(rows, f"{tmp_path}/j")
    assert {json.dumps(json.loads(r["value"])) for r in spark.read.text(f"{tmp_path}/j").collect()} == {json.dumps(r.asDict()) for r in rows.collect()}


def test_tables_of_a_folder_and_of_a_database(spark, tmp_path):
    rows = spark.range(100).select("id", (F.col("id") * 2).alias("twice"))
    rows.write.parquet(f"{tmp_path}/t.parquet")
    assert readers.read_table(spark, str(tmp_path), "t").count() == 100
    uri = f"jdbc:derby:{tmp_path}/db;create=true"
    options = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    for name, some in (("t", rows), ("e", rows.limit(0))):
        some.write.format("jdbc").options(url=uri, dbtable=name, **options).save()
    whole = readers.read_table(spark, uri, "t", key="id", parts=4, **options)
    assert whole.rdd.getNumPartitions() == 4
    assert {tuple(r) for r in whole.collect()} == {(i, 2 * i) for i in range(100)}
    assert readers.read_table(spark, uri, "t", **options).count() == 100
    assert readers.read_table(spark, uri, "e", key="id", **options).count() == 0


def test_a_kept_table_is_made_once(spark, tmp_path):
    made = []

    def make(n):
        made.append(n)
        return spark.range(n)

    assert [readers.kept(spark, str(tmp_path), ("s", "m"), lambda: make(3)).count() for _ in range(2)] == [3, 3]
    assert readers.kept(spark, str(tmp_path), ("sm", ""), lambda: make(4)).count() == 4
    for f in tmp_path.glob("*/_SUCCESS"):
        f.unlink()
    assert readers.kept(spark, str(tmp_path), ("s", "m"), lambda: make(5)).count() == 5
    assert made == [3, 4, 5]


def test_losses_name_their_nlets():
    assert nlets.for_loss("softmax/arcface") is nlets.onelets and nlets.for_loss("online/hard/l2sp") is nlets.quadlets
    assert nlets.for_loss("offline") is nlets.triplets
    with pytest.raises(ValueError):
        nlets.for_loss("other")


def test_top5_counts_votes(spark):
    near = [(0, rank, n, 0.0) for rank, n in enumerate([10, 11, 12, 13, 14, 15, 16, 16], 1)]
    found = spark.createDataFrame(near[:7] + [(0, 8, 17, 0.0)], "id bigint, rank int, neighbour bigint, d double")
    labels = spark.createDataFrame([(0, 6), *((10 + i, i) for i in range(7)), (17, 6)], "id bigint, label int")
    ranked = {r["predicted"]: r["place"] for r in metrics.ranked_votes(found, labels).collect()}
    assert ranked == {6: 1, 0: 2, 1: 3, 2: 4, 3: 5, 4: 6, 5: 7}


def test_grid_is_knn_for_each_choice(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, i % 6, "val" if i % 4 else "train", str(i % 5), rng.normal(i % 6, 2, 4).tolist()) for i in range(80)], "id bigint, label int, partition string, individual_video_id string, v array<double>")
    for r in metrics.knn_grid(rows, Scratch(spark, "t"), ks=(1, 7)).collect():
        one = metrics.knn(rows, r["k"], r["average"], r["metric"]).first()
        assert tuple(r)[3:] == pytest.approx(tuple(one))


def test_mixup_and_loss(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (20, 3))
    rows = spark.createDataFrame([(i, i % 3, x[i].tolist()) for i in range(20)], "id bigint, label int, v array<double>")
    mixed = vectors.mixup(rows, 0.3, 8, 1).collect()
    assert sorted(r["id"] for r in mixed) == sorted(r["partner"] for r in mixed) == list(range(20))
    for r in mixed:
        assert r["id"] // 8 == r["partner"] // 8 and r["other"] == r["partner"] % 3
        assert np.allclose(r["v"], 0.3 * x[r["id"]] + 0.7 * x[r["partner"]])
    means = np.array([x[c::3].mean(axis=0) for c in range(3)])
    s = 64 * (x @ means.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(means, axis=1)
    want = np.mean([np.log(np.exp(s[i] - s[i].max()).sum()) + s[i].max() - s[i, i % 3] for i in range(20)])
    assert vectors.prototype_loss(rows).first()["loss"] == pytest.approx(want)


def test_custom_split_prefers_the_first(spark):
    rows = spark.range(10).withColumnRenamed("id", "video_id")
    c = F.col("video_id")
    out = {r[0]: r[1] for r in splits.custom(rows, c < 3, c < 5, c < 7).collect()}
    assert out == {0: "train", 1: "train", 2: "train", 3: "val", 4: "val", 5: "test", 6: "test"}


def test_frames_are_in_range(spark):
    out = samplers.random_frame(spark.createDataFrame([(1, 1), (2, 50), (3, 0), (4, 7)], "video_id bigint, frames int"), 3).collect()
    assert {r["video_id"] for r in out} == {1, 2, 4} and all(0 <= r["frame_nr"] < r["frames"] for r in out)


def test_farthest_against_brute_force(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (40, 5))
    rows = spark.createDataFrame([(i, i % 3, x[i].tolist()) for i in range(40)], "tracking_frame_feature_id bigint, tracking_id int, v array<double>")
    got = {r["tracking_frame_feature_id"] for r in samplers.farthest(rows, 4).collect()}
    want = set()
    for g in range(3):
        ids = list(range(g, 40, 3))
        taken = [ids[0]]
        while len(taken) < 4:
            far = {i: min(1 - x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) for j in taken) for i in ids if i not in taken}
            taken.append(max(sorted(far), key=lambda i: round(far[i], 12)))
        want |= set(taken)
    assert got == want


def test_movement_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, i % 4, int(i // 4), *rng.random(2).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "tracking_frame_feature_id bigint, tracking_id int, frame_nr int, bbox_x_center_n double, bbox_y_center_n double")
    got = {r["tracking_frame_feature_id"] for r in samplers.movement(df, 3, 0.2).collect()}
    want = set()
    for g in range(4):
        heads, members = [], []
        for i, _, _, x, y in [r for r in rows if r[1] == g]:
            for k, (hx, hy) in enumerate(heads):
                if abs(x - hx) <= 0.2 and abs(y - hy) <= 0.2:
                    members[k].append(i)
                    break
            else:
                heads.append((x, y))
                members.append([i])
        if len(heads) > 1:
            order = lambda i: (i * 2654435761 % 2**32, i)
            want |= set(sorted((min(m, key=order) for m in members), key=order)[:3])
    assert got == want
