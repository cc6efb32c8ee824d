"""Queries that count pairs or components of all ids, against brute force."""

from canopy.plans import learning, relational  # noqa: F401
from canopy.plans.registry import QUERIES
from canopy.sources.views import Views

DATA = "/root/testdata/sf0.01"


def test_components_of_all_ids(spark):
    ids = [r[0] for r in Views(spark, DATA).tff.select("tracking_frame_feature_id").collect()]
    assert max(ids) > 3000
    up: dict[int, int] = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for x in ids:
        if x % 4:
            a, b = top(x), top(x + 1 + x % 3)
            up[max(a, b)] = min(a, b)
    want = {x: top(x) for x in list(up)}
    assert {tuple(r) for r in QUERIES["cc"](spark, DATA).collect()} == set(want.items())
    assert sorted(map(tuple, QUERIES["clique_merge"](spark, DATA).collect())) == sorted((x, want.get(x, x)) for x in set(ids))
    size: dict[int, int] = {}
    for r in want.values():
        size[r] = size.get(r, 0) + 1
    assert {tuple(r) for r in QUERIES["clique_rep"](spark, DATA).collect()} == {(r, r, n) for r, n in size.items()}


def test_social_pairs_of_all_ids(spark):
    rows = [(r[0], r[1]) for r in Views(spark, DATA).video_feature.select("video_id", "value").collect()]
    assert max(k for k, _ in rows) > 2000
    n = sl = sr = 0
    seen: list[int] = []
    seen_of: dict[str, list[int]] = {}
    totals: dict[str, int] = {}
    for k, g in sorted(rows):  # every smaller id of another group is a left side
        fewer = len(seen) - len(seen_of.get(g, []))
        n, sr, sl = n + fewer, sr + k * fewer, sl + totals.get("", 0) - totals.get(g, 0)
        seen.append(k)
        seen_of.setdefault(g, []).append(k)
        totals[""], totals[g] = totals.get("", 0) + k, totals.get(g, 0) + k
    assert tuple(QUERIES["j_social"](spark, DATA).first()) == (n, str(sl), str(sr))


def test_social_sums_are_those_of_the_pairs(spark):
    from canopy.operators import mining

    rows = spark.createDataFrame([(i * 37 % 101, "abc"[i % 3] if i % 7 else None) for i in range(60)], "video_id bigint, value string")
    pairs = mining.group_negatives(rows.where("value is not null")).collect()
    want = (len(pairs), sum(r[0] for r in pairs), sum(r[1] for r in pairs))
    assert tuple(mining.group_negative_sums(rows, width=10).first()) == want


def layers(spark):
    """Trackings 1 to 40 in four groups, every ninth without one; roots of several members; cuts inside and across groups."""
    own = [(100 * r + i, r) for r in range(1, 41) for i in range(1 + r % 3)]
    group = {r: "abcd"[r * 7 % 4] for r in range(1, 41) if r % 9}
    cuts = {(a, b) for x in range(1, 40) for y in (x + 1, x + 4) if y <= 40 and x % 3 == 0 for a, b in ((x, y), (y, x))}
    frames = spark.createDataFrame(own, "vertex bigint, root bigint"), spark.createDataFrame(sorted(cuts), "a bigint, b bigint"), spark.createDataFrame(list(group.items()), "root bigint, g string")
    apart = {(a, b) for a in range(1, 41) for b in range(1, 41) if (a, b) in cuts or (a in group and b in group and group[a] != group[b])}
    return own, frames, apart


def test_degrees_over_layers_are_those_of_the_pairs(spark):
    from canopy.operators import graph

    _, (own, cuts, groups), apart = layers(spark)
    heads = own.groupBy("root").agg({"vertex": "min"}).toDF("root", "vertex")
    at = {r["root"]: r["vertex"] for r in heads.collect()}
    named = spark.createDataFrame([(at[r["a"]], at[r["b"]]) for r in cuts.collect()], "a bigint, b bigint")
    got = {r["root"]: r["neighbours"] for r in graph.layered_degrees(own, named, groups).collect()}
    assert got == {x: n for x in range(1, 41) if (n := sum(a == x for a, _ in apart))}


def test_negatives_over_layers_lie_in_all_cliques_that_are_cut(spark):
    from canopy.operators import nlets

    rows, (own, cuts, groups), apart = layers(spark)
    root = dict(rows)
    seen = set()
    for seed in range(0, 40, 2):
        got = [tuple(r) for r in nlets.layered_negatives(own, cuts, groups, seed * 99991).collect()]
        assert sorted(i for i, _ in got) == sorted(v for v, r in rows if any(a == r for a, _ in apart))
        assert {(root[i], root[n]) for i, n in got} <= apart
        seen |= {(root[i], root[n]) for i, n in got}
    assert len(seen) > len(apart) / 2


def test_npy_rows(spark, tmp_path):
    import numpy as np

    from canopy.sources.readers import read_npy

    x = np.arange(70, dtype=np.float64).reshape(10, 7)
    np.save(tmp_path / "i.npy", np.arange(10, dtype=np.int32) * 3)
    np.save(tmp_path / "v.npy", x)
    got = read_npy(spark, str(tmp_path / "i.npy"), str(tmp_path / "v.npy"), rows=4).collect()
    assert sorted((r["id"], r["v"]) for r in got) == [(3 * k, x[k].tolist()) for k in range(10)]


def test_running_max_over_ranges(spark):
    from canopy.operators import stats

    values = [None if i % 9 == 4 else i * 37 % 53 for i in range(200)]
    got = stats.running_max(spark.createDataFrame(list(enumerate(values)), "i bigint, x bigint"), "i", "x", width=16).collect()
    most, want = None, {}
    for i, x in enumerate(values):
        most = x if most is None or (x is not None and x > most) else most
        want[i] = most
    assert {r["i"]: r["running"] for r in got} == want
