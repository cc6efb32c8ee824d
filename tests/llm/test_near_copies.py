"""Near copies against all pairs of shingle sets, with and without crowded shingles."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from canopy.llm import near_copies as near
from canopy.llm import simhash
from canopy.llm.near_copies import near_copies
from canopy.sources.scratch import Scratch

DATA = "/root/testdata/sf0.001"


def shingles(text, width=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def components(rows):
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if x == y or 9 * len(x & y) >= 4 * (len(x) + len(y)):
                up[top(i)] = top(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[top(i)] = min(k, least.get(top(i), k))
    return sorted((k, least[top(i)]) for i, (k, _) in enumerate(rows))


def planted():
    r = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    passage = " ".join(r.choice(words) for _ in range(60))
    rows = [(1, None), (2, " \t"), (3, "one two"), (4, "ONE  two"), (5, "one two three")]
    for base in range(12):
        text = [r.choice(words) for _ in range(r.choice([12, 60, 200]))]
        rows.append((100 + base * 20, " ".join(text)))
        for n in range(1, 10):  # from near to far
            changed = list(text)
            for _ in range(n * len(text) // 150 + n % 2):
                changed[r.randrange(len(text))] = "new"
            rows.append((100 + base * 20 + n, " ".join(changed)))
    rows += [(1000 + i, passage + " " + " ".join(r.choice(words) for _ in range(r.choice([8, 16, 40])))) for i in range(50)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("crowd,block", [(32, 512), (2, 512), (2, 3)])
def test_all_pairs(spark, monkeypatch, crowd, block):
    monkeypatch.setattr(near, "BLOCK", block)
    rows = planted()
    want = components(rows)
    assert len({c for _, c in want}) < len(rows) - 30
    got = near_copies(spark.createDataFrame(rows, "doc_id bigint, text string"), crowd=crowd)
    assert sorted(map(tuple, got.collect())) == want


def test_stage_drops_planted_copies(spark):
    r = random.Random(6)
    text = [f"w{r.randrange(5000)}" for _ in range(200)]
    far = text[:100] + ["new"] * 40 + text[140:]
    rows = [(1, " ".join(text)), (2, " ".join(text[:95] + ["other"] * 8 + text[103:])), (3, " ".join(far))]
    assert [k for k, _ in components(rows)] == [1, 2, 3] and components(rows)[1] == (2, 1)
    kept = pipeline.copies(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), DATA)
    assert sorted(x["doc_id"] for x in kept.collect()) == [1, 3]


def test_wide_sketches_keep_every_close_pair(spark):
    rng, rows = np.random.default_rng(3), []
    for n in (100, 512, 513, 900, 1024, 1030, 5000, 20000):
        for gone in (0.0, 0.05, 0.11, 0.15, 0.2, 0.5, 1.0):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            fresh = np.unique(rng.integers(0, 1 << 63, int(gone * n), dtype=np.uint64))
            b = np.unique(np.concatenate([a[len(fresh) :], fresh]))
            for x, y in ((a, b), (a, a[: max(1, int(len(a) * (1 - gone / 2)))])):
                both = len(np.intersect1d(x, y))
                if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)):
                    rows.append((both / (len(x) + len(y) - both), len(x), len(y), near.wide_sketch(x).tolist(), near.wide_sketch(y).tolist()))
    df = spark.createDataFrame(rows, "j double, na int, nb int, wa array<bigint>, wb array<bigint>")
    got = df.withColumn("ok", near._wide_close("wa", "wb", "na", "nb")).collect()
    assert all(r["ok"] for r in got if r["j"] >= 0.8)
    big = [r for r in got if r["j"] < 0.5 and r["wa"] and r["wb"]]
    assert big and not any(r["ok"] for r in big)


def test_halves_of_a_sketch_fold():
    found = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 3000, dtype=np.uint64))
    wide = near.sketch(found, 4096)
    assert (wide[:32] ^ wide[32:] == near.sketch(found, 2048)).all()


def test_wide_fingerprint_is_a_majority_of_mixed_bits():
    m, rng = (1 << 64) - 1, np.random.default_rng(8)

    def mixed(x, salt):
        x = (x ^ salt * 0x9E3779B97F4A7C15 & m) * 0xBF58476D1CE4E5B9 & m
        x = (x ^ x >> 31) * 0x94D049BB133111EB & m
        return x ^ x >> 32

    for n in (0, 1, 2, 255, 256, 700):
        found = rng.integers(0, 1 << 64, n, dtype=np.uint64)
        want = [2 * sum(mixed(int(x), w + 1) >> b & 1 for x in found) > n for w in range(8) for b in range(64)]
        got = simhash.wide_fingerprint(found)
        assert len(got) == 16 and np.unpackbits(got.view(np.uint8), bitorder="little").astype(bool).tolist() == want


@pytest.mark.parametrize("crowd", [32, 2])
def test_block_pairs_lose_none_that_pigeonhole_finds(spark, crowd):
    rng, prints = np.random.default_rng(9), []
    for _ in range(12):  # from each start, ever further away
        base = rng.integers(0, 2, 512)
        for n in (0, 3, 9, 15, 40, 100, 200):
            other = base.copy()
            other[rng.choice(512, n, replace=False)] ^= 1
            prints.append(other)
    rows = [(k, np.packbits(x.astype(np.uint8), bitorder="little").view(np.int32).tolist()) for k, x in enumerate(prints)]
    df = spark.createDataFrame(rows, "key bigint, print array<int>")
    got = {tuple(r) for r in simhash.block_pairs(df, Scratch(spark, "test"), 60, crowd)[0].collect()}
    apart = {(a, b): int((prints[a] != prints[b]).sum()) for b in range(len(prints)) for a in range(b)}
    assert got and all(apart[p] <= 60 for p in got)
    agree = {p for p in apart if any(x == y for x, y in zip(rows[p[0]][1], rows[p[1]][1]))}
    assert {p for p in apart if apart[p] < 16} <= agree
    if crowd == 32:  # no block is shared by more
        assert got == {p for p in agree if apart[p] <= 60}
    else:
        assert got <= agree


def test_simhash_links_close_copies_by_itself(spark, monkeypatch):
    r = random.Random(7)
    rows = []
    for k in range(20):
        text = [f"w{r.randrange(9000)}" for _ in range(400)]
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(text[:200] + ["new"] + text[201:]))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, near_copies(docs).collect())) == [(k, k - k % 2) for k in range(40)]
    none = lambda one, marks: one.select("key", "n", "centre", F.lit(0).alias("pos"), F.lit(0).cast("bigint").alias("s")).where("false")
    monkeypatch.setattr(near, "_posts", none)  # without the exact search for the rest
    got = [tuple(x) for x in near_copies(docs).collect()]
    assert sum(c < k for k, c in got) >= 15 and all(c == k - k % 2 or c == k for k, c in got)
