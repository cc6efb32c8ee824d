"""The training-data operators against brute force, on ordinary and odd rows."""

import base64
import collections
import hashlib
import math
import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from canopy.llm import byte_bpe, gif, langid, line_dedup, lm, packing, quality, simhash, topk, urls
from canopy.operators.graph import roots as roots_of
from canopy.sources.scratch import Scratch

WHITE = " \t\n\x0b\x0c\r"
RANKS, JSON, MODEL = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = ["the", "river", "walks", "under", "stone", "bridge", "and", "sings", "don't", "42", "quietly", "é", "中文", "of", "light"]
    return " ".join(r.choice(words) + r.choice(["", "", ",", ".\n", "  "]) for _ in range(n))


BASE = prose(1, 400)
LONG = prose(2, 30_000)
ODD = [
    (1, None, "en"), (2, "", "en"), (3, " \t\n ", None), (4, "One", "en"), (5, "one two", "en"), (6, "One two", "fr"),
    (7, BASE, "en"), (8, BASE, "en"), (9, BASE.replace("river", "RIVER"), "en"), (10, BASE + " more", "en"), (11, LONG, "de"),
    (12, "A shared line of text\nmine alone it is\n\na shared LINE of text \n short", "en"), (13, "x\na shared line of text", "en"),
    (14, "12 34 !? \x85\x1c\u00a0  ", "en"), (15, "\n\n\n", "en"), (16, "abcdefghij" * 3000, "en"), (17, "'s 'll I've we're x''s '", "en"),
    (18, prose(3, 90), "de"), (18, prose(3, 90), "de"), (None, "no id at all, this one", "en"), (None, prose(4, 50), None),
    (19, "ab <|endoftext|> cd<|endoftext|><|endoftext|>", "en"), (20, "<|endoftext|>", None), (21, "<|endoftext <|endoftext|>|>\n", "fr"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, g, "src", 1, "clash", 2.0, "x") for i, t, g in ODD]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, fingerprint string, rank double, id string").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def key(row):
    return (row["doc_id"] is None, row["doc_id"] or 0)


# --- 1 -------------------------------------------------------------------------------------------------------------


def plain_fingerprint(text: str | None) -> int:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in WHITE else c for c in low).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints: list[int], ids: list, distance: int = 2) -> list:
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


def test_simhash(docs, none):
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["fingerprint"], r["component_id"] or -1) for r in simhash.near_duplicates(docs).collect()))
    prints = [plain_fingerprint(t) for _, t, _ in ODD]
    comp = plain_components(prints, [i for i, _, _ in ODD])
    want = sorted((i is None, i or 0, f"{p:016x}", c or -1) for (i, _, _), p, c in zip(ODD, prints, comp))
    assert got == want
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("crowd,distance", [(2, 2), (32, 2), (2, 1), (32, 1)])
def test_links_have_the_components_of_all_close_pairs(spark, crowd, distance):
    r = random.Random(crowd)
    prints = []
    for _ in range(6):  # balls around centres, some crowded
        centre = r.getrandbits(64)
        for _ in range(60):
            x = centre
            for _ in range(r.randint(0, 5)):
                x ^= 1 << r.randrange(64)
            prints.append(x)
    prints = sorted(set(prints))
    signed = [simhash._signed(x) for x in prints]
    scratch = Scratch(spark, "t")
    edges, _ = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp bigint"), scratch, distance, crowd=crowd)
    root = {x["vertex"]: x["root"] for x in roots_of(edges, scratch).collect()}
    got = collections.defaultdict(set)
    for x in signed:
        got[root.get(x, x)].add(x)
    comp = plain_components(prints, list(range(len(prints))), distance)
    want = collections.defaultdict(set)
    for x, c in zip(signed, comp):
        want[c].add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


# --- 2 -------------------------------------------------------------------------------------------------------------


def test_gif_payloads(docs, none):
    got = gif.media_features(gif.text_media(docs)).collect()
    assert len(got) == len(ODD)
    payloads = {}
    for i, t, _ in ODD:
        b = (t or "").encode()
        payloads.setdefault(i, set()).add((len(b), b + b" " * (max(192, -(-len(b) // 192) * 192) - len(b))))
    for r in got:
        assert any((n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])) == (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for n, p in payloads[r["doc_id"]])
    assert gif.text_media(none).count() == 0


def plain_lzw(data: bytes, size: int) -> bytes:
    """The decoder of the textbook, bit by bit."""
    bits = int.from_bytes(data, "little")
    left, clear, out, at, prev = 8 * len(data), 1 << size, b"", 0, None
    table, width = [bytes([i]) for i in range(clear)] + [b"", b""], size + 1
    while at + width <= left:
        code = bits >> at & ((1 << width) - 1)
        at += width
        if code == clear:
            table, width, prev = table[: clear + 2], size + 1, None
            continue
        if code == clear + 1:
            break
        entry = table[code] if code < len(table) else prev + prev[:1]
        out += entry
        if prev is not None and len(table) < 4096:
            table.append(prev + entry[:1])
        width = max(width, min(12, len(table).bit_length()))
        prev = entry
    return out


@pytest.mark.parametrize("n", [0, 1, 2, 255, 3071, 3072, 3073, 9999])
def test_lzw_both_ways(n):
    r = random.Random(n)
    for data in (bytes(r.choice(b"ab") for _ in range(n)), r.randbytes(n), b"q" * n):
        coded = gif.lzw_encode(data)
        assert plain_lzw(coded, 8) == data
        assert gif.lzw_decode(coded, 8, n) == data


def greedy_stream(data: bytes, size: int) -> bytes:
    """An encoder that never clears, even after its table is full."""
    clear = 1 << size
    table = {bytes([i]): i for i in range(clear)}
    bits, at, width, nxt, cur = clear, size + 1, size + 1, clear + 2, b""

    def put(code):
        nonlocal bits, at
        bits |= code << at
        at += width

    for i in range(len(data)):
        if cur + data[i : i + 1] in table:
            cur += data[i : i + 1]
            continue
        put(table[cur])
        if nxt < 4096:
            table[cur + data[i : i + 1]] = nxt
            nxt += 1
            width = max(width, min(12, (nxt - 1).bit_length()))
        cur = data[i : i + 1]
    put(table[cur])
    if nxt < 4096:
        nxt += 1
        width = max(width, min(12, (nxt - 1).bit_length()))
    put(clear + 1)
    return bits.to_bytes(-(-at // 8), "little")


@pytest.mark.parametrize("size,n", [(2, 500), (4, 5000), (8, 40_000)])
def test_lzw_streams_of_others(size, n):
    r = random.Random(n)
    data = bytes(r.randrange(1 << size) for _ in range(n))
    coded = greedy_stream(data, size)
    assert plain_lzw(coded, size) == data
    assert gif.lzw_decode(coded, size, n) == data


def hand_made(frames, interlace=0):
    """A 2 x 2 GIF; frames: (disposal, transparent or -1, left, top, w, h, indexes)."""
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    out = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x81, 0, 0) + palette
    for disposal, through, left, top, w, h, px in frames:
        out += b"\x21\xf9\x04" + struct.pack("<BHBB", disposal << 2 | (through >= 0), 7, max(through, 0), 0)
        stream = greedy_stream(bytes(px), 2)
        out += b"\x2c" + struct.pack("<HHHHB", left, top, w, h, interlace) + b"\x02" + bytes([len(stream)]) + stream + b"\0"
    return out + b"\x3b"


def colours(frame):
    return ["." if not a else "krgb"[(0, 255, 510, 765).index(int(r) + 2 * int(g) + 3 * int(b))] for r, g, b, a in frame.canvas.reshape(-1, 4)]


def test_disposal_and_transparency():
    shown = [colours(f) for f in gif.decode(hand_made([(1, -1, 0, 0, 2, 2, [1, 1, 2, 2]), (2, 0, 0, 0, 2, 1, [0, 3]), (3, -1, 1, 1, 1, 1, [0]), (0, -1, 0, 0, 1, 1, [3])]))]
    assert shown == [list("rrgg"), list("rbgg"), list("..gk"), list("b.gg")]


def test_interlaced_rows_and_local_order():
    frame = next(gif.decode(hand_made([(0, -1, 0, 0, 1, 2, [1, 2])], interlace=0x40)))
    assert colours(frame) == ["r", ".", "g", "."] and frame.delay_ms == 70


def test_frames_table(spark):
    rows = spark.createDataFrame([(1, hand_made([(1, -1, 0, 0, 2, 2, [1, 1, 2, 2])] * 2)), (2, b"GIF89a"), (3, None)], "k bigint, media binary")
    got = gif.decode_frames(rows, "k", "media").orderBy("k", "frame").collect()
    assert [(r["k"], r["frame"], r["start_ms"], r["error"] is None) for r in got] == [(1, 0, 0, True), (1, 1, 70, True), (2, None, None, False), (3, None, None, False)]
    assert sum(got[0]["histogram"]) == 4


# --- 3 -------------------------------------------------------------------------------------------------------------


def plain_key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def plain_lines(rows):
    hold = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(plain_key(line)) >= 10:
                hold[plain_key(line)].add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        first = {k: min(x for x in v if x is not None) if any(x is not None for x in v) else None for k, v in hold.items()}
        kept = [x for x in lines if len(plain_key(x)) < 10 or first[plain_key(x)] is None or first[plain_key(x)] == i]
        out[i, t] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_line_dedup(docs, none):
    want = plain_lines([(i, t) for i, t, _ in ODD])
    got = line_dedup.dedup_lines(docs).collect()
    assert len(got) == len(ODD)
    held = collections.defaultdict(list)
    for (i, _), v in want.items():
        held[i].append(v)
    for r in got:
        assert (r["n_lines"], r["n_dropped"], r["text"]) in held[r["doc_id"]]
    assert line_dedup.dedup_lines(none, digest=True).count() == 0


def test_line_index_is_reversible(spark, monkeypatch):
    r = random.Random(5)
    pool = [f"a line that may be shared {k}" for k in range(40)]
    rows = [(i, "\n".join(r.choice(pool) for _ in range(6))) for i in range(30)]
    frame = lambda x: spark.createDataFrame(x, "doc_id bigint, text string")
    index = line_dedup.LineIndex(spark, shards=4).insert(frame(rows[:20])).insert(frame(rows[20:]))
    see = lambda ix, x, **k: {q["doc_id"]: (q["n_lines"], q["n_dropped"], q["text"]) for q in ix.apply(frame(x), **k).collect()}
    plain = lambda x: {i: v for (i, _), v in plain_lines(x).items()}
    assert see(index, rows) == plain(rows)
    gone = [i for i, _ in rows if i % 3 == 0]
    fewer = index.delete(spark.createDataFrame([(i,) for i in gone], "doc_id bigint"))
    rest = [x for x in rows if x[0] % 3]
    assert see(fewer, rest) == plain(rest)
    again = fewer.insert(frame([x for x in rows if x[0] % 3 == 0]))
    assert see(again, rows) == plain(rows)
    exact = again.postings.join(again.counts.where(line_dedup.SHARED).select("h1", "h2", "low"), ["h1", "h2"]).where("id > low")
    assert {tuple(x) for x in again.losses().collect()} == {tuple(x) for x in exact.select("id", "t", "h1", "h2").collect()}  # without the filters


def test_line_index_grows_and_splits_a_hot_shard(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 8)
    rows = [(i, f"one line that all of them hold\nanother line of {i // 2} alone\nthis is line {i} alone") for i in range(120)]
    rows += [(None, "one line that all of them hold\nthis line is without an id"), (None, "one line that all of them hold\nthis line is without an id")]
    frame = lambda x: spark.createDataFrame(x, "doc_id bigint, text string")
    index = line_dedup.LineIndex(spark, shards=2).insert(frame(rows[:20]))
    first, index = index.shards, index.insert(frame(rows[20:]))
    assert index.shards > first > 2
    refs = {(q["h1"], q["h2"]): q["refs"] for q in index.counts.collect()}
    assert max(refs.values()) == 122 > 2 * sum(refs.values()) / index.shards
    got = sorted((q["doc_id"] is None, q["doc_id"] or 0, q["n_lines"], q["n_dropped"], q["text"]) for q in index.apply(frame(rows)).collect())
    want = plain_lines(rows)
    assert got == sorted((i is None, i or 0, *want[i, t]) for i, t in rows)


def test_cuckoo_filter():
    keys = np.random.default_rng(3).integers(-(2**62), 2**62, 20_000)
    f = line_dedup.CuckooFilter.build(keys)
    assert f.has(keys).all() and f.has(keys + 1).mean() < 0.01
    f.remove(keys[:5000])
    assert f.has(keys[5000:]).all() and f.has(keys[:5000]).mean() < 0.01
    assert line_dedup.CuckooFilter.read(f.blob()).has(keys[5000:]).all()
    assert len(line_dedup.CuckooFilter.build(keys[:0]).blob()) > 0


# --- 4 -------------------------------------------------------------------------------------------------------------


def test_forward_sums_all_segmentations():
    pieces = langid.Pieces(["a", "b", "ab", "ba", "aba"])
    prob = np.array([[0.1, 0.2], [0.2, 0.1], [0.3, 0.3], [0.15, 0.2], [0.25, 0.1], [1e-7, 1e-7]])

    def total(word, k):
        if not word:
            return 1.0
        out = 0.0
        for n in range(1, len(word) + 1):
            p = pieces.pieces.index(word[:n]) if word[:n] in pieces.pieces else (-1 if n == 1 else None)
            if p is not None:
                out += prob[p, k] * total(word[n:], k)
        return out

    words = ["a", "ab", "abab", "babaab", "axb", "", "ab" * 30, "ba" * 15 + "x" * 5, "aba" * 11, "abx" * 11, "x" * 33, "abbaab" * 1000]
    got = pieces.forward(words, prob)

    def logs(word, k):  # from the front, in logarithms
        at = [0.0] + [-math.inf] * len(word)
        for i in range(len(word)):
            for n in range(1, min(3, len(word) - i) + 1):
                p = pieces.pieces.index(word[i : i + n]) if word[i : i + n] in pieces.pieces else (-1 if n == 1 else None)
                if p is not None:
                    at[i + n] = np.logaddexp(at[i + n], at[i] + math.log(prob[p, k]))
        return at[-1]

    for w, row in zip(words, got):
        assert row == pytest.approx([logs(w, k) for k in range(2)], rel=1e-9)
        if len(w) <= 12:
            assert row == pytest.approx([math.log(total(w, k)) for k in range(2)])
    assert got[6] == pytest.approx([-22.389, -28.364], abs=1e-3)
    for word in ("abxb", "ab" * 30):  # expected uses are the slopes of the logarithm of the sum
        slopes = []
        for i in range(6):
            more = prob[:, :1].copy()
            more[i] *= math.exp(1e-6)
            slopes.append((pieces.forward([word], more)[0, 0] - pieces.forward([word], prob[:, :1])[0, 0]) / 1e-6)
        assert pieces.expected([word], np.array([[1.0, 0.0]]), prob[:, 0])[:, 0] == pytest.approx(slopes, abs=1e-4)
    uses = pieces.expected(["ab"], np.array([[2.0, 0.0]]), prob[:, 0])
    whole = 0.3 + 0.1 * 0.2
    assert uses[2, 0] == pytest.approx(2 * 0.3 / whole) and uses[0, 0] == pytest.approx(2 * 0.02 / whole) and not uses[:, 1].any()


def test_language(spark, docs, none):
    got = {r["doc_id"]: r for r in langid.predict(docs, MODEL).collect() if r["doc_id"] != 18}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1, 2, 3, 14, 15))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert got[4]["held_out"] == (zlib.crc32(b"4") % 4 == 2)
    assert langid.predict(none, MODEL).count() == 0
    unlabelled = langid.predict(docs.withColumn("lang", F.lit(None).cast("string")), MODEL)
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}


def test_language_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predict(d, MODEL).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.97


# --- 5 -------------------------------------------------------------------------------------------------------------


def plain_top(rows, k, scale=1024):
    good = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, [math.floor(scale * x) for x in v]))
    out = set()
    for i, q in set((i, tuple(v)) for i, v in good if i % 10 == 0):
        found = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i)[:k]
        out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(found)}
    return out


@pytest.mark.parametrize("spread", [0.02, 1.0])
def test_top_k(spark, monkeypatch, spread):
    monkeypatch.setattr(topk, "ANNULUS", 16)
    r = random.Random(4)
    rows = []
    for i in range(300):
        c = i % 6
        rows.append((i, [float(x == c) + r.gauss(0, spread) for x in range(6)]))
    rows += [(1000 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0]) for i in range(40)]  # many equal vectors
    rows += [(2000, None), (2001, []), (2002, [0.5, -3.0]), (2010, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2020, [float("nan")] * 6), (2030, [float("inf")] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<double>, score int")
    got = {tuple(x) for x in topk.top_k(df, F.col("id") % 10 == 0, 10).collect()}
    assert got == plain_top(rows, 10)
    few = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [0.5, 0.5])]
    small = spark.createDataFrame(few, "vec_id bigint, embedding array<double>")
    assert {tuple(x) for x in topk.top_k(small, F.col("id") % 10 == 0, 10).collect()} == plain_top(few, 10)
    assert topk.top_k(small.where("false"), F.col("id") % 10 == 0).count() == 0


def test_top_k_of_huge_components(spark):
    big = [1e9, 3e38, -3e38, 1e15, 7.0, -2e12, 0.5]
    rows = [(i, [big[i % 7], big[(3 * i) % 7], float(i)]) for i in range(60)]
    most = (1 << 63) - 1
    clip = lambda x: max(-most - 1, min(most, x))
    whole = {i: [clip(math.floor(1024 * x)) for x in v] for i, v in rows}
    want = set()
    for i in range(0, 60, 10):
        found = sorted((-clip(sum(a * b for a, b in zip(whole[i], v))), j) for j, v in whole.items() if j != i)[:10]
        want |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(found)}
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert {tuple(x) for x in topk.top_k(df, F.col("id") % 10 == 0, 10).collect()} == want


def test_annuli_of_several_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "ANNULUS", 64)
    monkeypatch.setattr(topk, "CHUNK", 10)
    monkeypatch.setattr(topk, "BOUNDS", 16)
    r = random.Random(9)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert {tuple(x) for x in topk.top_k(df, F.col("id") % 10 == 0, 10).collect()} == plain_top(rows, 10)


def test_scores_are_exact_where_floats_are_not():
    a, b = np.array([[2**31 + 1, 3]]), np.array([[2**30 + 1, 5]])
    assert topk.scores(a, b)[0, 0] == (2**31 + 1) * (2**30 + 1) + 15


# --- 6 -------------------------------------------------------------------------------------------------------------

URLS = [
    "http://a.NET/x", "https://net/", "http://example.net/en/1", "http://www.Example.net/en", "http://notexample.net/en/1", "https://sub.example.com/de/x?y=1", "https://example.com/dex",
    "https://w.org/fr/", "https://w.org?/fr/", "no scheme", "", None, "://net/", "x://", "http://a.net", "http://a.net?q#/", "http://u#/net/", "http://a\nb.net/\n?x", "http://x.com/" + "a" * 50_000,
]


def plain_parts(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    n = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    tail = rest[n:]
    m = min([tail.find(c) for c in "?#" if c in tail] + [len(tail)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n]), tail[:m]


def plain_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_urls(spark):
    rows = [(i, u, "h", "r") for i, u in enumerate(URLS * 2)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, host string, rule string")
    got = {r["page_id"]: r for r in urls.judge(df).collect()}
    for i, u, _, _ in rows:
        host, path = plain_parts(u)
        rule, verdict = plain_rule(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == verdict if rule else got[i]["verdict"] in ("allow", "block")
    assert urls.judge(df.where("false")).count() == 0
    assert urls.judge(df.where("url = 'no scheme'")).first()["verdict"] in ("allow", "block")


def test_verdicts_are_the_trees_where_no_rule_fits(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    host, path = urls.parts("url")
    given = df.select(F.coalesce("url", F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    given = urls.with_suffixes(given.withColumn("ruled", urls.ruled(F.col("host"), F.col("path"))))
    model = urls.train(given)

    def plain(row):
        x, z = urls.features(*(row[c] for c in ("url", "host", "path", "rate", "count"))), model.base
        for tree in model.trees:
            at = 0
            while tree[at][0] >= 0:
                feature, edge, _ = tree[at]
                at = 2 * at + 1 + int(sum(x[feature] > e for e in model.edges[feature]) > edge)
            z += model.rate * tree[at][2]
        return "block" if z > 0 else "allow"

    want = collections.Counter((r["url"], (r["ruled"] or {"verdict": plain(r)})["verdict"]) for r in given.collect())
    assert want == collections.Counter((r["url"], r["verdict"]) for r in urls.judge(df).join(df.select("page_id", F.coalesce("url", F.lit("")).alias("url")), "page_id").collect())


def test_trees_on_urls_held_out(spark):
    """The only labels are the rules' verdicts, which hang on paths that lexical features see in part."""
    df = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("url").distinct()
    host, path = urls.parts("url")
    given = df.select("url", host.alias("host"), path.alias("path")).withColumn("all", urls.ruled(F.col("host"), F.col("path")))
    part = F.crc32(F.col("url").cast("binary")) % 4 == 2
    given = urls.with_suffixes(given.withColumn("ruled", F.when(~part, F.col("all"))))
    trees, rest = urls.train(given), given.where(part & F.col("all").isNotNull()).collect()
    x = np.array([urls.features(*(r[c] for c in ("url", "host", "path", "rate", "count"))) for r in rest])
    y = np.array([r["all"]["verdict"] == "block" for r in rest])
    right = np.mean((trees.probability(x) > 0.5) == y)
    assert len(rest) > 200 and right > 0.7 and right > max(y.mean(), 1 - y.mean()) + 0.1  # 0.79 against 0.58


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.3)).astype(float)
    t = urls.Trees().fit(x[:1000], y[:1000])
    assert np.mean((t.probability(x[1000:]) > 0.5) == y[1000:]) > 0.93


# --- 7 -------------------------------------------------------------------------------------------------------------


def plain_tokens(t):
    return [*(t or "").encode().lower().split(), b""]


@pytest.mark.parametrize("frequent", [5, 300_000])
def test_language_model(spark, docs, none, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    monkeypatch.setattr(lm, "KNOWN", 4)
    counts = collections.Counter()
    for i, t, _ in ODD:
        if i is not None and zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(plain_tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((len(plain_tokens(t)), sum(counts[w] > 0 for w in plain_tokens(t)), round(sum(math.log10((counts[w] + 1) / (n + 1 * (v + 1))) for w in plain_tokens(t)), 6)) for _, t, _ in ODD)
    rows = lm.predict(docs).collect()
    got = sorted((r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in rows)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=2e-6)
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in rows)
    assert lm.predict(none).count() == 0


def test_scores_are_the_softmax_over_all_words(spark, docs, monkeypatch):
    """Each token's probability from the parameters, summed over every word that the model knows, one by one."""
    monkeypatch.setattr(lm, "KNOWN", 12)
    scratch = Scratch(spark, "t")
    model, counts = lm.train(docs, F.expr("id > 6"), scratch)
    seen = {bytes(r["word"]): r["n"] for r in counts.collect()}
    index, net, size = {w: i for i, w in enumerate(model.words.split(b"\n")) if i < model.known}, model.net, model.net.size
    assert size == 13 and sum(seen.values()) == model.total and len(seen) == model.distinct

    def plain(text):
        ids = [index[b""], index[b""], *(index.get(w, size - 1) for w in plain_tokens(text))]
        out = 0.0
        for word, v, u, w in zip(plain_tokens(text), ids, ids[1:], ids[2:]):
            r = net.target[u].astype(float) @ net.near + net.target[v].astype(float) @ net.far
            given = np.exp(net.target.astype(float) @ r + net.bias)
            out += math.log10(given[w] / given.sum()) + (math.log10((seen.get(word, 0) + 1) / model.rest) if w == size - 1 else 0)
        return out

    assert model.rest == 1 + sum(n + 1 for w, n in seen.items() if w not in index)
    got = sorted((r["n_tokens"], r["score"]) for r in lm.score(docs, model, counts, scratch).collect())
    want = sorted((len(plain_tokens(t)), plain(t)) for _, t, _ in ODD)
    assert [g[1] for g in got] == pytest.approx([w[1] for w in want], rel=1e-4, abs=1e-4)


def test_every_training_token_takes_part(spark):
    """What only one late row of many holds moves the parameters."""
    rows = [(i, "a b c d e f g h " * 20) for i in range(60)]
    odd = [*rows[:-1], (59, "h g f e d c b a " * 20)]
    nets = [lm.train(spark.createDataFrame(x, "doc_id bigint, text string").coalesce(1), F.lit(True), Scratch(spark, "t"))[0].net for x in (rows, odd)]
    one = [n.tables()[0] for n in nets]
    assert not np.allclose(nets[0].flat(), nets[1].flat()) and one[0].shape == one[1].shape


def test_model_is_normalised_and_learns():
    rng = np.random.default_rng(1)
    seq = np.cumsum(rng.integers(1, 3, 6000)) % 7  # the next word is one or two further
    triples = np.stack([seq[:-2], seq[1:-1], seq[2:]], axis=1)
    net = lm.LogBilinear(8)
    triples, times = np.unique(triples, axis=0, return_counts=True)
    for _ in range(300):
        net.train(triples, times, np.bincount(seq, minlength=8) + 0.5)
    one, two, z = net.tables()
    p = 10 ** (one[None, :, :] + two[:, None, :] - z[:, :, None])
    assert p.sum(axis=2) == pytest.approx(np.ones((8, 8)), abs=1e-3)
    given = p[triples[:, 0], triples[:, 1], triples[:, 2]]
    assert -(np.log(given) * times).sum() / times.sum() < 1.2 < np.log(7)


def test_nothing_learned_still_scores(docs):
    got = lm.predict(docs.withColumn("doc_id", F.lit(None).cast("bigint"))).first()
    assert got["train_tokens"] == 0 and got["base_score"] == 0 and math.isfinite(got["score"])


# --- 8 -------------------------------------------------------------------------------------------------------------


def test_pairs_by_sum_of_squares():
    rng = np.random.default_rng(2)
    m = quality.Machine(0.3, rng.normal(size=9), rng.normal(size=(9, 3)))
    at, x = np.array([0, 2, 5, 8]), rng.normal(size=4)
    plain = 0.3 + m.weights[at] @ x + sum(m.factors[at[i]] @ m.factors[at[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    assert m.margins(np.array([0]), at, x)[0] == pytest.approx(plain)


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 19)] + [(4, None, 0), (None, 1, 0), (4, 1, 0)], "doc_id bigint, quality int, toxic int")
    rows = quality.predict(docs, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert quality.predict(none, labels).count() == 0
    assert {r["score"] for r in quality.predict(docs, labels.where("false")).collect()} == {0.5}


def test_quality_held_out(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality.predict(d, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.97


# --- 9 -------------------------------------------------------------------------------------------------------------


def test_packing(docs, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    ids = collections.defaultdict(list)
    for i, text, _ in ODD:
        ids[i].append(t.encode(text or "", add_special_tokens=False).ids + [2])
    rows = packing.pack_documents(docs, JSON).collect()
    total = sum(len(x) for v in ids.values() for x in v)
    assert sum(r["length"] for r in rows) == total
    bins = collections.defaultdict(list)
    for r in rows:
        ok = any(zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] for x in ids[r["doc_id"]])
        assert ok and (r["piece"] == 0) == (r["start"] == 0)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= -(-total // 1024) + 3
    assert packing.pack_documents(none, JSON).count() == 0


def test_cuts():
    assert packing.cut(1024, 1024) == [(0, 1024)] and packing.cut(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)] and packing.cut(2048, 1024) == [(0, 1024), (1024, 1024)]


def test_patterns_pack_everything_well():
    r = random.Random(7)
    histogram = collections.Counter(min(1024, int(r.expovariate(1 / 300)) + 1) for _ in range(5000))
    packed = packing.patterns(histogram, 1024)
    used = collections.Counter()
    for sizes, n in packed:
        assert sum(sizes) <= 1024
        for s in sizes:
            used[s] += n
    assert used == histogram
    total = sum(k * n for k, n in histogram.items())
    assert sum(n for _, n in packed) <= -(-total // 1024) * 1.005 + 1


def test_two_that_fit_tighter():
    left = np.zeros(20, np.int64)
    left[[3, 4, 9]] = 1
    assert packing._two_for(left, 5, 2) in ((3, 4), (4, 3))
    left[:] = 0
    left[4] = 1
    assert packing._two_for(left, 5, 4) is None  # the one of length 4 cannot be taken twice
    left[4] = 2
    assert packing._two_for(left, 5, 4) == (4, 4)


# --- 10 ------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_rows(docs, none, reference):
    want = collections.Counter()
    for i, t, _ in ODD:
        ids = np.array(reference.encode_ordinary(t or ""), "<u4").tobytes()
        want[i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert collections.Counter(tuple(r) for r in byte_bpe.encode_digests(docs, RANKS).collect()) == want
    assert byte_bpe.encode_digests(none, RANKS).count() == 0


def test_encodes_as_the_library(reference):
    r = random.Random(9)
    bpe = byte_bpe.loaded(RANKS)
    alphabet = "ab stmd'rvel  \n\t 12é中!?' \U0001f600\0\x1c\u00a0\u2003\u0301A"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 80))) for _ in range(3000)] + ["a" * 5000, " " * 500, "'ll" * 400, "x" * 15 + " " + "x" * 16, "<|endoftext|>"]
    for t, ids in zip(texts, bpe.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(t), t
        assert bpe.decode(ids) == t.encode()
    ids = next(bpe.encode(["two words"]))
    assert bpe.offsets(ids).tolist() == [0, 3, 9]


def test_every_codepoint_has_the_library_class(reference):
    bpe = byte_bpe.loaded(RANKS)
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}1{c}!{c} " for c in points[i : i + 2000]) for i in range(0, 0x30000, 2000)]
    for t, ids in zip(texts, bpe.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(t)


def test_state_carries_over_chunks(monkeypatch):
    whole = np.array([ord(c) for c in prose(8, 500) + "'re 've  \n x"] + [0x110000], np.uint32)
    want = byte_bpe.piece_starts(whole)
    for size in (1, 2, 3, 64, 1000):
        monkeypatch.setattr(byte_bpe, "CHUNK_CHARS", size)
        assert byte_bpe.piece_starts(whole).tolist() == want.tolist()


def test_a_small_table_starts_afresh(reference):
    bpe = byte_bpe.ByteBPE.from_ranks(RANKS)
    bpe.short = byte_bpe.PieceTable(bits=8)
    texts = [prose(i, 60) for i in range(20)] + ["".join(map(chr, range(0x4E00, 0x4E00 + 900)))[::1].replace("", " ")]
    for t, ids in zip(texts, bpe.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(t)
