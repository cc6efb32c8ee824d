"""Near copies by SimHash, and by the Jaccard similarity of their word shingles: every pair of 0.8 or more.

A text is the set of its shingles. The SimHash of a set has 512 bits in 16 blocks; sets meet that agree in a block
(pigeonhole: all that differ in 15 bits or fewer, and most of the close ones besides), pass a Hamming distance and then an
exact comparison of whole sets. What is linked so makes components.

SimHash has no distance that all pairs of 0.8 keep to. So what it leaves is found exactly, between components: in any one order
of all shingles, two sets of n and m with a similarity of 0.8 or more share one of the first n // 5 + 1 of the one and
m // 5 + 1 of the other (else too few are left to share). Sets of different components meet over these prefixes and are compared
whole, and no link is lost. The order is rare shingles first, by a sketch of their counts: it decides how many meet,
never which links are found.

Before two sets are compared whole, their parity sketches are: a set's sketch has a bit for each class of hashes,
the parity of its shingles there. Sketches differ in no more bits than sets differ in shingles, so pairs whose sketches
differ in too many are told apart by a Hamming distance, and no pair of 0.8 or more is. A sketch of few bits says
nothing of large sets, so each set has a wide one besides, which has about as many bits as the set has shingles.

A shingle that over `crowd` sets share is not expanded at once: all of them are compared with pivots, one by hash
and one of the commonest shingles, which is the middle of a group of near copies. Only those that are still in
different components then meet, dealt over many keys, and a row is made only where the sketches allow a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm import simhash
from canopy.llm._util import as_bytes, prepare
from canopy.operators.graph import roots as roots_of
from canopy.sources.scratch import Scratch

#: Counters of the sketch, and the slices they are summed in.
BUCKETS, SLICES = 1 << 19, 64
#: Pivots by hash that a group of near copies meets, whatever the number of shingles it shares.
PIVOTS = 8
#: Sets of a crowded shingle that meet under one key, about, where pivots have not linked them.
BLOCK = 512
#: Bits, at most, of a map that tells which documents' sets, or which shingles, are needed; a power of two.
MARKS = 1 << 27
#: Bits of the short parity sketch, and the fewest of a wide one; a power of two, 64 or more.
SKETCH = 512
#: Bits of a SimHash (of 512) in which sets may differ that are compared whole: those of 0.8 differ in 77 on average.
DISTANCE = 128


def shingle_set(text: bytes, width: int = 5) -> np.ndarray:
    """Distinct hashes (uint64, sorted) of the word shingles; a text of fewer words is one shingle."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # as in simhash.fingerprint
    if not words:
        return np.zeros(0, np.uint64)
    known: dict[bytes, int] = {}
    for w in words:
        if w not in known:
            known[w] = xxh64_intdigest(w, 42)
    ids = np.fromiter((known[w] for w in words), np.uint64, len(words))
    width = min(width, len(words))
    mixed = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        mixed = (mixed ^ ids[i : i + len(mixed)]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def _key(found: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    x = xxh64_intdigest(found.tobytes(), 7)
    return x - (1 << 64) if x >= 1 << 63 else x


def _bucket(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def sketch(found: np.ndarray, bits: int = SKETCH) -> np.ndarray:
    """The parity of the number of shingles in each of so many classes (a power of two), as 64-bit words. The halves of
    a sketch, combined by exclusive or, are the sketch of half the bits."""
    odd = np.bincount((found >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def wide_sketch(found: np.ndarray) -> np.ndarray:
    """The sketch whose bits are the least power of two that is not below the number of shingles; empty where the
    short sketch is as good. Sets whose sizes differ by a factor of up to two have bits that do so, too."""
    bits = 1 << (len(found) - 1).bit_length() if len(found) > SKETCH else 0
    return sketch(found, bits) if bits else np.zeros(0, np.int64)


def _commonness(given: DataFrame, width: int) -> np.ndarray:
    """For each bucket of hashes, the binary logarithm of the shingles counted in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for x in as_bytes(batch["text"]):
                at, n = np.unique(_bucket(shingle_set(x, width)), return_counts=True)
                counts[at] += n
        if counts.any():
            parts = [x.astype(np.uint32).tobytes() for x in counts.reshape(SLICES, -1)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary())], ["slice", "counts"])

    def add(part: pa.Table) -> pa.Table:
        total = np.zeros(BUCKETS // SLICES, np.int64)
        for x in part["counts"].to_pylist():
            total += np.frombuffer(x, np.uint32)
        return pa.table({"slice": part["slice"][:1], "classes": pa.array([np.frexp(total)[1].astype(np.uint8).tobytes()], pa.binary())})

    rows = given.mapInArrow(run, "slice int, counts binary").groupBy("slice").applyInArrow(add, "slice int, classes binary").collect()
    out = np.zeros((SLICES, BUCKETS // SLICES), np.uint8)
    for r in rows:
        out[r["slice"]] = np.frombuffer(r["classes"], np.uint8)
    return out.reshape(-1)


def _prefixes(given: DataFrame, width: int, classes: np.ndarray) -> DataFrame:
    """(id, key, n, print, centre, prefix, sketch, wide) of every row: key names the set of n shingles, print is its
    SimHash. The more common the shingles of the prefix, the greater is centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, prints, centres, prefixes, sketches, wides = [], [], [], [], [], [], []
            for x in as_bytes(batch["text"]):
                found = shingle_set(x, width)
                common = classes[_bucket(found)]
                order = np.argsort(common, kind="stable")[: len(found) // 5 + 1]
                keys.append(_key(found))
                sizes.append(len(found))
                prints.append(simhash.wide_fingerprint(found))
                centres.append(float(common[order].mean()) if len(found) else 0.0)
                prefixes.append(found[order].view(np.int64))
                sketches.append(sketch(found))
                wides.append(wide_sketch(found))
            cols = [pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()), pa.array(prints, pa.list_(pa.int32())), pa.array(centres, pa.float32()), *(pa.array(x, pa.list_(pa.int64())) for x in (prefixes, sketches, wides))]
            yield pa.RecordBatch.from_arrays([batch["id"], *cols], ["id", "key", "n", "print", "centre", "prefix", "sketch", "wide"])

    return given.mapInArrow(run, f"id {given.schema['id'].dataType.simpleString()}, key bigint, n int, print array<int>, centre float, prefix array<bigint>, sketch array<bigint>, wide array<bigint>")


def _marks(hashes: DataFrame, n: int) -> np.ndarray:
    """A bitmap of n hashes (h), with 16 bits for each up to MARKS bits: a hash that lacks its bit is not among them."""
    bits = 1 << max(15, min((16 * n).bit_length(), MARKS.bit_length() - 1))
    at = F.pmod(F.col("h"), F.lit(bits))
    parts = hashes.select(at.alias("at")).groupBy(F.shiftright("at", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(32767))).alias("bits")).collect()
    out = np.zeros((bits >> 15, 4096), np.uint8)
    for r in parts:  # at most MARKS bits
        out[r["part"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def _posts(one: DataFrame, marks: np.ndarray) -> DataFrame:
    """(key, n, centre, pos, s) of the shingles of prefixes that are marked. Most shingles are in one set alone, and those
    need not travel; a map that is too small for all shingles lets more of them through."""
    held = one.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            lists = batch["prefix"]
            s = lists.flatten().to_numpy()
            sizes = np.diff(lists.offsets.to_numpy())
            pos = np.arange(len(s)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            at = s & (8 * len(own) - 1)
            some = np.flatnonzero(own[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            of = pa.array(np.repeat(np.arange(len(sizes)), sizes)[some])
            cols = [*(batch[c].take(of) for c in ("key", "n", "centre")), pa.array(pos[some], pa.int32()), pa.array(s[some], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["key", "n", "centre", "pos", "s"])

    return one.mapInArrow(run, "key bigint, n int, centre float, pos int, s bigint")


def _sets(given: DataFrame, width: int, marks: np.ndarray) -> DataFrame:
    """(key, shingles) of the rows whose id is marked. Texts do not travel for it."""
    held = given.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            at = batch["at"].to_numpy()
            some = np.flatnonzero(own[at >> 3] >> (at & 7).astype(np.uint8) & 1)
            found = [shingle_set(x, width) for x in as_bytes(batch["text"].take(pa.array(some)))]
            yield pa.RecordBatch.from_arrays([pa.array([_key(x) for x in found], pa.int64()), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], ["key", "shingles"])

    return given.select("text", F.pmod(F.xxhash64("id"), F.lit(8 * len(marks))).alias("at")).mapInArrow(run, "key bigint, shingles array<bigint>")


def _close(left: str, right: str, ln: str, rn: str) -> F.Column:
    """Whether the sketches of sets of ln and rn shingles allow a similarity of 0.8: then at most a ninth of ln + rn differ."""
    apart = sum((F.bit_count(F.col(left)[i].bitwiseXOR(F.col(right)[i])) for i in range(SKETCH // 64)), F.lit(0))
    return 9 * apart <= F.col(ln) + F.col(rn)


def _wide_close(left: str, right: str, ln: str, rn: str) -> F.Column:
    """As _close, by the wide sketches of sets whose sizes differ by a factor of up to two; true where either has none."""
    words = F.least(F.size(left), F.size(right))
    half = lambda c: lambda i: F.when(F.size(c) > words, F.col(c)[i].bitwiseXOR(F.col(c)[i + words])).otherwise(F.col(c)[i])
    apart = F.aggregate(F.sequence(F.lit(0), words - 1), F.lit(0), lambda sum_, i: sum_ + F.bit_count(half(left)(i).bitwiseXOR(half(right)(i))))
    return F.when(words > 0, 9 * apart <= F.col(ln) + F.col(rn)).otherwise(F.lit(True))


def _alike(pairs: DataFrame, sets_of: DataFrame, given: DataFrame, width: int, scratch: Scratch, rows: int) -> tuple[DataFrame, int]:
    """The pairs (a, b) of keys of different roots whose sets have a similarity of 0.8 or more, and about their number.
    sets_of: (key, root, id, n, sketch, wide) of each set; sizes of the sets of a pair differ by a quarter at most. rows: about how many pairs there are at most."""
    left, right = (sets_of.select(F.col("key").alias(c), F.col("root").alias(f"r{c}"), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"), F.col("wide").alias(f"w{c}")) for c in "ab")
    met = pairs.distinct().join(left, "a").join(right, "b").where("ra <> rb").where(_close("sa", "sb", "na", "nb"))
    pairs = scratch.keep(met.where(_wide_close("wa", "wb", "na", "nb")).select("a", "b"), rows)
    rows = pairs.count()
    needed = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    needed = scratch.keep(sets_of.join(needed, "key", "left_semi").select("key", "id", "n"), 2 * rows)
    facts = needed.agg(F.count("*").alias("sets"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    sets = _sets(given, width, _marks(needed.select(F.xxhash64("id").alias("h")), facts["sets"])).join(needed, "key", "left_semi").dropDuplicates(["key"])
    sets = scratch.keep(sets, facts["n"] // 4)
    left, right = (sets.select(F.col("key").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    common = F.size(F.array_intersect("sa", "sb"))
    # a task meets whole sets, so the files follow their size, not the number of pairs
    out = scratch.keep(pairs.join(left, "a").join(right, "b").where(9 * common >= 4 * (F.size("sa") + F.size("sb"))).select("a", "b"), max(rows, rows * facts["n"] // (2 * max(1, facts["sets"]))))
    scratch.drop(pairs, needed, sets)
    return out, rows


def _merged(up: DataFrame, found: DataFrame, scratch: Scratch, rows: int) -> DataFrame:
    """up (key, root, and other columns) after the pairs found (a, b): what has a root is linked, only the roots meet."""
    of = up.select("key", "root")
    joined = found.join(of.select(F.col("key").alias("a"), F.col("root").alias("ra")), "a").join(of.select(F.col("key").alias("b"), F.col("root").alias("rb")), "b")
    top = roots_of(joined.select(F.col("ra").alias("a"), F.col("rb").alias("b")), scratch, rows=rows).select(F.col("vertex").alias("root"), F.col("root").alias("top"))
    return up.join(top, "root", "left").select(*(c if c != "root" else F.coalesce("top", "root").alias("root") for c in up.columns))


def _met(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Pairs that sizes and places in the order allow; both sides have key, n and pos, prefixed l and r."""
    met = left.join(right, on).where("lkey < rkey and 5 * least(ln, rn) >= 4 * greatest(ln, rn)")
    return met.where("9 * least(ln - lpos, rn - rpos) >= 4 * (ln + rn)")


def _side(x: DataFrame, p: str, *extra: str | F.Column) -> DataFrame:
    return x.select("s", *extra, *(F.col(c).alias(p + c) for c in ("key", "n", "pos")))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, crowd: int = 32) -> DataFrame:
    """Per row of docs: id, component_id, the least id among the documents reachable over pairs of a similarity of
    0.8 or more (its own included). Ids are not null; null text counts as empty, and texts without words are
    copies of each other. Whole texts count, however long. Repeated rows each get a row. An empty table gives none.
    Other columns of docs take no part, whatever their names.
    """
    spark = prepare(docs.sparkSession)
    scratch = Scratch(spark, "near")
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    held = scratch.keep(_prefixes(given, width, _commonness(given, width)))
    of = held.groupBy("key").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("print").alias("print"), F.first("sketch").alias("sketch"), F.first("wide").alias("wide"))
    alone = scratch.keep(of.withColumn("root", F.col("key")), 4 * held.count())
    close, rows = simhash.block_pairs(alone.where("n > 0").select("key", "print"), scratch, DISTANCE, crowd)
    sized = alone.select("key", "n")
    fit = close.join(sized.toDF("a", "na"), "a").join(sized.toDF("b", "nb"), "b").where("5 * least(na, nb) >= 4 * greatest(na, nb)")
    first, rows = _alike(fit.select("a", "b"), alone, given, width, scratch, rows)
    sets_of = scratch.keep(_merged(alone.drop("print"), first, scratch, rows), 4 * held.count())
    scratch.drop(alone, close, first)

    one = scratch.keep(held.where("n > 0").select("key", "n", "centre", "prefix").dropDuplicates(["key"]))
    shared = scratch.keep(one.select(F.explode("prefix").alias("s")).groupBy("s").agg(F.count("*").alias("c")).where("c > 1"))
    facts = shared.agg(F.count("*").alias("shingles"), F.coalesce(F.sum("c"), F.lit(0)).alias("rows")).first()
    rows = facts["rows"]
    member = scratch.keep(_posts(one, _marks(shared.select(F.col("s").alias("h")), facts["shingles"])).join(shared, "s"), rows)
    scratch.drop(one, shared)
    few, many = member.where(F.col("c") <= crowd), member.where(F.col("c") > crowd)
    pairs = _met(_side(few, "l"), _side(few, "r"), ["s"]).select(F.col("lkey").alias("a"), F.col("rkey").alias("b"))
    by_hash = F.xxhash64("key", F.pmod("s", F.lit(PIVOTS)))
    pivots = many.groupBy("s").agg(F.min_by("key", by_hash).alias("p0"), F.min_by("n", by_hash).alias("n0"), F.max_by("key", "centre").alias("p1"), F.max_by("n", "centre").alias("n1"))
    led = many.join(pivots, "s")
    for i in range(2):
        starred = led.where(f"key <> p{i} and 5 * least(n, n{i}) >= 4 * greatest(n, n{i})")
        pairs = pairs.union(starred.select(F.least("key", f"p{i}").alias("a"), F.greatest("key", f"p{i}").alias("b")))
    links, rows = _alike(pairs, sets_of, given, width, scratch, rows)
    own = _merged(sets_of.select("key", "sketch", "root"), links, scratch, rows)

    placed = scratch.keep(many.select("s", "key", "n", "pos").join(own.select("key", "root"), "key"), rows)
    apart = placed.groupBy("s").agg(F.count("*").alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    rest = placed.join(apart.select("s", F.ceil(F.col("c") / BLOCK).cast("int").alias("parts")), "s").join(own.select("key", "sketch"), "key")
    rest = rest.withColumn("i", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    left = _side(rest.withColumn("j", every), "l", "i", "j", F.col("root").alias("lroot"), F.col("sketch").alias("ls"))
    right = _side(rest.withColumnRenamed("i", "j").withColumn("i", every), "r", "i", "j", F.col("root").alias("rroot"), F.col("sketch").alias("rs"))
    more = _met(left, right, ["s", "i", "j"]).where("lroot <> rroot").where(_close("ls", "rs", "ln", "rn"))
    more, rows = _alike(more.select(F.col("lkey").alias("a"), F.col("rkey").alias("b")), sets_of, given, width, scratch, placed.count())

    of = _merged(own.select("key", "root"), more, scratch, rows)
    final = scratch.keep(held.select("id", "key").join(of, "key").select("id", "root"), held.count())
    scratch.drop(held, sets_of, member, placed, links, more)
    own = final
    component = own.groupBy("root").agg(F.min("id").alias("component_id"))
    return own.join(component, "root").select(F.col("id").alias(id_col), "component_id")
