"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming verification, components.

Fingerprints of 64 bits are cut into `blocks` blocks. Two that differ in at most `distance` bits
agree on at least blocks - distance of them, so they meet under one of the keys that such a choice of
blocks makes. Distinct fingerprints are joined on these keys and verified. A key that more than
`crowd` fingerprints share (a large group of near copies) would make its square in pairs; the
fingerprints of such keys are linked exactly in another way that is linear: two fingerprints differ
in at most 2 bits just if they have a common neighbour at distance 1 or less, so each is linked to
the least fingerprint among those with the same neighbour. (At most 1 bit: just if one is a neighbour
of the other.)

Wider fingerprints, for looser copies, are lists of blocks of 32 bits, and one block in common makes two meet (block_pairs).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.llm._util import as_bytes, prepare
from canopy.operators.graph import roots as roots_of
from canopy.sources.scratch import Scratch

#: Shingles whose bits are counted at once.
PART = 1 << 16


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of the word shingles of a text: a bit is set if over half of their hashes set it."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # of bytes: A-Z only, and exactly the white space \\x20, \\x09-\\x0D
    if not words:
        return 0
    total = max(1, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, total, PART):
        part = words[at : at + PART + width - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(width)))) if total > 1 or len(words) == width else [b" ".join(words)]
        hashes = np.fromiter((xxh64_intdigest(x, 42) for x in shingles), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def wide_fingerprint(hashes: np.ndarray, blocks: int = 16) -> np.ndarray:
    """SimHash of hashed features (uint64) as an even number of blocks of 32 bits: as fingerprint, with every 64 bits
    from hashes that are mixed anew. No features give zeros."""
    ones = np.zeros(32 * blocks, np.int64)
    salts = np.arange(1, blocks // 2 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), 255):  # so many bits sum up in 8 bits
        mixed = (hashes[at : at + 255, None] ^ salts) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0x94D049BB133111EB)
        mixed ^= mixed >> np.uint64(32)
        ones += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int32)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): fp is the fingerprint as a signed 64-bit integer. A null text counts as empty (0)."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(x, width) for x in as_bytes(batch["text"])], np.uint64)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(prints.view(np.int64))], ["id", "fp"])

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    return given.mapInArrow(run, f"id {kind}, fp bigint")


def _keys(blocks: int, distance: int) -> list[int]:
    """A mask of 64 bits for each choice of blocks - distance blocks."""
    edge = [64 * i // blocks for i in range(blocks + 1)]
    whole = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(blocks)]
    return [sum(whole[i] for i in pick) for pick in combinations(range(blocks), blocks - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(prints: DataFrame, scratch: Scratch, distance: int = 2, blocks: int = 4, crowd: int = 32) -> tuple[DataFrame, int]:
    """(a, b): edges with the same components as all pairs of distinct fingerprints within distance; and the
    number of rows that blocks share, which tells how large the table of edges may be, about.

    prints: one column fp, distinct. distance: 0 to 2.
    """
    if not 0 <= distance <= 2:
        raise ValueError("distance must be 0, 1 or 2")
    masks = F.array(*(F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(_keys(blocks, distance))))
    keyed = prints.select("fp", F.explode(masks).alias("k")).select("fp", "k.i", "k.key")
    shared = keyed.groupBy("i", "key").agg(F.count("*").alias("n")).where("n > 1")
    member = scratch.keep(keyed.join(shared, ["i", "key"]), len(_keys(blocks, distance)) * prints.count())
    rows = member.count()
    few = member.where(F.col("n") <= crowd)
    pairs = (
        few.select("i", "key", F.col("fp").alias("a"))
        .join(few.select("i", "key", F.col("fp").alias("b")), ["i", "key"])
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
        .select("a", "b")
    )
    crowded = member.where(F.col("n") > crowd).select("fp").distinct()
    flips = F.array(*(F.lit(_signed(1 << i)) for i in range(64)))
    near = crowded.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("at"))
    if distance < 2:  # neighbours that are there themselves
        linked = near.join(crowded.select(F.col("fp").alias("at")), "at") if distance else near.where("false")
        return pairs.union(linked.select(F.col("fp").alias("a"), F.col("at").alias("b"))).distinct(), rows
    near = near.union(crowded.select("fp", F.col("fp").alias("at")))
    least = near.groupBy("at").agg(F.min("fp").alias("low"), F.count("*").alias("n")).where("n > 1").select("at", "low")
    starred = near.join(least, "at").where("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b"))
    return pairs.union(starred).distinct(), rows


def block_pairs(prints: DataFrame, scratch: Scratch, distance: int, crowd: int = 32) -> tuple[DataFrame, int]:
    """(a, b), a < b: keys whose wide fingerprints agree in a block and differ in at most `distance` bits; and about how
    many pairs there are at most. By the pigeonhole principle these are all that differ in fewer bits than there are
    blocks, and of those that differ in more the likelier the closer they are.

    A block that more than `crowd` fingerprints share is not expanded into pairs: each of them meets one, by hash, and
    the caller finds what links are missing then. prints: (key, print), keys distinct, prints of one length.
    """
    keyed = prints.select("key", F.posexplode("print").alias("i", "block"))
    shared = keyed.groupBy("i", "block").agg(F.count("*").alias("n")).where("n > 1")
    member = scratch.keep(keyed.join(shared, ["i", "block"]), prints.count())
    rows = member.count()
    few, many = member.where(F.col("n") <= crowd), member.where(F.col("n") > crowd)
    pairs = few.select("i", "block", F.col("key").alias("a")).join(few.select("i", "block", F.col("key").alias("b")), ["i", "block"]).where("a < b").select("a", "b")
    middle = many.groupBy("i", "block").agg(F.min_by("key", F.xxhash64("key", "i")).alias("p"))
    starred = many.join(middle, ["i", "block"]).where("key <> p").select(F.least("key", "p").alias("a"), F.greatest("key", "p").alias("b"))
    left, right = (prints.select(F.col("key").alias(c), F.col("print").alias(f"p{c}")) for c in "ab")
    met = pairs.union(starred).distinct().join(left, "a").join(right, "b")
    one = lambda x, y: F.bit_count(x.bitwiseXOR(y).cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))  # noqa: E731  (bit_count extends the sign to 64 bits)
    apart = F.aggregate(F.zip_with("pa", "pb", one), F.lit(0), lambda sum_, x: sum_ + x)
    close = scratch.keep(met.where(apart <= distance).select("a", "b"), rows)
    scratch.drop(member)
    return close, rows


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 2, blocks: int = 4) -> DataFrame:
    """Per row of docs: id, fingerprint (16 lowercase hex digits), component_id.

    component_id is the smallest id among the documents reachable over links (its own included); null if
    none of them has an id. Null text counts as empty; a text without words has fingerprint zero
    and is linked like any other. Whole texts count, however long. Repeated rows each get a row. An empty table gives
    none. Other columns of docs, whatever their names, take no part. Tables are written to the shared folder when this
    is called; the result reads them.
    """
    spark = prepare(docs.sparkSession)
    scratch = Scratch(spark, "simhash")
    held = scratch.keep(fingerprints(docs, id_col, text_col, width))
    prints = scratch.keep(held.groupBy("fp").agg(F.min("id").alias("first")), held.count())
    edges, rows = links(prints.select("fp"), scratch, distance, blocks)
    roots = roots_of(edges, scratch, rows=rows)
    rooted = prints.join(roots, prints["fp"] == roots["vertex"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    component = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = rooted.join(component, "root").select("fp", "component_id")
    return held.join(of, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
