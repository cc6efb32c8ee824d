"""Best-two-fit packing of token sequences.

A bin is filled greedily (largest piece first, then always the largest that still fits); then its
smallest piece is replaced by two unpacked pieces that fill the widened gap more tightly, where two
such pieces exist. Only lengths decide, and there are at most `capacity` of them, so the packing
runs on the histogram of lengths: a table whose size does not depend on the data. What one bin
looks like is a pattern; a pattern repeats for as long as the counts of its lengths allow, which is
what packing bin after bin would do.

Pieces get their bins without gathering them: a piece has a rank among the pieces of its length
(its place in its partition, plus the counts of the partitions before it), and a range of ranks of
a length belongs to a pattern.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopy.llm._util import as_bytes, prepare
from canopy.llm.byte_bpe import batched, loaded
from canopy.sources.scratch import Scratch


def patterns(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in one bin, number of such bins), in the order in which they are packed."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    out = []
    while left.any():
        size = int(np.flatnonzero(left)[-1])
        bin_, gap = [size], capacity - size
        left[size] -= 1
        while gap > 0 and len(fit := np.flatnonzero(left[: gap + 1])):
            size = int(fit[-1])
            bin_.append(size)
            left[size] -= 1
            gap -= size
        if len(bin_) > 1 and gap > 0 and (two := _two_for(left, bin_[-1], gap)):
            left[bin_.pop()] += 1
            for size in two:
                bin_.append(size)
                left[size] -= 1
        sizes, each = np.unique(bin_, return_counts=True)
        more = int((left[sizes] // each).min())
        left[sizes] -= more * each
        out.append((tuple(sorted(bin_, reverse=True)), more + 1))
    return out


def _two_for(left: np.ndarray, smallest: int, gap: int) -> tuple[int, int] | None:
    """Two unpacked lengths that fill gap + smallest better than smallest does, as well as any two can."""
    room = smallest + gap
    have = np.flatnonzero(left[:room])
    if not len(have):
        return None
    mate = have[np.maximum(np.searchsorted(have, room - have, side="right") - 1, 0)]
    total = have + mate
    single = (mate == have) & (left[have] < 2)
    if single.any():  # the only one of its length cannot be taken twice
        where = np.searchsorted(have, mate[single]) - 1
        mate[single] = np.where(where >= 0, have[np.maximum(where, 0)], 0)
        total[single] = np.where(where >= 0, have[single] + mate[single], 0)
    total[total > room] = 0
    best = int(total.argmax())
    return (int(have[best]), int(mate[best])) if total[best] > smallest else None


class _Plan:
    """For each length, where the ranks of its patterns begin and what they mean."""

    def __init__(self, packed: list[tuple[tuple[int, ...], int]]) -> None:
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        upto: dict[int, int] = {}
        base = 0
        for bin_, n in packed:
            place = 0
            for size in dict.fromkeys(bin_):
                k = bin_.count(size)
                begin = upto.get(size, 0)
                rows.setdefault(size, []).append((begin, k, base, place))
                upto[size] = begin + n * k
                place += k * size
            base += n
        self.rows = {size: np.array(x, np.int64) for size, x in rows.items()}

    def place(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bin and offset of each piece."""
        bins, offsets = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for n in np.unique(size).tolist():
            at = np.flatnonzero(size == n)
            row = self.rows[n]
            begin, k, base, place = row[np.searchsorted(row[:, 0], rank[at], side="right") - 1].T
            nth = rank[at] - begin
            bins[at], offsets[at] = base + nth // k, place + nth % k * n
        return bins, offsets


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole, or pieces of capacity after a shorter first."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return ([(0, head)] if head else []) + [(x, capacity) for x in range(head, n, capacity)]


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    path: a vocabulary file of the tokenizers library (byte-level BPE); ids are the library's, those of its added
    tokens included. A null or empty text is one piece that holds end_id alone. Every row is packed, also if its id
    is null or occurs again, and whole, however long its text is. An empty table gives no rows. Other columns of docs
    take no part, whatever their names.
    """
    spark = prepare(docs.sparkSession)
    scratch = Scratch(spark, "packing")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, seen = loaded(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            row, which, start, length, crc, rank = [], [], [], [], [], []
            for i, ids in enumerate(bpe.encode_with_added(batched(as_bytes(batch["text"])))):
                ids += end
                for k, (a, n) in enumerate(cut(len(ids) // 4, capacity)):
                    row.append(i)
                    which.append(k)
                    start.append(a)
                    length.append(n)
                    crc.append(zlib.crc32(ids[4 * a : 4 * (a + n)]))
                    rank.append(seen[n])
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(row, pa.int64())), pa.array(which, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array([part] * len(row), pa.int32()), pa.array(rank, pa.int64())], ["id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    held = scratch.keep(given.mapInArrow(pieces, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, rank bigint"))
    counts = scratch.keep(held.groupBy("length", "part").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = spark.sparkContext.broadcast(_Plan(patterns(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, offsets = plan.value.place(batch["length"].to_numpy(), batch["rank"].to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("id", "piece", "start", "length", "ids_crc32")), pa.array(bins), pa.array(offsets)], ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = held.join(base, ["length", "part"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"))
    return ranked.mapInArrow(place, f"id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint").withColumnRenamed("id", id_col)
