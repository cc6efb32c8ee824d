"""Incremental, reversible line dedup: sharded cuckoo filters backed by exact reference counts.

State, as tables in a shared folder:

- postings: (id, t, h1, h2), one row for each document and distinct line key it holds; t is a hash of the text, which
  tells rows without an id apart. A key is known by 128 bits of hash. These are the exact counts' evidence, so a
  document can be taken out again.
- counts: (h1, h2, refs, low, high, bare): documents that hold the key, the least and greatest id, and
  whether one without an id holds it.
- filters: (shard, blob): cuckoo filters over the keys that at least two documents hold. They can
  delete, so they follow the counts down as well as up.

To decide which lines go, a document's keys first meet the filters: a key that no filter knows is
held by one document only, and that settles most lines. Only the rest is joined with the exact counts. Postings and
filters meet shard by shard: both are dealt by shard and sorted, so a task holds one filter while the postings
stream by. The number of shards follows the number of keys, so a filter has a bounded size; a shard that a very
common key makes larger than others is dealt over several tasks, each with a copy of the filter.

insert() and delete() touch the counts of the batch's keys alone, and rewrite only the filters of
shards whose shared keys changed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.llm._util import as_bytes, prepare
from canopy.sources.scratch import Scratch

BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Code points that a key needs before its lines may go.
MIN_POINTS = 10
#: Over the counts: at least two documents hold the key. Those without an id count as one, after all others.
SHARED = "low < high or (bare and low is not null)"
#: Keys of a shard, about, at most; and shards, at least.
SHARD_KEYS, SHARDS = 1 << 20, 64


class CuckooFilter:
    """Buckets of four 16-bit tags; a key has two buckets, each found from the other and the tag.

    No false negatives; deleting a key that was added removes one copy of its tag. Adding moves tags
    between their buckets; where that fails, the table doubles from the keys that the caller has.
    """

    def __init__(self, buckets: int) -> None:
        self.n = 1 << max(2, int(buckets - 1).bit_length())
        self.table = np.zeros((self.n, 4), np.uint16)

    @classmethod
    def build(cls, keys: np.ndarray) -> CuckooFilter:
        size = max(4, int(len(keys) / 3.2) + 1)
        while True:
            out = cls(size)
            if out.add(keys):
                return out
            size = out.n * 2

    @classmethod
    def read(cls, blob: bytes) -> CuckooFilter:
        out = cls(max(1, len(blob) // 8))
        out.table = np.frombuffer(blob, "<u2").reshape(-1, 4).copy()
        out.n = len(out.table)
        return out

    def blob(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    def _place(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tag (never 0) and both buckets of 64-bit keys."""
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        tag = (mixed >> np.uint64(48)).astype(np.int64) % 65535 + 1
        one = (mixed >> np.uint64(8)).astype(np.int64) & (self.n - 1)
        return tag, one, self._other(one, tag)

    def _other(self, bucket: np.ndarray, tag: np.ndarray) -> np.ndarray:
        return (bucket ^ (tag * 0x5BD1E995)) & (self.n - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        tag, one, two = self._place(keys)
        return ((self.table[one] == tag[:, None]) | (self.table[two] == tag[:, None])).any(axis=1)

    def add(self, keys: np.ndarray, kicks: int = 200) -> bool:
        """Add keys; False if they don't fit (the filter then lacks some)."""
        tag, bucket, other = self._place(keys)
        for turn in range(kicks):
            if not len(tag):
                return True
            held = []
            # each bucket takes as many of its suitors as it has room for
            order = np.argsort(bucket, kind="stable")
            tag, bucket, other = tag[order], bucket[order], other[order]
            first = np.concatenate([[True], bucket[1:] != bucket[:-1]])
            nth = np.arange(len(bucket)) - np.maximum.accumulate(np.where(first, np.arange(len(bucket)), 0))
            free = self.table[bucket] == 0
            rank = np.cumsum(free, axis=1)
            fits = nth < rank[:, -1]
            slot = (rank == (nth + 1)[:, None]).argmax(axis=1)
            self.table[bucket[fits], slot[fits]] = tag[fits]
            tag, bucket, other = tag[~fits], bucket[~fits], other[~fits]
            if turn % 2 == 0:  # first try the other bucket
                bucket, other = other, bucket
                continue
            _, one = np.unique(bucket, return_index=True)  # then one suitor of each bucket evicts a tag
            slot = (turn // 2 + one) % 4
            out = self.table[bucket[one], slot].astype(np.int64)
            self.table[bucket[one], slot] = tag[one]
            tag[one] = out
            moved = self._other(bucket[one], out)
            other[one], bucket[one] = bucket[one], moved
            held.append(out)
        return not len(tag)

    def remove(self, keys: np.ndarray) -> None:
        """Take out keys that were added."""
        for tag, one, two in zip(*(x.tolist() for x in self._place(keys))):
            for b in (one, two):
                at = np.flatnonzero(self.table[b] == tag)
                if len(at):
                    self.table[b, at[0]] = 0
                    break


def line_keys(text: bytes) -> list[bytes]:
    """The key of each line."""
    return [x.strip(BLANK) for x in text.lower().split(b"\n")]


def countable(key: bytes) -> bool:
    """Whether a key has at least MIN_POINTS code points."""
    return len(key) >= MIN_POINTS and (len(key) >= 4 * MIN_POINTS or len(key) - sum(0x80 <= b < 0xC0 for b in key) >= MIN_POINTS)


def _digest(keys: list[bytes]) -> np.ndarray:
    """Two 64-bit words for each key."""
    from xxhash import xxh3_128_digest

    return np.frombuffer(b"".join(map(xxh3_128_digest, keys)), "<i8").reshape(-1, 2)


class LineIndex:
    """The state over a set of documents; each change gives a new index and leaves the old one usable."""

    def __init__(self, spark: SparkSession, shards: int = SHARDS, scratch: Scratch | None = None, postings: DataFrame | None = None, counts: DataFrame | None = None, filters: DataFrame | None = None, kind: str = "bigint") -> None:
        self.spark, self.shards, self.kind = spark, shards, kind
        self.scratch = scratch or Scratch(spark, "lines")
        self.postings, self.counts, self.filters = postings, counts, filters

    def _read(self, docs: DataFrame) -> DataFrame:
        """(id, t, h1, h2) of each document row and distinct countable key."""
        prepare(self.spark)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, row = [], []
                for i, text in enumerate(as_bytes(batch["text"])):
                    own = {k for k in line_keys(text) if countable(k)}
                    keys += own
                    row += [i] * len(own)
                h = _digest(keys)
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([batch["id"].take(at), batch["t"].take(at), pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1]))], ["id", "t", "h1", "h2"])

        return docs.mapInArrow(run, f"id {self.kind}, t bigint, h1 bigint, h2 bigint")

    def _summary(self, postings: DataFrame) -> DataFrame:
        return postings.groupBy("h1", "h2").agg(F.count("*").alias("refs"), F.min("id").alias("low"), F.max("id").alias("high"), F.bool_or(F.col("id").isNull()).alias("bare"))

    def _shard(self) -> F.Column:
        return F.pmod("h1", F.lit(self.shards)).cast("int").alias("shard")

    def _filters(self, counts: DataFrame) -> DataFrame:
        """Cuckoo filters of the shared keys, one for each shard that has some."""

        def build(table: pa.Table) -> pa.Table:
            keys = table["h1"].to_numpy() ^ (table["h2"].to_numpy() << 1)
            return pa.table({"shard": table["shard"][:1], "blob": pa.array([CuckooFilter.build(keys).blob()], pa.binary())})

        shared = counts.where(SHARED).select(self._shard(), "h1", "h2")
        return shared.groupBy("shard").applyInArrow(build, "shard int, blob binary")

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> LineIndex:
        """Add documents whose ids the index lacks."""
        given = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("binary")).alias("t"), F.col(text_col).cast("binary").alias("text"))
        self.kind = given.schema["id"].dataType.simpleString()
        new = self.scratch.keep(self._read(given))
        summary = self._summary(new)
        if self.counts is None:
            return self._built(new, self.scratch.keep(summary))
        both = self.counts.union(summary).groupBy("h1", "h2").agg(F.sum("refs").alias("refs"), F.min("low").alias("low"), F.max("high").alias("high"), F.bool_or("bare").alias("bare"))
        counts = self.scratch.keep(both)
        if counts.count() > 2 * SHARD_KEYS * self.shards:
            return self._built(self.postings.union(new), counts)
        return self._changed(self.postings.union(new), counts, new.select(self._shard()).distinct())

    def _built(self, postings: DataFrame, counts: DataFrame) -> LineIndex:
        """An index with as many shards as its keys need, and new filters."""
        shards = max(self.shards, 1 << max(0, -(-counts.count() // SHARD_KEYS) - 1).bit_length())
        out = LineIndex(self.spark, shards, self.scratch, postings, counts, None, self.kind)
        out.filters = self.scratch.keep(out._filters(counts))
        return out

    def delete(self, ids: DataFrame, id_col: str = "doc_id") -> LineIndex:
        """Take out documents; lines that they alone shared with another come back for that one."""
        gone = ids.select(F.col(id_col).alias("id")).distinct()
        left = self.scratch.keep(self.postings.join(gone, "id", "left_anti"))
        touched = self.postings.join(gone, "id", "left_semi").select("h1", "h2").distinct()
        again = self._summary(left.join(touched, ["h1", "h2"], "left_semi"))
        counts = self.scratch.keep(self.counts.join(touched, ["h1", "h2"], "left_anti").union(again))
        return self._changed(left, counts, touched.select(self._shard()).distinct())

    def _changed(self, postings: DataFrame, counts: DataFrame, shards: DataFrame) -> LineIndex:
        """The next index: filters of changed shards lose the keys that are no longer shared and gain the new ones."""
        was = self.counts.where(SHARED).select("h1", "h2")
        now = counts.where(SHARED).select("h1", "h2")
        change = was.join(now, ["h1", "h2"], "left_anti").withColumn("add", F.lit(False)).union(now.join(was, ["h1", "h2"], "left_anti").withColumn("add", F.lit(True)))
        change = change.select(self._shard(), "h1", "h2", "add")

        def update(key: tuple, old: pa.Table, change: pa.Table) -> pa.Table:
            shard = key[0].as_py()
            keys = change["h1"].to_numpy() ^ (change["h2"].to_numpy() << 1)
            add = change["add"].to_numpy().astype(bool)
            at = CuckooFilter.read(old["blob"][0].as_py()) if len(old) else CuckooFilter.build(keys[:0])
            at.remove(keys[~add])
            blob = at.blob() if at.add(keys[add]) else None  # full: built again from the counts
            return pa.table({"shard": pa.array([shard], pa.int32()), "blob": pa.array([blob], pa.binary())})

        updated = self.filters.groupBy("shard").cogroup(change.groupBy("shard")).applyInArrow(update, "shard int, blob binary")
        updated = self.scratch.keep(updated)
        full = updated.where("blob is null").select("shard")
        rebuilt = self._filters(counts.join(full, F.pmod("h1", F.lit(self.shards)).cast("int") == full["shard"], "left_semi"))
        filters = self.scratch.keep(updated.where("blob is not null").union(rebuilt))
        return LineIndex(self.spark, self.shards, self.scratch, postings, counts, filters, self.kind)

    def losses(self) -> DataFrame:
        """(id, t, h1, h2): keys whose lines the document loses, since a smaller id holds them."""
        mine = self.postings.select(self._shard(), F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("blob"), "id", "t", "h1", "h2")
        # refs of each shard, most of them alike; a number of tasks for those that a common key makes large
        refs = self.counts.groupBy(self._shard()).agg(F.sum("refs").alias("refs"))
        mean = refs.agg(F.mean("refs")).first()[0] or 1.0
        large = {r["shard"]: int(-(-r["refs"] // mean)) for r in refs.where(F.col("refs") > 2 * mean).collect()}  # sums of the refs bound them: fewer than half the shards
        tasks = F.coalesce(F.create_map(*(F.lit(x) for pair in large.items() for x in pair))[F.col("shard")], F.lit(1)) if large else F.lit(1)
        mine = mine.withColumn("task", F.pmod(F.xxhash64("id", "t"), tasks).cast("int"))
        nothing = (F.lit(None).cast(c).alias(n) for c, n in ((self.kind, "id"), ("bigint", "t"), ("bigint", "h1"), ("bigint", "h2")))
        every = self.filters.select("shard", F.lit(0).alias("kind"), "blob", *nothing, F.explode(F.sequence(F.lit(0), tasks - 1)).alias("task"))
        dealt = mine.unionByName(every).repartition("shard", "task").sortWithinPartitions("shard", "task", "kind")

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filter_, of = None, None
            for batch in batches:
                where = batch["shard"].to_numpy().astype(np.int64) << 32 | batch["task"].to_numpy()
                kind, keep = batch["kind"].to_numpy(), np.zeros(batch.num_rows, bool)
                h1, h2 = (batch[c].fill_null(0).to_numpy() for c in ("h1", "h2"))
                key = h1 ^ (h2 << 1)
                edge = np.concatenate([[0], np.flatnonzero((where[1:] != where[:-1]) | (kind[1:] != kind[:-1])) + 1, [batch.num_rows]])
                for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                    if a < b and kind[a] == 0:
                        filter_, of = CuckooFilter.read(batch["blob"][a].as_py()), where[a]
                    elif a < b and of == where[a]:
                        keep[a:b] = filter_.has(key[a:b])
                yield batch.select(["id", "t", "h1", "h2"]).filter(pa.array(keep))

        maybe = dealt.mapInArrow(probe, f"id {self.kind}, t bigint, h1 bigint, h2 bigint")
        shared = self.counts.where(SHARED).select("h1", "h2", "low")
        return maybe.join(shared, ["h1", "h2"]).where("id > low or id is null").select("id", "t", "h1", "h2")

    def apply(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
        """Per row of docs: id, the columns to carry, n_lines, n_dropped, and the kept text, or its kept_sha256 instead.

        The rows' ids must be in the index. The first holder of a shared key keeps all its lines of
        it. A null or empty text is one empty line, kept. Rows that repeat an id are one document;
        a null id counts after all others, as one document. Whole texts count, however long. An empty table gives no
        rows. Columns of docs that are not named take no part.
        """
        lost = self.losses().groupBy("id", "t").agg(F.collect_set(F.struct("h1", "h2")).alias("lost"))
        lost = lost.select(F.col("id").alias("lost_id"), F.col("t").alias("lost_t"), "lost")
        more = [f"c{i}" for i in range(len(carry))]
        given = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("binary")).alias("t"), F.col(text_col).cast("binary").alias("text"), *(F.col(c).alias(m) for c, m in zip(carry, more)))
        joined = given.join(lost, (given["t"] == lost["lost_t"]) & given["id"].eqNullSafe(lost["lost_id"]), "left").select("id", "text", *more, F.col("lost.h1").alias("h1"), F.col("lost.h2").alias("h2"))
        prepare(self.spark)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lines, dropped, kept = [], [], []
                for text, h1, h2 in zip(as_bytes(batch["text"]), batch["h1"].to_pylist(), batch["h2"].to_pylist()):
                    n = text.count(b"\n") + 1
                    gone = 0
                    if h1:
                        bad = set(zip(h1, h2))
                        keys = line_keys(text)
                        hashes = map(tuple, _digest(keys).tolist())
                        rest = [x for x, k, h in zip(text.split(b"\n"), keys, hashes) if h not in bad or not countable(k)]
                        gone = n - len(rest)
                        text = b"\n".join(rest)
                    lines.append(n)
                    dropped.append(gone)
                    kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([batch["id"], *(batch[m] for m in more), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], ["id", *more, "n_lines", "n_dropped", "kept"])

        schema = joined.select("id", *more).schema.add("n_lines", T.LongType()).add("n_dropped", T.LongType()).add("kept", T.StringType())
        out = joined.mapInArrow(run, schema)
        return out.select(F.col("id").alias(id_col), *(F.col(m).alias(c) for m, c in zip(more, carry)), "n_lines", "n_dropped", F.col("kept").alias("kept_sha256" if digest else text_col))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Insert docs into a fresh index and apply it to them; see LineIndex.apply."""
    return LineIndex(docs.sparkSession).insert(docs, id_col, text_col).apply(docs, id_col, text_col, digest)
