"""Exact top-k search by inner product over a pivot-distance index.

Index. Vectors become integers, floor(scale * x). Pivots come from a bounded sample. Every vector is
keyed by its nearest pivot and its distance to it; vectors sorted by that key are cut into annuli of
bounded size, each with the least and greatest distance and the greatest norm in it. An annulus is stored as one or
more rows of at most CHUNK vectors.

Search. First each query expands the annuli of its own pivot that are nearest to its distance, until
k candidates are at hand: the k-th best score is a threshold. Then the triangle inequality bounds
what any other annulus can hold: a vector at distance r from a pivot p is at least |d(q, p) - r| from
q, and q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2. Annuli whose bound is under the threshold are never
read for that query. Scores are whole numbers, computed exactly; bounds are floating point, with room for its errors.

Queries travel in blocks, annuli are rows, and both meet in an equi-join on the annulus; no row
holds more than a block of queries, and no group is gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from canopy.llm._util import prepare, sampled
from canopy.sources.scratch import Scratch

#: Pivots; the sample from which they come holds at most PIVOT_SAMPLE vectors.
PIVOTS, PIVOT_SAMPLE = 24, 2000
#: Vectors in one annulus, at least, and how many annuli there are, about, at most.
ANNULUS, MOST_ANNULI = 1024, 50_000
#: Vectors in one row of an annulus, at most.
CHUNK = 1024
#: Queries in one block, at most, and pairs of a query and an annulus that are bounded at once, about.
BLOCK, BOUNDS = 512, 1 << 21
#: Whole numbers beyond these, of components and of scores, count as the nearer of the two.
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Share of the squares that the errors of floating point distances may make.
SLACK = 1e-6


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows, exact: by floating point where its 53 bits are enough."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    bound = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * max(1, a.shape[1])
    if bound < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, LEAST, MOST).astype(np.int64)


def best(ids: np.ndarray, got: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(got) > 4 * k:
        least = np.partition(got, len(got) - k)[len(got) - k]
        some = np.flatnonzero(got >= least)
    else:
        some = np.arange(len(got))
    return some[np.lexsort((ids[some], ~got[some]))[:k]]


def _rows(column: pa.Array, dim: int, scale: float) -> np.ndarray:
    """floor(scale * x) of vectors, filled with zeros up to dim."""
    size = np.diff(column.offsets.to_numpy())
    flat = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    inner = np.abs(flat) < float(1 << 63)
    flat = np.where(inner, np.where(inner, flat, 0).astype(np.int64), np.where(flat > 0, MOST, LEAST))
    if (size == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(size), dim), np.int64)
    out[np.arange(dim) < size[:, None]] = flat
    return out


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d = (x.astype(np.float64) ** 2).sum(axis=1)[:, None] - 2 * x.astype(np.float64) @ pivots.T + (pivots**2).sum(axis=1)
    return np.sqrt(np.maximum(d, 0))


def top_k(vectors: DataFrame, is_query, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score) of the k best rows, other than the query's own id, for each row that is_query selects.

    is_query: a condition over the column id. Ties go to the smaller id; a query with fewer than k
    other rows gets them all. Rows take no part if the id or vector is null, or the vector
    holds a null, NaN or infinity. A shorter vector counts as filled with zeros, and an empty one as zeros only. Whole
    numbers that 64 bits cannot hold, of components as of scores, count as the nearest that they can. Rows that repeat a
    query are searched once (with different vectors under one id, the best over all of them count); rows
    that repeat another's id and vector are candidates each. An empty table gives no rows.
    """
    spark = prepare(vectors.sparkSession)
    scratch = Scratch(spark, "topk")
    v = F.col("v")
    given = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    good = given.where(F.col("id").isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    facts = good.agg(F.count("*").alias("n"), F.max(F.size(v)).alias("dim"), F.max(F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))).alias("top")).first()
    n, dim, top = facts["n"], facts["dim"] or 1, scale * (facts["top"] or 0.0) + 1
    kind = np.dtype(np.int16 if top < 1 << 15 else np.int32 if top < 1 << 31 else np.int64)  # vectors travel in as few bytes as all fit in
    share = min(1.0, PIVOT_SAMPLE / max(1, n))
    sample = sampled(good.withColumn("hash", F.xxhash64("id", "v")), "hash", share).dropDuplicates(["hash"]).orderBy("hash").limit(2 * PIVOT_SAMPLE).select("id", "v").toArrow().sort_by("id")
    pivots = np.zeros((1, dim))
    if len(sample):
        drawn = _rows(sample["v"].combine_chunks(), dim, scale)
        pivots = _spread(np.unique(drawn, axis=0).astype(np.float64), PIVOTS)
    each = max(ANNULUS, -(-n // MOST_ANNULI))
    names = ["id", "pivot", "distance", "vector"]

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch["v"], dim, scale)
            d = _distances(x, pivots)
            near = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(x)), near]), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())], names)

    keyed = scratch.keep(good.select(F.col("id").cast("bigint").alias("id"), "v").mapInArrow(key, "id bigint, pivot int, distance double, vector binary"))
    parts = max(1, min(-(-n // (8 * each)), 4 * spark.sparkContext.defaultParallelism, 10_000))
    # the id spreads many equal vectors, which have equal keys, over the ranges
    ranged = keyed.repartitionByRange(parts, "pivot", "distance", "id").sortWithinPartitions("pivot", "distance", "id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of at most CHUNK vectors; those of one annulus follow each other."""
        part, nth, held, pivot = TaskContext.get().partitionId() << 32, -1, 0, None
        for batch in batches:
            p, ids, dist = (batch[c].to_numpy() for c in ("pivot", "id", "distance"))
            x = np.frombuffer(b"".join(batch["vector"].to_pylist()), kind).reshape(len(p), -1)
            at = 0
            while at < len(p):
                if p[at] != pivot or held >= each:
                    pivot, nth, held = int(p[at]), nth + 1, 0
                stop = min(at + min(CHUNK, each - held), at + int(np.searchsorted(p[at:], pivot, side="right")))
                some = x[at:stop]
                norm = float((some.astype(np.float64) ** 2).sum(axis=1).max())
                row = (part + nth, pivot, float(dist[at]), float(dist[stop - 1]), norm, stop - at, ids[at:stop].tobytes(), some.tobytes())
                held += stop - at
                at = stop
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.binary(), pa.binary()))], ["annulus", "pivot", "low", "high", "norm", "n", "ids", "vectors"])

    annuli = scratch.keep(ranged.mapInArrow(cut, "annulus bigint, pivot int, low double, high double, norm double, n bigint, ids binary, vectors binary"))
    stats = annuli.groupBy("annulus", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("norm").alias("norm"), F.sum("n").alias("n"))
    # a row of numbers for each annulus: their number is bounded by MOST_ANNULI and the ends of ranges
    stats = stats.toArrow().sort_by([("pivot", "ascending"), ("low", "ascending"), ("annulus", "ascending")])
    shared = spark.sparkContext.broadcast({c: stats[c].to_numpy() for c in stats.column_names})
    block_rows = max(1, min(BLOCK, BOUNDS // max(1, stats.num_rows)))
    queries = keyed.where(is_query).select("id", "vector")

    def block(q: np.ndarray, x: np.ndarray, floor: np.ndarray, need: np.ndarray, annulus: np.ndarray) -> Iterator[pa.RecordBatch]:
        """A row for each annulus that some of these queries need."""
        for a in np.flatnonzero(need.any(axis=0)):
            some = need[:, a]
            yield pa.RecordBatch.from_arrays([pa.array([int(annulus[a])], pa.int64()), pa.array([q[some].tobytes()], pa.binary()), pa.array([x[some].tobytes()], pa.binary()), pa.array([floor[some].tobytes()], pa.binary())], ["annulus", "qids", "queries", "floor"])

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return batch["id"].to_numpy(), np.frombuffer(b"".join(batch["vector"].to_pylist()), kind).reshape(batch.num_rows, -1)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Expand the annuli of a query's pivot, nearest first, until they hold more than k rows."""
        s = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                q, x = read(batch.slice(at, block_rows))
                d = _distances(x, pivots)
                near = d.argmin(axis=1)
                own = d[np.arange(len(q)), near]
                gap = np.maximum(np.maximum(s["low"] - own[:, None], own[:, None] - s["high"]), 0)
                gap[s["pivot"] != near[:, None]] = np.inf
                order = np.argsort(gap, axis=1, kind="stable")
                before = np.cumsum(s["n"][order], axis=1) - s["n"][order]
                need = np.zeros(gap.shape, bool)
                np.put_along_axis(need, order, before <= k, axis=1)
                yield from block(q, x, np.full(len(q), np.iinfo(np.int64).min), need & np.isfinite(gap), s["annulus"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best of an annulus for each query of a block, from the query's floor up."""
        for batch in batches:
            for qids, queries, floor, ids, vectors in zip(*(batch[c].to_pylist() for c in ("qids", "queries", "floor", "ids", "vectors"))):
                q, own, low = np.frombuffer(qids, np.int64), np.frombuffer(ids, np.int64), np.frombuffer(floor, np.int64)
                got = scores(np.frombuffer(queries, kind).reshape(len(q), -1), np.frombuffer(vectors, kind).reshape(len(own), -1))
                out: list[list[np.ndarray]] = [[], [], []]
                for i in range(len(q)):
                    some = np.flatnonzero((own != q[i]) & (got[i] >= low[i]))
                    some = some[best(own[some], got[i, some], k)]
                    out[0].append(np.full(len(some), q[i]))
                    out[1].append(own[some])
                    out[2].append(got[i, some])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in out], ["query_id", "vec_id", "score"])

    blocks = "annulus bigint, qids binary, queries binary, floor binary"
    found = "query_id bigint, vec_id bigint, score bigint"
    # rows are blocks, far wider than the planner thinks: neither side may be broadcast
    body = annuli.select("annulus", "ids", "vectors").hint("shuffle_merge")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # rows of one query id with equal vectors ask the same thing once
    asked = queries.distinct()
    first = asked.mapInArrow(home, blocks).join(body, "annulus").mapInArrow(match, found)
    floor = first.distinct().withColumn("rank", F.row_number().over(place)).where(f"rank = {k}").select(F.col("query_id").alias("id"), F.col("score").alias("floor"))
    # an id may stand for several vectors; its least threshold serves them all
    asked = scratch.keep(asked.join(floor.groupBy("id").agg(F.min("floor").alias("floor")), "id", "left"))
    several = asked.groupBy("id").agg(F.count("*").alias("m")).where("m > 1").select("id")
    asked = asked.join(several.withColumn("several", F.lit(True)), "id", "left").select("id", "vector", F.when(F.col("several").isNull(), F.col("floor")).alias("floor"))

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All annuli that may hold a score of the floor or more."""
        s = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, block_rows):
                part = batch.slice(at, block_rows)
                q, x = read(part)
                floor = np.array([np.iinfo(np.int64).min if f is None else f for f in part["floor"].to_pylist()], np.int64)
                d = _distances(x, pivots)[:, s["pivot"]]
                gap = np.maximum(np.maximum(s["low"] - d, d - s["high"]), 0)
                both = (x.astype(np.float64) ** 2).sum(axis=1)[:, None] + s["norm"]
                squares = both + (pivots**2).sum(axis=1)[s["pivot"]]
                need = (both - gap**2) / 2 + 1 + SLACK * squares >= floor[:, None].astype(np.float64)
                yield from block(q, x, floor, need, s["annulus"])

    second = asked.mapInArrow(rest, blocks).join(body, "annulus").mapInArrow(match, found)
    ranked = second.withColumn("rank", F.row_number().over(place)).where(f"rank <= {k}")
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id"), "score")


def _spread(x: np.ndarray, n: int) -> np.ndarray:
    """Up to n rows far from each other: each next one is the farthest from those taken."""
    taken = [0]
    d = ((x - x[0]) ** 2).sum(axis=1)
    while len(taken) < min(n, len(x)):
        taken.append(int(d.argmax()))
        d = np.minimum(d, ((x - x[taken[-1]]) ** 2).sum(axis=1))
    return x[taken]
