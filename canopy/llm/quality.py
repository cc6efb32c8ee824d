"""Quality scores by a factorisation machine.

A document is a sparse vector: hashed words (weights of log counts, of unit length together),
structure statistics of its bytes and words, and its size. The machine adds to a linear model the
products of all pairs of features, weighted by inner products of low-rank factors; the sum over
pairs is half of (the square of the sum, less the sum of the squares), so scoring takes time linear
in the features.

The machine is fitted in numpy on the driver from a documented sample of about `sample` labelled
rows (a hash of the id picks them); feature vectors, not texts, reach the driver. They are bounded
by the number of hash buckets. Scoring reads every whole text.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.llm._util import as_bytes, crc_mod, prepare, sampled

BUCKETS = 1 << 14
RANK = 8
THRESHOLD = 0.7
#: Dense features after the hashed words.
STRUCTURE = ("upper", "digit", "blank", "newline", "stop", "mark", "bar", "rare sign", "other sign", "high", "word length", "distinct words", "most frequent word", "doubled words", "log size", "log words", "capital words", "signed words")


def _classes() -> np.ndarray:
    """For each byte the column of its count among the first ten structure features, or 10."""
    out = np.full(256, 10, np.int64)
    for column, chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r", b"\n", b".,;:", b"!?", b"|", b"#$%&*@~^", b"\"'()[]{}<>/\\=+-_`")):
        out[list(chars)] = column
    out[128:] = 9
    return out


_CLASSES = _classes()


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (distinct) and values of a text's features."""
    words = text.split()
    counts = Counter(words)
    n = max(1, len(words))
    byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    share = np.bincount(_CLASSES, byte, 11)[:10] / max(1, len(text))
    doubled = sum(map(bytes.__eq__, words, words[1:]))
    capital = sum(c for w, c in counts.items() if w.isupper() and len(w) > 1)
    signed = sum(c for w, c in counts.items() if not w[-1:].isalnum() and w[-1] < 128 and w[-1] not in b".,;:!?")
    top = max(counts.values(), default=0)
    dense = np.concatenate([share * 5, [len(text) / n / 10, len(counts) / n, top / n, doubled / n, np.log1p(len(text)) / 10, np.log1p(n) / 10, capital / n, signed / n]])
    at = np.fromiter((zlib.crc32(w) % BUCKETS for w in counts), np.int64, len(counts))
    bag = np.bincount(at, np.fromiter(counts.values(), float, len(counts)), BUCKETS) if len(counts) > BUCKETS // 8 else None
    if bag is None:
        where, inverse = np.unique(at, return_inverse=True)
        value = np.bincount(inverse, np.fromiter(counts.values(), float, len(counts)), len(where)) if len(where) else np.zeros(0)
    else:
        where = np.flatnonzero(bag)
        value = bag[where]
    value = np.log1p(value)
    norm = np.sqrt((value**2).sum())
    return np.concatenate([where, BUCKETS + np.arange(len(STRUCTURE))]), np.concatenate([value / norm if norm else value, dense])


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray  # features by rank
    constant: float | None = None  # the score, where there was nothing to learn from

    def margins(self, first: np.ndarray, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Of documents whose features start at first in the flat arrays; none may be empty."""
        linear = np.add.reduceat(self.weights[at] * value, first)
        scaled = self.factors[at] * value[:, None]
        total = np.add.reduceat(scaled, first)
        squares = np.add.reduceat((scaled**2).sum(axis=1), first)
        return self.bias + linear + 0.5 * ((total**2).sum(axis=1) - squares)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        out = np.zeros(len(texts))
        for a in range(0, len(texts), 64):
            held = [features(x) for x in texts[a : a + 64]]
            first = np.cumsum([0, *(len(x) for x, _ in held[:-1])])
            z = self.margins(first, np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
            out[a : a + 64] = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        return out


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, rate: float = 0.05, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Adagrad on the logistic loss."""
    size = BUCKETS + len(STRUCTURE)
    if len(set(labels.tolist())) < 2:
        return Machine(0.0, np.zeros(0), np.zeros((0, RANK)), float(labels.mean()) if len(labels) else 0.5)
    rng = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(size), rng.normal(0, 0.05, (size, RANK)))
    weight_sum, factor_sum, bias_sum = np.full(size, 1e-6), np.full((size, RANK), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(order), 64):
            some = order[a : a + 64]
            at, value = np.concatenate([rows[i][0] for i in some]), np.concatenate([rows[i][1] for i in some])
            count = np.array([len(rows[i][0]) for i in some])
            first = np.cumsum(count) - count
            z = m.margins(first, at, value)
            slope = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[some]) / len(some)
            scaled = m.factors[at] * value[:, None]
            total = np.repeat(np.add.reduceat(scaled, first), count, axis=0)
            each = np.repeat(slope, count) * value
            where, inverse = np.unique(at, return_inverse=True)
            g = np.bincount(inverse, each, len(where)) + decay * m.weights[where]
            gf = np.stack([np.bincount(inverse, each * (total[:, k] - scaled[:, k]), len(where)) for k in range(RANK)], axis=1) + decay * m.factors[where]
            weight_sum[where] += g**2
            factor_sum[where] += gf**2
            bias_sum += slope.sum() ** 2
            m.weights[where] -= rate * g / np.sqrt(weight_sum[where])
            m.factors[where] -= rate * gf / np.sqrt(factor_sum[where])
            m.bias -= rate * slope.sum() / np.sqrt(bias_sum)
    return m


def train(docs: DataFrame, labels: DataFrame, is_train: Column, sample: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Machine:
    """A machine from rows of docs that labels marks and is_train (over the column id) selects.

    sample: about so many labelled ids are used. Ids that labels marks twice count by the larger mark; of rows of
    docs that repeat an id one is used (of the least hash of its text).
    """
    spark = prepare(docs.sparkSession)
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where(is_train & F.col("label").isNotNull())
    n = own.count()
    picked = sampled(own.withColumn("hash", F.xxhash64("id", F.lit(3))), "hash", min(1.0, sample / max(1, n))).groupBy("id").agg(F.max("label").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [features(x) for x in as_bytes(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], pa.array([x.astype(np.int32) for x, _ in held], pa.list_(pa.int32())), pa.array([y.astype(np.float32) for _, y in held], pa.list_(pa.float32()))], ["id", "label", "at", "value"])

    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    joined = given.join(F.broadcast(picked), "id").select("id", F.col("label").cast("int").alias("label"), "text")  # picked has about `sample` rows, whatever the size of labels
    joined = joined.groupBy("id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    kind = joined.schema["id"].dataType.simpleString()
    table = joined.mapInArrow(run, f"id {kind}, label int, at array<int>, value array<float>").toArrow().sort_by("id")
    rows = [(x.values.to_numpy().astype(np.int64), y.values.to_numpy().astype(float)) for x, y in zip(table["at"], table["value"])]
    return fit(rows, (table["label"].to_numpy() > 0).astype(float) if len(rows) else np.zeros(0))


def score_column(docs: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """docs, whose columns stay, with one more: `__quality`, the score (0 to 1). Null text counts as empty."""
    spark = prepare(docs.sparkSession)
    model = spark.sparkContext.broadcast(machine)
    names = [f"__c{i}" for i in range(len(docs.columns))]
    inner = docs.toDF(*names).withColumn("__text", F.col(names[docs.columns.index(text_col)]).cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(model.value.scores(as_bytes(batch["__text"])))], [*names, "__quality"])

    return inner.mapInArrow(run, inner.drop("__text").schema.add("__quality", T.DoubleType())).toDF(*docs.columns, "__quality")


def predict(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, score, predicted. Labels of ids with crc32(id) mod 4 = 2 are held out; a row without
    an id counts as not held out. A null text counts as empty; whole texts count, however long. Repeated rows each
    get a row; an empty table gives none; without labels of both kinds every score is the same (their mean, or 0.5).
    Other columns, whatever their names, take no part."""
    machine = train(docs, labels, crc_mod("id", 4) != 2, id_col=id_col, text_col=text_col)
    seen = score_column(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), machine)
    held = F.coalesce(crc_mod("id", 4) == 2, F.lit(False))
    return seen.select(F.col("id").alias(id_col), held.alias("held_out"), F.col("__quality").alias("score"), (F.col("__quality") >= THRESHOLD).cast("int").alias("predicted"))
