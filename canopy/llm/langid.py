"""Language identification by segmentation-marginalised unigrams.

Over the fixed vocabulary of a public piece model, each language has piece probabilities. The
probability of a word is the sum over all its segmentations into pieces, which a forward algorithm
gives; a text's is the product over its words. The forward pass runs in numpy over many words at
once: substrings are followed through a hash table of the pieces' prefixes. Words of any length are summed
whole: beyond SHORT codepoints in logarithms, over a window as wide as the longest piece.

Training is one expectation step: under the vocabulary's own order (Zipf), forward and backward
passes give the expected number of times that each piece is used in each language's words. It
reads a documented sample of labelled documents of every language (about `sample` documents each);
only the table of expected counts, of vocabulary size, reaches the driver.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopy.llm._util import as_bytes, crc_mod, prepare

#: Probabilities of words up to this many codepoints fit a double; those of longer ones are kept as logarithms.
SHORT = 32
#: Training alone reads longer words in parts of this many codepoints.
PART = 4096
#: Codepoints of one grid of words, about.
CELLS = 1 << 20
#: Probability of a codepoint that no piece covers.
FLOOR = 1e-7
#: Words whose probabilities a Python worker holds, and their codepoints.
CACHE, CACHE_POINTS = 300_000, 1 << 24
UNDETERMINED = "und"


class Pieces:
    """A vocabulary and the forward algorithm over it. A word starts with the mark that the vocabulary uses."""

    def __init__(self, pieces: list[str]) -> None:
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        prefixes: dict[int, int] = {}
        for i, p in enumerate(pieces):
            h = 0
            for k, c in enumerate(p):
                h = _extend(h, ord(c))
                prefixes.setdefault(h, -1)
            prefixes[h] = i
        bits = max(8, (4 * len(prefixes)).bit_length())
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.keys = np.zeros(1 << bits, np.uint64)  # 0 is free
        self.values = np.full(1 << bits, -1, np.int32)
        for h, i in prefixes.items():
            slot = (h * _MIX & _ALL) >> int(self.shift)
            while self.keys[slot]:
                slot = (slot + 1) & self.mask
            self.keys[slot], self.values[slot] = h, i

    @classmethod
    def from_model(cls, path: str) -> Pieces:
        from sentencepiece import SentencePieceProcessor

        m = SentencePieceProcessor(model_file=path)
        some = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        return cls([m.id_to_piece(i) for i in some])

    def look(self, h: np.ndarray) -> np.ndarray:
        """Piece id of each hash, -1 for a mere prefix, -2 for neither."""
        slot = ((h * np.uint64(_MIX)) >> self.shift).astype(np.int64)
        held = self.keys[slot]
        out = np.where(held == h, self.values[slot], -2)
        todo = np.flatnonzero((held != h) & (held != 0))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & self.mask
            held = self.keys[slot]
            hit = held == h[todo]
            out[todo[hit]] = self.values[slot[hit]]
            go = ~hit & (held != 0)
            todo, slot = todo[go], slot[go]
        return out

    def spans(self, grid: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, length, rows, pieces): the pieces that rows hold there, by start, then length."""
        for start in range(grid.shape[1]):
            rows = np.flatnonzero(size > start)
            h = np.zeros(len(rows), np.uint64)
            for length in range(1, self.longest + 1):
                fits = size[rows] >= start + length
                rows, h = rows[fits], h[fits]
                if not len(rows):
                    break
                h = (h ^ grid[rows, start + length - 1]) * np.uint64(_STEP) + np.uint64(1)
                h ^= h >> np.uint64(31)
                found = self.look(h)
                whole = found >= 0
                if length == 1:  # any codepoint is a piece of its own, known or not
                    yield start, 1, rows, np.where(whole, found, -1)
                elif whole.any():
                    yield start, length, rows[whole], found[whole]
                go = found > -2
                rows, h = rows[go], h[go]
                if not len(rows):
                    break

    def forward(self, words: list[str], prob: np.ndarray) -> np.ndarray:
        """Log probability of each word under each column of prob (pieces by columns; the last row is the floor)."""
        out = np.zeros((len(words), prob.shape[1]))
        for rows, grid, size in _grids(words):
            if grid.shape[1] > SHORT:
                out[rows] = self._forward_long(grid, size, np.log(prob))
                continue
            alpha = np.zeros((grid.shape[1] + 1, len(rows), prob.shape[1]))
            alpha[0] = 1
            for start, length, some, found in self.spans(grid, size):
                alpha[start + length, some] += alpha[start, some] * prob[found]
            out[rows] = np.log(alpha[size, np.arange(len(rows))])
        return out

    def _forward_long(self, grid: np.ndarray, size: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """The same in logarithms; what lies further back than the longest piece is forgotten. size ascends."""
        window, n = self.longest + 1, len(size)
        out = np.zeros((n, logs.shape[1]))
        alpha = np.full((window, n, logs.shape[1]), -np.inf)
        alpha[0] = 0
        at = 0
        for start, length, some, found in self.spans(grid, size):
            if start > at:  # every position of the longest word has a piece
                alpha[at % window] = -np.inf
                at = start
                done = slice(*np.searchsorted(size, [start, start + 1]))
                out[done] = alpha[start % window, done]
            to = (start + length) % window
            alpha[to, some] = np.logaddexp(alpha[to, some], alpha[start % window, some] + logs[found])
        done = slice(np.searchsorted(size, grid.shape[1]), n)
        out[done] = alpha[grid.shape[1] % window, done]
        return out

    def expected(self, words: list[str], times: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Expected uses of each piece (and of the floor) in words that occur times (words by languages)."""
        out = np.zeros((len(self.pieces) + 1, times.shape[1]))
        parts, owner = [], []
        for i, w in enumerate(words):
            for a in range(0, len(w), PART):
                parts.append(w[a : a + PART])
                owner.append(i)
        logs = np.log(base)
        for rows, grid, size in _grids(parts):
            n, own, end = len(rows), np.array(owner, np.int64)[rows], np.arange(len(rows))
            spans = list(self.spans(grid, size))
            short = grid.shape[1] <= SHORT
            alpha, beta = (np.full((grid.shape[1] + 1, n), 0.0 if short else -np.inf) for _ in "ab")
            alpha[0] = beta[size, end] = 1 if short else 0
            for start, length, some, found in spans:
                if short:
                    alpha[start + length, some] += alpha[start, some] * base[found]
                else:
                    alpha[start + length, some] = np.logaddexp(alpha[start + length, some], alpha[start, some] + logs[found])
            total = alpha[size, end]
            for start, length, some, found in reversed(spans):
                if short:
                    beta[start, some] += base[found] * beta[start + length, some]
                else:
                    beta[start, some] = np.logaddexp(beta[start, some], logs[found] + beta[start + length, some])
            for start, length, some, found in spans:
                if short:
                    use = alpha[start, some] * base[found] * beta[start + length, some] / total[some]
                else:
                    use = np.exp(alpha[start, some] + logs[found] + beta[start + length, some] - total[some])
                for k in range(times.shape[1]):
                    out[:, k] += np.bincount(found % len(out), use * times[own[some], k], len(out))
        return out


_ALL = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15
_MIX = 0xC2B2AE3D27D4EB4F


def _extend(h: int, c: int) -> int:
    h = ((h ^ c) * _STEP + 1) & _ALL
    return h ^ h >> 31


def _grids(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words as (places in the list, codepoints padded with 0, sizes), sizes ascending, of bounded size together.
    Words of over SHORT codepoints have grids of their own; empty words have none."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(size, kind="stable")
    at, edge = int((size == 0).sum()), int((size <= SHORT).sum())
    while at < len(order):
        stop = edge if at < edge else len(order)
        own = size[order[at : min(stop, at + 16_384)]]
        fits = own * np.arange(1, len(own) + 1) <= CELLS
        n = max(1, len(own) if fits.all() else int(fits.argmin()))
        some, own = order[at : at + n], own[:n]
        grid = np.zeros((n, int(own[-1])), np.uint64)
        flat = np.frombuffer("".join(words[i] for i in some.tolist()).encode("utf-32-le", "surrogatepass"), "<u4")
        grid[np.arange(grid.shape[1]) < own[:, None]] = flat
        yield some, grid, own
        at += n


@functools.cache
def loaded(path: str) -> Pieces:
    return Pieces.from_model(path)


def words_of(text: str) -> list[str]:
    return text.lower().split()


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def zipf(n: int) -> np.ndarray:
    """Probabilities of pieces by their place in the vocabulary, and the floor."""
    p = 1 / (np.arange(n) + 20.0)
    return np.append(p / p.sum(), FLOOR)


def train(docs: DataFrame, path: str, is_train: Column, sample: int = 1500, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, piece probabilities by language) from labelled rows that is_train selects.

    sample: about so many documents of each language are read; they are picked by a hash of the id and the text.
    """
    spark = prepare(docs.sparkSession)
    labelled = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), is_train.alias("own")).where("own and lang is not null")
    known = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(known)
    if not langs:
        return [], np.zeros((0, 0))
    share = F.create_map(*(F.lit(x) for k, n in known.items() for x in (k, min(1.0, sample / n))))
    picked = labelled.where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 62)) < (share[F.col("lang")] * float(1 << 62)).cast("bigint"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = loaded(path)
        base, n = zipf(len(vocabulary.pieces)), {k: i for i, k in enumerate(langs)}
        total = np.zeros((len(vocabulary.pieces) + 1, len(langs)))
        for batch in batches:
            counts = [Counter() for _ in langs]
            for lang, text in zip(batch["lang"].to_pylist(), as_bytes(batch["text"])):
                counts[n[lang]].update(words_of(text.decode("utf-8", "replace")))
            words = list(set().union(*counts))
            times = np.array([[c.get(w, 0) for c in counts] for w in words], float).reshape(len(words), len(langs))
            total += vocabulary.expected([f"▁{w}" for w in words], times, base)
        piece, lang = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(total[piece, lang])], ["lang", "piece", "n"])

    seen = picked.select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(run, "lang int, piece int, n double")
    table = seen.groupBy("lang", "piece").agg(F.sum("n").alias("n")).toArrow()  # at most vocabulary x languages
    size = len(loaded(path).pieces)
    counts = np.zeros((size + 1, len(langs)))
    counts[table["piece"].to_numpy(), table["lang"].to_numpy()] = table["n"].to_numpy()
    return langs, smoothed(counts)


def smoothed(counts: np.ndarray) -> np.ndarray:
    """Piece probabilities: counts, pulled towards the vocabulary's order; the last row stays the floor."""
    base = zipf(len(counts) - 1)[:-1, None]
    seen = counts[:-1]
    prob = (seen + 50.0 * base) / (seen.sum(axis=0) + 50.0)
    return np.vstack([np.maximum(prob, FLOOR / 10), np.full((1, counts.shape[1]), FLOOR)])


class Scorer:
    """Text scores with a bounded cache of words."""

    def __init__(self, pieces: Pieces, langs: list[str], prob: np.ndarray) -> None:
        self.pieces, self.langs, self.prob = pieces, langs, prob
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.points = 0
        self.table = np.zeros((1 << 16, len(self.langs)))

    def score(self, texts: list[str]) -> Iterator[tuple[str, float]]:
        held = [words_of(x) for x in texts]
        if len(self.row) > CACHE or self.points > CACHE_POINTS:
            self.clear()
        fresh = list(set().union(*held).difference(self.row))
        if fresh and self.langs:
            first = len(self.row)
            self.points += sum(map(len, fresh))
            while first + len(fresh) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            for at in range(0, len(fresh), 1 << 16):
                part = fresh[at : at + (1 << 16)]
                self.table[first + at : first + at + len(part)] = self.pieces.forward([f"▁{w}" for w in part], self.prob)
            self.row.update(zip(fresh, range(first, first + len(fresh))))
        row = self.row.__getitem__
        for text, words in zip(texts, held):
            if not self.langs or not has_letter(text):
                yield UNDETERMINED, 0.0
                continue
            total = self.table[np.fromiter(map(row, words), np.int64, len(words))].sum(axis=0)
            best = int(total.argmax())
            yield self.langs[best], float(1 / np.exp(total - total[best]).sum())


_scorers: dict[str, Scorer] = {}


def scorer(key: str, path: str, langs: list[str], prob: np.ndarray) -> Scorer:
    """One scorer, with its cache, for each Python worker and model."""
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(loaded(path), langs, prob)
    return _scorers[key]


def identify(docs: DataFrame, path: str, model: tuple[list[str], np.ndarray], text_col: str = "text") -> DataFrame:
    """docs, whose columns stay, with one more: `__language`, a struct of lang and score.

    The language is `und` (score 0) where the text is null, has no letter, or no language was learned;
    of equally likely languages the first by name. Whole texts count, however long.
    """
    import uuid

    spark = prepare(docs.sparkSession)
    given, key = spark.sparkContext.broadcast(model), uuid.uuid4().hex
    names = [f"__c{i}" for i in range(len(docs.columns))]
    inner = docs.toDF(*names).withColumn("__text", F.col(names[docs.columns.index(text_col)]).cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scorer(key, path, *given.value)
        for batch in batches:
            found = list(own.score([x.decode("utf-8", "replace") for x in as_bytes(batch["__text"])]))
            both = pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], ["lang", "score"])
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), both], [*names, "__language"])

    schema = inner.drop("__text").schema.add("__language", T.StructType().add("lang", T.StringType()).add("score", T.DoubleType()))
    return inner.mapInArrow(run, schema).toDF(*docs.columns, "__language")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(crc_mod(id_col, 4) == 2, F.lit(False))


def predict(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: id, held_out, lang_pred, score. Rows with crc32(id) mod 4 = 2 are held out of training; so
    is a row without an id, which counts as not held out. A null text, or one without a letter, is `und` with score
    0; whole texts count, however long their words. Repeated rows each get a row; an empty table gives none. Columns
    that clash with these names take no part."""
    model = train(docs, path, crc_mod(id_col, 4) != 2, id_col=id_col, text_col=text_col, lang_col=lang_col)
    seen = identify(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), path, model)
    return seen.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), F.col("__language.lang").alias("lang_pred"), F.col("__language.score").alias("score"))
