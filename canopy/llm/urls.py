"""URL filters: host rules first, gradient-boosted trees on lexical features for the rest.

A rule names a host and a path; it fits that host and its subdomains, where the path starts with
the rule's, and the longest fitting rule decides. URLs that a rule decides are the labelled ones:
the trees are trained in numpy on a bounded sample of them (a hash of the url picks it) and judge
the others by length, depth, digit ratio, entropy, parameter counts and the like, and by statistics
of the host's suffix that are counted over all labelled URLs and joined to every URL.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopy.llm._util import prepare, sampled

#: (verdict, host, path) in the order in which they are listed.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Labelled URLs, about, that train the trees.
SAMPLE = 20_000
FEATURES = ("length", "host length", "path length", "labels in host", "depth", "digit ratio", "entropy", "parameters", "query length", "marks", "upper ratio", "fragment", "secure", "longest segment", "vowel ratio", "suffix block rate", "suffix count")


def parts(url: str | Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where it is null or lacks ://."""
    c = F.col(url) if isinstance(url, str) else url
    tail = F.regexp_extract(F.coalesce(c, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(tail, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(tail, r"(?s)^[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """A struct of the longest fitting rule and its verdict, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest comes outermost
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def features(url: str, host: str, path: str, rate: float, count: float) -> list[float]:
    """rate: the share of blocked ones among labelled URLs of the host's suffix; count: the logarithm of their number."""
    n = max(1, len(url))
    letters = np.unique(np.frombuffer(url.encode("utf-32-le", "surrogatepass"), "<u4"), return_counts=True)[1] / n
    query = url.split("#", 1)[0].partition("?")[2]
    return [
        len(url), len(host), len(path), host.count(".") + 1, sum(1 for x in path.split("/") if x), sum(map(str.isdigit, url)) / n,
        float(-(letters * np.log2(letters)).sum()), query.count("=") + query.count("&"), len(query), sum(url.count(x) for x in "-_%~+"),
        sum(map(str.isupper, url)) / n, float("#" in url), float(url[:6].lower() == "https:"), max(map(len, path.split("/"))), sum(url.count(x) for x in "aeiouAEIOU") / n, rate, count,
    ]


@dataclass
class Trees:
    """Boosted regression trees on the logistic loss; features are cut into at most 32 bins."""

    rounds: int = 40
    depth: int = 3
    rate: float = 0.2
    least: float = 5.0
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[list[tuple[int, int, float]]] = field(default_factory=list)  # a heap of (feature, bin, value); feature -1 is a leaf

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        self.base = float(np.log(share / (1 - share)))
        if not len(y) or y.min() == y.max():
            return self
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 33)[1:-1])) for j in range(x.shape[1])]
        b, z = self._binned(x), np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            tree, node = self._tree(b, y - p, p * (1 - p))
            self.trees.append(tree)
            z += self.rate * np.array([t[2] for t in tree])[node]
        return self

    def _tree(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[list[tuple[int, int, float]], np.ndarray]:
        node = np.zeros(len(b), np.int64)
        tree = [(-1, 0, 0.0)] * (2 ** (self.depth + 1) - 1)
        for at in range(len(tree)):
            rows = np.flatnonzero(node == at)
            total_g, total_h = g[rows].sum(), h[rows].sum()
            tree[at] = (-1, 0, float(total_g / (total_h + 1)))
            if at >= 2**self.depth - 1 or len(rows) < 2:
                continue
            found = (1e-6, -1, 0)
            for j, e in enumerate(self.edges):
                if not len(e):
                    continue
                sg = np.cumsum(np.bincount(b[rows, j], g[rows], len(e) + 1))[:-1]
                sh = np.cumsum(np.bincount(b[rows, j], h[rows], len(e) + 1))[:-1]
                gain = sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1)
                gain[(sh < self.least / 4) | (total_h - sh < self.least / 4)] = 0
                k = int(gain.argmax())
                if gain[k] > found[0]:
                    found = (float(gain[k]), j, k)
            if found[1] >= 0:
                tree[at] = (found[1], found[2], tree[at][2])
                node[rows] = 2 * at + 1 + (b[rows, found[1]] > found[2])
        return tree, node

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        if len(x) and self.trees:
            b = self._binned(x)
            for tree in self.trees:
                feature, edge, value = (np.array(c) for c in zip(*tree))
                node = np.zeros(len(x), np.int64)
                for _ in range(self.depth):
                    inner = feature[node] >= 0
                    go = 2 * node + 1 + (b[np.arange(len(x)), np.maximum(feature[node], 0)] > edge[node])
                    node = np.where(inner, go, node)
                z += self.rate * value[node]
        return 1 / (1 + np.exp(-z))


def with_suffixes(urls: DataFrame) -> DataFrame:
    """urls, rows (url, host, path, ruled), with rate and count of each host's suffix over all that a rule decides."""
    s = F.substring_index("host", ".", -1)
    block = (F.col("ruled.verdict") == "block").cast("int")
    seen = urls.where("ruled is not null").groupBy(s.alias("suffix")).agg(((F.sum(block) + 1) / (F.count("*") + 2)).alias("rate"), F.log1p(F.count("*")).alias("count"))
    joined = urls.withColumn("suffix", s).join(seen, "suffix", "left").drop("suffix")
    return joined.withColumns({"rate": F.coalesce("rate", F.lit(0.5)), "count": F.coalesce("count", F.lit(0.0))})


def train(urls: DataFrame) -> Trees:
    """Trees from rows (url, host, path, ruled, rate, count) that a rule decides; label 1 is block."""
    own = urls.where("ruled is not null").select("url", "host", "path", "rate", "count", (F.col("ruled.verdict") == "block").cast("int").alias("y"), F.xxhash64("url").alias("hash"))
    share = min(1.0, SAMPLE / max(1, own.count()))
    # a url that a third of all rows hold counts once; the order makes the picked rows the same ones each time
    rows = sampled(own, "hash", share).dropDuplicates(["url"]).orderBy("hash").limit(2 * SAMPLE).collect()
    rows.sort(key=lambda r: r["url"])
    x = np.array([features(r["url"], r["host"], r["path"], r["rate"], r["count"]) for r in rows], float).reshape(len(rows), len(FEATURES))
    # a suffix's rate tells most of a rule; noise on it keeps the other features in use
    x[:, FEATURES.index("suffix block rate")] = np.where(np.arange(len(x)) % 3 == 0, 0.5, x[:, FEATURES.index("suffix block rate")])
    return Trees().fit(x, np.array([r["y"] for r in rows], float))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: id, host, path, rule (null where none fits), verdict, block_score.

    A null url, or one without ://, has an empty host and path and is judged by the trees. Whole urls count, however
    long. Repeated rows each get a row; an empty table gives none. Other columns of pages, whatever their names, take
    no part. Where no rule decides any url the trees have nothing to learn from and allow all.
    """
    spark = prepare(pages.sparkSession)
    host, path = parts(url_col)
    given = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    given = with_suffixes(given.withColumn("ruled", ruled(F.col("host"), F.col("path"))))
    model = spark.sparkContext.broadcast(train(given))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(*row) for row in zip(*(batch[c].to_pylist() for c in ("url", "host", "path", "rate", "count")))], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("id", "host", "path", "rule", "verdict")), pa.array(model.value.probability(x))], ["id", "host", "path", "rule", "verdict", "block_score"])

    kind = given.schema["id"].dataType.simpleString()
    flat = given.select("id", "url", "host", "path", "rate", "count", F.col("ruled.rule").alias("rule"), F.col("ruled.verdict").alias("verdict"))
    out = flat.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string, block_score double")
    own = F.when(F.col("block_score") > 0.5, "block").otherwise("allow")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", own).alias("verdict"), "block_score")
