"""A corpus from documents to packed sequences, in stages that each write a table for the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.llm import langid, line_dedup, near_copies, packing, quality
from canopy.llm._util import crc_mod, table
from canopy.sources.scratch import Scratch

#: Least score of a language that counts as known.
SURE = 0.5


# Each stage keeps the columns of docs (but the last) and whatever other columns they have, gives an empty table for an
# empty one, and treats a null text as an empty one and texts whole, however long.


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without a letter (a null text among them) and those between languages
    go. Repeated rows stay or go together. Without a labelled document nothing is known, and all go."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = langid.train(docs, path, crc_mod("id", 4) != 2)
    found = langid.identify(docs, path, model)
    return found.where((F.col("__language.lang") != langid.UNDETERMINED) & (F.col("__language.score") >= SURE)).select(*docs.columns)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold. Repeated rows stay or go together; labels of ids that are
    null or not in docs take no part. Without labels of both kinds all have one score, the labels' mean or 0.5."""
    machine = quality.train(docs, table(spark, sf_dir, "labels"), crc_mod("id", 4) != 2)
    return quality.score_column(docs, machine).where(F.col("__quality") >= quality.THRESHOLD).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that a document of a smaller id holds; n_chars, if there is one, follows the text. A
    null text becomes an empty one. Rows that repeat an id are one document; those without an id come after all others."""
    carry = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    kept = line_dedup.LineIndex(spark).insert(docs).apply(docs, carry=carry)
    return kept.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (0.8 or more of their five-word shingles in common, found by
    SimHash and, between what that leaves apart, exactly): the one of the smallest id, and of rows that repeat it the one whose text has the smallest hash. Documents without an id
    count after all others, in the order of that hash. Texts without words are one group."""
    text = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    own = F.struct(F.coalesce(F.col("doc_id"), F.lit(1 << 62) + F.pmod(text, F.lit(1 << 61))).alias("id"), text.alias("text"))
    named = docs.withColumn("__row", own)
    found = near_copies.near_copies(named, id_col="__row")
    stays = found.where(F.col("__row") == F.col("component_id")).select("__row").distinct()
    return named.join(stays, "__row", "left_semi").dropDuplicates(["__row"]).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows and their places in sequences of at most 1024 tokens: see packing.pack_documents. Every
    row is packed, also if its id is null or repeated; a null or empty text is one token, its end."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("quality", good), ("line dedup", lines), ("near duplicates", copies), ("packing", pack)]

#: The language and quality stages learn a model, which SQL cannot.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole documents table. A stage's table is deleted when the next one is written."""
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        was, docs = docs, scratch.keep(stage(spark, docs, sf_dir))
        if k:
            scratch.drop(was)
    return STAGES[-1][1](spark, docs, sf_dir)
