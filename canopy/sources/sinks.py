"""What is written: split manifests, and plans as lines of JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_manifest(entries: DataFrame, path: str, by: str = "partition") -> None:
    """Entries in one folder for each partition. A manifest stands for copies of the files; one shuffle puts a
    partition's rows in as many files as adaptive execution finds fit."""
    entries.repartition(by).write.mode("errorifexists").partitionBy(by).parquet(path)


def write_json(rows: DataFrame, path: str) -> None:
    """Each row as one line of JSON, its keys in the order of the columns; nulls stay in."""
    line = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    rows.select(line.alias("value")).write.mode("errorifexists").text(path)
