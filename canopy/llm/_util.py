"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.sources.shipping import ship

#: Rows and bytes in one Arrow batch, about, at most. Documents may be large, so a batch holds few of them.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20
#: Characters that numpy steps handle at once; bounds their temporary arrays.
CHUNK_CHARS = 1 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Send this package to the executors and bound the Arrow batches, for all operators alike: the settings are
    read when a plan runs."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return ship(spark)


def sampled(df: DataFrame, hash_col: str, share: float) -> DataFrame:
    """About that share of the rows: those whose hash (64 bits) falls under it. The hash has 62 bits here, so that
    the bound on a sample holds for as many rows as there can be."""
    return df.where(F.pmod(F.col(hash_col), F.lit(1 << 62)) < F.lit(min(int(share * (1 << 62)), 1 << 62)))


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(n)


def as_bytes(col: pa.Array) -> list[bytes]:
    """Values of a binary column; null becomes empty."""
    return [x or b"" for x in col.to_pylist()]


def groups_of(texts: list, size: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about size units each (a longer row stands alone)."""
    start, held = 0, 0
    for i, x in enumerate(texts):
        if held and held + len(x) > size:
            yield start, i
            start, held = i, 0
        held += len(x)
    if start < len(texts):
        yield start, len(texts)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
