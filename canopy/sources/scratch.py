"""Tables that cut lineage, in the folder that spark.checkpoint.dir names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it.

    Unset (as in tests on one machine), a temporary folder stands in; a cluster without the
    setting gets a folder in its warehouse, never a machine-local one.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        local = sc.master.startswith("local[") or sc.master == "local"
        at = f"file://{tempfile.mkdtemp(prefix='canopy-')}" if local else f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
        sc.setCheckpointDir(at)
    return at.rstrip("/")


#: Rows of a narrow table that one file may hold at least.
FILE_ROWS = 100_000


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.at, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame, rows: int | None = None) -> DataFrame:
        """Write df and read it back.

        rows: about how many rows a narrow df has at most. Then it is written in no more files than they need; else
        a small table would leave a file in each of many partitions. It never raises the number of partitions.
        """
        self.n += 1
        path = f"{self.at}/{self.n}"
        (df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._canopy_path = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        """Delete tables that keep() wrote and that no later step reads."""
        for df in dfs:
            self._delete(df._canopy_path)

    def clear(self) -> None:
        """Delete all tables of this scratch, once no plan reads them any more."""
        self._delete(self.at)

    def _delete(self, at: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
