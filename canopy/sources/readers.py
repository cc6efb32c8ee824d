"""Readers of the text formats that annotations come in, as DataFrames."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def decimal_comma(c: Column) -> Column:
    return F.regexp_replace(c, ",", ".").cast("double")


def read_camera_csv(spark: SparkSession, path: str) -> DataFrame:
    """name, latitude, longitude from a semicolon CSV with decimal commas; trailing x of a name goes."""
    raw = spark.read.option("sep", ";").option("header", True).csv(path)
    name, lat, lon = raw.columns[:3]
    return raw.select(F.rtrim(F.col(name), F.lit("x")).alias("name"), decimal_comma(F.col(lat)).alias("latitude"), decimal_comma(F.col(lon)).alias("longitude"))


def unique_lookup(df: DataFrame, key: str, value: str) -> DataFrame:
    """Values of the keys that occur exactly once."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.first(value).alias(value)).where("n = 1").drop("n")


def json_map(c: Column) -> Column:
    """A JSON object of strings as a map."""
    return F.from_json(c, "map<string,string>")


def tracked_boxes(labels: Column) -> Column:
    """Nested tracker output, one array of boxes for each frame."""
    return F.from_json(labels, "array<array<struct<class:int,id:int,center_x:double,center_y:double,w:double,h:double>>>")


def read_xml_images(spark: SparkSession, path: str) -> DataFrame:
    """name, label, left, top, right, bottom, rle of every mask of an annotation export; images without masks give no rows."""
    schema = "_name string, _width int, _height int, mask array<struct<_label:string,_rle:string,_left:int,_top:int,_width:int,_height:int>>"
    raw = spark.read.format("xml").option("rowTag", "image").schema(schema).load(path)
    return raw.select(F.col("_name").alias("name"), F.explode("mask").alias("m")).select(
        "name", F.col("m._label").alias("label"), F.col("m._left").alias("left"), F.col("m._top").alias("top"),
        (F.col("m._left") + F.col("m._width")).alias("right"), (F.col("m._top") + F.col("m._height")).alias("bottom"),
        F.split(F.col("m._rle"), r",\s*").cast("array<int>").alias("rle"),
    )


def yolo_row(line: Column) -> Column:
    """Numbers of one annotation line; null where the line is blank."""
    return F.when(F.trim(line) != "", F.split(F.trim(line), r"\s+").cast("array<double>"))


def read_yolo(spark: SparkSession, path: str) -> DataFrame:
    """path, line numbers lost: one row for each non-blank line, as an array of numbers."""
    return spark.read.text(path).select(F.input_file_name().alias("path"), yolo_row(F.col("value")).alias("box")).where("box is not null")


def list_files(spark: SparkSession, path: str, glob: str = "*.{mp4,avi}") -> DataFrame:
    """path of every file below a folder that matches; names that start with a dot are skipped. Contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return found.select("path").where(~F.element_at(F.split("path", "/"), -1).startswith("."))


def key_values(line: Column) -> Column:
    """`key value` tokens of one line as a map; the value Inf stands for unknown and becomes -1."""
    pairs = F.regexp_extract_all(line, F.lit(r"(\w+) (\S+)"), F.lit(0))
    return F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.split_part(p, F.lit(" "), F.lit(1)).alias("key"), F.when(F.split_part(p, F.lit(" "), F.lit(2)) == "Inf", "-1").otherwise(F.split_part(p, F.lit(" "), F.lit(2))).alias("value"))))


def read_npy(spark: SparkSession, ids: str, vectors: str, rows: int = 65536) -> DataFrame:
    """id, v from two array files in a folder that all executors see: whole numbers, and a vector for each. Tasks map
    ranges of rows, so no task and no driver holds a file; the driver reads the shapes."""
    n, shape = np.load(ids, mmap_mode="r").shape[0], np.load(vectors, mmap_mode="r").shape
    if len(shape) != 2 or shape[0] != n:
        raise ValueError(f"{n} ids do not fit vectors of shape {shape}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, x = np.load(ids, mmap_mode="r"), np.load(vectors, mmap_mode="r")
        for batch in batches:
            for k in batch["id"].to_pylist():
                at = slice(k * rows, min(n, (k + 1) * rows))
                flat = pa.array(np.ascontiguousarray(x[at]).reshape(-1).astype(np.float32))
                lists = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, shape[1], dtype=np.int32), flat)
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(i[at]).astype(np.int64)), lists], ["id", "v"])

    parts = -(-n // rows)
    return spark.range(0, parts, 1, max(1, parts)).mapInArrow(run, "id bigint, v array<float>")


def read_table(spark: SparkSession, uri: str, table: str, key: str | None = None, parts: int = 16, **options: str) -> DataFrame:
    """A table of a database (jdbc:...) or of a folder of Parquet files. With key, a whole number, a database is read
    in ranges of it, one query for each part; else by one task."""
    if not uri.startswith("jdbc:"):
        return spark.read.parquet(f"{uri.rstrip('/')}/{table}.parquet")

    def load(**how: str) -> DataFrame:
        return spark.read.format("jdbc").options(url=uri, **options, **how).load()

    if key is None:
        return load(dbtable=table)
    quoted = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(uri).quoteIdentifier(key)
    low, high = load(query=f"select min({quoted}) as low, max({quoted}) as high from {table}").first()
    if low is None:
        return load(dbtable=table)
    return load(dbtable=table, partitionColumn=key, lowerBound=str(low), upperBound=str(high + 1), numPartitions=str(parts))


def kept(spark: SparkSession, folder: str, key: tuple[str, ...], make: Callable[[], DataFrame]) -> DataFrame:
    """The table that make() gives, written below a shared folder under a hash of key, and read from there the next
    time. A table that was not written to its end is made again."""
    at = f"{folder.rstrip('/')}/{hashlib.sha256(chr(0).join(key).encode()).hexdigest()}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)
