"""Table and file sources. Any Hadoop file system URI works: file, s3a, abfs, gs, hdfs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table_path(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A parquet table by name."""
    return spark.read.parquet(table_path(folder, name))


def table_exists(spark: SparkSession, folder: str, name: str) -> bool:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(table_path(folder, name))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def list_tables(spark: SparkSession, folder: str, prefix: str = "") -> list[str]:
    """Names of the parquet tables under a folder that start with a prefix."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = [s.getPath().getName() for s in found]
    return sorted(n[: -len(".parquet")] for n in names if n.endswith(".parquet") and n.startswith(prefix))


def scan_files(spark: SparkSession, path: str, glob: str = "*", content: bool = True, recursive: bool = True) -> DataFrame:
    """Files as rows: path, name, size, mtime and, unless only listing, the bytes.

    Without the content column Spark lists the files and opens none of them.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", str(recursive).lower())
        .load(path)
    )
    cols = [
        "path",
        F.regexp_extract("path", r"([^/]+)$", 1).alias("name"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("mtime"),
    ]
    return files.select(*cols, *(["content"] if content else []))
