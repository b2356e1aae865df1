"""Steps whose rows are kept in the shared folder, and whose shuffle files go as soon as they are done."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from tidewall.session import checkpoint_dir, cut_lineage


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh folder beside the checkpoints, which all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of steps that nothing refers to any more.

    Spark does so when the driver collects its garbage, which a driver with a large heap seldom does.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def settled(df: DataFrame) -> DataFrame:
    """A checkpoint of large rows; what led to them is released."""
    spark = df.sparkSession
    out = cut_lineage(df)
    del df
    release(spark)
    return out


def kept(df: DataFrame, kind: str = "step") -> DataFrame:
    """Small rows of a loop as a table in the shared folder, read again.

    A checkpoint hands on the constraints that the optimiser inferred for its rows; over the rounds of a loop they multiply
    until the driver has no memory left. A table that is read again knows of none.
    """
    folder = new_folder(df.sparkSession, kind)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def written(df: DataFrame, kind: str, group: int | None = None) -> DataFrame:
    """Rows with texts as a compressed table in the shared folder, read again; what led to them is released.

    ``group``: bytes of rows that are held while they are written and when they are read, if large rows ask for less than Parquet's 128 MB.
    """
    spark, schema = df.sparkSession, df.schema
    folder = new_folder(spark, kind)
    writer = df.write.option("compression", "zstd")
    if group is not None:
        writer = writer.option("parquet.block.size", group).option("parquet.block.size.row.check.min", 8)
    writer.parquet(folder)
    del df, writer
    release(spark)
    return spark.read.schema(schema).parquet(folder)
