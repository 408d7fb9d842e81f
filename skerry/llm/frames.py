"""Small things that the operators share on the Spark side."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that the cluster shares. Only a session of one machine may do without the setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.conf.get("spark.skerry.scratch", "/tmp/skerry-scratch")
    return f"{base.rstrip('/')}/skerry-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """The same rows read back from a written table: cuts the lineage and survives a lost executor.

    The shuffle files behind it go once it is written (the next plan writes its own), the table when the session ends."""
    spark = df.sparkSession
    path, schema = shared_dir(spark), df.schema
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    before = spark.conf.get(_CLEAN_UP)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    return spark.read.schema(schema).parquet(path)


def broadcast_if_small(ids: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """A narrow table, marked for broadcast if it has no more than `rows` rows; else a join shuffles."""
    return F.broadcast(ids) if ids.count() <= rows else ids


def body(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def columns(df: DataFrame, but: Iterable[str] = ()) -> list[Column]:
    """The columns of a table, whatever signs are in their names."""
    out = set(but)
    return [df[f"`{c}`"] for c in df.columns if c not in out]


def with_fields(df: DataFrame, names: Iterable[str], more: str) -> T.StructType:
    """The fields of the named columns and those of a DDL string behind them."""
    return T.StructType([df.schema[n] for n in names] + T.StructType.fromDDL(more).fields)


def numbered(df: DataFrame) -> DataFrame:
    """The table with columns c0, c1, ...: functions on Arrow batches cannot take a table with dots in its names."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])
