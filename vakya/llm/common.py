"""Shared pieces: table access, the shared scratch folder and materialised intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which every executor sees.

    Only where a session on one machine leaves it unset is a temporary folder
    made and recorded in the session; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="vakya-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/vakya-{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hot_join(left: DataFrame, right: DataFrame, key: str, rows: int) -> DataFrame:
    """Inner join on ``key`` with ``right``, which has one row a key and, in ``n``, how many of ``left``'s ``rows`` have it.

    Keys with over a thousandth of the rows, of which there are fewer than a thousand, are
    broadcast. Their rows go on with a hash of the whole row as key, so that none is gathered
    in a task; should that hash be a key, the row keeps what it was given already. The others are
    joined by shuffling.
    """
    found = F.struct(*[c for c in right.columns if c not in (key, "n")])
    hot = F.broadcast(right.where(F.col("n") * 1000 > rows).select(key, found.alias("_hot")))
    rest = right.where(F.col("n") * 1000 <= rows).select(F.col(key).alias("_key"), found.alias("_rest"))
    spread = F.when(F.col("_hot").isNull(), F.col(key)).otherwise(F.xxhash64(*left.columns).cast(left.schema[key].dataType))
    both = left.join(hot, key, "left").withColumn("_key", spread).join(rest, "_key", "left")
    return both.select(*left.columns, F.coalesce("_hot", "_rest").alias("_found")).where("_found is not null").select(*left.columns, "_found.*")
