"""Keeping intermediate tables that later steps read more than once."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def once(df: DataFrame) -> DataFrame:
    """``df`` with its columns computed before anything after it: a filter on them is not pushed below, where it would repeat their expressions."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out by ``keys`` to as many partitions as the session shuffles to: few bytes with much work on each stay parallel."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset on a local master (tests), a folder of our own, set from then on."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-kept-")
        atexit.register(shutil.rmtree, path, True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def keep(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: what follows starts from there, and lost executors cost no more than that."""
    path = f"{folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """``df`` with each row's number from 1 in this order: a range partitioning, the sizes of its parts, and no global window.

    One row for each part is summed up in one task; equal rows are told apart by where they lie.
    """
    own = df.withColumn("__tie", F.monotonically_increasing_id())
    rows = keep(own.repartitionByRange(*order, "__tie").sortWithinPartitions(*order, "__tie").drop("__tie").withColumn("__at", F.monotonically_increasing_id()))
    return ordinals(rows.withColumn("__part", F.shiftright("__at", 33)), "__at", name, "__part").drop("__at", "__part")


def ordinals(rows: DataFrame, at: str, name: str, *part: str) -> DataFrame:
    """Add the number from 1 of each row: those of a part follow each other by ``at``, without gaps, and parts by ``part``."""
    sizes = rows.groupBy(*part).agg(F.count("*").alias("__n"), F.min(at).alias("__first"))
    before = F.sum("__n").over(W.orderBy(*part).rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select(*part, "__first", F.coalesce(before, F.lit(0)).alias("__before"))
    return rows.join(offsets, list(part)).withColumn(name, F.col(at) - F.col("__first") + F.col("__before") + 1).drop("__first", "__before")
