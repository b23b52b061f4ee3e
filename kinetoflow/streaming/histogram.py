"""Editing-state histogram of alignment lines that arrive as files: a stateful aggregation of Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import TAF, states


def stream_taf(spark: SparkSession, folder: str, files_at_once: int = 16) -> DataFrame:
    """Alignment lines of the files in ``folder``, as they come."""
    return spark.readStream.schema(TAF).option("sep", "\t").option("maxFilesPerTrigger", files_at_once).csv(folder)


def stream_histogram(lines: DataFrame, most: int = 16) -> DataFrame:
    """(ref, pos, es, n) kept up to date; its state has a row for each site and state seen, however many reads come."""
    long = lines.select("ref", "ref_s", F.posexplode(states(F.col("dr"))).alias("j", "es")).where(F.abs("es") <= most)
    return long.groupBy("ref", (F.col("ref_s") + F.col("j")).alias("pos"), "es").agg(F.count("*").alias("n"))
