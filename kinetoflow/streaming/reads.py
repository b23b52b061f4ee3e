"""Alignment of reads that arrive as FASTQ files: each micro-batch of whole files is aligned and written once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import align
from ..operators.store import folder
from ..options import EngineOptions
from ..sources.readers import fastq_lines, fastq_records

#: Records that a micro-batch may hold; numbers of reads start at its number times this.
BATCH = 1 << 40


def align_stream(spark: SparkSession, reads: str, refs: DataFrame, out: str, checkpoint: str, options: EngineOptions = EngineOptions(), files_at_once: int = 16) -> StreamingQuery:
    """Align the files that come into the folder ``reads`` against ``refs`` (as encoded); ends when those that are there are done.

    Files come whole, so records never cross micro-batches. A batch is one folder of Parquet below ``out``, ``batch=<number>``, with the columns of ``align`` and the read's name; a batch that
    runs again after a failure overwrites its own folder. rd_id is the record's number in its batch plus ``BATCH`` times the batch's number.
    Started again with the same ``checkpoint``, it goes on with new files. A batch without valid reads gives an empty folder.
    """
    folder(spark)  # what batches keep goes to the session's own folder

    def write(lines: DataFrame, number: int) -> None:
        records = fastq_records(lines).withColumn("rd_id", F.col("rd_id") + F.lit(number) * F.lit(BATCH))
        found = align.align(records, refs, options).join(records.select("rd_id", "name"), "rd_id")
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")

    lines = fastq_lines(spark.readStream.schema("value string").option("maxFilesPerTrigger", files_at_once).text(reads))
    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
