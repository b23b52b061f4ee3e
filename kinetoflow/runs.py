"""Whole runs: files in, files out, one settled table of alignments for all sinks, and counters observed while it is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .functions import dna
from .operators import align, assembly, diffexp, es
from .operators.store import keep
from .options import EngineOptions
from .sources import readers, writers


def _aligned(reads: DataFrame, refs: DataFrame, options: EngineOptions) -> tuple[DataFrame, dict]:
    """Alignments, written once, and how many reads there were, aligned, lay reversed, matched exactly and matched the reference."""
    given, found = Observation(), Observation()
    reads = reads.observe(given, F.count("*").alias("reads"))
    rows = align.align(reads, refs, options)
    rows = rows.observe(found, F.count("*").alias("aligned"), F.count_if("reversed").alias("reversed"), F.count_if("exact").alias("exact"), F.count_if("match_ref").alias("match_ref"))
    rows = keep(rows)
    return rows, {**given.get, **found.get}


def align_run(spark: SparkSession, fastq: str, fasta: str, out: str, options: EngineOptions = EngineOptions()) -> dict:
    """Reads of FASTQ files against the references of a FASTA file: ``out``/taf, /fastq, /matrix and /dest; the counters of the run.

    All sinks read one table of alignments. Files without valid reads give empty outputs and zeros.
    """
    refs = keep(align.encode_refs(readers.read_fasta(spark, fasta, strict=True)))
    found, counters = _aligned(readers.read_fastq(spark, fastq), refs, options)
    writers.write_taf(found, refs, f"{out}/taf")
    writers.write_fastq(found, refs, f"{out}/fastq")
    writers.write_matrix(found, refs, f"{out}/matrix")
    long = es.in_table(es.es_long(es.trimmed(found)))
    writers.write_dest(es.counts(long), refs, f"{out}/dest")
    return counters


def assemble_run(spark: SparkSession, fastq: str, fasta: str, out: str, options: EngineOptions = EngineOptions()) -> dict:
    """Reads to reading frames: aligned, joined along their overlaps and translated; ``out``/cds, /pep, /mrna and /taf of the frames.

    With ``each_orf_alignment`` the reads that lie on each frame's sequence are written as well, in a folder for each frame.
    """
    refs = keep(align.encode_refs(readers.read_fasta(spark, fasta, strict=True)))
    found, counters = _aligned(readers.read_fastq(spark, fastq), refs, options)
    own = keep(assembly.nodes(found, options))
    edges = keep(assembly.overlap_edges(own, options))
    paths = assembly.trace_paths(own, edges, refs, options)
    frames = keep(assembly.catalog(assembly.call_orfs(paths, refs, options), options))
    lines = frames.select("ref_idx", F.col("number").cast("long").alias("rd_id"), "ref_s", (F.col("ref_s") + F.size("dr") - 1).alias("ref_e"), "dr")
    writers.write_orfs(frames, out, align.taf(lines, refs))
    if options.each_orf_alignment:
        on = frames.select("ref_idx", "name", F.col("ref_s").alias("from"), (F.col("ref_s") + F.size("dr")).alias("to"), F.col("dr").alias("whole"))
        rows = found.join(on, "ref_idx").where((F.col("ref_s") >= F.col("from")) & (F.col("ref_e") <= F.col("to")))
        rows = rows.where(F.expr("slice(whole, ref_s - `from` + 1, size(dr)) = dr"))
        taf = align.taf(rows.select("ref_idx", F.struct("name", "rd_id").alias("both"), F.col("rd_id"), "ref_s", "ref_e", "dr", "name"), refs, read_name=F.concat(F.col("name"), F.lit("@"), F.col("rd_id").cast("string")))
        writers.write_tsv(taf.withColumn("orf", F.element_at(F.split("read", "@"), 1)), f"{out}/orf_alignments", "orf")
    return counters | {"edges": edges.count(), "frames": frames.count()}


def differential_run(spark: SparkSession, samples: dict[str, tuple[str, str]], fasta: str, out: str, first: str, second: str, options: EngineOptions = EngineOptions()) -> DataFrame:
    """Samples (name -> condition and FASTQ path) to tested editing states: every sample's dense table below ``out``/dest, the test in ``out``/tested.

    One job with a sample column: states are counted for all samples at once. (key, log_fc, log_cpm, p_value, fdr, fold) come back as written.
    """
    refs, counted = keep(align.encode_refs(readers.read_fasta(spark, fasta, strict=True))), None
    for name, (_, path) in sorted(samples.items()):
        found, _ = _aligned(readers.read_fastq(spark, path), refs, options)
        counts = keep(es.counts(es.in_table(es.es_long(es.trimmed(found)))))
        writers.write_dest(counts, refs, f"{out}/dest/{name}")
        own = counts.select(F.concat_ws(":", "ref_idx", "pos", "es").alias("key"), F.lit(name).alias("sample"), "n")
        counted = own if counted is None else counted.unionByName(own)
    tested = diffexp.exact_test(counted, {name: condition for name, (condition, _) in samples.items()}, first, second)
    tested = tested.withColumn("fold", dna.signed_fold_change(F.col("log_fc"), F.col("fdr")))
    tested.write.parquet(f"{out}/tested")
    return spark.read.parquet(f"{out}/tested")
