"""Writers of sequence, alignment and table files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dna
from ..operators import align, es
from ..operators.store import numbered


def write_tsv(rows: DataFrame, path: str, *partition: str) -> None:
    w = rows.write.option("sep", "\t").option("quote", "").option("emptyValue", "")
    (w.partitionBy(*partition) if partition else w).csv(path)


def write_taf(alignments: DataFrame, refs: DataFrame, path: str, numeric: bool = False) -> None:
    """Alignment lines; numeric: the first column is the reference's number, and reads are called @tal."""
    write_tsv(align.taf(alignments, refs, numeric, F.lit("@tal") if numeric else None), path)


def fastq_lines(alignments: DataFrame, refs: DataFrame) -> DataFrame:
    """Records @tal1, @tal2, ... with the aligned sequences and J for every quality, in the order of reads.

    Rows are dealt out by their numbers: neither the join that numbers them nor the files it reads keep their order.
    """
    rows = align.taf(alignments, refs).withColumn("id", F.expr("cast(substring(read, 2) as bigint)"))
    rows = numbered(rows.select("id", "ref", "seq"), "id", "ref").repartitionByRange("number").sortWithinPartitions("number")
    return rows.select(F.concat(F.lit("@tal"), F.col("number").cast("string"), F.lit("\n"), "seq", F.lit("\n+\n"), F.repeat(F.lit("J"), F.length("seq"))).alias("value"))


def write_fastq(alignments: DataFrame, refs: DataFrame, path: str) -> None:
    fastq_lines(alignments, refs).write.text(path)


def pair_lines(alignments: DataFrame, refs: DataFrame) -> DataFrame:
    """Gapped rows of reference and read, as FASTA records."""
    rows = alignments.join(refs.select("ref_idx", "ref_name", "letters", "runs"), "ref_idx")
    rows = rows.withColumn("v", dna.pair_view(F.col("letters"), F.col("runs"), F.col("ref_s"), F.col("dr")))
    return rows.select(F.concat(F.lit(">"), "ref_name", F.lit("\n"), "v.ref_row", F.lit("\n>"), F.col("rd_id").cast("string"), F.lit("\n"), "v.read_row").alias("value"))


def write_pairs(alignments: DataFrame, refs: DataFrame, path: str) -> None:
    pair_lines(alignments, refs).write.text(path)


def write_matrix(alignments: DataFrame, refs: DataFrame, path: str) -> None:
    """Forty lines for each reference, each its counts after tabs."""
    table = es.matrix_lines(es.dense(es.histogram(es.es_long(alignments), refs), refs))
    table.orderBy("ref_idx", "y").select(F.col("line").alias("value"), "ref_idx").write.partitionBy("ref_idx").text(path)


def write_orfs(catalog: DataFrame, path: str, taf_of: DataFrame | None = None) -> None:
    """FASTA of coding sequences, peptides (with their length) and whole sequences; optionally the alignment lines."""
    rows = catalog.orderBy("number")
    fasta = lambda seq, name: rows.select(F.concat(F.lit(">"), name, F.lit("\n"), seq).alias("value"))
    fasta(F.col("cds"), F.col("name")).write.text(f"{path}/cds")
    fasta(F.col("pep"), F.concat("name", F.lit(" Length="), F.length("pep").cast("string"))).write.text(f"{path}/pep")
    fasta(F.col("seq"), F.col("name")).write.text(f"{path}/mrna")
    if taf_of is not None:
        write_tsv(taf_of, f"{path}/taf")


def write_by_mrna(lines: DataFrame, path: str) -> None:
    """Alignment lines of mRNAs in a folder each, with their status."""
    write_tsv(lines.withColumn("status", F.when(F.col("ref").isNotNull(), "Mapped").otherwise("Unmapped")), path, "mrna")


def write_duplexes(hits: DataFrame, path: str) -> None:
    """Rows of the edit-graph matcher by mRNA and place, both descending."""
    write_tsv(hits.orderBy(F.desc("target"), F.desc("rf_begin"), "guide", "p", "action").select("target", "rf_begin", "guide", "p", "score", "aligned_rf", "aligned_rd", "action", "path"), path)


def hit_blocks(hits: DataFrame, flank: int = 50) -> DataFrame:
    """Report of ungapped hits: the row, the pairing, and both flanks, by mismatches and then place."""
    main = F.concat_ws("\t", "guide", "gl", "gr", "gtext", "target", "ml", "mr", "mtext", "gu", "mm", "len")
    up = F.coalesce(F.concat(F.lit(f"@@ Upstream {flank}bp: "), "upstream"), F.lit("@@ Upstream: 5' end"))
    down = F.coalesce(F.concat(F.lit(f"@@ Downstream {flank}bp: "), "downstream"), F.lit("@@ Downstream: 3' end"))
    return hits.orderBy("mm", "ml", "guide").select(F.concat(main, F.lit("\n## Printing alignment:\n##\t"), "gtext", F.lit("\n##\t"), "marks", F.lit("\n##\t"), "mtext", F.lit("\n\n"), up, F.lit("\n"), down, F.lit("\n")).alias("value"))


def write_dest(counts: DataFrame, refs: DataFrame, path: str) -> None:
    """Dense table x:y and count, row after row, zeros included."""
    write_tsv(es.dense(counts, refs).orderBy("y", "x").select(F.concat_ws(":", "x", "y"), "n"), path)


def circos_conf(prefix: str, names: list[str], first: str, first_length: int) -> str:
    """Configuration text of a circular plot of the named sequences, zoomed at the first."""
    return "\n".join([
        f"karyotype = {prefix}.runcircos.karyo", "chromosomes=" + "".join(f"{n};" for n in names), "chromosomes_display_default = no", "chromosomes_units=1",
        "<links>", "<link>", f"file={prefix}.runcircos.links", "ribbon=yes", "</link>", "</links>", "<zooms>", "<zoom>", f"chr={first}", "start=0u", f"end={first_length}u", "scale=1000", "</zoom>", "</zooms>", ""])
