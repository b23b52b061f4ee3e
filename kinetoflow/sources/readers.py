"""Readers of sequence, alignment and feature files as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dna
from ..operators.store import ordinals

TAF = "ref string, read string, ref_s int, ref_e int, dr string, seq string, s_seq int, e_seq int"
GFF = "chr string, auth string, type string, s int, e int, score string, strand string, phase string, attributes string"


def _records(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, body): text of each record of FASTA files; a record ends where a line starts with >."""
    parts = spark.read.option("lineSep", "\n>").text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), "value")
    first = F.row_number().over(W.partitionBy("file").orderBy("at")) == 1  # the first record keeps its own >
    rows = parts.withColumn("first", first).where(~(F.col("first") & ~F.col("value").startswith(">")))
    body = F.when(F.col("first"), F.expr("substring(value, 2)")).otherwise(F.col("value"))
    return rows.select("file", "at", F.regexp_replace(body, "\r", "").alias("body"))


def read_fasta(spark: SparkSession, path: str, strict: bool = False, cut_names: bool = False) -> DataFrame:
    """(ref_idx, ref_name, seq, length): records in the order of the file, upper case, blank lines and white space left out.

    strict: letters other than A, C, G, T raise an error that names the record and the place, from 1. cut_names: names end at the
    first space. A file is one unit only for its order; lines before the first record are ignored.
    """
    rows = _records(spark, path)
    name = F.trim(F.regexp_extract("body", r"^([^\n]*)", 1))
    seq = F.upper(F.regexp_replace(F.regexp_replace("body", r"^[^\n]*", ""), r"\s", ""))
    rows = rows.select("file", "at", (F.split_part(name, F.lit(" "), F.lit(1)) if cut_names else name).alias("ref_name"), seq.alias("seq"))
    if strict:
        bad = F.length(F.regexp_extract("seq", "^([ACGT]*)", 1)) + 1
        rows = rows.withColumn("seq", F.when(dna.is_dna(F.col("seq")), F.col("seq")).otherwise(F.raise_error(F.concat(F.lit("letter other than A, C, G, T in "), "ref_name", F.lit(" at "), bad.cast("string")))))
    order = F.row_number().over(W.orderBy("file", "at")) - 1
    return rows.withColumn("ref_idx", order).select("ref_idx", "ref_name", "seq", F.length("seq").alias("length"))


def fasta_map(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq), the last record of each name."""
    rows = read_fasta(spark, path, cut_names=False)
    return rows.groupBy(F.col("ref_name").alias("name")).agg(F.max_by("seq", "ref_idx").alias("seq"))


def read_fastq(spark: SparkSession, path: str, longer_than: int = 1, dna_only: bool = True) -> DataFrame:
    """(rd_id, name, seq, qual): valid records of four lines; rd_id counts all records of the files from 1, rejected ones too.

    Valid: the first line starts with @, sequence and quality are equally long and longer than ``longer_than``; dna_only drops
    sequences with other letters than A, C, G, T.
    """
    return fastq_records(fastq_lines(spark.read.text(path)), longer_than, dna_only)


def fastq_lines(text: DataFrame) -> DataFrame:
    """(value, file, block): the lines of text files, also of a stream of files, and where each lies."""
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def fastq_records(lines: DataFrame, longer_than: int = 1, dna_only: bool = True) -> DataFrame:
    """Records of such lines, as ``read_fastq`` gives them.

    Lines are numbered by the sizes of the files' splits, in the order of file and place: records may cross splits, and no task sees all lines.
    """
    lines = ordinals(lines.withColumn("at", F.monotonically_increasing_id()), "at", "i", "file", "block").withColumn("i", F.col("i") - 1)
    of = lambda k: F.max(F.when(F.col("i") % 4 == k, F.regexp_replace("value", "\r$", "")))
    rows = lines.groupBy(F.floor(F.col("i") / 4).alias("n")).agg(of(0).alias("name"), of(1).alias("seq"), of(3).alias("qual"))
    good = F.col("name").startswith("@") & (F.length("seq") > longer_than) & (F.length("seq") == F.length("qual"))
    if dna_only:
        good = good & dna.is_dna(F.col("seq"))
    return rows.where(good).select((F.col("n") + 1).alias("rd_id"), F.expr("substring(name, 2)").alias("name"), "seq", "qual")


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """Features with ``tags``, a map of their attributes; lines that start with # are left out."""
    rows = spark.read.schema(GFF).option("sep", "\t").option("comment", "#").csv(path)
    return rows.withColumn("tags", F.str_to_map(F.rtrim(F.col("attributes"), F.lit("; ")), F.lit("; *"), F.lit("="))).drop("attributes")


def get_feature(features: DataFrame, name: str) -> DataFrame:
    """The first feature with this ID; an error if there is none."""
    found = features.where(F.element_at("tags", "ID") == name).orderBy("s", "e").limit(1)
    if found.isEmpty():
        raise KeyError(f"no feature {name}")
    return found


def read_snps(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("chr string, pos int, ref string, alt string").option("sep", "\t").csv(path).orderBy("chr", "pos", "ref", "alt")


def states(text: Column) -> Column:
    """Array of the integers in a ;-separated text."""
    return F.transform(F.filter(F.split(text, ";"), lambda x: x != ""), lambda x: x.cast("int"))


def read_taf(spark: SparkSession, path: str, part: str = "all", longest: int = 20) -> DataFrame:
    """Alignment lines with ``dr`` as an array.

    part: all states; inner, without the first and the last two, and without lines that have an inner state over ``longest``; path,
    all but the last with ref_s one less.
    """
    rows = spark.read.schema(TAF).option("sep", "\t").csv(path).withColumn("dr", states(F.col("dr")))
    if part == "inner":
        return rows.withColumn("dr", F.slice("dr", 2, F.greatest(F.size("dr") - 3, F.lit(0)))).where(~F.exists("dr", lambda x: x > longest))
    if part == "path":
        return rows.withColumn("dr", F.slice("dr", 1, F.greatest(F.size("dr") - 1, F.lit(0)))).withColumn("ref_s", F.col("ref_s") - 1)
    return rows


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    return read_taf(spark, path).select("ref", "s_seq", "e_seq")


def read_de(spark: SparkSession, path: str) -> DataFrame:
    """Results of a differential test, without a header: (x, y, log_fc, log_cpm, p_value, fdr)."""
    rows = spark.read.schema("key string, log_fc double, log_cpm double, p_value double, fdr double").option("sep", "\t").csv(path)
    return rows.select(F.split_part("key", F.lit(":"), F.lit(1)).cast("int").alias("x"), F.split_part("key", F.lit(":"), F.lit(2)).cast("int").alias("y"), "log_fc", "log_cpm", "p_value", "fdr")


def read_dest(spark: SparkSession, path: str) -> DataFrame:
    """(sample, key, n) of all dense tables that the path matches; the sample is the file's name up to its first dot."""
    rows = spark.read.schema("key string, n long").option("sep", "\t").csv(path)
    return rows.select(F.regexp_extract(F.input_file_name(), r"([^/.]+)[^/]*$", 1).alias("sample"), "key", "n")


def read_guides(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the edit-graph matcher."""
    return spark.read.schema("target string, rf_begin int, guide string, p int, score int, aligned_rf string, aligned_rd string, action string, path string").option("sep", "\t").csv(path)


def read_anchored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("target string, m_start int, guide string, g_start int, mtext string, gtext string").option("sep", "\t").csv(path)


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Hits of the ungapped search from its report: main rows of 11 fields, with the flank on the line that starts with @@ Downstream."""
    lines = spark.read.option("lineSep", "@@ Downstream").text(path).select(F.monotonically_increasing_id().alias("at"), "value")
    both = lines.withColumn("tail", F.lead("value").over(W.orderBy("at"))).where("tail is not null")
    main = F.split(F.regexp_extract("value", r"(?m)^((?:[^\t\n]*\t){10}[^\t\n]*)$", 1), "\t")
    f = lambda i, kind="string": F.get(main, F.lit(i)).cast(kind)
    return both.select(f(0).alias("guide"), f(1, "int").alias("gl"), f(2, "int").alias("gr"), f(3).alias("gtext"), f(4).alias("target"), f(5, "int").alias("ml"), f(6, "int").alias("mr"), f(7).alias("mtext"), f(8, "int").alias("gu"), f(9, "int").alias("mm"), f(10, "int").alias("len"), F.nullif(F.regexp_extract("tail", r"^ \d+bp: ([^\n]*)", 1), F.lit("")).alias("downstream"))


def read_kmers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("kmer string, n long").option("sep", "\t").csv(path)
