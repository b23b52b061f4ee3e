"""K-mer libraries of reads and the support of guides by them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dna


def library(reads: DataFrame, k: int = 16) -> DataFrame:
    """(kmer, n) over reads longer than k and their reverse complements; the last k-mer of each is left out."""
    own = reads.where(F.length("seq") > k)
    both = own.select(F.explode(F.array("seq", dna.revcomp(F.col("seq")))).alias("s"))
    at = both.select("s", F.explode(dna.count_to(F.length("s") - k)).alias("i"))
    return at.select(F.substring("s", F.col("i") + 1, F.lit(k)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))


def supported(guides: DataFrame, lib: DataFrame, k: int = 16, least: int = 2) -> DataFrame:
    """Guides (guide, gseq) with ``supported``, how many of their inner k-mers are in at least ``least`` reads, and max_support."""
    at = guides.select("guide", "gseq", F.explode_outer(F.transform(dna.count_to(F.length("gseq") - k - 2), lambda i: F.substring("gseq", i + 2, F.lit(k)))).alias("kmer"))
    return at.join(lib.where(F.col("n") >= least), "kmer", "left").groupBy("guide", "gseq").agg(F.count("n").alias("supported"), F.coalesce(F.max("n"), F.lit(0)).alias("max_support"))


def verify(guides: DataFrame, lib: DataFrame, k: int = 16, least: int = 2) -> DataFrame:
    """Guides of whose inner k-mers all but one, at most, are supported. Guides of up to k + 3 letters pass with 0."""
    return supported(guides, lib, k, least).where(F.col("supported") >= F.length("gseq") - k - 3)
