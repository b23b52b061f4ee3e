"""K-mer graphs of peptides, checks of proteins against coding sequences, and links for circular plots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dna


def kmer_graph(peptides: DataFrame, k: int = 8) -> DataFrame:
    """(set, k1, k2, weight): how often the k-mer k1 is directly followed by k2 in the peptides (set, pep) of each set.

    All places of all peptides count, so neither the order of peptides nor a choice of frame matters. Peptides that are null or
    shorter than 2 k have no edges.
    """
    at = peptides.select("set", "pep", F.explode(dna.count_to(F.length("pep") - (2 * k - 1))).alias("i"))
    pairs = at.select("set", F.substring("pep", F.col("i") + 1, F.lit(k)).alias("k1"), F.substring("pep", F.col("i") + (k + 1), F.lit(k)).alias("k2"))
    return pairs.groupBy("set", "k1", "k2").agg(F.count("*").alias("weight"))


def pen_width(weight: Column, least: int = 2) -> Column:
    """Width tier of an edge; the first tier ends at ``least``."""
    out = F.when(weight < least, 1.0)
    for limit, width in ((5, 3.0), (10, 4.0), (20, 6.0), (30, 8.0)):
        out = out.when(weight < limit, width)
    return out.otherwise(10.0)


def strong_edges(graph: DataFrame, least: int = 2) -> DataFrame:
    return graph.where(F.col("weight") >= least)


def main_nodes(graph: DataFrame, main: DataFrame, k: int = 8) -> DataFrame:
    """Nodes of the graph that are k-mers of the main peptide (set, pep); its last k-mer is left out."""
    nodes = graph.select("set", F.explode(F.array("k1", "k2")).alias("kmer")).distinct()
    own = main.select("set", "pep", F.explode(dna.count_to(F.length("pep") - k)).alias("i")).select("set", F.substring("pep", F.col("i") + 1, F.lit(k)).alias("kmer"))
    return nodes.join(own, ["set", "kmer"], "left_semi")


def check_proteins(proteins: DataFrame, cds: DataFrame) -> DataFrame:
    """(name, found, fits), with other columns of the proteins: whether a protein (name, seq) has a coding sequence of its name, and of three times its length.

    Gaps do not count. Of coding sequences with one name that with the smallest ``ord`` is taken.
    """
    size = lambda c: F.length(F.regexp_replace(c, "-", ""))
    first = cds.groupBy("name").agg(F.min_by(size("seq"), "ord").alias("cds_len"))
    rows = proteins.join(first, "name", "left")
    fits = F.floor(F.col("cds_len") / 3) == size("seq")
    return rows.select(*[c for c in proteins.columns if c != "seq"], F.col("cds_len").isNotNull().alias("found"), F.coalesce(fits, F.lit(False)).alias("fits"))


def circos_links(forward: DataFrame, reverse: DataFrame, lengths: DataFrame) -> DataFrame:
    """Links (guide, gl, gr, target, ml, mr, ident) of both strands; guide places of reverse hits count from the contig's other end.

    A contig (name, length) that is missing has length 0.
    """
    cols = ["guide", "gl", "gr", "target", "ml", "mr"]
    side = lengths.select(F.col("name").alias("guide"), "length")
    back = reverse.select(*cols).join(side, "guide", "left").withColumn("l", F.coalesce("length", F.lit(0)))
    back = back.select("guide", (F.col("l") - F.col("gl")).alias("gl"), (F.col("l") - F.col("gr")).alias("gr"), "target", "ml", "mr")
    return forward.select(*cols).unionByName(back).withColumn("ident", F.lit("ident=100.0"))


def karyotype(mrnas: DataFrame, contigs: DataFrame) -> DataFrame:
    """Lines of a karyotype file: (line) for each sequence (name, length), mRNAs green, contigs grey."""
    line = lambda df, color: df.select(F.concat_ws("\t", F.lit("chr"), F.lit("-"), "name", "name", F.lit("0"), F.col("length").cast("string"), F.lit(color)).alias("line"))
    return line(mrnas, "green").unionByName(line(contigs, "grey"))


def snp_places(snps: DataFrame, genes: DataFrame, gene: str) -> DataFrame:
    """SNPs (chr, pos, ref, alt) with ``rel``: places relative to the start of the first feature whose ID is ``gene``."""
    start = genes.where(F.element_at("tags", "ID") == gene).orderBy("s", "e").limit(1).select(F.col("s").alias("gene_s"))
    return snps.join(F.broadcast(start)).withColumn("rel", dna.shift_place(F.col("pos"), F.col("gene_s"))).drop("gene_s")


def codon_sites() -> list[tuple[str, float]]:
    """Non-synonymous sites of each codon: single changes that alter the amino acid, in thirds; a stop counts as one."""
    out = []
    for codon, aa in dna.CODONS.items():
        changed = [dna.CODONS[codon[:i] + c + codon[i + 1 :]] != aa for i in range(3) for c in "ACGT" if c != codon[i]]
        out.append((codon, sum(changed) / 3))
    return out
