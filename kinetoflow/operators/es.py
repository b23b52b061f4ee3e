"""Analytics over editing states: histograms, dense tables, transitions, coverage and read support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dna

#: Rows of a dense table; row 20 - es holds state es.
ROWS = 40


def es_long(alignments: DataFrame) -> DataFrame:
    """(ref_idx, rd_id, j, pos, es): a row for each site of each alignment."""
    return alignments.select("ref_idx", "rd_id", "ref_s", F.posexplode("dr").alias("j", "es")).select("ref_idx", "rd_id", "j", (F.col("ref_s") + F.col("j")).alias("pos"), "es")


def trimmed(alignments: DataFrame, longest: int = 20) -> DataFrame:
    """Alignments less their first and last two states, keeping ref_s; those with a state over ``longest`` are left out."""
    inner = F.slice("dr", 2, F.greatest(F.size("dr") - 3, F.lit(0)))
    return alignments.withColumn("dr", inner).where(~F.exists("dr", lambda x: x > longest))


def histogram(long: DataFrame, refs: DataFrame, most: int = 16) -> DataFrame:
    """(ref_idx, pos, es, n) of states up to ``most`` at sites of the reference."""
    sizes = refs.select("ref_idx", F.length("letters").alias("sites"))
    inside = long.where(F.abs("es") <= most).join(F.broadcast(sizes) if refs.limit(10_001).count() <= 10_000 else sizes, "ref_idx").where("pos < sites")
    return inside.groupBy("ref_idx", "pos", "es").agg(F.count("*").alias("n"))


def in_table(long: DataFrame) -> DataFrame:
    """States that a dense table has a row for."""
    return long.where("es between -19 and 20")


def dense(counts: DataFrame, refs: DataFrame) -> DataFrame:
    """(ref_idx, x, y, n) for every site and row, zeros included; ``counts`` has ref_idx, pos, es, n."""
    grid = refs.select("ref_idx", F.explode(dna.count_to(F.length("letters"))).alias("x")).withColumn("y", F.explode(dna.count_to(ROWS)))
    own = counts.select("ref_idx", F.col("pos").alias("x"), (20 - F.col("es")).alias("y"), "n")
    return grid.join(own, ["ref_idx", "x", "y"], "left").select("ref_idx", "x", "y", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def matrix_lines(table: DataFrame) -> DataFrame:
    """(ref_idx, y, line): the counts of each row, each after a tab."""
    cells = table.groupBy("ref_idx", "y").agg(F.sort_array(F.collect_list(F.struct("x", "n"))).alias("cells"))
    return cells.select("ref_idx", "y", F.concat(F.lit("\t"), F.array_join(F.transform("cells", lambda c: c["n"].cast("string")), "\t")).alias("line"))


def productive(long: DataFrame, window: int = 8) -> DataFrame:
    """Sites of ``long`` whose ``window`` preceding states in the read are all 0."""
    before = W.partitionBy("ref_idx", "rd_id").orderBy("j").rowsBetween(-window, -1)
    return long.withColumn("calm", (F.count("es").over(before) == window) & (F.max(F.abs("es")).over(before) == 0)).where("calm").drop("calm")


def counts(long: DataFrame) -> DataFrame:
    return long.groupBy("ref_idx", "pos", "es").agg(F.count("*").alias("n"))


def productive_share(read_counts: DataFrame, calm_counts: DataFrame, least: int = 20) -> DataFrame:
    """(ref_idx, pos, es, share): productive reads over 1 + reads in edited cells with over ``least`` reads, else 0."""
    both = read_counts.join(calm_counts.withColumnRenamed("n", "calm"), ["ref_idx", "pos", "es"], "left")
    shown = (F.col("es") != 0) & (F.col("n") > least)
    return both.select("ref_idx", "pos", "es", F.when(shown, F.coalesce("calm", F.lit(0)) / (1.0 + F.col("n"))).otherwise(0.0).alias("share"))


def coverage(long: DataFrame) -> DataFrame:
    """(ref_idx, pos, unedited, edited) reads at each site."""
    return long.groupBy("ref_idx", "pos").agg(F.count_if(F.col("es") == 0).alias("unedited"), F.count_if(F.col("es") != 0).alias("edited"))


def transitions(long: DataFrame) -> DataFrame:
    """(ref_idx, pos, es, prev_es, n): states with those of the site before in the same read."""
    line = W.partitionBy("ref_idx", "rd_id").orderBy("j")
    return long.withColumn("prev_es", F.lag("es").over(line)).where("prev_es is not null").groupBy("ref_idx", "pos", "es", "prev_es").agg(F.count("*").alias("n"))


def top_transitions(table: DataFrame, least: int = 10, top: int = 3, spread: float = 0.2) -> DataFrame:
    """The ``top`` most frequent previous states of each cell with at least ``least`` reads and within ``spread`` of the most frequent.

    Ties go to the row further down the table, so to the smaller state.
    """
    cell = W.partitionBy("ref_idx", "pos", "es")
    ranked = table.withColumn("rank", F.row_number().over(cell.orderBy(F.desc("n"), "prev_es"))).withColumn("most", F.max("n").over(cell))
    return ranked.where((F.col("rank") <= top) & (F.col("n") >= least) & (F.col("most") - F.col("n") <= spread * F.col("most"))).drop("most")


def flow(long: DataFrame) -> DataFrame:
    """(ref_idx, pos, es, next_es, weight): transitions to the next site; those from 0 to 0 weigh 1."""
    line = W.partitionBy("ref_idx", "rd_id").orderBy("j")
    steps = long.withColumn("next_es", F.lead("es").over(line)).where("next_es is not null")
    both = (F.col("es") == 0) & (F.col("next_es") == 0)
    return steps.groupBy("ref_idx", "pos", "es", "next_es").agg(F.count("*").alias("n")).select("ref_idx", "pos", "es", "next_es", F.when(both, 1).otherwise(F.col("n")).cast("long").alias("weight"))


def strong_flow(edges: DataFrame) -> DataFrame:
    """Edges heavier than the reference's median weight."""
    middle = edges.groupBy("ref_idx").agg(F.median("weight").alias("middle"))
    return edges.join(F.broadcast(middle), "ref_idx").where("weight > middle").drop("middle")


def base_coverage(spans: DataFrame) -> DataFrame:
    """(ref_idx, reversed, pos, n) from spans (ref_idx, reversed, length, s, e), e left out; reverse ones are mirrored to length - pos.

    Spans become +1 and -1 at their ends, so a long span costs two rows, and a running sum; places between two ends are filled in.
    """
    low = F.when(F.col("reversed"), F.col("length") - F.col("e") + 1).otherwise(F.col("s"))
    high = F.when(F.col("reversed"), F.col("length") - F.col("s") + 1).otherwise(F.col("e"))
    ends = spans.where("e > s").select("ref_idx", "reversed", F.explode(F.array(F.struct(low.alias("pos"), F.lit(1).alias("step")), F.struct(high.alias("pos"), F.lit(-1).alias("step")))).alias("x")).select("ref_idx", "reversed", "x.*")
    steps = ends.groupBy("ref_idx", "reversed", "pos").agg(F.sum("step").alias("step"))
    line = W.partitionBy("ref_idx", "reversed").orderBy("pos")
    filled = steps.withColumn("n", F.sum("step").over(line)).withColumn("until", F.lead("pos").over(line)).where("n > 0")
    return filled.select("ref_idx", "reversed", F.explode(F.sequence("pos", F.col("until") - 1)).alias("pos"), F.col("n").cast("long").alias("n"))


def canonical_percent(read_counts: DataFrame, main: DataFrame, refs: DataFrame) -> DataFrame:
    """(ref_idx, pos, canonical, other, percent, unedited) for every site, given the main path's (ref_idx, pos, main_es).

    canonical counts reads with the main state, other those with other edited states; sites whose main state is 0 or absent are
    unedited = 100 with no counts.
    """
    sites = refs.select("ref_idx", F.explode(dna.count_to(F.length("letters"))).alias("pos")).join(main, ["ref_idx", "pos"], "left")
    same = F.col("es") == F.col("main_es")
    rows = sites.join(read_counts, ["ref_idx", "pos"], "left").groupBy("ref_idx", "pos", "main_es").agg(F.coalesce(F.sum(F.when(same, F.col("n"))), F.lit(0)).alias("c"), F.coalesce(F.sum(F.when(~same & (F.col("es") != 0), F.col("n"))), F.lit(0)).alias("o"))
    calm = F.col("main_es").isNull() | (F.col("main_es") == 0)
    rows = rows.select("ref_idx", "pos", F.when(calm, 0).otherwise(F.col("c")).alias("canonical"), F.when(calm, 0).otherwise(F.col("o")).alias("other"), F.when(calm, 100.0).otherwise(0.0).alias("unedited"))
    return rows.withColumn("percent", 100.0 * F.col("canonical") / (1.0 + F.col("canonical") + F.col("other")))


def grams(long_or_alignments: DataFrame, k: int) -> DataFrame:
    """(ref_idx, rd_id, gram, pos): windows of ``k`` states of each alignment, at the place of their middle."""
    own = _windows(long_or_alignments, k)
    return own.withColumn("gram", F.array_join(F.col("gram").cast("array<string>"), ";"))


def _windows(alignments: DataFrame, k: int) -> DataFrame:
    """``grams`` with arrays in place of texts, which compare alike."""
    at = alignments.select("ref_idx", "rd_id", "ref_s", "dr", F.explode(dna.count_to(F.size("dr") - (k - 1))).alias("i"))
    return at.select("ref_idx", "rd_id", F.slice("dr", F.col("i") + 1, F.lit(k)).alias("gram"), (F.col("ref_s") + F.col("i") + k // 2).alias("pos"))


def support(mrnas: DataFrame, reads: DataFrame, k: int | None = None) -> DataFrame:
    """(ref_idx, rd_id, value): summed read support of each mRNA, (1 + reads with its state) / (1 + reads) at each site.

    With ``k``, an even number from 4 to 10, states are compared in windows of k.
    """
    if k is not None and (k % 2 or not 4 <= k <= 10):
        raise ValueError("k must be even, from 4 to 10")
    state = "gram" if k else "es"
    own = _windows(mrnas, k) if k else es_long(mrnas)
    seen = _windows(reads, k) if k else es_long(reads)
    by_state = seen.groupBy("ref_idx", "pos", state).agg(F.count("*").alias("n"))
    by_site = by_state.groupBy("ref_idx", "pos").agg(F.sum("n").alias("all"))  # windows are made and counted once
    rows = own.select("ref_idx", "rd_id", "pos", state).join(by_state, ["ref_idx", "pos", state], "left").join(by_site, ["ref_idx", "pos"], "left")
    return rows.groupBy("ref_idx", "rd_id").agg(F.sum((1.0 + F.coalesce("n", F.lit(0))) / (1.0 + F.coalesce("all", F.lit(0)))).alias("value"))


def best_supported(values: DataFrame) -> DataFrame:
    """The mRNA of each reference with the greatest support; the smaller rd_id on a tie."""
    return values.groupBy("ref_idx").agg(F.max_by(F.struct("rd_id", "value"), F.struct("value", -F.col("rd_id"))).alias("best")).select("ref_idx", "best.*")


def support_index(alignments: DataFrame, edited: bool = True) -> DataFrame:
    """(ref_idx, rd_id, support): sites at which an alignment has the most frequent state of the site.

    edited: state 0 neither counts as most frequent nor as a site in favour. Ties go to the smaller state.
    """
    long = es_long(alignments)
    voted = long.where("es <> 0") if edited else long
    order = W.partitionBy("ref_idx", "pos").orderBy(F.desc("n"), "es")
    mode = counts(voted).withColumn("rank", F.row_number().over(order)).where("rank = 1").select("ref_idx", "pos", F.col("es").alias("mode"))
    agrees = F.col("es") == F.coalesce("mode", F.lit(0))
    if edited:
        agrees = agrees & (F.col("es") != 0)
    return long.join(mode, ["ref_idx", "pos"], "left").groupBy("ref_idx", "rd_id").agg(F.count_if(agrees).alias("support"))


def dedup(alignments: DataFrame) -> DataFrame:
    """One of the alignments with equal place and states: that with the greatest rd_id."""
    order = W.partitionBy("ref_idx", "ref_s", "ref_e", "dr").orderBy(F.desc("rd_id"))
    return alignments.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def matching_reads(alignments: DataFrame) -> DataFrame:
    """(aligned, matching) reads."""
    return alignments.agg(F.count("*").alias("aligned"), F.count_if(F.col("match_ref")).alias("matching"))
