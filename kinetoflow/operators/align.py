"""Alignment of reads to references on their letters other than T; the difference of their runs is the editing state.

Seeds of ``seed`` letters that follow each other on a diagonal form a chain. The longest one of a read and strand is found by its text
among the references' windows, extended in closed form, and the longer strand wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import dna
from ..options import EngineOptions
from .store import keep, once, spread

#: K-mer rows of references up to which they are broadcast.
BROADCAST_KMERS = 2_000_000
#: Beyond that, places of a k-mer from which on it is hot, and the parts its seeds are dealt to.
HOT_PLACES, PARTS = 1_000, 64
#: Letters of references up to which their windows of up to ``WINDOWED`` seeds are broadcast.
WINDOW_REFS, WINDOWED = 40_000, 16


def encode_refs(refs: DataFrame) -> DataFrame:
    """Add letters and runs to (ref_idx, ref_name, seq)."""
    return refs.withColumn("letters", dna.letters(F.col("seq"))).withColumn("runs", dna.runs(F.col("seq")))


def index_kmers(refs: DataFrame, k: int) -> DataFrame:
    """(ref_idx, p, kmer) for p from 0 to length - k - 1: the last k-mer is not indexed, references up to k letters have none."""
    at = refs.select("ref_idx", "letters", F.explode(dna.count_to(F.length("letters") - k)).alias("p"))
    return at.select("ref_idx", "p", F.substring("letters", F.col("p") + 1, F.lit(k)).alias("kmer"))


def strands(reads: DataFrame, options: EngineOptions = EngineOptions()) -> DataFrame:
    """(rd_id, reversed, letters, runs) of both strands that are long enough; reads with other letters than A, C, G, T are left out."""
    good = reads.where(F.col("seq").isNotNull() & dna.is_dna(F.col("seq")))
    both = good.select("rd_id", F.explode(F.array(F.struct(F.lit(False).alias("reversed"), F.col("seq").alias("seq")), F.struct(F.lit(True).alias("reversed"), dna.revcomp(F.col("seq")).alias("seq")))).alias("s"))
    own = both.select("rd_id", "s.reversed", dna.letters(F.col("s.seq")).alias("letters"), dna.runs(F.col("s.seq")).alias("runs"))
    return once(own).where(F.length("letters") > options.min_segment + options.seed)


def seed_hits(both: DataFrame, kmers: DataFrame, k: int) -> DataFrame:
    """(rd_id, reversed, pos, ref_idx, p): every k letters a seed, the last full one left out, at each place of a reference with it."""
    cut = F.transform(dna.count_to(F.floor(F.length("letters") / k) - 1), lambda i: F.substring("letters", i * k + 1, F.lit(k)))
    seeds = both.select("rd_id", "reversed", F.posexplode(cut).alias("i", "kmer")).select("rd_id", "reversed", (F.col("i") * k).alias("pos"), "kmer")
    if kmers.limit(BROADCAST_KMERS + 1).count() <= BROADCAST_KMERS:  # two numbers and k letters a row
        return seeds.join(F.broadcast(kmers), "kmer").select("rd_id", "reversed", "pos", "ref_idx", "p")
    return _dealt_join(seeds, kmers).select("rd_id", "reversed", "pos", "ref_idx", "p")


def _dealt_join(seeds: DataFrame, kmers: DataFrame) -> DataFrame:
    """Seeds and places that share a k-mer, by a shuffle in which no hot k-mer is one task's.

    The seeds of a hot k-mer are dealt to ``PARTS`` parts by their read, its places are written to each; all others have one part.
    """
    hot = kmers.groupBy("kmer").agg(F.count("*").alias("n")).where(F.col("n") > HOT_PLACES).select("kmer", F.lit(PARTS).alias("parts"))
    hot = keep(hot)
    parts = F.coalesce("parts", F.lit(1))
    dealt = seeds.join(hot, "kmer", "left").withColumn("part", F.pmod(F.xxhash64("rd_id", "reversed", "pos"), parts).cast("int")).drop("parts")
    spread_out = kmers.join(hot, "kmer", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return dealt.join(spread_out, ["kmer", "part"])


def seed_chains(hits: DataFrame, k: int, seeds: int = 1) -> DataFrame:
    """(rd_id, reversed, ref_idx, pos, p, covered): maximal runs of adjacent seeds on one diagonal; a hit is one of ``seeds`` seeds in a row."""
    own = hits.withColumn("diagonal", F.col("p") - F.col("pos"))
    line = W.partitionBy("rd_id", "reversed", "ref_idx", "diagonal").orderBy("pos")
    island = (F.col("pos") / k).cast("int") - F.row_number().over(line)
    return own.withColumn("island", island).groupBy("rd_id", "reversed", "ref_idx", "diagonal", "island").agg(F.min("pos").alias("pos"), F.min("p").alias("p"), ((F.count("*") + (seeds - 1)) * k).cast("int").alias("covered")).drop("diagonal", "island")


def best_chains(chains: DataFrame) -> DataFrame:
    """The longest chain of each read and strand; ties go to the smaller pos, ref_idx, p."""
    order = W.partitionBy("rd_id", "reversed").orderBy(F.desc("covered"), "pos", "ref_idx", "p")
    return chains.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def longest_chains(both: DataFrame, refs: DataFrame, k: int) -> DataFrame:
    """What ``best_chains`` of all hits gives, without making the hits of repetitive references.

    The longest chain of a strand is its longest run of seeds whose letters are a window of a reference, so each run of up to ``WINDOWED`` seeds
    looks up the first place of its text. Only strands of more seeds have runs of that many at all their places, which are chained.
    """
    if not refs.select((F.sum(F.length("letters")) <= WINDOW_REFS).alias("few")).first()["few"]:
        return best_chains(seed_chains(seed_hits(both, index_kmers(refs, k), k), k))
    sizes = F.sequence(F.lit(1), F.lit(WINDOWED))
    windows = refs.select("ref_idx", "letters", F.explode(sizes).alias("c")).select("ref_idx", "letters", "c", F.explode(dna.count_to(F.length("letters") - F.col("c") * k)).alias("p"))
    windows = windows.select("c", F.expr(f"substring(letters, p + 1, c * {k})").alias("text"), F.struct("ref_idx", "p").alias("at"))
    seeds = (F.floor(F.length("letters") / k) - 1).cast("int")
    runs = both.select("rd_id", "reversed", "letters", seeds.alias("n")).select("*", F.explode(dna.count_to(F.col("n"))).alias("i"))
    runs = runs.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(WINDOWED), F.col("n") - F.col("i")))).alias("c"))
    runs = once(runs.select("rd_id", "reversed", "n", (F.col("i") * k).alias("pos"), "c", F.expr(f"substring(letters, i * {k} + 1, c * {k})").alias("text")))
    brief = runs.join(F.broadcast(windows.groupBy("text").agg(F.min("at").alias("at"))), "text").select("rd_id", "reversed", (F.col("c") * k).alias("covered"), "pos", "at.ref_idx", "at.p")
    whole = windows.where(F.col("c") == WINDOWED).select("text", "at.ref_idx", "at.p")
    hits = runs.where((F.col("n") > WINDOWED) & (F.col("c") == WINDOWED)).join(F.broadcast(whole), "text").select("rd_id", "reversed", "pos", "ref_idx", "p")
    found = brief.unionByName(seed_chains(hits, k, WINDOWED))
    best = found.groupBy("rd_id", "reversed").agg(F.min(F.struct((-F.col("covered")).alias("less"), "pos", "ref_idx", "p")).alias("x"))
    return best.select("rd_id", "reversed", "x.ref_idx", "x.pos", "x.p", (-F.col("x.less")).alias("covered"))


def extend(best: DataFrame, both: DataFrame, refs: DataFrame, options: EngineOptions = EngineOptions()) -> DataFrame:
    """Alignments of the best chains that pass the length gates.

    Right of the seed the match goes on to the first mismatch. Up to two mismatches (``mismatch_max``) then extend it, leftwards
    first; one letter beyond a counted mismatch comes along unchecked.
    """
    most = min(options.mismatch_max, 2)
    side = refs.select("ref_idx", F.col("letters").alias("rf"), F.col("runs").alias("rf_runs"))
    rows = best.join(both, ["rd_id", "reversed"]).join(F.broadcast(side) if refs.limit(10_001).count() <= 10_000 else side, "ref_idx")
    rows = rows.withColumn("d", F.col("p") - F.col("pos")).withColumn("m", F.length("letters"))
    rows = rows.withColumn("low", F.greatest(F.lit(0), -F.col("d"))).withColumn("high", F.least(F.col("m") - 1, F.length("rf") - 1 - F.col("d")))
    d, n = F.col("d"), F.col("high") - F.col("low") + 1
    # letters of both sides as arrays, cut out once: a substring of the reference for every letter would read it from its start
    own, its = F.split(F.substring("letters", F.col("low") + 1, n), ""), F.split(F.substring("rf", F.col("low") + d + 1, n), "")
    unlike = F.transform(F.zip_with(own, its, lambda x, y: x != y), lambda u, i: F.when(u, F.col("low") + i))
    rows = once(rows.withColumn("mis", F.filter(unlike, lambda x: x.isNotNull())).drop("letters", "rf"))
    before = F.reverse(F.filter("mis", lambda x: (x <= F.col("pos")) & (x > F.col("low"))))
    after_seed = F.array_min(F.filter("mis", lambda x: x > F.col("pos") + F.col("covered") - 1))
    rows = rows.withColumn("before", before).withColumn("r0", F.coalesce(after_seed - 1, F.col("high")))
    if most == 0:
        rows = rows.withColumn("mm_left", F.lit(0)).withColumn("left", F.col("pos"))
    else:
        full = F.size("before") >= most
        rows = rows.withColumn("mm_left", F.least(F.size("before"), F.lit(most))).withColumn("left", F.when(full, F.get("before", F.lit(most - 1)) - 1).otherwise(F.col("low")))
    budget = F.lit(most) - F.col("mm_left")
    rows = rows.withColumn("budget", budget).withColumn("after", F.filter("mis", lambda y: (y >= F.col("r0")) & (y < F.col("high"))))
    right = F.when(F.col("budget") == 0, F.col("r0")).when(F.size("after") >= F.col("budget"), F.get("after", F.col("budget") - 1) + 1).otherwise(F.col("high"))
    rows = rows.withColumn("right", right).withColumn("mm", F.col("mm_left") + F.least(F.size("after"), F.col("budget")))
    rows = once(rows.withColumn("len", F.col("right") - F.col("left"))).where((F.col("len") > options.min_segment) & (F.col("len") > options.min_percent / 100.0 * F.col("m")))
    ref_s = F.col("left") + d
    rows = rows.withColumn("ref_s", ref_s).withColumn("ref_e", ref_s + F.col("len"))
    dr = F.zip_with(F.slice("runs", F.col("left") + 2, F.col("len")), F.slice("rf_runs", F.col("ref_s") + 2, F.col("len")), lambda x, y: x - y)
    rows = rows.withColumn("dr", dr)
    esd = F.size(F.filter("dr", lambda x: x != 0))
    return rows.select("ref_idx", "rd_id", "reversed", "ref_s", "ref_e", "dr", "mm", esd.alias("esd"), (F.col("mm") == 0).alias("exact"), (esd == 0).alias("match_ref"))


def pick_strand(alignments: DataFrame) -> DataFrame:
    """One alignment of each read: the longer strand, the forward one on a tie."""
    order = W.partitionBy("rd_id").orderBy((F.col("ref_e") - F.col("ref_s")).desc(), "reversed")
    return alignments.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def align(reads: DataFrame, refs: DataFrame, options: EngineOptions = EngineOptions()) -> DataFrame:
    """(ref_idx, rd_id, reversed, ref_s, ref_e, dr, mm, esd, exact, match_ref) of the reads that align.

    ``reads`` has rd_id and seq, ``refs`` ref_idx and seq (letters and runs are added). Empty tables give no rows.
    """
    own = refs if "runs" in refs.columns else encode_refs(refs)
    both = once(spread(strands(reads, options), "rd_id"))  # filters stay above the shuffle, so that all steps read the same one
    return pick_strand(extend(longest_chains(both, own, options.seed), both, own, options))


def split(alignments: DataFrame, predicate: Column) -> tuple[DataFrame, DataFrame]:
    """Those for which the predicate holds, and the rest."""
    holds = F.coalesce(predicate, F.lit(False))
    return alignments.where(holds), alignments.where(~holds)


def by_strand() -> Column:
    return F.col("reversed")


def by_match() -> Column:
    return F.col("match_ref")


def by_ref(ref_idx: int) -> Column:
    return F.col("ref_idx") == ref_idx


def by_edit_share(least: float) -> Column:
    return F.col("esd") / F.size("dr") >= least


def by_edit_count(least: int) -> Column:
    return F.col("esd") >= least


def taf(alignments: DataFrame, refs: DataFrame, numeric: bool = False, read_name: Column | None = None) -> DataFrame:
    """Alignment lines: ref, read, ref_s, ref_e, dr with ; after each value, seq, s_seq, e_seq."""
    places = dna.letter_places(dna.untless(F.col("letters"), F.col("runs")))  # once for a reference, not summed up to each end
    side = once(refs.select("ref_idx", "ref_name", "letters", "runs", places.alias("places")))
    place = lambda p: F.coalesce(F.get("places", F.col(p)), dna.seq_place(F.col("runs"), F.col(p))).cast("int")
    rows = alignments.join(F.broadcast(side) if refs.limit(10_001).count() <= 10_000 else side, "ref_idx")
    text = F.concat(F.array_join(F.col("dr").cast("array<string>"), ";"), F.when(F.size("dr") > 0, ";").otherwise(""))
    rows = rows.withColumn("_seq", dna.aligned_sequence(F.col("letters"), F.col("runs"), F.col("ref_s"), F.col("dr"))).withColumn("_dr", text)
    name = F.concat(F.lit("@"), F.col("rd_id").cast("string")) if read_name is None else read_name
    return rows.select(
        (F.col("ref_idx").cast("string") if numeric else F.col("ref_name")).alias("ref"), name.alias("read"), "ref_s", "ref_e", F.col("_dr").alias("dr"), F.col("_seq").alias("seq"),
        place("ref_s").alias("s_seq"), place("ref_e").alias("e_seq"))
