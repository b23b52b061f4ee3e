"""Benchmark decontamination by SimHash over item-sized windows, in DataFrame operations only.

1. Every document is shingled into hashes of ``SHINGLE`` words. An item and a window of its size that are at least
   ``SIMILARITY`` alike share shingles, and a shared shingle at position p of the document and q of the item puts the
   window at p - q, moved into the document where it sticks out. A window that is as alike as any starts with a shared
   shingle or ends with the document, so windows there are taken too if they hold as many shared shingles as the similarity
   asks for: items with parts left out or moved are met. A document shorter than the item is one window. This loses no
   match and needs one lookup of each shingle among those of the benchmark.
2. Windows and items get 64-bit SimHashes of their shingle multisets. The fingerprint is cut into ``BLOCKS`` blocks; two
   within ``RADIUS`` bits differ in at most RADIUS // BLOCKS bits in some block (pigeonhole). Items emit all
   variants of each block within that many bits, windows their blocks as they are, and both meet on (words, block,
   value).
3. Candidates within the radius are verified by the exact similarity of the weighted shingles: sum of minima over
   sum of maxima of their counts.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .common import settle, word_array

SHINGLE = 5
SIMILARITY = 0.8
#: Two texts 0.8 alike differ in 9.7 of 64 bits on average, with a deviation of 2.9: 19 is 3.2 deviations off.
RADIUS = 19
BLOCKS = 4
#: Benchmark shingles up to which they are broadcast (16 bytes and a hash-table entry each); beyond, they are shuffled.
BROADCAST_SHINGLES = 500_000


def _hashes(words: Column, size: int) -> Column:
    """Hashes of the shingles of ``size`` words in order; fewer words give none.

    The words' hashes are bound by a transform over an array of one, so that the words are not made again for each shingle.
    """
    own = F.array(F.transform(words, lambda w: F.xxhash64(w)))
    places = lambda h: F.when(F.size(h) >= size, F.sequence(F.lit(0), F.size(h) - size)).otherwise(F.array().cast("array<int>"))
    return F.element_at(F.transform(own, lambda h: F.transform(places(h), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(size)]))), 1)


def _fingerprints(shingles: DataFrame, keys: list[str]) -> DataFrame:
    """SimHash of the shingles ``h`` of each key, counted as often as they occur; two counters of 32 bits in a sum."""
    lanes = [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(0x0000000100000001)).alias(f"s{k}") for k in range(32)]
    sums = shingles.groupBy(*keys).agg(F.count("*").alias("m"), *lanes)
    bits = [f"case when 2 * (s{k} & 4294967295) > m then shiftleft(1L, {k}) else 0L end | case when 2 * shiftrightunsigned(s{k}, 32) > m then shiftleft(1L, {k + 32}) else 0L end" for k in range(32)]
    return sums.select(*keys, "m", F.expr(" | ".join(f"({b})" for b in bits)).alias("fp"))


def _variants(bits: int, flips: int) -> list[int]:
    """Masks that change at most ``flips`` of ``bits`` bits."""
    return [sum(1 << i for i in c) for k in range(flips + 1) for c in combinations(range(bits), k)]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(id, item, similarity, start): for each document and item at least ``similarity`` alike the best window's similarity and first word.

    Words are runs of characters other than ASCII white space, lower-cased. Items of 1 to 4 words have one
    shingle, all their words; items and documents without words match nothing. Null texts are empty. Items with the same words
    are searched once and reported each; repeated documents' rows with one id are one document whose windows are those of its
    distinct texts. Rows with null ids are reported under null. Empty tables give no rows.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).alias("item"), F.array_join(word_array(F.lower(F.col(item_text_col))), " ").alias("norm")).where("norm <> ''").distinct()
    kinds = items.groupBy("norm").agg(F.count("*").alias("_n")).select(F.xxhash64("norm").alias("kind"), "norm", F.split("norm", " ").alias("words"))
    kinds = kinds.withColumn("n", F.size("words")).withColumn("k", F.least("n", F.lit(SHINGLE)))
    kinds = settle(kinds, "kinds")
    sizes = sorted(r["k"] for r in kinds.select("k").distinct().collect())  # at most SHINGLE values
    if not sizes:
        schema = StructType([docs.schema[id_col], StructField(item_col, benchmark.schema[item_col].dataType), StructField("similarity", DoubleType()), StructField("start", IntegerType())])
        return spark.createDataFrame([], schema)
    parts = []
    for k in sizes:
        hs = _hashes(F.col("words"), k)
        parts.append(kinds.where(F.col("k") == k).select("kind", "n", "k", F.posexplode(hs).alias("q", "h")))
    grams = parts[0]
    for p in parts[1:]:
        grams = grams.unionByName(p)
    grams = settle(grams, "grams")
    few = grams.count() <= BROADCAST_SHINGLES

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    words = word_array(F.lower(F.col("text")))
    found = None
    for k in sizes:
        hashed = own.select("id", F.xxhash64("text").alias("mark"), _hashes(words, k).alias("hs"))
        # the lookup keeps only positions of benchmark shingles; each gives the windows of the items that have it
        anchors = grams.where(F.col("k") == k).select("h", "n", "q").distinct()
        spread = hashed.select("id", "mark", F.size("hs").alias("last"), F.posexplode("hs").alias("p", "h"))
        hits = spread.join(F.broadcast(anchors) if few else anchors, "h")
        starts = hits.select("id", "mark", "n", "last", F.lit(k).alias("k"), F.expr(f"least(greatest(p - q, 0), greatest(last - (n - {k} + 1), 0))").alias("start")).drop("last").distinct()
        # windows that start at a shared shingle, or the last one, with enough shared shingles in them
        held = hits.groupBy("id", "mark", "n", "last").agg(F.sort_array(F.collect_set("p")).alias("ps")).withColumn("m", F.col("n") - k + 1).withColumn("end", F.greatest(F.col("last") - F.col("m"), F.lit(0)))
        held = held.withColumn("least", F.greatest(F.lit(1), F.ceil(similarity / (1 + similarity) * (F.col("m") + F.least("m", "last")) - 1e-9)).cast("int"))
        held = held.withColumn("at", F.expr("filter(transform(ps, (p, i) -> case when p <= end and get(ps, i + least - 1) < p + m then p end), p -> p is not null)"))
        held = held.withColumn("at", F.expr("case when size(filter(ps, p -> p >= end)) >= least then array_union(at, array(end)) else at end"))
        starts = starts.unionByName(held.select("id", "mark", "n", F.lit(k).alias("k"), F.explode("at").alias("start"))).distinct()
        found = starts if found is None else found.unionByName(starts)
    windows = settle(found, "windows")
    # the shingles of each window: documents with windows are shingled again, a window's positions are a slice
    chosen = windows.groupBy("id", "mark", "k").agg(F.collect_set(F.struct("n", "start")).alias("at"))
    texts = own.withColumn("mark", F.xxhash64("text")).alias("d").join(chosen.alias("c"), F.expr("d.id <=> c.id and d.mark = c.mark")).select("d.id", "d.mark", "d.text", "c.k", "c.at")
    texts = texts.dropDuplicates(["id", "mark", "k"])
    pieces = None
    for k in sizes:
        hs = texts.where(F.col("k") == k).select("id", "mark", "k", "at", _hashes(words, k).alias("hs"))
        piece = hs.select("id", "mark", "k", "hs", F.explode("at").alias("w")).select("id", "mark", F.col("w.n").alias("n"), F.col("w.start").alias("start"), F.explode(F.slice("hs", F.col("w.start") + 1, F.col("w.n") - F.lit(k) + 1)).alias("h"))
        pieces = piece if pieces is None else pieces.unionByName(piece)
    pieces = settle(pieces, "pieces")
    key = ["id", "mark", "n", "start"]
    prints = _fingerprints(pieces, key)
    item_prints = _fingerprints(grams, ["kind", "n"])
    width = 64 // BLOCKS
    masks = ",".join(map(str, _variants(width, radius // BLOCKS)))  # one literal: an expression for each would be some thousand in every plan
    block = F.posexplode(F.array(*[F.shiftrightunsigned("fp", b * width).bitwiseAND((1 << width) - 1) for b in range(BLOCKS)])).alias("b", "v")
    wide = item_prints.select("kind", "n", "fp", block).withColumn("mask", F.explode(F.split(F.lit(masks), ",").cast("array<long>"))).select("n", "b", F.col("v").bitwiseXOR(F.col("mask")).alias("v"), "kind", F.col("fp").alias("item_fp"))
    # many rows grow out of few items: their estimated size says nothing, so neither side may be broadcast
    near = prints.select(*key, "m", "fp", block).hint("merge").join(wide, ["n", "b", "v"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius).select(*key, "m", "kind").distinct()
    # exact weighted Jaccard: sum of minima over sum of maxima of the shingle counts; m are the window's shingles
    counts = pieces.groupBy(*key, "h").agg(F.count("*").alias("c"))
    item_counts = grams.groupBy("kind", "k", "n", "h").agg(F.count("*").alias("ic"))
    pair = near.alias("x").join(counts.alias("y"), F.expr("x.id <=> y.id and x.mark = y.mark and x.n = y.n and x.start = y.start")).select("x.*", "y.h", "y.c")
    shared = pair.join(F.broadcast(item_counts) if few else item_counts, ["kind", "n", "h"])
    least = shared.groupBy(*key, "kind").agg(F.sum(F.least("c", "ic")).alias("least"), F.max("k").alias("k"), F.max("m").alias("m"))
    scored = least.select(*key, "kind", (F.col("least") / (F.col("n") - F.col("k") + 1 + F.col("m") - F.col("least"))).alias("similarity"))
    best = scored.where(F.col("similarity") >= similarity).groupBy("id", "kind").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best"))
    names = items.select("item", F.xxhash64("norm").alias("kind"))
    return best.join(names, "kind").select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("best.similarity").alias("similarity"), (-F.col("best.back")).alias("start"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item. Columns stay as they are; null ids go only if contaminated."""
    hits = contaminated(docs, benchmark, id_col, text_col, **options).select(F.col(id_col).alias("__hit")).distinct()
    return docs.join(settle(hits, "hits"), F.col(id_col).eqNullSafe(F.col("__hit")), "left_anti")
