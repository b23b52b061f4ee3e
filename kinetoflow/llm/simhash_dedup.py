"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text's fingerprint has 64 bits. Two fingerprints within ``RADIUS`` = 3 bits have a 32-bit half in which they
differ in at most ``RADIUS // 2`` = 1 bit. So every distinct fingerprint emits, for each half, the ball of half the
radius: the half itself (its centre) and the half with one bit changed. Of the two members of such a pair exactly
one has the differing bit set, so changing set bits alone reaches every pair: about 34 rows for a fingerprint in
place of 2 * 33, or of the 2,081 that balls of radius 2 over all 64 bits would take. Rows meet by a shuffle on the variant;
colliding pairs are deduplicated and verified by their Hamming distance.

Growth: N distinct fingerprints put N / 2^32 of them on a half by chance, so that one meets about 34 N / 2^32 others: 8 at 10^9. The
links that result are the same for every value of ``HOT``; the tests run with 1, where all fingerprints go by 64-bit balls.

A half shared by very many distinct fingerprints would pair quadratically. Fingerprints of such hot variants go
another, equally exact way: balls over all 64 bits, and a star in place of pairs (see ``_hub_links``).

Texts 0.8 alike (``similar_groups``) differ in more bits than such balls reach. They meet in the same way on blocks of a longer SimHash:
each block emits its ball of half the radius, those that collide are verified by the Hamming distance of 192 bits, then by their shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import count_at_most, settle, small_batches
from .components import components

RADIUS = 3
#: Fingerprints at one variant from which on it is hot.
HOT = 256
#: By similarity: longs of a SimHash, the share of its bits in which two sets of shingles 0.8 alike differ at most (their angle over pi), and the share of such
#: pairs that may meet on no block.
LONGS, FLIPPED, MISSED = 4, 0.1515, 0.0005
#: Shingles below which single ones weigh more; the pipeline's sets of fewer meet on their rarest shingles instead.
FEW = 16
#: Bits of the first 64 in which texts 0.8 alike may differ, and by longs compared those of all of them: from FEW shingles on, and below (9.7, 19.4 and 29 on average of 64, 128
#: and 192, deviation 2.9, 4.1 and 5). Texts without a common shingle differ in 96 of 192, deviation 7: among 10^9 less than one is near a given one by chance, so that
#: chance does not join groups; of 128 bits some hundred would be.
WIDE, APART = 24, {2: (36, 48), 3: (50, 66)}
#: Kinds at one cell from which on it is dealt out in pairs of tiles.
TILE = 4096
#: Kinds and shingles of a group from which on it is verified in pairs of parts.
PART, WEIGHT = 512, 1 << 20
#: Most rows (two longs each) that are broadcast to fetch texts.
BROADCAST_KINDS = 1_000_000
_ODD = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def _shingle_hashes(text: str | None, words: int, seed: int):
    """XXH64 of each shingle of ``words`` words, in arrays of at most 65,536; one of the whole sequence if it is shorter, none without words."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not parts:
        return
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    n = max(1, len(parts) - words + 1)
    hash64 = xxhash.xxh64_intdigest
    for at in range(0, n, 65536):  # memory stays bounded for any length of text
        low, high = starts[at : min(n, at + 65536)], ends[words - 1 :][at : at + 65536] if len(parts) >= words else ends[-1:]
        yield np.fromiter((hash64(joined[i:j], seed) for i, j in zip(low.tolist(), (high - 1).tolist())), np.uint64, len(low))


def _majority(hashes) -> int:
    """The bits that over half of all hashes have; 0 without hashes."""
    ones, n = np.zeros(64, np.int64), 0
    for h in hashes:
        n += len(h)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def text_fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles, repeats included; 0 for a text without words."""
    return _majority(_shingle_hashes(text, words, seed))


def text_shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    found = list(_shingle_hashes(text, words, 42))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def similarity_of(a: np.ndarray, b: np.ndarray) -> float:
    """Shared by all distinct shingles (Jaccard); 1 for two texts without any."""
    if not len(a) and not len(b):
        return 1.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def with_fingerprint(docs: DataFrame, column: str = "text", name: str = "fingerprint", words: int = 3) -> DataFrame:
    """Add the fingerprint as a signed long."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([text_fingerprint(t, words) for t in texts], np.uint64).view(np.int64))

    return docs.withColumn(name, fingerprint(F.col(column)))


def _ball(prints: DataFrame) -> DataFrame:
    """(variant, fp, centre): both halves of each fingerprint and these halves with one set bit cleared."""
    half = F.when(F.col("side") == 0, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(0xFFFFFFFF))
    bit = F.expr("shiftleft(1L, greatest(bit, 0))")
    rows = prints.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("half", half).withColumn("bit", F.explode(F.sequence(F.lit(-1), F.lit(31))))
    rows = rows.where((F.col("bit") < 0) | (F.col("half").bitwiseAND(bit) != 0))
    value = F.when(F.col("bit") < 0, F.col("half")).otherwise(F.col("half").bitwiseXOR(bit))
    return rows.select((F.col("side").cast("long") * F.lit(1 << 32) + value).alias("variant"), "fp", (F.col("bit") < 0).alias("centre"))


def _hub_links(prints: DataFrame) -> DataFrame:
    """Star links among ``prints`` (fp): exact for connectivity, linear in the fingerprints, no pairs.

    Every fingerprint emits the ball of radius 1 (role near) and its variants with two set bits cleared (role
    far). All that meet at a variant with a near member are within 3 bits of it, so a link to the least near member is
    a true one. Any two within 2 bits meet as near members; of two that differ in 3 bits, one has two of
    these bits set and so emits, as far, a variant next to the other. A variant holds at most 2,081 fingerprints.
    """
    single = prints.withColumn("i", F.explode(F.sequence(F.lit(-1), F.lit(63)))).select(
        F.when(F.col("i") < 0, F.col("fp")).otherwise(F.col("fp").bitwiseXOR(F.expr("shiftleft(1L, greatest(i, 0))"))).alias("variant"), "fp", F.lit(True).alias("near"))
    double = prints.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(62)))).where("getbit(fp, i) = 1").withColumn("j", F.explode(F.expr("sequence(i + 1, 63)"))).where("getbit(fp, j) = 1").select(
        F.expr("fp ^ shiftleft(1L, i) ^ shiftleft(1L, j)").alias("variant"), "fp", F.lit(False).alias("near"))
    rows = single.unionByName(double)
    hubs = rows.groupBy("variant").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("hub"), F.count("*").alias("n")).where("hub is not null and n > 1").drop("n")
    return rows.join(hubs, "variant").where("fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b")).distinct()


def fingerprint_links(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """(a, b): links among distinct fingerprints ``fp``; connects just those that chains of steps of at most 3 bits connect.

    Away from hot variants these are all pairs within 3 bits.
    """
    rows = _ball(prints)
    heavy = settle(rows.groupBy("variant").agg(F.count(F.when(F.col("centre"), 1)).alias("centres"), F.count("*").alias("n")).where((F.col("n") > hot) & (F.col("centres") > 0)).select("variant"), "hot")
    extra = None
    if not heavy.isEmpty():
        extra = _hub_links(rows.join(heavy, "variant", "left_semi").select("fp").distinct())
        rows = rows.join(heavy, "variant", "left_anti")
    centres = rows.where("centre").select("variant", F.col("fp").alias("a"))
    others = rows.select("variant", F.col("fp").alias("b"), "centre")
    pairs = centres.join(others, "variant").where("a <> b and (a < b or not centre) and bit_count(a ^ b) <= %d" % RADIUS)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs if extra is None else pairs.unionByName(extra)


def _grouped(docs: DataFrame, id_col: str, text_col: str, hot: int, words: int = 3) -> DataFrame:
    """(id, mark, fp, component_id, root) of every row; mark is a plain hash of the text."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
    prints = settle(with_fingerprint(own, "text", "fp", words).select("id", "mark", "fp"), "prints")
    kinds = settle(prints.groupBy("fp").agg(F.min("id").alias("least")), "kinds")
    found = components(fingerprint_links(kinds.select("fp"), hot))
    rooted = kinds.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.join(ids, "root").select("fp", "component_id", "root")
    return prints.join(labels, "fp")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(id_col, fingerprint long, component_id) for each row of ``docs``.

    component_id is the smallest id reachable over links of at most 3 bits, the row's own included. Null and empty
    texts have fingerprint zero and are linked as any other. Repeated rows and ids keep a row each; null ids
    count in no minimum (a group of null ids alone has a null component). Other columns are ignored, an empty
    table gives no rows.
    """
    return _grouped(docs, id_col, text_col, hot).select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), "component_id")


def _long_simhash(h: np.ndarray) -> np.ndarray:
    """SimHash of ``LONGS`` longs of distinct shingle hashes: the hashes as they are, then mixed anew for each long; zeros without hashes."""
    ones = np.zeros(64 * LONGS, np.int64)
    for k in range(0, len(h), 8160):
        own = h[k : k + 8160]
        words = np.empty((len(own), LONGS), np.uint64)
        words[:, 0] = own
        mixed = (own ^ (own >> np.uint64(31)))[:, None] * _ODD
        words[:, 1:] = mixed ^ (mixed >> np.uint64(29))
        # a byte's bits as eight counters of a byte each: up to 255 hashes add up without a carry
        sums = np.add.reduceat(_LANES[words.view(np.uint8)], np.arange(0, len(own), 255), axis=0)
        ones += sums.view(np.uint8).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)


def _sketches(docs: DataFrame, words: int) -> DataFrame:
    """Add ``s``: kind (hash of the shingle set), n (its size) and the longs s0, s1, ... of the SimHash of the distinct shingles."""
    small_batches(docs.sparkSession)
    names = [f"s{k}" for k in range(LONGS)]

    @F.pandas_udf("kind long, n long, " + ", ".join(f"{c} long" for c in names))
    def sketch(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            h = text_shingles(text, words)
            kind = np.array([xxhash.xxh3_64_intdigest(h.tobytes())], np.uint64).view(np.int64)
            out.append((*kind.tolist(), len(h), *_long_simhash(h).view(np.int64).tolist()))
        return pd.DataFrame(out, columns=["kind", "n", *names])

    return docs.withColumn("s", sketch("text"))


def _blocks(kinds: int) -> tuple[int, int]:
    """(bits, blocks) for so many kinds: a cell has some hundred rows at any size, and balls of radius 1 on the blocks bring a pair within 2 bits on one of
    them but for the share MISSED."""
    bits = min(28, max(8, math.ceil(math.log2(max(kinds, 1))) - 6))
    within = sum(math.comb(bits, i) * FLIPPED**i * (1 - FLIPPED) ** (bits - i) for i in range(3))
    return bits, math.ceil(math.log(MISSED) / math.log(1 - within))


def _cells(kinds: DataFrame, bits: int, blocks: int, longs: int) -> DataFrame:
    """(cell, bit, kind, n, s0, s1, ...): every block of a kind's SimHash, as it is (bit -1) and with each one bit changed; twice as many blocks below FEW shingles."""
    def block(t: int):
        return F.shiftrightunsigned(f"s{t % LONGS}", t // LONGS * bits % (65 - bits)).bitwiseAND(F.lit((1 << bits) - 1).cast("long")) + F.lit(t << 32).cast("long")

    columns = ["kind", "n", *(f"s{k}" for k in range(longs))]
    own = F.when(F.col("n") < FEW, F.array(*map(block, range(2 * blocks)))).otherwise(F.array(*map(block, range(blocks))))
    rows = kinds.select(*columns, F.explode(own).alias("block")).withColumn("bit", F.explode(F.sequence(F.lit(-1), F.lit(bits - 1))))
    return rows.select(F.expr("case when bit < 0 then block else block ^ shiftleft(1L, bit) end").alias("cell"), F.col("bit").cast("byte").alias("bit"), *columns)


def _labels(bit: np.ndarray, kind: np.ndarray, n: np.ndarray, s: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each kind of a cell the first one that pairs near by their bits connect it with.

    A pair collides in every cell of its balls where its blocks are equal, and in two where they differ: one of them counts.
    """
    label = np.arange(len(n))
    for a in range(0, len(n), 256):
        x, y = np.nonzero(np.bitwise_count(s[0][a : a + 256, None] ^ s[0][None, a:]) <= WIDE)
        x, y = x[x < y] + a, y[x < y] + a
        once = np.where(bit[x] == bit[y], bit[x] < 0, (bit[x] < bit[y]) == (kind[x] < kind[y]))
        x, y = x[once], y[once]
        least, most = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
        apart = sum(np.bitwise_count(c[x] ^ c[y]).astype(np.int64) for c in s)
        near = (apart <= np.where(least < FEW, *APART[len(s)][::-1])) & (least >= similarity * most)
        x, y = x[near], y[near]
        while True:
            low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
            if not (low < high).any():
                break
            np.minimum.at(label, high, low)
            while (label[label] != label).any():
                label = label[label]
    return label


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list[pa.Array]]]:
    """The columns behind the first one of each run of rows that are equal in it: lists of runs, as the batches bring them."""
    held: list[pa.RecordBatch] = []
    for batch in chain(batches, [None]):  # a run ends where the next one begins, or with its task's rows
        found: list[list[pa.Array]] = []

        def close() -> None:
            if held:
                found.append([pa.concat_arrays([b.column(c) for b in held]) for c in range(1, held[0].num_columns)])
                held.clear()

        if batch is None:
            close()
        elif batch.num_rows:
            keys = batch.column(0).to_numpy()
            if held and held[-1].column(0)[0].as_py() != keys[0]:
                close()
            bounds = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for start, end in zip(bounds, bounds[1:]):
                if start:
                    close()
                held.append(batch.slice(start, end - start))
        if found:
            yield found


def _meeting(kinds: DataFrame, similarity: float, longs: int = 2) -> DataFrame:
    """(variant, kind): kinds whose blocks' balls collide, in each cell by groups that pairs near by their first ``longs`` longs connect; the variant is a group's smallest kind.

    Rows of a cell that more than ``TILE`` kinds share are dealt out: every two tiles of them meet in a cell of their own, so that no pair is lost.
    """
    bits, blocks = _blocks(kinds.count())
    rows = _cells(kinds, bits, blocks, longs)
    heavy = settle(rows.groupBy("cell").count().where(F.col("count") > TILE).select("cell", F.ceil(F.col("count") / TILE).cast("int").alias("tiles")), "heavy")
    if not heavy.isEmpty():
        dealt = rows.join(heavy, "cell").withColumn("tile", F.pmod(F.xxhash64("kind"), "tiles").cast("int")).withColumn("o", F.explode(F.expr("sequence(0, tiles - 1)")))
        dealt = dealt.select(F.xxhash64("cell", F.least("tile", "o"), F.greatest("tile", "o")).alias("cell"), *rows.columns[1:])
        rows = rows.join(heavy, "cell", "left_anti").unionByName(dealt)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs in _runs(batches):
            found = []
            for columns in runs:
                if len(columns[0]) > 1:
                    bit, kind, n, *s = (c.to_numpy() for c in columns)
                    order = np.argsort(kind)
                    kind = kind[order]
                    label = _labels(bit[order], kind, n[order], [c[order].view(np.uint64) for c in s], similarity)
                    own = np.flatnonzero(np.bincount(label)[label] > 1)
                    found.append(np.stack([kind[label[own]], kind[own]]))
            if found and (rows := np.unique(np.concatenate(found, axis=1), axis=1)).size:
                yield pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1])], names=["variant", "kind"])

    small_batches(kinds.sparkSession, 1 << 16)  # numbers only: the session's own number
    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(meet, "variant long, kind long").distinct()


def _most_small(similarity: float) -> int:
    """The most shingles of a set that may be alike to one of fewer than ``FEW``."""
    return int((FEW - 1) / similarity + 1e-9)


def _small_links(sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links that connect all kinds that are alike where one has fewer than ``FEW`` shingles; no such pair is lost.

    Sets of n shingles that are alike share ``similarity`` * n of them, so in an order of all shingles, the rarest first, they share one of those
    with which so many begin that fewer are left.
    """
    own = sets.where(F.col("n").between(1, _most_small(similarity)))
    rows = own.select("kind", "n", F.explode(F.expr("transform(sequence(1, n), i -> substring(shingles, 8 * i - 7, 8))")).alias("shingle"))
    often = rows.groupBy("shingle").agg(F.count("*").alias("often"))
    order = F.sort_array(F.collect_list(F.struct("often", "shingle")))
    first = F.slice(order, F.lit(1), F.first("n") - F.ceil(F.first("n") * F.lit(similarity) - 1e-9).cast("int") + 1)
    first = rows.join(often, "shingle").groupBy("kind").agg(first.alias("first")).select("kind", F.explode("first").alias("f")).where("f.often > 1").select("kind", "f.shingle")
    first = settle(first, "first")
    heads = first.groupBy("shingle").agg(F.min("kind").alias("a"))
    return first.join(heads, "shingle").where("a <> kind").select("a", F.col("kind").alias("b")).distinct()


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """(kind, n, shingles): number of the distinct shingle hashes of (kind, text), and they as bytes, in order."""
    small_batches(texts.sparkSession)

    @F.pandas_udf("binary")
    def shingles(column: pd.Series) -> pd.Series:
        return pd.Series([text_shingles(t, words).tobytes() for t in column], dtype=object)

    return texts.select("kind", shingles("text").alias("shingles")).select("kind", (F.length("shingles") / 8).cast("int").alias("n"), "shingles")


def _forest(kind: np.ndarray, part: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Pairs of kinds that are alike, as many as connect all that such pairs do. Of two parts only pairs across count: each has a run of its own."""
    sizes = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    has, own = np.zeros(len(ids), bool), np.split(ids, np.cumsum(sizes)[:-1])
    label, across = np.arange(len(kind)), part.min() < part.max()
    found = []
    for x in range(len(kind) - 1):
        open_ = (label[x + 1 :] != label[x]) & (np.minimum(sizes[x + 1 :], sizes[x]) >= similarity * np.maximum(sizes[x + 1 :], sizes[x]))
        if across:
            open_ &= part[x + 1 :] != part[x]
        others = np.flatnonzero(open_) + x + 1
        if not len(others):
            continue
        has[own[x]] = True
        shared = np.add.reduceat(has[np.concatenate([own[y] for y in others.tolist()])], np.cumsum(sizes[others]) - sizes[others], dtype=np.int64)
        has[own[x]] = False
        for y in others[shared / (sizes[others] + sizes[x] - shared) >= similarity].tolist():
            if label[x] != label[y]:
                found.append((int(kind[x]), int(kind[y])))
                label[label == label[y]] = label[x]
    return found


def _alike(met: DataFrame, sets: DataFrame, similarity: float, part: int = PART) -> DataFrame:
    """(a, b): pairs of kinds that are at least ``similarity`` alike, as many as connect the kinds of each group of ``met`` (node, root) that such pairs do.

    A task has a group's sets once and gives links that connect something new, so no pairs are written. Groups of more than ``part`` kinds or ``WEIGHT`` shingles are
    dealt out: every two parts meet, which is exact, with the tests quadratic in such a group and each of its sets sent once for each part.
    """
    known = met.select(F.col("node").alias("kind"), "root").join(sets.select("kind", "n"), "kind")
    parts = known.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / part), F.ceil(F.sum("n") / WEIGHT)).cast("int").alias("parts"))
    dealt = known.join(parts, "root").withColumn("part", F.pmod(F.xxhash64("kind"), "parts").cast("int")).withColumn("o", F.explode(F.expr("sequence(0, parts - 1)")))
    dealt = dealt.select(F.xxhash64("root", F.least("part", "o"), F.greatest("part", "o")).alias("run"), "kind", "part")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs in _runs(batches):
            found = []
            for kind, own, shingles in runs:
                if len(kind) > 1:
                    found += _forest(kind.to_numpy(), own.to_numpy(), [np.frombuffer(x, np.uint64) for x in shingles.to_pylist()], similarity)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["a", "b"])

    small_batches(met.sparkSession)
    rows = dealt.join(sets.select("kind", "shingles"), "kind").select("run", "kind", "part", "shingles")
    return rows.repartition("run").sortWithinPartitions("run").mapInArrow(links, "a long, b long")


def _similar(docs: DataFrame, id_col: str, text_col: str, words: int, similarity: float) -> DataFrame:
    """(id, mark, kind, component_id, root) of every row; groups connect texts whose shingle sets are ``similarity`` alike or more.

    Candidates are groups of kinds that chains of near pairs connect: by blocks whose balls collide (``_meeting``), small sets by their rarest shingles
    (``_small_links``). The shingle sets of a group, made once for each kind that meets another, meet in one task, or by pairs of parts, and are compared there
    as long as they are not connected (``_alike``). Connected kinds need no more links, so none is lost.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
    prints = settle(_sketches(own, words).select("id", "mark", "s.*"), "prints")
    kinds = settle(prints.groupBy("kind").agg(*(F.first(c).alias(c) for c in ("n", *(f"s{k}" for k in range(LONGS)))), F.min("id").alias("least"), F.min("mark").alias("mark")), "kinds")
    near = settle(_meeting(kinds.where(F.col("n") >= FEW), similarity, longs=3), "near")
    small = kinds.where(F.col("n").between(1, _most_small(similarity))).select("kind")
    wanted = kinds.join(near.select("kind").unionByName(small).distinct(), "kind", "left_semi").select("kind", "mark")
    if count_at_most(wanted, BROADCAST_KINDS):
        wanted = F.broadcast(wanted)  # 16 bytes a row: below 20 MB
    texts = own.join(wanted, own["mark"].eqNullSafe(wanted["mark"])).groupBy("kind").agg(F.min("text").alias("text"))
    sets = settle(_sets(texts, words), "sets")
    met = settle(components(near.toDF("a", "b").unionByName(_small_links(sets, similarity))), "met")
    roots = components(settle(_alike(met, sets, similarity), "alike")).select(F.col("node").alias("kind"), "root")
    tops = kinds.select("kind", "least")
    tops = tops.join(roots, "kind", "left").withColumn("root", F.coalesce("root", "kind"))
    labels = tops.join(tops.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("kind", "component_id", "root")
    return prints.select("id", "mark", "kind").join(labels, "kind")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id_col, component_id) for each row: groups that links of at least ``similarity`` (Jaccard, distinct shingles) connect.

    A similarity of 0.8 leaves two fingerprints 9.7 of 64 bits apart on average, so balls of half such a radius over all bits cannot be written out. Here
    balls of radius 1 are written for blocks of a SimHash of 64 * ``LONGS`` bits, as many as bring two texts 0.8 alike within 2 bits on one of them
    but for 0.0005; colliding pairs are verified by the distance of 192 bits, then by the similarity of the whole sets. Texts alike to one of fewer than ``FEW``
    shingles meet on their rarest shingles, which misses none.

    Nulls and texts without words are alike; a text of fewer words is one shingle. Letters' case (A-Z) and kinds of white
    space do not count. Null ids count in no minimum. Other columns are ignored, an empty table gives no rows.
    """
    return _similar(docs, id_col, text_col, words, similarity).select(F.col("id").alias(id_col), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, similarity: float | None = None) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: that with the group's smallest id (nulls last).

    Groups are those of ``similar_groups`` where a similarity is given, else those of ``simhash_groups``. Of rows
    that repeat this id in the group the one with the smallest text hash stays, once. Columns stay as they are.
    """
    if similarity is None:
        groups = _grouped(docs, id_col, text_col, HOT, words)
    else:
        groups = _similar(docs, id_col, text_col, words, similarity)
    best = groups.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("k"), F.count("*").alias("n"))
    best = settle(best.select("k.id", "k.mark", "n"), "best")
    rows, keys = docs.withColumn("__mark", F.xxhash64(text_col)), best.select(F.col("id").alias("__id"), F.col("mark").alias("__own"))
    kept = rows.join(keys, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__mark") == F.col("__own")), "left_semi").drop("__mark")
    again = groups.join(best.where("n > 1"), groups["id"].eqNullSafe(best["id"]) & (groups["mark"] == best["mark"]), "left_semi").groupBy("id", "mark").count().where("count > 1")
    return kept if again.isEmpty() else kept.dropDuplicates([id_col, text_col])
