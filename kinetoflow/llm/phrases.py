"""Counts of phrases in tries of hash containers that spill sorted runs, and the collocations that stand out among them.

Every task counts the phrases of its texts in a trie: its first level are the prefix partitions, below them lie hash containers of phrases
(numbers of their words put together), and a container that grows too large bursts into a node with a child for each digit of the first word's
number. When a task holds too many phrases its largest subtrees leave whole, as runs in the order of the phrases, one row each; the runs of a
prefix partition are merged in one group. Phrases of one or two words go by these words, longer ones too, shifted by the words after: the phrases
that follow a hot pair spread over an eighth of all partitions.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import words as words_of
from .common import settle, small_batches

#: Words of a phrase at most (three numbers of BITS bits fit into 63), and occurrences a candidate needs.
WORDS = 3
LEAST = 10
#: A phrase goes if a longer candidate around it has this share of its occurrences.
COVERED = (50, 100)
#: Phrases of each language in the report.
TOP = 2000
SPACES, STOPS = b" \t", b".,;:!?\n\x0b\x0c\r"
#: Bytes of text worked on at a time; phrases that a task holds before subtrees leave; phrases of a container before it bursts; and what a
#: partition is planned for.
PORTION = 2_000_000
HELD = 1_000_000
BURST = 4_096
PARTITION = 1_200_000

BITS = 21
_LOW = (1 << BITS) - 1
_RUN = "part int, lang string, words binary, bits int, keys binary, counts binary"
_COUNTED = "lang string, size int, phrase string, f long"


class Trie:
    """Containers of one prefix partition and language: a counter of keys, or a node of sixteen by the next digit of the first word's number."""

    def __init__(self, depth: int = 0):
        self.depth, self.own, self.below, self.size = depth, Counter(), None, 0

    def add(self, keys: np.ndarray) -> int:
        """Count the keys; the number of phrases that are new."""
        if self.below is None:
            self.own.update(keys.tolist())
            grown, self.size = len(self.own) - self.size, len(self.own)
            if self.size > BURST and self.depth < BITS // 4:
                self.burst()
            return grown
        digits = (keys >> (2 * BITS + 4 * self.depth)) & 15
        grown = 0
        for d in np.unique(digits).tolist():
            grown += self.below[d].add(keys[digits == d])
        self.size += grown
        return grown

    def burst(self) -> None:
        self.below = [Trie(self.depth + 1) for _ in range(16)]
        for key, count in self.own.items():
            child = self.below[(key >> (2 * BITS + 4 * self.depth)) & 15]
            child.own[key] = count
        for child in self.below:
            child.size = len(child.own)
        self.own = Counter()

    def items(self):
        """(keys, counts) of all containers."""
        if self.below is None:
            yield np.fromiter(self.own.keys(), np.int64, len(self.own)), np.fromiter(self.own.values(), np.int64, len(self.own))
        else:
            for child in self.below:
                yield from child.items()


def planes(numbers: np.ndarray) -> bytes:
    """Non-negative numbers as planes of bytes, as many as the largest needs: those that hardly change compress well."""
    most = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    return np.ascontiguousarray(numbers.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :most].T).tobytes()


def from_planes(data: bytes, count: int) -> np.ndarray:
    out = np.zeros((count, 8), np.uint8)
    raw = np.frombuffer(data, np.uint8).reshape(-1, count)
    out[:, : len(raw)] = raw.T
    return out.view("<i8").ravel()


class Counting:
    """The tries of one task, its numbers of words, and the runs that leave it."""

    def __init__(self, parts: int, most: int, held: int):
        self.parts, self.most, self.held = parts, most, held
        self.number: dict[bytes, int] = {}
        self.tries: dict[tuple[str, int], Trie] = {}
        self.total = 0

    def portion(self, lang: str, ids: np.ndarray, vocabulary: pa.Array, pieces: np.ndarray):
        """Count the phrases of up to ``most`` words that begin in a portion's words; yields runs where too much is held."""
        hashes = np.array([xxhash.xxh3_64_intdigest(w.as_py()) for w in vocabulary], np.uint64) if len(vocabulary) else np.zeros(0, np.uint64)
        piece = np.cumsum(pieces)
        for start in range(0, len(ids), self.held):
            stop = min(len(ids), start + self.held)
            some, local = np.unique(ids[start : min(len(ids), stop + self.most - 1)], return_inverse=True)
            if len(self.number) + len(some) >= _LOW - 1:
                yield from self.spill(0)
                self.number = {}
            own = np.array([self.number.setdefault(w, len(self.number)) for w in vocabulary.take(pa.array(some)).to_pylist()], np.int64)[local] + 1
            here, its_piece = hashes[ids[start : start + len(own)]], piece[start : start + len(own)]
            keys = own[: stop - start] << (2 * BITS)
            yield from self.add(lang, keys, here[: stop - start] % np.uint64(self.parts))
            path = here
            for size in range(2, self.most + 1):
                fits = np.flatnonzero(its_piece[: max(0, len(own) - size + 1)][: stop - start] == its_piece[size - 1 :][: stop - start])
                keys = keys[: len(own) - size + 1] + (own[size - 1 :][: stop - start] << (BITS * (WORDS - size)))
                if size == 2:
                    path = here[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ (here[1:] >> np.uint64(7)) * np.uint64(0xC2B2AE3D27D4EB4F)
                    path ^= path >> np.uint64(32)
                    part = path[fits] % np.uint64(self.parts)
                else:
                    part = (path[fits] % np.uint64(self.parts) + here[fits + size - 1] % np.uint64(max(1, self.parts // 8))) % np.uint64(self.parts)
                yield from self.add(lang, keys[fits], part)

    def add(self, lang: str, keys: np.ndarray, part: np.ndarray):
        part = part.astype(np.int32)
        order = np.argsort(part, kind="stable")
        keys, part = keys[order], part[order]
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(keys)], strict=True) if len(keys) else ():
            self.total += self.tries.setdefault((lang, int(part[a])), Trie()).add(keys[a:b])
        if self.total > self.held:
            yield from self.spill(self.held // 2)

    def spill(self, until: int):
        """The largest subtrees leave until at most so many phrases are held."""
        words = pa.array(list(self.number), pa.binary())
        order = pc.array_sort_indices(words).to_numpy()
        rank = np.zeros(len(words) + 1, np.int64)
        rank[order + 1] = np.arange(1, len(words) + 1)
        spelled = np.array(words.take(pa.array(order)).to_pylist(), object)
        for place in sorted(self.tries, key=lambda p: -self.tries[p].size):
            if self.total <= until:
                return
            gone = self.tries.pop(place)
            self.total -= gone.size
            keys, counts = (np.concatenate(x) for x in zip(*gone.items(), strict=True))
            yield self.run(*place, keys, counts, rank, spelled)

    def run(self, lang: str, part: int, keys: np.ndarray, counts: np.ndarray, rank: np.ndarray, spelled: np.ndarray) -> dict:
        """One row: words in byte order, keys of their ranks in the order of the phrases, counts."""
        columns = [rank[keys >> (2 * BITS)], rank[(keys >> BITS) & _LOW], rank[keys & _LOW]]
        used = np.unique(np.concatenate([np.zeros(1, np.int64), *columns]))
        bits = int(len(used)).bit_length()
        first, second, third = (np.searchsorted(used, c) for c in columns)
        keys = (first << (2 * bits)) | (second << bits) | third
        order = np.argsort(keys)
        return {"part": part, "lang": lang, "words": b"\n".join(spelled[used[1:] - 1].tolist()), "bits": bits, "keys": planes(keys[order]), "counts": planes(counts[order]) + len(keys).to_bytes(8, "little")}


def _count(parts: int, most: int, portion: int, held: int):
    kinds = words_of.byte_kinds(SPACES, STOPS)
    fold = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)

    def run(batches):
        counting = Counting(parts, most, held)
        rows = []
        for table in words_of.portions(batches, "text", portion):
            for lang in table["lang"].unique().to_pylist():
                ids, vocabulary, _, pieces = words_of.encode(table.filter(pc.equal(table["lang"], lang))["text"], kinds, fold)
                rows.extend(counting.portion(lang, ids, vocabulary, pieces))
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_RUN_ARROW)
                rows = []
        for row in counting.spill(0):
            rows.append(row)
            if len(rows) >= 64:
                yield pa.RecordBatch.from_pylist(rows, schema=_RUN_ARROW)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_RUN_ARROW)

    return run


_RUN_ARROW = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("words", pa.binary()), ("bits", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def _lines(texts: list[bytes]) -> pa.Array:
    """The lines of all texts in turn, as one array, without an object for each."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    ends = np.append(np.flatnonzero(data == 10), len(data))
    offsets = np.zeros(len(ends) + 1, np.int64)
    offsets[1:] = ends - np.arange(len(ends))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data[data != 10])])


def _merge(least: int):
    """Runs of one prefix partition -> its phrases with ``least`` occurrences or more, and for each language all occurrences of words (size 0)."""

    def run(rows: pa.Table) -> pa.Table:
        langs, sizes, phrases, counts = [], [], [], []
        for lang in rows["lang"].unique().to_pylist():
            runs = rows.filter(pc.equal(rows["lang"], lang)).to_pylist()
            coded = _lines([x["words"] for x in runs]).dictionary_encode()
            by_word = pc.array_sort_indices(coded.dictionary).to_numpy()
            spelled = coded.dictionary.take(pa.array(by_word))
            rank = np.empty(len(spelled), np.int64)
            rank[by_word] = np.arange(1, len(spelled) + 1)
            ranks = rank[coded.indices.to_numpy()]
            at, keys, every, low = 0, [], [], (1 << len(spelled).bit_length()) - 1
            width = len(spelled).bit_length()
            if 3 * width > 63:
                raise ValueError("more than two million words in one prefix partition: lower PARTITION")
            for x in runs:
                words = x["words"].count(b"\n") + 1
                own = np.concatenate([[0], ranks[at : at + words]])
                at += words
                found = from_planes(x["keys"], int.from_bytes(x["counts"][-8:], "little"))
                mask = (1 << x["bits"]) - 1
                keys.append((own[found >> (2 * x["bits"])] << (2 * width)) | (own[(found >> x["bits"]) & mask] << width) | own[found & mask])
                every.append(from_planes(x["counts"][:-8], len(found)))
            keys, every = np.concatenate(keys), np.concatenate(every)
            order = np.argsort(keys, kind="stable")  # merges the runs, which are in order
            keys, every = keys[order], every[order]
            first = np.flatnonzero(np.diff(keys, prepend=-1))
            keys, every = keys[first], np.add.reduceat(every, first)
            single = (keys & ((1 << (2 * width)) - 1)) == 0
            langs.append(lang), sizes.append(0), phrases.append(b""), counts.append(int(every[single].sum()))
            often = every >= least
            for key, count in zip(keys[often].tolist(), every[often].tolist(), strict=True):
                words = [spelled[k - 1].as_py() for k in (key >> (2 * width), (key >> width) & low, key & low) if k]
                langs.append(lang), sizes.append(len(words)), phrases.append(b" ".join(words)), counts.append(count)
        return pa.table({"lang": pa.array(langs, pa.string()), "size": pa.array(sizes, pa.int32()), "phrase": pa.array(phrases, pa.binary()).cast(pa.string(), safe=False), "f": pa.array(counts, pa.int64())})

    return run


def count_phrases(docs: DataFrame, most: int = WORDS, least: int = LEAST, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, size, phrase, f): phrases of 1 to ``most`` words with at least ``least`` occurrences, and with size 0 the number of all words.

    ``f`` counts all contiguous occurrences within pieces, overlapping ones too. Null languages are ``und``, null texts empty.
    """
    if not 1 <= most <= WORDS:
        raise ValueError(f"phrases have 1 to {WORDS} words")
    small_batches(docs.sparkSession, 1000)
    own = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = own.select(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size * most // (7 * PARTITION)))
    runs = own.mapInArrow(_count(parts, most, PORTION, HELD), _RUN)
    return settle(runs.groupBy("part").applyInArrow(_merge(least), _COUNTED), "phrases")


def collocations(docs: DataFrame, most: int = WORDS, least: int = LEAST, top: int = TOP, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): for each language its ``top`` phrases of 2 to ``most`` words by their weakest cut.

    Texts are lower-cased (A-Z) and split into pieces at ``. , ; : ! ?`` and line ends, pieces into words at spaces and tabs. ``a`` is a phrase's
    count, ``l`` and ``r`` those of the parts before and after the cut that scores least (the first of equal ones), and the score is a million times
    a a / (l r), rounded down, exactly. Phrases that lie in a longer candidate with at least half of their occurrences are left out. Equal rows
    count as often as they stand; empty tables and texts give no rows; other columns are not looked at.
    """
    counted = count_phrases(docs, most, least, lang_col, text_col)
    n = counted.where("size = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    parts = counted.where("size > 0").select("lang", "phrase", "f")
    candidates = counted.where("size > 1").withColumn("w", F.split("phrase", " "))
    cut = lambda start, count: F.array_join(F.slice("w", start, count), " ")
    at = candidates.select("lang", "size", "phrase", F.col("f").alias("a"), "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    at = at.select("lang", "size", "phrase", "a", "k", cut(F.lit(1), F.col("k")).alias("left"), cut(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    met = at.join(parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(parts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    score = (whole("a") * whole("a")).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    met = met.withColumn("__a", score).withColumn("__b", whole("l") * whole("r")).withColumn("score", F.expr("__a div __b"))
    weakest = met.groupBy("lang", "size", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x")).select("lang", "size", "phrase", "a", "x.*")
    within = candidates.where("size > 2").select("lang", "f", "w", "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
    within = within.select("lang", "f", "w", "m", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("i")).select("lang", F.array_join(F.slice("w", F.col("i"), F.col("m")), " ").alias("phrase"), "f")
    longer = within.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    own = weakest.join(longer, ["lang", "phrase"], "left").where(F.col("most").isNull() | (COVERED[1] * whole("most") < COVERED[0] * whole("a")))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = own.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
