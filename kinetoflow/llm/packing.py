"""Token ids and packing: best-fit-decreasing bins with capacity search in a segment tree.

Every input partition tokenises and packs its own documents in one pass, without a shuffle: documents gather in a buffer of
at most ``BUFFER`` tokens, are cut losslessly into pieces of at most ``length`` tokens, sorted by length, and each piece goes to the bin with the least
room that still holds it. A segment tree over the ``length`` possible rooms finds that room in log(length) steps. A packed row holds its ids
as little-endian unsigned integers of fixed width, the cumulative segment lengths (from 0, as attention kernels take
them) and, by them, where positions start again from 0.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokenising pattern that belongs to the vocabulary; a fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LENGTH = 2048
BUFFER = 1 << 23
#: Id that follows each document.
END = 50256
PACKED = "part int, row int, n_tokens int, ids binary, cu_seqlens array<int>, doc_ids array<long>, piece_starts array<long>"


def load_encoding(path: str = VOCABULARY):
    """The tokenizer of a rank file: a line for each token, its bytes in base64 and its id."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Rooms:
    """Segment tree over rooms 0..capacity: which of them have open bins, and the least one that is large enough."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << max(1, capacity.bit_length())
        self.any = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, room: int, bin_: int) -> None:
        self.bins[room].append(bin_)
        k = room + self.size
        while k:
            self.any[k] += 1
            k >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """A bin with the smallest room of at least ``least``, taken out; None if there is none."""
        k = least + self.size
        if not self.any[k]:
            while k > 1 and (k & 1 or not self.any[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.size:
                k = 2 * k if self.any[2 * k] else 2 * k + 1
        room = k - self.size
        bin_ = self.bins[room].pop()
        while k:
            self.any[k] -= 1
            k >>= 1
        return room, bin_


def pack_lengths(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: the indexes in each bin, in the order placed. Every length is between 1 and ``capacity``."""
    rooms, bins = Rooms(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        found = rooms.take(n)
        if found is None:
            bins.append([])
            found = capacity, len(bins) - 1
        room, b = found
        bins[b].append(i)
        if room > n:
            rooms.add(room - n, b)
    return bins


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, vocabulary: str = VOCABULARY, end: int | None = END, buffer: int = BUFFER) -> DataFrame:
    """Packed rows (see PACKED) of all documents; every document's ids, then ``end``, lie whole in its pieces.

    doc_ids and piece_starts tell the document of each segment and where in the document's ids it starts. Documents
    longer than ``length`` are cut into pieces of that length and a rest. Null and empty texts give ``end`` alone (nothing if
    it is None), repeated rows are packed each, null ids stay null. ids holds unsigned integers, of 2 bytes each as long as
    the vocabulary has at most 65,536 ids, else of 4, and has exactly n_tokens of them: readers pad the last bins.
    """
    small_batches(docs.sparkSession)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoding = load_encoding(vocabulary)
        part, rows = TaskContext.get().partitionId(), 0
        kind = "<u2" if max(encoding.n_vocab, (end or 0) + 1) <= 1 << 16 else "<u4"
        names = [c.split()[0] for c in PACKED.split(", ")]
        held: list[tuple[int | None, int, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal rows, held, size
            bins = pack_lengths([len(p[2]) for p in held], length)
            for at in range(0, len(bins), 256):
                some = bins[at : at + 256]
                ids = [np.concatenate([held[i][2] for i in b]).astype(kind).tobytes() for b in some]
                cuts = [np.concatenate(([0], np.cumsum([len(held[i][2]) for i in b]))).astype(np.int32) for b in some]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(some), part, np.int32)), pa.array(np.arange(rows, rows + len(some), dtype=np.int32)), pa.array([int(c[-1]) for c in cuts], pa.int32()), pa.array(ids, pa.binary()),
                    pa.array(cuts, pa.list_(pa.int32())), pa.array([[held[i][0] for i in b] for b in some], pa.list_(pa.int64())), pa.array([[held[i][1] for i in b] for b in some], pa.list_(pa.int64()))], names=names)
                rows += len(some)
            held, size = [], 0

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array(encoding.encode_ordinary(text or ""), np.uint32)
                if end is not None:
                    ids = np.append(ids, np.uint32(end))
                for at in range(0, len(ids), length):
                    piece = ids[at : at + length].astype(kind)
                    held.append((doc, at, piece))
                    size += len(piece)
                    if size >= buffer:
                        yield from flush()
        yield from flush()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(packed, PACKED)


def position_ids(cu_seqlens: list[int]) -> np.ndarray:
    """Positions of a packed row: from 0 again at each segment."""
    cuts = np.asarray(cu_seqlens)
    return np.arange(cuts[-1]) - np.repeat(cuts[:-1], np.diff(cuts))


def write(packed: DataFrame, path: str) -> None:
    """Write packed rows as Parquet shards, one or more for each input partition."""
    packed.write.parquet(path)
