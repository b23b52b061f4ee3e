"""Removal of word sequences that occur more than once, by levels of doubling window length.

Texts are kept in portions of some megabytes as numbers of their words. At each level every portion sends a narrow hash of its candidate windows,
one for equal windows, to the bucket of the hash; a bucket tells each portion by one bit for a hash whether another place has it too. Only windows
that begin and end with a repeated one are candidates at twice the length. The last level compares 64 bits and the bucket, so what chance adds at
the earlier ones is taken away. No row holds a window's places, so a passage that a third of all texts share is one hash for each portion.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as words_of
from .common import settle

#: Words of a window whose repetition is removed.
LENGTH = 35
#: The first level's windows have at least so many words.
LEAST = 16
#: Bytes of text in a portion, hashes in a bucket: what one task holds at a time.
PORTION = 6_000_000
BUCKET = 2_000_000

_SENT = "chunk long, bucket int, hashes binary, twice binary"
_TOLD = "chunk long, bucket int, bits binary"
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)


def levels(length: int, least: int = LEAST) -> list[int]:
    """Window lengths from the first level to ``length``, none more than twice the one before."""
    found = [length]
    while (found[0] + 1) // 2 >= least:
        found.insert(0, (found[0] + 1) // 2)
    return found


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _K1 + ((b << np.uint64(31)) | (b >> np.uint64(33))) * _K2
    x ^= x >> np.uint64(32)
    x *= _K3
    return x ^ (x >> np.uint64(29))


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` words from each place, put together from halves; places with too few words after them have none."""
    out, at, size, power = None, 0, 1, words
    while True:
        if length & size:
            out = power if out is None else _mix(out[: max(0, len(words) - at - size + 1)], power[at : max(at, len(words) - size + 1)])
            at += size
        if size * 2 > length:
            return out[: max(0, len(words) - length + 1)]
        power = _mix(power[: max(0, len(words) - 2 * size + 1)], power[size : max(size, len(words) - size + 1)])
        size *= 2


class Portion:
    """Words of one portion as two columns of hashes, and the windows that lie within a text."""

    def __init__(self, row: dict):
        self.vocabulary = row["vocabulary"]
        self.sizes = np.array(row["sizes"], np.int64)
        self.ids = unpack(row["words"])
        digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, self.vocabulary)), "<u8").reshape(-1, 2)
        self.hashes = [digests[:, k].astype(np.uint64)[self.ids] if len(self.ids) else np.zeros(0, np.uint64) for k in (0, 1)]

    def inside(self, length: int) -> np.ndarray:
        """Whether a window from each word ends within the same text."""
        fits = np.zeros(len(self.ids), bool)
        ends = np.cumsum(self.sizes)
        for start, end in zip((ends - self.sizes).tolist(), ends.tolist(), strict=True):
            if end - start >= length:
                fits[start : end - length + 1] = True
        return fits

    def candidates(self, length: int, shorter: int, repeated: np.ndarray | None) -> np.ndarray:
        """Places of windows to compare at ``length``: those whose first and last ``shorter`` words both repeat."""
        fits = self.inside(length)
        if repeated is not None:
            step = length - shorter
            fits &= repeated
            fits[: max(0, len(fits) - step)] &= repeated[step:]
        return np.flatnonzero(fits)

    def sorted(self, places: np.ndarray, length: int, buckets: int, wide: bool) -> tuple[np.ndarray, ...]:
        """(place's number among the different hashes, bucket and hash of each of these, whether it occurs twice here), by bucket and hash."""
        if not len(places):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
        first, second = (window_hashes(h, length)[places] for h in self.hashes)
        bucket = second % np.uint64(buckets)
        if wide:
            order = np.lexsort((first, bucket))
        else:
            first &= np.uint64(0xFFFFFFFF)
            order = np.argsort((bucket << np.uint64(32)) | first)
        bucket, first = bucket[order], first[order]
        new = np.ones(len(order), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (first[1:] != first[:-1])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        at = np.flatnonzero(new)
        return number, bucket[at].astype(np.int64), first[at], np.diff(np.append(at, len(order))) > 1


def pack(ids: np.ndarray) -> bytes:
    """Numbers as planes of bytes, compressed."""
    planes = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    return pa.compress(np.ascontiguousarray(planes.T[:3]).tobytes() if len(ids) == 0 or ids.max() < 1 << 24 else planes.T.tobytes(), "zstd", asbytes=True) + len(ids).to_bytes(8, "little") + (3 if len(ids) == 0 or ids.max() < 1 << 24 else 4).to_bytes(1, "little")


def unpack(data: bytes) -> np.ndarray:
    count, planes = int.from_bytes(data[-9:-1], "little"), data[-1]
    raw = np.frombuffer(pa.decompress(data[:-9], count * planes, "zstd", asbytes=True), np.uint8).reshape(planes, count)
    out = np.zeros((count, 4), np.uint8)
    out[:, :planes] = raw.T
    return out.view("<u4").ravel().astype(np.int64)


def portions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(chunk, keys, sizes, vocabulary, words): all texts in portions, written once; frequent words have small numbers."""
    own = docs.select(F.col(id_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("keys", T.ArrayType(own.schema["key"].dataType)), T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("vocabulary", T.ArrayType(T.BinaryType())), T.StructField("words", T.BinaryType())])
    most, kinds = PORTION, words_of.byte_kinds(words_of.SPACES)

    def cut(batches):
        first = TaskContext.get().partitionId() << 32
        for k, rows in enumerate(words_of.portions(batches, "text", most)):
            ids, vocabulary, bounds, _ = words_of.encode(rows["text"], kinds)
            by_count = np.argsort(-np.bincount(ids, minlength=len(vocabulary)), kind="stable")
            rank = np.empty(len(by_count), np.int64)
            rank[by_count] = np.arange(len(by_count))
            keys = pa.concat_arrays(rows["key"].chunks)
            row = [
                pa.array([first + k]), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), pa.array([np.diff(bounds).astype(np.int32)]),
                pa.array([vocabulary.take(pa.array(by_count)).to_pylist()], pa.list_(pa.binary())), pa.array([pack(rank[ids])], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(row, names=schema.names)

    return settle(own.mapInArrow(cut, schema), "portions")


def _send(portion: Portion, chunk: int, length: int, shorter: int, repeated: np.ndarray | None, buckets: int, wide: bool) -> pa.Table:
    places = portion.candidates(length, shorter, repeated)
    _, bucket, hashes, twice = portion.sorted(places, length, buckets, wide)
    kind = "<u8" if wide else "<u4"
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    ends = np.append(cuts[1:], len(bucket))
    rows = zip(cuts.tolist(), ends.tolist(), strict=True)
    blobs = [(hashes[a:b].astype(kind).tobytes(), np.packbits(twice[a:b]).tobytes()) for a, b in rows] if len(bucket) else []
    return pa.table({"chunk": pa.array([chunk] * len(blobs), pa.int64()), "bucket": pa.array(bucket[cuts] if len(bucket) else [], pa.int32()), "hashes": pa.array([x for x, _ in blobs], pa.binary()), "twice": pa.array([x for _, x in blobs], pa.binary())})


def _told(portion: Portion, told: pa.Table, length: int, shorter: int, repeated: np.ndarray | None, buckets: int, wide: bool) -> np.ndarray:
    """Whether the window from each word repeats, read from the buckets' bits."""
    places = portion.candidates(length, shorter, repeated)
    number, bucket, _, _ = portion.sorted(places, length, buckets, wide)
    again = np.zeros(len(bucket), bool)
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1)) if len(bucket) else np.zeros(0, np.int64)
    ends = dict(zip(bucket[cuts].tolist(), zip(cuts.tolist(), np.append(cuts[1:], len(bucket)).tolist(), strict=True), strict=True)) if len(bucket) else {}
    for b, bits in zip(told["bucket"].to_pylist(), told["bits"].to_pylist(), strict=True):
        start, end = ends[b]
        again[start:end] = np.unpackbits(np.frombuffer(bits, np.uint8), count=end - start)
    out = np.zeros(len(portion.ids), bool)
    out[places] = again[number]
    return out


def _tell(sent: DataFrame, wide: bool) -> DataFrame:
    """For each hash that a portion sent, in order, a bit: set where another portion has it or it occurs twice there. Rows without a set bit are left out."""
    kind = "<u8" if wide else "<u4"

    def meet(rows: pa.Table) -> pa.Table:
        each = [np.frombuffer(x, kind) for x in rows["hashes"].to_pylist()]
        everything = np.sort(np.concatenate(each))
        more = [v[np.unpackbits(np.frombuffer(t, np.uint8), count=len(v)).astype(bool)] for v, t in zip(each, rows["twice"].to_pylist(), strict=True)]
        repeated = np.unique(np.concatenate([everything[1:][everything[1:] == everything[:-1]], *more]))
        bits = []
        for v in each:
            at = np.searchsorted(repeated, v)
            at[at == len(repeated)] = 0
            has = repeated[at] == v if len(repeated) else np.zeros(len(v), bool)
            bits.append(np.packbits(has).tobytes() if has.any() else None)
        out = pa.table({"chunk": rows["chunk"], "bucket": rows["bucket"], "bits": pa.array(bits, pa.binary())})
        return out.filter(pc.is_valid(out["bits"]))

    return sent.groupBy("bucket").applyInArrow(meet, _TOLD)


def repeated_windows(kept: DataFrame, length: int = LENGTH, least: int = LEAST, longest: bool = False):
    """The levels over ``portions`` up to ``length``, or until no window repeats: for each its settings and the ``bits`` that buckets told portions.

    With ``longest`` the levels go on by doubling beyond ``length`` until no window repeats.
    """
    total = kept.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET))
    steps, done = levels(length, least), []
    while steps:
        size = steps.pop(0)
        shorter, wide = (done[-1]["length"] if done else 0), size >= length
        if not done:
            sent = kept.select("chunk", "sizes", "vocabulary", "words").mapInArrow(_first(size, buckets, wide), _SENT)
        else:
            sent = _by_chunk(kept.select("chunk", "sizes", "vocabulary", "words"), done, _next(done, size, buckets, wide), _SENT)
        bits = settle(_tell(sent, wide), "bits")
        done.append({"length": size, "shorter": shorter, "wide": wide, "buckets": buckets, "bits": bits})
        if bits.isEmpty():
            break
        if longest and not steps:
            steps = [size * 2]
    return done


def _by_chunk(kept: DataFrame, done: list[dict], work, schema) -> DataFrame:
    """Portions and the bits of the last two levels that were told them, together."""
    told = done[-1]["bits"].withColumn("level", F.lit(len(done) - 1))
    for k in range(len(done) - 1):
        told = told.unionByName(done[k]["bits"].withColumn("level", F.lit(k)))
    return kept.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(work, schema)


def _first(size: int, buckets: int, wide: bool):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield from _send(Portion(row), row["chunk"], size, 0, None, buckets, wide).to_batches()

    return run


def _replay(portion: Portion, told: pa.Table, settings: list[tuple]) -> list[np.ndarray]:
    """Repetition of the windows at each level so far."""
    out, repeated = [], None
    for k, (length, shorter, wide, buckets) in enumerate(settings):
        repeated = _told(portion, told.filter(pc.equal(told["level"], k)), length, shorter, repeated, buckets, wide)
        out.append(repeated)
    return out


def _settings(done: list[dict]) -> list[tuple]:
    return [(x["length"], x["shorter"], x["wide"], x["buckets"]) for x in done]


def _next(done: list[dict], size: int, buckets: int, wide: bool):
    settings = _settings(done)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        portion = Portion(row)
        return _send(portion, row["chunk"], size, settings[-1][0], _replay(portion, right, settings)[-1], buckets, wide)

    return run


def dedup(docs: DataFrame, length: int = LENGTH, least: int = LEAST, longest: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, text, spans[, longest]): each text without the words that a repeated window of ``length`` words covers.

    A window repeats if its words also start anywhere else, in the same text too; all copies go. ``text`` has the kept words joined by one space,
    ``spans`` the removed ranges of words (start, end). With ``longest`` the levels go on until no window repeats, and each text tells the longest
    level at which one of its windows does (0: none). Null, empty and blank texts have no words and an empty text; null and repeated ids are rows of
    their own; other columns are not looked at; an empty table gives no rows. One text must fit into a task.
    """
    kept = portions(docs, id_col, text_col)
    done = repeated_windows(kept, length, least, longest)
    settings, key = _settings(done), kept.schema["keys"].dataType.elementType
    fields = [T.StructField(id_col, key), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("text", T.StringType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))]
    schema = T.StructType(fields + ([T.StructField("longest", T.IntegerType())] if longest else []))

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        portion = Portion(left.drop_columns(["keys"]).to_pylist()[0])
        by_level = _replay(portion, right, settings)
        marks = np.zeros(len(portion.ids) + 1, np.int64)
        if settings[-1][0] >= length:
            at = np.flatnonzero(by_level[[x[0] for x in settings].index(length)])
            marks[at] += 1
            marks[at + length] -= 1
        gone = np.cumsum(marks[:-1]) > 0
        spelled = np.array(portion.vocabulary, object)
        bounds = np.concatenate([[0], np.cumsum(portion.sizes)])
        texts, spans, lost, most = [], [], [], []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            here = gone[a:b]
            n = int(np.count_nonzero(here))
            ids = portion.ids[a:b] if not n else portion.ids[a:b][~here]
            texts.append(b" ".join(spelled[ids].tolist()))
            edges = np.flatnonzero(np.diff(here.view(np.int8), prepend=0, append=0)).tolist() if n else []
            spans.append([{"start": x, "end": y} for x, y in zip(edges[::2], edges[1::2], strict=True)])
            lost.append(n)
            if longest:
                most.append(max([0, *(s[0] for s, has in zip(settings, by_level, strict=True) if has[a:b].any())]))
        columns = {id_col: left["keys"].chunk(0).flatten(), "n_words": pa.array(portion.sizes), "n_removed": pa.array(lost, pa.int64()), "text": pa.array(texts, pa.binary()).cast(pa.string(), safe=False), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))}
        return pa.table(columns | ({"longest": pa.array(most, pa.int32())} if longest else {}))

    return _by_chunk(kept, done, cut, schema)
