"""Words of whole texts as numbers, by Arrow and numpy on the bytes of a batch: shared by operators that look at all words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ASCII white space: space, tab to carriage return.
SPACES = b" \t\n\x0b\x0c\r"


def portions(batches: Iterable[pa.RecordBatch], text: str, most: int) -> Iterator[pa.Table]:
    """Rows of ``batches`` in turn, cut or gathered to about ``most`` bytes of ``text``; a longer text is a portion by itself."""
    held, size = [], 0
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        ends = np.cumsum(pc.binary_length(table[text]).fill_null(0).to_numpy().astype(np.int64))
        start, before = 0, 0
        while start < table.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, before + most - size, "right")))
            held.append(table.slice(start, stop - start))
            size += int(ends[stop - 1]) - before
            start, before = stop, int(ends[stop - 1])
            if size >= most or start < table.num_rows:
                yield pa.concat_tables(held)
                held, size = [], 0
    if held:
        yield pa.concat_tables(held)


def byte_kinds(spaces: bytes, stops: bytes = b"") -> np.ndarray:
    """For each byte: 0 part of a word, 1 between words, 2 between words of different pieces."""
    kinds = np.zeros(256, np.uint8)
    kinds[list(spaces)] = 1
    kinds[list(stops)] = 2
    return kinds


def encode(texts: pa.ChunkedArray, kinds: np.ndarray, fold: np.ndarray | None = None) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(number of each word, different words by number as bytes, first word of each text and the end, whether a piece begins at a word).

    Null texts hold no word. A text begins a piece. ``fold`` has the byte to read in place of each.
    """
    column = pa.concat_arrays([pa.array([], pa.large_binary()), *texts.cast(pa.large_binary()).chunks]).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    low, high = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(column.buffers()[2], np.uint8, high - low, low) if high > low else np.zeros(0, np.uint8)
    data = data if fold is None else fold[data]
    offsets = offsets - low
    kind = kinds[data]
    inside = kind == 0
    begins = offsets[:-1][offsets[:-1] < len(data)]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[begins] = inside[begins]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = begins[begins > 0] - 1
    last[before] = inside[before]
    starts = np.flatnonzero(first)
    sizes = np.flatnonzero(last) + 1 - starts
    ends = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sizes, out=ends[1:])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data[inside])])
    coded = words.dictionary_encode()
    bounds = np.searchsorted(starts, offsets)
    pieces = np.zeros(len(starts) + 1, bool)
    pieces[np.searchsorted(starts, np.flatnonzero(kind == 2))] = True
    pieces[bounds] = True
    return coded.indices.to_numpy(), coded.dictionary, bounds, pieces[:-1]
