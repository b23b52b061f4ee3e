"""Fuzzy line dedup: lines normalised and hashed, joined on blocks, verified by edit similarity, one line kept of each group.

1. One pass over the texts turns every line into words (lower case, digits as 0, no punctuation), a 128-bit key of the word
   sequence, a 64-bit SimHash of its words and its blocks. Lines with equal keys are one kind; only numbers are shuffled.
2. Kinds that share a block meet. ``KEYS`` blocks are each the hash of the ``DRAWN`` different words that a weighted min-hash puts first;
   the rarer a word in all texts, the likelier it is drawn, so that neither function words nor a passage that many lines quote
   brings unlike lines together. Lines of up to ``BRIEF`` words also have a block for all but the last of these words. Lines of up to ``SHORT`` letters have a block for
   all they become by as many deletions as edits are allowed, which misses no pair; lines of up to ``FEW`` words and ``LONGER`` letters
   one for what any one deletion leaves, which misses none that one edit parts.
3. Of kinds that meet, pairs remain whose lengths allow the similarity (exact) and, from ``FIRM`` words on, whose SimHashes differ in at
   most ``WIDE`` bits. Their texts are fetched, and pairs verified: edit distance at most (1 - ``SIMILARITY``) of the longer line, computed for many pairs together. First
   the pairs of a block's first kind with its others are, which connects most copies; then only pairs of blocks whose kinds are not
   yet in one group, of kinds from different groups. Pairs inside a group would add nothing.
4. Links join kinds to groups; of each group the first occurrence (by id, then line) stays.

Blocks are not pieces of the SimHash: lines 0.8 alike differ in up to 17 of its 64 bits, and 18 pieces of three or four bits would
hold everything in common. ``tests/llm`` measures the recall against all pairs by edit similarity alone.

Only of blocks of up to ``PAIRED`` kinds the pairs are written, so they grow with the kinds. Larger blocks are compared in place, in tiles of ``HOT`` kinds: a task takes
a tile or two, tests the pairs of kinds that are not in one group, and gives only links that connect something new, so no task holds a group and pairs are not emitted.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, small_batches
from .components import components
from .words import portions

SIMILARITY = 0.8
HOT = 256
#: Kinds of a block up to which its pairs are written and verified once each.
PAIRED = 16
KEYS, DRAWN = 8, 3
#: Distances are computed for so many 64-bit lanes of pairs at a time, texts of so many letters are gathered for it.
LANES_AT_ONCE, GATHERED, LETTERS = 65_536, 12_000_000, 128
SHORT, LONGER, FEW, BRIEF = 14, 40, 5, 14
#: SimHashes of single words tell little of short lines: they are used from FIRM words on, up to WIDE bits.
FIRM, WIDE = 12, 24
#: Buckets in which words are counted: the table of counts has one size for all inputs.
BUCKETS = 1 << 18
#: Lists of lines that are broadcast hold at most so many documents and lines (some 30 MB); beyond, documents are shuffled.
BROADCAST_DOCS, BROADCAST_LINES = 250_000, 2_000_000
#: Bytes of texts whose letters are held as numbers at a time (some 40 bytes each); a longer text by itself.
PORTION = 4_000_000
_WORDS, _PIECE = 50_000, 16_384
_PLACES = np.random.default_rng(11).integers(1 << 62, 1 << 63, 4096).astype(np.uint64) | np.uint64(1)
_KEYS = [f"k{n}" for n in range(KEYS)]
_SEEDS = np.random.default_rng(7).integers(1, 1 << 63, KEYS).astype(np.uint64)[None, :]
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


@functools.cache
def _letters() -> np.ndarray:
    """For each code point: 0 if it is in no word, else the one to read in its place (lower case, 0 for digits)."""
    points = [chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(0x110000)]
    lower = pc.utf8_lower(pa.array(points)).to_pylist()
    return np.array([0 if not (c.isalnum() or c == "_") else 48 if c.isdecimal() else ord(c) for c in lower], np.uint32)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(46)).astype(np.int64)


class _Words:
    """Words of the texts of a batch, in order: their hashes, sizes, first letters and lines; null texts have none.

    ``letters`` has all texts, one after the other, each ended by a line break, ``breaks`` where lines end. A word's hash is a sum of its letters times
    random numbers by their places.
    """

    def __init__(self, texts: pa.ChunkedArray, table: np.ndarray) -> None:
        own = [x or "" for x in texts.to_pylist()]
        points = np.frombuffer("\n".join([*own, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)
        self.letters = table[points]
        self.breaks = np.flatnonzero(points == 10)
        inside = self.letters > 0
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1  # the last letter is in no word
        if len(inside) and inside[0]:
            edges = np.append(0, edges)
        self.firsts, self.sizes = edges[::2], edges[1::2] - edges[::2]
        begins = np.cumsum(self.sizes) - self.sizes
        place = np.arange(int(self.sizes.sum())) - np.repeat(begins, self.sizes)
        terms = self.letters[inside].astype(np.uint64)
        with np.errstate(over="ignore"):
            terms *= _PLACES[place & 4095]
            if len(place) and place.max() > 4095:
                terms *= 2 * (place >> 12).astype(np.uint64) + np.uint64(1)
            self.hashes = pair_hash(np.add.reduceat(terms, begins), self.sizes.astype(np.uint64)) if len(begins) else np.empty(0, np.uint64)

    def text(self, low: int, high: int) -> str:
        """Words between two places, joined by spaces."""
        part = self.letters[low:high]
        return " ".join(np.where(part > 0, part, 32).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").split())


def _counts(table: Broadcast):
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for part in portions(batches, "text", PORTION):
            total += np.bincount(_bucket(_Words(part["text"], table.value).hashes), minlength=BUCKETS)
        rows = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(total[rows])], names=["bucket", "n"])

    return counts


def word_weights(own: DataFrame, table: Broadcast) -> np.ndarray:
    """Weight of each bucket's words: square of the logarithm of all words over the bucket's."""
    found = own.select("text").mapInArrow(_counts(table), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS rows
    n = np.ones(BUCKETS)
    n[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(float)
    return (np.log(1 + n.sum() / n) ** 2).astype(np.float32)


def _draws(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Min-hash values of words, a column for each key."""
    out = np.empty((len(hashes), KEYS), np.float32)
    for at in range(0, len(hashes), 4096):
        h = hashes[at : at + 4096]
        with np.errstate(over="ignore"):
            u = (pair_hash(h[:, None], _SEEDS) >> np.uint64(40)).astype(np.float32)
        out[at : at + len(h)] = -np.log((u + np.float32(0.5)) / np.float32(1 << 24)) / weights[_bucket(h)][:, None]
    return out


def _keys(values: np.ndarray, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(2, lines, KEYS): hash of the DRAWN words of least value for each key, and of these words but the last.

    Memory stays bounded for any length of line.
    """
    out, ends = np.empty((2, len(starts), KEYS), np.int64), np.append(starts[1:], len(words))
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + _PIECE, side="right")))
        own, at = words[starts[a] : ends[b - 1]], starts[a:b] - starts[a]
        if len(own) > _PIECE:  # one long line: its words once each
            own = np.unique(own)
        v, line = values[own], np.repeat(np.arange(b - a), np.diff(np.append(at, len(own))))
        key = np.arange(KEYS, dtype=np.uint64)[None, :]
        for k in range(DRAWN):
            least = np.minimum.reduceat(v, at, axis=0)
            with np.errstate(over="ignore"):
                key = pair_hash(key, least.view(np.uint32).astype(np.uint64))
            if k + 1 < DRAWN:
                v[v <= least[line]] = np.inf
                out[1, a:b] = key.view(np.int64)
        out[0, a:b] = key.view(np.int64)
        a = b
    return out


def _shorter(text: str, similarity: float) -> set[str]:
    """``text`` and all that deletions leave of it: as many as edits are allowed between it and a line of up to SHORT letters, or one."""
    most = 1 if len(text) > SHORT else int((1 - similarity) * min(SHORT, int(len(text) / similarity + 1e-9)) + 1e-9)
    out = last = {text}
    for _ in range(most):
        last = {t[:i] + t[i + 1 :] for t in last for i in range(len(t))}
        out = out | last
    return out


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two words' hashes, in their order; unsigned 64 bits."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _fingerprints(h: np.ndarray, starts: list[int]) -> np.ndarray:
    """SimHash of each line's word hashes; memory stays bounded for any length of line."""
    # a byte's bits as eight counters of a byte each: up to 255 words add up without a carry
    pieces = sorted({*starts, *range(0, len(h), 255)})
    ones = np.empty((len(pieces), 64), np.uint8)
    for a in range(0, len(pieces), 256):
        end = pieces[a + 256] if a + 256 < len(pieces) else len(h)
        part = LANES[h[pieces[a] : end].view(np.uint8).reshape(-1, 8)]
        ones[a : a + 256] = np.add.reduceat(part, [x - pieces[a] for x in pieces[a : a + 256]], axis=0).view(np.uint8)
    ones = np.add.reduceat(ones, np.searchsorted(pieces, starts), axis=0, dtype=np.int32)
    size = np.diff([*starts, len(h)])[:, None]
    return np.packbits(2 * ones > size, axis=1, bitorder="little").view(np.int64)[:, 0]


def _line_rows(found: _Words, words: slice, codes: np.ndarray, values: np.ndarray, starts: np.ndarray, bounds: np.ndarray, similarity: float) -> list[pa.Array]:
    """Columns key, fp, words, size, blocks and more blocks of lines; no line is empty. ``starts`` are their first words, ``bounds`` their places."""
    h, ends = found.hashes[words], np.append(starts, words.stop - words.start)
    counts = np.diff(ends)
    sizes = np.add.reduceat(found.sizes[words], starts) + counts - 1
    raw, at = h.tobytes(), (8 * ends).tolist()
    keys = [xxhash.xxh3_128_digest(raw[i:j]) for i, j in zip(at, at[1:])]
    drawn, brief = _keys(values, codes[words], starts)
    more: list[list[int] | None] = [None] * len(starts)
    for n in np.nonzero(counts <= BRIEF)[0].tolist():
        more[n] = brief[n].tolist()
        if sizes[n] <= SHORT or sizes[n] <= LONGER and counts[n] <= FEW:
            more[n] += [xxhash.xxh64_intdigest(v.encode("utf-8", "surrogatepass"), 2) - (1 << 63) for v in _shorter(found.text(*bounds[n]), similarity)]
    return [pa.array(keys, pa.binary()), pa.array(_fingerprints(h, starts)), pa.array(counts.astype(np.int32)), pa.array(sizes.astype(np.int32)), *map(pa.array, np.ascontiguousarray(drawn.T)), pa.array(more, pa.list_(pa.int64()))]


def _lines(similarity: float, table: Broadcast, weights: Broadcast):
    names = ["id", "mark", "line", "key", "fp", "words", "size", *_KEYS, "more"]

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches, "text", PORTION):
            found = _Words(part["text"], table.value)
            docs = np.searchsorted(found.ends, found.breaks, "right")
            numbers = np.arange(len(docs)) - np.searchsorted(docs, docs)
            line = np.searchsorted(found.breaks, found.firsts)
            first = np.flatnonzero(np.diff(line, prepend=-1))
            has = line[first]
            coded = pa.array(found.hashes).dictionary_encode()
            codes, values = coded.indices.to_numpy(), _draws(coded.dictionary.to_numpy(), weights.value)
            low, ends = np.append(-1, found.breaks)[has] + 1, np.append(first, len(line))
            bounds = np.stack((low, found.breaks[has]), axis=1)
            at = 0
            while at < len(has):  # lines of some 50,000 words at a time
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + _WORDS, "right")) - 1)
                own = [part[c].take(pa.array(docs[has[at:to]])).combine_chunks() for c in ("id", "mark")]
                rows = _line_rows(found, slice(int(ends[at]), int(ends[to])), codes, values, first[at:to] - first[at], bounds[at:to], similarity)
                yield pa.RecordBatch.from_arrays([*own, pa.array(numbers[has[at:to]].astype(np.int32)), *rows], names=names)
                at = to

    return lines


def _near(a: str, b: str, similarity: float) -> str:
    """Condition on two kinds' ``p`` under which their texts are compared."""
    sizes = f"abs({a}.size - {b}.size) <= {1 - similarity!r}D * greatest({a}.size, {b}.size) + 1e-6D"
    return f"{sizes} and (least({a}.words, {b}.words) < {FIRM} or bit_count({a}.fp ^ {b}.fp) <= {WIDE})"


def edit_distance(a: str, b: str, most: int) -> int:
    """Edit distance, or ``most`` + 1 if it is greater (bit-parallel over the longer string's letters)."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, high = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, d = full, 0, len(a)
    for left, c in zip(range(len(b), 0, -1), b):
        if d - left > most:  # each further letter saves one edit at best
            return most + 1
        eq = at.get(c, 0)
        zero = (((eq & plus) + plus) ^ plus) | eq | minus
        gain, loss = minus | ~(zero | plus) & full, plus & zero
        d += bool(gain & high) - bool(loss & high)
        gain, loss = gain << 1 | 1, loss << 1
        plus, minus = (loss | ~(zero | gain)) & full, gain & zero & full
    return min(d, most + 1)


def _most(a: str, b: str, similarity: float) -> int:
    return int((1 - similarity) * max(len(a), len(b)) + 1e-9)


def alike(a: str, b: str, similarity: float) -> bool:
    """Whether the edit distance is at most (1 - similarity) of the longer string."""
    most = _most(a, b, similarity)
    return _replaced(a, b, most) or edit_distance(a, b, most) <= most


def _replaced(a: str, b: str, most: int) -> bool:
    """Whether putting one line's words in place of the other's, where they have as many, takes at most ``most`` edits: then no distance need be computed."""
    x, y = a.split(" "), b.split(" ")
    return len(x) == len(y) and sum(max(len(u), len(v)) for u, v in zip(x, y) if u != v) <= most


def all_alike(texts: list[str], left: np.ndarray, right: np.ndarray, similarity: float) -> np.ndarray:
    """``alike`` for pairs of numbers of ``texts``: the same bit-parallel distances, for thousands of pairs at a time."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    swap = sizes[left] > sizes[right]
    left, right = np.where(swap, right, left), np.where(swap, left, right)
    most = ((1 - similarity) * sizes[right] + 1e-9).astype(np.int64)
    out = np.zeros(len(left), bool)
    lanes = np.exp2(np.ceil(np.log2(np.maximum(-(-sizes[left] // 64), 1)))).astype(np.int64)  # at most so many, in powers of two
    fit = np.nonzero(sizes[right] - sizes[left] <= most)[0]
    fit = fit[np.lexsort((sizes[right][fit], lanes[fit]))]
    for own in np.split(fit, np.nonzero(np.diff(lanes[fit]))[0] + 1):
        if len(own) and lanes[own[0]] > 8:
            out[own] = [_replaced(texts[a], texts[b], m) for a, b, m in zip(left[own].tolist(), right[own].tolist(), most[own].tolist())]
            own = own[~out[own]]
        step = max(256, LANES_AT_ONCE // int(lanes[own[0]])) if len(own) else 1
        for at in range(0, len(own), step):
            part = own[at : at + step]
            if len(part) < 32 or lanes[part[0]] > 32:  # too few, or too long, for arrays
                out[part] = [edit_distance(texts[a], texts[b], m) <= m for a, b, m in zip(left[part].tolist(), right[part].tolist(), most[part].tolist())]
            else:
                out[part] = _distances_within(texts, left[part], right[part], most[part])
    return out


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(all letters as small numbers, first of each text, letters for each number, number of letters)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    letters = np.nonzero(np.bincount(points))[0]
    table = np.zeros(int(letters[-1]) + 1, np.uint8)
    table[letters] = np.arange(len(letters)) % LETTERS
    return table[points], np.cumsum(sizes) - sizes, sizes, len(letters)


def _distances_within(texts: list[str], left: np.ndarray, right: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether each pair's distance is at most ``most``; the right texts, which are no shorter, ascend in length.

    Columns of all pairs advance together, lanes only within ``most`` of the diagonal. A distance is at least what stands
    in any column on its last diagonal, so pairs leave as soon as that passes ``most``.
    """
    used, index = np.unique(np.concatenate((left, right)), return_inverse=True)
    codes, first, sizes, letters = _codes([texts[x] for x in used.tolist()])
    left, right = index[: len(left)], index[len(left) :]
    kinds, row = np.unique(left, return_inverse=True)
    lanes, width, one = max(1, int(-(-sizes[left].max() // 64))), min(letters, LETTERS), np.uint64(1)
    place = np.arange(int(sizes[kinds].sum())) - np.repeat(np.cumsum(sizes[kinds]) - sizes[kinds], sizes[kinds])
    owner = np.repeat(np.arange(len(kinds)), sizes[kinds])
    bits = np.zeros((lanes, len(kinds) * width), np.uint64)
    np.bitwise_or.at(bits, (place >> 6, owner * width + codes[first[kinds][owner] + place]), one << (place & 63).astype(np.uint64))
    n, ahead = sizes[right], sizes[right] - sizes[left]
    out, alive, base, start = np.zeros(len(left), bool), np.arange(len(left)), row * width, first[right]
    plus, minus = np.full((lanes, len(left)), ~np.uint64(0)), np.zeros((lanes, len(left)), np.uint64)
    limits, band, last = most, int(most.max()), -1
    foot = np.zeros(len(left), np.int64)  # value under the lowest lane
    top = np.uint64(63)

    def value(own: slice, column: int) -> np.ndarray:
        """What stands on the last diagonal in ``column``."""
        rows, found = column - ahead[own], foot[own].copy()
        for lane in range(max(0, int(rows.min()) >> 6), last + 1):
            left_over = np.clip(64 * (lane + 1) - rows, 0, 64)  # rows of the lane that lie below
            mask = np.where(left_over > 0, ~np.uint64(0) << np.clip(64 - left_over, 0, 63).astype(np.uint64), np.uint64(0))
            found -= np.bitwise_count(plus[lane, own] & mask).astype(np.int64) - np.bitwise_count(minus[lane, own] & mask)
        return found

    column = 0
    while len(alive):
        while last < min(lanes - 1, (column + 1 + band) >> 6):
            last, foot = last + 1, foot + 64
        at = base + codes[start + column]
        column += 1
        up, down = one, np.uint64(0)  # the value above the first lane rises by one
        for lane in range(min(last, max(0, (column - band - 1) >> 6)), last + 1):
            p, m, eq = plus[lane], minus[lane], bits[lane].take(at)
            vertical = eq | m
            eq |= down
            across = (((eq & p) + p) ^ p) | eq
            gain, loss = m | ~(across | p), p & across
            new_up, new_down = gain >> top, loss >> top
            gain, loss = gain << one | up, loss << one | down
            plus[lane], minus[lane] = loss | ~(vertical | gain), gain & vertical
            up, down = new_up, new_down
        foot += up.astype(np.int64) - down.astype(np.int64)
        high = int(np.searchsorted(n, column, "right"))
        if high:  # pairs whose longer text ends here
            out[alive[:high]] = value(slice(0, high), column) <= most[:high]
        if high or not column % 16:
            stay = np.arange(len(alive)) >= high
            late = slice(high, len(alive))
            if not column % 16 and high < len(alive):
                rows = column - ahead[late]
                stay[late] &= (rows <= 0) | (value(late, column) <= most[late])
            if high or stay.mean() < 0.9:
                alive, base, start, n, ahead, most, foot = (x[stay] for x in (alive, base, start, n, ahead, most, foot))
                plus, minus = np.ascontiguousarray(plus[:, stay]), np.ascontiguousarray(minus[:, stay])
                band = int(most.max()) if len(most) else 0
    if letters > LETTERS:  # letters that share a number make a distance too small, never too great
        for k in np.nonzero(out)[0].tolist():
            a, b = texts[used[left[k]]], texts[used[right[k]]]
            out[k] = edit_distance(a, b, len(b)) <= limits[k]
    return out


def _candidates(tile: pa.Table, offset: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a tile that are to be compared; ``offset`` is the row of its first."""
    first, size, words, prints, root = (tile[c].to_numpy() for c in ("tile", "size", "words", "fp", "root"))
    own = tile["i"][0].as_py() == tile["j"][0].as_py()  # pairs inside a tile are tested where it meets itself
    found = []
    for k in range(tile.num_rows - 1):
        o = slice(k + 1, None)
        near = (root[o] != root[k]) & (np.abs(size[o] - size[k]) <= (1 - similarity) * np.maximum(size[o], size[k]) + 1e-6)
        near &= (np.bitwise_count(prints[o] ^ prints[k]) <= WIDE) | (np.minimum(words[o], words[k]) < FIRM)
        if not own:
            near &= first[o] != first[k]
        near = np.nonzero(near)[0]
        found.append(np.stack((np.full(len(near), offset + k), offset + k + 1 + near)))
    return tuple(np.concatenate(found, axis=1)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))


def _tile_links(similarity: float):
    """Links of whole tiles that connect something new. Rows come sorted by tile; pairs of many tiles are compared together."""

    def linked(tiles: list[pa.Table]) -> pa.RecordBatch:
        rows = pa.concat_tables(tiles)
        starts = np.cumsum([0, *(t.num_rows for t in tiles)])
        a, b = (np.concatenate(x) for x in zip(*(_candidates(t, int(k), similarity) for t, k in zip(tiles, starts))))
        group = np.unique(rows["root"].to_numpy(), return_inverse=True)[1]
        lids, texts, found, take = rows["lid"].to_numpy(), rows["norm"].to_pylist(), [], 1
        while len(a):
            # a few pairs of any two groups first, then more: those that are one group by then need no test
            low, high = np.minimum(group[a], group[b]), np.maximum(group[a], group[b])
            order = np.lexsort((high, low))
            new = np.append(True, (np.diff(low[order]) != 0) | (np.diff(high[order]) != 0))
            rank = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
            now = order[rank < take]
            rest = order[rank >= take]
            for k in now[all_alike(texts, a[now], b[now], similarity)].tolist():
                x, y = group[a[k]], group[b[k]]
                if x != y:
                    group[group == y] = x
                    found.append((lids[a[k]], lids[b[k]]))
            a, b, take = a[rest], b[rest], 4 * take
            apart = group[a] != group[b]
            a, b = a[apart], b[apart]
        return pa.RecordBatch.from_arrays([pa.array(np.array([f[k] for f in found], np.int64)) for k in (0, 1)], names=["a", "b"])

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tiles, letters = [], [], 0
        for table in portions(batches, "norm", GATHERED):
            at = [table[c].to_numpy() for c in ("block", "i", "j")]
            cuts = np.nonzero(np.any([np.diff(x) != 0 for x in at], axis=0))[0] + 1
            for low, high in zip([0, *cuts], [*cuts, table.num_rows]):
                part = table.slice(low, high - low)
                if held and any(held[-1][c][0] != part[c][0] for c in ("block", "i", "j")):
                    tiles.append(pa.concat_tables(held))
                    held = []
                held.append(part)
            letters += table["norm"].nbytes
            if letters > GATHERED and tiles:
                yield linked(tiles)
                tiles, letters = [], 0
        if held:
            yield linked([*tiles, pa.concat_tables(held)])

    return links


def _by_document(docs: DataFrame, lists: DataFrame, lines: str, how: str) -> DataFrame:
    """Join documents (id, mark, text, ...) with lists of their lines (id, mark, ...); column ``lines`` is the list."""
    side = lists.select(F.col("id").alias("_id"), F.col("mark").alias("_mark"), *[c for c in lists.columns if c not in ("id", "mark")])
    docs_in, lines_in = lists.agg(F.count("*"), F.coalesce(F.sum(F.size(lines)), F.lit(0))).first()
    if docs_in <= BROADCAST_DOCS and lines_in <= BROADCAST_LINES:
        side = F.broadcast(side)
    return docs.join(side, F.col("id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), how).drop("_id", "_mark")


def _texts(own: DataFrame, kinds: DataFrame, wanted: DataFrame) -> DataFrame:
    """(lid, norm): normalised text of the wanted kinds, from their first occurrences."""
    at = kinds.join(wanted, "lid").select("first.id", "first.mark", F.struct(F.col("first.line").alias("line"), "lid").alias("at")).groupBy("id", "mark").agg(F.collect_list("at").alias("at"))
    # each text is split once, bound by a transform over an array of one; the wanted lines are taken from there
    picked = F.flatten(F.transform(F.array(F.split("text", "\n")), lambda ls: F.transform("at", lambda w: F.struct(w["lid"].alias("lid"), F.get(ls, w["line"]).alias("line")))))
    norm = F.trim(F.regexp_replace(F.regexp_replace(F.lower("w.line"), r"[^\p{L}\p{N}_]+", " "), r"\p{Nd}", "0"))
    found = _by_document(own, settle(at, "at"), "at", "inner").select(F.explode(picked).alias("w"))
    return found.select("w.lid", norm.alias("norm")).groupBy("lid").agg(F.min("norm").alias("norm"))


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of kinds whose texts are alike."""

    def holds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, "ta", GATHERED):
            n = batch.num_rows
            ok = all_alike(batch["ta"].to_pylist() + batch["tb"].to_pylist(), np.arange(n), np.arange(n, 2 * n), similarity)
            yield from batch.select(["a", "b"]).filter(pa.array(ok)).to_batches()

    both = pairs.join(texts.select(F.col("lid").alias("a"), F.col("norm").alias("ta")), "a").join(texts.select(F.col("lid").alias("b"), F.col("norm").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(holds, "a long, b long")


def fuzzy_links(own: DataFrame, kinds: DataFrame, similarity: float = SIMILARITY, hot: int = HOT) -> DataFrame:
    """(a, b): links that connect kinds as all pairs do that share a block and are alike."""
    rows = kinds.select(F.explode(F.concat(F.array(*_KEYS), F.coalesce("more", F.array().cast("array<long>")))).alias("block"), "lid")
    heads = rows.groupBy("block").agg(F.min("lid").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    p = kinds.select("lid", F.struct("fp", "words", "size").alias("p"))
    shared = settle(rows.join(heads, "block"), "shared")
    heads = shared.where("lid <> head").select("head", "lid").distinct()
    star = heads.join(p, "lid").join(p.select(F.col("lid").alias("head"), F.col("p").alias("q")), "head")
    star = settle(star.where(_near("p", "q", similarity)).select(F.col("head").alias("a"), F.col("lid").alias("b")), "star")
    ends = lambda df: df.select(F.explode(F.array("a", "b")).alias("lid")).distinct()
    texts = settle(_texts(own, kinds, ends(star)), "texts")
    first = settle(_verified(star, texts, similarity), "links")
    joined = components(first)
    met = shared.join(joined.select(F.col("node").alias("lid"), "root"), "lid", "left").select("block", "head", "lid", F.coalesce("root", "lid").alias("root"))
    # pairs with the head are settled: what is left are blocks in which two other kinds are in different groups
    apart = met.where("lid <> head").groupBy("block").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("block")
    met = met.where("lid <> head").join(apart, "block").join(p, "lid")
    met = settle(met.join(met.groupBy("block").agg(F.count("*").alias("n")), "block"), "met")
    cold, tiled = met.where(F.col("n") <= min(PAIRED, hot)), met.where(F.col("n") > min(PAIRED, hot))
    left = cold.select("block", F.col("lid").alias("a"), F.col("p").alias("pa"), F.col("root").alias("ra"))
    pairs = left.join(cold.select("block", F.col("lid").alias("b"), F.col("p").alias("pb"), F.col("root").alias("rb")), "block")
    pairs = settle(pairs.where(f"ra < rb and {_near('pa', 'pb', similarity)}").select("a", "b").distinct(), "pairs")
    any_tiled = not tiled.isEmpty()
    more = ends(pairs).unionByName(tiled.select("lid").distinct()).distinct() if any_tiled else ends(pairs)
    more = settle(more.join(texts.select("lid"), "lid", "left_anti"), "more")
    if not more.isEmpty():
        texts = texts.unionByName(settle(_texts(own, kinds, more), "texts"))
    links = first.unionByName(_verified(pairs, texts, similarity))
    if any_tiled:
        tiles = tiled.withColumn("tiles", F.ceil(F.col("n") / hot)).withColumn("tile", F.pmod(F.xxhash64("lid"), "tiles").cast("int"))
        parts = tiles.withColumn("o", F.explode(F.expr("sequence(0, cast(tiles as int) - 1)"))).select("block", F.least("tile", "o").alias("i"), F.greatest("tile", "o").alias("j"), "tile", "lid", "root", "p.fp", "p.words", "p.size")
        parts = parts.join(texts, "lid").repartition(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), "block", "i", "j").sortWithinPartitions("block", "i", "j", "lid")
        links = links.unionByName(parts.mapInArrow(_tile_links(similarity), "a long, b long"))
    return links


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, hot: int = HOT) -> DataFrame:
    """(id, text, n_lines, n_removed) for each row: its text without lines that repeat, even roughly, an earlier one.

    Earlier is by id (null last), text hash, then line number, over all documents. Lines without letters or digits always stay. Null
    texts stay null, with no lines. Rows that repeat id and text are one document and all get its result. An empty
    table gives no rows; other columns are ignored. Lines are one group if a chain of lines connects them, each as alike as ``similarity``
    to the next by edit distance and sharing a block with it.
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    table = docs.sparkSession.sparkContext.broadcast(_letters())
    weights = docs.sparkSession.sparkContext.broadcast(word_weights(own, table))
    id_type = own.schema["id"].dataType.simpleString()
    fields = f"id {id_type}, mark long, line int, key binary, fp long, words int, size int, {', '.join(k + ' long' for k in _KEYS)}, more array<long>"
    lines = settle(own.mapInArrow(_lines(similarity, table, weights), fields), "lines")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "mark", "line")
    same = [F.any_value(c).alias(c) for c in ("fp", "words", "size", *_KEYS, "more")]
    kinds = lines.groupBy("key").agg(*same, F.min(place).alias("first"), F.count("*").alias("n"))
    kinds = settle(kinds.withColumn("lid", F.monotonically_increasing_id()), "kinds")
    roots = components(fuzzy_links(own, kinds, similarity, hot))
    grouped = kinds.join(roots.select(F.col("node").alias("lid"), "root"), "lid", "left").select("key", "first", "n", F.coalesce("root", "lid").alias("root"))
    heads = grouped.groupBy("root").agg(F.min("first").alias("head"), F.sum("n").alias("n")).where("n > 1").drop("n")
    repeated = grouped.join(heads, "root").select("key", "head")
    dropped = lines.select("id", "mark", "line", "key").join(repeated, "key").where(~place.eqNullSafe(F.col("head"))).groupBy("id", "mark").agg(F.collect_set("line").alias("gone"))
    out = _by_document(own, settle(dropped, "dropped"), "gone", "left")
    parts = F.split("text", "\n")
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.coalesce(F.array_contains("gone", i), F.lit(False))), "\n")
    return out.select(F.col("id").alias(id_col), F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("text"), F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).alias("n_removed"))
