"""Words and word hashes of whole texts, from the bytes of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACES = bytes([0x20, *range(0x09, 0x0E)])
#: Lower-cases A-Z and leaves the rest: words are then the runs between SPACES, as bytes.split() cuts them.
LOWER = bytes(range(256)).lower()
#: Lower-cases A-Z; everything below 0x80 but letters and digits becomes a space.
ALPHANUMERIC = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in LOWER)

#: A text is hashed in pieces of about so many bytes, cut between words.
PIECE = 1 << 21
_BYTE_VALUES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all others (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its texts; nulls are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(offsets):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: int, size: int = 6 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `size` bytes of text, one text at least, so that working memory doesn't follow the batch."""
    _, offsets = text_bytes(batch.column(column))
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_VALUE = _BYTE_VALUES[np.frombuffer(LOWER, np.uint8)]
_VALUE[list(SPACES)] = 0


def _pieces(data: np.ndarray) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and not _IS_SPACE[data[end]]:
            ahead = np.flatnonzero(_IS_SPACE[data[end : end + 4096]])
            end = end + int(ahead[0]) if len(ahead) else min(end + 4096, len(data))
        yield at, end
        at = end


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all lower-cased words, and for each text the place of its first word (and the end)."""
    hashes, starts = [], []
    for at, end in _pieces(data):
        piece = data[at:end]
        inside = ~_IS_SPACE[piece]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cuts = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end)] - at  # texts begin words too
        first[cuts] = inside[cuts]
        where = np.flatnonzero(first)
        if not len(where):
            continue
        place = np.zeros(len(piece), np.int64)
        place[where[0] :] = np.arange(where[0], len(piece)) - np.repeat(where, np.diff(where, append=len(piece)))
        powers = np.full(int(place.max()) + 1, _STEP, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        hashes.append(mixed(np.add.reduceat(_VALUE[piece] * powers[place], where)))
        starts.append(where + at)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def distinct_pairs(group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, value) with their counts, by group and value."""
    if not len(value):
        return group[:0], value[:0], np.zeros(0, np.int64)
    order = np.lexsort((value, group))
    group, value = group[order], value[order]
    new = np.concatenate([[True], (group[1:] != group[:-1]) | (value[1:] != value[:-1])])
    at = np.flatnonzero(new)
    return group[at], value[at], np.diff(at, append=len(value))
