"""Words and word sequences of whole Arrow batches as 64-bit hashes, without a Python step per word.

A word is a maximal run of bytes of a given kind; all kinds used here hold either all or none of the bytes from 0x80 on,
so runs of bytes are runs of characters. A-Z count as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 512 << 10

_RANDOM = np.random.default_rng(7)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def _kind(*spans: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    for low, high in spans:
        table[low : high + 1] = True
    return table


#: Everything but white space.
PLAIN = ~_kind((0x20, 0x20), (0x09, 0x0D))
#: Letters, digits and all characters beyond ASCII.
ALNUM = _kind((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


@dataclass(frozen=True)
class Words:
    """Words of several texts. `first` has a text's first word, one entry more than texts."""

    hashes: np.ndarray
    first: np.ndarray

    def text_of(self) -> np.ndarray:
        """For each word the text it is in."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and where its texts begin, one entry more than texts. A null text is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def texts(batch: pa.RecordBatch) -> pa.Array:
    """The texts of a batch: its column text, or that of the whole rows in its column row."""
    if "text" in batch.schema.names:
        return batch.column("text")
    return batch.column("row").field(batch.schema.field("row").type.get_field_index("text"))


def chunks(at: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `most` bytes together; a longer text is a run of its own."""
    low, n = 0, len(at) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(at, at[low] + most, "right")) - 1)
        yield low, high
        low = high


def spans(data: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of all texts start and end."""
    inside = kind[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    borders = at[1:-1]
    borders = borders[(borders > 0) & (borders < len(data))]
    starts[borders] = inside[borders]
    ends[borders - 1] = inside[borders - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def words(data: np.ndarray, at: np.ndarray, kind: np.ndarray) -> Words:
    """Hashes of the words of some texts, given as bytes and borders that start at 0."""
    start, end = spans(data, at, kind)
    with np.errstate(over="ignore"):
        power = np.full(len(data) + 1, _BASE, dtype=np.uint64)
        power[0] = 1
        np.cumprod(power, out=power)
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * power[:-1], out=total[1:])
        unshift = np.full(len(data) + 1, _INVERSE, dtype=np.uint64)
        unshift[0] = 1
        np.cumprod(unshift, out=unshift)
        hashes = mixed((total[end] - total[start]) * unshift[start])
    return Words(hashes, np.searchsorted(start, at))


def sequences(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for every n words in a row, wherever they start; texts are not told apart."""
    count = max(0, len(hashes) - n + 1)
    with np.errstate(over="ignore"):
        out = np.zeros(count, dtype=np.uint64)
        for j in range(n):
            out += hashes[j : j + count] * _PLACE[j % 64] + np.uint64(j >> 6)
        return mixed(out)


def of_texts(texts: list[str | None], kind: np.ndarray) -> Words:
    data, at = buffers(pa.array(texts, pa.large_string()))
    return words(data, at, kind)
