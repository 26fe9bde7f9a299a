"""Arrays of a fixed size that tasks fill and that are added up, whatever the size of the input."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICES = 16


def slices(array: np.ndarray) -> pa.RecordBatch:
    """An array as rows (no, data), as `summed` takes them."""
    return pa.RecordBatch.from_pydict(
        {"no": pa.array(range(SLICES), pa.int32()), "data": pa.array([s.tobytes() for s in array.reshape(SLICES, -1)], pa.binary())}
    )


def summed(parts: DataFrame, size: int, kind: type, add: np.ufunc, wide: type | None = None) -> np.ndarray:
    """Combines the arrays of all tasks, slice by slice, as `wide` numbers if given. Rows stream, so memory holds a slice or
    two; the driver gets one array of `size` entries."""
    wide = wide or kind

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for no, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                new = np.frombuffer(data, dtype=kind).astype(wide)
                sums[no] = add(sums[no], new) if no in sums else new
        yield pa.RecordBatch.from_pydict({"no": pa.array(list(sums), pa.int32()), "data": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

    out = np.zeros((SLICES, size // SLICES), dtype=wide)
    for row in parts.repartition(SLICES, "no").mapInArrow(total, "no int, data binary").collect():
        out[row.no] = np.frombuffer(row.data, dtype=wide)
    return out.ravel()


class Among:
    """A bit for each bucket of 64-bit values: a value whose bit is not set is certainly not among those put in.

    The upper bits of the values are the bucket, so they have to be spread evenly.
    """

    def __init__(self, values: DataFrame, bits: int) -> None:
        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = np.zeros(1 << bits, dtype=bool)
            for batch in batches:
                table[(batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)] = True
            yield slices(np.packbits(table, bitorder="little"))

        self.bits = bits
        self.table = summed(values.mapInArrow(mark, "no int, data binary"), (1 << bits) // 8, np.uint8, np.bitwise_or)

    def maybe(self, values: np.ndarray) -> np.ndarray:
        place = (values.view(np.uint64) >> np.uint64(64 - self.bits)).astype(np.int64)
        return ((self.table[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(bool)
