"""Two Bloom filters over 64-bit hashes (seen once, seen twice) with an optional count-min row, built where the data is."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Cells in one merged piece, so that a merging task never holds whole filters.
SEGMENT = 1 << 18
#: Upper bound of the filters' cells: 16 MB a filter. Fuller filters call more hashes suspected; they never miss one.
MAX_CELLS = 1 << 27


@dataclass
class Sketch:
    """``twice``: bits of the cells hit at least twice. ``counts``: levels of the count-min row (1, and one more for each doubling above the base), or an empty array."""

    twice: np.ndarray
    cells: int
    probes: int
    counts: np.ndarray

    def repeated(self, hashes: np.ndarray) -> np.ndarray:
        """False only for hashes that were certainly added once at most."""
        out = np.ones(len(hashes), dtype=bool)
        for place in places(hashes, self.cells, self.probes):
            out &= (self.twice[place >> 3] >> (place & 7).astype(np.uint8)) & 1 > 0
        return out

    def estimate(self, hashes: np.ndarray) -> np.ndarray:
        """Level of each hash; never below that of its true count."""
        return self.counts[(hashes >> np.uint64(11)) % np.uint64(len(self.counts))]


def places(hashes: np.ndarray, cells: int, probes: int) -> Iterator[np.ndarray]:
    """Each probe's cell for every hash."""
    for k in range(probes):
        mixed = hashes * np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF | 1)
        yield ((mixed ^ (mixed >> np.uint64(31))) % np.uint64(cells)).astype(np.int64)


def _set(bits: np.ndarray, cells: np.ndarray) -> None:
    """Set the bits of sorted distinct cells."""
    if len(cells):
        byte = cells >> 3
        start = np.flatnonzero(np.concatenate(([True], byte[1:] != byte[:-1])))
        bits[byte[start]] |= np.bitwise_or.reduceat(np.uint8(1) << (cells & 7).astype(np.uint8), start)


def cells_for(items: int, per_item: int) -> int:
    """A power of two of about ``per_item`` cells for each item, within the bounds."""
    return min(MAX_CELLS, max(SEGMENT, 1 << max(1, items * per_item - 1).bit_length()))


def build(rows: DataFrame, hashes_of: Callable[[pa.RecordBatch], np.ndarray], cells: int, probes: int, counters: int = 0, at_once: int = 1000, base: float = 1.0) -> Sketch:
    """Add what ``hashes_of`` makes of every batch of ``rows``.

    As many tasks as the cluster runs at once each fill filters of bounded size; the pieces are merged by
    segment (a cell that two tasks have hit once counts as hit twice), and only the bits of ``twice`` and the
    the counters' levels above ``base``, whose size is bounded whatever the input, come to the driver. ``at_once`` rows
    are hashed together.
    """
    spark = rows.sparkSession

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, again = np.zeros(cells // 8, dtype=np.uint8), np.zeros(cells // 8, dtype=np.uint8)
        counts = np.zeros(counters, dtype=np.int32)
        for whole in batches:
            for low in range(0, whole.num_rows, at_once):
                hashes = hashes_of(whole.slice(low, at_once))
                for place in places(hashes, cells, probes):
                    cell, times = np.unique(place, return_counts=True)
                    seen = (first[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 > 0
                    _set(again, cell[seen | (times > 1)])
                    _set(first, cell)
                if counters:
                    np.add.at(counts, ((hashes >> np.uint64(11)) % np.uint64(counters)).astype(np.int64), 1)
        for segment in range(cells // SEGMENT):
            part = slice(segment * SEGMENT // 8, (segment + 1) * SEGMENT // 8)
            if first[part].any():
                once, twice = (zlib.compress(bits[part].tobytes(), 1) for bits in (first, again))
                yield pa.RecordBatch.from_pydict({"segment": [segment], "once": [once], "twice": [twice]}, schema=schema)
        for k in range(0, counters, SEGMENT):
            if counts[k : k + SEGMENT].any():
                yield pa.RecordBatch.from_pydict({"segment": [-1 - k // SEGMENT], "once": [zlib.compress(counts[k : k + SEGMENT].tobytes(), 1)], "twice": [b""]}, schema=schema)

    def merge(pieces: pa.Table) -> pa.Table:
        segment = pieces.column("segment")[0].as_py()
        parts = zip(pieces.column("once").to_pylist(), pieces.column("twice").to_pylist(), strict=True)
        if segment < 0:
            total = sum(np.frombuffer(zlib.decompress(once), dtype=np.int32).astype(np.int64) for once, _ in parts)
            level = (1 + np.log2(np.maximum(1, total / base))).astype(np.uint8)
            return pa.table({"segment": [segment], "bits": [zlib.compress(level.tobytes(), 1)]}, schema=merged)
        seen, again = np.zeros(SEGMENT // 8, dtype=np.uint8), np.zeros(SEGMENT // 8, dtype=np.uint8)
        for once, twice in parts:
            one = np.frombuffer(zlib.decompress(once), dtype=np.uint8)
            again |= np.frombuffer(zlib.decompress(twice), dtype=np.uint8) | (seen & one)
            seen |= one
        return pa.table({"segment": [segment], "bits": [zlib.compress(again.tobytes(), 1)]}, schema=merged)

    schema = pa.schema([("segment", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])
    merged = pa.schema([("segment", pa.int32()), ("bits", pa.binary())])
    filled = rows.coalesce(max(1, spark.sparkContext.defaultParallelism)).mapInArrow(fill, "segment int, once binary, twice binary")
    twice, counts = np.zeros(cells // 8, dtype=np.uint8), np.ones(counters, dtype=np.uint8)
    for row in filled.groupBy("segment").applyInArrow(merge, "segment int, bits binary").collect():
        whole = zlib.decompress(row.bits)
        if row.segment < 0:
            at = (-1 - row.segment) * SEGMENT
            counts[at : at + SEGMENT] = np.frombuffer(whole, dtype=np.uint8)
        else:
            twice[row.segment * SEGMENT // 8 : (row.segment + 1) * SEGMENT // 8] = np.frombuffer(whole, dtype=np.uint8)
    return Sketch(twice, cells, probes, counts)
