"""Fixed-size arrays that tasks fill in parts and Spark merges.

A task fills an array of the same length as every other task and ships it as
compressed segments; segments of one number meet in one task, which folds them
one after the other, so no task holds more than its share of the array.  Only
the merged array, whose length is a parameter and not a property of the data,
comes to the driver to be broadcast.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SEGMENT = 1 << 16     # bytes of a segment
SCHEMA = "segment int, data binary"


def segments(array: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The segments of ``array`` that are not all zero."""
    raw = array.view(np.uint8).reshape(-1)
    for first in range(0, len(raw), SEGMENT * 64):
        at, data = [], []
        for start in range(first, min(first + SEGMENT * 64, len(raw)), SEGMENT):
            piece = raw[start:start + SEGMENT]
            if piece.any():
                at.append(start // SEGMENT)
                data.append(zlib.compress(piece.tobytes(), 1))
        if at:
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(data, pa.binary())], ["segment", "data"])


def merged(parts: DataFrame, n_bytes: int, fold: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The fold of all tasks' arrays, as bytes.  ``fold`` takes and returns
    segments and must not depend on the order."""
    n = max(1, min(-(-n_bytes // SEGMENT), int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[int, np.ndarray] = {}
        for b in batches:
            for at, data in zip(b.column("segment").to_pylist(), b.column("data").to_pylist()):
                piece = np.frombuffer(zlib.decompress(data), np.uint8)
                have[at] = fold(have[at], piece) if at in have else piece
        for at, piece in have.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zlib.compress(piece.tobytes(), 1)], pa.binary())],
                                             ["segment", "data"])

    out = np.zeros(n_bytes, np.uint8)
    for r in parts.select("segment", "data").repartition(n, "segment").mapInArrow(run, SCHEMA).collect():
        piece = np.frombuffer(zlib.decompress(r.data), np.uint8)
        out[r.segment * SEGMENT:r.segment * SEGMENT + len(piece)] = piece
    return out
