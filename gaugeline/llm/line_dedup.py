"""Line deduplication: lines found in many documents are removed.

1. Every task reads its documents' line keys into two Bloom filters: one of
   the hashes seen once, one of those met again.  The filters of two tasks
   merge into one pair: ``once`` is their union, and ``twice`` the union of both
   ``twice`` and of what both ``once`` share, so no repeat across tasks is missed.
2. Lines whose hash is in ``twice`` are suspects; only they are shuffled, as
   one (key, document) each, and counted by their exact text.  A false positive
   of the filter costs a shuffled row and changes no result.
3. The confirmed keys are removed from the documents: by a broadcast set
   while their bytes stay below ``broadcast_bytes`` (checked), else by a join of the
   suspects' positions that splits on hot keys.

A filter has 12 bits for each line and ``max_bits`` at most (a parameter that
bounds the broadcast); beyond that more lines are suspects and the result is the same.

Defined cases: each row is a document of its own, whatever its doc_id (null,
repeated); a null or empty text is one empty line; the empty key is never
removed; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from gaugeline.llm.bitmaps import SCHEMA, merged, segments
from gaugeline.llm.common import materialize

SPACE = b" \t\n\x0b\x0c\r"
BITS_A_LINE = 12
OUT = "n_lines long, n_dropped long, kept_sha256 string, kept_text binary"


def line_keys(data: bytes | None) -> tuple[list[bytes], list[bytes]]:
    """The lines of a text and their keys."""
    lines = (data or b"").split(b"\n")
    return lines, [x.strip(SPACE).lower() for x in lines]


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (least <= 1 or len(key.decode(errors="replace")) >= least)


def _hashes(keys) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def _places(h: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Word of the filter and the four bits in it, for each hash."""
    mask = np.zeros(len(h), np.uint64)
    for shift in (0, 6, 12, 18):
        mask |= np.uint64(1) << ((h >> np.uint64(shift)) & np.uint64(63))
    return ((h >> np.uint64(24)) % np.uint64(words)).astype(np.int64), mask


class Filters:
    """The once-seen and twice-seen filters of one task, side by side."""

    def __init__(self, bits: int):
        self.bits = np.zeros((2, bits // 64), np.uint64)

    def add(self, h: np.ndarray) -> None:
        """Hashes of keys that each stand for one document."""
        h, n = np.unique(h, return_counts=True)
        at, mask = _places(h, self.bits.shape[1])
        again = (n > 1) | ((self.bits[0][at] & mask) == mask)
        np.bitwise_or.at(self.bits[1], at[again], mask[again])
        np.bitwise_or.at(self.bits[0], at, mask)

    def interleaved(self) -> np.ndarray:
        """Both filters' words in turn, so that a segment holds both."""
        return np.ascontiguousarray(self.bits.T)


def join_filters(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x, y = a.view(np.uint64).reshape(-1, 2), b.view(np.uint64).reshape(-1, 2)
    out = x | y
    out[:, 1] |= x[:, 0] & y[:, 0]
    return out.view(np.uint8).reshape(-1)


def repeated_filter(docs: DataFrame, least: int, max_bits: int) -> np.ndarray:
    """The twice-seen filter of all documents."""
    n = docs.select(F.sum(F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) + 1)).first()[0] or 0
    bits = min(max_bits, 1 << max(20, int(n * BITS_A_LINE - 1).bit_length()))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Filters(bits)
        for b in batches:
            found = [_hashes([k for k in set(line_keys(d)[1]) if _long_enough(k, least)]) for d in b.column("text").to_pylist()]
            if found:
                seen.add(np.concatenate(found))
        yield from segments(seen.interleaved())

    parts = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(fill, SCHEMA)
    return np.ascontiguousarray(merged(parts, bits // 4, join_filters).view(np.uint64).reshape(-1, 2)[:, 1])


def _suspect_test(filter_words) -> Callable[[list[bytes]], np.ndarray]:
    def test(keys: list[bytes]) -> np.ndarray:
        at, mask = _places(_hashes(keys), len(filter_words))
        return (filter_words[at] & mask) == mask
    return test


def suspects(docs: DataFrame, least: int, max_bits: int, positions: bool = False) -> DataFrame:
    """(key) of every document's suspected repeats, once a document; with
    ``positions`` (key, row, at) with all their line numbers."""
    twice = docs.sparkSession.sparkContext.broadcast(repeated_filter(docs, least, max_bits))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = _suspect_test(twice.value)
        for b in batches:
            rows = b.column("row").to_pylist() if positions else [None] * b.num_rows
            keys, owners, places = [], [], []
            for row, data in zip(rows, b.column("text").to_pylist()):
                where: dict[bytes, list[int]] = {}
                for i, k in enumerate(line_keys(data)[1]):
                    where.setdefault(k, []).append(i)
                own = [k for k in where if _long_enough(k, least)]
                keys += own
                if positions:
                    owners += [row] * len(own)
                    places += [where[k] for k in own]
            hit = np.flatnonzero(test(keys)) if keys else np.empty(0, np.int64)
            out = [pa.array([keys[i] for i in hit], pa.binary())]
            if positions:
                out += [pa.array([owners[i] for i in hit], pa.int64()), pa.array([places[i] for i in hit], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(out, ["key", "row", "at"][:len(out)])

    text = F.col("text").cast("binary").alias("text")
    if positions:
        return docs.select("row", text).mapInArrow(probe, "key binary, row long, at array<int>")
    return docs.select(text).mapInArrow(probe, "key binary")


def _result(lines: list[bytes], gone) -> tuple[int, int, str, bytes]:
    kept = b"\n".join(x for i, x in enumerate(lines) if i not in gone)
    return len(lines), len(gone), hashlib.sha256(kept).hexdigest(), kept


def _rewrite(docs: DataFrame, dropped: Callable[[dict, list[bytes]], set[int]], columns: list[str]) -> DataFrame:
    """doc_id and OUT of every row; ``dropped`` gives the line numbers that go."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            extra = [b.column(c).to_pylist() for c in columns]
            for data, *own in zip(b.column("text").to_pylist(), *extra):
                lines, keys = line_keys(data)
                out.append(_result(lines, dropped(own, keys)))
            cols = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()),
                 pa.array(cols[3], pa.binary())], ["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept_text"])

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), *columns)
    return rows.mapInArrow(run, f"doc_id {key}, {OUT}").withColumn("kept_text", F.col("kept_text").cast("string"))


def _by_broadcast(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    known = docs.sparkSession.sparkContext.broadcast(frozenset(bytes(r.key) for r in repeated.select("key").collect()))
    return _rewrite(docs, lambda _, keys: {i for i, k in enumerate(keys) if k in known.value}, [])


def _by_join(docs: DataFrame, repeated: DataFrame, found: DataFrame, keep_first: bool) -> DataFrame:
    """``docs`` has a column ``row``; ``found`` is (key, row, at)."""
    hits = found.join(repeated.select("key", *(["first_row"] if keep_first else [])), "key")
    if keep_first:
        hits = hits.withColumn("at", F.when(F.col("row") == F.col("first_row"), F.slice("at", 2, F.greatest(F.size("at") - 1, F.lit(0))))
                               .otherwise(F.col("at")))
    gone = hits.groupBy("row").agg(F.flatten(F.collect_list("at")).alias("gone"))
    return _rewrite(docs.join(gone, "row", "left"), lambda own, _: set(own[0] or ()), ["gone"])


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep: str = "none", max_bits: int = 1 << 29,
               broadcast_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 and kept_text of every row.

    A line's key is the line stripped of ASCII white space and with A-Z
    lower-cased.  Keys of at least ``min_chars`` code points that stand in at least
    ``min_docs`` documents lose all their lines (``keep='none'``) or all but the
    first one of the first document in table order (``keep='first'``).
    """
    if keep not in ("none", "first") or min_docs < 2 or min_chars < 1:
        raise ValueError("keep is 'none' or 'first', min_docs at least 2 and min_chars at least 1")
    docs = docs.select("doc_id", "text")
    if keep == "none":
        counted = suspects(docs, min_chars, max_bits).groupBy("key").agg(F.count("*").alias("n"))
        repeated = materialize(counted.where(F.col("n") >= min_docs), "line-dedup-repeated")
        n_bytes = repeated.agg(F.sum(F.octet_length("key") + 64)).first()[0] or 0
        if n_bytes <= broadcast_bytes:
            return _by_broadcast(docs, repeated)
    # The way for any number of repeated keys: row numbers that stay the
    # same in every later read, so they are written with the texts.
    docs = materialize(docs.withColumn("row", F.monotonically_increasing_id()), "line-dedup-rows")
    found = materialize(suspects(docs, min_chars, max_bits, positions=True), "line-dedup-suspects")
    counted = found.groupBy("key").agg(F.count("*").alias("n"), F.min("row").alias("first_row"))
    repeated = materialize(counted.where(F.col("n") >= min_docs), "line-dedup-repeated")
    return _by_join(docs, repeated, found, keep == "first")
