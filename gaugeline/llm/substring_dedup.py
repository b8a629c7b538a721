"""Removal of repeated passages (suffix-array dedup).

A byte goes when a 400-byte string covering it also starts elsewhere, in any
document.  ``without_repeats`` removes repeated strings of 51 words too, of which many
are shorter: the same search with words as symbols, whatever white space is between them.  The README says why the strings are found by content-defined
anchors and not by one global round for each symbol.

1. Equal texts collapse; a class of at least 400 bytes with two or more
   documents is removed whole, and its text is searched once.
2. Every 400-byte string is keyed by its 64-byte gram of the smallest hash
   (its anchor).  Equal strings have equal anchors, at the same offset.  A
   maximal run of starts with one anchor place is an occurrence; its anchor is
   the part common to its strings, its whole extent the part they cover.
3. Occurrences with an equal extent are repeated as a whole.  Where an anchor
   has several extents, one occurrence of each is cut into blocks of 16 starts
   at fixed offsets from the anchor, and the same is done again: a block's
   core is common to its strings, its hull is what they cover.
4. Where a core has several hulls, one block of each emits its 400-byte strings
   (96-bit hashes), and those found twice are repeated.

So only strings at the edges of repeated passages are ever written out.  Tables
are removed when a later one holds what is needed of them.  Grouping is by
aggregates with partial sums only; nothing is collected but the spans of one
document.  Defined cases: rows are told apart by numbers of their own, so null
and repeated doc_ids are rows like others, and rows with equal text are copies
whatever their ids; null and empty texts have no bytes; texts below 400 bytes
keep everything; other columns are ignored.  ``kept_text`` leaves out the bytes
of a character that a removal cut in two (the hash has them).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from gaugeline.llm.common import DOCUMENT_COLUMNS, Scratch

LENGTH = 400
GRAM = 64
BLOCK = 16
WORDS = 51       # a passage of over 50 words
_U = np.uint64
_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_BYTES = np.random.default_rng(20).integers(1, 2**63, (2, 256), dtype=np.uint64)


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


def _byte_values(data: bytes, which: int) -> np.ndarray:
    return _BYTES[which][np.frombuffer(data, np.uint8)]


def _word_values(data: bytes, which: int) -> np.ndarray:
    # On bytes, split() knows [\x20\x09-\x0D] only.
    return np.fromiter((xxhash.xxh3_64_intdigest(w, which) for w in data.split()), np.uint64)


class Unit(NamedTuple):
    """What a text is a string of, and the sizes of the search in such symbols."""

    values: Callable[[bytes, int], np.ndarray]
    length: int
    gram: int
    block: int
    least: int       # bytes of the shortest text that holds such a string
    prefix: str      # of the written tables


BYTE = Unit(_byte_values, LENGTH, GRAM, BLOCK, LENGTH, "")
WORD = Unit(_word_values, WORDS, 8, 4, 2 * WORDS - 1, "words-")


class Rolling:
    """Hashes of any substrings of one string, modulo 2**64."""

    def __init__(self, data: bytes, which: int = 0, unit: Unit = BYTE):
        value = unit.values(data, which)
        n = len(value)
        base = _BASES[which]
        self.inverse = self._powers(pow(base, -1, 2**64), n + 1)
        value = value * self._powers(base, n + 1)[:n]
        self.sum = np.concatenate([np.zeros(1, _U), np.cumsum(value, dtype=_U)])

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        p = np.full(n, _U(base))
        p[0] = 1
        return np.multiply.accumulate(p)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sum[end] - self.sum[start]) * self.inverse[start])


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of ``w`` values."""
    n = len(x)
    full = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    full[:n] = x
    blocks = full.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n - w + 1], left[w - 1:n])


def occurrences(data: bytes, unit: Unit = BYTE) -> tuple[np.ndarray, ...]:
    """anchor, extent hash, first and last start and anchor place of each occurrence."""
    roll = Rolling(data, unit=unit)
    n = len(roll.sum) - 1
    if n < unit.length:
        return (np.zeros(0, np.int64),) * 5
    at = np.arange(n - unit.gram + 1)
    grams = roll.of(at, at + unit.gram)
    # High half: hash, low half: place, so that ties go to the leftmost gram.
    m = _sliding_min((grams >> _U(32) << _U(32)) | at.astype(_U), unit.length - unit.gram + 1)
    lo = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
    hi = np.concatenate([lo[1:] - 1, [len(m) - 1]])
    place = (m[lo] & _U(0xFFFFFFFF)).astype(np.int64)
    return grams[place].view(np.int64), roll.of(lo, hi + unit.length).view(np.int64), lo, hi, place


def blocks(data: bytes, lo: np.ndarray, hi: np.ndarray, place: np.ndarray, single: np.ndarray,
           unit: Unit = BYTE) -> tuple[np.ndarray, ...]:
    """core hash, hull hash, first and last start and ``single`` of each block of the occurrences."""
    roll = Rolling(data, unit=unit)
    low = (lo - place) // unit.block
    count = (hi - place) // unit.block - low + 1
    which = np.repeat(np.arange(len(lo)), count)
    block = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + low[which]
    at = place[which] + block * unit.block
    a, b = np.maximum(lo[which], at), np.minimum(hi[which], at + unit.block - 1)
    return (roll.of(at + unit.block - 1, at + unit.length).view(np.int64), roll.of(a, b + unit.length).view(np.int64), a, b, single[which])


ROWS = "outer long, inner long, row long, lo int, hi int, place int, single boolean"


def _rows(row: int, outer, inner, lo, hi, place, single) -> pa.RecordBatch:
    n = len(lo)
    return pa.RecordBatch.from_arrays(
        [pa.array(outer), pa.array(inner), pa.array(np.full(n, row, np.int64)), *[pa.array(x.astype(np.int32)) for x in (lo, hi, place)],
         pa.array(single)], ["outer", "inner", "row", "lo", "hi", "place", "single"])


def _find(batches: Iterator[pa.RecordBatch], unit: Unit) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row, text in zip(b.column("row"), b.column("text")):
            found = occurrences(text.as_py().encode(), unit)
            yield _rows(row.as_py(), *found, np.ones(len(found[0]), bool))


def _spans(b: pa.RecordBatch, i: int) -> tuple[np.ndarray, ...]:
    spans = b.column("spans")[i].values
    return tuple(np.asarray(spans.field(x).to_numpy(zero_copy_only=False)) for x in ("lo", "hi", "place", "single"))


def _blocks(batches: Iterator[pa.RecordBatch], unit: Unit) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            lo, hi, place, single = _spans(b, i)
            core, hull, lo, hi, single = blocks(b.column("text")[i].as_py().encode(), lo.astype(np.int64), hi.astype(np.int64),
                                                place.astype(np.int64), single, unit)
            yield _rows(b.column("row")[i].as_py(), core, hull, lo, hi, lo, single)


def _strings(batches: Iterator[pa.RecordBatch], unit: Unit) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            data = b.column("text")[i].as_py().encode()
            row = b.column("row")[i].as_py()
            one, two = Rolling(data, 0, unit), Rolling(data, 1, unit)
            lo, hi, _, single = _spans(b, i)
            for j in range(0, len(lo), 4096):
                count = (hi - lo + 1)[j:j + 4096].astype(np.int64)
                at = np.arange(count.sum()) + np.repeat(lo[j:j + 4096] - (np.cumsum(count) - count), count)
                second = (two.of(at, at + unit.length) >> _U(33)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one.of(at, at + unit.length).view(np.int64)), pa.array(second), pa.array(np.full(len(at), row, np.int64)),
                     pa.array(at.astype(np.int32)), pa.array(np.repeat(single[j:j + 4096], count))], ["h1", "h2", "row", "lo", "single"])


def _word_bytes(data: bytes, copies: int, spans) -> list[tuple[int, int]]:
    """(first byte, end) of the repeated passages of words."""
    if copies == 1 and spans is None:
        return []
    words = [x.span() for x in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    if copies > 1:
        return [(words[0][0], words[-1][1])] if len(words) >= WORDS else []
    return [(words[lo][0], words[hi + WORDS - 1][1]) for lo, hi in zip(spans.field("lo").to_pylist(), spans.field("hi").to_pylist())]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
    for b in batches:
        rows = []
        for i in range(b.num_rows):
            data = b.column("text")[i].as_py().encode()
            n = len(data)
            step = np.zeros(n + 1, np.int64)
            if b.column("copies")[i].as_py() > 1 and n >= LENGTH:
                step[0] += 1
                step[n] -= 1
            spans = b.column("marks")[i].values
            if spans is not None:
                np.add.at(step, spans.field("lo").to_numpy(), 1)
                np.add.at(step, spans.field("hi").to_numpy() + LENGTH, -1)
            if "word_marks" in b.schema.names:
                for lo, hi in _word_bytes(data, b.column("copies")[i].as_py(), b.column("word_marks")[i].values):
                    step[lo] += 1
                    step[hi] -= 1
            gone = np.cumsum(step[:n]) > 0
            edges = np.diff(np.concatenate([[0], gone.astype(np.int8)]))
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            rows.append((b.column("key")[i].as_py(), n, int(gone.sum()), int((edges == 1).sum()),
                         hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)


def _shared(rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The rows whose outer part is found twice: ``whole`` if the inner part is
    found twice too, ``emits`` if the row stands for its inner part among others
    of the same outer part, ``single`` if the row's strings may still be single."""
    twice = scratch.write(rows.groupBy("outer").count().where("count > 1").select("outer"), f"{name}-twice")
    kinds = scratch.write(rows.join(twice, "outer", "left_semi").groupBy("outer", "inner").agg(
        F.count("*").alias("times"), F.min(F.struct("row", "lo")).alias("first"), F.bool_or("single").alias("open")), f"{name}-kinds")
    several = kinds.groupBy("outer").agg(F.count("*").alias("kinds"), F.bool_or(F.expr("times = 1 and open")).alias("left"))
    kinds = scratch.write(kinds.join(several, "outer").where("times > 1 or (kinds > 1 and left)"), f"{name}-asked")
    out = scratch.write(rows.join(kinds, ["outer", "inner"]).select(
        "row", "lo", "hi", "place", F.expr("single and times > 1").alias("whole"), F.expr("single and times = 1").alias("single"),
        F.expr("kinds > 1 and left and first.row = row and first.lo = lo").alias("emits")).where("whole or emits"), f"{name}-shared")
    scratch.drop(f"{name}-twice", f"{name}-kinds", f"{name}-asked")
    return out


def _spans_by_row(rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    return scratch.write(rows.where("emits").groupBy("row").agg(
        F.collect_list(F.struct("lo", "hi", "place", "single")).alias("spans")), name)


def _marks(texts: DataFrame, classes: DataFrame, scratch: Scratch, unit: Unit) -> DataFrame:
    """row and marks: the first and last starts of repeated strings, in symbols of ``unit``."""
    p = unit.prefix
    find, cut, spell = (lambda b: _find(b, unit)), (lambda b: _blocks(b, unit)), (lambda b: _strings(b, unit))
    long_ = texts.where(F.octet_length("text") >= unit.least)
    found = scratch.write(long_.join(classes.select("row"), "row").select("row", "text").mapInArrow(find, ROWS), f"{p}anchors")
    runs = _shared(found, scratch, f"{p}runs")
    scratch.drop(f"{p}anchors")
    asked = _spans_by_row(runs, scratch, f"{p}runs-asked")
    cores = scratch.write(long_.join(asked, "row").select("row", "text", "spans").mapInArrow(cut, ROWS), f"{p}cores")
    parts = _shared(cores, scratch, f"{p}parts")
    scratch.drop(f"{p}cores")
    asked = _spans_by_row(parts, scratch, f"{p}parts-asked")
    strings = scratch.write(long_.join(asked, "row").select("row", "text", "spans").mapInArrow(
        spell, "h1 long, h2 int, row long, lo int, single boolean"), f"{p}strings")
    twice = scratch.write(strings.groupBy("h1", "h2").agg(F.count("*").alias("c"), F.bool_or("single").alias("open"))
                          .where("c > 1 and open").select("h1", "h2"), f"{p}strings-twice")
    starts = strings.where("single").join(twice, ["h1", "h2"], "left_semi").select("row", "lo", F.col("lo").alias("hi"))
    marks = scratch.write(runs.where("whole").select("row", "lo", "hi").union(parts.where("whole").select("row", "lo", "hi")).union(starts)
                          .groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("marks")), f"{p}marks")
    scratch.drop(*[p + x for x in ("strings", "strings-twice", "runs-shared", "runs-asked", "parts-shared", "parts-asked")])
    return marks


def _with_cuts(docs: DataFrame, text: bool, words: bool = False) -> DataFrame:
    """The columns of ``docs`` but the text, and the results of its search."""
    scratch = Scratch(docs.sparkSession, "repeats")
    docs = scratch.write(docs.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("row", F.monotonically_increasing_id())
                         .withColumn("key", F.unhex(F.sha2("text", 256))), "rows")
    classes = scratch.write(docs.groupBy("key").agg(F.min("row").alias("row"), F.count("*").alias("copies")), "classes")
    texts = docs.select("row", "key", "text")
    cut = texts.join(classes.select("row", "copies"), "row").join(_marks(texts, classes, scratch, BYTE), "row", "left")
    if words:
        cut = cut.join(_marks(texts, classes, scratch, WORD).withColumnRenamed("marks", "word_marks"), "row", "left")
    cut = cut.drop("row").mapInArrow(
        _cut, "key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    cut = scratch.write(cut if text else cut.drop("kept_text"), "cut")
    out = scratch.write(docs.drop("text", "row").join(cut, "key").drop("key"), "result")
    scratch.drop("rows", "classes", "marks", "words-marks", "cut")
    return out


def repeated_spans(docs: DataFrame, text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``text``, kept_text."""
    return _with_cuts(docs.select("doc_id", "text"), text)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated strings of 400 bytes and of 51 words; texts left without a word are dropped."""
    out = _with_cuts(docs.select(*DOCUMENT_COLUMNS), True, words=True).where(F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source",
                      F.length("kept_text").cast(docs.schema["n_chars"].dataType).alias("n_chars"))
