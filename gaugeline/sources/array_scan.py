"""Scan of JSON array files of any size by byte ranges (SRC-4).

One array is one JSON value, but not one task here: Spark's text reader cuts
the file into ranges at the byte ``}``.  What a ``}`` means depends on all that
stands before it (inside a string, inside a nested object), so the scan is a
prefix scan over the ranges:

1. every range gives its effect: whether it ends inside a string and how it changes
   the depth of objects (if any ends inside a string, also for beginning inside one),
   and how many elements it has if it begins between elements;
2. the driver adds up these few numbers, one row for each range of
   ``spark.sql.files.maxPartitionBytes``, to the state and the position at which each range begins;
3. every range is read again with its beginning known and gives its elements with
   their positions; the parts of an element cut by a range's end are put together by position.

Elements are decoded as strictly as a request body.  ``null`` elements are
empty rows and count as positions; a file holding ``null`` or ``[]`` has no rows; an empty
file has none either; anything else that is no JSON array of objects is an error.
"""

from __future__ import annotations

import copy
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeline.sources.json_body import parse_single_bodies

_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
_CLOSE = re.compile(r'(?:[^"\\]|\\.)*"', re.S)
_OPEN = re.compile(r'"(?:[^"\\]|\\.)*$', re.S)
_FLAT = re.compile(r"\s*,\s*\{[^{}\\]*")
_NULL = re.compile(r"\bnull\b")
_LEAD = re.compile(r"\s*(?P<sep>[\[,]?)\s*(?P<nulls>(?:null\s*,\s*)*)$")
_END = re.compile(r"\s*(?P<sep>[\[,]?)\s*(?P<nulls>(?:null\s*(?:,\s*null\s*)*)?)\]\s*$")


def outside(piece: str, inside: bool) -> tuple[str, bool]:
    """The text of a piece outside strings, and whether it ends inside one."""
    if inside:
        m = _CLOSE.match(piece)
        if not m:
            return "", True
        piece = piece[m.end():]
    rest = _STRING.sub('""', piece) if '"' in piece else piece
    m = _OPEN.search(rest.replace('""', "  "))
    return (rest[:m.start()], True) if m else (rest, False)


class Scanner:
    """State at a place of a file: inside a string, depth of objects, text of
    the element under way, elements so far."""

    def __init__(self, inside: bool = False, depth: int = 0, elements: int = 0, begun: bool = False):
        self.inside, self.depth, self.elements, self.begun, self.text = inside, depth, elements, begun, ""

    def piece(self, text: str, closed: bool) -> Iterator[tuple[int, str]]:
        """Elements that end with ``text`` and the ``}`` after it (if ``closed``)."""
        top = self.depth == 0 and not self.begun and not self.inside
        if top and closed and self.elements and _FLAT.fullmatch(text) and text.count('"') % 2 == 0:
            # One flat object without escapes: nearly every piece.
            yield self.elements, text[text.index("{"):] + "}"
            self.elements += 1
            return
        plain, self.inside = outside(text, self.inside)
        # The state is right after this even if what follows raises.
        self.depth += plain.count("{") - (closed and not self.inside)
        if top and "{" in plain:
            lead = text.partition("{")[0]
            m = _LEAD.match(lead)
            if not m or (m["sep"] == "") or (m["sep"] == "[") != (self.elements == 0):
                raise ValueError("no JSON array of objects")
            for _ in _NULL.findall(m["nulls"]):
                yield self.elements, "null"
                self.elements += 1
            text, self.begun = text[len(lead):], True
        if self.depth < 0:
            raise ValueError("no JSON array of objects")
        if self.begun:
            self.text += text + ("}" if closed else "")
            if closed and not self.inside and self.depth == 0:
                yield self.elements, self.text
                self.elements, self.text, self.begun = self.elements + 1, "", False
        elif not closed:
            yield from self.end(text)

    def end(self, text: str) -> Iterator[tuple[int, str]]:
        """The text after the last element."""
        m = _END.match(text)
        if m and ((m["sep"] == "[") == (self.elements == 0)) and not (m["sep"] == "" and m["nulls"]) and (
                m["sep"] != "," or m["nulls"]):
            for _ in _NULL.findall(m["nulls"]):
                yield self.elements, "null"
                self.elements += 1
        elif text.strip() != "null" or self.elements:
            raise ValueError("no JSON array of objects")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    m = F.col("_metadata")
    return spark.read.option("lineSep", "}").text(path).select(
        "value", m["file_path"].alias("file"), m["file_block_start"].alias("start"))


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[tuple[str, bool]]]]:
    """(file, start) of each range of a task, with its pieces and whether a
    piece is the range's last."""
    def rows():
        for b in batches:
            yield from zip(b.column("file").to_pylist(), b.column("start").to_pylist(), b.column("value").to_pylist())
    source, held = rows(), []

    def pieces(key):
        text = held.pop()[2]
        for row in source:
            if row[:2] != key:
                held.append(row)
                break
            yield text, False
            text = row[2]
        yield text, True

    for row in source:
        held.append(row)
        while held:
            key = held[0][:2]
            yield key, pieces(key)


def _elements_after(scan: Scanner, text: str, closed: bool) -> int | None:
    """Elements when ``text`` is the range's last piece; None if it cannot be."""
    scan = copy.copy(scan)
    try:
        for _ in scan.piece(text, closed):
            pass
    except ValueError:
        return None
    return scan.elements


def _effects(pieces: DataFrame, inside: bool = False) -> DataFrame:
    """One row a range that begins outside (or ``inside``) a string, its last
    piece closed: whether it ends inside one and how the depth changes; and its
    elements if it begins between elements, with its last piece closed and as the end of the file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, start), texts in _ranges(batches):
            scan, ok, n = Scanner(inside, elements=int(start > 0)), not inside, [None, None]
            for text, last in texts:
                if last and ok:
                    n = [_elements_after(scan, text, True), _elements_after(scan, text, False)]
                try:
                    for _ in scan.piece(text, True) if ok else ():
                        pass
                except ValueError:
                    ok = False          # it does not begin between elements, or the file is broken
                    continue
                if not ok:
                    plain, scan.inside = outside(text, scan.inside)
                    scan.depth += plain.count("{") - (not scan.inside)
            n = [None if x is None else x - int(start > 0) for x in n]
            yield pa.RecordBatch.from_pylist([{"file": file, "start": start, "inside": scan.inside, "depth": scan.depth, "n": n[0],
                                               "n_final": n[1]}], _EFFECT)
    return pieces.mapInArrow(run, "file string, start long, inside boolean, depth long, n long, n_final long")


_EFFECT = pa.schema([("file", pa.string()), ("start", pa.int64()), ("inside", pa.bool_()), ("depth", pa.int64()), ("n", pa.int64()),
                     ("n_final", pa.int64())])


@dataclass(frozen=True)
class Begin:
    """How a range begins: inside a string, depth, elements before it; ``final``:
    no range of the file follows."""

    inside: bool
    depth: int
    elements: int
    final: bool

    def scanner(self) -> Scanner:
        return Scanner(self.inside, self.depth, self.elements, self.inside or self.depth > 0)


def _elements(pieces: DataFrame, begins: dict[tuple[str, int], Begin], only_count: bool = False) -> DataFrame:
    """(file, start, pos, text, whole) of all elements and parts of elements; or
    one row a range, ``pos`` being the elements that end in it."""
    known = pieces.sparkSession.sparkContext.broadcast(begins)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, start), texts in _ranges(batches):
            begin = known.value[file, start]
            scan = begin.scanner()
            part, out = scan.begun, []
            try:
                for text, last in texts:
                    for pos, element in scan.piece(text, not (last and begin.final)):
                        if not only_count:
                            out.append((file, start, pos, element, not part))
                        part = False
                    if len(out) > 5000:
                        yield _batch(out)
                        out = []
                if begin.final and scan.begun:
                    raise ValueError("the file ends inside an element")
            except ValueError as e:
                raise ValueError(f"snapshot does not decode: {file}: {e}") from None
            if only_count:
                out = [(file, start, scan.elements - begin.elements, None, None)]
            elif scan.begun:
                out.append((file, start, scan.elements, scan.text, False))
            yield _batch(out)
    return pieces.mapInArrow(run, "file string, start long, pos long, text string, whole boolean")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 5
    types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["file", "start", "pos", "text", "whole"])


def scan_array(spark: SparkSession, path: str) -> DataFrame:
    """``(id, type, delta, value, file, pos)`` of the JSON array files at ``path``."""
    pieces = _pieces(spark, path)
    ranges = sorted(_effects(pieces).collect(), key=lambda r: (r.file, r.start))
    # Only where a range ends inside a string may another begin there.
    within = {(r.file, r.start): r for r in _effects(pieces, True).collect()} if any(r.inside for r in ranges) else {}
    begins: dict[tuple[str, int], Begin] = {}
    inside, depth = False, 0
    for i, r in enumerate(ranges):
        if i == 0 or ranges[i - 1].file != r.file:
            inside, depth = False, 0
        begins[r.file, r.start] = Begin(inside, depth, int(r.start > 0), i + 1 == len(ranges) or ranges[i + 1].file != r.file)
        effect = within[r.file, r.start] if inside else r
        depth, inside = depth + effect.depth, effect.inside
    cut = any(b.inside or b.depth for b in begins.values())
    counts = {(r.file, r.start): r.n_final if begins[r.file, r.start].final else r.n for r in ranges}
    if cut or None in counts.values():
        # A range that begins inside an element has to be counted with that
        # known; a broken file raises here.
        counts = {(r.file, r.start): r.pos for r in _elements(pieces, begins, only_count=True).collect()}
    total = 0
    for i, r in enumerate(ranges):
        key = (r.file, r.start)
        total = 0 if i == 0 or ranges[i - 1].file != r.file else total
        begins[key] = replace(begins[key], elements=total)
        total += counts[key]
    found = _elements(pieces, begins)
    body = found.where("whole").select("file", "pos", "text")
    if cut:
        parts = F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda x: x["text"])
        body = body.unionByName(found.where("not whole").groupBy("file", "pos").agg(F.array_join(parts, "").alias("text")))
    rows = parse_single_bodies(body, "text", keep=["file", "pos"])
    bad = F.raise_error(F.concat(F.lit("snapshot does not decode: "), F.col("file")))
    return rows.select(F.when(F.col("decode_ok"), F.col("id")).otherwise(bad).alias("id"), "type", "delta", "value", "file", "pos")
