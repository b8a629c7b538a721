"""Phrase collocation mining over a weighted de Bruijn graph.

Nodes are three-word grams, edges four-word grams between overlapping nodes;
an edge's weight is its number of occurrences inside pieces, per language.

1. One pass counts words and fills a sketch of fixed size with the counts of
   adjacent word pairs.  A pair below ``min_count`` in the sketch is below it in
   truth (collisions only raise a count), so no phrase of at least ``min_count``
   occurrences spans it: pieces are broken there, which loses none of its occurrences.
2. A second pass emits the longest grams as edges, and for every broken piece
   the shorter gram at its end.  Spark sums both.
3. A node's count is the flow out of it plus the pieces that end with it; a
   pair's count is the flow of the nodes that start with it plus the pieces that end with it.
4. Edges that meet in a node through which all flow of both goes are one path of
   constant weight.  Paths are compacted by pointer doubling; four-word phrases are read from them.
5. Every phrase is scored at its weakest cut, those that stand in a longer one
   nearly as often are dropped, and each language's best are kept.

Defined cases: a null text has no pieces; a null lang is ``und``; rows count
whatever their doc_id; other columns are ignored; equal scores are settled by a,
then by the phrase's bytes; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from gaugeline.llm.bitmaps import merged, segments
from gaugeline.llm.common import Scratch

UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BREAKS = b".,;:!?\n\x0b\x0c\r"
FOLD = bytes.maketrans(UPPER + BREAKS, UPPER.lower() + b"\n" * len(BREAKS))
TOKENS = 1 << 20          # words of a task that are handled at once
WORDS = 1 << 20           # words of a task that are numbered before it starts anew
_MULT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


class Numbers(dict):
    """The number of each word, from 1 in order of first use."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 1
        return n


class Stream:
    """Word numbers of a task's texts by language; 0 stands between pieces."""

    def __init__(self):
        self.numbers = Numbers()
        self.hashes = np.zeros(1, np.uint64)

    def add(self, into: list[int], data: bytes) -> None:
        number = self.numbers.__getitem__
        for piece in data.translate(FOLD).split(b"\n"):
            found = piece.split()
            if found:
                into.extend(map(number, found))
                into.append(0)

    def parts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, bool]]:
        """(lang, numbers, last): ``last`` is set before words are numbered anew."""
        pending: dict[str, list[int]] = {}
        size = 0

        def flush(last: bool):
            for i, (lang, ids) in enumerate(pending.items()):
                yield lang, np.array(ids, np.int64), last and i == len(pending) - 1
            pending.clear()

        for b in batches:
            for lang, data in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                ids = pending.setdefault(lang, [])
                size -= len(ids)
                self.add(ids, data or b"")
                size += len(ids)
                if size > TOKENS:
                    full = len(self.numbers) > WORDS
                    yield from flush(full)
                    size = 0
                    if full:
                        self.__init__()
        yield from flush(True)

    def pairs(self, lang: str, ids: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
        """Whether a word and the next are one piece's, and the pair's slot in the sketch."""
        if len(self.hashes) <= len(self.numbers):
            new = list(self.numbers)[len(self.hashes) - 1:]
            self.hashes = np.concatenate([self.hashes, np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new))])
        h = self.hashes[ids]
        mixed = (h[:-1] * _MULT[0]) ^ (h[1:] * _MULT[1] + np.uint64(xxhash.xxh3_64_intdigest(lang)))
        mixed = (mixed ^ (mixed >> np.uint64(31))) * _MULT[2]
        return (ids[:-1] > 0) & (ids[1:] > 0), ((mixed >> np.uint64(20)) % np.uint64(slots)).astype(np.int64)


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))


def count_words(docs: DataFrame, sketch_bytes: int) -> DataFrame:
    """Rows (lang, word, n) of words, and rows (segment, data) of the pair sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, sketch, totals = Stream(), np.zeros(sketch_bytes, np.uint8), {}
        numbers = stream.numbers
        for lang, ids, last in stream.parts(batches):
            numbers = stream.numbers
            n = np.bincount(ids, minlength=len(numbers) + 1)
            if lang in totals:
                n[:len(totals[lang])] += totals[lang]
            totals[lang] = n
            joined, slot = stream.pairs(lang, ids, sketch_bytes)
            at, more = np.unique(slot[joined], return_counts=True)
            sketch[at] = np.minimum(sketch[at] + more, 255)
            if last:
                names = [None, *numbers]
                for key, total in totals.items():
                    used = np.flatnonzero(total[1:]) + 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key] * len(used), pa.string()), pa.array([names[i] for i in used], pa.binary()), pa.array(total[used]),
                         pa.nulls(len(used), pa.int32()), pa.nulls(len(used), pa.binary())], ["lang", "word", "n", "segment", "data"])
                totals = {}
        for b in segments(sketch):
            none = [pa.nulls(b.num_rows, t) for t in (pa.string(), pa.binary(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*none, b.column(0), b.column(1)], ["lang", "word", "n", "segment", "data"])

    return _input(docs).mapInArrow(run, "lang string, word binary, n long, segment int, data binary")


def add_counts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum(a.astype(np.uint16) + b, 255).astype(np.uint8)


def count_edges(docs: DataFrame, sketch: np.ndarray, min_count: int) -> DataFrame:
    """(lang, gram, size, n): edges (size 4) and the grams at piece ends (size 3 and 2)."""
    known = docs.sparkSession.sparkContext.broadcast(sketch)
    least = min(min_count, 255)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, counts = Stream(), known.value
        for lang, ids, _ in stream.parts(batches):
            joined, slot = stream.pairs(lang, ids, len(counts))
            joined &= counts[slot] >= least
            on = np.concatenate([joined, np.zeros(3, bool)])
            n = len(joined)
            one, two, three = on[:n], on[:n] & on[1:n + 1], on[:n] & on[1:n + 1] & on[2:n + 2]
            names = [b"", *stream.numbers]
            for size, starts in ((4, three), (3, two & ~three), (2, one & ~two)):
                at = np.flatnonzero(starts)
                if not len(at):
                    continue
                cols = [ids[at + i] for i in range(size)]
                order = np.lexsort(cols)
                cols = [c[order] for c in cols]
                first = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in cols], axis=0)]))
                grams = [b" ".join([names[i] for i in row]) for row in zip(*(c[first].tolist() for c in cols))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.binary()), pa.array([size] * len(grams), pa.int32()),
                     pa.array(np.diff(np.append(first, len(at))))], ["lang", "gram", "size", "n"])

    rows = _input(docs).mapInArrow(run, "lang string, gram binary, size int, n long")
    return rows.groupBy("lang", F.col("gram").cast("string").alias("gram"), "size").agg(F.sum("n").alias("n"))


def _first(gram: str, k: int) -> Column:
    return F.substring_index(gram, " ", k)


def flow_counts(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Counts of the nodes (three words) and of pairs, from flow and piece ends."""
    nodes = (edges.where("size >= 3").groupBy("lang", _first("gram", 3).alias("gram")).agg(F.sum("n").alias("n")))
    nodes = scratch.write(nodes, "nodes")
    ends = edges.where("size = 2").select("lang", "gram", "n")
    pairs = (nodes.select("lang", _first("gram", 2).alias("gram"), "n").union(ends)
             .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    return nodes, pairs


def unary_paths(edges: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(lang, path, n): maximal chains of edges in which all flow of an edge
    goes into the next.  ``edges`` and ``nodes`` are (lang, gram, n) with all of
    the edges of a weight that any of them has through its nodes."""
    def through(end: int) -> DataFrame:
        node = nodes.select("lang", F.col("gram").alias("node"), F.col("n").alias("flow"))
        return edges.withColumn("node", _first("gram", end)).join(node, ["lang", "node"]).where("n = flow")

    into = through(-3).select("lang", "node", F.col("gram").alias("before"))
    links = into.join(through(3).select("lang", "node", "gram"), ["lang", "node"]).select("lang", "gram", "before")
    cur = edges.join(links, ["lang", "gram"], "left").select(
        "lang", "gram", "n", F.coalesce("before", "gram").alias("head"), F.col("before").isNotNull().cast("int").alias("steps"))
    # Pieces end, so no chain is a ring, and doubling ends after log2 of the
    # longest chain's length.
    # Each round's table replaces the one before.
    for n in count():
        cur = scratch.write(cur, f"paths-{n}")
        scratch.drop(f"paths-{n - 1}")
        up = cur.where("steps > 0").select("lang", F.col("gram").alias("head"), F.col("head").alias("higher"), F.col("steps").alias("more"))
        if cur.where("steps > 0").join(up, ["lang", "head"], "left_semi").isEmpty():
            break
        cur = cur.join(up, ["lang", "head"], "left").select(
            "lang", "gram", "n", F.coalesce("higher", "head").alias("head"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))
    tail = F.transform(F.array_sort(F.collect_list(F.when(F.col("steps") > 0, F.struct("steps", _first("gram", -1).alias("w"))))), lambda x: x["w"])
    return cur.groupBy("lang", "head").agg(F.max("n").alias("n"), tail.alias("tail")).select(
        "lang", F.concat_ws(" ", F.col("head"), F.concat_ws(" ", "tail")).alias("path"), "n").withColumn("path", F.rtrim("path"))


def windows(paths: DataFrame, size: int = 4) -> DataFrame:
    """(lang, gram, n): all grams of ``size`` words of the paths."""
    w = F.split("path", " ", -1)
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - (size - 1)), lambda i: F.array_join(F.slice("w", i, size), " "))
    return paths.select("lang", w.alias("w"), "n").select("lang", F.explode(grams).alias("gram"), "n")


def phrase_graph(docs: DataFrame, min_count: int = 30, sketch_bytes: int = 1 << 24) -> dict[str, DataFrame]:
    """``words`` (lang, word, n), ``phrases`` (lang, phrase, size, a) of two to
    four words with a >= min_count, and ``paths`` (lang, path, n)."""
    docs = docs.select("text", "lang")
    scratch = Scratch(docs.sparkSession, "collocations")
    first = scratch.write(count_words(docs, sketch_bytes), "words")
    sketch = merged(first.where("segment is not null"), sketch_bytes, add_counts)
    words = (first.where("segment is null").groupBy("lang", F.col("word").cast("string").alias("word")).agg(F.sum("n").alias("n")))
    words = scratch.write(words, "vocabulary")
    scratch.drop("words")
    edges = scratch.write(count_edges(docs, sketch, min_count), "edges")
    nodes, pairs = flow_counts(edges, scratch)
    often = F.col("n") >= min_count
    paths = scratch.write(unary_paths(edges.where("size = 4").where(often).select("lang", "gram", "n"), nodes.where(often), scratch),
                          "unitigs")
    sized = [df.where(often).select("lang", F.col("gram").alias("phrase"), F.lit(k).alias("size"), F.col("n").alias("a"))
             for k, df in ((2, pairs), (3, nodes), (4, windows(paths)))]
    phrases = scratch.write(sized[0].union(sized[1]).union(sized[2]), "phrases")
    scratch.drop("edges", "nodes")
    return {"words": words, "paths": paths, "phrases": phrases}


def weakest_cuts(phrases: DataFrame, words: DataFrame, min_count: int) -> DataFrame:
    """lang, phrase, size, a, l, r and score of every phrase at its lowest-scoring cut."""
    w = F.split("phrase", " ", -1)
    part = F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")
    cuts = phrases.select("lang", "phrase", "size", "a", w.alias("w"), part).select(
        "lang", "phrase", "size", "a", "k", F.array_join(F.expr("slice(w, 1, k)"), " ").alias("left"),
        F.array_join(F.expr("slice(w, k + 1, size - k)"), " ").alias("right"))
    # A part of a phrase occurs at least as often, so rarer words and phrases
    # are not needed.
    f = words.where(F.col("n") >= min_count).select("lang", F.col("word").alias("part"), F.col("n").alias("f")).union(
        phrases.select("lang", "phrase", "a"))
    both = (cuts.join(f.select("lang", F.col("part").alias("left"), F.col("f").alias("l")), ["lang", "left"])
            .join(f.select("lang", F.col("part").alias("right"), F.col("f").alias("r")), ["lang", "right"]))
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r"))
    return both.groupBy("lang", "phrase", "size", "a").agg(best.alias("b")).select(
        "lang", "phrase", "size", "a", "b.l", "b.r", "b.score")


def mine_collocations(docs: DataFrame, min_count: int = 30, inside_percent: int = 80, top: int = 2000,
                      sketch_bytes: int = 1 << 24) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases."""
    graph = phrase_graph(docs, min_count, sketch_bytes)
    phrases, words = graph["phrases"], graph["words"]
    # A phrase inside a longer one is also inside one a word longer that
    # occurs as often, so neighbours in size are enough.
    inside = phrases.where("size > 2").select(
        "lang", F.explode(F.array(F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring_index(phrase, ' ', 1 - size)"))).alias("phrase"),
        F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = (weakest_cuts(phrases, words, min_count).join(inside, ["lang", "phrase"], "left")
            .where(F.col("longer").isNull() | (F.col("longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * inside_percent)))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    spread = F.pmod(F.xxhash64("phrase"), F.lit(64))
    near = kept.withColumn("s", spread).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "s").orderBy(*order))).where(F.col("rank") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
