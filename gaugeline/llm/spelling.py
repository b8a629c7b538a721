"""Spelling variant grouping with asymmetric q-chunks.

Two words are near if they differ by one inserted, deleted or replaced code
point.  A word cut into two disjoint chunks keeps one of them whole under one
edit; the other word holds that chunk among its positional grams, at a place
shifted by at most one.  So a word of length n contributes two chunks (its first and
its last n div 2 code points), and every word the grams that can face a
chunk: of words of its own length (shift none) and of words one shorter (the first
chunk unshifted, the last one shifted by one).  Both sides meet in one group of
(length of the chunk's word, chunk, text), and pairs are verified by edit distance.

A group of more than ``max_group`` words is not paired: within it the
chunk is known, and the part between the known ends is cut into two chunks in the
same way, so that its words move to narrower groups, down to a part of one code point,
where a group is bounded by the alphabet.  Every near pair stays in one group at each cut.

Defined cases: a null text has no words; a null doc_id counts as an empty
string in the hash; repeated rows each count; equal n are settled by code-point order; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gaugeline.llm.common import materialize

RUN = re.compile("[A-Za-zÀ-ÿ]+")
FLUSH = 300_000      # words of a task's table before it is sent on


def add_words(counts: Counter, doc_id: str, data: bytes, every: int) -> None:
    """Add the runs of one text; those whose hash ``every`` divides lose one code point."""
    start = zlib.crc32(f"{doc_id}:".encode())
    for word, n in Counter(RUN.findall(data.lower().decode())).items():
        h = zlib.crc32(word.encode(), start)
        if every and h % every == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1:]
        counts[word] += n


def vocabulary(docs: DataFrame, min_length: int = 5, min_count: int = 3, every: int = 97) -> DataFrame:
    """(word, n) of the words of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def rows():
            keep = {w: n for w, n in counts.items() if len(w) >= min_length}
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(keep.keys(), pa.string()), pa.array(keep.values(), pa.int64())], ["word", "n"])

        for b in batches:
            for doc_id, data in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                if data:
                    add_words(counts, doc_id, data, every)
                    if len(counts) > FLUSH:
                        yield rows()
        yield rows()

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return (rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= min_count))


def _cut(entries: DataFrame) -> DataFrame:
    """Entries (word, n, length, of, head, tail) with the part between the
    known ends cut once more: ``of`` is the length of the chunk's word, ``head`` and
    ``tail`` the lengths of what is known of it at both ends."""
    half = F.expr("(of - head - tail) div 2")
    return entries.withColumn("ends", F.array(F.struct((F.col("head") + half).alias("head"), F.col("tail").alias("tail")),
                                              F.struct(F.col("head").alias("head"), (F.col("tail") + half).alias("tail")))) \
        .select("word", "length", "of", F.inline("ends"))


def _keyed(entries: DataFrame) -> DataFrame:
    # The gram of a word one longer than ``of`` at its end is the chunk's,
    # shifted by one: counted from the end, both are the last ``tail`` code points.
    text = F.concat_ws("|", F.expr("substring(word, 1, head)"), F.expr("substring(word, length - tail + 1, tail)"))
    return entries.withColumn("key", F.concat_ws(":", "of", "head", text))


def near_pairs(words: DataFrame, max_group: int = 60) -> DataFrame:
    """(a, b) of all near words, each pair once; ``words`` holds each word once."""
    length = F.length("word")
    entries = words.select("word", length.alias("length"), F.explode(F.array(length, length - 1)).alias("of")) \
        .withColumns({"head": F.lit(0), "tail": F.lit(0)}).where("of >= 2")
    found = None
    while True:
        cur = materialize(_keyed(_cut(entries)), "spelling-grams")
        groups = cur.groupBy("key").agg(F.count_if(F.col("length") == F.col("of")).alias("chunks"), F.count("*").alias("grams"),
                                        F.max(F.col("of") - F.col("head") - F.col("tail")).alias("open"))
        groups = materialize(groups.where("chunks > 0 and grams > 1")
                             .withColumn("wide", (F.col("grams") > max_group) & (F.col("open") >= 2)), "spelling-groups")
        small = cur.join(groups.where("not wide").select("key"), "key")
        a = small.where("length = of").select("key", F.col("word").alias("a"), F.col("length").alias("la"))
        b = small.select("key", F.col("word").alias("b"), F.col("length").alias("lb"))
        pairs = (a.join(b, "key").where("lb > la or a < b").where(F.levenshtein("a", "b", 1) == 1)
                 .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        pairs = materialize(pairs, "spelling-pairs")
        found = pairs if found is None else found.union(pairs)
        wide = groups.where("wide").select("key")
        if wide.isEmpty():
            return found.distinct()
        entries = cur.join(wide, "key").drop("key")


def variant_groups(docs: DataFrame, min_length: int = 5, min_count: int = 3, times: int = 2, every: int = 97,
                   max_group: int = 60) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word.

    A word's form is its near word of largest n if that n is at least ``times``
    its own; its root is the last word reached by following forms.
    """
    if times < 2:
        raise ValueError("times must be at least 2, so that forms lead upwards")
    words = materialize(vocabulary(docs, min_length, min_count, every), "spelling-words")
    pairs = materialize(near_pairs(words.select("word"), max_group), "spelling-near")
    both = pairs.union(pairs.select("b", "a")).toDF("word", "near")
    best = (both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").groupBy("word")
            .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("top")))
    formed = (-F.col("top.m") >= F.col("n") * times)
    table = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(formed, F.col("top.w")).alias("form"), F.when(formed, -F.col("top.m")).alias("form_n"))
    table = materialize(table, "spelling-forms")
    # Pointer jumping: n at least doubles along forms, so the longest chain
    # has 63 steps and at most six rounds end them all.
    root = table.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        step = root.select(F.col("word").alias("root"), F.col("root").alias("next"))
        nxt = materialize(root.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                                 F.col("next").isNotNull().alias("moved")), "spelling-roots")
        root = nxt.select("word", "root")
        if nxt.where("moved").isEmpty():
            break
    return table.join(root, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
