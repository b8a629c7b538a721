"""License scans by patience alignment.

Text and template are word sequences.  Words unique to both sides anchor the
alignment; the longest increasing subsequence of anchors is kept, and the gaps
between anchors are aligned the same way after their equal ends.  Coverage is
the aligned share of the template's words.

A text that quotes a template twice has no unique words, so the alignment
runs on each region where the template's words gather; long regions are read in
half-overlapping windows of two template lengths.  Every region is scanned.

The registered templates (``license_texts``) are notices, headers, SPDX and
Creative Commons lines and whole texts.  Notices, the lines that only name a
license, must match their telling words and numbers and stay together.  Where matches overlap, the one
with the most aligned words times squared coverage is kept, so that a license
is not reported as its sibling.  A template is only aligned where one of its
rarest words, of which a match cannot miss all, is in the text.

Defined cases: null, empty or word-free texts match nothing; ties go to the
longest alignment, then to the first template by name; repeated rows get equal results; other columns are
ignored; templates without words never match.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from gaugeline.llm.license_texts import NOTICES, TELLING, library

_WORD = re.compile(r"[a-z0-9]+")

# One-line notices (fixed values), registered beside ``library()``.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
}


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of ``pairs`` (ordered by the first) rising in the second."""
    tails, piles, back = [], [], []
    for n, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        back.append(piles[at - 1] if at else -1)
        if at == len(tails):
            tails.append(j)
            piles.append(n)
        else:
            tails[at], piles[at] = j, n
    out, n = [], piles[-1] if piles else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned positions of two word sequences."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, iend, j, jend = todo.pop()
        while i < iend and j < jend and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < iend and j < jend and a[iend - 1] == b[jend - 1]:
            iend, jend = iend - 1, jend - 1
            out.append((iend, jend))
        if i >= iend or j >= jend:
            continue
        ca, cb = Counter(a[i:iend]), Counter(b[j:jend])
        where = {b[y]: y for y in range(j, jend) if cb[b[y]] == 1}
        anchors = _increasing([(x, where[a[x]]) for x in range(i, iend) if ca[a[x]] == 1 and a[x] in where])
        out += anchors
        edges = [(i - 1, j - 1), *anchors, (iend, jend)] if anchors else []
        todo += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(edges, edges[1:])]
    return sorted(out)


class Template:
    """Words of one template, and what a text must hold for it."""

    def __init__(self, name: str, words: list[str], least: float, common: Counter, notice: bool):
        self.name, self.words, self.times = name, words, Counter(words)
        self.notice = notice
        self.telling = frozenset(w for w in self.times if w in TELLING or w.isdigit()) if notice else frozenset()
        self.need = least * len(words)
        # The rarest words, until a text without them lacks too much.
        rare, lacking = [], 0
        for w in sorted(self.times, key=lambda w: (common[w], w)):
            if len(words) - lacking < self.need:
                break
            rare.append(w)
            lacking += self.times[w]
        self.rare = frozenset(rare)

    def enough(self, seen) -> bool:
        """Whether the words in ``seen`` could cover the template."""
        return sum(n for w, n in self.times.items() if w in seen) >= self.need

    def possible(self, seen) -> bool:
        return not self.rare.isdisjoint(seen) and self.telling <= seen and self.enough(seen)


def prepare(texts: list[tuple[str, str]], least: float, told: bool) -> list[Template]:
    """The templates of (license, text); ``told`` knows the registered notices."""
    notices = {tuple(_WORD.findall(t.lower())) for t in (*TEMPLATES.values(), *(t for _, t in NOTICES))} if told else set()
    known = sorted({(name, tuple(_WORD.findall(t.lower()))) for name, t in texts})
    common = Counter(w for _, t in known for w in set(t))
    return [Template(name, list(t), least, common, t in notices) for name, t in known if t]


def scan(text: str | None, templates: list[Template], least: float) -> list[tuple]:
    """(license, coverage, first word, last word, aligned words) of each found region."""
    words = _WORD.findall((text or "").lower())
    seen = set(words)
    near = [t for t in templates if t.possible(seen)]
    if not near:
        return []
    known = frozenset().union(*(t.times for t in near))
    places: dict[str, list[int]] = {}
    for n, w in enumerate(words):
        if w in known:
            places.setdefault(w, []).append(n)
    found = []
    for t in near:
        hits = sorted(n for w in t.times for n in places.get(w, ()))
        regions, start = [], 0
        for n in range(1, len(hits) + 1):
            if n == len(hits) or hits[n] - hits[n - 1] > len(t.words):
                regions.append((hits[start], hits[n - 1] + 1))
                start = n
        size, last = 2 * len(t.words), -1
        for lo, hi in regions:
            for at in range(lo, max(lo + 1, hi - len(t.words)), len(t.words)):
                part = words[at:min(hi, at + size)]
                if not t.enough(set(part)):
                    continue
                pairs = align(t.words, part)
                if len(pairs) < least * len(t.words):
                    continue
                first, end = at + pairs[0][1], at + pairs[-1][1]
                if t.notice and (end - first >= len(t.words) + 3 or not t.telling <= {part[j] for _, j in pairs}):
                    continue
                if first > last:
                    found.append((t.name, len(pairs) / len(t.words), first, end, len(pairs)))
                    last = end
    kept, starts = [], []
    for m in sorted(found, key=lambda m: (-m[4] * m[1] ** 2, m[0], m[2])):
        at = bisect_left(starts, m[2])
        if (at == 0 or kept[at - 1][3] < m[2]) and (at == len(kept) or kept[at][2] > m[3]):
            kept.insert(at, m)
            starts.insert(at, m[2])
    return kept


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """doc_id, license (best coverage, else null), coverage, n_matches and
    the matches themselves."""
    texts = [*TEMPLATES.items(), *library()] if templates is None else list(templates.items())
    known = docs.sparkSession.sparkContext.broadcast(prepare(texts, least, templates is None))
    key = docs.schema["doc_id"].dataType.simpleString()
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_ = [scan(t, known.value, least) for t in b.column("text").to_pylist()]
            best = [min(f, key=lambda m: (-m[1], -m[4], m[0])) if f else (None, 0.0) for f in all_]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([m[0] for m in best], pa.string()), pa.array([m[1] for m in best], pa.float64()),
                 pa.array([len(f) for f in all_], pa.int64()),
                 pa.array([[dict(zip(("license", "coverage", "first_word", "last_word"), m)) for m in f] for f in all_], kind)],
                ["doc_id", "license", "coverage", "n_matches", "matches"])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {key}, license string, coverage double, n_matches long, "
             "matches array<struct<license:string,coverage:double,first_word:long,last_word:long>>")
