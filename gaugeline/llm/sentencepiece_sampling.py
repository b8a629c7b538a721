"""SentencePiece encoding and decoding with Gumbel top-k sampling.

The lattice of a whole text has one arc per vocabulary piece.  An arc's
probability comes from the rank r of the piece, proportional to
``1 / (r + offset)``; a character without a piece is one byte-fallback arc.
No piece crosses the start of a word, so the lattice is a chain of word
lattices with their own backward sums.

The k segmentations with the largest Gumbel-perturbed log-probabilities are a
sample without replacement.  They are found by perturbed A* search: a queue
holds parts of the lattice (a fixed prefix of words, and one word whose tried
segmentations are excluded) under the exact maximum of their perturbed
log-probabilities.  The first part popped yields the next segmentation, by
drawing top down under that maximum (all words of the text walk their lattices
at once, over tables of each place's cumulative arc shares), and is split at every
word into the parts that leave the segmentation there; their maxima are truncated Gumbels.  The
maximum left after k pops is the threshold kappa of the inclusion scores,
``log(1 - exp(-exp(logp - kappa)))``.  A text with fewer than k segmentations
gives all of them, with log inclusion 0.

Draws are seeded by the row key.  Decoding joins the pieces and their bytes; it
restores the text exactly, since a literal U+2581 is spelled in bytes.

Defined cases: null and empty texts give one sample without pieces; equal keys
and texts give equal samples; doc_ids that are text stay text; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

MARK = "\u2581"
# Stands for a literal U+2581 inside the lattice; a lone surrogate is in no text.
LITERAL = "\udfff"
_CHUNK = re.compile("\n|\u2581*[^\u2581\n]+|\u2581+")
# Characters of words held in the tables of a Python worker (about 100 bytes each).
CACHE_CHARS = 1_000_000
GROUP_CHARS = 200_000


class Column:
    """A numpy array that grows at its end."""

    def __init__(self, dtype):
        self.data = np.empty(0, dtype)
        self.n = 0

    def extend(self, values) -> None:
        end = self.n + len(values)
        if end > len(self.data):
            more = np.empty(2 * end, self.data.dtype)
            more[:self.n] = self.data[:self.n]
            self.data = more
        self.data[self.n:end] = values
        self.n = end


class Lattice:
    """Word lattices of one vocabulary, with bounded tables of the words met.

    In the tables a node is a place in a word, or a place between the bytes of
    a character; its arcs are numbered ``first`` and on, each with one piece."""

    def __init__(self, model_file: str, offset: float = 10.0):
        import sentencepiece
        m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = m.get_piece_size()
        self.text = [m.id_to_piece(i) for i in range(n)]
        self.byte = {}
        plain = {}
        for i, p in enumerate(self.text):
            if m.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
            elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
                plain[p] = i
        total = math.log(sum(1.0 / (r + offset) for r in range(len(plain) + 256)))
        self.score = {p: -math.log(r + offset) - total for r, p in enumerate(plain)}
        self.ids = plain
        self.byte_score = -math.log(len(plain) + 256 + offset) - total
        self.longest = max(map(len, plain), default=1)
        self.raw = [t.replace(MARK, " ").encode() for t in self.text]
        for x, i in self.byte.items():
            self.raw[i] = bytes([x])
        self.latest: tuple = ("", ([0.0], []))
        self._trie()
        self.forget()

    def _trie(self) -> None:
        """The pieces as a trie: sorted keys (state, character) and the states they lead to."""
        self.code = np.zeros(0x110000, np.int64)
        letters = sorted({c for x in self.ids for c in x})
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.width = len(letters) + 1
        code = {c: i for i, c in enumerate(letters, 1)}
        step: dict[int, int] = {}
        ends = {}
        for x, i in self.ids.items():
            state = 0
            for c in x:
                state = step.setdefault(state * self.width + code[c], len(step) + 1)
            ends[state] = i
        self.keys = np.fromiter(step, np.int64, len(step))
        self.next = np.fromiter(step.values(), np.int64, len(step))
        order = np.argsort(self.keys)
        self.keys, self.next = self.keys[order], self.next[order]
        self.ending = np.full(len(step) + 1, -1, np.int64)
        self.ending[list(ends)] = list(ends.values())
        self.scores = np.zeros(len(self.text))
        self.scores[list(self.ids.values())] = list(self.score.values())

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.held = 0
        self.start, self.first, self.to, self.piece = (Column(np.int64) for _ in range(4))
        self.mass, self.logp, self.own, self.share, self.other = (Column(np.float64) for _ in range(5))

    def word(self, w: str) -> tuple:
        """(log mass from each place, arcs of each place: (end, ids, logp))."""
        if self.latest[0] != w:
            n, score, ids, longest = len(w), self.score, self.ids, self.longest
            beta = [0.0] * (n + 1)
            arcs: list = [()] * n
            for i in range(n - 1, -1, -1):
                own = []
                for j in range(i + 1, min(n, i + longest) + 1):
                    x = w[i:j]
                    if x in score:
                        own.append((j, (ids[x],), score[x]))
                if not own or own[0][0] > i + 1:
                    x = (MARK if w[i] == LITERAL else w[i]).encode()
                    own.append((i + 1, tuple(self.byte[y] for y in x), self.byte_score * len(x)))
                if len(own) == 1:
                    beta[i] = own[0][2] + beta[own[0][0]]
                else:
                    parts = [s + beta[j] for j, _, s in own]
                    top = max(parts)
                    beta[i] = top + math.log(sum([math.exp(x - top) for x in parts]))
                arcs[i] = own
            self.latest = (w, (beta, arcs))
        return self.latest[1]

    def numbers(self, words: list[str]) -> np.ndarray:
        """Numbers of the words in the tables; good until the next ``hold``."""
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def hold(self, words: list[str]) -> None:
        """Tables for these words; others are forgotten where the tables are full."""
        new = [w for w in dict.fromkeys(words) if w not in self.number]
        if self.held and self.held + sum(map(len, new)) > CACHE_CHARS:
            self.forget()
            new = list(dict.fromkeys(words))
        if new:
            self._tabulate(new)

    def _arcs(self, chars: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, ...]:
        """(start, end, piece, logp) of every piece in the words, which end at
        ``stop``, by one walk down the trie from all places at once."""
        code = self.code[chars]
        at = place = np.arange(len(chars))
        state = np.zeros(len(chars), np.int64)
        found = []
        while len(at):
            key = state * self.width + code[place]
            hit = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[hit] == key
            at, place, state = at[ok], place[ok] + 1, self.next[hit[ok]]
            piece = self.ending[state]
            full = piece >= 0
            found.append((at[full], place[full], piece[full]))
            go = place < stop[at]
            at, place, state = at[go], place[go], state[go]
        start, end, piece = (np.concatenate(x) for x in zip(*found))
        return start, end, piece, self.scores[piece]

    def _tabulate(self, words: list[str]) -> None:
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        length = np.fromiter(map(len, words), np.int64, len(words))
        n, node0, arc0 = len(chars), self.first.n, self.to.n
        until = np.cumsum(length)
        stop = np.repeat(until, length)
        start, end, piece, logp = self._arcs(chars, stop)
        # A character without a piece of its own is an arc of its bytes.
        lone = np.ones(n, bool)
        lone[start[end == start + 1]] = False
        lone = np.flatnonzero(lone)
        spelled = [[self.byte[x] for x in (MARK if chr(c) == LITERAL else chr(c)).encode()] for c in chars[lone].tolist()]
        start, end = np.concatenate([start, lone]), np.concatenate([end, lone + 1])
        piece = np.concatenate([piece, np.fromiter((x[0] for x in spelled), np.int64, len(lone))])
        logp = np.concatenate([logp, self.byte_score * np.fromiter(map(len, spelled), np.int64, len(lone))])
        # Arcs by the distance of their start from the word's end, long ones
        # (the likely ones) first within a place.
        left = stop - np.arange(n)
        order = np.lexsort((-end, start, left[start]))
        start, end, piece, logp = start[order], end[order], piece[order], logp[order]
        goal = np.where(end == stop[start], n, end)
        head = np.flatnonzero(np.concatenate([[True], start[1:] != start[:-1]]))
        first = np.empty(n, np.int64)
        first[start[head]] = head
        rank = np.arange(len(start)) - first[start]
        beta = np.zeros(n + 1)
        # Places at one distance from the end need only nearer ones.
        level = np.searchsorted(left[start[head]], np.arange(1, int(length.max()) + 2))
        heads = np.append(head, len(start))
        for a, b in zip(level[:-1].tolist(), level[1:].tolist()):
            lo, hi, own = heads[a], heads[b], head[a:b]
            if lo < hi:
                part = logp[lo:hi] + beta[goal[lo:hi]]
                top = np.maximum.reduceat(part, own - lo)
                some = np.exp(part - np.repeat(top, np.diff(heads[a:b + 1])))
                beta[start[own]] = top + np.log(np.add.reduceat(some, own - lo))
        own = np.exp(logp + beta[goal] - beta[start])
        before, after = np.zeros(len(own)), np.zeros(len(own))
        steps = [np.flatnonzero(rank == r) for r in range(1, int(rank.max()) + 1)]
        for at in steps:
            before[at] = before[at - 1] + own[at - 1]
        for at in reversed(steps):
            after[at - 1] = after[at] + own[at]
        share = before + own
        share[heads[1:] - 1] = 2.0  # the last arc of a place takes what rounding leaves
        to = np.where(goal == n, -1, node0 + goal)
        inner_to, inner_piece = [], []
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        for x, at in zip(spelled, place[len(order) - len(lone):].tolist()):
            if len(x) > 1:
                here = node0 + n + len(inner_to)
                inner_to += [here + t for t in range(1, len(x) - 1)] + [int(to[at])]
                inner_piece += x[1:]
                to[at] = here
        m = len(inner_to)
        certain = np.zeros(m)
        begin = until - length
        self.number.update(zip(words, range(self.start.n, self.start.n + len(words))))
        self.held += n
        for column, values in ((self.start, node0 + begin), (self.mass, beta[begin]),
                               (self.first, np.concatenate([arc0 + first, arc0 + len(own) + np.arange(m)])),
                               (self.to, np.concatenate([to, np.array(inner_to, np.int64)])),
                               (self.piece, np.concatenate([piece, np.array(inner_piece, np.int64)])),
                               (self.logp, np.concatenate([logp, certain])), (self.own, np.concatenate([own, certain + 1])),
                               (self.share, np.concatenate([share, certain + 2])),
                               (self.other, np.concatenate([before + after, certain]))):
            column.extend(values)

    def walk(self, numbers: np.ndarray, rng) -> tuple[np.ndarray, ...]:
        """Free draws for all words: (pieces of each word, all pieces in order,
        log-probability within each word, log mass of its other segmentations)."""
        first, to, share, own, other = (x.data for x in (self.first, self.to, self.share, self.own, self.other))
        n = len(numbers)
        node, on = self.start.data[numbers], np.arange(n)
        reach, rest = np.ones(n), np.zeros(n)
        whose, taken = [on[:0]], [on[:0]]
        while len(on):
            arc = first[node]
            u = rng.random(len(on))
            more = np.flatnonzero(share[arc] <= u)
            while len(more):
                arc[more] += 1
                more = more[share[arc[more]] <= u[more]]
            whose.append(on)
            taken.append(arc)
            # The others leave the path at one of its places: positive sums only.
            rest[on] += reach[on] * other[arc]
            reach[on] *= own[arc]
            node = to[arc]
            go = node >= 0
            on, node = on[go], node[go]
        who, arcs = np.concatenate(whose), np.concatenate(taken)
        order = np.argsort(who, kind="stable")
        logs = np.bincount(who, self.logp.data[arcs], n) - self.mass.data[numbers]
        with np.errstate(divide="ignore"):
            rest = np.log(np.minimum(rest, 1.0))
        return np.bincount(who, minlength=n), self.piece.data[arcs[order]], np.minimum(logs, 0.0), rest

    def left(self, w: str, tried: frozenset) -> float:
        """Log mass of the segmentations not in ``tried``."""
        return self.excluded(w, tried)[1][0] if tried else self.word(w)[0][0]

    def excluded(self, w: str, tried: frozenset) -> tuple[list[dict], list[float]]:
        """A trie of the tried segmentations: per node the child of each arc's
        end, and the log mass, from its place on, of the segmentations not in
        ``tried``.  Sums only, so that a tiny remainder is exact."""
        beta, arcs = self.word(w)
        kids, place = [{}], [0]
        for t in tried:
            node = i = at = 0
            while i < len(w):
                i, ids, _ = next(a for a in arcs[i] if t[at:at + len(a[1])] == a[1])
                at += len(ids)
                nxt = kids[node].get(i)
                if nxt is None:
                    nxt = kids[node][i] = len(kids)
                    kids.append({})
                    place.append(i)
                node = nxt
        mass = [-math.inf] * len(kids)
        # Children come after their parents.
        for node in range(len(kids) - 1, -1, -1):
            if place[node] < len(w):
                own = kids[node]
                parts = [s + (mass[own[j]] if j in own else beta[j]) for j, _, s in arcs[place[node]]]
                top = max(parts)
                if top > -math.inf:
                    mass[node] = top + math.log(sum(math.exp(x - top) for x in parts))
        return kids, mass

    def draw(self, w: str, rng, tried: frozenset = frozenset()) -> tuple[tuple, float]:
        """(ids, log-probability within the word) of one segmentation, drawn in
        proportion to its mass among those not in ``tried``."""
        beta, arcs = self.word(w)
        kids, left = self.excluded(w, tried) if tried else ([], [])
        node = 0 if tried else None
        i, ids, logp = 0, [], -beta[0]
        while i < len(w):
            own = arcs[i]
            pick = own[0]
            gone = kids[node] if node is not None else {}
            if len(own) > 1:
                mass = [s + (left[gone[j]] if j in gone else beta[j]) for j, x, s in own]
                top = max(mass)
                mass = [math.exp(x - top) for x in mass]
                u = rng.random() * sum(mass)
                for arc, x in zip(own, mass):
                    if x > 0:
                        pick = arc
                        u -= x
                        if u < 0:
                            break
            i, logp = pick[0], logp + pick[2]
            ids += pick[1]
            node = gone.get(i)
        return tuple(ids), logp


def _truncated(loc: np.ndarray, top: float, rng) -> np.ndarray:
    """Gumbels with locations ``loc``, each conditioned to be at most ``top``."""
    with np.errstate(divide="ignore", over="ignore"):
        e = -np.log(rng.random(len(loc)))
        return loc - np.logaddexp(loc - top, np.log(e))


def chunks(text: str) -> list[str]:
    if not text:
        return []
    return _CHUNK.findall(MARK + text.replace(MARK, LITERAL).replace(" ", MARK))


def search(lat: Lattice, words: list[str], key: str, k: int) -> tuple[list[tuple], float]:
    """([(pieces of each word, all pieces, logp, gumbel)] in order, kappa) of a
    text in words that the tables hold."""
    rng = np.random.default_rng(int.from_bytes(hashlib.blake2b(key.encode(), digest_size=8).digest(), "big"))
    n = len(words)
    numbers = lat.numbers(words)
    none = np.zeros(0, np.int64)
    tie = 0
    # part: (-max, tie, first free word, prefix segmentation, excluded there)
    heap: list = [(-float(rng.gumbel()), 0, 0, (none, none, np.zeros(0)), frozenset())]
    out: list = []
    while heap and len(out) < k:
        top, _, at, (counts, ids, logs), without = heapq.heappop(heap)
        top = -top
        free = lat.walk(numbers[at + bool(without):], rng)
        fixed = [(counts[:at], ids[:counts[:at].sum()], logs[:at])]
        rest = free[3]
        if without:
            # This word leaves its tried segmentations, the words after it are free.
            own, lp = lat.draw(words[at], random.Random(int(rng.integers(1 << 62))), without)
            fixed.append(([len(own)], np.array(own, np.int64), [min(lp, 0.0)]))
            rest = np.append(lat.left(words[at], without | {own}) - lat.word(words[at])[0][0], rest)
        counts, ids, logs = (np.concatenate(x) for x in zip(*fixed, free[:3]))
        before = np.append(0.0, np.cumsum(logs))
        out.append((counts, ids, float(before[-1]), top))
        if n == 0:
            break
        edge = np.append(0, np.cumsum(counts))
        # Mass of the other segmentations at each word from ``at`` on.
        g = _truncated(before[at:n] + rest, top, rng)
        # Only the k best of these parts can ever be popped.
        for j in np.argsort(-g, kind="stable")[:k - len(out) + 1].tolist():
            if np.isfinite(g[j]):
                tie += 1
                tried = frozenset([tuple(ids[edge[at + j]:edge[at + j + 1]].tolist())])
                heapq.heappush(heap, (-float(g[j]), tie, at + j, (counts, ids, logs), tried if j else tried | without))
    return out, (-heap[0][0] if heap else -math.inf)


def sample(lat: Lattice, text: str, key: str, k: int) -> tuple[list[tuple], float]:
    """([(pieces by word, logp, gumbel)] in order, kappa) of ``text``."""
    words = chunks(text)
    lat.hold(words)
    found, kappa = search(lat, words, key, k)
    by_word = lambda counts, ids: [tuple(x.tolist()) for x in np.split(ids, np.cumsum(counts)[:-1])] if len(counts) else []
    return [(by_word(counts, ids), lp, g) for counts, ids, lp, g in found], kappa


def _logp(lat: Lattice, w: str, ids: tuple) -> float:
    """Log-probability of the segmentation ``ids`` within the word."""
    beta, arcs = lat.word(w)
    i, at, lp = 0, 0, -beta[0]
    while i < len(w):
        end, own, s = next(a for a in arcs[i] if ids[at:at + len(a[1])] == a[1])
        i, at, lp = end, at + len(own), lp + s
    return lp


def decode(lat: Lattice, ids) -> str:
    return b"".join([lat.raw[i] for i in ids]).decode()[1:]


_LATTICES: dict[str, Lattice] = {}


def _lattice(model_file: str | None) -> Lattice:
    if model_file is None:
        import public_tokenizers
        model_file = public_tokenizers.path("piece_bpe_32k.model")
    if model_file not in _LATTICES:
        _LATTICES[model_file] = Lattice(model_file)
    return _LATTICES[model_file]


def _groups(b: pa.RecordBatch) -> Iterator[list[tuple]]:
    """(key, text, words) of a few rows at a time, so that words met for the
    first time get their tables together; a long text is a group of its own."""
    own, size = [], 0
    for i in range(b.num_rows):
        text = b.column("text")[i].as_py() or ""
        if own and (len(own) == 64 or size + len(text) > GROUP_CHARS):
            yield own
            own, size = [], 0
        own.append((b.column("doc_id")[i].as_py(), text, chunks(text)))
        size += len(text)
    if own:
        yield own


def encode_samples(docs: DataFrame, k: int = 2, model_file: str | None = None) -> DataFrame:
    """One row per document and sample: doc_id, sample, ids, n_pieces, logp,
    gumbel, log_inclusion and ``decoded_ok`` (the exact round trip)."""
    names = ["doc_id", "sample", "ids", "n_pieces", "logp", "gumbel", "log_inclusion", "decoded_ok"]
    key_type = "string" if isinstance(docs.schema["doc_id"].dataType, StringType) else "long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = _lattice(model_file)
        raw = np.array(lat.raw, object)
        for b in batches:
            for own in _groups(b):
                rows, pieces = [], []
                lat.hold([w for _, _, words in own for w in words])
                for key, text, words in own:
                    found, kappa = search(lat, words, str(key), k)
                    # A word's mark is a space, and so is the one before the text.
                    whole = (" " + text).encode() if text else b""
                    for r, (_, ids, lp, g) in enumerate(found):
                        gap = lp - kappa
                        inc = 0.0 if gap > 30 else (gap if gap < -30 else math.log(-math.expm1(-math.exp(gap))))
                        pieces.append(ids)
                        rows.append((key, r, len(ids), lp, g, inc, b"".join(raw[ids].tolist()) == whole))
                if rows:
                    c = list(zip(*rows))
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(c[2])]).astype(np.int32)),
                                                     pa.array(np.concatenate(pieces).astype(np.int32)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c[0], b.schema.field("doc_id").type), pa.array(c[1], pa.int32()), lists, pa.array(c[2], pa.int64()),
                         *[pa.array(x, pa.float64()) for x in c[3:6]], pa.array(c[6])], names)

    return docs.select(F.col("doc_id").cast(key_type).alias("doc_id"), "text").mapInArrow(
        run, f"doc_id {key_type}, sample int, ids array<int>, n_pieces long, logp double, gumbel double, "
             "log_inclusion double, decoded_ok boolean")
