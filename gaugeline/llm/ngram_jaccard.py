"""N-gram Jaccard join with PartEnum signatures.

Sets of hashed five-word shingles are joined at Jaccard similarity 0.8.
Equal sets first collapse to a class with its smallest doc_id.  Class
representatives are put in size bands that grow by 1 / threshold, so partners
lie in the same or the next band, and sign once per band pair:

* Jaccard >= t means a Hamming distance of at most (1-t)/(1+t) * (|r|+|s|),
  which is at most ``k(r) = floor((1-t)/t * |r|)`` seen from either set;
* the hashed feature domain is split into ``n1`` first-level partitions, and
  each of them into ``N2`` second-level ones.  With more than k/(K2+1)
  first-level partitions, one of them has at most ``K2`` differing elements;
* every subset of N2-K2 second-level partitions of a first-level one gives one
  signature, so this subset agrees in both sets.

A subset that is empty in a set says nothing, and would be one hot signature.
Empty subsets are left out, and a set is *covered* when, even if every
first-level partition holding an empty subset is discounted, one agreeing
partition must remain.  A set that is not covered signs again under the next
domain partitioning, and under the last one also with its empty subsets.  A pair is
found as soon as one of its sets is covered by a partitioning that both used,
so no link is lost.

Verification: round one compares each representative only with the smallest
representative that it shares a signature with, linear in the input, and only
where sizes and sketches allow a link: ``64 * MARKS`` bits that say of which
cells a set has an odd number of features, so that differing bits are differing
elements.  One that
links within ``BALL`` joins that centre's ball, and others are balls of themselves.  Jaccard
distance is a metric, so members of two balls can only link if the centres are
within 0.2 plus both radii.  Round two therefore compares centres whose
components differ, where the sketches allow it.  All pairs of a signature's centres would grow with
the square of their number, so where a signature has ``HOT`` centres or more, each is first
compared, ``STARS`` times under orders of their own, with the first centre of another component
only; what links becomes one component, and all pairs are taken of the components that are left.
Round three compares members, only
where the centres are near enough, the components still differ, each member's
sketch allows it to be near the other's centre, and their sketches allow a link.
Members are judged against the other centre before their signatures are fetched.
The bounds are exact, so no link is lost, and a large group meets others by its centre.

Signatures are shuffled packed, as those of one task and bucket together: 32 bits of each and the
steps between the representatives' numbers.  Two that differ in other bits only then count as one, which
adds pairs and takes none.  Before sets are fetched for a pair, its wide sketches are compared, with twice
to four times as many cells as the set has features.  Sets are carried to their pairs in
as many passes as keep them within ``CARRIED`` times the sets.

Tables are removed when a later one holds what is needed of them.

Classes have numbers of their own, and a representative's row is found by a
hash of its id and text and confirmed by its set, so ids need not be distinct.

Defined cases: null, empty or word-free texts have an empty set and link with
nothing; texts with fewer than five words are one shingle; rows of one doc_id
are rows of their own, each with the component of its text; rows whose
component has no doc_id but null have a null component_id; ids that are not whole
numbers count as null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from gaugeline.llm.common import DOCUMENT_COLUMNS, Scratch, connected

N2 = 3          # second-level partitions
K2 = 1          # differing second-level partitions that a signature tolerates
SEEDS = 6       # domain partitionings before empty subsets are used
MARKS = 8       # words of 64 cells of the sketch that bounds a distance from below
NEAR = 0.2 + 1e-9
SKETCH = [f"m{i}" for i in range(MARKS)]
BALL = 0.1      # farthest that a linked representative is a member of its centre's ball
HOT = 8         # centres of a signature that are first compared with one another's first only
STARS = 4       # rounds of these comparisons
BUCKET = 400_000     # features whose signatures make up a bucket
PACKED = 1 << 21     # signatures that are packed at once
CARRIED = 2          # times the sets of the pairs that a pass of measuring may carry
LEAST = 1 << 24      # features that any pass may carry
FEW = 1 << 15        # pairs whose representatives are broadcast to the texts
SUBSETS = list(combinations(range(N2), N2 - K2))


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """splitmix64 of the feature hashes."""
    z = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    z ^= z >> np.uint64(30)
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


def shingle_set(text: bytes) -> np.ndarray:
    """The sorted distinct 64-bit shingle hashes of a UTF-8 text."""
    # On bytes, lower() and split() know A-Z and [\x20\x09-\x0D] only.
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, text.lower().split()), np.uint64)
    n = len(w)
    if n == 0:
        return w
    size = min(n, 5)
    h = np.full(n - size + 1, size, np.uint64)
    for j in range(size):
        h = _mix(h ^ w[j:n - size + 1 + j], j)
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name the set."""
    return tuple(np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64).tolist())


def set_marks(s: np.ndarray) -> np.ndarray:
    """The parity of the number of features in each of ``64 * MARKS`` cells."""
    odd = np.bincount((s % np.uint64(64 * MARKS)).astype(np.int64), minlength=64 * MARKS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def set_wide(s: np.ndarray) -> bytes:
    """The same with at least two cells for each feature; empty where ``set_marks`` has as many."""
    if len(s) <= 32 * MARKS:
        return b""
    cells = 1 << (2 * len(s) - 1).bit_length()
    odd = np.bincount((s % np.uint64(cells)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def wide_apart(one: bytes, two: bytes) -> int:
    """No more than the number of differing features: cells modulo the smaller power of two are compared."""
    if not (one and two):
        return 0
    a, b = sorted((np.frombuffer(x, np.uint8) for x in (one, two)), key=len)
    while len(b) > len(a):
        b = b[:len(b) // 2] ^ b[len(b) // 2:]
    return int(np.bitwise_count(a ^ b).sum())


def _bands(size: int, num: int, den: int) -> tuple[int, int, int]:
    """(band, upper size of the band, upper size of the next one).

    Band b holds the sizes from its lower bound l to floor(l * den / num)."""
    low, band = 1, 0
    while low * den // num < size:
        low, band = low * den // num + 1, band + 1
    high = low * den // num
    return band, high, (high + 1) * den // num


def set_signatures(s: np.ndarray, num: int = 4, den: int = 5) -> np.ndarray:
    """Signatures of one set of uint64 features."""
    size = len(s)
    own = size * (den - num) // num          # k(r)
    band, high, next_high = _bands(size, num, den)
    out = []
    for pair, top in ((band, high), (band + 1, next_high)):
        k = top * 2 * (den - num) // (num + den)
        n1 = int(k // (K2 + 1) * 1.15) + 1
        need = min(own, k) // (K2 + 1)
        tag = np.uint64((pair * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        for seed in range(SEEDS):
            h = _mix(s ^ tag, 2 * seed)
            cell = (h % np.uint64(n1 * N2)).astype(np.int64)
            total = np.zeros(n1 * N2, np.uint64)
            np.add.at(total, cell, _mix(h, 2 * seed + 1))
            count = np.bincount(cell, minlength=n1 * N2).reshape(n1, N2)
            total = total.reshape(n1, N2)
            bad = np.zeros(n1, bool)
            part = np.arange(n1, dtype=np.uint64)
            last = seed == SEEDS - 1
            for i, sub in enumerate(SUBSETS):
                filled = count[:, sub].sum(axis=1) > 0
                bad |= ~filled
                sig = part * np.uint64(len(SUBSETS)) + np.uint64(i)
                for c in sub:
                    sig = _mix(sig ^ total[:, c], c)
                sig = _mix(sig ^ tag, seed)
                out.append(sig if last else sig[filled])
            if n1 - need > bad.sum():
                break
    return np.concatenate(out)


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, the text's bytes, and ``rid``, equal only for repeated rows."""
    return docs.select(F.col("doc_id").try_cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("rid"),
                       F.col("text").cast("binary").alias("text"))


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size, key and sketch of every row's set."""
    for b in batches:
        n, keys, marks, wide = [], [], np.zeros((b.num_rows, MARKS), np.int64), []
        for i, t in enumerate(b.column("text")):
            s = shingle_set(t.as_py() or b"")
            n.append(len(s))
            keys.append(set_key(s))
            marks[i] = set_marks(s)
            wide.append(set_wide(s))
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("rid"), pa.array(n, pa.int32()), *[pa.array([k[j] for k in keys], pa.int64()) for j in (0, 1)],
             *[pa.array(marks[:, j]) for j in range(MARKS)], pa.array(wide, pa.binary())], ["doc_id", "rid", "n", "k1", "k2", *SKETCH, "wide"])


def _wanted(b: pa.RecordBatch, done: set[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(rep, set) of the rows that hold their class's set, once in a task."""
    for rep, k1, k2, t in zip(*(b.column(c) for c in ("rep", "k1", "k2", "text"))):
        rep = rep.as_py()
        if rep not in done:
            s = shingle_set(t.as_py() or b"")
            if set_key(s) == (k1.as_py(), k2.as_py()):
                done.add(rep)
                yield rep, s


def _steps(reps: np.ndarray) -> bytes:
    """Ascending numbers as steps of two bytes, low bytes first; then the large steps."""
    step = np.diff(reps, prepend=0)
    code = np.minimum(step, 0xFFFF).astype("<u2")
    return code.view(np.uint8).reshape(-1, 2).T.tobytes() + step[code == 0xFFFF].astype("<i8").tobytes()


def _from_steps(data: bytes, n: int) -> np.ndarray:
    code = np.ascontiguousarray(np.frombuffer(data, np.uint8, 2 * n).reshape(2, n).T).view("<u2").ravel()
    step = code.astype(np.int64)
    step[code == 0xFFFF] = np.frombuffer(data, "<i8", offset=2 * n)
    return np.cumsum(step)


def _packed(reps: list[int], sigs: list[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    """A row for each bucket: the lower halves of the signatures and their representatives."""
    order = np.argsort(reps)
    rep = np.repeat(np.array(reps, np.int64)[order], [len(sigs[i]) for i in order])
    sig = np.concatenate([sigs[i] for i in order])
    bucket = ((sig >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
    by = np.argsort(bucket, kind="stable")
    rep, low, bucket = rep[by], sig[by].astype("<u4"), bucket[by]
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])).tolist()
    parts = list(zip(edge[:-1], edge[1:]))
    yield pa.RecordBatch.from_arrays(
        [pa.array(bucket[edge[:-1]].astype(np.int32)), pa.array([low[a:b].tobytes() for a, b in parts], pa.binary()),
         pa.array([_steps(rep[a:b]) for a, b in parts], pa.binary())], ["bucket", "sigs", "reps"])


def _sign(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    done: set[int] = set()
    reps, sigs, held = [], [], 0
    for b in batches:
        for rep, s in _wanted(b, done):
            reps.append(rep)
            sigs.append(set_signatures(s))
            held += len(sigs[-1])
            if held >= PACKED:
                yield from _packed(reps, sigs, buckets)
                reps, sigs, held = [], [], 0
    if held:
        yield from _packed(reps, sigs, buckets)


def _met(bucket: int, sigs: list[np.ndarray], reps: list[np.ndarray]) -> pa.RecordBatch:
    """The signatures of a bucket that several representatives have, and the smallest of these."""
    sig, rep = np.concatenate(sigs), np.concatenate(reps)
    by = np.argsort(sig, kind="stable")
    sig, rep = sig[by], rep[by]
    first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    low, size = np.minimum.reduceat(rep, first), np.diff(np.append(first, len(sig)))
    kept = np.repeat(low < np.maximum.reduceat(rep, first), size)
    sig = sig[kept].astype(np.int64) | (bucket << 32)
    return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(rep[kept]), pa.array(np.repeat(low, size)[kept])], ["sig", "rep", "low"])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_met`` of each bucket; the rows of one come together."""
    number, sigs, reps = None, [], []
    for b in batches:
        for bucket, sig, rep in zip(b.column("bucket").to_pylist(), b.column("sigs"), b.column("reps")):
            if sigs and bucket != number:
                yield _met(number, sigs, reps)
                sigs, reps = [], []
            number = bucket
            sigs.append(np.frombuffer(sig.as_py(), "<u4"))
            reps.append(_from_steps(rep.as_py(), len(sigs[-1])))
    if sigs:
        yield _met(number, sigs, reps)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    done: set[int] = set()
    for b in batches:
        for at in range(0, b.num_rows, 256):
            found = list(_wanted(b.slice(at, 256), done))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in found], pa.int64()), pa.array([len(s) for _, s in found], pa.int64()),
                                                  pa.array([s.view(np.int64) for _, s in found], pa.list_(pa.int64()))], ["rep", "n", "s"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose wide sketches allow a distance within ``reach``."""
    for b in batches:
        apart = np.array([wide_apart(x.as_py(), y.as_py()) for x, y in zip(b.column("wa"), b.column("wb"))], np.int64)
        n, m, reach = (b.column(c).to_numpy() for c in ("n", "m", "reach"))
        yield b.select(["a", "b", "n"]).filter(pa.array(apart * (2 - reach) <= reach * (n + m) + 1e-6))


def _of_reps(docs: DataFrame, reps: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run`` over the texts of ``reps`` (rep, rid, k1, k2)."""
    rows = _rows(docs).select("rid", "text").join(reps, "rid")
    return rows.select("rep", "k1", "k2", "text").mapInArrow(run, schema)


def _measure(pairs: DataFrame, docs: DataFrame, reps: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``pairs`` (a, b, reach) that can be within their reach, with the Jaccard distance ``d`` and ``linked``."""
    side = lambda a, n, w: reps.select(F.col("rep").alias(a), F.col("n").cast("long").alias(n), F.col("wide").alias(w))
    pairs = pairs.select("a", "b", F.col("reach").cast("double").alias("reach")).join(side("a", "n", "wa"), "a").join(side("b", "m", "wb"), "b")
    pairs = scratch.write(pairs.mapInArrow(_near, "a long, b long, n long"), f"{name}-pairs")
    count, carried = pairs.agg(F.count("*"), F.sum("n")).first()
    asked = reps.select("rep", "rid", "k1", "k2").join(pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct(), "rep", "left_semi")
    # Sets are made from the texts where they are needed; they are larger than the texts.
    sets = _of_reps(docs, F.broadcast(asked) if count <= FEW else asked, _sets, "rep long, n long, s array<long>")
    sets = scratch.write(sets.dropDuplicates(["rep"]), f"{name}-sets")
    own = sets.agg(F.sum("n")).first()[0] or 0
    passes = max(1, math.ceil((carried or 0) / max(LEAST, CARRIED * own)))
    out = []
    for i in range(passes):
        some = pairs.drop("n").where(F.pmod(F.xxhash64("a", "b"), F.lit(passes)) == i) if passes > 1 else pairs.drop("n")
        left = some.join(sets.select(F.col("rep").alias("a"), F.col("s").alias("sa")), "a")
        both = left.join(sets.select(F.col("rep").alias("b"), F.col("s").alias("sb")), "b")
        both = both.select("a", "b", (F.size("sa") + F.size("sb")).alias("total"), F.size(F.array_intersect("sa", "sb")).alias("n"))
        out.append(scratch.write(both.select("a", "b", (1 - F.col("n") / (F.col("total") - F.col("n"))).alias("d"),
                                             (F.col("n") * 100 >= (F.col("total") - F.col("n")) * 80).alias("linked")), f"{name}/{i}"))
    scratch.drop(f"{name}-pairs", f"{name}-sets")
    return reduce(DataFrame.union, out)


def _links(measured: DataFrame) -> DataFrame:
    return measured.where("linked").select("a", "b")


def _reach(l: str, r: str):
    """The farthest that centres with linked members can be from each other."""
    return F.col(f"{l}.r") + F.col(f"{r}.r") + NEAR


def _possible(l: str, r: str, reach):
    """Whether sizes and sketches allow a distance within ``reach``."""
    n, m = F.col(f"{l}.n"), F.col(f"{r}.n")
    apart = sum((F.bit_count(F.col(f"{l}.{c}").bitwiseXOR(F.col(f"{r}.{c}"))) for c in SKETCH[1:]),
                F.bit_count(F.col(f"{l}.{SKETCH[0]}").bitwiseXOR(F.col(f"{r}.{SKETCH[0]}"))))
    return (F.least(n, m) >= (1 - reach) * F.greatest(n, m)) & (apart * (2 - reach) <= reach * (n + m))


def _first_pairs(hits: DataFrame, reps: DataFrame) -> DataFrame:
    """Each representative with the smallest one that it shares a signature
    with, where both sets' sketches allow a link."""
    star = hits.where("low < rep").groupBy(F.col("rep").alias("b")).agg(F.min("low").alias("a"))
    info = reps.select("rep", "n", *SKETCH)
    both = star.join(info.alias("l"), F.col("a") == F.col("l.rep")).join(info.alias("r"), F.col("b") == F.col("r.rep"))
    return both.where(_possible("l", "r", F.lit(NEAR))).select("a", "b", F.lit(NEAR).alias("reach"))


def _centres(open_: DataFrame, balls: DataFrame, reps: DataFrame) -> DataFrame:
    """The open centres with their component and the radius of their ball."""
    spots = open_.groupBy("c").agg(F.min("label").alias("label"))
    return reps.select(F.col("rep").alias("c"), "n", *SKETCH).join(spots, "c").join(balls, "c", "left").select(
        "c", "n", *SKETCH, "label", F.coalesce("radius", F.lit(0.0)).alias("r"))


def _mixed(heads: DataFrame, centres: DataFrame) -> DataFrame:
    """(sig, c, label) of the signatures whose centres are of several components."""
    heads = heads.select("sig", "c").join(centres.select("c", "label"), "c")
    mixed = heads.groupBy("sig").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("sig")
    return heads.join(mixed, "sig").select("sig", "c", "label")


def _star_pairs(heads: DataFrame, centres: DataFrame, turn: int) -> DataFrame:
    """Each centre of ``heads`` with the first centre of another component that it
    shares a signature with, in the order of this turn: linear in ``heads``."""
    group = Window.partitionBy("sig")
    order = F.struct(F.xxhash64("c", F.lit(turn)).alias("o"), "c", "label")
    found = heads.withColumn("one", F.min(order).over(group))
    found = found.withColumn("two", F.min(F.when(F.col("label") != F.col("one.label"), order)).over(group))
    other = F.when(F.col("label") != F.col("one.label"), F.col("one.c")).otherwise(F.col("two.c"))
    pairs = found.select("c", other.alias("o")).where("o is not null").select(F.least("c", "o").alias("a"), F.greatest("c", "o").alias("b"))
    pairs = pairs.distinct().join(centres.alias("l"), F.col("a") == F.col("l.c")).join(centres.alias("r"), F.col("b") == F.col("r.c"))
    return pairs.where(_possible("l", "r", _reach("l", "r"))).select("a", "b", _reach("l", "r").alias("reach"))


def _merged(centres: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``centres`` with the components that ``links`` make of theirs."""
    label = centres.select("c", "label")
    edges = links.join(label.toDF("a", "x"), "a").join(label.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    parts = connected(edges, scratch, f"{name}-parts").select(F.col("node").alias("label"), F.col("label").alias("to"))
    return scratch.write(centres.join(parts, "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to"), f"{name}-centres")


def _compare_centres(open_: DataFrame, centres: DataFrame, docs: DataFrame, reps: DataFrame, scratch: Scratch) -> DataFrame:
    """The measured pairs of open centres: all that can matter for the components."""
    heads = scratch.write(open_.select("sig", "c").distinct(), "heads")
    hot = heads.groupBy("sig").count().where(F.col("count") >= HOT).select("sig")
    hot = scratch.write(heads.join(hot, "sig", "left_semi").join(centres.select("c", "label"), "c"), "hot-0")
    measured: list[DataFrame] = []

    def new(pairs: DataFrame) -> DataFrame:
        for known in measured:
            pairs = pairs.join(known, ["a", "b"], "left_anti")
        return pairs

    for turn in range(STARS):
        if hot.isEmpty():
            break
        found = _measure(new(_star_pairs(hot, centres, turn)), docs, reps, scratch, f"star-{turn}")
        measured.append(found)
        if _links(found).isEmpty():
            break
        centres = _merged(centres, _links(found), scratch, f"star-{turn}")
        hot = scratch.write(_mixed(hot, centres), f"hot-{turn + 1}")
    heads = scratch.write(_mixed(heads, centres).join(centres.drop("label"), "c"), "heads-left")
    scratch.drop("heads", *[f"hot-{i}" for i in range(STARS + 1)])
    pairs = (heads.alias("l").join(heads.alias("r"), (F.col("l.sig") == F.col("r.sig")) & (F.col("l.label") != F.col("r.label"))
                                   & (F.col("l.c") < F.col("r.c")) & _possible("l", "r", _reach("l", "r")))
             .select(F.col("l.c").alias("a"), F.col("r.c").alias("b"), _reach("l", "r").alias("reach")).distinct())
    measured.append(_measure(new(pairs), docs, reps, scratch, "second"))
    scratch.drop("heads-left", *[f"star-{i}-centres" for i in range(STARS)])
    return reduce(DataFrame.union, measured)


def _member_pairs(open_: DataFrame, second: DataFrame, centres: DataFrame, label: DataFrame, reps: DataFrame,
                  scratch: Scratch) -> DataFrame:
    """Pairs of members that can still link, from the measured centres."""
    side = centres.drop("label").join(label.withColumnRenamed("node", "c"), "c", "left").withColumn("label", F.coalesce("label", "c"))
    near = (second.alias("p").join(side.alias("x"), F.col("p.a") == F.col("x.c")).join(side.alias("y"), F.col("p.b") == F.col("y.c"))
            .where((F.col("x.label") != F.col("y.label")) & (F.col("x.r") + F.col("y.r") > 0) & (F.col("p.d") <= _reach("x", "y")))
            .select("p.a", "p.b", "p.d"))
    near = scratch.write(near, "near")
    members = scratch.write(open_.select("rep", "c", "r").distinct().join(reps.select("rep", "n", *SKETCH), "rep"), "members")

    def close(own: str, other: str) -> DataFrame:
        """Members of the centres ``own`` that can link with one of the ball of ``other``."""
        far = near.join(centres.select(F.col("c").alias(other), "n", *SKETCH, "r"), other)
        found = members.alias("m").join(far.alias("o"), (F.col("m.c") == F.col(f"o.{own}")) & (F.col("o.d") <= _reach("m", "o"))
                                        & _possible("m", "o", F.col("o.r") + NEAR))
        return scratch.write(found.select("m.*", "o.a", "o.b", "o.d").drop("c"), f"close-{own}")

    sigs = open_.select("sig", "rep")
    one, two = sigs.join(close("a", "b"), "rep").alias("l"), sigs.join(close("b", "a"), "rep").alias("r")
    same = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in ("sig", "a", "b")]
    both = one.join(two, [*same, F.col("l.d") <= _reach("l", "r"), _possible("l", "r", F.lit(NEAR))])
    return both.select(F.least("l.rep", "r.rep").alias("a"), F.greatest("l.rep", "r.rep").alias("b"), F.lit(NEAR).alias("reach")).distinct()


def _classes(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rid, doc_id, n, k1, k2, rep, label) of every row, and (label, low) of
    every component: its smallest doc_id."""
    profile = f"doc_id long, rid long, n int, k1 long, k2 long, {', '.join(f'{c} long' for c in SKETCH)}, wide binary"
    keys = scratch.write(_rows(docs).mapInArrow(_profile, profile), "profiles")
    reps = keys.where("n > 0").groupBy("k1", "k2").agg(
        F.min("doc_id").alias("low"), F.min("rid").alias("rid"), *[F.first(c).alias(c) for c in ("n", *SKETCH, "wide")])
    # Written once, so that the numbers stay.
    reps = scratch.write(reps.withColumn("rep", F.monotonically_increasing_id()), "reps")
    keys = scratch.write(keys.drop(*SKETCH, "wide"), "keys")
    scratch.drop("profiles")
    signed = reps.where("n >= 4").select("rep", "rid", "k1", "k2", "n")
    buckets = max(1, math.ceil((signed.agg(F.sum("n")).first()[0] or 0) / BUCKET))
    sigs = _of_reps(docs, signed, lambda batches: _sign(batches, buckets), "bucket int, sigs binary, reps binary")
    hits = scratch.write(sigs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_meet, "sig long, rep long, low long"), "hits")

    first = _measure(_first_pairs(hits, reps), docs, reps, scratch, "first")
    label = connected(_links(first), scratch, "parts-1")
    ball = first.where(F.col("linked") & (F.col("d") <= BALL)).select(F.col("b").alias("rep"), F.col("a").alias("c"), F.col("d").alias("r"))
    placed = (reps.select("rep").join(label.withColumnRenamed("node", "rep"), "rep", "left").join(ball, "rep", "left")
              .select("rep", F.coalesce("label", "rep").alias("label"), F.coalesce("c", "rep").alias("c"),
                      F.coalesce("r", F.lit(0.0)).alias("r")))
    open_ = hits.select("sig", "rep").join(placed, "rep")
    mixed = open_.groupBy("sig").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("sig")
    open_ = scratch.write(open_.join(mixed, "sig").select("sig", "rep", "label", "c", "r"), "open")
    scratch.drop("hits")
    centres = scratch.write(_centres(open_, ball.groupBy("c").agg(F.max("r").alias("radius")), reps), "centres")
    second = _compare_centres(open_, centres, docs, reps, scratch)
    links = _links(first).union(_links(second))
    label = connected(links, scratch, "parts-2")
    third = _measure(_member_pairs(open_, second, centres, label, reps, scratch), docs, reps, scratch, "third")
    scratch.drop("open", "centres", "near", "members", "close-a", "close-b")
    label = connected(links.union(_links(third)), scratch, "parts-3")
    placed = scratch.write(reps.select("k1", "k2", "rep", "low").join(label.withColumnRenamed("node", "rep"), "rep", "left")
                           .select("k1", "k2", "rep", "low", F.coalesce("label", "rep").alias("label")), "placed")
    scratch.drop("reps", "first", "second", "third", *[f"star-{i}" for i in range(STARS)])
    rows = keys.select("rid", "doc_id", "n", "k1", "k2").join(placed.select("k1", "k2", "rep", "label"), ["k1", "k2"], "left")
    return rows, placed.groupBy("label").agg(F.min("low").alias("low"))


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    rows, lows = _classes(docs, Scratch(docs.sparkSession, "jaccard"))
    return rows.join(lows, "label", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("low")).alias("component_id"))


def keep_representatives(docs: DataFrame) -> DataFrame:
    """``docs`` with one row for each component: one with the smallest doc_id.
    A text without words is a component of its own."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    rows, _ = _classes(docs, scratch)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("best")
    kept = rows.groupBy(F.col("label"), F.when(F.col("label").isNull(), F.col("rid")).alias("alone")).agg(best).select("best.rid")
    kept = scratch.write(kept, "kept")
    scratch.drop("keys", "placed")
    own = docs.select(*DOCUMENT_COLUMNS).withColumn("rid", F.xxhash64("doc_id", "text"))
    return own.join(kept, "rid", "left_semi").dropDuplicates(["rid"]).select(*DOCUMENT_COLUMNS)
