"""Mixing sources to target weights with soft memberships.

A multinomial logistic classifier over hashed words is fitted on a bounded
sample of labelled documents (``sample_rows``) and predicts, for every
document, the posterior of each domain: the (quality, toxic) label pairs.  A
labelled document belongs to its own domain alone.
Nonnegative document rates are then fitted by distributed projected gradient:
minimise  1/2 |sum_d w_d r_d P_d - target|^2 + ridge/2 * sum_d w_d (r_d - 1)^2
over the documents' token shares w_d; the ridge only breaks ties.  Every step
moves a document along its own posterior, so the steps add up to one K-vector
and the rates are their projection, ``r_d = max(0, 1 + y . P_d)``.  Steps are
scaled by the K x K curvature of the documents with a positive rate, and halved
until the objective (in y) falls.  An iteration is one aggregate of
K (K + 3) / 2 + 1 sums, and no lineage grows.  It ends when the K residuals are
within ``tolerance`` of the minimum, else raises.  Targets that no rates bring
within ``reach`` would leave a handful of documents; there the rates are fitted
with ``far_ridge`` instead, and a warning gives the residuals.

Defined cases: null texts have no tokens, rate 1 and the prior as posterior;
without labels every domain is equally likely and all rates stay 1; targets
out of reach of the posteriors are met as nearly as the objective allows; empty
tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gaugeline.llm.common import DOCUMENT_COLUMNS, materialize, words

DOMAINS = ((0, 0), (0, 1), (1, 0), (1, 1))     # (quality, toxic)
TARGETS = (0.15, 0.02, 0.80, 0.03)             # share of tokens
BUCKETS = 4096


def _features(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, bucket indexes and their counts."""
    w = docs.select("doc_id", words(F.col("text")).alias("w"))
    h = w.select("doc_id", F.size("w").cast("long").alias("n_tokens"),
                 F.expr(f"transform(w, x -> cast(pmod(xxhash64(x), {BUCKETS}) as int))").alias("h"))
    return h


def _dense(h) -> np.ndarray:
    x = np.bincount(np.asarray(h, np.int64), minlength=BUCKETS).astype(np.float64)
    x = np.sqrt(x)
    return x / max(np.sqrt((x * x).sum()), 1.0)


def _domains(labels: DataFrame) -> DataFrame:
    """One row per doc_id whose two labels are known; values other than 0 and 1
    say nothing."""
    known = [F.max(F.when(F.col(c).isin(0, 1), F.col(c))).alias(c) for c in ("quality", "toxic")]
    return labels.groupBy("doc_id").agg(*known).dropna()


def fit_classifier(feats: DataFrame, labels: DataFrame, sample_rows: int, epochs: int = 60) -> np.ndarray:
    """(BUCKETS + 1) x K weights from at most ``sample_rows`` labelled rows,
    chosen by the hash of the doc_id.  This bound covers the fit only."""
    part = (_domains(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).join(feats, "doc_id")
            .select("quality", "toxic", "h").collect())
    k = len(DOMAINS)
    if not part:
        return np.zeros((BUCKETS + 1, k))
    x = np.stack([np.append(_dense(r.h), 1.0) for r in part])
    y = np.zeros((len(part), k))
    for i, r in enumerate(part):
        y[i, DOMAINS.index((int(r.quality), int(r.toxic)))] = 1.0
    w = np.zeros((BUCKETS + 1, k))
    for _ in range(epochs):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        w -= 4.0 * (x.T @ (p - y) / len(part) + 1e-4 * w)
    return w


def posteriors(feats: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, n_tokens and one posterior column per domain."""
    bc = feats.sparkSession.sparkContext.broadcast(weights)
    names = [f"p{i}" for i in range(len(DOMAINS))]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = bc.value
        for b in batches:
            h = b.column("h")
            out = np.zeros((b.num_rows, len(DOMAINS)))
            for i in range(b.num_rows):
                idx = h[i].values.to_numpy(zero_copy_only=False) if h[i].is_valid else []
                z = _dense(idx) @ w[:-1] + w[-1]
                e = np.exp(z - z.max())
                out[i] = e / e.sum()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_tokens"), *[pa.array(out[:, i]) for i in range(len(DOMAINS))]],
                ["doc_id", "n_tokens", *names])

    key = feats.schema["doc_id"].dataType.simpleString()
    return feats.mapInArrow(predict, f"doc_id {key}, n_tokens long, " + ", ".join(f"{n} double" for n in names))


def fit_steps(p: DataFrame, targets: tuple[float, ...], tolerance: float, iterations: int, ridge: float) -> np.ndarray | None:
    """The summed steps y; None where no document has tokens."""
    k = len(targets)
    n = float(p.agg(F.sum("n_tokens")).first()[0] or 0)
    if n == 0:
        return None
    share = F.col("n_tokens") / n
    goal = np.asarray(targets, np.float64)

    def look(y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        rate = _rate(y)
        on = F.when(rate > 0, share).otherwise(0.0)
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        row = p.agg(F.sum(share * rate * rate), *[F.sum(share * F.col(f"p{i}") * rate) for i in range(k)],
                    *[F.sum(on * F.col(f"p{i}") * F.col(f"p{j}")) for i, j in pairs]).first()
        bend = ridge * np.eye(k)
        for (i, j), v in zip(pairs, row[1 + k:]):
            bend[i, j] += v
            bend[j, i] += v if i != j else 0.0
        return 0.5 * (row[0] + ridge * y @ y) - goal @ y, np.asarray(row[1:1 + k]) + ridge * y - goal, bend

    y = np.zeros(k)
    value, slope, bend = look(y)
    for _ in range(iterations):
        if np.abs(slope).max() <= tolerance:
            return y
        step, size = -np.linalg.solve(bend, slope), 1.0
        while True:
            new = look(y + size * step)
            if new[0] <= value + 1e-4 * size * (slope @ step) or size < 1e-6 or np.abs(new[1]).max() <= tolerance:
                break
            size /= 2
        y, (value, slope, bend) = y + size * step, new
    if np.abs(slope).max() <= tolerance:
        return y
    raise RuntimeError("mixing rates did not converge")


def _rate(y: np.ndarray) -> Column:
    return F.greatest(F.lit(0.0), sum((F.col(f"p{i}") * float(v) for i, v in enumerate(y)), F.lit(1.0)))


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: tuple[float, ...] = TARGETS,
                 sample_rows: int = 4000, iterations: int = 200, ridge: float = 1e-5, tolerance: float = 1e-7,
                 reach: float = 1e-3, far_ridge: float = 0.02) -> DataFrame:
    """doc_id, n_tokens, the posteriors and ``rate`` of every document."""
    feats = _features(docs)
    names = [f"p{i}" for i in range(len(DOMAINS))]
    known = [F.when((F.col("quality") == q) & (F.col("toxic") == t), 1.0).otherwise(0.0) for q, t in DOMAINS]
    soft = posteriors(feats, fit_classifier(feats, labels, sample_rows)).join(_domains(labels), "doc_id", "left")
    p = materialize(soft.select("doc_id", "n_tokens", *[F.when(F.col("quality").isNull(), F.col(n)).otherwise(v).alias(n)
                                                        for n, v in zip(names, known)]), "mixing-posteriors")
    y = fit_steps(p, targets, tolerance, iterations, ridge)
    # At the minimum the K residuals are ridge * y.
    if y is not None and ridge * np.abs(y).max() > reach:
        warnings.warn(f"mixing targets are out of reach by {(ridge * y).round(4).tolist()}")
        y = fit_steps(p, targets, tolerance, iterations, far_ridge)
    rate = F.lit(1.0) if y is None else F.when(F.col("n_tokens") > 0, _rate(y)).otherwise(1.0)
    return p.select("doc_id", "n_tokens", *names, rate.alias("rate"))


def mix(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with each row repeated ``rate`` times: the whole part, and one
    more with the fractional part as probability, drawn from the doc_id."""
    rates = mixing_rates(docs, labels).groupBy("doc_id").agg(F.max("rate").alias("rate"))
    draw = F.pmod(F.xxhash64(F.lit("mix"), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    times = F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    return (docs.select(*DOCUMENT_COLUMNS).join(rates, "doc_id").withColumn("times", times.cast("int"))
            .where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
            .select(*DOCUMENT_COLUMNS))
