"""Language identification: multinomial naive Bayes over hashed character
n-grams of one to three code points.

Counts are summed per partition, then per (lang, bucket) by Spark; the
log-probability matrix (learned languages x BUCKETS) has a fixed width and is
broadcast.  A batch of texts is scored as sparse counts in numpy.

Defined cases: null texts and texts without a letter are ``und`` with score 0;
rows without lang teach nothing; a row without doc_id is not held out; ties go to the first language by name; with
no learned language everything is ``und``; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BUCKETS = 1 << 15
_MULT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def grams(text: str) -> np.ndarray:
    """Bucket of each n-gram of the whole text."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    one = c * _MULT[0]
    two = one[:-1] ^ (c[1:] * _MULT[1])
    three = two[:-1] * _MULT[2] ^ (c[2:] * _MULT[0]) if len(c) > 2 else two[:0]
    h = np.concatenate([one, two * _MULT[2], three * _MULT[1]])
    return ((h ^ (h >> np.uint64(29))) * _MULT[0] >> np.uint64(49)).astype(np.int64)


def learn(docs: DataFrame, alpha: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities (prior in the last column)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                if lang not in total:
                    total[lang] = np.zeros(BUCKETS + 1, np.int64)
                total[lang][:BUCKETS] += np.bincount(grams(text), minlength=BUCKETS)
                total[lang][BUCKETS] += 1
        for lang, t in total.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(t[at])], ["lang", "bucket", "n"])

    counts = (docs.where("lang is not null and text is not null").select("text", "lang")
              .mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    rows = counts.toPandas()
    langs = sorted(rows.lang.unique())
    w = np.zeros((len(langs), BUCKETS + 1))
    w[[langs.index(x) for x in rows.lang], rows.bucket.to_numpy()] = rows.n.to_numpy()
    if langs:
        g = w[:, :BUCKETS] + alpha
        w[:, :BUCKETS] = np.log(g / g.sum(axis=1, keepdims=True))
        w[:, BUCKETS] = np.log(w[:, BUCKETS] / w[:, BUCKETS].sum())
    return langs, w


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    bc = docs.sparkSession.sparkContext.broadcast(model)
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, w = bc.value
        for b in batches:
            pred, score = [], []
            for text in b.column("text").to_pylist():
                if not langs or text is None or not any(map(str.isalpha, text)):
                    pred.append("und")
                    score.append(0.0)
                    continue
                n = np.bincount(grams(text), minlength=BUCKETS)
                at = np.flatnonzero(n)
                z = w[:, at] @ n[at] + w[:, BUCKETS]
                p = np.exp(z - z.max())
                best = int(np.argmax(z))
                pred.append(langs[best])
                score.append(float(p[best] / p.sum()))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, lang_pred string, score double")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score; learned from the other rows."""
    out = predict(docs, learn(docs.where(~held_out())))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
