"""Quality rules with robust multivariate outliers (native).

Base rules count words, symbols, duplicate lines and repeated five-word
windows inside one row with higher-order functions, so no text is shuffled.
The outlier rule transforms the counts into a vector and fits a minimum
covariance determinant (MCD) per (lang, source): concentration steps keep
the ``h`` share of rows nearest by Mahalanobis distance and re-estimate mean
and covariance, all groups at once as grouped aggregates.

Defined cases: null text has no words and fails the base rules; null lang or
source are groups of their own; groups with fewer than ``min_rows`` rows that
passed the base rules use the estimate pooled over all rows; repeated rows
count as rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gaugeline.llm.common import DOCUMENT_COLUMNS, materialize, words

FEATURES = ("f1", "f2", "f3", "f4")
# Smallest variance of each feature: MCD of a share that is constant in most
# documents is singular, and tiny spreads must not make clean text an outlier.
FLOORS = (0.15, 0.25, 0.003, 0.003)
# Median of the chi-squared distribution with four degrees of freedom.
CHI2_MEDIAN = 3.3567


def base_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts and ``base_failed``."""
    d = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text"),
                    words(F.col("text")).alias("w"))
    d = d.select("*", F.size("w").cast("long").alias("n_words"))
    hashes = F.when(F.col("n_words") >= 5, F.expr(
        "transform(sequence(1, size(w) - 4), i -> struct(xxhash64(w[i-1], w[i], w[i+1], w[i+2], w[i+3]) AS h, i AS i))"))
    d = d.select("*", F.sort_array(F.coalesce(hashes, F.expr("cast(array() as array<struct<h:bigint,i:int>>)"))).alias("s"))
    d = d.select("*", F.expr(
        "CASE WHEN size(s) < 2 THEN cast(array() as array<int>) ELSE sort_array(transform(filter("
        "sequence(0, size(s) - 1), j -> (j > 0 AND s[greatest(j - 1, 0)].h = s[j].h) OR "
        "(j < size(s) - 1 AND s[least(j + 1, size(s) - 1)].h = s[j].h)), j -> s[j].i)) END").alias("p"))
    d = d.select("*", F.expr("split(text, '\\n', -1)").alias("raw_lines"))
    d = d.select("*", F.expr(r"filter(raw_lines, l -> l rlike '[^\\x20\\x09-\\x0D]')").alias("lines"))
    d = d.select(
        "doc_id", "lang", "source", "n_words",
        F.expr("aggregate(w, 0L, (a, x) -> a + length(x))").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("CASE WHEN size(p) = 0 THEN 0L ELSE aggregate(sequence(0, size(p) - 1), 0L, (a, j) -> a + "
               "CASE WHEN j = size(p) - 1 THEN 5 ELSE least(5, p[least(j + 1, size(p) - 1)] - p[j]) END) END")
        .alias("n_repeat_words"),
        F.size("lines").alias("n_lines"))
    return d.select("*", F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words").alias("base_failed"))


def _transformed(stats: DataFrame) -> DataFrame:
    """Shares shrunk towards a usual text, so that a short text is not an
    outlier by chance."""
    return stats.select(
        "*", ((F.col("word_chars") + 250) / (F.col("n_words") + 50)).alias("f1"),
        F.log((F.col("n_symbols") + 1) / (F.col("n_words") + 50)).alias("f2"),
        (F.col("n_dup_lines") / (F.col("n_lines") + 5)).alias("f3"),
        F.sqrt(F.col("n_repeat_words") / (F.col("n_words") + 50)).alias("f4"))


def _estimate(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and Cholesky factor of the floored covariance per group."""
    p = range(len(FEATURES))
    aggs = [F.avg(f).alias(f"m{i}") for i, f in enumerate(FEATURES)]
    aggs += [F.coalesce(F.covar_pop(FEATURES[i], FEATURES[j]), F.lit(0.0)).alias(f"c{i}{j}") for i in p for j in range(i + 1)]
    e = rows.groupBy(*keys).agg(F.count("*").alias("rows"), *aggs)
    for i in p:
        for j in range(i + 1):
            acc = F.col(f"c{i}{j}") + (F.lit(FLOORS[i]) if i == j else F.lit(0.0))
            for k in range(j):
                acc = acc - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            e = e.withColumn(f"l{i}{j}", F.sqrt(F.greatest(acc, F.lit(1e-9))) if i == j else acc / F.col(f"l{j}{j}"))
    return e.select(*keys, "rows", *[f"m{i}" for i in p], *[f"l{i}{j}" for i in p for j in range(i + 1)])


def _distance(rows: DataFrame, est: DataFrame, keys: list[str]) -> DataFrame:
    """Squared Mahalanobis distance ``d2`` by forward substitution; null
    without an estimate, when no row of the table passed the base rules."""
    cond = [F.col(f"r.{k}").eqNullSafe(F.col(f"e.{k}")) for k in keys]
    out = rows.alias("r").join(est.drop("rows").alias("e"), cond, "left").select("r.*", *[
        F.col(f"e.{c}") for c in est.columns if c not in (*keys, "rows")])
    for i, f in enumerate(FEATURES):
        acc = F.col(f) - F.col(f"m{i}")
        for k in range(i):
            acc = acc - F.col(f"l{i}{k}") * F.col(f"y{k}")
        out = out.withColumn(f"y{i}", acc / F.col(f"l{i}{i}"))
    d2 = sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, len(FEATURES))), F.col("y0") * F.col("y0"))
    return out.select(*rows.columns, d2.alias("d2"))


def mcd_distances(vectors: DataFrame, h: float, steps: int, min_rows: int) -> DataFrame:
    """``vectors`` with the robust squared distance ``robust_d2``."""
    size = vectors.where("not base_failed").groupBy("lang", "source").agg(F.count("*").alias("group_rows"))
    v = (vectors.alias("v").join(size.alias("s"), F.col("v.lang").eqNullSafe(F.col("s.lang"))
                                 & F.col("v.source").eqNullSafe(F.col("s.source")), "left")
         .select("v.*", F.coalesce("s.group_rows", F.lit(0)).alias("group_rows")))
    big = F.col("group_rows") >= min_rows
    v = v.select("*", F.when(big, F.lit("own")).otherwise("pooled").alias("g"),
                 F.when(big, F.col("lang")).alias("g_lang"), F.when(big, F.col("source")).alias("g_source"))
    v = materialize(v, "mcd-vectors")
    keys = ["g", "g_lang", "g_source"]
    fit = v.where("not base_failed")
    # The pooled estimate covers all rows, so that it exists for every small group.
    fit = fit.union(fit.where("g = 'own'").withColumns(
        {"g": F.lit("pooled"), "g_lang": F.lit(None).cast("string"), "g_source": F.lit(None).cast("string")}))
    est = materialize(_estimate(fit, keys), "mcd-estimate")
    for step in range(steps):
        d = _distance(fit, est, keys)
        d = materialize(d, "mcd-distances")
        cut = d.groupBy(*keys).agg(F.percentile_approx("d2", h, 10000).alias("cut"))
        cond = [F.col(f"d.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
        near = d.alias("d").join(cut.alias("c"), cond).where("d2 <= cut").select("d.*")
        est = materialize(_estimate(near, keys), "mcd-estimate")
    d = materialize(_distance(fit, est, keys), "mcd-distances")
    scale = d.groupBy(*keys).agg(F.percentile_approx("d2", 0.5, 10000).alias("mid"))
    out = _distance(v, est, keys)
    cond = [F.col(f"d.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    # Consistency: the median distance of a normal vector is the chi-squared
    # median.  The factor only widens, never narrows, a floored covariance.
    return out.alias("d").join(scale.alias("c"), cond, "left").select(
        "d.*", (F.col("d2") / F.greatest(F.col("mid") / CHI2_MEDIAN, F.lit(1.0))).alias("robust_d2"))


def quality_rules(docs: DataFrame, cutoff: float = 40.0, h: float = 0.75, steps: int = 2,
                  min_rows: int = 200) -> DataFrame:
    """One row per document: the base counts, ``robust_d2`` and ``kept``."""
    # Written before any filter: a predicate pushed below the statistics would
    # put the arrays' definitions inside the lambdas, once per element.
    stats = materialize(_transformed(base_statistics(docs)), "quality-statistics")
    v = mcd_distances(stats, h, steps, min_rows)
    return v.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    (~F.col("base_failed") & (F.coalesce("robust_d2", F.lit(0.0)) <= cutoff)).alias("kept"),
                    "robust_d2")


def keep_quality(docs: DataFrame) -> DataFrame:
    """``docs`` without the rejected documents (repeated ids share one verdict
    only when all their rows are rejected)."""
    good = quality_rules(docs).where("kept").select("doc_id").distinct()
    return docs.select(*DOCUMENT_COLUMNS).join(good, "doc_id", "left_semi").select(*DOCUMENT_COLUMNS)
