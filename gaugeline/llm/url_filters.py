"""URL filters by association rules (native).

FP-growth over the distinct url tokens of labelled pages, with the class as
one more item, mines token combinations; rules that conclude the blocked class
with enough confidence and support are kept.  An inverted index from token to
rule matches all pages: a rule fires where all of its tokens were found.
Listed host and path rules go before mined ones, the longest first.

The label of a page is that of its document, whose number is the last part of
the url path (``/en/7817``, ``/en/7817.html``); page_id is no doc_id.

Defined cases: null urls or urls without ``://`` have an empty host and path
and no tokens, so they are allowed; pages without a document number have no label; without labels no rule is mined; repeated
rows get the same verdict; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from gaugeline.llm.common import materialize

# Fixed rules: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"),
         ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
BLOCKED = "class=block"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    whole = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(whole, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(whole, pattern, 2)


def tokens() -> Column:
    """Distinct tokens of the host labels and words, the path segments and the
    query keys."""
    return F.expr(r"""array_distinct(concat(
        transform(filter(split(host, '\\.'), x -> x != ''), x -> concat('h:', x)),
        transform(filter(split(host, '[^a-z0-9]+'), x -> x != ''), x -> concat('w:', x)),
        transform(filter(split(path, '/'), x -> x != ''), x -> concat('p:', x)),
        transform(regexp_extract_all(coalesce(url, ''), '[?&]([^=&#]+)', 1), x -> concat('q:', x))))""")


def document() -> Column:
    """Number of the page's document, null if the path ends in none."""
    return F.expr(r"try_cast(nullif(regexp_extract(path, '/([0-9]+)(?:[.][A-Za-z0-9]+)?/*$', 1), '') as bigint)")


def listed(rules: tuple = RULES) -> tuple[Column, Column]:
    """Rule text and verdict of the longest fitting listed rule."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def mine_rules(labelled: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    """(rule_id, tokens, confidence, support) concluding the blocked class."""
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(labelled)
    return (model.associationRules.where(F.col("consequent")[0] == BLOCKED)
            .select(F.array_sort("antecedent").alias("tokens"), "confidence", "support")
            .withColumn("rule_id", F.xxhash64("tokens")))


def judge_urls(pages: DataFrame, labels: DataFrame, min_support: float = 0.005, min_confidence: float = 0.8,
               min_pages: int = 10) -> DataFrame:
    """page_id, host, path, rule, verdict and the mined confidence."""
    host, path = parts(F.col("url"))
    p = pages.select("page_id", "url", host.alias("host"), path.alias("path")).select("*", tokens().alias("tokens"))
    bad = labels.groupBy("doc_id").agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    labelled = (p.withColumn("doc_id", document()).join(bad, "doc_id")
                .select(F.concat("tokens", F.when(F.col("bad") == 1, F.array(F.lit(BLOCKED))).otherwise(
                    F.expr("cast(array() as array<string>)"))).alias("items")))
    labelled = materialize(labelled, "url-items")
    # A rule also needs ``min_pages`` pages, or few labels would be learned by heart.
    min_support = min(1.0, max(min_support, min_pages / max(labelled.count(), 1)))
    rules = materialize(mine_rules(labelled, min_support, min_confidence), "url-rules")
    index = rules.select("rule_id", "confidence", F.size("tokens").alias("need"), F.explode("tokens").alias("token"))
    # One row per distinct token set, so that repeated hosts match once.
    sets = p.select("tokens").distinct()
    hits = (sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token")
            .groupBy("tokens", "rule_id").agg(F.count("*").alias("n"), F.max("need").alias("need"), F.max("confidence").alias("confidence"))
            .where("n = need").groupBy("tokens").agg(F.max("confidence").alias("confidence")))
    rule, verdict = listed()
    out = p.join(hits, "tokens", "left")
    mined = F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, mined).alias("verdict"), "confidence")
