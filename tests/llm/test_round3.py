"""Disk held by the training-data operators, and the bounds of the near-duplicate rounds."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeline.llm import common, ngram_jaccard, substring_dedup

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _written(spark, name):
    return set(glob.glob(f"{common.checkpoint_root(spark)}/llm/{name}-*/*"))


def _shuffle_files(spark):
    local = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for top in local for f in glob.glob(f"{top}/*/shuffle*.data")}


@pytest.mark.parametrize("way", ["materialize", "scratch"])
def test_written_tables_leave_no_shuffle_files(spark, way):
    df = spark.range(1000).groupBy((F.col("id") % 10).alias("a")).count()
    before = _shuffle_files(spark)
    out = common.materialize(df, "t") if way == "materialize" else common.Scratch(spark, "t").write(df, "t")
    assert out.count() == 10 and spark.conf.get(common.CLEANUP) == "false"
    spark.conf.set(common.CLEANUP, "true")
    try:
        common.materialize(df, "t")
        assert spark.conf.get(common.CLEANUP) == "true"
    finally:
        spark.conf.set(common.CLEANUP, "false")
    out = common.materialize(df, "t")
    assert len(_shuffle_files(spark) - before) <= 4     # those of count() alone


def test_jaccard_removes_used_tables(spark):
    texts = [" ".join(f"{x}{i}" for i in range(40)) for x in "abcdef"]
    rows = [(i, t + " more" * (i // 6), "en", "s", 0) for i, t in enumerate(texts * 3)]
    before = _written(spark, "jaccard")
    docs = spark.createDataFrame(rows, COLUMNS)
    assert {r.component_id for r in ngram_jaccard.jaccard_classes(docs).collect()} == set(range(6))
    left = {os.path.basename(x) for x in _written(spark, "jaccard") - before}
    assert {x.rstrip("0123456789-") for x in left} <= {"keys", "placed", "parts"}
    assert len([x for x in left if x.startswith("parts")]) == 3


def test_sketches_never_rule_out_a_possible_pair():
    rng = np.random.default_rng(3)
    for _ in range(300):
        common_, one, two = (rng.integers(0, 2**63, int(rng.integers(1, n)), dtype=np.uint64) for n in (900, 200, 200))
        r, s = np.concatenate([common_, one]), np.concatenate([common_, two])
        a, b = ngram_jaccard.set_marks(r).view(np.uint64), ngram_jaccard.set_marks(s).view(np.uint64)
        apart = int(np.bitwise_count(a ^ b).sum())
        assert apart <= len(one) + len(two)
        d = 1 - len(common_) / (len(common_) + len(one) + len(two))
        assert apart * (2 - d) <= d * (len(r) + len(s)) + 1e-6


def test_members_link_across_balls(spark):
    """Two balls whose centres are too far apart to link meet by their members."""
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(600)]
    base = [words[int(i)] for i in rng.integers(0, 600, 150)]
    chain = [base]
    for k in range(12):       # each text changes a few words of the one before
        t = list(chain[-1])
        for at in rng.integers(0, 150, 3):
            t[int(at)] = f"n{k}x{at}"
        chain.append(t)
    texts = [" ".join(t) for t in chain]
    sets = [{tuple(t[i:i + 5]) for i in range(len(t) - 4)} for t in chain]
    order = [0, 12, 6, 3, 9, 1, 11, 5, 7, 2, 10, 4, 8]
    label = {k: k for k in range(13)}
    for a in range(13):
        for b in range(a + 1, 13):
            x, y = sets[order[a]], sets[order[b]]
            if 100 * len(x & y) >= 80 * len(x | y):
                lo, hi = sorted((label[a], label[b]))
                label = {k: lo if v == hi else v for k, v in label.items()}
    docs = spark.createDataFrame([(k, texts[j], "en", "s", 0) for k, j in enumerate(order)], COLUMNS)
    got = {r.doc_id: r.component_id for r in ngram_jaccard.jaccard_classes(docs).collect()}
    assert got == label and len(set(label.values())) < 13


def test_search_keeps_one_small_index(spark):
    """Nothing but the found rows stays, and the index holds frequencies, not impacts."""
    from gaugeline.llm import topk_search
    before = _written(spark, "search")
    rows = [(i, " ".join(f"w{(i * j) % 50}" for j in range(20)), "en", "s", 0) for i in range(300)]
    docs = spark.createDataFrame(rows, COLUMNS)
    got = topk_search.top_k(docs, docs.where("doc_id % 100 = 0"), shard_rows=64).collect()
    assert {r.query_id for r in got} == {0, 100, 200} and len(got) == 30
    assert [os.path.basename(x) for x in _written(spark, "search") - before] == ["found"]
    assert "impacts" not in topk_search.INDEX


def test_collocations_remove_used_tables(spark):
    from gaugeline.llm import collocations
    before = _written(spark, "collocations")
    docs = spark.createDataFrame([(i, "alpha beta gamma delta epsilon zeta", "en", "s", 0) for i in range(40)], COLUMNS)
    assert collocations.mine_collocations(docs, sketch_bytes=1 << 16).count() > 0
    left = {os.path.basename(x) for x in _written(spark, "collocations") - before}
    assert len(left) == 4 and left >= {"vocabulary", "unitigs", "phrases"}


def test_jaccard_pairs_of_a_near_copy_group_grow_linearly(spark, monkeypatch):
    """Copies with two or three words of their own: those with three link by those with two only, and the group is one component."""
    rng = np.random.default_rng(5)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 240)]
    rows = []
    for i in range(80):
        own = list(base)
        for at in rng.choice(np.arange(5, 235, 5), 2 if i % 6 == 5 else 3, replace=False):
            own[at] = f"x{i}y{at}"
        rows.append((i, " ".join(own)))
    measured, measure = [], ngram_jaccard._measure

    def counted(pairs, docs, reps, scratch, name):
        found = measure(pairs, docs, reps, scratch, name)
        measured.append((name, found.count(), found.where("linked").count()))
        return found

    monkeypatch.setattr(ngram_jaccard, "_measure", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_jaccard.jaccard_classes(docs).collect()}
    sets = [set(ngram_jaccard.shingle_set(t.encode()).tolist()) for _, t in rows]
    label = list(range(80))
    for a in range(80):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if 100 * n >= 80 * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if x == old else x for x in label]
    assert got == dict(enumerate(label))
    # All pairs are 3,160; each copy is measured with a few others.
    assert sum(n for _, n, _ in measured) < 80 * 14, measured


def test_passages_of_over_50_words_go_whatever_their_bytes(spark):
    rng = np.random.default_rng(9)
    vocab = [f"{x:x}" for x in range(16, 4096)]
    say = lambda n: " ".join(rng.choice(vocab, n))
    short, fifty = say(55), say(50)
    assert len(short) < 300
    texts = [f"{say(40)} {short} {say(40)}", f"{say(30)}\n{short.replace(' ', chr(10))} {say(30)}", f"{say(20)} {fifty} {say(30)}",
             f"{say(25)} {fifty} {say(30)}", say(120), f"{short} {say(7)} {short}", ""]
    # Runs that overlap, and those that blocks and single strings have to tell apart.
    long_ = say(140).split()
    texts += [" ".join([say(9), *long_[a:b], say(9)]) for a, b in ((0, 60), (8, 70), (17, 71), (40, 101), (88, 140), (0, 50))]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    got = {r.doc_id: r.text for r in substring_dedup.without_repeats(spark.createDataFrame(rows, COLUMNS)).collect()}
    words, seen = [t.split() for t in texts], {}
    for w in words:
        for k in range(len(w) - 50):
            seen[tuple(w[k:k + 51])] = seen.get(tuple(w[k:k + 51]), 0) + 1
    for i, w in enumerate(words):
        gone = {j for k in range(len(w) - 50) if seen[tuple(w[k:k + 51])] > 1 for j in range(k, k + 51)}
        assert got.get(i, "").split() == [x for j, x in enumerate(w) if j not in gone], i
