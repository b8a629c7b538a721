"""Disk held at larger sizes: packed signatures, wide sketches, passes of measuring."""

import numpy as np
import pyarrow as pa

from gaugeline.llm import ngram_jaccard, topk_search


def test_packed_signatures_meet_as_rows_do():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 900, dtype=np.uint64)
    reps, sigs = [], []
    for i in range(60):       # numbers as Spark gives them, far apart between partitions
        s = np.concatenate([base[:int(rng.integers(700, 900))], rng.integers(0, 2**63, 60, dtype=np.uint64)])
        reps.append(int(rng.integers(0, 4)) * 2**33 + 70_000 * i)
        sigs.append(ngram_jaccard.set_signatures(s))
    batches = [b for lo, hi in ((0, 25), (25, 60)) for b in ngram_jaccard._packed(reps[lo:hi], sigs[lo:hi], 7)]
    rows = pa.Table.from_batches(batches).sort_by("bucket")
    assert rows.num_rows == 14
    got = [r for b in ngram_jaccard._meet(iter(rows.to_batches(max_chunksize=3))) for r in b.to_pylist()]
    by_sig = {}
    for rep, sig in zip(reps, sigs):
        for x in sig.tolist():
            by_sig.setdefault(x, []).append(rep)
    want = sorted((rep, min(v)) for v in by_sig.values() if len(v) > 1 for rep in v)
    assert sorted((r["rep"], r["low"]) for r in got) == want and want
    assert len({r["sig"] for r in got}) == sum(len(v) > 1 for v in by_sig.values())
    # A row for each signature took 16 bytes before it was compressed, 12 after.
    assert sum(len(x.as_py()) for c in ("sigs", "reps") for x in rows[c]) < 7 * sum(map(len, sigs))


def test_steps_of_numbers_come_back():
    for reps in ([5], [0, 0, 0], [1, 2, 2, 65_536, 65_537, 131_072, 2**33, 2**33, 2**60]):
        x = np.array(reps, np.int64)
        assert ngram_jaccard._from_steps(ngram_jaccard._steps(x), len(x)).tolist() == reps


def test_wide_sketches_never_rule_out_a_possible_pair():
    rng = np.random.default_rng(2)
    for _ in range(200):
        both, one, two = (rng.integers(0, 2**63, int(rng.integers(1, n)), dtype=np.uint64) for n in (5000, 900, 900))
        r, s = np.concatenate([both, one]), np.concatenate([both, two])
        assert ngram_jaccard.wide_apart(ngram_jaccard.set_wide(r), ngram_jaccard.set_wide(s)) <= len(one) + len(two)


def _said(rng, n):
    return [f"w{x}" for x in rng.integers(0, 10**6, n)]


def _measured(monkeypatch):
    found, measure = [], ngram_jaccard._measure

    def counted(pairs, docs, reps, scratch, name):
        out = measure(pairs, docs, reps, scratch, name)
        found.append((name, out.count()))
        return out

    monkeypatch.setattr(ngram_jaccard, "_measure", counted)
    return found


def test_long_texts_that_cannot_link_are_not_measured(spark, monkeypatch):
    """Halves of the texts are equal, so they share signatures; 512 cells are too few to tell them apart."""
    rng = np.random.default_rng(6)
    half, measured = _said(rng, 1500), _measured(monkeypatch)
    rows = [(i, " ".join(half + _said(rng, 1500))) for i in range(10)]
    rows.append((10, rows[3][1] + " one more"))
    got = {r.doc_id: r.component_id for r in ngram_jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i for i in range(10)} | {10: 3}
    assert sum(n for _, n in measured) == 1, measured     # the one pair that links


def test_sets_are_carried_in_passes(spark, monkeypatch):
    """The same pairs with the same distances, whatever the number of passes."""
    rng = np.random.default_rng(7)
    base, rows = _said(rng, 200), []
    for i in range(24):
        own = list(base)
        for at in rng.choice(200, 2, replace=False):
            own[int(at)] = f"x{i}y{at}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scratch = ngram_jaccard.Scratch(spark, "passes")
    reps = scratch.write(ngram_jaccard._rows(docs).mapInArrow(
        ngram_jaccard._profile, "doc_id long, rid long, n int, k1 long, k2 long, "
        f"{', '.join(f'{c} long' for c in ngram_jaccard.SKETCH)}, wide binary").withColumn("rep", ngram_jaccard.F.col("doc_id")), "reps")
    pairs = spark.createDataFrame([(a, b, 0.9) for b in range(24) for a in range(b)], "a long, b long, reach double")
    run = lambda name: {(r.a, r.b): (r.d, r.linked) for r in ngram_jaccard._measure(pairs, docs, reps, scratch, name).collect()}
    one = run("one")
    assert len(one) == 276
    monkeypatch.setattr(ngram_jaccard, "LEAST", 1)
    parts, write = [], ngram_jaccard.Scratch.write
    monkeypatch.setattr(ngram_jaccard.Scratch, "write", lambda self, df, name: (parts.append(name), write(self, df, name))[1])
    assert run("several") == one
    assert len([x for x in parts if x.startswith("several/")]) == 6     # 276 sets carried, 48 at once


def _found(spark, docs, queries, **more):
    return {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in topk_search.top_k(docs, queries, k=4, **more).collect()}


def test_search_in_several_rounds_and_shards(spark, monkeypatch):
    """Neither the index nor the queries are dealt to shards by a shuffle, and what is written is one packed row a shard."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{x}" for x in rng.zipf(1.4, 30) % 400)) for i in range(240)] + [(None, "w1 w2 w3"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    written, write = {}, topk_search.Scratch.write

    def kept(self, df, name):
        out = write(self, df, name)
        written[name] = (out.count(), out.columns, df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(topk_search.Scratch, "write", kept)
    one = _found(spark, docs, docs.where("doc_id % 5 = 0"))
    assert len(one) == 48 * 4 and "rows" not in written and [x for x in written if x.startswith("found")] == ["found/0"]
    count, columns, _ = written["index"]
    assert count <= 3 and columns == ["n", "words", "terms", "postings", "packed"]
    monkeypatch.setattr(topk_search, "ROUND", 200)
    several = _found(spark, docs, docs.where("doc_id % 5 = 0"), shard_rows=9, block=2)
    assert len([x for x in written if x.startswith("found")]) > 3 and written["index"][0] >= 26
    assert several.keys() == one.keys()
    assert all(several[x][0] == i and abs(several[x][1] - s) < 2e-9 for x, (i, s) in one.items())


def test_a_task_returns_the_best_of_all_its_shards():
    rng = np.random.default_rng(4)
    h = [rng.integers(0, 50, 12) for _ in range(100)]
    rows = pa.RecordBatch.from_arrays([pa.array(range(100), pa.int64()), pa.array(h, pa.list_(pa.int64()))], ["doc_id", "h"])
    shards = list(topk_search._build(iter([rows]), 10))
    terms = np.arange(0, 50, 5)
    sent = (np.array([3, 4]), np.array([0, 6, 10]), terms, np.linspace(0.5, 2, 10))
    run = lambda some: [r for b in topk_search._run(iter(some), sent, 5, 4, 12.0) for r in b.to_pylist()]
    got = run(shards)
    every = [r for s in shards for r in run([s])]
    assert len(shards) == 10 and len(got) == 10 < len(every)
    for q in (3, 4):
        best = sorted(((-r["score"], r["doc_id"]) for r in every if r["query_id"] == q))[:5]
        assert [(-r["score"], r["doc_id"]) for r in got if r["query_id"] == q] == best


def test_representatives_of_long_texts(spark, monkeypatch):
    """The pipeline's second stage: only the pair that links is measured, and one row of it goes."""
    rng = np.random.default_rng(8)
    half, measured = _said(rng, 1200), _measured(monkeypatch)
    texts = [" ".join(half + _said(rng, 1300)) for _ in range(8)]
    texts.append(texts[5] + " one more")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id: r.text for r in ngram_jaccard.keep_representatives(docs).collect()} == dict(enumerate(texts[:8]))
    assert sum(n for _, n in measured) == 1, measured
