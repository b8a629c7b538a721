"""The pipeline's stages on a small table: each judged on its own input."""

import re
from collections import Counter

import numpy as np

import corpus_pipeline

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _shingles(text):
    w = WORD.findall(text.encode().lower().decode())
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def _base_failed(text):
    w = WORD.findall(text or "")
    c = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    cover = {j for i in range(len(w) - 4) if c[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    return len(w) < 10 or 100 * len(cover) > 20 * len(w)


def test_stages_by_brute_force(spark, scratch):
    rng = np.random.default_rng(8)
    vocab = ["".join(rng.choice(list("abcdeiou"), rng.integers(2, 8))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocab, n))
    passage = say(150)
    texts = [say(int(n)) for n in rng.integers(40, 160, 30)]
    texts += texts[:4] + [t.replace(t.split()[20], "changed", 1) for t in texts[4:8]]
    texts += [f"{say(60)} {passage} {say(60)}" for _ in range(4)] + ["two words", "", "same again and so on " * 12]
    rows = [(i, t, "en", "web", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{scratch}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i % 7 == 0)) for i in range(0, 30, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{scratch}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard", "suffix_dedup", "mixing", "sentencepiece"]
    docs, left = spark.read.parquet(f"{scratch}/documents.parquet"), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, scratch)
        assert i == 4 or docs.columns == COLUMNS
        docs.write.parquet(f"{scratch}/{name}")
        docs = spark.read.parquet(f"{scratch}/{name}")
        left[name] = docs.collect()
    # Quality: what fails the base rules goes, and nearly all clean texts stay.
    kept = {r.doc_id: r.text for r in left["quality_rules"]}
    assert not any(_base_failed(t) for t in kept.values())
    clean = [i for i, t in enumerate(texts) if not _base_failed(t)]
    assert all(texts[i] == t for i, t in kept.items()) and len(kept) >= 0.9 * len(clean)
    # Near duplicates: one document of each group of its own input.
    sets = {i: _shingles(t) for i, t in kept.items()}
    group = {i: i for i in kept}
    for a in sorted(kept):
        for b in sorted(kept):
            n = len(sets[a] & sets[b])
            if a < b and 100 * n >= 80 * len(sets[a] | sets[b]):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {k: new if v == old else v for k, v in group.items()}
    one = {r.doc_id: r.text for r in left["ngram_jaccard"]}
    assert sorted(group[i] for i in one) == sorted(set(group.values())) and all(kept[i] == t for i, t in one.items())
    # Passages: every byte of a 400-byte string that starts twice is gone.
    data = {i: t.encode() for i, t in one.items()}
    seen = Counter(b[k:k + 400] for b in data.values() for k in range(len(b) - 399))
    want = {}
    for i, b in data.items():
        gone = bytearray(len(b))
        for k in range(len(b) - 399):
            if seen[b[k:k + 400]] > 1:
                gone[k:k + 400] = b"\1" * 400
        want[i] = bytes(x for x, g in zip(b, gone) if not g).decode()
    cut = {r.doc_id: r.text for r in left["suffix_dedup"]}
    assert all(cut[i] == want[i] for i in cut) and set(want) - set(cut) <= {i for i, t in want.items() if not t}
    assert any(want[i] != one[i] for i in one)
    # Mixing draws from its input; the samples decode to the text they are of.
    mixed = {r.doc_id: r.text for r in left["mixing"]}
    assert mixed and all(cut[i] == t for i, t in mixed.items())
    assert {r.doc_id for r in left["sentencepiece"]} == set(mixed) and all(r.decoded_ok for r in left["sentencepiece"])
