"""Collocations, spelling variants and line dedup against brute force and on edge tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gaugeline.llm import collocations, line_dedup, spelling

# Columns named like outputs and inner columns must not matter.
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, key string, row long, n long, word string, "
          "gram string, at int, segment int, data binary, phrase string, rank int")
EXTRA = ("k", 1, 2, "w", "g", 3, 4, b"d", "p", 5)
SPACE = " \t\n\x0b\x0c\r"


def table(spark, rows):
    """Rows of (doc_id, text, lang)."""
    return spark.createDataFrame([(i, t, lang, None, None, *EXTRA) for i, t, lang in rows], SCHEMA)


def low(text):
    return text.encode().lower().decode()


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(11)
    vocab = ["".join(rng.choice(list("abé"), rng.integers(4, 8))) for _ in range(60)]
    say = lambda n: " ".join(rng.choice(vocab, n))
    line = "The COMMON line"
    out = [(None, say(9), "en"), (1, None, None), (1, "", "en"), (1, say(5), None), (2, " \t \n\x0b\x0c\r ", "de"), (3, say(5), "en"), (3, say(6), "en")]
    for i in range(60):
        body = [say(int(n)) + rng.choice([".", "!", "", " ;"]) for n in rng.integers(0, 12, 6)]
        body += [line] * int(i % 3 == 0) + ["\tthe Common LINE\r"] * int(i % 4 == 1) + [f"once {i}"] + ["x y z w v"] * int(i % 2)
        out.append((10 + i, "\n".join(rng.permutation(body)), ["en", "de", None][i % 3]))
    out += out[-3:]                                    # repeated rows
    out.append((90, say(60_000) + ", " + "a" * 200_000, "en"))      # a very long text and a very long word
    return out


def lines_by_brute_force(rows, least, min_chars, keep):
    key = lambda x: low(x.strip(SPACE))
    texts = [(t or "").split("\n") for _, t, _ in rows]
    n = Counter(k for ls in texts for k in set(map(key, ls)) if len(k) >= min_chars)
    out, met = [], set()
    for (i, _, _), ls in zip(rows, texts):
        kept = []
        for x in ls:
            k = key(x)
            if n.get(k, 0) < least or (keep == "first" and k not in met):
                kept.append(x)
            met.add(k)
        text = "\n".join(kept)
        out.append((i, len(ls), len(ls) - len(kept), hashlib.sha256(text.encode()).hexdigest(), text))
    return sorted(out, key=repr)


@pytest.mark.parametrize("broadcast", [32 << 20, -1])
@pytest.mark.parametrize("least,min_chars", [(10, 1), (2, 1), (2, 10)])
def test_lines(spark, rows, broadcast, least, min_chars):
    got = line_dedup.line_dedup(table(spark, rows), least, min_chars, broadcast_bytes=broadcast).collect()
    assert sorted(map(tuple, got), key=repr) == lines_by_brute_force(rows, least, min_chars, "none")


def test_first_line_stays(spark, rows):
    d = table(spark, rows).coalesce(1)
    got = line_dedup.line_dedup(d, 3, keep="first").collect()
    assert sorted(map(tuple, got), key=repr) == lines_by_brute_force(rows, 3, 1, "first")


def test_full_filters_change_nothing(spark, rows):
    # A filter far too small takes every line for a suspect.
    got = line_dedup.line_dedup(table(spark, rows), 10, max_bits=1 << 18).collect()
    assert sorted(map(tuple, got), key=repr) == lines_by_brute_force(rows, 10, 1, "none")


def test_filters_miss_no_repeat():
    rng = np.random.default_rng(2)
    h = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    parts = []
    for hashes in (h[:3000], h[2000:], h[:0]):
        f = line_dedup.Filters(1 << 18)
        for piece in np.array_split(hashes, 7):
            f.add(piece)
        parts.append(f.interleaved().view(np.uint8).reshape(-1))
    for order in ((0, 1, 2), (2, 1, 0)):
        a, b, c = (parts[i] for i in order)
        twice = line_dedup.join_filters(line_dedup.join_filters(a, b), c).view(np.uint64).reshape(-1, 2)[:, 1]
        at, mask = line_dedup._places(h, len(twice))
        hit = (twice[at] & mask) == mask
        assert hit[2000:3000].all() and hit.mean() < 0.5


def words_by_brute_force(rows, min_length=5, min_count=3, times=2, every=97):
    c = Counter()
    for i, t, _ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = low(w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            c[w] += 1
    n = {w: k for w, k in c.items() if len(w) >= min_length and k >= min_count}

    def near(a, b):
        if abs(len(a) - len(b)) > 1 or a == b:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:k] + b[k + 1:] == a for k in range(len(b)))
    beside = {a: [b for b in n if near(a, b)] for a in n}
    best = {a: min(bs, key=lambda b: (-n[b], b)) for a, bs in beside.items() if bs}
    form = {a: b for a, b in best.items() if n[b] >= times * n[a]}
    root = lambda a: root(form[a]) if a in form else a
    return sorted((a, form.get(a), root(a), n[a], len(beside[a]), n[form[a]] if a in form else None) for a in n)


@pytest.mark.parametrize("max_group", [60, 2])
def test_spelling(spark, rows, max_group):
    got = spelling.variant_groups(table(spark, rows), max_group=max_group).collect()
    want = words_by_brute_force(rows)
    assert sorted(map(tuple, got)) == want and sum(r[4] for r in want) > 10


def test_spelling_in_hot_groups(spark):
    # Words that all share their first half, chains of forms and ties.
    rng = np.random.default_rng(4)
    words = ["prefixed" + "".join(rng.choice(list("abc"), rng.integers(6, 8))) for _ in range(300)]
    chain = ["abcde"] * 3 + ["abcdf"] * 6 + ["abcgf"] * 12 + ["abcgfh"] * 40 + ["zzzzz"] * 3 + ["zzzza"] * 6 + ["zzzzb"] * 6
    rows = [(1, " ".join(words * 3), "en"), (2, " ".join(words[:50] * 9), None), (3, " ".join(chain), "en"), (4, "ÀÉÎÕü ÀÉÎÕü ÀÉÎÕü×", "en")]
    got = {r.word: r for r in spelling.variant_groups(table(spark, rows), max_group=5).collect()}
    assert sorted(map(tuple, got.values())) == words_by_brute_force(rows)
    assert got["abcde"].root == "abcgfh" and got["zzzzz"].form == "zzzza"
    with pytest.raises(ValueError):
        spelling.variant_groups(table(spark, rows), times=1)


def phrases_by_brute_force(rows, least, inside=80, top=2000):
    f, total = Counter(), Counter()
    for _, t, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low(t or "")):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    out = []
    for lang in total:
        mine = {p: a for (g, p), a in found.items() if g == lang}
        rows_ = []
        for p, a in mine.items():
            if any(len(q) > len(p) and 100 * b >= inside * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in mine.items()):
                continue
            score, _, l, r = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            rows_.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows_)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("least,top,sketch", [(30, 2000, 1 << 20), (3, 25, 1 << 16), (3, 2000, 1 << 16)])
def test_collocations(spark, rows, least, top, sketch):
    few = rows if least > 3 else rows[:-1]
    got = collocations.mine_collocations(table(spark, few), min_count=least, top=top, sketch_bytes=sketch).collect()
    assert sorted(map(tuple, got)) == phrases_by_brute_force(few, least, top=top)


def test_words_are_numbered_anew(spark, rows, monkeypatch):
    monkeypatch.setattr(collocations, "TOKENS", 50)
    monkeypatch.setattr(collocations, "WORDS", 20)
    batches = [b for b in table(spark, rows[:-1]).select("lang", "text").na.fill("und", ["lang"]).toArrow().to_batches()]
    s, c = collocations.Stream(), Counter()
    for b in batches:
        b = b.set_column(1, "text", b.column("text").cast("binary"))
        for lang, ids, _ in s.parts(iter([b])):
            names = [None, *s.numbers]
            c.update((lang, names[i]) for i in ids if i)
    want = Counter(("und" if g is None else g, w.encode()) for _, t, g in rows[:-1] for w in re.split("[ \t.,;:!?\n\x0b\x0c\r]+", low(t or "")) if w)
    assert c == want


def test_paths_are_maximal(spark):
    line = " ".join(f"w{i}" for i in range(40))
    rows = [(i, line + " end" * (i % 2) + ". q r s t u. q r s t v. a a a a a a", "en") for i in range(40)]
    graph = collocations.phrase_graph(table(spark, rows), min_count=30, sketch_bytes=1 << 16)
    got = {r.path: r.n for r in graph["paths"].collect()}
    assert got[line] == 40 and got["q r s t"] == 80 and "q r s t u" not in got
    assert got["q r s t"] == 80 and got["r s t u"] == got["r s t v"] == 40 and got["a a a a"] == 120
    assert {(r.phrase, r.a) for r in graph["phrases"].where("size = 2 and phrase like 'q%'").collect()} == {("q r", 80)}


def test_empty_tables(spark, rows):
    for some in ([], [(None, None, None), (1, "", "en")]):
        d = table(spark, some)
        assert collocations.mine_collocations(d).count() == spelling.variant_groups(d).count() == 0
        assert sorted(map(tuple, line_dedup.line_dedup(d).collect()), key=repr) == lines_by_brute_force(some, 10, 1, "none")


def test_text_ids(spark):
    d = spark.createDataFrame([(f"id-{i % 3}", "Alike\nother words") for i in range(12)], "doc_id string, text string").selectExpr("*", "null as lang")
    got = line_dedup.line_dedup(d).collect()
    assert {(r.doc_id, r.n_dropped) for r in got} == {(f"id-{i}", 2) for i in range(3)}
    assert {r.word for r in spelling.variant_groups(d).collect()} >= {"alike", "other", "words"}
