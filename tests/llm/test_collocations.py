"""Phrase mining against counters over plain loops."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from agewise.llm import collocations as col

DOC = "doc_id long, lang string, text string"


def mined(rows, min_count, top):
    counts, sizes = defaultdict(Counter), Counter()
    low = str.maketrans(col.UPPER, col.LOWER)
    for _, lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(ws)
            for m in range(1, 5):
                counts[lang].update(tuple(ws[i : i + m]) for i in range(len(ws) - m + 1))
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        best = []
        for p, a in often.items():
            cuts = [(2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
            if not any(len(q) > len(p) and 100 * b >= 80 * a and inside(q) for q, b in often.items()):
                best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


def corpus(seed, docs=400):
    rng = random.Random(seed)
    stock = ["new york city", "in the end", "as well as", "le petit prince", "a b a b", "Ünder é", "NASA rocket"]
    rows = []
    for k in range(docs):
        words = []
        for _ in range(rng.randrange(60)):
            words.append(rng.choice(stock) if rng.random() < 0.4 else f"w{int(rng.paretovariate(1)) % 50}")
            words.append(rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "\x1c", "\x00"]))
        rows.append((k, rng.choice(["en", "fr", None, ""]), "".join(words)))
    return rows + [(1, "en", None), (None, "en", ""), (2, "en", "..\n\n"), (3, "de", "once"), *rows[:5]]


@pytest.mark.parametrize("tries, top", [(1_000_000, 2000), (7, 5)])
def test_phrases_equal_counters(spark, tries, top):
    rows = corpus(1)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], DOC + ", rank int, phrase string").repartition(5)
    got = col.collocations(docs, min_count=8, top=top, trie_phrases=tries)
    want = mined(rows, 8, top)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 10


def test_small_slices_and_blocks(spark, monkeypatch):
    rows = corpus(2, 60)
    frames = [{"lang": "und" if r[1] is None else r[1], "text": r[2] or ""} for r in rows]
    monkeypatch.setattr(col, "SLICE_BYTES", 16)
    for f in frames:
        whole = f["text"].encode().translate(col._table()).replace(b"\xff", b" \xff ").split()
        assert [w for ws in col.words_of(f["text"]) for w in ws] == whole
    long = "x" * 100 + " tail. " + "é" * 50
    assert [w for ws in col.words_of(long) for w in ws] == [b"x" * 100, b"tail", b"\xff", "é".encode() * 50]


def test_odd_tables(spark):
    assert col.collocations(spark.createDataFrame([], DOC)).count() == 0
    assert col.collocations(spark.createDataFrame([(1, None, None), (2, "en", "a b c")], DOC)).count() == 0
    rows = [(1, "en", "a b " * 50_000 + "." + "c" * 300_000)]  # one long text
    assert sorted(tuple(r) for r in col.collocations(spark.createDataFrame(rows, DOC)).collect()) == mined(rows, 30, 2000)
    with pytest.raises(ValueError):
        col.collocations(spark.range(1))


@pytest.mark.parametrize("seed, n, words, length", [(1, 1, 1, 2), (2, 500, 20, 3), (3, 3000, 400, 2), (4, 2000, 9, 4), (5, 900, 30, 1)])
def test_double_array_equals_a_set(seed, n, words, length):
    rng = np.random.default_rng(seed)
    phrases = np.unique(rng.integers(1, words + 1, (n, length)).astype(np.int32) * 3, axis=0)
    rng.shuffle(phrases)
    trie = col.DoubleArray(phrases)
    text = rng.integers(0, 3 * words + 5, 20_000).astype(np.int32)
    at, which = trie.walk(text)
    rows = {tuple(p): k for k, p in enumerate(phrases.tolist())}
    want = [(i, rows[w]) for i in range(len(text) - length + 1) if (w := tuple(text[i : i + length].tolist())) in rows]
    assert list(zip(at.tolist(), which.tolist(), strict=True)) == want
    assert len(trie.walk(np.zeros(0, np.int32))[0]) == 0


def test_tries_are_dense():
    """Wide states of many words: some 21 slots a phrase here, 54 before."""
    rng = np.random.default_rng(7)
    ids = (rng.pareto(0.7, (400_000, 2)) * 20).astype(np.int64)
    scattered = rng.permutation(60_000).astype(np.int32) + 1
    phrases = np.unique(scattered[ids[(ids < 60_000).all(axis=1)]], axis=0)
    trie = col.DoubleArray(phrases)
    assert len(phrases) > 100_000 and len(trie.base) < 30 * len(phrases)
    rows = rng.permutation(len(phrases))[:2000]
    at, which = trie.walk(np.c_[np.zeros(2000, np.int32), phrases[rows]].ravel())
    assert which.tolist() == rows.tolist() and at.tolist() == list(range(1, 6000, 3))


def test_rows_of_encoded_texts_are_small(spark):
    """Many short texts: no row holds more than some 8,192 words and a text; before, 131,072."""
    words = [f"w{k % 97}" for k in range(500)]
    docs = spark.range(200, numPartitions=1).selectExpr("'en' lang", f"'{' '.join(words)}' text")
    counts = col.PhraseCounts(docs, 30, 1000)
    sizes = [len(r["tokens"]) for r in counts.texts.collect()]
    assert max(sizes) <= 4 * (8192 + 502) and sum(sizes) >= 4 * 200 * 500
    assert sorted((r["word"], r["n"]) for r in counts.vocabulary.collect()) == sorted((w, 200 * words.count(w)) for w in set(words))


def test_passes_over_texts_follow_frequent_phrases(spark, monkeypatch):
    """Pairs are counted in one pass and longer phrases in one for three tries; before, every trie of candidates took one more."""
    rows = corpus(3, 300)
    written = []
    plain = col.materialise

    def noted(df, name):
        written.append(name)
        return plain(df, name)

    monkeypatch.setattr(col, "materialise", noted)
    got = col.collocations(spark.createDataFrame(rows, DOC), min_count=8, trie_phrases=40)
    assert sorted(tuple(r) for r in got.collect()) == mined(rows, 8, 2000)
    counts = col.PhraseCounts(spark.createDataFrame(rows, DOC).selectExpr("coalesce(lang, 'und') lang", "coalesce(text, '') text"), 8, 40)
    pairs = counts.pairs()
    tries = list(counts._tries(pairs))
    firsts = [set(t.phrases[:, 0].tolist()) for t in tries]
    assert len(tries) > 2 and sum(map(len, firsts)) == len(set().union(*firsts)) and sum(len(t.phrases) for t in tries) == pairs.count()
    assert written.count("phrases") <= 1 + 2 * (1 + len(tries) // 3) + 2 and "candidates" not in written
