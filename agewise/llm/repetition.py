"""Quality rules over repetition, by suffix arrays of the words of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agewise.llm.common import WHITE, need

SYMBOLS = "#*$%&|<>"
#: Words of the texts that share one suffix array; a longer text has one to itself.
BLOCK_WORDS = 200_000


def _starts(changed: np.ndarray) -> np.ndarray:
    """For every place of a sorted array, where its run begins."""
    return np.maximum.accumulate(np.where(changed, np.arange(len(changed)), 0))


def repeated_spans(docs: list[list[bytes]], min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Over the words of each of ``docs``: words in 3-word windows found twice, words covered by maximal
    repeats of at least ``min_words``, the longest repeat, and the cover itself over all words.

    One suffix array holds the suffixes of all texts, ranked within their own text. Ranks by the first
    1, 2, 3, 6, 12, ... words are refined until every suffix stands alone; only suffixes that still share
    their rank are sorted again. The ranks of each length then give the longest common prefix of suffixes that
    are neighbours in the array: those are the borders of the LCP intervals, so a suffix's longest repeat is the
    larger of its two. The union of these prefixes is the union of the spans of all maximal repeats.
    """
    sizes = np.array([len(d) for d in docs], dtype=np.int64)
    n = int(sizes.sum())
    zero = np.zeros(len(docs), dtype=np.int64)
    if not n:
        return zero, zero, zero, np.zeros(0, dtype=bool)
    ids: dict[bytes, int] = {}
    words = np.fromiter((ids.setdefault(w, len(ids)) for d in docs for w in d), dtype=np.int64, count=n)
    of = np.repeat(np.arange(len(docs)), sizes)
    end = np.repeat(np.cumsum(sizes), sizes)
    key = of * len(ids) + words
    order = np.argsort(key, kind="stable")
    held = key[order]
    starts = _starts(np.r_[True, held[1:] != held[:-1]])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = starts
    levels: list[tuple[int, np.ndarray]] = [(1, rank)]
    shared = np.bincount(starts, minlength=n)[rank] > 1
    open_, windows, candidates = np.flatnonzero(shared), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    while len(open_):
        have, rank = levels[-1]
        step, other = (1, levels[0][1]) if have < 3 else (have, rank)
        at = open_ + have
        inside = at < end[open_]
        second = np.where(inside, other[np.minimum(at, n - 1)], -1)
        first = rank[open_]
        order = np.lexsort((second, first))
        a, b, who = first[order], second[order], open_[order]
        old = np.r_[True, a[1:] != a[:-1]]
        new = old | np.r_[True, b[1:] != b[:-1]]
        rank = rank.copy()
        rank[who] = a + _starts(new) - _starts(old)
        levels.append((have + step, rank))
        run = np.diff(np.r_[np.flatnonzero(new), len(who)])
        open_ = np.sort(who[np.repeat(run, run) > 1])
        if have + step == 3:
            windows = open_
        if have + step <= max(min_words, 1):
            candidates = open_
    cover3 = np.zeros(n + 1, dtype=bool)
    for k in range(3):
        cover3[windows + k] = True
    repeat_words = np.bincount(of, weights=cover3[:n], minlength=len(docs)).astype(np.int64)

    covered, longest = np.zeros(n, dtype=bool), zero.copy()
    if len(candidates) > 1:
        in_order = candidates[np.argsort(levels[-1][1][candidates], kind="stable")]
        i, j = in_order[:-1], in_order[1:]
        lcp = np.zeros(len(i), dtype=np.int64)
        same = of[i] == of[j]
        for length, rank in reversed(levels):
            p, q = i + lcp, j + lcp
            ok = same & (p < end[i]) & (q < end[j])
            ok[ok] = rank[p[ok]] == rank[q[ok]]
            lcp[ok] += length
        best = np.maximum(np.r_[lcp, 0], np.r_[0, lcp])
        hit = best >= min_words
        at, size = in_order[hit], best[hit]
        delta = np.zeros(n + 1, dtype=np.int64)
        np.add.at(delta, at, 1)
        np.add.at(delta, at + size, -1)
        covered = np.cumsum(delta)[:n] > 0
        np.maximum.at(longest, of[at], size)
    return repeat_words, np.bincount(of, weights=covered, minlength=len(docs)).astype(np.int64), longest, covered


def _spans(cover: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[0, cover.astype(np.int8), 0]))
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _dup_lines(text: str) -> int:
    seen: set[bytes] = set()
    n = 0
    for line in text.encode().split(b"\n"):
        if line.strip():
            n += line in seen
            seen.add(line)
    return n


def measure(texts: list[str], min_words: int) -> pd.DataFrame:
    """The counts of whole texts, blocks of them sharing one suffix array."""
    out, block, size = [], [], 0

    def flush() -> None:
        repeat, covered, longest, cover = repeated_spans([w for _, w in block], min_words)
        at = 0
        for k, (text, words) in enumerate(block):
            mine = cover[at : at + len(words)]
            at += len(words)
            chars = len(text) - sum(text.count(c) for c in WHITE)
            symbols = sum(text.count(c) for c in SYMBOLS)
            out.append((len(words), chars, symbols, _dup_lines(text), int(repeat[k]), int(covered[k]), int(longest[k]), _spans(mine) if covered[k] else []))
        block.clear()

    for text in texts:
        words = text.encode().split()
        if block and size + len(words) > BLOCK_WORDS:
            flush()
            size = 0
        block.append((text, words))
        size += len(words)
    if block:
        flush()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat", "spans"]
    return pd.DataFrame(out, columns=names)


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long, spans array<struct<start: long, end: long>>"


def repetition_rules(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = 12,
    max_covered: float = 0.3,
    max_longest: int = 200,
    base_words: int = 50,
    base_repeat: float = 0.5,
) -> DataFrame:
    """(id, counts, spans, base_failed, kept) for every row of ``docs``; whole texts.

    Words are runs of other than ASCII white space. ``spans`` are the word ranges (end excluded) that maximal
    repeats of at least ``min_words`` words cover together, ``covered_words`` their length, ``longest_repeat`` the
    words of the longest one. A text fails the base rules if it has fewer than ``base_words`` words or more than
    ``base_repeat`` of them lie in 3-word windows found twice or more; it is kept if it passes those, repeats cover at
    most ``max_covered`` of its words and none is longer than ``max_longest`` words.

    A null text counts as empty: no words, base_failed. Ids may be null or repeat; each row gives one row. Other
    columns are not read. An empty table gives no rows.
    """
    need(docs, [id_col, text_col])

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = measure([t or "" for t in part["text"]], min_words)
            found.insert(0, "id", part["id"].array)
            yield found

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = rows.mapInPandas(work, f"id {kind}, {SCHEMA}")
    n = F.col("n_words")
    failed = (n < base_words) | (F.col("n_repeat_words") > base_repeat * n)
    kept = ~failed & (F.col("covered_words") <= max_covered * n) & (F.col("longest_repeat") <= max_longest)
    return found.withColumnRenamed("id", id_col).withColumns({"base_failed": failed, "kept": kept})
