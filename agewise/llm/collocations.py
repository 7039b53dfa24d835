"""Phrase mining: level by level, frequent phrases in double-array tries are walked from all places of the encoded texts at once, and the words after them counted."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agewise.llm.common import LOWER, UPPER, materialise, need

#: Bytes that end a piece; space and tab part words.
BREAKS = b".,;:!?\n\x0b\x0c\r"
#: A byte that no UTF-8 text holds stands for the end of a piece.
BREAK = b"\xff"
#: Bytes of a text that are split at a time, words of a stored chunk, chunks handed over at a time, and words whose vocabulary is held together.
#: A chunk's row takes 32 KB (a longer text is one chunk), far below what the JVM's heap keeps in regions of its own.
SLICE_BYTES, CHUNK_WORDS, CHUNKS, BLOCK_WORDS = 1 << 20, 1 << 13, 16, 1 << 20
#: Buckets of the bitmap of frequent phrases: so many a phrase, within these bounds (2 to 32 MB in all), and those of a row of it.
PHRASE_BUCKETS, LEAST_BUCKETS, MOST_BUCKETS, ROW_BUCKETS = 16, 1 << 24, 1 << 28, 1 << 16
#: Places whose phrases are counted together before they leave a task, and counts of a share that are held before they are summed.
PLACES, HELD = 1 << 20, 1 << 16
#: Tries that one pass over the texts walks; a worker holds these, the driver one.
TRIES = 3
#: Words of a vocabulary that are handed over at a time.
VOCABULARY_ROWS = 20_000
#: States of a trie with so many children at most are placed together.
NARROW = 3
#: Neighbouring bases that are tried for a wide state before its trie's array grows.
BASES = 1 << 10
#: Words of one task when words are numbered.
NUMBERED = 100_000


def _table() -> bytes:
    table = bytearray(range(256))
    for a, b in zip(UPPER.encode(), LOWER.encode(), strict=True):
        table[a] = b
    for b in BREAKS:
        table[b] = BREAK[0]
    return bytes(table)


def words_of(text: str, table: bytes = _table()) -> Iterator[list[bytes]]:
    """The words of a text in slices, A-Z lower-cased, with ``BREAK`` where a piece ends. ``bytes.split`` parts at space and tab only, as all
    other ASCII white space is a break."""
    data = text.encode("utf-8", "replace").translate(table).replace(BREAK, b" " + BREAK + b" ").replace(b"\t", b" ")
    at = 0
    while at < len(data):
        end = len(data) if len(data) - at <= SLICE_BYTES else data.find(b" ", at + SLICE_BYTES)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


class _Ids(dict):
    """Numbers from 1 in the order of first sight; the break is 0."""

    def __init__(self, counter: list[int]):
        super().__init__({BREAK: 0})
        self.counter = counter

    def __missing__(self, word: bytes) -> int:
        self.counter[0] += 1
        self[word] = self.counter[0]
        return self.counter[0]


ENCODED = "block long, tokens binary, local int, lang string, word string, n long"


def _encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chunks of texts as local numbers of words (0 at the end of a piece and of a text), and each block's vocabulary with its counts."""
    block = TaskContext.get().partitionId() << 32
    langs: dict[str, _Ids] = {}
    counter, held, chunks, size, in_block = [0], [], [], 0, 0
    total = np.zeros(1, np.int64)

    def chunk() -> None:
        nonlocal size
        chunks.append(np.concatenate([np.zeros(1, np.int32), *held]))
        held.clear()
        size = 0

    def tokens() -> pd.DataFrame:
        nonlocal total
        found = np.bincount(np.concatenate(chunks), minlength=counter[0] + 1)
        found[: len(total)] += total
        total = found
        rows = pd.DataFrame({"block": block, "tokens": [x.tobytes() for x in chunks], "local": None, "lang": None, "word": None, "n": None})
        chunks.clear()
        return rows

    def vocabulary() -> Iterator[pd.DataFrame]:
        nonlocal total
        for lang, ids in langs.items():
            del ids[BREAK]
            local = np.fromiter(ids.values(), np.int32, len(ids))
            words = iter(ids)
            for k in range(0, len(local), VOCABULARY_ROWS):
                part = local[k : k + VOCABULARY_ROWS]
                yield pd.DataFrame({"block": block, "tokens": None, "local": part, "lang": lang, "word": [next(words).decode() for _ in part], "n": total[part]})
        langs.clear()
        counter[0], total = 0, np.zeros(1, np.int64)

    end = np.zeros(1, np.int32)
    for part in parts:
        for lang, text in zip(part["lang"], part["text"], strict=True):
            ids = langs.get(lang)
            if ids is None:
                ids = langs[lang] = _Ids(counter)
            for words in words_of(text):
                held.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
                size += len(words)
                in_block += len(words)
            held.append(end)
            if size >= CHUNK_WORDS:
                chunk()
                if len(chunks) >= CHUNKS or in_block >= BLOCK_WORDS:
                    yield tokens()
                if in_block >= BLOCK_WORDS:
                    yield from vocabulary()
                    block, in_block = block + 1, 0
    if held:
        chunk()
    if chunks:
        yield tokens()
    yield from vocabulary()


def _renumber(chunks: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """One block's chunks in global numbers; rare words are 0, and of several 0 in a row one stays."""
    out = []
    local, number = known["local"].to_numpy(np.int64), known["id"].to_numpy(np.int32)
    blobs = [np.frombuffer(blob, np.int32) for blob in chunks["tokens"]]
    to = np.zeros(max([int(x.max()) for x in [local, *blobs] if len(x)], default=0) + 1, np.int32)
    to[local] = number
    for tokens in blobs:
        ids = to[tokens]
        out.append(ids[(ids > 0) | np.r_[True, ids[:-1] > 0]].tobytes())
    return pd.DataFrame({"tokens": out})


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9)


def _bucket(words: list[np.ndarray], buckets: int) -> np.ndarray:
    """Buckets (a power of two) of phrases whose words of each place are given."""
    h = words[0].astype(np.uint64)
    for w in words[1:]:
        h = _mixed(h, w)
    return (h >> np.uint64(32)).astype(np.int64) & (buckets - 1)


def _summed(packed: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different numbers, ascending, and the sums of their counts."""
    order = np.argsort(packed, kind="stable")
    packed = packed[order]
    start = np.flatnonzero(np.r_[True, packed[1:] != packed[:-1]])
    return packed[start], np.add.reduceat(n[order], start, dtype=np.int64)


class DoubleArray:
    """A trie of phrases of one length in two arrays: the child of state s by symbol c is at base[s] + c, if check there is s.

    Symbols are the places of words in ``alphabet``, from 1. ``accept`` holds the row of the phrase that ends in a state, else -1.
    """

    def __init__(self, phrases: np.ndarray):
        self.phrases = phrases
        self.length = phrases.shape[1]
        self.alphabet = np.unique(phrases)
        codes = np.searchsorted(self.alphabet, phrases) + 1
        self.width = len(self.alphabet) + 1
        order = np.lexsort(codes.T[::-1])
        codes = codes[order]
        n = len(codes)
        self.used = np.zeros(2 * n + 2 * self.width, bool)
        self.used[0] = True
        self.base = np.zeros(len(self.used), np.int32)
        self.check = np.full(len(self.used), -1, np.int32)
        self.rng = np.random.default_rng(1)
        at = np.zeros(n, np.int64)  # the state of each phrase's first words
        for d in range(self.length):
            new = np.ones(n, bool)
            new[1:] = (at[1:] != at[:-1]) | (codes[1:, d] != codes[:-1, d])
            first = np.flatnonzero(new)
            parent, symbol = at[first], codes[first, d]
            slots = self._place(parent, symbol)
            at = slots[np.cumsum(new) - 1]
        size = int(np.flatnonzero(self.used)[-1]) + self.width + 1
        self._grow(size)
        self.base, self.check = self.base[:size].copy(), self.check[:size].copy()
        self.accept = np.full(size, -1, np.int32)
        self.accept[at] = order
        self.codes = np.zeros(int(self.alphabet[-1]) + 2, np.int32)  # the last is that of all greater words
        self.codes[self.alphabet] = np.arange(1, self.width)
        to = self.base[0] + self.codes
        self.begins = (self.codes > 0) & (self.check[to] == 0)
        del self.used, self.rng

    def _grow(self, size: int) -> None:
        more = size - len(self.used)
        if more > 0:
            self.used = np.r_[self.used, np.zeros(more, bool)]
            self.base = np.r_[self.base, np.zeros(more, np.int32)]
            self.check = np.r_[self.check, np.full(more, -1, np.int32)]

    def _place(self, parent: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Slots of the children; those of one parent stand together in the input."""
        start = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
        size = np.diff(np.r_[start, len(parent)])
        base = np.zeros(len(start), np.int64)
        for g in np.argsort(-size, kind="stable")[: int((size > NARROW).sum())]:  # wide states first, each where it fits
            own = symbol[start[g] : start[g] + size[g]]
            base[g] = self._fit(own)
            self.used[base[g] + own] = True
        group = np.repeat(np.arange(len(start)), size)
        open_ = np.flatnonzero(size[group] <= NARROW)
        span = max(2 * (int(self.used.sum()) + len(open_)), self.width)
        self._grow(span + self.width + 1)
        while len(open_):  # narrow states all at once, anew where two meet
            tries = self.rng.integers(0, span, len(start))
            slots = tries[group[open_]] + symbol[open_]
            clash = self.used[slots]
            by = np.argsort(slots, kind="stable")
            again = np.r_[False, slots[by][1:] == slots[by][:-1]]
            clash[by[again]] = True
            bad = np.zeros(len(start), bool)
            bad[group[open_[clash]]] = True
            done = ~bad[group[open_]]
            self.used[slots[done]] = True
            base[group[open_[done]]] = tries[group[open_[done]]]
            open_ = open_[~done]
        slots = base[group] + symbol
        self.base[parent[start]] = base
        self.check[slots] = parent
        return slots

    def _fit(self, own: np.ndarray) -> int:
        """A base at which all of a wide state's children have free slots, sought among neighbours at random places of a slowly growing array."""
        reach = len(self.used) - self.width
        while True:
            at = int(self.rng.integers(0, reach)) + np.arange(BASES)
            self._grow(int(at[-1]) + self.width + 1)
            k, more = 0, 4
            while k < len(own) and len(at):  # the first few children rule out most bases
                at = at[~self.used[at[:, None] + own[k : k + more]].any(axis=1)]
                k, more = k + more, 2 * more
            if len(at):
                return int(at[0])
            reach += reach // 16 + 1

    def walk(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, phrases): all places of a text where a phrase begins, and which. The states of all places go a level at a time, from those
        whose word begins a phrase of this trie."""
        ids = np.minimum(np.r_[ids, np.zeros(self.length, np.int32)], len(self.codes) - 1)
        at = np.flatnonzero(self.begins[ids])
        state = np.zeros(len(at), np.int64)
        for d in range(self.length):
            symbol = self.codes[ids[at + d]]
            to = self.base[state] + symbol
            ok = (symbol > 0) & (self.check[to] == state)
            at, state = at[ok], to[ok]
        return at, self.accept[state]


def _lists(rows: np.ndarray) -> pd.Series:
    return pd.Series(list(rows), dtype=object)  # an empty one as well


def _phrase(parts: list[Column]) -> Column:
    return F.array(*parts)


@contextmanager
def _small_batches(spark: SparkSession, rows: int = 32) -> Iterator[None]:
    """Few rows a batch to and from Python, and from files, as a row holds a chunk or a text; for jobs that run inside."""
    sizes = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.parquet.columnarReaderBatchSize": 4 * rows}
    before = {key: spark.conf.get(key) for key in sizes}
    try:
        for key, size in sizes.items():
            spark.conf.set(key, size)
        yield
    finally:
        for key, size in before.items():
            spark.conf.set(key, size)


def _joined(chunks: pd.Series) -> np.ndarray:
    """A batch's chunks as one text: each begins and ends with 0."""
    return np.frombuffer(b"".join(chunks), np.int32)


class PhraseCounts:
    """Counts of phrases over encoded texts. Everything that grows with the corpus is a table in the shared folder."""

    def __init__(self, docs: DataFrame, min_count: int, trie_phrases: int):
        self.spark, self.min_count, self.trie_phrases = docs.sparkSession, min_count, trie_phrases
        with _small_batches(self.spark, 250):
            held = materialise(docs.mapInPandas(_encode, ENCODED), "encoded")
        words = held.where(F.col("word").isNotNull()).select("block", "local", "lang", "word", "n")
        self.sizes = materialise(words.groupBy("lang").agg(F.sum("n").alias("n")), "sizes")
        self.vocabulary = self._numbered(words)
        known = words.join(self.vocabulary.select("lang", "word", "id"), ["lang", "word"]).select(F.col("block").alias("of"), "local", "id")
        chunks = held.where(F.col("tokens").isNotNull()).select("block", "tokens")
        with _small_batches(self.spark):
            self.texts = materialise(chunks.groupBy("block").cogroup(known.groupBy("of")).applyInPandas(_renumber, "tokens binary"), "texts")

    def _numbered(self, words: DataFrame) -> DataFrame:
        """(lang, word, n, id): words often enough, numbered from 1 with few gaps: each task numbers its own share of them."""
        often = materialise(words.groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= self.min_count), "words")
        shares = often.count() // NUMBERED + 1
        share = F.pmod(F.xxhash64("lang", "word"), F.lit(shares))
        row = F.row_number().over(Window.partitionBy("share").orderBy("lang", "word"))
        ided = often.withColumn("share", share).select("lang", "word", "n", ((row - 1) * shares + F.col("share") + 1).cast("int").alias("id"))
        return materialise(ided, "vocabulary")

    def _over_texts(self, work, schema: str) -> DataFrame:
        return self.texts.mapInPandas(work, schema)

    def _bitmap(self, phrases: DataFrame) -> np.ndarray:
        """A bit for each bucket of words' hashes; those of the frequent ``phrases`` are 1."""
        buckets = LEAST_BUCKETS
        while buckets < min(PHRASE_BUCKETS * phrases.count(), MOST_BUCKETS):
            buckets *= 2

        def places(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                if len(part):
                    found = np.unique(_bucket(list(np.stack(part["p"]).T), buckets))
                    row, start = np.unique(found // ROW_BUCKETS, return_index=True)
                    yield pd.DataFrame({"row": row.astype(np.int32), "place": [x.tobytes() for x in np.split((found % ROW_BUCKETS).astype(np.uint16), start[1:])]})

        def bits(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            rows: dict[int, np.ndarray] = {}
            for part in parts:
                for row, place in zip(part["row"], part["place"], strict=True):
                    rows.setdefault(row, np.zeros(ROW_BUCKETS, bool))[np.frombuffer(place, np.uint16)] = True
            for row, held in rows.items():
                yield pd.DataFrame({"row": [row], "bits": [np.packbits(held).tobytes()]})

        with _small_batches(self.spark, 10_000):
            rows = phrases.select("p").mapInPandas(places, "row int, place binary").repartition("row").mapInPandas(bits, "row int, bits binary").collect()
        bitmap = np.zeros(buckets // 8, np.uint8)
        for r in rows:  # MOST_BUCKETS bits at most
            bitmap[r["row"] * ROW_BUCKETS // 8 : (r["row"] + 1) * ROW_BUCKETS // 8] = np.frombuffer(r["bits"], np.uint8)
        return bitmap

    def _grown(self, tries: list[Broadcast], kept: Broadcast | None) -> DataFrame:
        """(p, n): the frequent ones among the phrases that are a phrase of ``tries``, or any known word if there is none, and one word more. All
        are counted as they are met; left out before are those whose last words are surely not frequent, by the bitmap ``kept``."""
        shares = max(256, 4 * int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        least = self.min_count

        def extended(ids: np.ndarray) -> Iterator[np.ndarray]:
            """For every place where a phrase goes on, the phrase's row (or the word) and the next word as one number."""
            if kept is None:
                at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
                yield ids[at].astype(np.int64) << 32 | ids[at + 1]
                return
            bitmap, first = kept.value, 0
            for trie in (t.value for t in tries):
                at, which = trie.walk(ids)
                after = ids[at + trie.length]  # a text ends with 0
                ok = after > 0
                at, which, after = at[ok], which[ok], after[ok]
                b = _bucket([ids[at + d] for d in range(1, trie.length + 1)], 8 * len(bitmap))
                ok = (bitmap[b >> 3] >> (7 - (b & 7)).astype(np.uint8)) & 1 == 1
                yield which[ok].astype(np.int64) + first << 32 | after[ok]
                first += len(trie.phrases)

        def places(parts: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
            """These of some ``PLACES`` places at a time."""
            held, size = [], 0
            for part in parts:
                for packed in extended(_joined(part["tokens"])):
                    held.append(packed)
                    size += len(packed)
                if size >= PLACES:
                    yield np.concatenate(held)
                    held, size = [], 0
            if size:
                yield np.concatenate(held)

        def counts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Different phrases of some places and their counts, a row for each share of them."""
            for packed in places(parts):
                one, n = np.unique(packed, return_counts=True)
                share = (_mixed(one >> 32, one & 0xFFFFFFFF) >> np.uint64(32)).astype(np.int64) % shares
                order = np.argsort(share.astype(np.int32), kind="stable")
                names, start = np.unique(share[order], return_index=True)
                parted = [[x.tobytes() for x in np.split(v[order], start[1:])] for v in (one, n.astype(np.int32))]
                yield pd.DataFrame({"share": names.astype(np.int32), "packed": parted[0], "n": parted[1]})

        def frequent(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Sums over all tasks; what waits in a share is summed whenever it is as much as the sums are."""
            sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

            def settled(share: int) -> tuple[np.ndarray, np.ndarray]:
                held = [*([sums.pop(share)] if share in sums else []), *waiting.pop(share, [])]
                return held[0] if len(held) == 1 else _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))

            for part in parts:
                for share, packed, n in zip(part["share"], part["packed"], part["n"], strict=True):
                    own = waiting.setdefault(share, [])
                    own.append((np.frombuffer(packed, np.int64), np.frombuffer(n, np.int32)))
                    if sum(len(x) for x, _ in own) >= max(HELD, len(sums[share][0]) if share in sums else 0):
                        sums[share] = settled(share)
            phrases = np.concatenate([t.value.phrases for t in tries]) if tries else None
            for share in sorted({*sums, *waiting}):
                one, n = settled(share)
                often = n >= least
                one, n = one[often], n[often].astype(np.int64)
                if len(one):
                    first, last = one >> 32, (one & 0xFFFFFFFF).astype(np.int32)
                    yield pd.DataFrame({"p": _lists(np.c_[first.astype(np.int32) if phrases is None else phrases[first], last]), "n": n})

        found = self.texts.mapInPandas(counts, "share int, packed binary, n binary").repartition("share").mapInPandas(frequent, "p array<int>, n long")
        found = materialise(found, "phrases")
        for t in tries:
            t.unpersist()
        return found

    def pairs(self) -> DataFrame:
        """(p, n): the frequent phrases of two words."""
        return self._grown([], None)

    def _tries(self, phrases: DataFrame) -> Iterator[DoubleArray]:
        """All phrases in tries of some ``trie_phrases`` phrases each, one at a time. Phrases with one first word share a trie, so
        that of all tries only one is walked from a place."""
        n = phrases.count()
        shards = -(-n // self.trie_phrases)
        share = F.pmod(F.xxhash64(F.col("p")[0]), F.lit(shards)) if shards > 1 else F.lit(0)
        for k in range(shards):
            rows = phrases.where(share == k).select("p").toArrow()["p"].combine_chunks()  # some trie_phrases rows
            if len(rows):
                yield DoubleArray(rows.flatten().to_numpy().reshape(len(rows), -1))

    def longer(self, frequent: DataFrame) -> DataFrame:
        """(p, n): the frequent phrases of one word more than those of ``frequent``."""
        sc = self.spark.sparkContext
        kept, tries, found = sc.broadcast(self._bitmap(frequent)), [], self.spark.createDataFrame([], "p array<int>, n long")
        for trie in self._tries(frequent):
            tries.append(sc.broadcast(trie))
            del trie
            if len(tries) == TRIES:
                found, tries = found.unionByName(self._grown(tries, kept)), []
        if tries:
            found = found.unionByName(self._grown(tries, kept))
        kept.unpersist()
        return found


def _wide(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(20,0)")


def collocations(
    docs: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    min_count: int = 30,
    max_words: int = 4,
    top: int = 2000,
    absorbed: tuple[int, int] = (80, 100),
    scale: int = 2_000_000,
    trie_phrases: int = 250_000,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    Texts are lower-cased (A-Z), split into pieces at ``.,;:!?`` and line ends, and those into words at spaces and tabs. A phrase of 2 to
    ``max_words`` words that comes at least ``min_count`` times within pieces (a) is scored by each of its cuts into counts l and r:
    floor(scale * a / (l + r)), exactly; the lowest cut counts, the earliest of equals. A phrase is dropped if a longer one that holds its
    words has at least 80 of 100 of its count. n is the number of words of the language.

    Words are numbered once, and texts stored as numbers. At each length, the frequent phrases of the last are put into double-array tries of some
    ``trie_phrases`` phrases, broadcast a few at a time; all places of the texts walk a trie together, and the words that come after its
    phrases are counted there, if the longer phrase's last words are frequent too. Tasks' counts are summed, so candidates need no pass of
    their own, and each place is walked in one trie only.

    A null text is empty and a null language ``und``; a language without frequent phrases has no rows, nor has an empty table.
    Equal scores go by count, then phrase (bytes). Repeated rows count each; other columns are not read. Words are told apart exactly.
    """
    need(docs, [text_col, lang_col])
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counts = PhraseCounts(rows, min_count, trie_phrases)
    with _small_batches(counts.spark):
        levels = [counts.pairs()]
        while len(levels) + 1 < max_words:
            levels.append(counts.longer(levels[-1]))
    phrases = levels[0]
    for level in levels[1:]:
        phrases = phrases.unionByName(level)
    phrases = materialise(phrases, "phrases")
    every = phrases.unionByName(counts.vocabulary.select(_phrase([F.col("id")]).alias("p"), "n"))

    size = F.size("p")
    cuts = phrases.select("p", "n", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("*", F.slice("p", F.lit(1), F.col("k")).alias("lp"), F.slice("p", F.col("k") + 1, size - F.col("k")).alias("rp"))
    cuts = cuts.join(every.select(F.col("p").alias("lp"), F.col("n").alias("l")), "lp").join(every.select(F.col("p").alias("rp"), F.col("n").alias("r")), "rp")
    score = F.expr(f"(cast({scale} as decimal(10,0)) * cast(n as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = cuts.withColumn("score", score).groupBy("p", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    inner = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.slice("p", i, m))))
    holds = phrases.where(size > 2).select(F.explode(inner).alias("p"), "n").groupBy("p").agg(F.max("n").alias("most"))
    kept = scored.join(holds, "p", "left").where(F.col("most").isNull() | (_wide("most") * absorbed[1] < _wide("n") * absorbed[0]))

    named = kept.select("p", F.posexplode("p").alias("i", "id")).join(counts.vocabulary.select("id", "lang", "word"), "id")
    named = named.groupBy("p", "lang").agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("w"))
    named = named.select("p", "lang", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("phrase"))
    found = kept.join(named, "p").select("lang", "phrase", F.col("n").alias("a"), "cut.l", "cut.r", "cut.score")
    # the best of each share of a language first, so that no task ranks a whole language
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    first = found.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(counts.sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
