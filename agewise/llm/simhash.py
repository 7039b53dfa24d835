"""SimHash near-dedup: fingerprints joined by Golay-code keys, classes by connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import cache, reduce
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agewise.llm.common import connected_components, materialise, need

#: The generator polynomial of the binary Golay code of length 23.
GENERATOR = 0b110001110101
#: First bit and width of the three segments of a fingerprint; the last is filled up with zeros.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: (segment looked up with errors, segment compared whole).
TABLES = ((0, 2), (1, 0), (2, 1))
#: Shingles are counted in so many buckets (as a power of two), to order them by their rarity.
SKETCH_BITS = 20
#: Bits of a text's odd sketch.
ODD_BITS = 1024
#: Rows whose texts a Python worker holds as strings at a time.
CHUNK_ROWS = 200


@cache
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the 23 single bits; for each remainder, the error pattern of weight 3 or less and the five (or no)
    patterns of weight 4."""
    bits = np.zeros(23, dtype=np.int64)
    r = 1
    for i in range(23):
        bits[i] = r
        r <<= 1
        if r >> 11 & 1:
            r ^= GENERATOR
    near = np.zeros(2048, dtype=np.int64)
    far: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(5):
        for chosen in combinations(range(23), weight):
            pattern, rest = sum(1 << i for i in chosen), 0
            for i in chosen:
                rest ^= int(bits[i])
            if weight < 4:
                near[rest] = pattern
            else:
                far[rest].append(pattern)
    width = max(map(len, far))
    return bits, near, np.array([f + [-1] * (width - len(f)) for f in far], dtype=np.int64)


def remainder(words: np.ndarray) -> np.ndarray:
    bits, _, _ = _golay()
    out = np.zeros(len(words), dtype=np.int64)
    for i in range(23):
        out ^= np.where(words >> i & 1, bits[i], 0)
    return out


def codeword_index(words: np.ndarray) -> np.ndarray:
    """The 12 leading bits of the codeword within 3 bits of each 23-bit word."""
    _, near, _ = _golay()
    return (words ^ near[remainder(words)]) >> 11


def near_indices(words: np.ndarray) -> np.ndarray:
    """(n, 6): the indices of all codewords within 4 bits, -1 where there are fewer. A word one bit away decodes to one of them."""
    _, _, far = _golay()
    more = far[remainder(words)]
    more = np.where(more < 0, -1, (words[:, None] ^ np.maximum(more, 0)) >> 11)
    return np.concatenate([codeword_index(words)[:, None], more], axis=1)


def _segments(fingerprints: np.ndarray) -> list[np.ndarray]:
    u = fingerprints.astype(np.int64).view(np.uint64)
    return [((u >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]


def golay_keys(prints: DataFrame, column: str, probe: bool, carry: Sequence[str] = ()) -> DataFrame:
    """(key, ``column``, carried columns): three keys a fingerprint for the index, up to eighteen for the probe.

    Two fingerprints that differ in two bits or fewer have one segment of three with at most one error beside another
    with none, in one of the three turns of TABLES; so an index key of each equals a probe key of the other.
    """

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if part.empty:
                continue
            seg, rows, keys = _segments(part[column].to_numpy()), [], []
            for t, (loose, whole) in enumerate(TABLES):
                found = near_indices(seg[loose]) if probe else codeword_index(seg[loose])[:, None]
                row, col = np.nonzero(found >= 0)
                rows.append(row)
                keys.append(t << 40 | found[row, col] << 23 | seg[whole][row])
            out = part.iloc[np.concatenate(rows)].reset_index(drop=True)
            out.insert(0, "key", np.concatenate(keys))
            yield out

    kept = prints.select(column, *carry)
    schema = ", ".join(["key long", *(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)])
    return kept.mapInPandas(work, schema)


def bits_apart(a: str | Column, b: str | Column) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.bit_count(a.bitwiseXOR(b))


def shingles(text: str, size: int) -> list[bytes]:
    """Space-joined runs of ``size`` words of the text with A-Z lower-cased; fewer words: all of them as one; none: none."""
    w = text.encode().lower().split()
    if len(w) <= size:
        return [b" ".join(w)] if w else []
    return list(map(b" ".join, zip(*(w[i:] for i in range(size)), strict=False)))


def fingerprint(features: list[bytes], seed: int = 42) -> int:
    """Bit b is set if it is set in over half of the features' XXH64; signed; zero for no feature."""
    if not features:
        return 0
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(f, seed) for f in features), dtype=np.uint64, count=len(features))
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 65536):
        ones += np.unpackbits(h[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): a signed 64-bit SimHash of every row's whole text; a null text counts as empty."""
    need(docs, [id_col, text_col])

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"id": part["id"].array, "fp": [fingerprint(shingles(t, words), seed) for t in part["text"]]})

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInPandas(work, f"id {kind}, fp long").withColumnRenamed("id", id_col)


def simhash_links(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """(src, dst): pairs of different fingerprints of column fp that differ in at most ``max_bits`` <= 2 bits, src < dst."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the keys guarantee up to 2 bits")
    distinct = prints.select("fp").distinct()
    left = golay_keys(distinct, "fp", probe=True).withColumnRenamed("fp", "src")
    right = golay_keys(distinct, "fp", probe=False).withColumnRenamed("fp", "dst")
    pairs = left.join(right, "key").where((F.col("src") < F.col("dst")) & (bits_apart("src", "dst") <= max_bits))
    return pairs.select("src", "dst").distinct()


def simhash_classes(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 3,
    max_bits: int = 2,
    seed: int = 42,
) -> DataFrame:
    """(id, fp, fingerprint, component_id) for every row of ``docs``.

    Equal fingerprints are one node, so copies are never paired; different ones meet through Golay keys and are linked
    at ``max_bits`` differing bits or fewer. ``component_id`` is the smallest id of the class.

    A null or wordless text has fingerprint zero and is linked like any other. Null ids are never the smallest; a class
    without any id has a null component_id. Repeated rows stay. Other columns are not read. An empty table gives no rows.
    """
    prints = materialise(fingerprints(docs, id_col=id_col, text_col=text_col, words=words, seed=seed), "prints")
    nodes = prints.groupBy("fp").agg(F.min(id_col).alias("least"))
    parts = connected_components(simhash_links(nodes, max_bits))
    named = nodes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("class", F.coalesce("component", "fp"))
    named = materialise(named.select("fp", "class", "least"), "classes")
    least = named.groupBy("class").agg(F.min("least").alias("component_id"))
    of_fp = named.join(least, "class").select("fp", "component_id")
    return prints.join(of_fp, "fp").select(
        id_col, "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def word_prints(text: str, count: int) -> list[int]:
    """``count`` independent SimHashes of the set of a text's words, A-Z lower-cased; zeros without words."""
    words = list(set(text.encode().lower().split()))
    if not words:
        return [0] * count
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(w, 0) for w in words), dtype=np.uint64, count=len(words))
    out = []
    for k in range(count):
        x = h + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones = np.zeros(64, dtype=np.int64)
        for i in range(0, len(x), 65536):
            ones += np.unpackbits(x[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(x), bitorder="little").view(np.int64)[0]))
    return out


def resemblance(a: str, b: str, words: int) -> float:
    """Jaccard similarity of the sets of two texts' shingles; two texts without words are alike."""
    x, y = set(shingles(a, words)), set(shingles(b, words))
    return len(x & y) / len(x | y) if x or y else 1.0


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """The different shingles of :func:`shingles` as sorted 64-bit hashes, made of the hashes of their words; zero without words."""
    w = text.encode().lower().split()
    if not w:
        return np.zeros(1, dtype=np.uint64)
    if len(w) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), 1)], dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), dtype=np.uint64, count=len(w))
    x = np.zeros(len(w) - words + 1, dtype=np.uint64)
    for k in range(words):
        x = x * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(x)]
        x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return np.unique(x)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK_ROWS):
            yield batch.slice(at, CHUNK_ROWS)


def shingle_levels(texts: DataFrame, *, words: int = 5) -> np.ndarray:
    """For each of 2^SKETCH_BITS buckets of shingles (column text), a measure that grows with the number of texts that hold
    one of them."""
    chunks = 256

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        for part in _chunks(batches):
            for t in part["text"].to_pylist():
                np.add.at(held, _bucket(shingle_hashes(t, words)), np.uint32(1))
        own = [pa.array(range(chunks), pa.int32()), pa.array([x.tobytes() for x in np.split(held, chunks)], pa.binary())]
        yield pa.RecordBatch.from_arrays(own, ["k", "v"])

    def total(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        held = sum(np.frombuffer(v, dtype=np.uint32).astype(np.int64) for v in group["v"])
        return pd.DataFrame({"k": [key[0]], "v": [(256 * np.log2(1 + held)).astype(np.uint16).tobytes()]})

    found = texts.select("text").mapInArrow(count, "k int, v binary").groupBy("k").applyInPandas(total, "k int, v binary").collect()
    out = np.zeros((chunks, (1 << SKETCH_BITS) // chunks), dtype=np.uint16)
    for r in found:
        out[r["k"]] = np.frombuffer(r["v"], dtype=np.uint16)
    return out.reshape(-1)


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def lead(text: str, levels: np.ndarray, words: int, similarity: float) -> tuple[int, float, np.ndarray, np.ndarray]:
    """Number of a text's different shingles, their mean level, its leading ones by level and hash: as many as needed so
    that any text at ``similarity`` or more has one of them among its own leading ones; and the odd sketch of all."""
    h = shingle_hashes(text, words)
    own = levels[_bucket(h)]
    first = len(h) - math.ceil(similarity * len(h) - 1e-6) + 1
    return len(h), float(own.mean()), h[np.lexsort((h, own))[:first]].view(np.int64), odd_sketch(h)


def odd_sketch(hashes: np.ndarray) -> np.ndarray:
    """ODD_BITS bits as signed 64-bit numbers: each is set if an odd number of the hashes fall on it. Of two sets, no more bits
    differ than elements do."""
    odd = np.bincount((hashes & np.uint64(ODD_BITS - 1)).astype(np.int64), minlength=ODD_BITS) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def _leads(texts: list[str], levels: np.ndarray, words: int, similarity: float) -> dict[str, pa.Array]:
    n, common, *lists = zip(*(lead(t, levels, words, similarity) for t in texts), strict=True)
    arrays = []
    for each in lists:
        ends = np.concatenate([[0], np.cumsum([len(x) for x in each])])
        arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(each))))
    return {"n": pa.array(n, pa.int32()), "common": pa.array(common, pa.float64()), "lead": arrays[0], "sketch": arrays[1]}


def shingle_ranks(texts: DataFrame, *, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(node, n, common, lead, sketch) for ``texts`` (node, text), see :func:`lead`."""
    levels = texts.sparkSession.sparkContext.broadcast(shingle_levels(texts, words=words))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _chunks(batches):
            yield pa.RecordBatch.from_pydict({"node": part["node"], **_leads(part["text"].to_pylist(), levels.value, words, similarity)})

    return materialise(texts.select("node", "text").mapInArrow(work, "node long, n int, common double, lead array<long>, sketch array<long>"), "ranks")


def _led(ranks: DataFrame) -> DataFrame:
    """A row for each leading shingle sh, with its place i."""
    own = [c for c in ranks.columns if c in ("node", "c", "n", "common")]
    return ranks.select(*own, F.posexplode("lead").alias("i", "sh"))


def _open(led: DataFrame) -> DataFrame:
    """Leading shingles that texts of different classes c have."""
    ends = led.groupBy("sh").agg(F.min("c").alias("low"), F.max("c").alias("high")).where(F.col("low") < F.col("high"))
    return led.join(ends, "sh", "left_semi")


def _least_common(na: Column, nb: Column, similarity: float) -> Column:
    return F.ceil(similarity / (1 + similarity) * (na + nb) - 1e-6)


def _within_reach(na: str, ia: str, nb: str, ib: str, similarity: float) -> Column:
    """Whether places ia and ib of two texts can be those of the first shingle they share if they are similar."""
    s = _least_common(F.col(na), F.col(nb), similarity)
    return (F.col(ia) + s <= F.col(na)) & (F.col(ib) + s <= F.col(nb))


def _central(opened: DataFrame, similarity: float) -> DataFrame:
    hubs = opened.groupBy("sh").agg(F.min(F.struct((-F.col("common")).alias("x"), "node", "c", "n", "i")).alias("hub"))
    met = opened.join(hubs, "sh").where((F.col("c") != F.col("hub.c")) & _within_reach("n", "i", "hub.n", "hub.i", similarity))
    return met.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()


def _rare(opened: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    parts = range(ODD_BITS // 64)
    wide = opened.join(sketches.select("node", *[F.get("sketch", F.lit(k)).alias(f"s{k}") for k in parts]), "node")
    held = ("node", "c", "n", "i", *(f"s{k}" for k in parts))
    small, large = (wide.select("sh", *(F.col(c).alias(c + x) for c in held)) for x in "ab")
    small = small.where(F.col("ia") + _least_common(F.col("na"), F.col("na"), similarity) <= F.col("na"))
    ordered = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("nodea") < F.col("nodeb")))
    # sets of m and n elements at a similarity t differ in (1 - t) / (1 + t) * (m + n) at most, and their sketches in no more bits
    differ = reduce(Column.__add__, [bits_apart(f"s{k}a", f"s{k}b") for k in parts])
    alike = differ <= F.floor((1 - similarity) / (1 + similarity) * (F.col("na") + F.col("nb")) + 1e-6)
    left, right = small.alias("l"), large.alias("r")
    on = (F.col("l.sh") == F.col("r.sh")) & (F.col("ca") != F.col("cb")) & ordered & _within_reach("na", "ia", "nb", "ib", similarity) & alike
    meet = left.join(right, on)
    return meet.select(F.least("nodea", "nodeb").alias("a"), F.greatest("nodea", "nodeb").alias("b")).distinct()


def central_pairs(ranks: DataFrame, *, similarity: float = 0.8) -> DataFrame:
    """(a, b), a < b: pairs of :func:`rare_shingle_pairs` with that text which, of all with a leading shingle, has the commonest
    shingles. No more pairs than leading shingles."""
    return _central(_open(_led(ranks)), similarity)


def rare_shingle_pairs(ranks: DataFrame, *, similarity: float = 0.8) -> DataFrame:
    """(a, b), a < b: every pair of texts of ``ranks`` (with its class c) in different classes that can reach ``similarity``.

    A set of m shingles and one of n at a Jaccard similarity t share s = t / (1 + t) * (m + n) or more, so in any common
    order of shingles the first they share is among the first m - s + 1 of one and the first n - s + 1 of the other. The
    order is the rarest first, by counts of buckets: edits of a copy are rare, so copies that differ too much meet little. Pairs whose
    odd sketches differ in more bits than such sets in elements don't come out of the join: with up to some ODD_BITS shingles a
    text, few pairs under ``similarity`` are left, however many such texts there are.
    """
    return _rare(_open(_led(ranks)), ranks, similarity)


def near_copy_classes(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    similarity: float = 0.8,
    prints: int = 6,
    max_apart: float = 0.17,
) -> DataFrame:
    """(t1, t2, id, keep_id, keep1, keep2): the distinct texts (two hashes), their smallest id, and id and hashes of the
    text that stands for their class of near copies.

    Every pair of texts whose ``words``-word shingles have a Jaccard similarity of ``similarity`` or more ends in one class.
    Cheap links come first: fingerprints, ``prints`` independent SimHashes of a text's set of words, bring texts together by
    Golay keys, and texts that share a key are compared with one of them, that which meets most others by its keys; there
    fingerprints that differ in more than ``max_apart`` of all bits are left to what follows. All distinct texts, whether they
    share a key or not, then meet by their leading shingles: those of different classes are compared by :func:`central_pairs`,
    which joins most of a large group, and then by :func:`rare_shingle_pairs`, which finds all others that can be similar
    enough. Every link is verified by its similarity.

    Nulls count as empty texts; texts without words are copies of each other. Null ids come last when a class's smallest id
    stands for it.
    """
    need(docs, [id_col, text_col])
    text = F.coalesce(F.col(text_col), F.lit(""))
    t1, t2 = F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2")

    rows = docs.select(F.col(id_col).cast("long").alias("id"), t1, t2, text.alias("text"))
    levels = docs.sparkSession.sparkContext.broadcast(shingle_levels(rows, words=words))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _chunks(batches):
            held = part["text"].to_pylist()
            fps = pa.array([word_prints(t, prints) for t in held], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict({c: part[c] for c in ("id", "t1", "t2")} | {"fps": fps} | _leads(held, levels.value, words, similarity))

    hashed = rows.mapInArrow(work, "id long, t1 long, t2 long, fps array<long>, n int, common double, lead array<long>, sketch array<long>")
    nodes = hashed.groupBy("t1", "t2").agg(F.min("id").alias("id"), *(F.first(c).alias(c) for c in ("fps", "n", "common", "lead", "sketch")))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    each = nodes.select("node", F.posexplode("fps").alias("s", "fp"))
    turned = F.col("key") + F.shiftleft(F.col("s").cast("long"), 44)
    index = golay_keys(each, "fp", False, ["node", "s"]).select(turned.alias("key"), F.col("node").alias("b"), F.col("fp").alias("fb"))
    probe = golay_keys(each, "fp", True, ["node", "s"]).select(turned.alias("key"), F.col("node").alias("a"), F.col("fp").alias("fa"))
    index = materialise(index, "index")
    # one print may differ more than all together
    close = (F.col("a") != F.col("b")) & (bits_apart("fa", "fb") <= 1.5 * max_apart * 64)
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    sizes = index.groupBy("key").agg(F.count("*").alias("n"))
    weights = index.join(sizes.where(F.col("n") > 1), "key").groupBy("b").agg(F.sum("n").alias("w"))
    weighed = index.join(weights, "b", "left").withColumn("w", -F.coalesce("w", F.lit(0)))
    hubs = weighed.groupBy("key").agg(F.min(F.struct("w", "b", "fb")).alias("hub")).select("key", "hub.b", "hub.fb")
    first = probe.join(hubs, "key").where(close).select(*pair).distinct()

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _chunks(batches):
            ok = [resemblance(x.as_py(), y.as_py(), words) >= similarity for x, y in zip(part["ta"], part["tb"], strict=True)]
            yield part.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    def key_of(c: str) -> list[Column]:
        return [F.coalesce(F.col(c), F.lit(0)).alias("k0"), F.col(c).isNull().alias("k1")]

    def texts_of(used: DataFrame) -> DataFrame:
        # the id is part of the key, so that copies of one text go to different tasks and all but one meet nothing
        keys = nodes.join(used, "node").select("node", "t1", "t2", *key_of("id"))
        texts = rows.select("t1", "t2", "text", *key_of("id")).join(keys, ["t1", "t2", "k0", "k1"])
        return texts.groupBy("node").agg(F.first("text").alias("text"))

    def likely(pairs: DataFrame) -> DataFrame:
        fps = nodes.select("node", "fps")
        pairs = pairs.join(fps.select(F.col("node").alias("a"), F.col("fps").alias("fa")), "a")
        pairs = pairs.join(fps.select(F.col("node").alias("b"), F.col("fps").alias("fb")), "b")
        apart = F.aggregate(F.zip_with("fa", "fb", bits_apart), F.lit(0), lambda x, y: x + y)
        return pairs.where(apart <= max_apart * 64 * prints).select("a", "b")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = materialise(pairs, "pairs")
        used = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        texts = materialise(texts_of(used), "texts")
        both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
        both = both.join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b")
        return materialise(both.select("a", "b", "ta", "tb").mapInArrow(alike, "a long, b long"), "alike")

    def joined(named: DataFrame, links: DataFrame) -> DataFrame:
        """``named`` (node, c) with the classes that the links join made one; only pairs of classes are walked."""
        ends = links.join(named.select(F.col("node").alias("a"), F.col("c").alias("ca")), "a").join(named.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b")
        parts = connected_components(ends.where(F.col("ca") != F.col("cb")), "ca", "cb").withColumnRenamed("node", "c")
        return materialise(named.join(parts, "c", "left").select("node", F.coalesce("component", "c").alias("c")), "named")

    named = joined(nodes.select("node", F.col("node").alias("c")), verified(likely(first)))
    led = _led(nodes.select("node", "n", "common", "lead"))
    met = led.groupBy("sh").agg(F.count("*").alias("m")).where(F.col("m") > 1)
    shared = materialise(led.join(met, "sh", "left_semi"), "shared")
    central = materialise(_central(_open(shared.join(named, "node")), similarity), "central")
    named = joined(named, verified(central))
    rare = _rare(_open(shared.join(named, "node")), nodes, similarity)
    named = joined(named, verified(rare.join(central, ["a", "b"], "left_anti")))
    named = nodes.select("node", "t1", "t2", "id").join(named, "node")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", F.col("t1"), F.col("t2")))
    kept = named.groupBy("c").agg(best.alias("k")).select("c", F.col("k.id").alias("keep_id"), F.col("k.t1").alias("keep1"), F.col("k.t2").alias("keep2"))
    return named.join(kept, "c").select("t1", "t2", "id", "keep_id", "keep1", "keep2")


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each class of :func:`near_copy_classes`: that of the smallest id. Of rows that repeat its id
    and text, one stays. Own columns t1 and t2 are kept under their names."""
    classes = near_copy_classes(docs, id_col=id_col, text_col=text_col, **how)
    chosen = classes.select(F.col("keep1").alias("__1"), F.col("keep2").alias("__2"), F.col("keep_id").alias("__id")).distinct()
    text = F.coalesce(F.col(text_col), F.lit(""))
    held = F.struct(F.coalesce(F.col("__id"), F.lit(0)).alias("id"), F.col("__id").isNull().alias("none"))
    mine = docs.withColumns({"__1": F.xxhash64(text), "__2": F.xxhash64(F.lit(7), text), "__id": F.col(id_col).cast("long")})
    found = mine.withColumn("__k", held).join(chosen.select("__1", "__2", held.alias("__k")), ["__1", "__2", "__k"])
    return found.dropDuplicates(["__1", "__2", "__k"]).select(*docs.columns)
