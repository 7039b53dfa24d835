"""Toxicity by compression distance: two zstandard dictionaries, window lengths and calibrated weights."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agewise.llm.common import need

#: Punctuation and symbols separate words here.
_MARKS = b"!\"#$%&()*+,./:;<=>?@[\\]^_`{|}~"
_TO_SPACE = bytes.maketrans(_MARKS, b" " * len(_MARKS))
#: zstandard codes a match in some three bytes and leaves inputs of a few bytes as they are. So that a match of a few
#: letters counts, each byte is written as several different ones, in windows and dictionaries alike.
WIDE = 3
#: Windows whose lengths each Python worker keeps; when full, the cache is emptied.
CACHE_WINDOWS = 300_000


def windows(text: str, size: int) -> list[bytes]:
    """Runs of ``size`` lower-cased words, over the whole text."""
    w = text.encode().lower().translate(_TO_SPACE).split()
    return w if size == 1 else [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1) if w else 0)]


def widened(raw: bytes) -> bytes:
    one = np.frombuffer(raw, dtype=np.uint8)
    return np.stack([one + np.uint8(85 * k) for k in range(WIDE)], axis=1).tobytes()


@dataclass
class Compressors:
    """Dictionaries of ordinary and toxic text, and the logistic weights of a document's window statistics."""

    ordinary: bytes
    toxic: bytes
    size: int = 1
    margin: int = 4
    weights: tuple[float, ...] = ()

    def _tools(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        how = zstandard.ZstdCompressionParameters.from_level(19, write_content_size=0, write_dict_id=0, write_checksum=0, min_match=6)
        made = []
        for content in (self.ordinary, self.toxic):
            words = zstandard.ZstdCompressionDict(widened(content), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(compression_params=how)
            made.append(zstandard.ZstdCompressor(dict_data=words, compression_params=how))
        return made[0], made[1]

    def statistics(self, texts: list[str], gains: dict[bytes, int]) -> np.ndarray:
        """For each text: the most bytes that the toxic dictionary saves on a window, and how many windows, and what
        share of them, it shortens by ``margin`` bytes. ``gains`` is a cache over windows."""
        ordinary, toxic = self._tools()
        out = np.zeros((len(texts), 3))
        for k, text in enumerate(texts):
            counts = Counter(windows(text, self.size))
            if len(gains) > CACHE_WINDOWS:
                gains.clear()
            most, hits = 0, 0
            for w, n in counts.items():
                g = gains.get(w)
                if g is None:
                    framed = widened(b" " + w + b" ")
                    g = gains[w] = len(ordinary.compress(framed)) - len(toxic.compress(framed))
                if g >= self.margin:
                    hits += n
                if g > most:
                    most = g
            out[k] = most, math.log1p(hits), math.log1p(100 * hits / max(1, counts.total()))
        return out

    def score(self, stats: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + stats @ np.array(self.weights[1:]), -500, 500)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Newton steps for the weights (intercept first), prior odds as in ``y``."""
    a, w = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    penalty = np.diag([1e-3] + [ridge] * x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p) + 1e-9)[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def beginnings(window: bytes) -> list[bytes]:
    """The segments of a window that begin with the space before it, of 5 to 16 bytes, the space after it included."""
    whole = b" " + window + b" "
    return [whole[:n] for n in range(5, min(len(whole), 16) + 1)]


def train(
    texts: list[str],
    labels: list[int],
    *,
    size: int = 1,
    least: int = 3,
    base_windows: int = 100,
    odds: float = 1.5,
    toxic_share: float | None = None,
) -> Compressors:
    """Dictionaries from labelled texts, near copies of one label counted once, and weights calibrated on the same texts.

    A text of one label that is a near copy of one of the other counts: what sets the two apart is what is to be learnt.

    Both dictionaries begin with the ``base_windows`` commonest windows of ordinary text of each length, so that windows
    without toxic content compress alike. The toxic one goes on with the beginnings of windows that ``least`` toxic texts
    hold and whose log odds against ordinary text, less two standard errors, reach ``odds``, so words of a rare language
    count as those of a common one do; one that a longer one replaces almost everywhere is left out. ``toxic_share`` moves the
    intercept from the sample's share of toxic texts to the corpus'.
    """
    seen: set[tuple[int, int, int]] = set()
    found: dict[int, list[set[bytes]]] = {0: [], 1: []}
    for text, y in zip(texts, labels, strict=True):
        held = set(windows(text, size))
        longer = set(windows(text, size + 3))
        marks = {(y, k, min((xxhash.xxh64_intdigest(w, k) for w in longer), default=0)) for k in range(3)}
        if not marks & seen:
            seen |= marks
            found[y].append(held)
    toxic = Counter(b for held in found[1] for b in {b for w in held for b in beginnings(w)})
    toxic = {b: k for b, k in toxic.items() if k >= least}
    plain = Counter(b for held in found[0] for b in {b for w in held for b in beginnings(w)} & toxic.keys())
    lift = {}
    for b, k in toxic.items():
        ratio = math.log((k + 0.5) / (len(found[1]) + 1)) - math.log((plain[b] + 0.5) / (len(found[0]) + 1))
        lift[b] = ratio - 2 * math.sqrt(1 / (k + 0.5) + 1 / (plain[b] + 0.5))
    replaced = {b[:-1] for b, k in toxic.items() if k >= 0.8 * toxic.get(b[:-1], math.inf)}
    own = sorted((b for b, v in lift.items() if v >= odds and b not in replaced), key=lambda b: (lift[b], b))
    plain_windows = Counter(w for held in found[0] for w in held)
    lengths: dict[int, int] = Counter()
    common = []
    for w, _ in plain_windows.most_common():
        lengths[len(w)] += 1
        if lengths[len(w)] <= base_windows:
            common.append(w)
    base = b" " + b" ".join(common[::-1]) + b" "
    made = Compressors(base, base + b"".join(own), size)
    y = np.array(labels, dtype=float)
    if 0 < y.sum() < len(y):
        weights = list(_logistic(made.statistics(texts, {}), y))
        if toxic_share is not None and 0 < toxic_share < 1:
            weights[0] += math.log(toxic_share / (1 - toxic_share)) - math.log(y.mean() / (1 - y.mean()))
    else:
        weights = [20.0 if len(y) and y.all() else -20.0, 0, 0, 0]
    made.weights = tuple(weights)
    return made


def fit_toxicity(labelled: DataFrame, *, text_col: str = "text", label_col: str = "label", id_col: str = "doc_id", per_class: int = 2000, size: int = 1, toxic_share: float | None = None) -> Compressors:
    """Train on at most ``per_class`` rows of each label 0 and 1, those of the smallest hashes of their ids and texts.

    Rows of other labels or none are left out; a null text is learnt from as an empty one; of equal rows each counts towards
    ``per_class`` and a label's share, one towards the dictionaries. Without rows of both labels every score is the same.
    """
    rows = labelled.where(F.col(label_col).isin(0, 1)).select(
        F.col(text_col).alias("t"), F.col(label_col).cast("int").alias("y"), F.xxhash64(F.col(id_col), F.lit(5), F.col(text_col)).alias("h")
    )
    n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    sample = [r for y in (0, 1) for r in rows.where(F.col("y") == y).orderBy("h").limit(per_class).collect()]
    total = sum(n.values())
    if toxic_share is None and total:
        toxic_share = n.get(1, 0) / total
    return train([r["t"] or "" for r in sample], [r["y"] for r in sample], size=size, toxic_share=toxic_share)


_gains: dict[bytes, dict[bytes, int]] = {}


def score_toxicity(docs: DataFrame, model: Compressors, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with its own columns and a score from 0 to 1 (a column of that name is replaced).

    Null and empty texts have no windows and get the score of a text without toxic windows. Repeated rows stay. An
    empty table gives no rows.
    """
    need(docs, [text_col])
    rows = docs.select(*[c for c in docs.columns if c.lower() != score_col.lower()])
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"`{score_col}` double"])

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gains = _gains.setdefault(model.toxic, {})  # workers live on over tasks
        for part in parts:
            yield part.assign(**{score_col: model.score(model.statistics([t or "" for t in part[text_col]], gains))})

    return rows.mapInPandas(work, schema)
