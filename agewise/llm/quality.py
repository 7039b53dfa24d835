"""Quality classifier: a regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agewise.llm.common import need

FEATURES = (
    "words", "word_length", "unique_words", "line_words", "upper", "digits", "symbols", "stops", "commas", "exclaims",
    "other_marks", "non_ascii", "long_words", "single_words",
)


def _class(chars: bytes) -> np.ndarray:
    mask = np.zeros(256)
    mask[list(chars)] = 1
    return mask


_CLASSES = np.array(
    [
        _class(bytes(range(65, 91))),
        _class(b"0123456789"),
        _class(b"#*$%&|<>"),
        _class(b".?"),
        _class(b",;:"),
        _class(b"!"),
        _class(b"\"'()[]{}=+/\\_-~^@`"),
        _class(bytes(range(128, 256))),
        _class(b" \t\n\x0b\x0c\r"),
    ]
)


def statistics(text: str) -> np.ndarray:
    """The transformed statistics of one whole text: logs of sizes, log odds of shares; defined for empty texts too."""
    raw = text.encode()
    upper, digits, symbols, stops, commas, exclaims, marks, high, white = _CLASSES @ np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    words = raw.split()
    n, distinct, lines = len(words), set(words), raw.count(b"\n") + 1
    chars = len(raw) - white

    def odds(k: float, of: float) -> float:
        return np.log((k + 0.5) / (max(of - k, 0) + 0.5)) - np.log(1 / (of + 1))

    return np.array(
        [
            np.log1p(n),
            np.log1p(chars / max(n, 1)),
            np.log((len(distinct) + 1) / (n + 1)),
            np.log1p(n / lines),
            *(odds(x, chars) for x in (upper, digits, symbols, stops, commas, exclaims, marks)),
            np.log1p(100 * high / max(chars, 1)),
            np.log1p(100 * sum(len(w) > 20 for w in distinct) / max(len(distinct), 1)),
            np.log1p(100 * sum(len(w) == 1 for w in distinct) / max(len(distinct), 1)),
        ]
    )


@dataclass(frozen=True)
class Discriminant:
    """Means, inverted Cholesky factors and log determinants of the two classes; log prior odds."""

    means: np.ndarray
    whiten: np.ndarray
    logdets: np.ndarray
    log_odds: float
    softness: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Of rows of statistics: the softened posterior share of class 1."""
        dist = [(((x - m) @ w.T) ** 2).sum(axis=1) for m, w in zip(self.means, self.whiten, strict=True)]
        gap = (dist[0] - dist[1] + self.logdets[0] - self.logdets[1]) / 2 + self.log_odds
        return 1 / (1 + np.exp(-np.clip(gap / self.softness, -500, 500)))


#: Texts that a Python worker holds as strings at a time.
CHUNK_ROWS = 200


def statistics_of(texts: pa.Array) -> np.ndarray:
    """Rows of statistics of an array of texts, of which only some at a time become strings; null texts count as empty."""
    rows = [statistics(t or "") for k in range(0, len(texts), CHUNK_ROWS) for t in texts.slice(k, CHUNK_ROWS).to_pylist()]
    return np.stack(rows) if rows else np.zeros((0, len(FEATURES)))


def _with_statistics(docs: DataFrame, text_col: str, keep: dict[str, Column]) -> DataFrame:
    """``keep`` and the array x of each row; null texts count as empty."""
    rows = docs.select(*(c.alias(k) for k, c in keep.items()), F.col(text_col).alias("__text"))
    names = list(keep)

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = statistics_of(part["__text"])
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(part[k] for k in names), lists], [*names, "x"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text")
    return rows.mapInArrow(work, f"{kept}, x array<double>")


def document_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x) of every row: narrow rows, that can meet labels without a shuffle of texts."""
    need(docs, [id_col, text_col])
    return _with_statistics(docs, text_col, {id_col: F.col(id_col)})


def fit_discriminant(
    labelled: DataFrame, *, text_col: str = "text", label_col: str = "label", stat_col: str | None = None, shrink: float = 0.1, softness: float = 4.0
) -> Discriminant:
    """Fit on every row with label 0 or 1, from its text or from its statistics in ``stat_col``. Spark sums the moments; the
    driver gets one row for each class and cell."""
    k = len(FEATURES)
    rows, y = labelled.where(F.col(label_col).isin(0, 1)), F.col(label_col).cast("int")
    rows = rows.select(y.alias("y"), F.col(stat_col).alias("x")) if stat_col else _with_statistics(rows, text_col, {"y": y})

    def moments(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, 1 + k + k * k))
        for part in parts:
            for y, group in part.groupby("y"):
                x = np.stack(group["x"].to_list())
                total[y] += np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
        size = total.shape[1]
        yield pd.DataFrame({"y": np.repeat([0, 1], size), "cell": np.tile(np.arange(size), 2), "v": total.ravel()})

    sums = np.zeros((2, 1 + k + k * k))
    for y, cell, v in rows.mapInPandas(moments, "y int, cell int, v double").groupBy("y", "cell").agg(F.sum("v")).collect():
        sums[y, cell] = v
    n = np.maximum(sums[:, 0], 1e-9)
    means = sums[:, 1 : 1 + k] / n[:, None]
    within = sums[:, 1 + k :].reshape(2, k, k) - n[:, None, None] * means[:, :, None] * means[:, None, :]
    covers = within / np.maximum(n - 1, 1)[:, None, None]
    pooled = np.diag(np.diag(within.sum(axis=0)) / max(n.sum() - 2, 1) + 1e-3)
    whiten, logdets = [], []
    for c in covers:
        low = np.linalg.cholesky((1 - shrink) * c + shrink * pooled)
        whiten.append(np.linalg.inv(low))
        logdets.append(2 * np.log(np.diag(low)).sum())
    odds = float(np.log((sums[1, 0] + 1) / (sums[0, 0] + 1)))
    return Discriminant(means, np.array(whiten), np.array(logdets), odds, softness)


def score_quality(docs: DataFrame, model: Discriminant, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with its own columns and a score from 0 to 1 (a column of that name is replaced).

    Null and empty texts are scored from their statistics like any other. Repeated rows stay. An empty table gives no rows.
    """
    need(docs, [text_col])
    own = [c for c in docs.columns if c.lower() != score_col.lower()]
    rows = docs.select(*own)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"`{score_col}` double"])

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            score = model.score(statistics_of(part[text_col]))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], [*own, score_col])

    return rows.mapInArrow(work, schema)


def score_statistics(stats: DataFrame, model: Discriminant, *, id_col: str = "doc_id", score_col: str = "score") -> DataFrame:
    """(id, score) from :func:`document_statistics`."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x = np.stack(part["x"].to_list()) if len(part) else np.zeros((0, len(FEATURES)))
            yield pd.DataFrame({id_col: part[id_col].array, score_col: model.score(x)})

    kind = stats.schema[id_col].dataType.simpleString()
    return stats.select(id_col, "x").mapInPandas(work, f"`{id_col}` {kind}, `{score_col}` double")
