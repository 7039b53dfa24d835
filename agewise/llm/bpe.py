"""Byte-level BPE by DuckDB recursive queries inside Spark tasks."""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from agewise.llm.common import need

#: Words that each Python worker keeps with their ids and bytes; with more, it begins anew.
CACHE_WORDS = 400_000
#: Characters of texts whose words are looked up together, and words put together at once.
CHUNK_CHARS = 4_000_000
TAKE_WORDS = 100_000
#: Bytes of words for one recursive query.
QUERY_BYTES = 400_000

#: A word is a list of ids, unnested to token positions at every step. All its pairs of the least rank are contracted, from
#: the left, where none of the pairs that arise can rank before them (settled); else the leftmost alone. The key keeps a
#: word's newest ids; a step works on the words that the last one changed.
MERGE = """
CREATE OR REPLACE TABLE coded AS
WITH RECURSIVE words(w, ids) USING KEY (w) AS (
    SELECT w, ids FROM start
  UNION (
    WITH met AS MATERIALIZED (
        SELECT w, pos, merged, settled, p.l = p.r AS twin
        FROM (
            SELECT w, unnest(ids[:-2]) AS l, unnest(ids[2:]) AS r, generate_subscripts(ids[2:], 1) AS pos
            FROM words WHERE len(ids) > 1
        ) p JOIN merges m ON m.l = p.l AND m.r = p.r
    ), least AS MATERIALIZED (
        SELECT w, pos, merged, settled, twin FROM met JOIN (SELECT w, min(merged) AS merged FROM met GROUP BY w) USING (w, merged)
    ), apart AS (
        SELECT w, pos, merged, settled FROM least WHERE NOT twin
      UNION ALL  -- of a row of equal tokens, every other pair
        SELECT w, pos, merged, settled
        FROM (SELECT *, pos - row_number() OVER (PARTITION BY w ORDER BY pos) AS island FROM least WHERE twin)
        QUALIFY row_number() OVER (PARTITION BY w, island ORDER BY pos) % 2 = 1
    ), spots AS MATERIALIZED (
        SELECT w, merged, min(pos) AS pos, CASE WHEN bool_and(settled) AND count(*) > 1 THEN list(pos) END AS more
        FROM apart GROUP BY w, merged
    )
    SELECT w, ids[:pos - 1] || [merged] || ids[pos + 2:] FROM words JOIN spots USING (w) WHERE more IS NULL
  UNION ALL
    SELECT w, list(coalesce(s.merged, t.id) ORDER BY pos)
    FROM (
        SELECT w, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos
        FROM words SEMI JOIN (SELECT w FROM spots WHERE more IS NOT NULL) USING (w)
    ) t
    LEFT JOIN (SELECT w, merged, unnest(more) AS pos FROM spots) s USING (w, pos)
    ANTI JOIN (SELECT w, unnest(more) + 1 AS pos FROM spots) gone USING (w, pos)
    GROUP BY w
  )
)
SELECT w, ids FROM words
"""

DECODE = """
SELECT w, ids, parts FROM coded JOIN (
    SELECT w, list(bytes ORDER BY pos) AS parts
    FROM (SELECT w, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM coded) JOIN vocab USING (id)
    GROUP BY w
) USING (w) ORDER BY w
"""


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _merges(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(left, right, merged) of all pairs of tokens that make a token, and the tokens that one of lower rank begins or ends
    with: a pair with one of these may rank before it."""
    pairs, unsettled = array("i"), set()
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            a, b = ranks.get(token[:k], -1), ranks.get(token[k:], -1)
            if a >= 0 and b >= 0:
                pairs.extend((a, b, rank))
            unsettled.update(x for x in (a, b) if x > rank)
    return np.array(pairs, dtype=np.int32).reshape(-1, 3).T, np.array(sorted(unsettled), dtype=np.int32)


class Encoder:
    """Ids and decoded bytes of words, by one in-memory DuckDB."""

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.split = regex.compile(pattern)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.pairs, self.unsettled = _merges(self.ranks)
        self.forget()
        self.db: duckdb.DuckDBPyConnection | None = None

    def open(self) -> None:
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self.db.execute("SET preserve_insertion_order = false")
        left, right, merged = self.pairs
        self._table("merges", pa.table({"l": left, "r": right, "merged": merged, "settled": ~np.isin(merged, self.unsettled)}))
        tokens = list(self.ranks)
        self._table("vocab", pa.table({"id": pa.array([self.ranks[t] for t in tokens], pa.int32()), "bytes": pa.array(tokens, pa.binary())}))

    def close(self) -> None:
        """Between tasks a worker keeps its words, not the database's memory."""
        if self.db:
            self.db.close()
            self.db = None
        pa.default_memory_pool().release_unused()

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("__rows", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM __rows")
        self.db.unregister("__rows")

    def forget(self) -> None:
        self.known: defaultdict[str, int] = defaultdict(count().__next__)
        self.ids, self.bytes = _Lists(np.uint32), _Lists(np.uint8)

    def places(self, text: str) -> np.ndarray:
        """The places of a text's words among the known ones; new words get the next places and are to be learnt."""
        words = self.split.findall(text)
        return np.fromiter(map(self.known.__getitem__, words), dtype=np.int32, count=len(words))

    def learn(self) -> None:
        """Encode and decode the words that were met since."""
        new = list(islice(self.known, self.ids.n, None))
        ends = np.cumsum([len(word.encode()) for word in new])
        k = 0
        while k < len(new):
            n = max(1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + QUERY_BYTES, side="right")) - k)
            ids, decoded = self.encode(new[k : k + n])
            self.ids.add(*ids)
            self.bytes.add(*decoded)
            k += n

    def encode(self, words: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """Ids and decoded bytes of the words, each as (values, where the words end); a word that is a token itself is that token."""
        if not self.db:
            self.open()
        raw = [word.encode() for word in words]
        whole = [(w, r) for w, r in enumerate(map(self.ranks.get, raw)) if r is not None]
        for w, _ in whole:
            raw[w] = b"\0"
        flat = self.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        ends = np.cumsum([0, *map(len, raw)]).astype(np.int32)
        for w, r in whole:
            flat[ends[w]] = r
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
        self._table("start", pa.table({"w": np.arange(len(words), dtype=np.int32), "ids": lists}))
        self.db.execute(MERGE)
        return self.decode()

    def decode(self) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """The ids of the table ``coded`` and their tokens' bytes in order."""
        found = self.db.sql(DECODE).to_arrow_table()
        ids, parts = (found[c].combine_chunks() for c in ("ids", "parts"))
        tokens = parts.values.to_numpy(zero_copy_only=False)
        ends = np.cumsum([0, *map(len, tokens)])
        data = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        return (ids.values.to_numpy().astype(np.uint32), ids.offsets.to_numpy()[1:]), (data, ends[parts.offsets.to_numpy()[1:]])


class _Lists:
    """Lists of numbers, one after another."""

    def __init__(self, kind: type):
        self.flat, self.ends = np.zeros(1 << 16, dtype=kind), np.zeros(1 << 16, dtype=np.int64)
        self.n = 0

    def add(self, values: np.ndarray, ends: np.ndarray) -> None:
        at = int(self.ends[self.n])
        if (most := at + len(values)) > len(self.flat):
            self.flat = np.concatenate([self.flat[:at], np.zeros(most, dtype=self.flat.dtype)])
        if self.n + len(ends) >= len(self.ends):
            self.ends = np.concatenate([self.ends[: self.n + 1], np.zeros(self.n + len(ends), dtype=np.int64)])
        self.flat[at:most] = values
        self.ends[self.n + 1 : self.n + 1 + len(ends)] = at + ends
        self.n += len(ends)

    def take(self, which: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        """The lists ``which``, joined between each two of ``bounds``."""
        first = self.ends[which]
        stops = np.cumsum(self.ends[which + 1] - first)
        at = np.arange(stops[-1] if len(stops) else 0)
        if len(stops):
            sizes = np.diff(stops, prepend=0)
            at += np.repeat(first - (stops - sizes), sizes)
        cuts = np.concatenate([[0], stops])[bounds]
        flat = self.flat[at]
        return [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """This worker's encoder; workers live on over tasks."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def encode_decode(
    docs: DataFrame,
    path: str,
    pattern: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) for every row of ``docs``; with ``with_ids`` also ids and text decoded.

    ``path`` is a rank file that every executor can read, ``pattern`` the expression whose matches are encoded
    separately. Each word that a worker has not met lately becomes token-position rows; a recursive query joins
    neighbours with the table of mergeable pairs and contracts the leftmost pair of least rank of every word, until no
    word has one; a second query decodes the ids found by ordered aggregation of the tokens' bytes. Word results are
    cached per worker with a bound on memory only; results don't depend on it. A word of n bytes takes up to n steps over
    at most n rows; one of hundreds of thousands of random letters takes many minutes.

    A null text counts as empty: no tokens, hashes of empty strings. Ids may be null or repeat; other columns are not
    read. An empty table gives no rows.
    """
    need(docs, [id_col, text_col])
    extra = ", ids array<long>, decoded string" if with_ids else ""

    kind = docs.schema[id_col].dataType
    wanted = pa.schema(
        [("id", to_arrow_type(kind)), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
        + ([("ids", pa.list_(pa.int64())), ("decoded", pa.string())] if with_ids else [])
    )

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path, pattern)
        for part in parts:
            sizes = pc.fill_null(pc.binary_length(part["text"]), 0).to_numpy(zero_copy_only=False)
            k = 0
            while k < len(part):
                # as many texts as make a chunk, one at least; only these become Python strings
                n = max(1, int(np.searchsorted(np.cumsum(sizes[k : k + 16384]), CHUNK_CHARS, side="right")))
                if len(tool.known) > CACHE_WORDS:
                    tool.forget()
                places = [tool.places(t or "") for t in part["text"].slice(k, n).to_pylist()]
                tool.learn()
                ends = np.cumsum([len(w) for w in places])
                i = 0
                while i < n:
                    j = i + max(1, int(np.searchsorted(ends[i:] - (ends[i - 1] if i else 0), TAKE_WORDS, side="right")))
                    which, bounds = np.concatenate(places[i:j]), np.cumsum([0, *map(len, places[i:j])])
                    ids, decoded = tool.ids.take(which, bounds), tool.bytes.take(which, bounds)
                    out = [
                        part["id"].slice(k + i, j - i),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x.astype("<u4", copy=False)).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string()),
                    ]
                    if with_ids:
                        out.append(pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())))
                        out.append(pa.array([x.tobytes().decode("utf-8", "replace") for x in decoded], pa.string()))
                    yield pa.RecordBatch.from_arrays(out, schema=wanted)
                    i = j
                k += n
        tool.close()

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = rows.mapInArrow(work, f"id {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string{extra}")
    return found.withColumnRenamed("id", id_col)
