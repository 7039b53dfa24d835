"""WARC records in seekable Zstandard bundles: independent frames, a footer seek table and a record index."""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agewise.llm.common import materialise, need

#: Fixed values of the seekable format: the magic numbers of its skippable frame and of its footer.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
#: A frame is closed at this many bytes of records, a bundle at this many bytes of frames.
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 32 << 20
EPOCH = datetime(2000, 1, 1, tzinfo=UTC)


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record of a payload of ``size`` bytes. A revisit has no block; its payload is the one it refers to."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {EPOCH:%Y-%m-%dT%H:%M:%SZ}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {size}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [
            f"WARC-Refers-To: <urn:page:{refers_to}>",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        ]
    block = b"" if revisit else payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers in lower case, block) of each record of uncompressed WARC data."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at {at}")
        head = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
        size = int(head["content-length"])
        yield at, head, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


class BundleWriter:
    """Frames of whole records, then a skippable frame with each frame's sizes and the footer."""

    def __init__(self, level: int = 6):
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.open = bytearray()
        self.index: list[tuple] = []
        self.bytes = 0

    def add(self, key: tuple, raw: bytes) -> None:
        if self.open and len(self.open) + len(raw) > FRAME_BYTES:
            self.close_frame()
        self.index.append((*key, len(self.frames), len(self.open), len(raw)))
        self.open += raw

    def close_frame(self) -> None:
        if self.open:
            frame = self.compress(bytes(self.open))
            self.frames.append(frame)
            self.sizes.append((len(frame), len(self.open)))
            self.bytes += len(frame)
            self.open = bytearray()

    def finish(self) -> bytes:
        self.close_frame()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, size) of each frame, from the footer of a bundle."""
    n, _, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    entries = struct.iter_unpack("<II", data[-9 - 8 * n : -9])
    out, at = [], 0
    for packed, size in entries:
        out.append((at, packed, size))
        at += packed
    return out


def read_record(uri: str, frame: int, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record by its place in the index; reads the footer and one frame."""
    where, path = fs.FileSystem.from_uri(uri)
    with where.open_input_file(path) as f:
        size = f.size()
        f.seek(size - 9)
        n = struct.unpack("<I", f.read(4))[0]
        f.seek(size - 9 - 8 * n)
        at, packed, _ = seek_table(f.read(8 * n + 9))[frame]
        f.seek(at)
        data = zstandard.ZstdDecompressor().decompress(f.read(packed))
    _, head, block = next(parse_records(data[offset : offset + length]))
    return head, block


def mark_revisits(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", min_bytes: int = 100) -> DataFrame:
    """(__digest, __first): the smallest id of each payload of at least ``min_bytes`` that more than one row has."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    sums = pages.select(id_col, F.sha2(payload, 256).alias("__digest"), F.octet_length(payload).alias("__size"))
    seen = sums.where(F.col("__size") >= min_bytes).groupBy("__digest").agg(F.min(id_col).alias("__first"), F.count("*").alias("__n"))
    return seen.where((F.col("__n") > 1) & F.col("__first").isNotNull()).select("__digest", "__first")


INDEX = "page_id long, payload_bytes long, bundle string, frame int, offset long, length long"


def write_bundles(
    pages: DataFrame,
    directory: str,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_bytes: int = 100,
) -> DataFrame:
    """Write a record of every row to bundles in ``directory`` and return the record index: (page_id, payload_bytes, bundle,
    frame, offset in the frame, length).

    ``directory`` is a URI that pyarrow's file systems can write to from every executor. Of the rows with equal payloads
    (the html in UTF-8; null: empty) of at least ``min_bytes`` bytes, the one with the smallest id is a response; the
    others are revisits of it. The rows that make a bundle are those of one task; each file is written under a name of its
    own attempt, and the index, itself written to the shared folder, names only files of attempts that succeeded.

    Rows that share the smallest id of a payload are all responses. A row with a null id is never referred to; if all rows
    of a payload have one, all are responses. An empty table writes no bundle. Other columns are not read.
    """
    need(pages, [id_col, url_col, html_col])
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    packed = "page_id long, url string, packed binary, size long, __digest string"

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = zstandard.ZstdCompressor(level=3)
        for part in parts:
            bodies = part.pop("payload")
            yield part.astype({"page_id": "Int64"}).assign(
                packed=[tool.compress(b) for b in bodies], size=[len(b) for b in bodies], __digest=[hashlib.sha256(b).hexdigest() for b in bodies]
            )

    # payloads travel compressed, dealt by digest at every size
    rows = rows.mapInPandas(pack, packed)
    firsts = mark_revisits(pages, id_col=id_col, html_col=html_col, min_bytes=min_bytes)
    # small payloads meet nothing, so they are spread by their page; a large one that very many pages share can be split
    met = F.when(F.col("size") >= min_bytes, F.col("__digest")).otherwise(F.concat(F.lit("-"), F.coalesce("page_id", F.lit(0)).cast("string")))
    rows = rows.withColumn("__met", met).join(firsts.withColumnRenamed("__digest", "__met").hint("shuffle_hash"), "__met", "left").withColumn(
        "revisit", F.col("__first").isNotNull() & ~F.col("__first").eqNullSafe(F.col("page_id"))
    )

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, folder = fs.FileSystem.from_uri(directory)
        where.create_dir(folder, recursive=True)
        bundle, undo = BundleWriter(), zstandard.ZstdDecompressor()

        def flush() -> pd.DataFrame:
            nonlocal bundle
            name = f"bundle-{uuid.uuid4().hex}.warc.zst"
            data = bundle.finish()
            with where.open_output_stream(f"{folder}/{name}", compression=None) as f:
                f.write(data)
            out = pd.DataFrame(
                [(None if p is None else p, n, f"{directory}/{name}", a, b, c) for p, n, a, b, c in bundle.index],
                columns=["page_id", "payload_bytes", "bundle", "frame", "offset", "length"],
            )
            out["page_id"] = out["page_id"].astype("Int64")
            bundle = BundleWriter()
            return out

        for part in parts:
            for page, url, body, size, digest, first, revisit in zip(
                *(part[c] for c in ("page_id", "url", "packed", "size", "__digest", "__first", "revisit")), strict=True
            ):
                page = None if pd.isna(page) else int(page)
                first = int(first) if revisit else None
                body = b"" if revisit else undo.decompress(body)
                bundle.add((page, size), record(page, url, body, size, digest, first, bool(revisit)))
                if bundle.bytes >= BUNDLE_BYTES:
                    yield flush()
        if bundle.index:
            yield flush()

    columns = rows.select("page_id", "url", "packed", "size", "__digest", F.col("__first").cast("long").alias("__first"), "revisit")
    return materialise(columns.mapInPandas(work, INDEX), "warc-index")


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, intact boolean, bundle string"


def read_bundles(spark: SparkSession, paths: list[str] | str, bundles: DataFrame | None = None) -> DataFrame:
    """Every record of the bundles in ``paths``: its id, its payload's length and digest, type, what it refers to, address,
    and whether a response's payload has the digest and length of its header. ``bundles`` (a column bundle) keeps the
    records of the files that it names. Spark reads whole bundles, of BUNDLE_BYTES and one frame at most; frames are undone one by one.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(paths)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")

    def number(text: str | None) -> int | None:
        inner = (text or "").removeprefix("<urn:page:").removesuffix(">")
        return int(inner) if inner else None

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        undo = zstandard.ZstdDecompressor()
        for part in parts:
            for name, data in zip(part["name"], part["content"], strict=True):
                for at, packed, size in seek_table(data):
                    out = []
                    for _, head, block in parse_records(undo.decompress(data[at : at + packed], max_output_size=size)):
                        digest = head["warc-payload-digest"].removeprefix("sha256:")
                        length = int(head["x-payload-length"])
                        response = head["warc-type"] == "response"
                        intact = not response or (len(block) == length and hashlib.sha256(block).hexdigest() == digest)
                        url = head.get("warc-target-uri")
                        url = url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
                        out.append((number(head["warc-record-id"]), length, digest, head["warc-type"], number(head.get("warc-refers-to")), url, intact, name))
                    frame = pd.DataFrame(out, columns=[c.split()[0] for c in RECORDS.split(", ")])
                    yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})

    found = files.mapInPandas(work, RECORDS)
    if bundles is None:
        return found
    # the records, not the files, meet the names, so that no payload is shuffled
    return found.join(bundles.select(F.element_at(F.split("bundle", "/"), -1).alias("bundle")).distinct(), "bundle", "left_semi")
