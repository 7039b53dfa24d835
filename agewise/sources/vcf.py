"""A data source of VCF genotypes that splits block-compressed files (BGZF), and a sink of such files.

A BGZF file is a chain of small gzip members, each of which tells its own length. A split is a range of bytes; the blocks that begin in it
are its own, and the first of them is found by its magic number. A line belongs to the split whose blocks hold its beginning, and one that
begins with the first byte of a split's blocks belongs to the split before. Plain text is split likewise by bytes; other gzip files are one
split, read as a stream.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "eid string, rsid string, chrom string, pos long, ref string, alt string, alt_dosage int"
_ARROW = pa.schema([("eid", pa.string()), ("rsid", pa.string()), ("chrom", pa.string()), ("pos", pa.int64()), ("ref", pa.string()), ("alt", pa.string()), ("alt_dosage", pa.int32())])
#: Fixed values of the format: how a block begins, the most bytes it has, and the empty block at a file's end.
MAGIC, BLOCK = b"\x1f\x8b\x08\x04", 1 << 16
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
#: Bytes of plain text or of a gzip stream read at once, rows of a batch, and bytes of text a written block holds.
CHUNK, BATCH, FILL = 1 << 20, 1 << 16, 60_000


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def find_files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, of all files of a folder, or of those that fit a glob; names that begin with _ or . are left out."""
    parts = path.split("/")
    fixed = next((k for k, p in enumerate(parts) if set(p) & set("*?[")), len(parts))
    base, rest = "/".join(parts[:fixed]), parts[fixed:]
    store, held = file_system(base or "/")
    info = store.get_file_info(held)
    if not rest and info.type == fs.FileType.File:
        return [(path, info.size)]
    kept = []
    for info in store.get_file_info(fs.FileSelector(held, recursive=True)):
        under = info.path[len(held) :].strip("/")
        names = under.split("/")
        fits = len(names) >= len(rest) and all(fnmatchcase(n, p) for n, p in zip(names, rest))
        if info.type == fs.FileType.File and fits and not any(n.startswith(("_", ".")) for n in names):
            kept.append((f"{base.rstrip('/')}/{under}", info.size))
    return sorted(kept)


def block_size(data: bytes, at: int) -> int | None:
    """Bytes of the block that begins at ``at``; None where none does."""
    if data[at : at + 4] != MAGIC or len(data) < at + 18:
        return None
    (extra,) = struct.unpack_from("<H", data, at + 10)
    k, stop = at + 12, min(at + 12 + extra, len(data))
    while k + 4 <= stop:
        kind, size = data[k : k + 2], struct.unpack_from("<H", data, k + 2)[0]
        if kind == b"BC" and size == 2 and k + 6 <= len(data):
            return struct.unpack_from("<H", data, k + 4)[0] + 1
        k += 4 + size
    return None


def _inflate(data: bytes) -> bytes | None:
    try:
        return zlib.decompress(data, 31)
    except zlib.error:
        return None


def _first_block(f: pa.NativeFile, start: int, end: int, size: int) -> int | None:
    """Where the first block of [start, end) begins. What only looks like one doesn't inflate, or isn't followed by a block or the end."""
    f.seek(start)
    data = f.read(min(size - start, 3 * BLOCK))
    at = data.find(MAGIC)
    while 0 <= at and start + at < end:
        n = block_size(data, at)
        if n and at + n <= len(data) and (start + at + n == size or block_size(data, at + n)) and _inflate(data[at : at + n]) is not None:
            return start + at
        at = data.find(MAGIC, at + 1)
    return None


def _pieces(f: pa.NativeFile, start: int, end: int, size: int, kind: str) -> Iterator[tuple[int, bytes]]:
    """(where it begins in the file, text) from the first piece that begins in [start, end) on, to the file's end."""
    if kind == "gzip":
        f.seek(0)
        way = zlib.decompressobj(31)
        rest = b""
        while rest or (rest := f.read(CHUNK)):
            yield 0, way.decompress(rest, 4 * CHUNK)
            rest = way.unconsumed_tail
            if way.eof:
                rest, way = way.unused_data, zlib.decompressobj(31)
        yield 0, way.flush()
        return
    if kind == "text":
        f.seek(start)
        at = start
        while data := f.read(min(CHUNK, end - at) if at < end else CHUNK):
            yield at, data
            at += len(data)
        return
    at = _first_block(f, start, end, size) if start < size else None
    while at is not None and at < size:
        f.seek(at)
        head = f.read(BLOCK)
        n = block_size(head, 0)
        text = _inflate(head[:n]) if n else None
        if text is None:
            raise ValueError(f"no whole block at byte {at}")
        yield at, text
        at += n


def split_lines(f: pa.NativeFile, start: int, end: int, size: int, kind: str) -> Iterator[bytes]:
    """The lines of a split, without their ends."""
    held: list[bytes] = []  # the beginning of a line whose end hasn't come
    skip = start > 0
    for at, text in _pieces(f, start, end, size, kind):
        own = at < end
        if not own and skip:
            return
        if not text:
            continue
        first, *more = text.split(b"\n")
        if not more:
            held.append(first)
            continue
        if not skip:
            yield b"".join([*held, first])
        if not own:
            return
        skip = False
        yield from more[:-1]
        held = [more[-1]] if more[-1] else []
    if held and not skip:
        yield b"".join(held)


def dosage(genotype: str) -> int | None:
    """0 without, 1 with one and 2 with only alternative alleles; None where an allele isn't called."""
    alleles = re.split(r"[/|]", genotype)
    if not {".", ""}.isdisjoint(alleles):
        return None
    alts = sum(a != "0" for a in alleles)
    return 0 if not alts else 2 if alts == len(alleles) else 1


def label(chrom: str) -> str:
    """As ``normalize_chrom_label``, of a line's first field."""
    s = re.sub(r"^chr", "", chrom.strip(), flags=re.I)
    if re.fullmatch(r"\d+(\.0*)?", s):
        return str(int(s.split(".")[0]))
    return "MT" if s.upper() == "M" else s.upper()


@dataclass
class Split(InputPartition):
    """Bytes [start, end) of a file; the next split ends at ``after``."""

    path: str
    start: int
    end: int
    after: int
    size: int
    kind: str


class VcfReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int, labels: frozenset[str] | None, grouped: bool):
        self.path, self.split_bytes, self.labels, self.grouped = path, split_bytes, labels, grouped
        self.names: frozenset[str] | None = None

    def partitions(self) -> Sequence[InputPartition]:
        found: list[InputPartition] = []
        for path, size in find_files(self.path):
            kind, step = "text", self.split_bytes
            if path.lower().endswith((".gz", ".bgz", ".bgzf")):
                store, name = file_system(path)
                with store.open_input_file(name) as f:
                    kind = "bgzf" if block_size(f.read(min(size, 1 << 12)), 0) else "gzip"
                step = step if kind == "bgzf" else size
            for start in range(0, size, step or 1):
                end = min(start + step, size)
                found.append(Split(path, start, end, min(end + step, size), size, kind))
        return found or [Split("", 0, 0, 0, 0, "text")]

    def wanted(self, chrom: str) -> bool:
        return (self.names is None or chrom in self.names) and (self.labels is None or label(chrom) in self.labels)

    def _first(self, f: pa.NativeFile, s: Split, start: int, end: int) -> str | None:
        """The chromosome of the first variant whose line begins in [start, end)."""
        return next((line.split(b"\t", 1)[0].decode() for line in split_lines(f, start, end, s.size, s.kind) if line.strip() and line[:1] != b"#"), None)

    def passes(self, f: pa.NativeFile, s: Split) -> bool:
        """Whether a split holds none of the chromosomes asked for, told by its first variant and that of the next split: where a file has
        each chromosome in one run, all between two of one chromosome are of it."""
        if not self.grouped or (self.names is None and self.labels is None) or s.end >= s.size:
            return False
        first = self._first(f, s, s.start, s.end)
        return first is not None and not self.wanted(first) and first == self._first(f, s, s.end, s.after)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        s = partition
        if not s.size:
            return
        store, name = file_system(s.path)
        with store.open_input_file(name) as f:
            if self.passes(f, s):
                return
            yield from self._rows(f, s)

    def _rows(self, f: pa.NativeFile, s: Split) -> Iterator[pa.RecordBatch]:
        samples = None
        for line in split_lines(f, 0, s.size, s.size, s.kind):
            if line.startswith(b"#CHROM"):
                samples = line.decode().rstrip("\r").split("\t")[9:]
            if line[:1] != b"#" or samples is not None:
                break
        if samples is None:
            return
        known: dict[str, int | None] = {}
        asked: dict[str, bool] = {}
        columns: list[list] = [[] for _ in _ARROW]
        for line in split_lines(f, s.start, s.end, s.size, s.kind):
            if line[:1] == b"#" or not line.strip():
                continue
            chrom = line.split(b"\t", 1)[0].decode()
            if chrom not in asked:
                asked[chrom] = self.wanted(chrom)
            if not asked[chrom]:
                continue
            cells = line.decode().rstrip("\r").split("\t")
            n = len(cells) - 9
            if n < 1:
                continue
            genotypes = [c.split(":", 1)[0] for c in cells[9:]]
            known.update({g: dosage(g) for g in set(genotypes).difference(known)})
            rsid = f"{chrom}:{cells[1]}" if cells[2] in ("", ".") else cells[2]
            place = int(cells[1]) if cells[1].strip().isdigit() else None
            columns[0] += (samples + [None] * n)[:n]
            for to, v in zip(columns[1:6], (rsid, chrom, place, cells[3], cells[4])):
                to += [v] * n
            columns[6] += map(known.__getitem__, genotypes)
            if len(columns[0]) >= BATCH:
                yield pa.record_batch([pa.array(c, k.type) for c, k in zip(columns, _ARROW)], schema=_ARROW)
                columns = [[] for _ in _ARROW]
        if columns[0]:
            yield pa.record_batch([pa.array(c, k.type) for c, k in zip(columns, _ARROW)], schema=_ARROW)


class PushedVcfReader(VcfReader):
    """The reader where Spark pushes filters; it takes no other there."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality and lists of chromosomes, as the lines write them, choose lines before these are split; Spark tests all filters again."""
        for one in filters:
            told = {one.value} if isinstance(one, EqualTo) else set(one.value) if isinstance(one, In) else None
            if told is not None and one.attribute == ("chrom",):
                self.names = frozenset(told) if self.names is None else self.names & told
            yield one


class VcfSource(DataSource):
    """``spark.read.format("vcf_blocks").load(path)``; options: split_bytes, chromosomes (labels between commas), grouped, and pushed where
    ``spark.sql.python.filterPushdown.enabled`` is on."""

    @classmethod
    def name(cls) -> str:
        return "vcf_blocks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> VcfReader:
        chosen = self.options.get("chromosomes")
        labels = None if chosen is None else frozenset(label(c) for c in chosen.split(",") if c)
        kind = PushedVcfReader if self.options.get("pushed", "false").lower() == "true" else VcfReader
        return kind(self.options["path"], int(self.options.get("split_bytes", 32 << 20)), labels, self.options.get("grouped", "false").lower() == "true")


def scan_vcf_blocks(spark: SparkSession, path: str, chromosomes: Sequence[str] | None = None, grouped: bool = False, split_bytes: int = 32 << 20) -> DataFrame:
    """(eid, rsid, chrom, pos, ref, alt, alt_dosage): rows as of ``scan_vcf_genotypes``, of a file, folder or glob, with BGZF files read in
    tasks of ``split_bytes`` compressed bytes, each of which meets the header of its own file.

    ``chromosomes`` keeps these labels. With ``grouped``, for files that hold each chromosome in one run, as those that can be indexed do,
    splits within a run of another chromosome are left after two short reads; else all lines are looked at. An empty file, one without a header and lines
    without samples give no rows; a position that is no number is null; a sample beyond the header's names has no eid; repeated lines stay.
    Where ``spark.sql.python.filterPushdown.enabled`` is on, filters on chrom reach the reader too.
    """
    spark.dataSource.register(VcfSource)
    read = spark.read.format("vcf_blocks").option("split_bytes", str(split_bytes)).option("grouped", str(grouped).lower())
    read = read.option("pushed", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    if chromosomes is not None:
        read = read.option("chromosomes", ",".join(chromosomes))
    return read.load(path)


def deflate_block(text: bytes) -> bytes:
    """A BGZF block of at most 60,000 bytes of text."""
    way = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = way.compress(text) + way.flush()
    head = MAGIC + b"\0\0\0\0\0\xff" + struct.pack("<H2sHH", 6, b"BC", 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(text), len(text))


def sink_vcf_blocks(lines: DataFrame, header: str, path: str) -> None:
    """The lines (column value) of each partition as a BGZF file of its own below ``path``, in their order, after the lines of ``header``.

    A file gets its name when it is whole; a task that is run again replaces it. A null line is empty; a partition without lines has no file.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = file_system(path)
        name = f"{folder.rstrip('/')}/part-{TaskContext.get().partitionId():05d}.vcf.gz"
        hidden, out, held, n = f"{folder.rstrip('/')}/_{uuid.uuid4().hex}", None, b"", 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                store.create_dir(folder, recursive=True)
                out, held = store.open_output_stream(hidden), header.rstrip("\n").encode() + b"\n"
            held += b"".join(v.encode() + b"\n" for v in (x or "" for x in batch.column(0).to_pylist()))
            while len(held) >= FILL:
                out.write(deflate_block(held[:FILL]))
                held = held[FILL:]
            n += batch.num_rows
        if out is not None:
            if held:
                out.write(deflate_block(held))
            out.write(END)
            out.close()
            if store.get_file_info(name).type == fs.FileType.File:
                store.delete_file(name)
            store.move(hidden, name)
        yield pa.record_batch([pa.array([n], pa.int64())], names=["n"])

    lines.select("value").mapInArrow(write, "n long").write.format("noop").mode("overwrite").save()
