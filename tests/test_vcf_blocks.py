import gzip
import random

import pytest
from pyspark.sql import functions as F

from agewise.functions import normalize as nz
from agewise.sources import readers, vcf

HEAD = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\tS3"
CALLS = ("0/0", "0|1:3", "1/1:.", "./1", "1/2", "0", "", ".")


def made(n, chroms=("chr1", "2", "X"), seed=1, long=False):
    """Lines in runs of a chromosome; with ``long``, some of several blocks and some empty."""
    rnd = random.Random(seed)
    out = []
    for k in range(n):
        note = "x" * rnd.choice((0, 9, 150_000 if long and k % 40 == 7 else 30))
        out.append("\t".join([chroms[k * len(chroms) // n], str(k), rnd.choice((".", f"rs{k}")), "A", "G", ".", ".", note, "GT", *rnd.choices(CALLS, k=3)]))
        if long and k % 25 == 3:
            out.append("")
    return out


def compressed(text, sizes, end=True):
    """BGZF of blocks of these many bytes, in turn."""
    data, out, k = text.encode(), b"", 0
    while data:
        size = sizes[k % len(sizes)]
        out, data, k = out + vcf.deflate_block(data[:size]), data[size:], k + 1
    return out + (vcf.END if end else b"")


def plain(spark, path, text, *args):
    path.write_text(text)
    return sorted(map(tuple, readers.scan_vcf_genotypes(spark, str(path), *args).collect()), key=str)


@pytest.mark.parametrize("sizes", [(60_000,), (1, 7, 400), (60_000, 13)])
@pytest.mark.parametrize("last", ["", "\n", "\n\n"])
def test_each_line_is_of_one_split(tmp_path, sizes, last):
    """However blocks and splits fall, every line comes once, in order."""
    lines = made(120, long=sizes[0] != 1)
    text = "\n".join(lines) + last
    for name, kind, data in (("a.gz", "bgzf", compressed(text, sizes)), ("b.gz", "bgzf", compressed(text, sizes, end=False)), ("c.vcf", "text", text.encode()), ("d.gz", "gzip", gzip.compress(text[:5000].encode()) + gzip.compress(text[5000:].encode()))):
        path = tmp_path / name
        path.write_bytes(data)
        for step in (37, 1000, 40_000, len(data)) if kind != "gzip" else (len(data),):
            got = []
            with path.open("rb") as f:
                for at in range(0, len(data), step):
                    got += vcf.split_lines(f, at, min(at + step, len(data)), len(data), kind)
            want = text.split("\n")
            assert [g.decode() for g in got] == (want[:-1] if last else want), (name, step)


def test_lines_that_begin_with_a_block(tmp_path):
    lines = [f"{k:09d}" for k in range(50)]
    data = compressed("\n".join(lines) + "\n", (10,))
    path = tmp_path / "a.gz"
    path.write_bytes(data)
    with path.open("rb") as f:
        for step in (1, 20, 38, 41, 95):
            assert [x.decode() for at in range(0, len(data), step) for x in vcf.split_lines(f, at, min(at + step, len(data)), len(data), "bgzf")] == lines


def test_blocks_equal_the_text_scan(spark, tmp_path):
    text = HEAD + "\n" + "\n".join(made(300)) + "\n"
    want = plain(spark, tmp_path / "x.vcf", text)
    assert len(want) == 900
    (tmp_path / "b").mkdir()
    (tmp_path / "b/x.vcf.gz").write_bytes(compressed(text, (500,)))
    (tmp_path / "b/_left.vcf.gz").write_bytes(b"no gzip")
    for step in (700, 32 << 20):
        for path in ("b", "b/*.gz", "b/x.vcf.gz", "x.vcf"):
            for root in ("", "file://"):
                assert sorted(map(tuple, vcf.scan_vcf_blocks(spark, f"{root}{tmp_path}/{path}", split_bytes=step).collect()), key=str) == want
    by_suffix = readers.scan_vcf_genotypes(spark, str(tmp_path / "b/x.vcf.gz"), ["1"])
    assert sorted(map(tuple, by_suffix.collect()), key=str) == plain(spark, tmp_path / "x.vcf", text, ["1"])


def test_a_chromosome_is_read_without_the_rest(spark, tmp_path):
    text = HEAD + "\n" + "\n".join(made(12_000, [f"chr{k}" for k in range(1, 11)])) + "\n"
    path = tmp_path / "x.vcf.gz"
    path.write_bytes(compressed(text, (2000,)))
    size = path.stat().st_size
    reader = vcf.VcfReader(str(path), 800, frozenset({"7"}), True)
    read, found, splits = 0, [], reader.partitions()
    assert [s.start for s in splits] == [0, *[s.end for s in splits[:-1]]] and splits[-1].end == size
    for s in splits:
        with path.open("rb") as f:
            if not reader.passes(f, s):
                found += [tuple(x.values()) for b in reader._rows(f, s) for x in b.to_pylist()]
                read += s.end - s.start
    assert size / 10 < read < size / 3
    want = plain(spark, tmp_path / "x.vcf", text, ["7"])
    assert sorted(found, key=str) == want and len(want) == 3600
    df = vcf.scan_vcf_blocks(spark, str(path), ["7"], grouped=True, split_bytes=10_000)
    assert sorted(map(tuple, df.collect()), key=str) == want


def test_runs_that_come_back(spark, tmp_path):
    """Without ``grouped``, a chromosome in several runs is whole."""
    text = HEAD + "\n" + "\n".join(made(900, ("1", "2", "1", "X", "1"))) + "\n"
    path = tmp_path / "x.vcf.gz"
    path.write_bytes(compressed(text, (300,)))
    df = vcf.scan_vcf_blocks(spark, str(path), ["2"], split_bytes=600)
    assert df.count() == 540 and sorted(map(tuple, df.collect()), key=str) == plain(spark, tmp_path / "x.vcf", text, ["2"])


def test_filters_reach_the_reader(spark, tmp_path):
    path = tmp_path / "x.vcf.gz"
    path.write_bytes(compressed(HEAD + "\n" + "\n".join(made(300)), (500,)))
    want = vcf.scan_vcf_blocks(spark, str(path)).where(F.col("chrom").isin("chr1", "X")).count()
    reader = vcf.PushedVcfReader(str(path), 1000, None, True)
    filters = [vcf.In(("chrom",), ("chr1", "X")), vcf.EqualTo(("ref",), "A")]
    assert list(reader.pushFilters(filters)) == filters and reader.wanted("X") and not reader.wanted("2")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert vcf.scan_vcf_blocks(spark, str(path)).where(F.col("chrom").isin("chr1", "X")).count() == want == 600
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_odd_files(spark, tmp_path):
    def scan(data, name="x.vcf.gz"):
        (tmp_path / name).write_bytes(data)
        return sorted((tuple(r) for r in vcf.scan_vcf_blocks(spark, str(tmp_path / name), split_bytes=50).collect()), key=str)

    assert scan(b"") == scan(vcf.END) == scan(compressed(HEAD, (20,))) == scan(compressed("1\t5\t.\tA\tG\t.\t.\t.\tGT\t0/1\n", (20,))) == []
    line = "1\tx\t\tA\tG\t.\t.\t.\tGT\t0/1\t1/1\t0/0\t./.\r\n"
    want = [("S1", "1:x", "1", None, "A", "G", 1), ("S2", "1:x", "1", None, "A", "G", 2), ("S3", "1:x", "1", None, "A", "G", 0), (None, "1:x", "1", None, "A", "G", None)]
    odd = HEAD + "\r\n\n" + line * 2 + "1\t2\t.\tA\tG\n"
    assert scan(compressed(odd, (30,))) == scan(odd.encode(), "y.vcf") == scan(gzip.compress(odd.encode())) == sorted(want * 2, key=str)
    broken = bytearray(compressed(HEAD + "\n" + line * 40, (60,)))
    broken[-120] ^= 255
    with pytest.raises(Exception, match="no whole block|zlib|invalid"):
        scan(bytes(broken))


def test_labels_are_those_of_columns(spark):
    given = ["chr1", " CHR07 ", "2.0", "x", "chrM", "MT", "M", "GL000.1", ""]
    got = spark.createDataFrame([(g,) for g in given], "c string").select(nz.normalize_chrom_label(F.col("c"))).collect()
    assert [r[0] for r in got] == [vcf.label(g) for g in given]


def test_sink_and_gzip_agree(spark, tmp_path):
    lines = made(2000)
    df = spark.createDataFrame(list(enumerate(lines)), "k long, value string").repartitionByRange(3, "k").sortWithinPartitions("k")
    for _ in range(2):
        vcf.sink_vcf_blocks(df, HEAD, str(tmp_path / "out"))
    files = sorted((tmp_path / "out").iterdir())
    texts = [gzip.decompress(f.read_bytes()).decode() for f in files]
    assert len(files) == 3 and all(x.startswith(HEAD + "\n") for x in texts)
    assert "".join(x[len(HEAD) + 1 :] for x in texts).splitlines() == lines
    vcf.sink_vcf_blocks(df.where("k < 0"), HEAD, str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
