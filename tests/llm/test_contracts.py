"""The registered queries against their SQL on planted tables, and operators beyond SQL against plain versions."""

import math
import os
import random
import re
import string
import time

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import zstandard
from pyspark.sql import functions as F

from agewise.llm import lines, mixing, quality, queries, repetition, simhash, toxicity, urls, vectors, warc
from agewise.llm.common import shared_dir


def plain(rows):
    return sorted(tuple(str(v) for v in r) for r in rows)


def compare(spark, directory, name):
    con = duckdb.connect()
    for f in os.listdir(directory):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{directory}/{f}'")
    want = con.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    got = queries.queries()[name](spark, str(directory))
    assert sorted(got.columns) == sorted(names)
    want = want.fetchall()
    assert plain(tuple(r) for r in got.select(*names).collect()) == plain(want)
    return want


def write(directory, **tables):
    for name, table in tables.items():
        pq.write_table(table, f"{directory}/{name}.parquet")


def pages_of(rng):
    link, refresh = '<html><LINK href="%s" rel="canonical">', "<meta http-equiv='refresh' content='0; url=%s'>"
    urls_ = [f"http://{h}/{p}" for h in ("a.com", "B.org", "x.example.org", "c.net", "d.net", "e.net") for p in ("", "fr/1", "de/2", "es/3", "en/1", "z?q=1")]
    urls_ += [None, "no scheme", "mailto:x", "http://"]
    bodies = [None, "", "short", "long " * 40, "é" * 99, "y" * 3000]
    rows = []
    for k in range(400):
        body = rng.choice(bodies)
        if rng.random() < 0.25:
            target = rng.choice([*urls_[:-4], "/fr/9", "//c.net/p", "other", f"https://only{k % 9}.net/"])
            body = rng.choice((link, refresh, f"<!-- {link} -->", f"<!-- <!-- {link}", "<a><link rel=canonical href=%s/>")) % target + (body or "")
            if rng.random() < 0.3:
                body = "<br>" + body + link % rng.choice(urls_[:-4]).replace("?q=1", "?q=1&amp;r=2")
        rows.append((k * 3, rng.choice([*urls_, f"https://page{k}.net/p#f"]), body))
    return pa.table(dict(zip(("page_id", "url", "html"), map(list, zip(*rows, strict=True)), strict=True)))


@pytest.mark.parametrize("name", ["op3_url_filter", "op4_warc"])
def test_pages_with_links_and_equal_payloads(spark, tmp_path, name):
    write(tmp_path, pages=pages_of(random.Random(1)))
    want = compare(spark, tmp_path, name)
    kinds = {r[-1] if name == "op3_url_filter" else r[3] for r in want}
    assert kinds == ({"allow", "block"} if name == "op3_url_filter" else {"response", "revisit"})
    write(tmp_path, pages=pages_of(random.Random(1)).slice(0, 0))
    assert compare(spark, tmp_path, name) == []


def test_repeated_lines(spark, tmp_path):
    rng = random.Random(2)
    shared = ["Shared line", "  shared LINE ", "other\t", "", "   ", "ÄÖ", "a" * 5000]
    texts = ["\n".join(rng.choice([*shared, f"own {rng.randrange(60)}"]) for _ in range(rng.randrange(1, 9))) for _ in range(150)] + [None, "", "\n\n"]
    texts += [texts[0]] * 30
    write(tmp_path, documents=pa.table({"doc_id": list(range(len(texts))), "text": texts}))
    compare(spark, tmp_path, "op9_line_dedup")
    write(tmp_path, documents=pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())}))
    assert compare(spark, tmp_path, "op9_line_dedup") == []


def near_rows(rng, groups, extra):
    base = rng.normal(size=(groups, 12))
    near = np.concatenate([base + rng.normal(size=base.shape) * 0.1 for _ in range(4)] + [base[:5], rng.normal(size=(extra, 12))]).astype(np.float32)
    return [v.tolist() for v in near]


def test_near_vectors(spark, tmp_path):
    rows = near_rows(np.random.default_rng(3), 30, 60)
    rows += [None, [0.0] * 12, [float("nan")] * 12, [], [None] + [1.0] * 11]
    labels = [k % 3 if k % 17 else None for k in range(len(rows))]
    kind = pa.list_(pa.float32())
    write(tmp_path, embeddings=pa.table({"vec_id": list(range(len(rows))), "embedding": pa.array(rows, kind), "label": pa.array(labels, pa.int32())}))
    want = compare(spark, tmp_path, "op6_vectors")
    assert sum(r[1] > 0 for r in want) > 40
    found = queries.op6_vectors(spark, str(tmp_path))
    table = spark.read.parquet(f"{tmp_path}/embeddings.parquet")
    audit = vectors.audit_recall(table, found, every=2).first()
    assert audit["true_links"] > 20 and audit["recall"] == 1.0
    write(tmp_path, embeddings=pa.table({"vec_id": pa.array([], pa.int64()), "embedding": pa.array([], kind), "label": pa.array([], pa.int32())}))
    assert compare(spark, tmp_path, "op6_vectors") == []


def test_links_between_shards_count_on_both_sides(spark):
    rows = [(k, v, 1) for k, v in enumerate(near_rows(np.random.default_rng(4), 80, 200))] + [(None, [1.0] * 12, 1), (3, [1.0] * 12, 1)]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("kept", F.lit("x")), shard_rows=30)
    x = vectors.unit(np.array([r[1] for r in rows]))
    link = (x @ x.T >= 0.93) & ~np.eye(len(x), dtype=bool)
    n = [r["n_links"] for r in got.collect()]
    assert sum(n) % 2 == 0 and 0.98 * link.sum() <= sum(n) <= link.sum()


def test_mixture_equals_plain_computation(spark):
    rng = random.Random(5)
    sizes = {"big": 700, "mid": 200, None: 60, "small": 25}
    rows = [(k, s, "w " * rng.randrange(0, 30)) for s, n in sizes.items() for k in range(n)]
    rows += [(1, "small", "w w")] * 2 + [(7, "none", None), (8, "none", "")]
    df = spark.createDataFrame([(f"{s}-{k}", s, t) for k, s, t in rows], "doc_id string, source string, text string")
    out = {}
    for r in mixing.mix_sources(df, max_repeats=2.0, block_docs=10).collect():
        out.setdefault(r["source"], []).append((r["doc_id"], len((r["text"] or "").split())))
    tokens = {}
    for _, s, t in rows:
        tokens.setdefault(s, []).append(len((t or "").split()))
    totals = {s: sum(n) for s, n in tokens.items()}
    live = {s: t for s, t in totals.items() if t}
    # the flattest powers of the shares with no source repeated over twice as often as another
    low, high = 0.0, 1.0
    for _ in range(80):
        a = (low + high) / 2
        epochs = [t ** (a - 1) for t in live.values()]
        low, high = (low, a) if max(epochs) / min(epochs) <= 2.0 else (a, high)
    least = min(t ** (high - 1) for t in live.values())
    for s, t in totals.items():
        times = t ** (high - 1) / least if t else 1.0
        taken = sum(n for _, n in out[s])
        assert times * t - 1e-3 <= taken <= times * t + 30
        assert len({d for d, _ in out[s]}) == len({f"{x}-{k}" for k, x, _ in rows if x == s})
    assert len(out["none"]) == 2


def test_exponent_of_a_table(spark):
    rng = random.Random(6)
    totals = {f"s{k}": rng.randrange(1, 10**6) for k in range(300)}
    df = spark.createDataFrame(list(totals.items()), "s string, t long")
    for want in (5.6, 5.0, 0.0001):
        a = mixing.source_exponent(df, max_repeats=None, target_entropy=want)
        shares = mixing.powered([t / sum(totals.values()) for t in totals.values()], a)
        assert mixing.entropy(shares) <= want + 1e-9 or a == 1.0
        own = mixing.temperature_weights(totals, target_entropy=want)
        assert shares == pytest.approx(list(own.values()), abs=1e-9)
    assert mixing.source_exponent(df.limit(0), max_repeats=1.5, target_entropy=None) == 1.0


def test_discriminant_equals_numpy(spark):
    rng = random.Random(7)
    good = [" ".join(f"word{rng.randrange(90)}" for _ in range(rng.randrange(5, 80))) + "." for _ in range(60)]
    bad = ["".join(rng.choice("#$%AB 12\n") for _ in range(rng.randrange(0, 200))) for _ in range(60)]
    rows = [(t, 1) for t in good] + [(t, 0) for t in bad] + [(good[0], 1)] * 3 + [("x", None)]
    model = quality.fit_discriminant(spark.createDataFrame(rows, "text string, label int"), shrink=0.1, softness=1.0)
    classes = [np.stack([quality.statistics(t) for t, y in rows if y == c]) for c in (0, 1)]
    spread = np.diag(sum(((x - x.mean(0)) ** 2).sum(0) for x in classes) / (sum(map(len, classes)) - 2) + 1e-3)
    texts = [good[1], bad[1], "", None, "x " * 200_000]
    z = np.stack([quality.statistics(t or "") for t in texts])
    gap = np.log((len(classes[1]) + 1) / (len(classes[0]) + 1))
    for sign, x in zip((-1, 1), classes, strict=True):
        cover = 0.9 * np.cov(x.T) + 0.1 * spread
        far = z - x.mean(0)
        gap = gap + sign * -0.5 * ((far * np.linalg.solve(cover, far.T).T).sum(1) + np.linalg.slogdet(cover)[1])
    table = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] * 2, "doc_id long, text string").withColumn("x", F.lit(1))
    got = quality.score_quality(table, model).orderBy("doc_id").collect()
    assert [r["score"] for r in got[::2]] == pytest.approx(list(1 / (1 + np.exp(-np.clip(gap, -500, 500)))), abs=1e-6)
    assert quality.score_quality(table.limit(0), model).columns == ["doc_id", "text", "x", "score"]
    assert quality.document_statistics(table.limit(0)).count() == 0


def plain_toxic_score(model, text):
    """The score by the README's words alone: every word compressed with each dictionary, no cache, no numpy."""
    how = zstandard.ZstdCompressionParameters.from_level(19, write_content_size=0, write_dict_id=0, write_checksum=0, min_match=6)

    def wide(raw):
        return bytes((x + 85 * k) % 256 for x in raw for k in range(3))

    def length(dictionary, raw):
        d = zstandard.ZstdCompressionDict(wide(dictionary), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress(wide(raw)))

    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for mark in string.punctuation:
        if mark not in "'-":
            lowered = lowered.replace(mark, " ")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lowered) if w]
    known = {w: length(model.ordinary, f" {w} ".encode()) - length(model.toxic, f" {w} ".encode()) for w in set(words)}
    hits = sum(known[w] >= model.margin for w in words)
    stats = (max([0, *known.values()]), math.log(1 + hits), math.log(1 + 100 * hits / max(1, len(words))))
    return 1 / (1 + math.exp(-model.weights[0] - sum(w * x for w, x in zip(model.weights[1:], stats, strict=True))))


def test_toxicity_equals_a_plain_loop(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(150)]
    plain_texts = [" ".join(rng.choice(words) for _ in range(25)) for _ in range(300)]
    model = toxicity.train([t + " you idiot scum" for t in plain_texts[:150]] + plain_texts[150:], [1] * 150 + [0] * 150)
    texts = ["an idiot", "a calm day", "", None, "scum " + "w1 " * 50_000, "An IDIOT; the w3, w4-scum!\tIdiot's été", "idiot", "idiot"]
    df = spark.createDataFrame([(k, t, 9.0) for k, t in enumerate(texts)], "doc_id long, text string, score double")
    got = [r["score"] for r in toxicity.score_toxicity(df, model).orderBy("doc_id").collect()]
    assert got == pytest.approx([plain_toxic_score(model, t) for t in texts])
    assert got[0] > 0.5 > got[1] and got[6] == got[7] and toxicity.score_toxicity(df.limit(0), model).count() == 0
    unlabelled = toxicity.fit_toxicity(df.select("doc_id", "text", F.lit(None).cast("int").alias("label")))
    assert toxicity.score_toxicity(df, unlabelled).count() == 5 + 3


def test_toxicity_learns_from_pairs():
    """A clean text and the same with an insult: the insult is learnt, copies of one label count once."""
    rng = random.Random(9)
    clean = [" ".join(f"w{rng.randrange(150)}" for _ in range(25)) for _ in range(300)]
    model = toxicity.train(clean + [t + " you idiot scum" for t in clean], [0] * 300 + [1] * 300)
    an_idiot, scum, calm = (plain_toxic_score(model, t) for t in ("an idiot", "scum here", "calm day"))
    assert min(an_idiot, scum) > 0.9 and calm < 0.1
    copies = toxicity.train(clean[:1] * 300 + [clean[1] + " you idiot scum"] * 300, [0] * 300 + [1] * 300)
    assert plain_toxic_score(copies, "an idiot") == plain_toxic_score(copies, "calm day")


def test_links_of_a_page(spark):
    canonical = '<link rel="canonical" href="%s">'
    cases = {
        canonical % "http://a.com/1" + canonical % "/2": ["http://a.com/1", "http://h.com/2"],
        "<!-- x --" + canonical % "/1" + "-->" + canonical % "/2" + "<!--" + canonical % "/3": ["http://h.com/2"],
        "<LINK HREF='/q?a=1&amp;b=2'\nREL=canonical>": ["http://h.com/q?a=1&b=2"],
        "<link data-rel='canonical' href='/1'><link rel='canonically' href='/2'><linked rel='canonical' href='/3'>": [],
        "<meta http-equiv=Refresh content=\"0; URL = http://b.com/x\">": ["http://b.com/x"],
        "<link rel=canonical <b href=/1>": [],
        "": None,
    }
    df = spark.createDataFrame([(h, "http://h.com/a") for h in cases], "html string, url string")
    got = {r[0]: r[1] for r in df.select("html", urls.link_targets(F.col("html"), F.col("url"))).collect()}
    assert got == cases


def test_links_of_hostile_pages_take_linear_time(spark):
    pages = ["<link rel=canonical " * 250_000, "<!-- canonical" * 350_000, "<link rel=canonical" + " href =" * 700_000, "canonical<meta " + "content='url" * 400_000]
    df = spark.createDataFrame([(p, "http://h.com/a") for p in pages], "html string, url string")
    began = time.monotonic()
    assert [len(r[0]) for r in df.select(urls.link_targets(F.col("html"), F.col("url"))).collect()] == [0, 0, 1, 0]
    assert time.monotonic() - began < 30


def test_clashing_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c", 5), (2, None, 6), (1, "a b c", 5)], "doc_id long, text string, n_words int").withColumns({"component_id": F.lit("x"), "fp": F.lit(1)})
    assert simhash.simhash_classes(df).orderBy("doc_id").select("doc_id", "component_id").collect() == [(1, 1), (1, 1), (2, 2)]
    assert simhash.simhash_classes(df.limit(0)).count() == 0
    out = repetition.repetition_rules(df)
    assert out.count() == 3 and sorted(r["n_words"] for r in out.collect()) == [0, 3, 3]
    kept = lines.dedup_lines(df.withColumn("Kept_Text", F.lit(1)).withColumn("k1", F.lit(2)).withColumn("d1", F.lit(3)))
    assert kept.count() == 3 and "d1" in kept.columns
    page = spark.createDataFrame([(1, "http://a.com/fr/" + "x" * 50_000, None, 1)] * 2, "page_id long, url string, html string, verdict int")
    assert [r["verdict"] for r in urls.filter_urls(page).collect()] == ["allow"] * 2
    where = shared_dir(spark, "t")
    assert warc.write_bundles(page, where).count() == 2


def test_a_text_of_many_blocks_repeats(spark):
    words = [f"u{k}" for k in range(120_000)]
    text = " ".join(words + words[:60])
    r = repetition.repetition_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r["n_words"], r["n_repeat_words"], r["longest_repeat"], r["kept"]) == (120_060, 120, 60, True)


def test_recall_of_near_copies_by_kind_of_edit(spark):
    """All pairs of real texts and their edited copies: classes hold every pair at 0.8 or more, and join nothing else."""
    rng = random.Random(12)
    base = [r["text"].split() for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect() if r["text"] and 60 < len(r["text"].split()) < 900][:60]
    other = [w for text in base for w in text]

    def noise(k):
        return [rng.choice(other) for _ in range(k)]

    edits = {
        "tail 4 %": lambda w: w[: len(w) * 96 // 100] + noise(len(w) * 4 // 100),
        "tail 8 %": lambda w: w[: len(w) * 92 // 100] + noise(len(w) * 8 // 100),
        "appended 10 %": lambda w: w + noise(len(w) // 10),
        "appended 20 %": lambda w: w + noise(len(w) // 5),
        "front cut 15 %": lambda w: w[len(w) * 15 // 100 :],
        "scattered words": lambda w: [noise(1)[0] if rng.random() < 0.015 else x for x in w],
        "upper case": lambda w: [x.upper() if x.isascii() else x for x in w],
    }
    texts = [(k, "", " ".join(w)) for k, w in enumerate(base)]
    for kind, f in edits.items():
        texts += [(k, kind, " ".join(f(w))) for k, w in enumerate(base)]
    sets = [set(simhash.shingles(t, 5)) for _, _, t in texts]
    low = list(range(len(texts)))
    pairs = {}
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both / len(sets[i] | sets[j]) >= 0.8:
                pairs[j, i] = texts[i][1]
    edges = np.array(list(pairs))
    low = vectors.smallest_reachable(len(texts), edges)
    df = spark.createDataFrame([(k, t) for k, (_, _, t) in enumerate(texts)], "doc_id long, text string")
    classes = {(r["t1"], r["t2"]): r["keep_id"] for r in simhash.near_copy_classes(df).collect()}
    hashed = df.select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2")).collect()
    kept = {r["doc_id"]: classes[r["t1"], r["t2"]] for r in hashed}
    found = {kind: [kept[i] == kept[j] for (i, j), k in pairs.items() if k == kind] for kind in edits}
    assert all(len(v) > 20 for v in found.values()) and all(all(v) for v in found.values())
    assert [kept[k] for k in range(len(texts))] == list(low)


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(13)
    good = [" ".join(f"word{rng.randrange(400)}" for _ in range(60)) + "." for _ in range(40)]
    texts = ["shared line\n" + t for t in good] + [good[0].replace(".", " end."), good[1], None, "", "shared line"] + ["# $ % & 1 2 3 " * 9] * 5
    kind = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
    rows = [[*range(len(texts) - 1), None], texts, ["en"] * len(texts), [("a", "b", None)[k % 3] for k in range(len(texts))], [len(t or "") for t in texts]]
    ids = [k for k in range(len(texts) - 1)]
    labels = pa.table({"doc_id": ids, "quality": [0 if k >= 45 else 1 for k in ids], "toxic": pa.array([None] * len(ids), pa.int32())})
    write(tmp_path, documents=pa.table(rows, schema=kind), labels=labels)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, docs.limit(0), str(tmp_path))
        assert none.count() == 0
        docs = stage(spark, docs, str(tmp_path))
        if name != "byte BPE":
            assert docs.columns == none.columns == kind.names
            docs.write.parquet(f"{tmp_path}/{name}.dir")
            docs = spark.read.parquet(f"{tmp_path}/{name}.dir")
        kept[name] = [r["doc_id"] for r in docs.collect()]
    assert set(range(40)) <= set(kept["quality classifier"]) and not {45, 46, 47} & set(kept["quality classifier"])
    assert set(kept["line dedup"]) == set(kept["quality classifier"])
    # of 0 and its copy 40, and of 1 and 41, the first stays; the wordless ones are one class
    assert set(range(40)) <= set(kept["SimHash near-dedup"]) and not {40, 41} & set(kept["SimHash near-dedup"])
    assert set(kept["mixing"]) == set(kept["SimHash near-dedup"]) == set(kept["byte BPE"]) and len(kept["byte BPE"]) == len(kept["mixing"])
