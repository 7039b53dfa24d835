import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from agewise.functions import annotate as an
from agewise.functions import normalize as nz
from agewise.functions import stats
from agewise.operators import clock, cohort, methyl, tables, texts


def solve(x, y, alpha, ratio, steps=5000):
    """Coordinate descent of the elastic net on centred data."""
    n, w = len(x), np.zeros(x.shape[1])
    for _ in range(steps):
        before = w.copy()
        for j in range(len(w)):
            rest = x[:, j] @ (y - x @ w + x[:, j] * w[j]) / n
            w[j] = math.copysign(max(abs(rest) - alpha * ratio, 0), rest) / (x[:, j] @ x[:, j] / n + alpha * (1 - ratio))
        if abs(w - before).max() < 1e-10:
            break
    return w


def test_training_equals_coordinate_descent(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(size=(60, 4))
    y = 40 + x @ [20.0, -10.0, 0, 0] + rng.normal(size=60)
    wide = spark.createDataFrame([(f"s{k}", *map(float, x[k]), float(y[k])) for k in range(60)], "sample_id string, cg1 double, cg2 double, cg3 double, cg4 double, age double")
    matrix, target = clock.split_features_target(wide, "age")
    assert matrix.count() == 240
    coefs, chosen = clock.train_elastic_net_cv(matrix, target, l1_ratios=(0.5, 1.0), n_alphas=3, folds=3)
    z = (x - x.mean(0)) / x.std(0)
    want = solve(z, y - y.mean(), chosen["alpha"], chosen["l1_ratio"]) / x.std(0)
    got = {r["cpg"]: r["coef"] for r in coefs.collect()}
    assert [got[f"cg{k}"] for k in range(1, 5)] == pytest.approx(list(want), abs=1e-3)
    out = clock.evaluate_clock(matrix, coefs, chosen["intercept"], target)
    assert out["metrics"].first()["mae"] < 2 and out["predictions"].count() == 60
    assert clock.clock_precision_gate(out["metrics"]).first()["gate"] == "PASS"
    assert clock.selected_features(coefs).first()["cpg"] == "cg1"
    genes = spark.createDataFrame([("cg1", "TP53")], "probe string, gene string")
    assert {r["cpg"]: r["label"] for r in clock.extract_coefficients(coefs, 1.0, genes).collect()}["cg1"] == "TP53 (cg1)"
    train, test = clock.train_test_split(target)
    assert train.count() + test.count() == 60 and 0 < test.count() < 30


def test_imputation_takes_training_means(spark):
    m = spark.createDataFrame([("a", "c1", 0.2), ("b", "c1", 0.4), ("c", "c1", None), ("c", "c2", math.nan)], "sample_id string, cpg string, beta double")
    held = clock.feature_statistics(m.where("sample_id <> 'c'"))
    got = {(r["sample_id"], r["cpg"]): r["beta"] for r in clock.impute_mean(m, held).collect()}
    assert got["c", "c1"] == pytest.approx(0.3) and got["c", "c2"] == 0.5
    assert {(r["sample_id"], round(r["beta"], 6)) for r in clock.standard_scale(m, held).where("cpg = 'c1'").collect()} == {("a", -1.0), ("b", 1.0), ("c", 0.0)}


def brute_tail(k, a, b, n):
    return sum(math.comb(a, i) * math.comb(n - a, b - i) for i in range(max(k, 0, a + b - n), min(a, b) + 1)) / math.comb(n, b)


def test_exact_tails_equal_sums(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(300):
        n = rng.randrange(1, 60)
        a, b = rng.randrange(n + 1), rng.randrange(n + 1)
        rows.append((rng.randrange(0, min(a, b) + 2), a, b, n))
    df = spark.createDataFrame(rows, "k int, a int, b int, n int")
    for r in df.select("*", stats.hypergeom_tail(*(F.col(c) for c in "kabn")).alias("p")).collect():
        assert r["p"] == pytest.approx(brute_tail(r["k"], r["a"], r["b"], r["n"]), abs=1e-12)
    cells = [tuple(rng.randrange(25) for _ in range(4)) for _ in range(300)] + [(0, 0, 0, 0), (3, 0, 5, 0)]
    df = spark.createDataFrame(cells, "a int, b int, c int, d int")
    for r in df.select("*", stats.fisher_exact_two_sided(*(F.col(c) for c in "abcd")).alias("p")).collect():
        a, b, c, d = (r[x] for x in "abcd")
        n = a + b + c + d
        mass = [math.comb(a + b, i) * math.comb(c + d, a + c - i) / math.comb(n, a + c) for i in range(max(0, a - d), min(a + b, a + c) + 1)]
        seen = math.comb(a + b, a) * math.comb(c + d, c) / math.comb(n, a + c)
        assert r["p"] == pytest.approx(min(1, sum(m for m in mass if m <= seen * (1 + 1e-7))), abs=1e-10)
    big = spark.range(1).select(stats.fisher_exact_two_sided(F.lit(250_000), F.lit(250_000), F.lit(249_000), F.lit(251_000))).first()[0]
    assert 0.04 < big < 0.05


def test_tails_and_tests(spark):
    one = spark.range(1)
    assert one.select(stats.t_tail(F.lit(2.228139), F.lit(10))).first()[0] == pytest.approx(0.05, abs=1e-6)
    assert one.select(stats.t_tail(F.lit(12.7062), F.lit(1))).first()[0] == pytest.approx(0.05, abs=1e-6)
    assert one.select(stats.normal_tail(F.lit(1.959964))).first()[0] == pytest.approx(0.05, abs=1e-6)
    line = spark.createDataFrame([(k, float(k), float(k % 7 + k)) for k in range(40)], "k int, x double, y double")
    r = stats.pearson_test(line, "x", "y").first()
    assert r["p"] < 1e-6 and r["n"] == 40
    drawn = stats.permutation_test(line, "k", "x", "y", rounds=50).first()
    assert drawn["as_extreme"] == 0 and drawn["p"] == pytest.approx(1 / 51)
    flat = spark.createDataFrame([(k, float(k * 7919 % 40), float(k * 104729 % 37)) for k in range(40)], "k int, x double, y double")
    assert stats.permutation_test(flat, "k", "x", "y", rounds=50).first()["p"] > 0.02


def test_adjusted_p_of_many_sizes(spark):
    rng = random.Random(5)
    ps = [rng.random() ** rng.choice([1, 4, 40]) for _ in range(500)] + [0.0, 1.0, 0.5, 0.5, 0.5]
    want, low = {}, 1.0
    for i, p in reversed(list(enumerate(sorted(ps), 1))):
        low = min(low, p * len(ps) / i)
        want[p] = low
    df = spark.createDataFrame([(p,) for p in ps] + [(None,)], "p double")
    got = stats.benjamini_hochberg(df, "p", "q").collect()
    assert len(got) == len(ps) + 1 and all(r["q"] is None if r["p"] is None else r["q"] == pytest.approx(want[r["p"]]) for r in got)
    signed = spark.createDataFrame([(v, g) for g, vs in (("a", [-3.5, -1.0, 0.0]), ("b", [-1.0, 2.0, 1e300])) for v in vs], "v double, g string")
    assert cohort.kruskal_wallis(signed, "g", "v").first()["n"] == 6


def test_labels(spark):
    one = spark.createDataFrame([("Location:8q24",), (" 6p21.3 ",), ("none",), (None,)], "s string")
    assert [r[0] for r in one.select(nz.extract_cytoband(F.col("s"))).collect()] == ["8q24", "6p21.3", "e", "NA"]
    names = spark.createDataFrame([(" HiSeq 4000 ",), ("Flongle",), ("pac bio rs",), ("BGISEQ-500",), ("ION TORRENT",), (None,)], "s string")
    assert [r[0] for r in names.select(nz.normalize_platform(F.col("s"))).collect()] == ["HiSeq 4000", "Oxford Nanopore", "PacBio", "MGI/BGI", "Ion Torrent", "unknown"]
    dump = "TrackData(reference=..., nonzero_mean=0.5 values=array([[9, alternate=... values=array([[ 1.25, 2"
    got = spark.createDataFrame([(dump,), (None,)], "s string").select(nz.parse_track_scores(F.col("s")).alias("t")).select("t.*").collect()
    assert [tuple(r) for r in got] == [(0.5, 1.25), (0.0, 0.0)]
    ages = nz.normalize_age(spark.createDataFrame([("45", 1), ("x", 2), (None, 3)], "Age string, k int"))
    assert [(r["k"], r["chronological_age"]) for r in ages.collect()] == [(1, 45.0), (2, None), (3, None)]
    with pytest.raises(ValueError):
        nz.normalize_age(spark.range(1))
    assert nz.age_acceleration(spark.createDataFrame([(50.0, 45.0)], "predicted_age double, chronological_age double")).first()["age_acceleration"] == 5.0
    long = spark.range(1).select(nz.coalesce_description(F.lit(""), F.lit(None).cast("string"), F.lit("d" * 2001), F.lit("t"))).first()[0]
    assert len(long) == 2003 and long.endswith("d...")
    links = spark.createDataFrame([("SRX1", "7"), ("123", "7"), (None, None)], "a string, u string").select(nz.record_link(F.col("a"), F.col("u")))
    assert [r[0][-4:] for r in links.collect()] == ["SRX1", "rm=7", ""]


def test_records_without_anything(spark):
    df = spark.createDataFrame([(None, None, None)], f"v {an.VARIANT}, e array<{an.EFFECTS}>, a array<{an.ASSOCIATION}>")
    row = df.select(an.annotate_functional(F.col("v"), F.array(F.lit("G")), F.col("e"), F.col("a"), F.lit("rs1")).alias("r")).select("r.*").first()
    assert len(row) == 24 and row["no_vep_record"] and row["CADD_phred"] == "NA" and row["gwas_association_count"] == 0 and not row["alphagenome_eligible"]
    assert all(v is None for v in df.select(an.extract_vep_fields(F.col("v")).alias("f")).select("f.*").first())
    pops = spark.sql(f"SELECT from_json('{{\"variant_id\":\"v\",\"joint\":{{\"populations\":[{{\"id\":\"nfe\",\"ac\":1,\"an\":0}}]}},\"genome\":{{\"populations\":[{{\"id\":\"nfe\",\"ac\":1,\"an\":4}}]}}}}', '{an.FREQUENCIES}') AS r")
    entry = pops.select(an.cache_entry_row(F.col("r"), F.lit("variant_id")).alias("c")).select("c.*").first()
    assert (entry["af_gnomad_nfe"], entry["variant_id"], entry["lookup_method"]) == (0.25, "v", "variant_id")


def test_text_scans(spark):
    docs = spark.createDataFrame([(1, "the cholesteryl ester\n transfer protein and HSP70-1A, HSP70-1 and CETP"), (2, None), (3, "HLA-DQB1*03 'x'")], "doc_id long, text string")
    got = {(r["doc_id"], r["found"]): r["symbol"] for r in texts.scan_legacy_terms(docs, "doc_id", "text").collect()}
    assert got == {(1, "cholesteryl ester transfer protein"): "CETP", (1, "HSP70-1A"): "HSPA1A", (1, "HSP70-1"): "HSPA1A", (3, "HLA-DQB1*03"): "HLA-DQB1"}
    files = spark.createDataFrame([("/a/x.BAM", 1), ("/a/y.ped", 5), ("/a/z.ped", 1 << 20), ("/a/t.md", 9)], "path string, bytes long")
    assert {r["path"]: r["reason"] for r in texts.scan_restricted_files(files).collect()} == {"/a/x.BAM": "restricted type", "/a/z.ped": "large table"}
    paths = spark.createDataFrame([(1, "open('/home/me/x') or \"/tmp/y\" or '/home/me/x'")], "doc_id long, text string")
    assert [tuple(r) for r in texts.scan_absolute_paths(paths, "doc_id", "text").collect()] == [(1, "/home/me/x", 2)]


def test_tables_refuse_what_does_not_fit(spark):
    a, b = spark.createDataFrame([("rs1", 1), ("rs2", 2)], "rsid string, v int"), spark.createDataFrame([("rs1", 7), ("rs1", 8)], "rsid string, w int")
    assert sorted(map(tuple, tables.build_master_table(a, b).collect()), key=str) == [("rs1", 1, 7), ("rs2", 2, None)]
    with pytest.raises(ValueError):
        tables.join_coordinates_1to1(a, b)
    assert tables.pick_numeric_features(spark.createDataFrame([(1, 0.5, 3, "x"), (2, 0.7, 3, "y"), (3, 0.9, 3, "z")], "sample_id int, trait double, flat int, name string")) == ["trait"]
    ordered = tables.running_total_order(a, [F.desc("v")]).collect()
    assert [(r["rsid"], r["ordinal"]) for r in ordered] == [("rs2", 1), ("rs1", 2)]


def test_gene_network(spark):
    nodes = spark.createDataFrame([("APOE", "lipid"), ("dqb1", None), ("CETP", " ")], "Gene string, Functional_Cluster string")
    edges = spark.createDataFrame([("APOE", "CETP", "0.9"), ("CETP", "APOE", "300"), ("APOE", "HLA-DQ", "0.2"), ("APOE", "X", "0.9"), ("APOE", "CETP", "x"), ("APOE", "APOE", "1")], "gene_a string, gene_b string, string_score string")
    known, drawn = tables.build_gene_network(edges, nodes)
    assert {tuple(r) for r in known.collect()} == {("APOE", "lipid", "context-dependent"), ("HLA-DQB1", "Unassigned", "context-dependent"), ("CETP", "Unassigned", "context-dependent")}
    assert {tuple(r) for r in drawn.collect()} == {("APOE", "CETP", 0.9), ("APOE", "HLA-DQB1", 0.2)}


def test_matrix_checks_with_metadata_and_examples(spark):
    rows = [("S1", "cg1", 0.21), ("S2", "cg1", None), ("S3", "cg1", 1.2), ("S3", "cg1", 0.5), ("S3", "cg9", 0.0)]
    m = spark.createDataFrame(rows, "sample_id string, cpg string, beta double")
    want, meta = spark.createDataFrame([("cg1",), ("cg3",)], "cpg string"), spark.createDataFrame([("S1",), ("S2",), ("S9",)], "sample_id string")
    got = {r["check"]: (r["n"], r["examples"], r["passed"]) for r in methyl.validate_matrix(m, want, samples=meta, examples=2).collect()}
    assert got == {
        "duplicate_cells": (1, "S3/cg1", False), "missing_features": (1, "cg3", False), "extra_features": (1, "cg9", False), "missing_cells": (1, "S2/cg1", False),
        "out_of_range": (2, "S3/cg1,S3/cg9", False), "matrix_only_samples": (1, "S3", False), "metadata_only_samples": (1, "S9", False),
    }


def test_prepared_variants(spark):
    df = spark.createDataFrame([("chrX", "10", "a", " t , g ", " rs5 "), ("2", "200", "G", "T,C", "none"), (None, "x", "A", "C", None)], "chrom string, pos string, ref string, alt string, rsid string")
    got = [tuple(r) for r in nz.prepare_variants(df).collect()]
    assert got == [("X", 10, "A", "T", "rs5", "X:10:A:T"), ("2", 200, "G", "T", None, "2:200:G:T"), (None, None, "A", "C", None, None)]


def test_exact_quantiles(spark):
    rng = random.Random(9)
    rows = [(g, v) for g, n in (("a", 101), ("b", 1), ("c", 40)) for v in [rng.choice([-2.5, 0.0, 1e-9, 7.0, rng.gauss(0, 1e6)]) for _ in range(n)]] + [("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["x"], r["y"]) for r in stats.exact_quantiles(df, "v", {"x": 0.1, "y": 0.75}, ["g"]).collect()}
    want = {g: tuple(np.quantile([v for h, v in rows if h == g], [0.1, 0.75])) for g in "abc"}
    assert set(got) == set("abc") and all(got[g] == pytest.approx(want[g], rel=1e-12) for g in got)
    assert stats.exact_quantiles(df.limit(0), "v", {"x": 0.5}).first()["x"] is None
