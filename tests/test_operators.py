import glob
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from agewise.functions import normalize as nz
from agewise.functions import scores, stats
from agewise.operators import assoc, eqtl, methyl
from agewise.plans import bindings, files, records, rollups, scans, training  # noqa: F401  (these register their queries)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def _rows(rows):
    return sorted(tuple(f"{v:.5g}" if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", list(bindings.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = bindings.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = duck.execute(bindings.ORACLES[name])
    names = [x[0] for x in got.description]
    assert sorted(names) == cols
    want = [[r[names.index(c)] for c in cols] for r in got.fetchall()]
    assert _rows([[r[c] for c in cols] for r in df.collect()]) == _rows(want)


def test_variant_key_and_rsid(spark):
    df = spark.createDataFrame([("chrX", 10, "a", " t , g ", "  "), ("2", 200, "G", "T,C", "rs0"), (None, 1, "A", "C", "not-an-rsid")], "c string, p long, r string, a string, id string")
    got = df.select(nz.variant_key(F.col("c"), F.col("p"), F.col("r"), F.col("a")), nz.normalize_rsid_strict(F.col("id"))).collect()
    assert [tuple(r) for r in got] == [("X:10:A:T", None), ("2:200:G:T", "rs0"), (None, None)]


def test_composite_of_the_worked_example(spark):
    df = spark.createDataFrame([("HIGH", 25.0, 0.8, 10, 1e-10, 5.0), ("LOW", 0.0, None, 2, 1e-3, 0.0)], "vep string, alphagenome_abs_perc_change double, am double, n long, p double, e double")
    channels = {
        "vep": scores.score_vep_impact(F.col("vep")), "alphagenome": scores.score_alphagenome(df), "alphamissense": scores.score_alphamissense(F.col("am")),
        "gtex": scores.score_gtex_eqtl(F.col("n"), F.col("p")), "epigenetic": scores.score_epigenetic(F.col("e")),
    }
    got = [r[0] for r in df.select(scores.composite_risk(channels)).collect()]
    assert got == pytest.approx([0.75, 0.1189286], abs=1e-6)


def test_sample_risk_keeps_unmatched_dosage(spark):
    g = spark.createDataFrame([("S1", "rs1", 2), ("S1", "rs2", 1), ("S2", "rs1", 0), ("S3", "rs9", 2)], "sample_id string, rsid string, alt_dosage int")
    r = spark.createDataFrame([("rs1", 0.8), ("rs2", 0.2)], "rsid string, risk double")
    got = {x["sample_id"]: x["sample_risk"] for x in eqtl.sample_risk(g, r).collect()}
    assert got == pytest.approx({"S1": 0.6, "S2": 0.0, "S3": 0.0})


def test_halting_join(spark):
    a, b = spark.range(100).withColumnRenamed("id", "eid"), spark.range(97).select(F.col("id").cast("string").alias("eid"))
    with pytest.raises(ValueError):
        assoc.audited_inner_join(a, b, "eid", "eid")
    audit = assoc.join_audit(a, b, "eid", "eid").first()
    assert (audit["left_only"], audit["halted"]) == (3, True) and audit["drop_rate"] == pytest.approx(0.03)


def test_statistics(spark):
    one = spark.range(1)
    fisher = one.select(stats.hypergeom_tail(F.lit(8), F.lit(10), F.lit(9), F.lit(16))).first()[0]
    assert fisher == pytest.approx(280 / 11440, abs=1e-12)  # C(10,8)C(6,1) + C(10,9) of C(16,9)
    p = spark.createDataFrame([(0.01,), (0.04,), (0.03,), (0.2,), (None,)], "p double")
    q = {r["p"]: r["q"] for r in stats.benjamini_hochberg(p, "p", "q").collect()}
    assert q.pop(None) is None
    assert q == pytest.approx({0.01: 0.04, 0.04: 0.16 / 3, 0.03: 0.16 / 3, 0.2: 0.2})
    tail = one.select(stats.chi2_tail(F.lit(3.841459), F.lit(1))).first()[0]
    assert tail == pytest.approx(0.05, abs=1e-6)


def test_missing_policies_and_empty_strata(spark):
    m = spark.createDataFrame([("a", "c1", 0.2), ("b", "c1", math.nan), ("a", "c2", 0.5), ("b", "c2", 0.7)], "sample_id string, cpg string, beta double")
    assert {(r["sample_id"], r["cpg"]): r["beta"] for r in methyl.apply_missing_policy(m, "impute_column_mean").collect()}["b", "c1"] == pytest.approx(0.2)
    assert methyl.apply_missing_policy(m, "drop_sites").count() == 2
    with pytest.raises(ValueError):
        methyl.apply_missing_policy(m, "fail")
    ages = spark.createDataFrame([(35.0, 36.0)], "age double, predicted_age double")
    assert {r["stratum"]: r["n"] for r in methyl.mae_by_stratum(ages).collect()} == {"<30": 0, "30-60": 1, ">60": 0}
