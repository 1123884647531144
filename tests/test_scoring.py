from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from keelson.operators import rollup, scoring, weights
from keelson.plans.fixtures import occurrence

# version, ecosystem, deprecated, cvss tenths, count, staleness, points, penalty
GOLDEN = [
    ("v2", "npm", True, None, 0, 0, ("27.20", "0.00", "0.00", "0.00"), "27.20"),
    ("v2", "npm", False, None, 1, 0, ("0.00", "24.15", "1.57", "0.00"), "25.72"),
    ("v2", "pypi", False, None, 1, 0, ("0.00", "26.19", "1.57", "0.00"), "27.76"),
    ("v1", "npm", False, 98, 2, None, ("0.00", "30.49", "3.56", None), "34.05"),
    ("v1", "npm", True, 100, 40, 4000, ("46.00", "28.00", "16.00", "10.00"), "100.00"),
    ("v1", "npm", False, None, 0, 730, ("0.00", "0.00", "0.00", "6.67"), "6.67"),
    ("v1", "npm", False, None, 0, 729, ("0.00", "0.00", "0.00", "6.66"), "6.66"),
    ("v2", "pypi", True, 75, 3, None, ("21.86", "45.09", "5.41", None), "72.36"),
    ("v0_equal", "npm", False, 0, 1, 1095, ("0.00", "0.00", "2.50", "25.00"), "27.50"),
]
SCHEMA = "n int, v string, ecosystem string, is_deprecated boolean, cvss_tenths int, vulnerability_count int, staleness_days int, is_unassessable boolean"


def test_golden_scores(spark):
    rows = [(n, *g[:6], False) for n, g in enumerate(GOLDEN)]
    got = scoring.score_occurrences(spark.createDataFrame(rows, SCHEMA), F.col("v")).orderBy("n").collect()
    for row, (*_, points, penalty) in zip(got, GOLDEN, strict=True):
        assert [row[f"points_{s}"] for s in weights.SIGNALS] == [None if p is None else D(p) for p in points]
        assert row["penalty"] == D(penalty) and row["score"] == 100 - D(penalty)


def test_unknown_ecosystem_fails(spark):
    frame = spark.createDataFrame([(1, "v2", "cargo", False, None, 0, 0, False)], SCHEMA)
    with pytest.raises(Exception, match="no weights"):
        scoring.score_occurrences(frame, F.col("v")).collect()


def test_roll_up(spark):
    groups = {1: ["50.01", "25.01", "10.00"], 2: ["100.00"] * 25, 3: ["20.00"], 4: ["50.00"], 5: ["50.01"]}
    rows = [(scan, n, D(p)) for scan, ps in groups.items() for n, p in enumerate(ps)]
    scored = spark.createDataFrame(rows, "scan_id int, part_id int, penalty decimal(5,2)").withColumn("used_version", F.lit("v2"))
    got = {r[0]: r[1] for r in rollup.ranked_points(scored, "part_id").groupBy("scan_id").agg(F.sum("points")).collect()}
    assert got == {1: D("65.02"), 2: D("200.00"), 3: D("20.00"), 4: D("50.00"), 5: D("50.01")}


def test_fixture_classes(spark):
    rows = occurrence(spark, "/root/testdata/sf0.01")
    row = rows.agg(
        F.count("*"), F.count_if("is_unassessable"), F.count_if("is_deprecated"), F.count_if(F.col("deprecation_reason") == ""), F.count_if(F.col("vulnerability_count") > 0),
        F.count_if((F.col("vulnerability_count") > 0) & F.col("cvss_tenths").isNull()), F.count_if(F.col("staleness_days").isNull()), F.count_if(F.col("staleness_days") >= 730), F.count_if(F.col("vulnerability_count") > 10), F.count_if(F.col("cvss_tenths") == 50),
    ).first()
    assert tuple(row) == (60000, 4277, 4225, 1384, 17050, 2472, 8662, 37718, 4871, 111)


def test_empty_scan_is_safe(spark):
    scans = spark.createDataFrame([(1, "v2")], "scan_id long, used_version string")
    none = occurrence(spark, "/root/testdata/sf0.001").where("scan_id < 0")
    row = rollup.roll_up(scans, none).first()
    assert (row["score"], row["classification"], row["assessed_count"]) == (D("100.00"), "safe", 0)


def test_weight_checks():
    good = {"version": "x", "weights": {e: dict.fromkeys(weights.SIGNALS, "0.25") for e in weights.ECOSYSTEMS}, "caps": {"count": 10, "staleness_days": 1095}, "stale_flag_days": 730, "thresholds": {"safe_min": 80, "medium_min": 50}, "rollup": {"decay": "0.5", "max_terms": 20}, "epss": {"enabled": False, "weight": "0"}}
    assert weights.parse(good, "x").max_terms == 20
    for broken in ({"version": "y"}, {"thresholds": {"safe_min": 50, "medium_min": 80}}, {"rollup": {"decay": "1.5", "max_terms": 20}}, {"epss": {"enabled": False, "weight": "0.1"}}, {"weights": {"npm": good["weights"]["npm"]}}):
        with pytest.raises(weights.WeightsError):
            weights.parse(good | broken, "x")
    with pytest.raises(weights.WeightsError):
        weights.load("missing")
