"""Stored curves of one player-match: identities between their columns, and the blended scores."""

import os

import pytest
from pyspark.sql import functions as F

from keystride.functions import scalar as S
from keystride.operators import windows as W
from keystride.operators.ordered import Line
from keystride.plans import jobs
from keystride.sources import curves as C

ROOT = os.path.join(os.path.dirname(__file__), "fixtures")


def read(spark, file):
    d = spark.read.option("header", True).csv(f"{ROOT}/case_a/source/{file}")
    return d.select(*[F.col(c) if c in ("section", "reference", "y_metric", "half") else S.num(F.col(c)).alias(c) for c in d.columns]).withColumn("i", F.monotonically_increasing_id())


def gap(df, *pairs):
    """Largest difference of each pair, and whether nulls agree."""
    row = df.agg(*[F.max(F.abs(F.col(a) - F.col(b))).alias(f"d{i}") for i, (a, b) in enumerate(pairs)], *[F.count_if(F.col(a).isNull() != F.col(b).isNull()).alias(f"n{i}") for i, (a, b) in enumerate(pairs)]).first()
    assert all(row[f"n{i}"] == 0 for i in range(len(pairs)))
    return max(row[f"d{i}"] for i in range(len(pairs)))


@pytest.mark.parametrize("whole", [True, False])
def test_centred_means(spark, whole):
    d = read(spark, "01f_pc_synergy_m_80_1450_timewin.csv")
    out = W.centred_mean(d, Line(("period",), "minute", ("i",), whole), "m", {"a1": 1.0, "a3": 3.0, "a5": 5.0, "a10": 10.0})
    assert out.count() == d.count()
    assert gap(out, ("a1", "m_w1"), ("a3", "m_w3"), ("a5", "m_w5"), ("a10", "m_w10")) < 1e-12


@pytest.mark.parametrize("whole", [True, False])
def test_lead(spark, whole):
    d = read(spark, "03_self_nearest_distance_lead.csv")
    wide = d.groupBy("period", "minute").pivot("reference", ["teammates", "opponents"]).agg(F.max("r"))
    out = W.signed_lead(wide, Line(("period",), "minute", (), whole), {"teammates": "teammates", "opponents": "opponents"})
    both = out.join(d.select("period", "minute", "reference", F.col("C").alias("c0"), F.col("N").alias("n0"), F.col("ma7").alias("m0")), ["period", "minute", "reference"])
    assert both.count() == d.count()
    assert gap(both, ("C", "c0"), ("N", "n0"), ("ma7", "m0")) < 1e-10


def test_probability_composite_and_norms(spark):
    phi = read(spark, "04_speed_roll10_phi.csv").withColumn("p", S.normal_cdf(F.col("roll10_z")))
    assert gap(phi, ("p", "phi_roll10")) < 1e-14
    c = read(spark, "05_pass_shot_quality_w5.csv").withColumn("c0", S.composite(F.col("P"), F.col("w"), F.col("Q")))
    assert gap(c, ("c0", "C")) < 1e-14
    s = read(spark, "06_standing_position.csv")
    s = s.withColumns({"a": S.two_piece_norm(F.col("worst_vulnerability_5min")), "b": S.shift_half(F.col("trailing_median_5min"))})
    assert gap(s, ("a", "worst_vulnerability_5min_norm"), ("b", "trailing_median_5min_norm")) < 1e-14


@pytest.mark.parametrize("whole", [True, False])
def test_blended_scores(spark, whole):
    out = jobs.mix_cases(C.read_curves(spark, ROOT), whole)
    r = out.groupBy("case").agg(
        F.count("*").alias("n"), F.count("cognitive").alias("nc"), F.count("kinematic").alias("nk"), F.avg("cognitive").alias("c"), F.avg("kinematic").alias("k"), F.avg("both").alias("b")
    ).first()
    assert (r.case, r.n, r.nc, r.nk) == ("case_a", 80, 77, 77)
    assert (r.c, r.k, r.b) == pytest.approx((0.663797, 0.586945, 0.624165), abs=1e-6)
