"""Ordered passes, quantiles and scalar functions against plain Python, in both forms."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from keystride.functions import scalar as S
from keystride.operators import fits, quantiles as Q, windows as W
from keystride.operators.ordered import Line, deal, neighbour, part_of, prefix, range_means, range_totals, rows_around, run_starts, settle, short_keys


@pytest.fixture(scope="module")
def data(spark):
    rnd = random.Random(5)
    rows = [(("hot" if rnd.random() < 0.7 else "b"), rnd.randrange(-1280, 3840) / 64, i, rnd.choice([None, rnd.gauss(0, 9)]), rnd.choice("xyz")) for i in range(700)]
    pdf = pd.DataFrame(rows, columns=["k", "t", "i", "v", "lab"])
    df = spark.createDataFrame(rows, "k string, t double, i long, v double, lab string")
    return pdf.sort_values(["k", "t", "i"]), df


LINES = [Line(("k",), "t", ("i",), True), Line(("k",), "t", ("i",))]


def by_id(df, *cols):
    return {r["i"]: tuple(r[c] for c in cols) for r in df.select("i", *cols).collect()}


@pytest.mark.parametrize("line", LINES)
@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("reverse", [True, False])
def test_prefix(data, line, inclusive, reverse):
    pdf, df = data
    kinds = ["sum", "count", "min", "max", "first", "last"]
    got = by_id(prefix(df, line, {k: (k, F.col("v")) for k in kinds}, inclusive=inclusive, reverse=reverse), *kinds)
    for _, g in pdf.groupby("k"):
        g = g[::-1] if reverse else g
        seen = []
        for _, r in g.iterrows():
            if inclusive and r.v == r.v:
                seen.append(r.v)
            want = (sum(seen), len(seen), min(seen), max(seen), seen[0], seen[-1]) if seen else (None, 0, None, None, None, None)
            for a, b in zip(got[r.i], want):
                assert a == b or a == pytest.approx(b)
            if not inclusive and r.v == r.v:
                seen.append(r.v)


@pytest.mark.parametrize("line", LINES)
def test_neighbours_and_frames(data, line):
    pdf, df = data
    d = neighbour(df, line, {"p": F.col("v"), "pi": F.col("i")})
    d = neighbour(d, line, {"n": F.col("i")}, following=True)
    d = rows_around(d, line, 4, 2, lambda p, w: p.withColumn("s", F.sum("i").over(w.rowsBetween(-4, 2))), chunk=7)
    d = range_totals(d, line, {"i": F.col("i")}, {"r": (2.5, 1.0)}).withColumnRenamed("r_i", "r")
    got = by_id(d, "p", "pi", "n", "s", "r")
    assert len(got) == len(pdf)
    for _, g in pdf.groupby("k"):
        ids, ts, vs = g.i.tolist(), g.t.to_numpy(), g.v.tolist()
        for j, i in enumerate(ids):
            p, pi, n, s, r = got[i]
            assert pi == (ids[j - 1] if j else None) and n == (ids[j + 1] if j + 1 < len(ids) else None)
            assert p == (vs[j - 1] if j and vs[j - 1] == vs[j - 1] else None)
            assert s == sum(ids[max(0, j - 4) : j + 3])
            near = (ts >= ts[j] - 2.5) & (ts <= ts[j] + 1.0)
            assert r == np.array(ids)[near].sum()


def test_one_key_fills_all_partitions(spark):
    """All rows of one key, most of them at one time: parts are even, shrink as partitions grow, and follow row order."""
    df = spark.range(4000).select(F.lit("hot").alias("k"), F.when(F.col("id") < 3000, 7.0).otherwise(F.col("id") / 8.0).alias("t"), F.col("id").alias("i"))
    line, before = Line(("k",), "t", ("i",)), spark.conf.get("spark.sql.shuffle.partitions")
    largest = []
    try:
        for n in (4, 16):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            d = deal(df, line)
            assert deal(d, line.by("more")) is d  # dealt once for all finer lines
            parts = d.groupBy(part_of(d, line)).agg(F.count("*").alias("n"), F.min(F.struct("t", "i")).alias("lo"), F.max(F.struct("t", "i")).alias("hi")).orderBy(part_of(d, line)).collect()
            assert len(parts) == n and sum(p.n for p in parts) == 4000
            assert all(a.hi < b.lo for a, b in zip(parts, parts[1:]))
            largest.append(max(p.n for p in parts))
            # what a task of a pass holds is one key's rows of one part
            out = prefix(d, line, {"c": ("count", F.lit(1))})
            assert "__part" in out._jdf.queryExecution().optimizedPlan().toString() and out.agg(F.max("c")).first()[0] == 4000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert largest[0] < 1500 and largest[1] < largest[0] / 2


@pytest.mark.parametrize("line", LINES)
def test_means_and_median_of_time_frames(spark, data, line):
    pdf, df = data
    df = df.withColumn("v", F.when(F.col("i") % 11 == 0, float("nan")).when(F.col("i") % 3 == 0, 5.0).otherwise(F.col("v"))).withColumn("t", F.when(F.col("i") != 50, F.col("t")))
    pdf = df.toPandas().sort_values(["k", "t", "i"])
    got = by_id(W.centred_median(range_means(df, line, "v", {"a": (1.0, 1.0), "b": (4.0, 0.5)}), line, "v", "med", 6.0, buckets=5), "a", "b", "med")
    assert got[50] == (None, None, None)
    for _, g in pdf[pdf.i != 50].groupby("k"):
        ts, vs = g.t.to_numpy(), g.v.to_numpy(float)
        for i, t in zip(g.i, ts):
            for x, f, lo, hi in zip(got[i], (np.mean, np.mean, np.median), (1.0, 4.0, 3.0), (1.0, 0.5, 3.0)):
                near = vs[(ts >= t - lo) & (ts <= t + hi)]
                near = near[~np.isnan(near)]
                assert x is None if not len(near) else x == pytest.approx(f(near), abs=1e-12)


def test_means_keep_their_digits(spark):
    """A short frame after a long run of large values."""
    df = spark.range(3000).select(F.lit(1).alias("k"), F.col("id").cast("double").alias("t"), F.when(F.col("id") < 2990, 1e8 / 3).otherwise(F.col("id") / 1e4).alias("v"))
    for line in (Line(("k",), "t"), Line(("k",), "t", (), True)):
        got = range_means(df, line, "v", {"m": (1.0, 1.0)}).where("t = 2997").first().m
        assert got == pytest.approx(0.2997, rel=1e-13)


@pytest.mark.parametrize("line", LINES)
def test_run_starts(data, line):
    pdf, df = data
    got = by_id(run_starts(df, line, F.col("lab")), "run")
    for _, g in pdf.groupby("k"):
        run = (g.lab != g.lab.shift()).cumsum()
        assert [got[i][0] for i in g.i] == run.tolist()


def test_quantiles_keep_groups_without_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None)], "k string, v double")
    for bounded in (True, False):
        assert sorted(map(tuple, Q.quantiles(df, ["k"], F.col("v"), {"q": 0.5}, bounded=bounded).collect())) == [("a", 2.0), ("b", None)]


@pytest.mark.parametrize("bounded", [True, False])
def test_quantiles(data, bounded):
    pdf, df = data
    got = {r.k: r for r in Q.quantiles(df, ["k"], F.col("v"), {"a": 0.1, "m": 0.5, "z": 1.0}, bounded=bounded).collect()}
    for k, g in pdf.groupby("k"):
        v = g.v.dropna()
        assert (got[k].a, got[k].m, got[k].z) == pytest.approx((v.quantile(0.1), v.median(), v.max()))
    whole = Q.quantiles(df, [], F.col("v"), {"m": 0.5}, bounded=bounded).collect()[0].m
    assert whole == pytest.approx(pdf.v.median())


def test_share_at_or_below(data):
    pdf, df = data
    df = df.withColumn("q", F.round("v"))
    got = by_id(Q.share_at_or_below(df, ["k"], "q", "s"), "q", "s")
    for _, g in pdf.groupby("k"):
        v = np.array([got[i][0] for i in g.i if got[i][0] is not None])
        for i in g.i:
            q, s = got[i]
            assert s is None if q is None else s == pytest.approx(100 * (v <= q).mean())


def test_normal_cdf(spark):
    zs = [-40.0, -9.0, -7.5, -7.0, -3.2, -1.0, 0.0, 0.4, 2.5, 6.9, 7.2, 12.0, 39.0, None]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select("z", S.normal_cdf(F.col("z")).alias("p")).collect()
    for z, p in got:
        assert p is None if z is None else p == pytest.approx(0.5 * math.erfc(-z / math.sqrt(2)), abs=5e-15)


def test_nulls_survive_clipping(spark):
    r = spark.sql("SELECT cast(null AS double) AS x").select(
        S.clip_unit(F.col("x"), 350.0).alias("a"), S.two_piece_norm(F.col("x")).alias("b"), S.shift_half(F.col("x")).alias("c"), S.angle_unit(F.col("x")).alias("d")
    ).first()
    assert tuple(r) == (None,) * 4


def local_line(x, y, frac=0.5):
    n = len(x)
    k = int(min(1.0, max(frac, 3.0 / n)) * n + 1e-10)
    out = []
    for at in x:
        d = np.abs(x - at)
        h = np.sort(d)[k - 1]
        w = np.where(d < h, (1 - (d / h) ** 3) ** 3, 0.0)
        b, a = np.polyfit(x - at, y, 1, w=np.sqrt(w)) if (w > 0).sum() > 1 else (0, np.average(y, weights=w))
        out.append(a)
    return np.array(out)


def test_lowess_against_weighted_polyfit(spark):
    rng = np.random.default_rng(3)
    x = np.sort(rng.choice(np.arange(1, 46), 30, replace=False)).astype(float)
    y = rng.normal(size=30)
    rows = [("a", float(a), float(b)) for a, b in zip(x, y)] + [("a", 50.0, None), ("few", 1.0, 1.0), ("few", 2.0, 5.0)]
    got = fits.lowess(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", {"f": "y"}).toPandas()
    a = got[(got.k == "a") & got.y.notna()].sort_values("x")
    assert a.f.to_numpy() == pytest.approx(local_line(x, y), abs=1e-9)
    assert got[(got.k == "few") | got.y.isna()].f.isna().all()


def test_lowess_takes_minute_series_only(spark):
    df = spark.range(200).select((F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("x"), F.lit(1.0).alias("y"))
    assert fits.lowess(df, ["k"], "x", {"f": "y"}, most=100).where("abs(f - 1) < 1e-9").count() == 200
    with pytest.raises(Exception, match="at most 99 rows"):
        fits.lowess(df, ["k"], "x", {"f": "y"}, most=99).collect()


def test_rolling_line_gates(spark):
    """Too few rows, too small a range, unusable rows between, restart at the period."""
    xs = [(1, 1, None, 5.0), (1, 2, 10.0, 5.0), (1, 3, 12.0, 6.0), (1, 4, None, 9.0), (1, 5, 40.0, 9.0), (1, 6, -1.0, 9.0), (1, 7, 41.0, 2.0), (2, 8, 90.0, 1.0)]
    df = spark.createDataFrame([("e", p, float(t), x, y) for p, t, x, y in xs], "k string, p int, t double, x double, y double")
    for whole in (True, False):
        r = fits.rolling_line(df, Line(("k", "p"), "t", (), whole), "x", "y", table_keys=["k"], rows=3, min_rows=2, min_range=20.0, s_x=2.0, s_y=1.0, x_ref=10.0)
        r = {int(x.t): x for x in r.collect()}
        assert [r[t].roll_method for t in range(1, 9)] == [None, "too_few", "x_range", None, "ols", None, "ols", "too_few"]
        b, a = np.polyfit([10, 12, 40], [5, 6, 9], 1)
        assert (r[5].roll_slope, r[5].roll_H) == pytest.approx((b, a + 10 * b))
        assert r[5].roll_A == pytest.approx((math.atan(2 * b) + math.pi / 2) / math.pi)
        assert r[7].roll_n == 3


def test_window_step():
    assert W.step_for(3.0, 60.0) == 2.0
    with pytest.raises(ValueError):
        W.step_for(1.0, 90.0)
    assert W.heat_scale("half")[1] == 56 and W.heat_scale("tight")[0] == {"jerk_use": 2.0}


def test_short_keys_are_windows_in_large_tables(spark):
    """What decides is the largest key, not the size of the table."""
    df = spark.range(90).select((F.col("id") % 9).alias("k"), F.col("id").cast("double").alias("t"))
    line = Line(("k",), "t")
    for rows, whole in ((10, True), (9, False)):
        spark.conf.set("spark.keystride.keyRows", str(rows))
        try:
            d, settled = settle(df, line)
            table = short_keys(df, [])
        finally:
            spark.conf.unset("spark.keystride.keyRows")
        assert settled.whole == whole and (part_of(d, line) is None) == whole and not table


def test_median_of_short_and_long_frames(spark, monkeypatch):
    from keystride.operators import windows as W

    rows = [(k, i * 0.7 if i % 9 else None, None if i % 5 == 0 else float("nan") if i % 7 == 0 else float(i * 37 % 11), i) for k in (1, 2) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, t double, v double, i int")
    got = []
    for most in (200, 0):
        monkeypatch.setattr(W, "FRAME_ROWS", most)
        got.append({(r.k, r.i): r.med for r in W.centred_median(df, Line(("k",), "t", ("i",)), "v", "med", 6.0).collect()})
    assert got[0] == got[1] and len(got[0]) == 120 and sum(v is None for v in got[0].values()) == 14
