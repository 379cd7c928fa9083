"""Sliding windows from panes, missing windows and their edge cases against loops over rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from keystride.operators import joins as J, ordered as O, windows as W


def test_pane_width():
    assert [float(W.pane_width(*x)) for x in ((3.0, 2.0), (0.5, 1.0, 3.0), (0.7, 0.3), (4.0, 8.0), (2.5, 1.0))] == [1.0, 0.5, 0.1, 1.0, 0.5]


@pytest.mark.parametrize("wins, step", [((3.0,), 2.0), ((0.5, 2.0), 0.5), ((0.7,), 0.3), ((4.0, 6.0), 4.0)])
def test_windows_from_panes(spark, wins, step):
    rng = np.random.default_rng(4)
    rows = [(k, float(t), None if rng.random() < 0.1 else float(v)) for k in ("a", "b") for t, v in zip(np.round(rng.uniform(-3.3, 17, 300), 1), rng.normal(size=300))]
    rows += [("a", 2.1, 5.0)] * 40 + [("a", None, 1.0), ("c", 4.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, t double, v double")
    aggs = {"top": ("max", F.col("v")), "low": ("min", F.col("v")), "total": ("sum", F.col("v")), "n": ("count", F.col("v")), "mean": ("mean", F.col("v"))}
    got = {(r.k, r.win_min, round(r.t0, 6)): r for r in W.window_aggregate(df, ["k"], "t", aggs, list(wins), step, 3).collect()}
    want = {}
    for k in ("a", "b", "c"):
        ts = np.array([t for q, t, _ in rows if q == k and t is not None])
        vs = np.array([np.nan if v is None else v for q, t, v in rows if q == k and t is not None])
        for w in wins:
            i, lo = 0, np.floor(ts.min())
            while lo + i * step <= ts.max() - w + 1e-9:
                inside = (np.round(ts - lo - i * step, 6) >= 0) & (np.round(ts - lo - i * step - w, 6) < 0)
                if inside.sum() >= 3:
                    want[k, w, round(lo + i * step, 6)] = (inside.sum(), vs[inside])
                i += 1
    assert got.keys() == want.keys() and len(want) > 5
    for key, (n, v) in want.items():
        r, v = got[key], v[~np.isnan(v)]
        assert (r.n_frames, r.n) == (n, len(v))
        assert (r.top, r.low, r.total, r.mean) == pytest.approx((v.max(), v.min(), v.sum(), v.mean()))


def test_windows_without_any_class(spark):
    rows = [(1, t / 10, None if t < 40 else "IN_POSSESSION") for t in range(80)]
    got = W.label_proportions(spark.createDataFrame(rows, "k int, t double, c string"), ["k"], "t", "c", 2.0, 2.0, 2).orderBy("t0").collect()
    assert [(r.t0, r.p_ip, r.p_max, r.poss_class) for r in got] == [(0.0, 0.0, 0.0, "DEAD_OR_UNRESOLVED"), (2.0, 0.0, 0.0, "DEAD_OR_UNRESOLVED"), (4.0, 1.0, 1.0, "IN_POSSESSION")]


def test_missing_windows(spark):
    rows = [("m", p, "t", t / 10, 1.0, 1.0, 1.0, 0.1) for p in "abc" for t in range(80) if p != "c" or t < 20]
    df = spark.createDataFrame(rows, "m string, p string, team string, t double, speed double, acc_use double, jerk_use double, step_dist double")
    peers = W.peer_percentiles(df, ["m"], "p", "team", "t", 2.0, 2.0, 10)
    everyone = df.select("m", "p").unionByName(spark.createDataFrame([("m", "never"), ("other", "x")], "m string, p string"))
    got = {(r.m, r.p): (r.n_windows, r.focal_missing, r.short_team) for r in W.presence_by_player(peers, everyone, ["m"], "p").collect()}
    assert got == {("m", "a"): (3, 0, 3), ("m", "b"): (3, 0, 3), ("m", "c"): (1, 2, 1), ("m", "never"): (0, 3, 0), ("other", "x"): (0, 0, 0)}
    assert {r.mean_speed_all_pct for r in peers.collect()} == {100.0}  # all equal


def test_passes_without_receiver_are_left_out(spark):
    passes = spark.createDataFrame([(1, 10, 5.0, 7), (1, 11, 5.0, None)], "m int, i int, t double, rc int")
    otb = spark.createDataFrame([(1, 6.0, 8), (1, 7.0, 7)], "m int, t0 double, p int")
    got = J.pass_handoffs(passes, otb, ["m"], "i", "t", "rc", "t0", "p").collect()
    assert [(r.i, r.next_player, r.gap_s, r.receiver_match) for r in got] == [(10, 7, 2.0, True)]


def test_small_tables_are_not_dealt(spark, sized, tmp_path):
    line = O.Line(("k",), "t")
    spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("t")).write.parquet(str(tmp_path / "x"))
    df = spark.read.parquet(str(tmp_path / "x"))
    assert O.settle(df, line) == (df, line.bounded())
    spark.conf.set("spark.keystride.oneTaskBytes", "100")
    d, same = O.settle(df, line)
    assert same == line and O.part_of(d, line)


def test_level_lines_cross_nothing(spark):
    from keystride.operators import fits

    line = O.Line(("k", "p"), "t")
    rows = [(1, 1, float(i), 5, 3, 20.0, "y", a, 0.0) for i, a in enumerate((0.5, 0.5 + 1e-16 * 3, 0.5 - 1e-16, 0.6, 0.4))]
    d = spark.createDataFrame(rows, "k int, p int, t double, n_window int, min_n int, min_x_s double, y_metric string, roll_A double, roll_theta_deg double")
    # on it three times, then above, then below
    assert [r.n_cross_half for r in fits.sweep_summary(d, line, O.Line(("k",), "t")).collect()] == [2]


def test_heat_cells_at_nine_decimals(spark):
    from keystride.plans import jobs

    rows = [(1, 1, 1, i, float(i), v, v, v, v) for i, v in enumerate((0.25, 0.25 - 2**-54, 0.25 + 2**-52, 9.0))]
    panel = spark.createDataFrame(rows, "match_id int, player_id int, period int, frameNum int, periodGameClockTime double, speed double, acc_use double, jerk_use double, step_dist double")
    heat = jobs.player_report(panel.withColumn("video_time_s", F.col("periodGameClockTime")), heat_s=(3.0, 3.0))["heat"].where("n > 0")
    assert {(r.metric, r.bin, r.n) for r in heat.collect()} == {("speed", 1, 3), ("acc_use", 2, 3), ("jerk_use", 1, 3), ("distance_1s", 1, 3)}


def test_same_values_tie_in_any_order(spark):
    """Means of the same values in another order rank alike, and no value leaves its cell by its last digit."""
    a, b = (0.1, 0.2, 0.3), (0.3, 0.2, 0.1)
    assert (a[0] + a[1]) + a[2] != (b[0] + b[1]) + b[2]
    rows = [("m", p, "t", 0.1 + i / 10, v, v, v, v) for p, vs in (("a", a), ("b", b)) for i, v in enumerate(vs)] + [("m", "z", "t", 2.0, 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "m string, p string, team string, t double, speed double, acc_use double, jerk_use double, step_dist double").coalesce(1)
    got = W.peer_percentiles(df, ["m"], "p", "team", "t", 1.0, 1.0, 2, digits=9).collect()
    assert {(r.p, r.mean_speed_all_pct, r.total_distance_team_pct) for r in got} == {(p, 100.0, 100.0) for p in "ab"}


def test_summary_sql_takes_unrounded_scores():
    from keystride.catalog import reports as R

    assert "round(" not in R.SCORES and R.SCORES.count(" AS phi_roll10 FROM") == 1


def test_setting_table_writes_no_fits(spark, sized, tmp_path, monkeypatch):
    """The table of settings equals the summary of its fits, which are neither written nor sent where keys are short."""
    from keystride import catalog
    from keystride.operators import fits

    rng = np.random.default_rng(7)
    rows = [(k, int(i > 20), float(i // 2), i, float(rng.integers(-3, 90)), None if i % 5 == k % 5 else float(rng.integers(0, 4)), float(rng.normal())) for k in range(9) for i in range(40)]
    rows += [(9, 0, 0.0, 0, 5.0, 1.0, None), (10, 0, 0.0, 0, -1.0, 1.0, 1.0)]
    spark.createDataFrame(rows, "k int, p int, t double, i int, x double, y double, z double").write.parquet(str(tmp_path / "x"))
    df = spark.read.parquet(str(tmp_path / "x"))
    line, by_key = O.Line(("k", "p"), "t", ("i",)), O.Line(("k",), "t", ("i",))
    args = (df, line, by_key, "x", {"y": 2.0, "z": 1.0}, 20.0, ((3, 2, 5.0), (5, 3, 20.0), (4, 4, 500.0)))
    want = fits.sweep_summary(fits.setting_sweep(df, line, *args[3:]), line, by_key)

    def no(*_):
        raise AssertionError("fits are written")

    with monkeypatch.context() as m:
        m.setattr(fits, "stage", no)
        m.setattr(O, "written", no)
        got = fits.setting_table(*args)
        catalog.load()["a10_setting_sweep"][0](spark, "/root/testdata/sf0.001")
    assert got.columns == want.columns and got._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    order = ["k", "n_window", "min_x_s", "y_metric"]
    got, want = got.orderBy(*order).collect(), want.orderBy(*order).collect()
    assert len(got) == len(want) == 9 * 6 + 3 and {r.n_fit for r in got if r.n_window == 4} == {0}
    for g, w in zip(got, want):
        assert tuple(g) == pytest.approx(tuple(w), nan_ok=True)
    # a key of more fits than one task may hold goes the other way
    spark.conf.set("spark.keystride.oneTaskBytes", "100")
    spark.conf.set("spark.keystride.keyRows", "100")
    try:
        assert not O.short_keys(df, ["k"], 3) and O.short_keys(df, ["k"])
        dealt = fits.setting_table(*args).orderBy(*order).collect()
    finally:
        spark.conf.unset("spark.keystride.keyRows")
    assert [tuple(r)[:6] for r in dealt] == [tuple(r)[:6] for r in want]


def test_decimals_as_sql_takes_them(spark):
    import duckdb

    from keystride.functions import scalar as S

    x = [4126.6680238875, 4219.4511117375, 2093.0161996125, 0.5e-9, -2.5e-9, -4126.6680238875, 1e305, float("inf"), 1.25, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").coalesce(1).select(S.at_digits(F.col("x"), 9)).collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 9)", [v]).fetchone()[0] for v in x]


def test_rows_on_a_window_border(spark):
    """Rows whole steps after the first one: windows are those of a loop in doubles, as SQL's ``lo + i * step``."""
    rng = np.random.default_rng(3)
    rows = [(k, round(lo + 900.0 * i, 9), 1.0) for k, lo in enumerate(np.round(rng.uniform(0, 700, 300), 9).tolist()) for i in range(k % 4 + 1)]
    df = spark.createDataFrame(rows, "k int, t double, v double")
    for win, step in ((900.0, 900.0), (1800.0, 900.0), (900.0, 450.0)):
        got = {(r.k, r.t_centre): r.n for r in W.sliding_histogram(df, ["k"], "t", "v", 10.0, 1, win, step).where("n > 0").collect()}
        want = {}
        for k in range(300):
            ts = [t for q, t, _ in rows if q == k]
            lo, hi = min(ts), max(ts)
            for i in range(12):
                t0 = lo + i * step
                n = sum(t0 <= t < t0 + win for t in ts)
                if t0 < (hi if win == step else hi - win + step) and n:
                    want[k, t0 + win / 2] = n
        assert got == want


def test_large_values_tie_in_any_order(spark):
    """Where nine decimals of a double depend on the order of its sum, the same values tie all the same."""
    a = (0.23, 1e8 / 3, 0.711, 1e8 / 7 + 10)
    b = tuple(reversed(a))
    assert round(((a[0] + a[1]) + a[2]) + a[3], 9) != round(((b[0] + b[1]) + b[2]) + b[3], 9)
    rows = [("m", p, "t", 0.1 + i / 10, v, v, v, v) for p, vs in (("a", a), ("b", b)) for i, v in enumerate(vs)]
    rows += [("m", "z", "t", 2.0, 0.0, 0.0, 0.0, 0.0)] + [("m", "n", "t", 0.3, 1.0, None, 1e300, None)] * 2
    df = spark.createDataFrame(rows, "m string, p string, team string, t double, speed double, acc_use double, jerk_use double, step_dist double").coalesce(1)
    got = {r.p: r for r in W.peer_percentiles(df, ["m"], "p", "team", "t", 1.0, 1.0, 2, digits=9).collect()}
    for m in ("mean_acc", "mean_jerk", "total_distance"):
        assert got["a"][f"{m}_all_pct"] == got["b"][f"{m}_all_pct"]
    assert got["a"].mean_acc_all_pct == 100.0 and got["n"].mean_acc_all_pct is None and got["n"].mean_jerk_all_pct == 100.0
    sums = W.window_aggregate(df, ["m"], "t", {n: (n, F.col("step_dist")) for n in ("exact_sum", "exact_mean")}, 1.0, 1.0, 2, within=("p",))
    sums = {r.p: (r.exact_sum, r.exact_mean) for r in sums.collect()}
    assert sums["a"] == sums["b"] == (pytest.approx(sum(a), rel=1e-15), pytest.approx(sum(a) / 4, rel=1e-15)) and sums["n"] == (None, None)
