"""Event and possession operators against short step-by-step loops on random and hand-made rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from keystride.functions import scalar as S
from keystride.operators import events as E, possession as P
from keystride.operators.ordered import Line

NAN = float("nan")


def known(v):
    return v is not None


def hysteresis_loop(v, low, high):
    """Events as (first, last) index, walking row by row."""
    out, i, n = [], 0, len(v)
    while i < n - 1:
        if not (known(v[i]) and known(v[i + 1]) and v[i] < low <= v[i + 1]):
            i += 1
            continue
        first, last, top = i + 1, None, False
        for j in range(first, n - 1):
            top = top or (known(v[j + 1]) and v[j + 1] >= high)
            if known(v[j]) and known(v[j + 1]) and v[j] >= low > v[j + 1]:
                last = j
                break
        if last is None:
            if not (top and known(v[-1]) and v[-1] >= low):
                i = first
                continue
            last = n - 1
        if top and sum(known(x) for x in v[first : last + 1]) >= 3:
            out.append((first, last))
        i = last + 1
    return out


HAND = {
    "start above high": [0, 9, 6, 6, 0],
    "null inside": [0, 6, None, 9, 6, None, 0, 0],
    "open at the end": [0, 6, 9, 7],
    "open but low at the end": [0, 6, 9, 7, None],
    "two samples": [0, 6, 9, 0],
    "dip between highs": [0, 6, 9, 6, 9, 6, 0],
    "null hides the fall": [0, 6, 9, 7, None, 0, 6, 6, 9, 6, 0],
}


@pytest.mark.parametrize("whole", [True, False])
def test_hysteresis(spark, whole):
    rnd = random.Random(2)
    cases = dict(HAND)
    for c in range(60):
        cases[f"r{c}"] = [rnd.choice([None, rnd.randint(0, 10), rnd.randint(0, 10), rnd.randint(3, 10)]) for _ in range(rnd.randint(1, 30))]
    rows = [(k, float(i), None if x is None else float(x)) for k, v in cases.items() for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "k string, t double, v double").withColumns({"t_low": F.lit(5.0), "t_high": F.lit(8.0), "z": F.lit(1.0)})
    ev = E.hysteresis_events(df, Line(("k",), "t", (), whole), "v", clock="t", step="z", acc="z", jerk="z").collect()
    got = sorted((r.k, int(r.start_time_s), int(r.end_time_s)) for r in ev)
    assert got == sorted((k, a, b) for k, v in cases.items() for a, b in hysteresis_loop(v, 5, 8))
    for r in ev:
        v = cases[r.k][int(r.start_time_s) : int(r.end_time_s) + 1]
        top = max(x for x in v if known(x))
        assert (r.peak_speed, r.n_samples) == (top, sum(map(known, v)))
        assert r.peak_time_s == r.start_time_s + v.index(top)


@pytest.mark.parametrize("whole", [True, False])
def test_merge_close(spark, whole):
    """Gap 0, just under and at the limit, a chain of three, and the period border."""
    ev = [(1, 0.0, 2.0), (1, 2.0, 3.0), (1, 4.2, 5.0), (1, 6.25, 7.0), (2, 7.5, 8.0), (2, 8.5, 9.0), (2, 9.9, 10.5)]
    df = spark.createDataFrame(ev, "p int, start_time_s double, end_time_s double")
    got = E.merge_clusters(df, Line(("p",), "t", (), whole), 1.25).collect()
    assert sorted((r.p, r._c0, r._c1, r.n_atoms) for r in got) == [(1, 0.0, 5.0, 3), (1, 6.25, 7.0, 1), (2, 7.5, 10.5, 3)]


def span_loop(otb, dead, t_min, respect=True):
    """Spans by walking the intervals: (t0, t1, label)."""
    rows, cur, prev_end = [], None, None
    if t_min is not None and t_min < otb[0][0] and dead and dead[0] <= otb[0][0]:
        rows.append((t_min, otb[0][0], "DEAD"))

    def close(t1):
        if t1 > cur["t0"]:
            rows.append((cur["t0"], t1, cur["team"]))

    for t0, t1, team, seq in otb:
        if cur:
            marks = [m for m in dead if cur["t0"] < m < t0]
            if marks:
                close(marks[0])
                rows.append((marks[0], t0, "DEAD"))
                cur = None
            elif cur["team"] != team:
                close(t0)
                cur = None
            elif respect and cur["seq"] is not None and seq is not None and cur["seq"] != seq:
                close(min(prev_end, t0))
                cur = None
        if cur is None:
            cur = {"team": team, "t0": t0, "seq": seq}
        elif cur["seq"] is None and seq is not None:
            cur["seq"] = seq
        prev_end = t1
    end = max(o[1] for o in otb)
    marks = [m for m in dead if cur["t0"] < m < end]
    close(marks[0] if marks else end)
    if marks:
        rows.append((marks[0], end, "DEAD"))
    rows.sort()
    merged = [list(rows[0])]
    for r in rows[1:]:
        if r[2] == merged[-1][2] and abs(r[0] - merged[-1][1]) < 1e-6:
            merged[-1][1] = r[1]
        else:
            merged.append(list(r))
    return [tuple(r) for r in merged]


@pytest.mark.parametrize("whole", [True, False])
@pytest.mark.parametrize("respect", [True, False])
def test_spans(spark, whole, respect):
    rnd = random.Random(8)
    matches, ticks = {}, 0
    for m in range(60):
        starts = sorted(rnd.sample(range(2, 120), rnd.randint(1, 25)))
        otb = [(s / 4, s / 4 + rnd.choice([0.25, 1.0, 3.0]), rnd.choice(["FOCAL", "FOCAL", "OPP"]), rnd.choice([None, 1, 1, 2])) for s in starts]
        # some markers sit exactly on an interval's start, never on two neighbouring ones
        dead = sorted({rnd.randint(0, 130) / 4 + rnd.choice([0.1, 0.1, 0.0]) for _ in range(rnd.randint(0, 6))})
        on = [i for i, o in enumerate(otb) if o[0] in dead]
        dead = [x for x in dead if not any(otb[i][0] == x and i - 1 in on for i in on)]
        ticks += sum(x in {o[0] for o in otb} for x in dead)
        matches[m] = (otb, dead)
    assert ticks > 5
    o = [(m, i, *r) for m, (otb, _) in matches.items() for i, r in enumerate(otb)]
    o = spark.createDataFrame(o, "m int, i int, t0 double, t1 double, label string, sequence int").withColumn("how", F.lit("team_id"))
    d = spark.createDataFrame([(m, x) for m, (_, dead) in matches.items() for x in dead], "m int, t_dead double")
    lim = spark.createDataFrame([(m, 0.0, None) for m in matches], "m int, t_min double, t_max double")
    got = P.possession_spans(o, d, ["m"], "i", whole=whole, limits=lim, respect_sequence=respect).collect()
    for m, (otb, dead) in matches.items():
        mine = sorted((r.t0, r.t1, r.team_possession) for r in got if r.m == m)
        assert mine == span_loop(otb, dead, 0.0, respect), m


def carry_loop(frames):
    last, out = "UNRESOLVED", []
    for dead, control, fallback in frames:
        if dead:
            last = "DEAD"
            out.append("DEAD")
        elif control:
            last = control
            out.append(last)
        elif last in ("FOCAL", "OPP"):
            out.append(last)
        elif fallback in ("FOCAL", "OPP", "DEAD"):
            last = fallback
            out.append(last)
        else:
            out.append("UNRESOLVED")
    return out


@pytest.mark.parametrize("whole", [True, False])
def test_carry(spark, whole):
    rnd = random.Random(4)
    cases = {c: [(rnd.random() < 0.15, rnd.choice([None, None, None, "FOCAL", "OPP"]), rnd.choice(["FOCAL", "OPP", "DEAD", "UNRESOLVED"])) for _ in range(40)] for c in range(40)}
    rows = [(c, float(i), d, None if d else ct, fb) for c, fr in cases.items() for i, (d, ct, fb) in enumerate(fr)]
    df = spark.createDataFrame(rows, "c int, t double, event_dead boolean, control_team string, fallback string")
    df = df.withColumns({"ball_state": F.when(F.col("control_team").isNotNull(), "CONTROL").otherwise("FREE"), "control_player_id": F.lit(1)})
    got = P.carry_possession(df, Line(("c",), "t", (), whole), focal_player=F.lit(1)).orderBy("c", "t").collect()
    for c, fr in cases.items():
        mine = [r for r in got if r.c == c]
        assert [r.team_possession for r in mine] == carry_loop(fr)
        assert all(r.ball_state == "DEAD" for r in mine if r.event_dead)


def test_segments_and_recovery(spark):
    rows = [(0.0, "a"), (1.0, "a"), (2.0, None), (3.0, None), (4.0, "a")]
    df = spark.createDataFrame([("k", t, x) for t, x in rows], "k string, t double, lab string")
    segs = E.label_segments(df, Line(("k",), "t"), "lab").orderBy("t0").collect()
    assert [(r.lab, r.t0, r.t1, r.n_frames) for r in segs] == [("a", 0.0, 1.0, 2), (None, 2.0, 3.0, 2), ("a", 4.0, 4.0, 1)]
    ph = E.phase_durations(df, Line(("k",), "t"), "lab").orderBy("t0").collect()
    assert [r.duration_s for r in ph] == [2.0, 2.0, 1.0]
    ev = spark.createDataFrame([("k", 1, 0.0, 2.0), ("k", 1, 1.0, 3.0), ("k", 2, 5.0, 6.0)], "k string, p int, start_time_s double, end_time_s double")
    whole = E.recovery_gaps(ev, ["k"]).orderBy("start_time_s").collect()
    assert [r.recovery_before_s for r in whole] == [None, None, 2.0]
    per = E.recovery_gaps(ev, ["k", "p"]).orderBy("start_time_s").collect()
    assert [r.recovery_before_s for r in per] == [None, None, None]


def test_team_label_sources(spark):
    rows = [(1, None), (None, "1"), (None, "False"), (None, None), (2, "true"), (1, " YES ")]
    df = spark.createDataFrame(rows, "team int, hb string")
    got = df.select(S.team_label(F.col("team"), F.col("hb"), F.lit(1), F.lit(1)).alias("r")).select("r.*").collect()
    assert [tuple(r) for r in got] == [
        ("FOCAL", "team_id"), ("FOCAL", "home_ball"), ("OPP", "home_ball"), ("UNRESOLVED", "unresolved"),
        ("OPP", "team_id_over_home_ball_conflict"), ("FOCAL", "team_id"),
    ]
