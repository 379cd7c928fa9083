"""Bins, sliding windows and rolling statistics over irregular times."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from fractions import Fraction
from math import gcd, lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..session import written
from .bands import band_join
from .kinematics import sample_interval
from .ordered import Line, dealt, prefix, range_around, range_means, range_totals, rows_around
from .quantiles import counted, quantiles, value_shares

# Fixed values
WINDOW_MIN, STEP_MIN, MIN_FRAMES = 3.0, 2.0, 30
EDGE = 1e-6
HEAT_BINS = 40
HEAT_TOP = {"speed": 10.0, "acc_use": 5.0, "jerk_use": 8.0, "distance_1s": 10.0}
KERNEL_SIGMA, KERNEL_REACH, KERNEL_WEIGHT = 1.25, 2.5, 0.15
METRICS = ("speed", "acceleration", "distance", "jerk")
MEDIAN_BUCKETS = 16
FRAME_ROWS = 200
SHORT_TEAM, SHORT_ALL = 10, 20


def step_for(win: float, overlap_s: float) -> float:
    """Step of a sliding window from its overlap in seconds."""
    step = win - overlap_s / 60.0
    if not 0 < step <= win:
        raise ValueError(f"no step for window {win} with overlap {overlap_s} s")
    return step


def pane_width(*lengths: float) -> Fraction:
    """Longest step that divides all lengths and one unit, so that panes also meet windows that start at whole units."""
    parts = [Fraction(str(x)) for x in (*lengths, 1)]
    common = lcm(*(f.denominator for f in parts))
    return Fraction(gcd(*(f.numerator * (common // f.denominator) for f in parts)), common)


def _border(j: Column, width: Fraction) -> Column:
    """Start of pane ``j``, rounded once, so that a time written as the same decimal number lies on it."""
    return j * F.lit(width.numerator) / F.lit(width.denominator)


def _pane(t: Column, width: Fraction) -> Column:
    """Pane of a time; a border that floor() misses by rounding is settled by comparison with the border itself."""
    j = F.floor(t / float(width)).cast("long")
    return F.when(t < _border(j, width), j - 1).when(t >= _border(j + 1, width), j + 1).otherwise(j)


def panes(df: DataFrame, keys: Sequence[str], time: str, parts: Mapping[str, Column], width: Fraction, within: Sequence[str] = ()) -> DataFrame:
    """Rows aggregated once to pieces ``_j`` of ``width`` along the time, per key (and ``within``), with ``n`` and last time.

    ``parts`` are aggregates that can be merged later (counts, sums, largest, smallest values).
    """
    t = F.col(time)
    return df.where(t.isNotNull()).groupBy(*keys, *within, _pane(t, width).alias("_j")).agg(
        F.count(F.lit(1)).alias("_n"), F.max(t).alias("_last"), *[c.alias(n) for n, c in parts.items()]
    )


def windows_of(pieces: DataFrame, keys: Sequence[str], wins: Sequence[float], step: float, width: Fraction, merge: Mapping[str, Column], within: Sequence[str] = ()) -> DataFrame:
    """Sliding windows put together from panes: one row per (key, window length ``win_min``, start ``t0``, ``within``).

    Windows start at the floor of the key's first time, every ``step``, while they fit before its last time.
    """
    keys = list(keys)
    unit, s = int(1 / width), int(Fraction(str(step)) / width)
    spans = pieces.groupBy(*keys).agg((F.floor(F.min("_j") / unit) * unit).alias("_lo"), F.max("_last").alias("_hi"))
    lengths = F.explode(F.array(*[F.struct(F.lit(float(w)).alias("win_min"), F.lit(int(Fraction(str(w)) / width)).cast("long").alias("_w")) for w in wins]))
    d = pieces.join(spans, keys).select("*", lengths.alias("_win")).select("*", "_win.*").drop("_win")
    at = F.col("_j") - F.col("_lo")
    last = F.floor((F.col("_hi") - F.col("win_min") + 1e-9 - _border(F.col("_lo"), width)) / step).cast("long")
    first, upto = F.greatest(F.lit(0), F.floor((at - F.col("_w")) / s).cast("long") + 1), F.least(last, F.floor(at / s).cast("long"))
    d = d.where(upto >= first).withColumn("_k", F.explode(F.sequence(first, upto)))
    t0 = _border(F.col("_lo") + F.col("_k") * s, width).alias("t0")
    return d.groupBy(*keys, "win_min", t0, *within).agg(F.sum("_n").alias("n_frames"), *[c.alias(n) for n, c in merge.items()])


#: A value is summed exactly as a multiple of 2 ** -10 and one of 2 ** -50; beyond ``EXACT_MOST`` (or not finite) it is summed as a double.
EXACT_MOST = float(2**33)


def _exact(c: Column) -> tuple[Column, Column, Column]:
    """Whole multiples of 2 ** -10 and 2 ** -50 that make up a value, and the value itself where it is too large for them."""
    v = F.when(F.abs(c) < EXACT_MOST, c.cast("double"))
    coarse = F.rint(v * 1024)
    return coarse.cast("long"), F.rint((v - coarse / 1024) * float(2**50)).cast("long"), F.when(~(F.abs(c) < EXACT_MOST), c.cast("double"))


def _exact_total(n: str) -> Column:
    """The sum of a value's parts: the same for any order of the rows. Null without any value."""
    fine = F.coalesce(F.sum(f"{n}_h"), F.lit(0)) / F.lit(1024.0) + F.coalesce(F.sum(f"{n}_l"), F.lit(0)) / F.lit(float(2**50))
    return F.when(F.sum(f"{n}_c") > 0, F.coalesce(F.sum(f"{n}_b"), F.lit(0.0)) + fine)


_EXACT_PARTS = (
    ("_h", lambda c: F.sum(_exact(c)[0])), ("_l", lambda c: F.sum(_exact(c)[1])), ("_b", lambda c: F.sum(_exact(c)[2])), ("_c", F.count),
)
#: How an aggregate is cut into parts per pane, and put together again.
_MERGED = {
    "max": ((("", F.max),), lambda n: F.max(f"{n}")),
    "min": ((("", F.min),), lambda n: F.min(f"{n}")),
    "sum": ((("", F.sum),), lambda n: F.sum(f"{n}")),
    "count": ((("", F.count),), lambda n: F.sum(f"{n}")),
    "mean": ((("_s", F.sum), ("_c", F.count)), lambda n: F.sum(f"{n}_s") / F.nullif(F.sum(f"{n}_c"), F.lit(0))),
    "exact_sum": (_EXACT_PARTS, _exact_total),
    "exact_mean": (_EXACT_PARTS, lambda n: _exact_total(n) / F.nullif(F.sum(f"{n}_c"), F.lit(0))),
}


def window_aggregate(
    df: DataFrame, keys: Sequence[str], time: str, aggs: Mapping[str, tuple[str, Column]], win: float | Sequence[float] = WINDOW_MIN, step: float = STEP_MIN,
    min_frames: int = MIN_FRAMES, within: Sequence[str] = (),
) -> DataFrame:
    """Aggregates ``name: (max | min | sum | count | mean | exact_sum | exact_mean, column)`` per sliding window with at least ``min_frames`` rows.

    ``within`` groups the rows of a window further; windows still follow the times of ``keys``. Rows are read once
    for all window lengths: they become panes, of which windows are made.
    """
    wins = [win] if isinstance(win, (int, float)) else list(win)
    width = pane_width(*wins, step)
    # distinct names keep a part from reading another one's column
    parts = {f"_p_{n}{tail}": f(c) for n, (kind, c) in aggs.items() for tail, f in _MERGED[kind][0]}
    merge = {n: _MERGED[kind][1](f"_p_{n}") for n, (kind, _) in aggs.items()}
    d = windows_of(panes(df, keys, time, parts, width, within), keys, wins, step, width, merge, within)
    return d.where(F.col("n_frames") >= min_frames)


def _centred(d: DataFrame, win: float) -> DataFrame:
    return d.withColumn("t_centre", F.col("t0") + win / 2).drop("t0", "win_min", "n_frames")


def rolling_peaks(df: DataFrame, keys, time: str, cols: Sequence[str], win: float = WINDOW_MIN, **kw) -> DataFrame:
    return _centred(window_aggregate(df, keys, time, {f"max_{c}": ("max", F.col(c)) for c in cols}, win, **kw), win)


def rolling_distance(df: DataFrame, keys, time: str, step_col: str = "step_dist", win: float = WINDOW_MIN, **kw) -> DataFrame:
    d = window_aggregate(df, keys, time, {"window_distance": ("sum", F.col(step_col))}, win, **kw)
    return _centred(d.withColumn("window_distance", F.coalesce("window_distance", F.lit(0.0))), win)


def majority_label(centres: DataFrame, points: DataFrame, keys, centre: str, time: str, label: str, win: float) -> DataFrame:
    """Most frequent of the three possession classes within ``win`` around each centre."""
    keys = list(keys)
    pts = points.select(*keys, F.col(time).alias("_pt"), F.col(label).alias("_pl"))
    pairs = band_join(centres, pts, keys, centre, "_pt", win / 2, win / 2, how="left", closed=False)
    n_in, n_out, n_other = (F.count_if(F.col("_pl") == c).alias(c) for c in (S.IN_POSS, S.OUT_POSS, S.NEUTRAL))
    counts = pairs.groupBy(*centres.columns).agg(n_in, n_out, n_other)
    return counts.withColumn("poss_class", _majority(*(F.col(c) for c in (S.IN_POSS, S.OUT_POSS, S.NEUTRAL)))).drop(
        S.IN_POSS, S.OUT_POSS, S.NEUTRAL
    )


def _majority(n_in: Column, n_out: Column, n_other: Column) -> Column:
    top = F.greatest(n_in, n_out, n_other)
    return F.when((top == n_in) & (top > 0), S.IN_POSS).when((top == n_out) & (top > 0), S.OUT_POSS).otherwise(S.NEUTRAL)


def label_proportions(
    df: DataFrame, keys, time: str, label: str, win: float | Sequence[float] = WINDOW_MIN, step: float = STEP_MIN, min_frames: int = MIN_FRAMES
) -> DataFrame:
    """Share of each possession class per sliding window, the largest share and its class (and ``win_min`` of several lengths)."""
    classes = {f"_n{i}": ("count", F.when(F.col(label) == c, 1)) for i, c in enumerate((S.IN_POSS, S.OUT_POSS, S.NEUTRAL))}
    d = window_aggregate(df, keys, time, classes, win, step, min_frames)
    d = d.drop("win_min") if isinstance(win, (int, float)) else d
    total = F.col("_n0") + F.col("_n1") + F.col("_n2")
    # a window without any known class has zero shares
    shares = {n: F.when(total > 0, F.col(f"_n{i}") / F.greatest(total, F.lit(1))).otherwise(0.0) for i, n in enumerate(("p_ip", "p_oop", "p_dead"))}
    d = d.withColumns(shares)
    return d.withColumns(
        {
            "p_max": F.greatest("p_ip", "p_oop", "p_dead"),
            "poss_class": _majority(F.col("_n0"), F.col("_n1"), F.col("_n2")),
        }
    ).drop("_n0", "_n1", "_n2")


def window_length_sweep(
    df: DataFrame, keys, time: str, label: str, wins=(0.5, 1.0, 3.0), step: float = 0.5, thresholds=(0.5, 0.6, 0.7), min_frames: int = MIN_FRAMES
) -> DataFrame:
    """How window length changes the dominance of one class; one row per length over all groups."""
    d = label_proportions(df, keys, time, label, [float(w) for w in wins], step, min_frames)
    aggs = [
        F.count(F.lit(1)).alias("n_windows"),
        F.avg("p_max").alias("p_max_mean"),
        F.avg("p_ip").alias("mean_p_ip"),
        F.avg("p_oop").alias("mean_p_oop"),
        F.avg("p_dead").alias("mean_p_dead"),
    ]
    for th in thresholds:
        tag, clean = int(round(th * 100)), F.col("p_max") >= th
        aggs += [
            F.avg(clean.cast("double")).alias(f"frac_pmax_ge_{tag}"),
            F.avg(F.when(clean, (F.col("poss_class") == S.IN_POSS).cast("double"))).alias(f"frac_clean_ip_{tag}"),
            F.avg(F.when(clean, (F.col("poss_class") == S.OUT_POSS).cast("double"))).alias(f"frac_clean_oop_{tag}"),
            F.avg((~clean).cast("double")).alias(f"frac_mixed_{tag}"),
        ]
    spread = quantiles(d, ["win_min"], F.col("p_max"), {"p_max_p25": 0.25, "p_max_median": 0.5, "p_max_p75": 0.75})
    return d.groupBy("win_min").agg(*aggs).join(spread, "win_min")


def peer_percentiles(
    df: DataFrame, match: Sequence[str], player: str, team: str, time: str, win: float = WINDOW_MIN, step: float = STEP_MIN, min_frames: int = MIN_FRAMES,
    digits: int | None = None,
) -> DataFrame:
    """Per window and player: inclusive percentile of four metrics among the team and among all.

    With ``digits`` metrics are ranked at so many decimals, of sums that no order of the rows changes: the same values always tie.
    """
    match = list(match)
    how = "" if digits is None else "exact_"
    means = {n: (how + kind, F.col(c)) for n, kind, c in (("mean_speed", "mean", "speed"), ("mean_acc", "mean", "acc_use"), ("mean_jerk", "mean", "jerk_use"), ("total_distance", "sum", "step_dist"))}
    d = window_aggregate(df, match, time, means, win, step, min_frames, within=(player, team))
    d = d.withColumn("total_distance", F.coalesce("total_distance", F.lit(0.0)))
    if digits is not None:
        d = d.withColumns({m: S.at_digits(F.col(m), digits) for m in means})
    everyone = [*match, "t0"]
    ident = [*everyone, player, team]
    # long form: one ranking among all and one among the team serve all metrics and both sizes; the values are counted once
    long = d.select(*ident, F.lit(1.0).alias("_one"), *means).unpivot(ident, ["_one", *means], "metric", "_v")
    group, own = [*everyone, "metric"], [*everyone, "metric", team]
    counts = counted(long, own, "_v")
    everywhere = counts.groupBy(*group, "_v").agg(F.sum("__n").alias("__n"))
    long = long.join(value_shares(everywhere, group, "_v", "all_pct", "_n_all"), [*group, "_v"], "left")
    long = long.join(value_shares(counts, own, "_v", "team_pct", "_n_team"), [*own, "_v"], "left")
    out = long.groupBy(*ident).agg(
        *[F.max(F.when(F.col("metric") == m, F.col(p))).alias(f"{m}_{p}") for m in means for p in ("team_pct", "all_pct")],
        *[F.max(F.when(F.col("metric") == "_one", F.col(f"_{n}"))).alias(n) for n in ("n_team", "n_all")],
    )
    return out.withColumn("t_centre", F.col("t0") + win / 2).drop("t0")


def presence_by_player(peers: DataFrame, players: DataFrame, match: Sequence[str], player: str) -> DataFrame:
    """Per player of ``players`` (match keys, player): windows with them, windows of others without them, and short windows.

    A window counts as missing where it has peers but the player has too few frames in it.
    """
    match = list(match)
    windows = peers.groupBy(*match).agg(F.count_distinct("t_centre").alias("_all"))
    own = peers.groupBy(*match, player).agg(
        F.count(F.lit(1)).alias("_own"), F.count_if(F.col("n_team") < SHORT_TEAM).alias("_st"), F.count_if(F.col("n_all") < SHORT_ALL).alias("_sa")
    )
    d = players.select(*match, player).distinct().join(windows, match, "left").join(own, [*match, player], "left")
    n, everyone = (F.coalesce(c, F.lit(0)).cast("long") for c in ("_own", "_all"))
    return d.select(*match, player, n.alias("n_windows"), (everyone - n).alias("focal_missing"), *[F.coalesce(c, F.lit(0)).cast("long").alias(o) for c, o in (("_st", "short_team"), ("_sa", "short_all"))])


def presence_diagnostics(peers: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """How many peers the windows had: windows per (team size, overall size), with short flags."""
    return (
        peers.groupBy(*by, "n_team", "n_all")
        .agg(F.count(F.lit(1)).alias("n_windows"))
        .withColumns({"short_team": F.col("n_team") < SHORT_TEAM, "short_all": F.col("n_all") < SHORT_ALL})
    )


def second_bins(df: DataFrame, keys, clock_s: str, interval: float = 1.0) -> DataFrame:
    """Means and summed distance per whole interval."""
    return df.groupBy(*keys, F.floor(F.col(clock_s) / interval).cast("long").alias("time_bin")).agg(
        F.avg(clock_s).alias(clock_s),
        F.avg("speed").alias("speed"),
        F.avg("acc_use").alias("acc_use"),
        F.avg("jerk_use").alias("jerk_use"),
        F.coalesce(F.sum("step_dist"), F.lit(0.0)).alias("distance_1s"),
        F.count("speed").alias("n_frames"),
    )


def heat_scale(zoom: str = "full") -> tuple[dict[str, float], int]:
    """Top of the value axis per metric and the number of bins."""
    if zoom == "full":
        return dict(HEAT_TOP), HEAT_BINS
    if zoom == "half":
        return {k: v / 2 for k, v in HEAT_TOP.items()}, round(HEAT_BINS * 1.4)
    if zoom == "tight":
        return {"jerk_use": HEAT_TOP["jerk_use"] / 4}, round(HEAT_BINS * 2.5)
    raise ValueError(f"zoom is full, half or tight, not {zoom!r}")


def sliding_histogram(df: DataFrame, keys, time: str, value: str, top: float, bins: int, win: float = 180.0, step: float = 120.0) -> DataFrame:
    """Counts per (window, value bin) over ``[0, top]``, zero bins included, last bin closed.

    Windows start at the group's first time and one partly filled window is kept. Window ``k`` starts at ``lo + k * step`` and ends ``win``
    after that, in doubles; quotients only guess a row's windows. Rows become counts per (first window, last window, bin) before any window is made.
    """
    keys = list(keys)
    d = df.where(F.col(time).isNotNull() & F.col(value).isNotNull())
    v, t, lo, hi = F.col(value), F.col(time), F.col("_lo"), F.col("_hi")
    slot = F.least(F.floor(v * bins / top), F.lit(bins - 1)).cast("int")
    slot = F.when((v >= 0) & (v <= top), slot)
    spans = d.groupBy(*keys).agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))

    def start(k: Column) -> Column:
        return lo + k * F.lit(float(step))

    def last_with(holds, guess: Column) -> Column:
        """The last window for which ``holds``, next to a guess that division rounded."""
        k = guess.cast("long")
        return F.when(~holds(k), k - 1).when(holds(k + 1), k + 1).otherwise(k)

    end = hi if win == step else hi - win + step  # hi - win + win is not always hi
    last = last_with(lambda k: start(k) < end, F.ceil((end - lo) / step) - 1)
    upto = last_with(lambda k: start(k) <= t, F.floor((t - lo) / step))
    over = last_with(lambda k: start(k) + win <= t, F.floor((t - lo - win) / step))
    pieces = d.join(spans, keys).select(*keys, "_lo", F.greatest(F.lit(0), over + 1).alias("_first"), F.least(last, upto).alias("_upto"), slot.alias("bin"))
    pieces = pieces.where(F.col("_upto") >= F.col("_first")).groupBy(*pieces.columns).agg(F.count(F.lit(1)).alias("_n"))
    pieces = pieces.withColumn("_k", F.explode(F.sequence("_first", "_upto")))
    counts = pieces.groupBy(*keys, start(F.col("_k")).alias("t0"), "bin").agg(F.sum("_n").alias("n"))
    grid = counts.select(*keys, "t0").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = grid.join(counts, [*keys, "t0", "bin"], "left")
    return full.select(
        *keys, (F.col("t0") + win / 2).alias("t_centre"), "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def fingerprint(df: DataFrame, line: Line, win: float | None, coverage: float = 0.8, clock: str | None = None) -> DataFrame:
    """Mean |jerk|, mean positive acceleration, mean speed and distance per tumbling window.

    Without ``win`` every row is its own window. ``clock`` (seconds) cuts the windows, by default the time of the line.
    """
    keys, t = list(line.keys), F.col(clock or line.time)
    gain = F.when(F.col("a_tan_use").isNotNull(), F.greatest(F.col("a_tan_use"), F.lit(0.0)))
    if not win:
        return df.select(
            *keys, t.alias("t_s"), F.abs("jerk_use").alias("jerk"), gain.alias("acc"), "speed",
            F.col("step_dist").alias("distance"), F.lit(1).cast("long").alias("n_frames"),
        )
    hz = sample_interval(df, line).select(*keys, "hz")
    ends = df.where(t.isNotNull()).groupBy(*keys).agg(F.min(t).alias("_lo"), F.max(t).alias("_hi"))
    gates = ends.join(hz, keys).withColumn("_need", F.greatest(F.lit(3), F.floor(coverage * win * F.col("hz"))))
    d = df.join(gates, keys).withColumn("_k", F.floor((t - F.col("_lo")) / win))
    d = d.where(F.col("_lo") + F.col("_k") * win < F.col("_hi") - win + 1e-9)
    d = d.groupBy(*keys, (F.col("_lo") + F.col("_k") * win + win / 2).alias("t_s"), "_need").agg(
        F.avg(F.abs("jerk_use")).alias("jerk"),
        F.avg(gain).alias("acc"),
        F.avg("speed").alias("speed"),
        F.sum("step_dist").alias("distance"),
        F.count(F.lit(1)).alias("n_frames"),
    )
    return d.where(F.col("n_frames") >= F.col("_need")).drop("_need")


def match_max_norm(df: DataFrame, keys, cols: Mapping[str, str]) -> DataFrame:
    """Each column over its positive group maximum, clipped to ``[0, 1]``; 0 when there is none."""
    keys = list(keys)
    tops = df.groupBy(*keys).agg(*[F.max(c).alias(f"_top_{n}") for n, c in cols.items()])
    d = df.join(tops, keys)
    out = {}
    for n, c in cols.items():
        top = F.col(f"_top_{n}")
        out[n] = F.when(top > 0, S.clamp(F.col(c) / top, 0.0, 1.0)).when(F.col(c).isNotNull(), 0.0)
    return d.withColumns(out).drop(*[f"_top_{n}" for n in cols])


def regulation_minutes(df: DataFrame, line: Line, clock_s: str = "clock_s", period: str = "period", coverage: float = 0.7) -> DataFrame:
    """Long ``(keys, minute 1..90, metric, value)``; null where the minute misses its coverage gate.

    ``line.keys`` is one player in one match, ``line.time`` the video clock in seconds.
    """
    keys = list(line.keys)
    dt = sample_interval(df, line).select(*keys, F.coalesce("median_dt", F.lit(1.0 / 30.0)).alias("_dt"))
    need = F.greatest(F.lit(3), F.floor(coverage * F.greatest(F.lit(1.0), 60.0 / F.col("_dt"))))
    minutes = df.withColumn("minute", S.regulation_minute(F.col(period), F.col(clock_s)) + 1)
    minutes = minutes.where(F.col("minute").isNotNull()).groupBy(*keys, "minute").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.struct(F.avg(c).alias("v"), F.count(c).alias("n")).alias(f"_{c}") for c in ("speed", "acc_use", "jerk_use")],
        F.sum("step_dist").alias("_dist"),
    )
    grid = dt.withColumn("_need", need).withColumn("minute", F.explode(F.sequence(F.lit(1), F.lit(90))))
    d = grid.join(minutes, [*keys, "minute"], "left")
    row_ok = F.col("_n") >= F.col("_need")

    def gated(c: str) -> Column:
        return F.when(row_ok & (F.col(f"_{c}.n") >= F.col("_need")), F.col(f"_{c}.v"))

    d = d.select(
        *keys, "minute", gated("speed").alias("speed"), gated("acc_use").alias("acceleration"),
        F.when(row_ok, F.col("_dist")).alias("distance"), gated("jerk_use").alias("jerk"),
    )
    return d.unpivot([*keys, "minute"], list(METRICS), "metric", "value")


def hop_success(
    df: DataFrame, keys, time: str, success: str, start: Column, win: float = 5.0, hop: float = 1.0, min_n: int = 2
) -> DataFrame:
    """Success rate in hopping windows from ``start`` to the group's last time; empty ones are kept.

    ``start`` is an expression over the keys (clock minute at which the half begins).
    """
    keys = list(keys)
    ends = df.groupBy(*keys).agg(F.max(time).alias("_hi")).withColumn("_s0", start.cast("double"))
    last = F.floor((F.col("_hi") + 1e-9 - F.col("_s0")) / hop).cast("long")
    grid = ends.where(F.col("_hi") >= F.col("_s0")).withColumn("_k", F.explode(F.sequence(F.lit(0), last)))
    t = F.col(time)
    d = df.withColumn("_s0", start.cast("double"))
    lo = F.greatest(F.lit(0), F.floor((t - F.col("_s0") - win) / hop)).cast("long")
    hi = F.floor((t - F.col("_s0")) / hop).cast("long")
    d = d.where(hi >= 0).withColumn("_k", F.explode(F.sequence(lo, hi)))
    w0 = F.col("_s0") + F.col("_k") * hop
    d = d.where((t >= w0) & (t < w0 + win)).groupBy(*keys, "_k").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(success)).alias("n_ok")
    )
    n = F.coalesce("n", F.lit(0)).cast("long")
    return grid.join(d, [*keys, "_k"], "left").select(
        *keys,
        (w0 + win / 2).alias("t_min"),
        w0.alias("window_start_min"),
        (w0 + win).alias("window_end_min"),
        n.alias("n"),
        F.when(n >= min_n, F.col("n_ok") / F.col("n")).alias("P"),
    )


def centred_mean(df: DataFrame, line: Line, value: str, widths: Mapping[str, float]) -> DataFrame:
    """Means over ``|dt| <= width/2`` on irregular times, several widths in one pass."""
    return range_means(df, line, value, {n: (w / 2 + EDGE, w / 2 + EDGE) for n, w in widths.items()})


def _frame_rows(df: DataFrame, line: Line, width: float) -> float:
    """How many rows of its key fall into a row's own stretch of ``width``, on average over the rows."""
    sizes = df.groupBy(*line.keys, F.floor(F.col(line.time) / (width or 1.0))).agg(F.count("_v").cast("double").alias("n"))
    return sizes.agg(F.sum(F.col("n") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0.0))).first()[0] or 0.0


def centred_median(df: DataFrame, line: Line, value: str, out: str, width: float = 9.0, buckets: int = MEDIAN_BUCKETS) -> DataFrame:
    """Median over ``|dt| <= width/2``.

    Where a row shares its time frame with few rows, each frame is ordered by itself. Otherwise the key's values are cut into ``buckets`` by its quantiles. How many values of each bucket a frame holds
    is a difference of running counts, which tells the buckets of the one or two middle ranks. A bucket of one value is
    the answer; of others only the frame's rows of that bucket are gathered and ordered.
    """
    keys, half = list(line.keys), width / 2
    d = df.withColumn("_v", F.when(~F.isnan(value), F.col(value).cast("double")))
    if _frame_rows(d, line, width) <= FRAME_ROWS:
        return range_around(d, line, {out: ("percentile(`_v`, 0.5D)", half, half)}).drop("_v")
    cuts = quantiles(d, keys, F.col("_v"), {f"_q{i}": i / buckets for i in range(1, buckets)})
    cuts = cuts.select(*keys, F.array_distinct(F.array(*[f"_q{i}" for i in range(1, buckets)])).alias("_cuts"))
    d = d.join(cuts, keys, "left").withColumn("_b", F.when(F.col("_v").isNotNull(), F.size(F.filter("_cuts", lambda c: c <= F.col("_v")))))
    d = written(d.drop("_cuts").withColumn("_id", F.monotonically_increasing_id()))
    counts = {str(i): (F.col("_b") == i).cast("long") for i in range(buckets)}
    focal = range_totals(d.select(*keys, line.time, "_id", "_b"), line, counts, {"_f": (half, half)})
    # running counts over the buckets place the middle ranks
    n = F.array(*[F.col(f"_f_{i}") for i in range(buckets)])
    upto = F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda i: F.aggregate(F.slice(n, 1, i + 1), F.lit(0).cast("long"), lambda a, x: a + x))
    focal = focal.select(*keys, line.time, "_id", upto.alias("_upto")).withColumn("_all", F.get("_upto", F.lit(buckets - 1)))
    ranks = F.array(F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2))
    focal = focal.where(F.col("_all") > 0).withColumn("_rank", F.explode(F.array_distinct(ranks)))
    focal = focal.withColumn("_b", F.size(F.filter("_upto", lambda x: x <= F.col("_rank"))))
    before = F.when(F.col("_b") > 0, F.get("_upto", F.col("_b") - 1)).otherwise(0)
    focal = focal.select(*keys, line.time, "_id", "_b", (F.col("_rank") - before).alias("_at"))

    ends = d.where("_b is not null").groupBy(*keys, "_b").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    focal = focal.join(ends, [*keys, "_b"])
    alike = F.col("_lo") == F.col("_hi")
    easy = focal.where(alike).select("_id", F.col("_lo").alias("_m"))
    mixed = ends.where(~alike).select(*keys, "_b")
    both = focal.where(~alike).select(*keys, line.time, "_b", "_id", "_at").unionByName(
        d.join(mixed, [*keys, "_b"], "left_semi").select(*keys, line.time, "_b", "_v"), allowMissingColumns=True
    )
    hard = range_around(both, line.by("_b"), {"_near": ("collect_list(`_v`)", half, half)}).where(F.col("_at").isNotNull())
    hard = hard.select("_id", F.get(F.array_sort("_near"), F.col("_at").cast("int")).alias("_m"))
    middle = easy.unionByName(hard).groupBy("_id").agg(F.avg("_m").alias(out))
    return d.drop("_v", "_b", *([out] if out in d.columns else [])).join(middle, "_id", "left").drop("_id")


@dealt
def trailing_mean(df: DataFrame, line: Line, value: str, out: str, rows: int = 10) -> DataFrame:
    """Mean of the last ``rows`` non-null rows, shorter at the start; null rows stay null."""
    # null rows are a line of their own, so frames count known rows only
    d = df.withColumn("_known", F.col(value).isNotNull())
    d = rows_around(
        d, line.by("_known"), rows - 1, 0,
        lambda part, w: part.withColumn(out, F.avg(value).over(w.rowsBetween(-(rows - 1), 0))),
    )
    return d.drop("_known")


@dealt
def running_sums(df: DataFrame, line: Line, value: str) -> DataFrame:
    """Sum, count and mean so far of the non-null rows; null on null rows."""
    v = F.col(value)
    d = prefix(df, line, {"_sum": ("sum", v), "_cnt": ("count", v)})
    s, n = F.when(v.isNotNull(), F.col("_sum")), F.when(v.isNotNull(), F.col("_cnt"))
    return d.withColumns({"cum": s, "n_so_far": n, "mean_so_far": s / n}).drop("_sum", "_cnt")


def period_to_date(df: DataFrame, line: Line, cols: Mapping[str, Column]) -> DataFrame:
    """Running sums under new names."""
    return prefix(df, line, {n: ("sum", c) for n, c in cols.items()})


def signed_lead(df: DataFrame, line: Line, residuals: Mapping[str, str], half_range: float = S.LEAD_WIDE_HALF_RANGE_M) -> DataFrame:
    """Cumulative residual per reference with its 7-minute mean and clipped unit form, long."""
    keep = [*line.keys, *line.order]
    long = df.select(*keep, *[F.col(c).alias(n) for c, n in residuals.items()])
    long = long.unpivot(keep, list(residuals.values()), "reference", "r")
    by_ref = line.by("reference")
    d = running_sums(long, by_ref, "r").withColumnRenamed("cum", "C").drop("n_so_far", "mean_so_far")
    d = d.withColumn("N", S.clip_unit(F.col("C"), half_range))
    return centred_mean(d, by_ref, "r", {"ma7": 7.0})


def kernel_modifier(points: DataFrame, marks: DataFrame, keys, time: str, mark_time: str, quality: str) -> DataFrame:
    """Gaussian-weighted marks near each point: weight ``w`` and mean quality ``Q``."""
    m = marks.select(*keys, F.col(mark_time).alias("_mt"), F.col(quality).alias("_mq"))
    pairs = band_join(points, m, list(keys), time, "_mt", KERNEL_REACH, KERNEL_REACH, how="left")
    g = F.exp(-0.5 * ((F.col(time) - F.col("_mt")) / KERNEL_SIGMA) ** 2)
    d = pairs.withColumn("_g", g).groupBy(*points.columns).agg(
        F.sum("_g").alias("_sg"), F.sum(F.col("_g") * F.col("_mq")).alias("_sq")
    )
    return d.withColumns(
        {"w": KERNEL_WEIGHT * F.least(F.coalesce("_sg", F.lit(0.0)), F.lit(1.0)), "Q": F.col("_sq") / F.col("_sg")}
    ).drop("_sg", "_sq")


def synergy_windows(df: DataFrame, line: Line, player: str, team: str) -> DataFrame:
    """Capped synergy of saved scores with its 1, 3, 5 and 10 minute centred means."""
    d = df.withColumn("m", S.capped_synergy(F.col(player), F.col(team))["m"])
    return centred_mean(d, line, "m", {"m_w1": 1.0, "m_w3": 3.0, "m_w5": 5.0, "m_w10": 10.0})


def class_averages(df: DataFrame, keys, label: str, value: str) -> DataFrame:
    """Mean of a metric in and out of possession, and each class's share of rows."""
    lab = F.col(label)
    return df.groupBy(*keys).agg(
        F.avg(F.when(lab == S.IN_POSS, F.col(value))).alias("in_avg"),
        F.avg(F.when(lab == S.OUT_POSS, F.col(value))).alias("out_avg"),
        (100.0 * F.count_if(lab == S.IN_POSS) / F.count(F.lit(1))).alias("in_pct"),
        (100.0 * F.count_if(lab == S.OUT_POSS) / F.count(F.lit(1))).alias("out_pct"),
    )
