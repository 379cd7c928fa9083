"""Rolling lines, local regression and the scores built on them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..session import stage
from .ordered import Line, dealt, neighbour, one_task, prefix, rows_around, short_keys
from .quantiles import quantiles
from .windows import running_sums, trailing_mean

# Fixed values
SCALE_X = 200.0
SCALE_Y = {"distance_m": 42.0, "peak_speed": 7.0}
SETTINGS = (  # (rows in the window, fewest rows, smallest x range)
    (5, 3, 20.0), (5, 4, 20.0), (6, 3, 20.0), (6, 4, 20.0), (6, 5, 20.0),
    (8, 3, 20.0), (8, 5, 20.0), (10, 5, 20.0), (5, 3, 15.0), (5, 3, 30.0),
)
LOWESS_FRACTION = 0.5
#: Fits of a setting sweep that one task makes and sorts.
FITS_PER_TASK = 4_000_000
#: Rows of one minute series: the minutes of a half and of any overtime.
LOWESS_ROWS = 120


def usable(x: str, y: str) -> Column:
    return F.col(x).isNotNull() & (F.col(x) > 0) & F.col(y).isNotNull()


def _middle(ordered: Column) -> Column:
    """Median of a sorted array."""
    n = F.size(ordered)
    return (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2


def _theil_sen(df: DataFrame, points: str) -> DataFrame:
    """Add ``_tb``/``_ta``: median pairwise slope and its intercept over a short array of ``(x, y)``."""
    pts = F.col(points)
    slopes = F.flatten(
        F.transform(
            pts,
            lambda a: F.transform(
                F.filter(pts, lambda b: b["x"] > a["x"]), lambda b: (b["y"] - a["y"]) / (b["x"] - a["x"])
            ),
        )
    )
    d = df.withColumns(
        {
            "_slopes": F.array_sort(slopes),
            "_xs": F.array_sort(F.transform(pts, lambda a: a["x"])),
            "_ys": F.array_sort(F.transform(pts, lambda a: a["y"])),
        }
    )
    d = d.withColumn("_tb", _middle(F.col("_slopes")))
    d = d.withColumn("_ta", _middle(F.col("_ys")) - F.col("_tb") * _middle(F.col("_xs")))
    return d.drop("_slopes", "_xs", "_ys")


@dealt
def rolling_line(
    df: DataFrame,
    line: Line,
    x: str,
    y: str,
    *,
    table_keys: Sequence[str],
    rows: int = 8,
    min_rows: int = 5,
    min_range: float = 20.0,
    s_x: float | None = None,
    s_y: float | None = None,
    x_ref: float | None = None,
    method: str = "ols",
) -> DataFrame:
    """Line through the last ``rows`` usable rows of the line, as slope, angle, score and height.

    Scales default to the 90th percentiles of the table (``table_keys``), the median if those are not
    positive; ``x_ref`` to the median of ``x``. Unusable rows come back with null results.
    """
    if method not in ("ols", "theilsen"):
        raise ValueError("method is ols or theilsen")
    df = df.withColumn("_ok", F.coalesce(usable(x, y), F.lit(False)))
    wants = {"_x9": (x, 0.9), "_x5": (x, 0.5), "_y9": (y, 0.9), "_y5": (y, 0.5)}
    needed = [n for n, given in (("_x9", s_x), ("_y9", s_y), ("_x5", x_ref)) if given is None]
    if s_x is None and "_x5" not in needed:
        needed.append("_x5")
    if s_y is None:
        needed.append("_y5")
    scales = None
    if needed and line.whole and short_keys(df, table_keys):
        # short tables: scales ride along as whole-table windows, on the same exchange as the frames
        table = Window.partitionBy(*table_keys)
        df = df.withColumns({n: F.percentile(F.when(F.col("_ok"), F.col(wants[n][0])), F.lit(wants[n][1])).over(table) for n in needed})
    else:
        for col in (x, y):
            probs = {n: wants[n][1] for n in needed if wants[n][0] == col}
            if probs:
                q = quantiles(df.where("_ok"), table_keys, F.col(col), probs)
                scales = q if scales is None else scales.join(q, list(table_keys))

    def build(d: DataFrame, w) -> DataFrame:
        f = w.rowsBetween(-(rows - 1), 0)
        d = d.withColumns({"roll_n": F.count(F.lit(1)).over(f), "_span": F.max(x).over(f) - F.min(x).over(f)})
        d = d.withColumn(
            "roll_method",
            F.when(F.col("roll_n") < min_rows, "too_few").when(F.col("_span") < min_range, "x_range").otherwise(method),
        )
        slope, icept = F.regr_slope(y, x).over(f), F.regr_intercept(y, x).over(f)
        if method == "theilsen":
            d = d.withColumn("_pts", F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y"))).over(f))
            d = d.withColumns({"_b": slope, "_a": icept})
            d = _theil_sen(d, "_pts").drop("_pts")
            ts = F.col("_tb").isNotNull()
            d = d.withColumns({"_b": F.coalesce("_tb", "_b"), "_a": F.when(ts, F.col("_ta")).otherwise(F.col("_a"))})
            d = d.withColumn("roll_method", F.when((F.col("roll_method") == method) & ~ts, "ols").otherwise(F.col("roll_method")))
            slope, icept = F.col("_b"), F.col("_a")
        fitted = ~F.col("roll_method").isin("too_few", "x_range")
        d = d.withColumns({"roll_slope": slope, "roll_intercept": icept})
        d = d.withColumns({c: F.when(fitted, F.col(c)) for c in ("roll_slope", "roll_intercept")})
        return d.drop("_span", "_b", "_a", "_tb", "_ta")

    # usable and unusable rows are lines of their own, so frames count usable rows only
    d = rows_around(df, line.by("_ok"), rows - 1, 0, build)
    d = d.withColumns({c: F.when(F.col("_ok"), F.col(c)) for c in ("roll_n", "roll_method", "roll_slope", "roll_intercept")})
    if scales is not None:
        d = d.join(scales, list(table_keys), "left")

    def scale(given, p90, p50):
        return F.lit(float(given)) if given is not None else F.when(F.col(p90) > 0, F.col(p90)).otherwise(F.col(p50))

    ref = F.lit(float(x_ref)) if x_ref is not None else F.col("_x5")
    out = S.slope_score(F.col("roll_slope"), F.col("roll_intercept"), scale(s_x, "_x9", "_x5"), scale(s_y, "_y9", "_y5"), ref)
    return d.withColumns(out).drop("_ok", "_x9", "_x5", "_y9", "_y5")


def pooled_scales(df: DataFrame, cols: Sequence[str], p: float = 0.9) -> DataFrame:
    """The pooled quantile of each column over all entities, one row per column."""
    long = df.select(*cols).unpivot([], list(cols), "scale_of", "_v")
    return quantiles(long, ["scale_of"], F.col("_v"), {"scale": p})


@dealt
def setting_sweep(df: DataFrame, line: Line, x: str, ys: Mapping[str, float], s_x: float = SCALE_X, settings=SETTINGS) -> DataFrame:
    """Angle score under every (window, fewest rows, range) setting and metric, long.

    One window pass per metric serves all settings: the frames differ only in length, the gates are
    applied afterwards. ``ys`` maps a metric to its frozen scale.
    """
    longest = max(n for n, _, _ in settings)
    out = None
    for y, s_y in ys.items():

        def build(d: DataFrame, w, y=y) -> DataFrame:
            cols = {}
            for n in sorted({n for n, _, _ in settings}):
                f = w.rowsBetween(-(n - 1), 0)
                cols[f"_n{n}"] = F.count(F.lit(1)).over(f)
                cols[f"_r{n}"] = F.max(x).over(f) - F.min(x).over(f)
                cols[f"_b{n}"] = F.regr_slope(y, x).over(f)
            return d.withColumns(cols)

        d = rows_around(df.where(usable(x, y)), line, longest - 1, 0, build)
        one = []
        for n, least, span in settings:
            ok = (F.col(f"_n{n}") >= least) & (F.col(f"_r{n}") >= span)
            b = F.when(ok, F.col(f"_b{n}"))
            score = S.slope_score(b, b, F.lit(s_x), F.lit(float(s_y)), F.lit(0.0))
            one.append(
                F.struct(
                    F.lit(n).alias("n_window"), F.lit(least).alias("min_n"), F.lit(span).alias("min_x_s"),
                    score["roll_A"].alias("roll_A"), score["roll_theta_deg"].alias("roll_theta_deg"),
                )
            )
        keep = [*line.keys, *line.order]
        d = d.select(*keep, F.lit(y).alias("y_metric"), F.inline(F.array(*one)))
        out = d if out is None else out.unionByName(d)
    return out


def sweep_summary(fits: DataFrame, line: Line, table_line: Line) -> DataFrame:
    """Per setting and metric: fits, median, spread, mean step within a period, crossings of 0.5.

    A score within 5e-10 of 0.5 lies on it: the slope of a level line is 0 up to the order of its sums.
    """
    case = ["n_window", "min_n", "min_x_s", "y_metric"]
    fits = fits if line.whole else stage(fits)
    total = fits.groupBy(*table_line.keys, *case).agg(F.count(F.lit(1)).alias("n_usable"))
    a = F.col("roll_A")
    d = fits.where(a.isNotNull())
    d = neighbour(d, line.by(*case), {"_step_from": a})
    d = neighbour(d, table_line.by(*case), {"_cross_from": a})
    group = [*table_line.keys, *case]
    crossed = F.signum(F.round(a - 0.5, 9)) != F.signum(F.round(F.col("_cross_from") - 0.5, 9))
    out = d.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_fit"),
        F.min(a).alias("min_A"),
        F.max(a).alias("max_A"),
        F.avg(F.abs(a - F.col("_step_from"))).alias("mean_abs_step_A"),
        F.count_if(crossed).alias("n_cross_half"),
    )
    fit = line.whole
    q = quantiles(d, group, a, {"q25": 0.25, "median_A": 0.5, "q75": 0.75}, bounded=fit)
    q = q.withColumn("iqr_A", F.col("q75") - F.col("q25")).drop("q25", "q75")
    th = quantiles(d, group, F.col("roll_theta_deg"), {"median_theta_star_deg": 0.5}, bounded=fit)
    out = total.join(out.join(q, group).join(th, group), group, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_fit", "n_cross_half")})


def setting_table(
    df: DataFrame, line: Line, table_line: Line, x: str, ys: Mapping[str, float], s_x: float = SCALE_X, settings=SETTINGS
) -> DataFrame:
    """:func:`setting_sweep` and its :func:`sweep_summary` in one.

    Where the keys of ``table_line`` are short, a key's rows go to one task once, and frames, steps, crossings and quantiles
    are taken there: the fits, one per row, setting and metric, are columns that are neither sent nor written. Tasks are as many as the
    fits ask for. A longer key goes through the two functions, which write the fits.
    """
    keys = list(table_line.keys)
    if not (line.whole or short_keys(df, keys, len(settings))):
        return sweep_summary(setting_sweep(df, line, x, ys, s_x, settings), line, table_line)

    n = None
    if not (line.whole or one_task(df)):
        least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        n = max(least, -(-df.count() * len(settings) * len(ys) // FITS_PER_TASK))
    d = df.repartition(*keys) if n is None else df.repartition(n, *keys)
    names = dict.fromkeys([*keys, *line.keys, *line.order, *table_line.order, x])
    metrics = F.array(*[F.struct(F.lit(y).alias("y_metric"), F.lit(float(s)).alias("_s"), F.col(y).cast("double").alias("_y")) for y, s in ys.items()])
    d = d.select(*names, F.inline(metrics)).where(usable(x, "_y"))

    def score(b: Column) -> Mapping[str, Column]:
        return S.slope_score(b, b, F.lit(1.0), F.lit(1.0), F.lit(0.0))

    w, along = line.by("y_metric").window(), table_line.by("y_metric").window()
    so_far = (Window.unboundedPreceding, -1)
    frames = {}
    for rows in sorted({r for r, _, _ in settings}):
        f = w.rowsBetween(-(rows - 1), 0)
        frames |= {f"_n{rows}": F.count(F.lit(1)).over(f), f"_r{rows}": F.max(x).over(f) - F.min(x).over(f), f"_b{rows}": F.regr_slope("_y", x).over(f)}
    held = [*dict.fromkeys([*keys, *table_line.order]), "y_metric"]
    at = range(len(settings))
    d = d.withColumns(frames)
    ok = [(F.col(f"_n{rows}") >= least) & (F.col(f"_r{rows}") >= span) for rows, least, span in settings]
    d = d.withColumns({f"_f{i}": S.slope_score(b, b, F.lit(s_x), F.col("_s"), F.lit(0.0))["roll_b_star"] for i in at for b in [F.when(ok[i], F.col(f"_b{settings[i][0]}"))]})
    d = d.withColumns({f"_a{i}": score(F.col(f"_f{i}"))["roll_A"] for i in at})
    d = d.withColumns({f"_from{i}": F.last(f"_a{i}", ignorenulls=True).over(w.rowsBetween(*so_far)) for i in at})
    d = d.select(
        *held, *[F.col(f"_f{i}") for i in at], *[F.abs(F.col(f"_a{i}") - F.col(f"_from{i}")).alias(f"_step{i}") for i in at],
        *[F.signum(F.round(F.col(f"_a{i}") - 0.5, 9)).alias(f"_side{i}") for i in at],
    )
    d = d.withColumns({f"_last{i}": F.last(f"_side{i}", ignorenulls=True).over(along.rowsBetween(*so_far)) for i in at})
    d = d.groupBy(*keys, "y_metric").agg(
        F.count(F.lit(1)).alias("n_usable"),
        *[F.sort_array(F.collect_list(f"_f{i}")).alias(f"_f{i}") for i in at],
        *[F.avg(f"_step{i}").alias(f"_step{i}") for i in at],
        *[F.count_if(F.col(f"_side{i}") != F.col(f"_last{i}")).alias(f"_cross{i}") for i in at],
    )

    def summary(i: int) -> Column:
        fits, size = F.col(f"_f{i}"), F.size(f"_f{i}")

        def ranked(rank: Column, name: str) -> Column:
            return score(F.get(fits, rank.cast("int")))[name]

        def quantile(p: float, name: str = "roll_A") -> Column:
            pos = F.lit(p) * (size - 1)
            lo, hi = ranked(F.floor(pos), name), ranked(F.ceil(pos), name)
            return lo + (hi - lo) * (pos - F.floor(pos))

        rows, least, span = settings[i]
        # score and angle rise with the fit, so its order is theirs
        return F.struct(
            F.lit(rows).alias("n_window"), F.lit(least).alias("min_n"), F.lit(span).alias("min_x_s"),
            size.cast("long").alias("n_fit"), ranked(F.lit(0), "roll_A").alias("min_A"), ranked(size - 1, "roll_A").alias("max_A"),
            F.col(f"_step{i}").alias("mean_abs_step_A"), F.col(f"_cross{i}").alias("n_cross_half"), quantile(0.5).alias("median_A"),
            (quantile(0.75) - quantile(0.25)).alias("iqr_A"), quantile(0.5, "roll_theta_deg").alias("median_theta_star_deg"),
        )

    d = d.select(*keys, "y_metric", "n_usable", F.inline(F.array(*[summary(i) for i in at])))
    case = ["n_window", "min_n", "min_x_s", "y_metric"]
    return d.select(*keys, *case, "n_usable", *[c for c in d.columns if c not in (*keys, *case, "n_usable")])


def exemplars(df: DataFrame, keys: Sequence[str], score: str, ident: str, whole: bool = False) -> DataFrame:
    """Rows with the lowest, middle and highest score per group (all rows when there are three or fewer)."""
    d = df.where(F.col(score).isNotNull()).withColumn("_one", F.lit(1))
    line = Line(tuple(keys), score, (ident,), whole)
    d = prefix(d, line, {"_rank": ("count", F.col("_one"))})
    sizes = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    d = d.join(sizes, list(keys))
    mid = F.floor(F.col("_n") / 2) + 1
    keep = (F.col("_n") <= 3) | (F.col("_rank") == 1) | (F.col("_rank") == mid) | (F.col("_rank") == F.col("_n"))
    return d.where(keep).drop("_one", "_rank", "_n")


def maxnorm_scores(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Both columns over their group maximum, and two bounded scores of their ratio."""
    ok = F.col(x).isNotNull() & (F.col(x) > 0) & F.col(y).isNotNull() & (F.col(y) >= 0)
    tops = df.where(ok).groupBy(*keys).agg(F.max(x).alias("_xm"), F.max(y).alias("_ym"))
    d = df.join(tops, list(keys), "left")
    xn, yn = F.try_divide(F.col(x), F.col("_xm")), F.try_divide(F.col(y), F.col("_ym"))
    q = F.try_divide(yn, xn)
    out = {
        "x_norm": xn, "y_norm": yn, "q_yx": q, "s_angle": F.atan(q) * (2.0 / F.pi()), "s_ratio": F.try_divide(yn, xn + yn),
    }
    return d.withColumns({n: F.when(ok, c) for n, c in out.items()}).drop("_xm", "_ym")


def _local_fit(points: Column, at: Column, far: Column, y: str) -> Column:
    """Tricube-weighted line through ``points`` evaluated at ``at`` with bandwidth ``far``."""
    zero = F.lit(0.0)
    start = F.struct(*[zero.alias(c) for c in ("w", "u", "y", "uu", "uy")])

    def near(p):
        u = p["x"] - at
        r = F.try_divide(F.abs(u), far)
        w = F.when(r < 1, F.pow(1.0 - F.pow(r, F.lit(3.0)), F.lit(3.0))).otherwise(0.0)
        return F.struct(u.alias("u"), p[y].alias("y"), w.alias("w"))

    def add(acc, p):
        wu, wy = p["w"] * p["u"], p["w"] * p["y"]
        return F.struct(
            (acc["w"] + p["w"]).alias("w"), (acc["u"] + wu).alias("u"), (acc["y"] + wy).alias("y"),
            (acc["uu"] + wu * p["u"]).alias("uu"), (acc["uy"] + wu * p["y"]).alias("uy"),
        )

    def finish(s):
        um, ym = s["u"] / s["w"], s["y"] / s["w"]
        spread = s["uu"] / s["w"] - um * um
        return F.when(s["w"] > 0, F.when(spread > 1e-12, ym - um * (s["uy"] / s["w"] - um * ym) / spread).otherwise(ym))

    return F.aggregate(F.transform(points, near), start, add, finish)


def lowess(df: DataFrame, keys: Sequence[str], x: str, ys: Mapping[str, str], *, carry: Sequence[str] = (), fraction: float = LOWESS_FRACTION, min_n: int = 4, most: int = LOWESS_ROWS) -> DataFrame:
    """Local linear smoothing of minute series (one pass, no robustness rounds).

    A group is one half of one player: at most one row per clock minute, so its array is short. A group of more than
    ``most`` rows fails before anything is gathered: rows are counted in order of ``x``, as they pass.
    ``ys`` maps output names to columns; null values are left out of their own fit.
    """
    names = {out: f"y{i}" for i, out in enumerate(ys)}
    row = F.struct(F.col(x).cast("double").alias("x"), *[F.col(ys[o]).cast("double").alias(names[o]) for o in ys], *[F.col(c) for c in carry])
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(x))
    fault = F.raise_error(F.concat(F.lit(f"lowess takes minute series of at most {most} rows in a group; more at "), F.to_json(F.struct(*keys))))
    counted = df.withColumn("_place", place).withColumn("_row", F.when(F.col("_place") > most, fault.cast(df.select(row.alias("r")).schema["r"].dataType)).otherwise(row))
    d = counted.groupBy(*keys).agg(F.array_sort(F.collect_list("_row")).alias("_pts"))

    def known(y: str) -> Column:
        return F.filter("_pts", lambda p: p[y].isNotNull())

    def bandwidths(y: str) -> Column:
        # distance to the k-th nearest known point, for every point
        n = F.size(f"_p{y}")
        share = F.greatest(F.lit(min(float(fraction), 1.0)), 3.0 / n)
        k = F.floor(F.least(share, F.lit(1.0)) * n + 1e-10).cast("int")
        return F.when(n >= min_n, F.transform("_pts", lambda p: F.get(F.array_sort(F.transform(f"_p{y}", lambda q: F.abs(q["x"] - p["x"]))), k - 1)))

    d = d.withColumns({f"_p{y}": known(y) for y in names.values()})
    d = d.withColumns({f"_h{y}": bandwidths(y) for y in names.values()})

    def fitted(p, i):
        cells = [p["x"].alias(x)]
        for out, y in names.items():
            far = F.get(f"_h{y}", i)
            fit = _local_fit(F.col(f"_p{y}"), p["x"], far, y)
            cells.append(F.when(far.isNotNull() & p[y].isNotNull(), F.coalesce(fit, p[y])).alias(out))
            cells.append(p[y].alias(f"_in_{out}"))
        return F.struct(*cells, *[p[c].alias(c) for c in carry])

    d = d.select(*keys, F.inline(F.transform("_pts", fitted)))
    return d.withColumnsRenamed({f"_in_{o}": c for o, c in ys.items()})


def half_of(minute: Column) -> Column:
    return F.when(minute.between(1, 45), 1).when(minute.between(46, 90), 2)


def relative_scores(minutes: DataFrame, profile: DataFrame, keys: Sequence[str], on: Sequence[str], *, rows: int = 10) -> DataFrame:
    """Standing of each player-minute against a reference profile.

    ``minutes`` has ``(keys, minute, value)``, ``profile`` has ``(on, minute, mean, sd)``. Both curves
    are smoothed per half; their difference over the profile's sd is accumulated and averaged over
    the last ``rows`` minutes, both also mapped through the normal distribution function.
    """
    keys = list(keys)
    d = minutes.join(profile.select(*on, "minute", "mean", "sd"), [*on, "minute"])
    d = d.withColumn("half", half_of(F.col("minute")))
    d = lowess(d, [*keys, "half"], "minute", {"player_fit": "value", "profile_fit": "mean"}, carry=["sd"])
    residual = F.col("player_fit") - F.col("profile_fit")
    d = d.withColumns({"residual": residual, "z": F.when(F.col("sd") > 0, residual / F.col("sd"))})
    line = Line((*keys, "half"), "minute", whole=True)  # at most 45 rows
    d = trailing_mean(running_sums(d, line, "z"), line, "z", "roll10_z", rows)
    d = d.withColumns(
        {"phi_5a": S.normal_cdf(F.col("mean_so_far")), "phi_roll10": S.normal_cdf(F.col("roll10_z")), "sum_z": F.col("cum")}
    )
    return d.drop("cum", "n_so_far", "mean_so_far", "value", "mean")


def half_ends(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Last known value per half of both probabilities and of the accumulated score."""
    def last(c):
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("minute"))).alias(f"{c}_end")

    return scores.groupBy(*keys, "half").agg(last("phi_5a"), last("phi_roll10"), last("sum_z"))


def batch_summary(scores: DataFrame, keys: Sequence[str], phi: str = "phi_roll10") -> DataFrame:
    """Half means, value at minute 45, first value and minutes above one half in period 1."""
    p, m = F.col(phi), F.col("minute")
    first = m <= 45
    return scores.groupBy(*keys).agg(
        F.avg(F.when(first, p)).alias("phi_p1_mean"),
        F.max(F.when(m == 45, p)).alias("phi_p1_end"),
        F.min_by(p, m).alias("phi_start"),
        F.avg(F.when(m > 45, p)).alias("phi_p2_mean"),
        F.count_if(first & (p > 0.5)).alias("n_above_half_p1"),
    )


def line_angle_curve(fitted: DataFrame, y_metric: str, keys: Sequence[str] = (), minute: str = "minute") -> DataFrame:
    return fitted.select(
        F.lit("ols_line_angle").alias("section"), *keys, F.lit(y_metric).alias("y_metric"), "period", F.col(minute).alias("minute"), "roll_A"
    )


def relative_speed_curve(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    z = F.col("roll10_z") if "roll10_z" in scores.columns else F.lit(None).cast("double")
    return scores.select(F.lit("speed_roll10").alias("section"), *keys, "minute", "phi_roll10", z.alias("roll10_z"))


def standing_curve(df: DataFrame) -> DataFrame:
    """Trailing medians to the standing curve: shifted median and the vulnerability norm."""
    m = F.col("best_regret_5min")
    d = df.withColumns({"trailing_median_5min": m, "trailing_median_5min_norm": S.shift_half(m)})
    if "worst_vulnerability_5min" in df.columns:
        d = d.withColumn("worst_vulnerability_5min_norm", S.two_piece_norm(F.col("worst_vulnerability_5min")))
    return d.withColumn("section", F.lit("standing_position"))
