"""Column functions: coercion, clipping, normalisation, clocks, labels, pitch geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
LEAD_HALF_RANGE_M = 350.0
LEAD_WIDE_HALF_RANGE_M = 600.0
ANGLE_HALF_RANGE_DEG = 42.5
SYNERGY_CAP_PLAYER = 80.0
SYNERGY_CAP_TEAM = 1450.0
VULNERABILITY_MEDIAN = 0.0256378650665283
VULNERABILITY_P95 = 0.11229975186288345
PITCH_LENGTH_M, PITCH_WIDTH_M = 105.0, 68.0
GRID_LENGTH, GRID_WIDTH = 120.0, 80.0

FOCAL, OPP, DEAD, UNRESOLVED = "FOCAL", "OPP", "DEAD", "UNRESOLVED"
TEAMMATE, OPPONENT, NOBODY, DUEL = "TEAMMATE", "OPPONENT", "NONE", "DUEL"
ON_BALL, OFF_BALL = "PLAYER_ON_BALL", "TEAM_POSSESSION_OFF_BALL"
OPPOSITION, BALL_DEAD = "OPPOSITION_POSSESSION", "BALL_OUT_OR_DEAD"
IN_POSS, OUT_POSS, NEUTRAL = "IN_POSSESSION", "OUT_OF_POSSESSION", "DEAD_OR_UNRESOLVED"

# Hart's rational form of the normal tail (highest power first), as published by West (2005)
HART_NUM = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
HART_DEN = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
HART_LIMIT = 7.07106781186547


def num(c: Column) -> Column:
    """Number or null: junk text and NaN both become null."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d), d)


def clamp(c: Column, lo: float, hi: float) -> Column:
    """Clip that keeps null (greatest/least alone would skip it)."""
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def clip_unit(c: Column, half_range: float) -> Column:
    """Map ``[-r, r]`` to ``[0, 1]``, clipped."""
    return clamp((c + half_range) / (2.0 * half_range), 0.0, 1.0)


def angle_unit(score: Column, half_deg: float = ANGLE_HALF_RANGE_DEG) -> Column:
    """Angle score in ``[0, 1]`` back to degrees, then to the clipped unit range."""
    return clip_unit(F.degrees(score * F.pi() - F.pi() / 2), half_deg)


def capped_synergy(player: Column, team: Column, cap_player=SYNERGY_CAP_PLAYER, cap_team=SYNERGY_CAP_TEAM) -> Column:
    """Struct ``(u, v, m)``: both sources capped to the unit range, and their mean."""
    u, v = clip_unit(player, cap_player), clip_unit(team, cap_team)
    return F.struct(u.alias("u"), v.alias("v"), ((u + v) / 2).alias("m"))


def two_piece_norm(c: Column, median: float = VULNERABILITY_MEDIAN, p95: float = VULNERABILITY_P95) -> Column:
    """0.5 at the median, 1 at p95, linear on both sides, clipped."""
    below = F.greatest(c, F.lit(0.0)) * (0.5 / median)
    above = (c - median) * (0.5 / (p95 - median)) + 0.5
    return clamp(F.when(c <= median, below).otherwise(above), 0.0, 1.0)


def benefit(c: Column) -> Column:
    return 1.0 - c


def shift_half(c: Column) -> Column:
    """``min(x + 0.5, 1)``, null kept."""
    return F.when(c.isNotNull(), F.least(c + 0.5, F.lit(1.0)))


def infer_period(minute: Column) -> Column:
    return (
        F.when(minute <= 45, 1).when(minute <= 90, 2).when(minute <= 105, 3).when(minute.isNotNull(), 4)
    )


def regulation_minute(period: Column, clock_s: Column) -> Column:
    """0..44 in period 1, 45..89 in period 2, null in stoppage and extra time."""
    start = (period - 1) * 2700
    inside = period.isin(1, 2) & (clock_s >= start) & (clock_s < start + 2700)
    return F.when(inside, F.floor(clock_s / 60.0).cast("int"))


def video_seconds(ms: Column, seconds: Column, mixed: Column) -> Column:
    """First of three clocks; the last one is in milliseconds when above 10000."""
    return F.coalesce(ms / 1000.0, seconds, F.when(mixed > 10000, mixed / 1000.0).otherwise(mixed))


def clock_minutes(clock_s: Column) -> Column:
    return clock_s / 60.0


def match_phase(period: Column, minute: Column) -> Column:
    """early / middle / late thirds of a half; later periods use the second-half bands."""
    into = minute - F.when(period == 1, 0.0).otherwise(45.0)
    return F.when(into < 15, "early").when(into < 30, "middle").when(into.isNotNull(), "late")


def collapse_team(team: Column) -> Column:
    return F.when(team == FOCAL, IN_POSS).when(team == OPP, OUT_POSS).otherwise(NEUTRAL)


def collapse_context(context: Column, classes: int = 3) -> Column:
    """Context labels to four classes (on/off ball kept apart) or three."""
    dead = context.isin(BALL_DEAD, UNRESOLVED)
    if classes == 4:
        return F.when(dead, NEUTRAL).otherwise(context)
    return F.when(context.isin(ON_BALL, OFF_BALL), IN_POSS).when(context == OPPOSITION, OUT_POSS).otherwise(NEUTRAL)


def in_class(context: Column, label: str) -> Column:
    return context.isin(BALL_DEAD, UNRESOLVED) if label == NEUTRAL else context == label


def player_label(player: Column, team: Column, focal_player: Column, focal_team: Column) -> Column:
    """Who is on the ball, seen from the focal player."""
    return (
        F.when(player.isNull(), NOBODY)
        .when(player == focal_player, FOCAL)
        .when(team == focal_team, TEAMMATE)
        .when(team.isNotNull(), OPPONENT)
        .otherwise(NOBODY)
    )


def possession_context(player_lab: Column, team_lab: Column) -> Column:
    return (
        F.when(team_lab == DEAD, BALL_DEAD)
        .when(team_lab == OPP, OPPOSITION)
        .when((team_lab == FOCAL) & (player_lab == FOCAL), ON_BALL)
        .when(team_lab == FOCAL, OFF_BALL)
        .otherwise(UNRESOLVED)
    )


def is_true_text(c: Column) -> Column:
    """Vendor truth text: 1 / true / t / yes in any case; null stays null."""
    return F.lower(F.trim(c.cast("string"))).isin("1", "true", "t", "yes")


def team_label(team: Column, home_ball: Column, focal_team: Column, home_team: Column) -> Column:
    """Struct ``(label, how)``: the team id decides, the home-ball flag only fills or conflicts."""
    by_id = F.when(team == focal_team, FOCAL).when(team.isNotNull(), OPP)
    by_flag = F.when(is_true_text(home_ball) == (focal_team == home_team), FOCAL).when(
        home_ball.isNotNull() & home_team.isNotNull(), OPP
    )
    how = (
        F.when(by_id.isNull() & by_flag.isNull(), "unresolved")
        .when(by_id.isNull(), "home_ball")
        .when(by_flag.isNull() | (by_flag == by_id), "team_id")
        .otherwise("team_id_over_home_ball_conflict")
    )
    return F.struct(F.coalesce(by_id, by_flag, F.lit(UNRESOLVED)).alias("label"), how.alias("how"))


def to_attack_grid(x: Column, y: Column, direction: Column) -> Column:
    """Centre-origin metres to the 120 x 80 grid, always attacking towards x = 120."""
    sign = F.when(F.upper(F.substring(direction, 1, 1)) == "L", -1.0).otherwise(1.0)
    return F.struct(
        ((sign * x + PITCH_LENGTH_M / 2) * (GRID_LENGTH / PITCH_LENGTH_M)).alias("x"),
        ((sign * y + PITCH_WIDTH_M / 2) * (GRID_WIDTH / PITCH_WIDTH_M)).alias("y"),
    )


def _horner(x: Column, coefs: tuple[float, ...]) -> Column:
    acc = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + c
    return acc


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function to about 1e-15, as one arithmetic expression."""
    a = F.abs(z)
    density = F.exp(-a * a / 2)
    body = density * _horner(a, HART_NUM) / _horner(a, HART_DEN)
    cf = a + 0.65
    for n in (4, 3, 2, 1):
        cf = a + n / cf
    far = density / cf / 2.506628274631
    upper = F.when(a < HART_LIMIT, body).when(a <= 37, far).when(a.isNotNull(), 0.0)
    return F.when(z > 0, 1.0 - upper).otherwise(upper)


def distance_share(mine: Column, near: Column, floor: float) -> Column:
    """``(mine-near)/(mine+near)`` moved to ``[0, 1]``; null while the sum is under ``floor``."""
    total = mine + near
    return F.when(total >= floor, ((mine - near) / total + 1.0) / 2)


def distance_ratio(mine: Column, near: Column, floor: float) -> Column:
    """``mine/near - 1``, null while either the sum or the denominator is under ``floor``."""
    return F.when((mine + near >= floor) & (near >= floor), mine / near - 1.0)


def slope_score(slope: Column, intercept: Column, s_x: Column, s_y: Column, x_ref: Column) -> dict[str, Column]:
    """Scale-free slope, its angle, the angle score in ``[0, 1]`` and the height at ``x_ref``."""
    b = slope * F.try_divide(s_x, s_y)
    theta = F.atan(b)
    return {
        "roll_b_star": b,
        "roll_theta_deg": F.degrees(theta),
        "roll_A": (theta + F.pi() / 2) / F.pi(),
        "roll_H": intercept + slope * x_ref,
    }


def at_digits(x: Column, digits: int) -> Column:
    """``x`` at so many decimals as SQL's ``round`` of a double takes it: the product with ``10 ** digits`` rounded half away from zero.

    Spark's ``round`` goes by the shortest decimal text of ``x``, which calls ties what the product puts just below or above one.
    """
    scale = F.lit(float(10**digits))
    scaled = x * scale
    return F.when(F.abs(scaled) < float("inf"), F.round(scaled, 0) / scale).otherwise(x)


def composite(p: Column, w: Column, q: Column) -> Column:
    """``(1-w)p + wq`` where ``w > 0``, else ``p``."""
    return F.when(w > 0, (1.0 - w) * p + w * q).otherwise(p)
