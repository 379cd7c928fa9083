"""Vendor code tables as literal maps."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values
COARSE_POSITION = {
    "LB": "Defender", "LCB": "Defender", "RCB": "Defender", "RB": "Defender",
    "DM": "Midfielder", "CM": "Midfielder", "AM": "Midfielder",
    "LW": "Attacker", "RW": "Attacker", "CF": "Attacker",
}
BODY = {"R": "Right Foot", "L": "Left Foot", "HE": "Head", "O": "Other"}
SET_PIECE = {
    "O": "Open Play", "F": "Free Kick", "P": "Penalty", "C": "Corner",
    "K": "Open Play", "G": "Open Play", "T": "Open Play",
}
TECHNIQUE = {
    "S": "Normal", "V": "Volley", "O": "Overhead Kick", "D": "Diving Header",
    "F": "Normal", "I": "Normal", "H": "Normal",
}
GAME_PERIOD = {1: "First Half", 2: "Second Half", 3: "Extra Time 1", 4: "Extra Time 2"}
OUTCOME = {
    "G": "Goal", "S": "Save on target", "B": "Block on target", "C": "Block off target",
    "O": "Off target", "F": "Save off target", "L": "Goalline clearance",
}
# model categories, and how other labels fall into them
MODEL_BODY = ("Left Foot", "Other", "Right Foot")
MODEL_SHOT = ("Free Kick", "Open Play", "Penalty")
MODEL_TECHNIQUE = ("Diving Header", "Half Volley", "Lob", "Normal", "Overhead Kick", "Volley")
MODEL_PERIOD = ("First Half", "First Half Ending", "Opening", "Second Half", "Second Half Beginning")
BODY_ALIAS = {"Head": "Other"}
SHOT_ALIAS = {"Corner": "Free Kick", "Kick Off": "Open Play"}
TECHNIQUE_ALIAS = {"Backheel": "Normal"}
PERIOD_ALIAS = {
    "Extra Time 1": "Second Half Beginning", "Extra Time First Half": "Second Half Beginning",
    "Extra Time 2": "Second Half", "Extra Time Second Half": "Second Half",
}
FIRST_TIME_SHOTS = ("V", "F", "D")


def lookup(c: Column, table: dict) -> Column:
    """Value of a code, null when unknown."""
    return F.element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())]), c)


def coarse_position(code: Column) -> Column:
    return lookup(F.upper(code), COARSE_POSITION)


def body_part(code: Column) -> Column:
    return F.coalesce(lookup(code, BODY), F.lit("Right Foot"))


def set_piece(code: Column) -> Column:
    return F.coalesce(lookup(code, SET_PIECE), F.lit("Open Play"))


def technique(shot_code: Column, body_code: Column) -> Column:
    """A diving header needs a header; everything unknown is a normal shot."""
    odd = (shot_code == "D") & ~body_code.eqNullSafe(F.lit("HE"))
    return F.when(odd, "Normal").otherwise(F.coalesce(lookup(shot_code, TECHNIQUE), F.lit("Normal")))


def game_period(period: Column) -> Column:
    return F.coalesce(lookup(period.cast("int"), GAME_PERIOD), F.lit("First Half"))


def outcome(code: Column) -> Column:
    return F.coalesce(lookup(code, OUTCOME), code)


def model_category(label: Column, alias: dict, allowed: tuple[str, ...], default: str) -> Column:
    v = F.coalesce(lookup(label, alias), label)
    return F.when(v.isin(*allowed), v).otherwise(default)
