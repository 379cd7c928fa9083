"""Every operator bound to the driver tables, each with the SQL that must give the same rows."""

from . import base  # noqa: F401


def load() -> dict:
    from . import aggregates, events, joins, kinematics, mixing, plans, reports, possession, scalar, shots, sources, windows  # noqa: F401

    return base.REGISTRY
