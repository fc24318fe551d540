"""Registered queries: each applies operators to a carrier view and, where SQL can say the same, comes with that SQL."""

from voxframe.plans import cohorts, models, normalising, scalars, scoring, spatial, statistics  # noqa: F401
from voxframe.plans.registry import ORACLES, QUERIES  # noqa: F401
