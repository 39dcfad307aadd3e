"""Registered queries over the driver tables."""

from stationflow.plans import files, grid_time, live, places, series, tasks, verification  # noqa: F401
from stationflow.plans.registry import QUERIES, SQL  # noqa: F401
