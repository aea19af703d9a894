"""Registered queries over the driver's tables."""

from workload import files, graphs, reports, tables, texts, training  # noqa: F401
from workload.registry import ORACLES, QUERIES  # noqa: F401
