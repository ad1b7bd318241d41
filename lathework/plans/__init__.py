"""Registered queries over the driver's tables."""

from lathework.plans import benchmarks, evaluate, prepare, retrieve, science, storage  # noqa: F401
from lathework.plans.registry import ORACLES, QUERIES  # noqa: F401
