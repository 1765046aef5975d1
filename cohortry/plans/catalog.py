"""Imports every query module once and exposes the filled registry."""

from cohortry.plans import countries, experiments, models, profiles, samples, statistics, users  # noqa: F401
from cohortry.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
