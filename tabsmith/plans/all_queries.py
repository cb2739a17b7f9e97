"""Importing this module registers every query."""

from tabsmith.plans import detection, history, modelling, preparation, profiling  # noqa: F401
