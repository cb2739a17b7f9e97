"""Profiling, detection, preparation, modelling, scoring and run-history operators."""
