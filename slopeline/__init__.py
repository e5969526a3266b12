"""Slopeline: road-hazard analytics as PySpark jobs.

Everything is a ``DataFrame -> DataFrame`` or ``Column -> Column`` function; Catalyst plans the
physical work. See README.md for the map from operators to modules.
"""
