"""Runnable queries over the given tables, one module per operator family."""

from slopeline.catalog import (  # noqa: F401
    assembly, graph, joins, learning, quality, ranking, scalars, spatial, streams, temporal, text,
)
from slopeline.catalog.registry import QUERIES, Tables, run

__all__ = ["QUERIES", "Tables", "run"]
