"""Registered queries over the driver's tables, grouped by theme."""

from . import analytics, answers, builders, extra, graph, queue, reading, records, retrieval, structure, text  # noqa: F401
