"""Every registered query with its SQL twin."""

from queries import analysis, charts, cleaning, columns, profiling, sources, text
from queries.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "analysis", "charts", "cleaning", "columns", "profiling", "sources", "text"]
