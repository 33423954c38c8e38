"""Every operator as a query over the given tables, with equivalent SQL where there is any."""

from cohortspark.queries.registry import ORACLES, QUERIES
from cohortspark.queries import clinical, events, metrics, models, selection, storage  # noqa: F401  (register)

__all__ = ["ORACLES", "QUERIES"]
