"""All registered queries of the library and their SQL twins, one module a topic."""

from . import checks, completed, events, scaled, scans, shapes  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
