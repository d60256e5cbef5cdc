"""The query catalogue."""

from .catalog import flagship
from .feeds import parse_box  # noqa: F401 - registers its queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "flagship"]
