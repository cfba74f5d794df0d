"""Named queries over the driver's tables."""

from . import files, statistics, tabular, texts  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
