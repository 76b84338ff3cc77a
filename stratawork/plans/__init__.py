from . import checks, relational, series, storage
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "checks", "relational", "series", "storage"]
