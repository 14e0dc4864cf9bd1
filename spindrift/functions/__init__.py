"""Vector functions: Spark SQL expressions, and the same as SQL functions of a session."""

from spindrift.functions.registration import register
from spindrift.functions.vectors import METRICS, TYPES

__all__ = ["METRICS", "TYPES", "register"]
