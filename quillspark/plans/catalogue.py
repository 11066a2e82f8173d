"""All registered queries: importing this fills the registry."""

from quillspark.plans import frames, relations, scalars, search, sequences, states, udf_queries  # noqa: F401
from quillspark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
