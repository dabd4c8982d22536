"""Registered queries over the provided tables (``QUERIES``) and their SQL oracles (``ORACLES``)."""

from leakfree.plans import q_cv, q_logs, q_misc, q_ml, q_ops, q_opt, q_stream  # noqa: F401  (registers queries)
from leakfree.plans import q_joins  # noqa: F401,E402  (reuses queries registered above)
from leakfree.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
