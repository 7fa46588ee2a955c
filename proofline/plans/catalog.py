"""All registered queries."""

from proofline.plans import calibration, correlation, evaluation, extraction, jobs, reports, scoring, sources  # noqa: F401
from proofline.plans.registry import CHECK_SQL, QUERIES

__all__ = ["CHECK_SQL", "QUERIES"]
