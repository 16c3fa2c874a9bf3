"""All registered queries."""

from syncohort.plans import (  # noqa: F401
    cases_cohort,
    cases_privacy,
    cases_stats,
    cases_synthesis,
    cases_utility,
)
from syncohort.plans.cases import CHECKS, QUERIES

__all__ = ["CHECKS", "QUERIES"]
