"""Queries: operators bound to the given tables, each with its SQL twin where SQL can say it."""

from surveyloom.plans import (associations, bootstraps, causal, cohorts, contracts, evaluation, fitted, flagship, imputation,
                              inference, joining, models, profiles, ranking, saturated)
from surveyloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "associations", "bootstraps", "causal", "cohorts", "contracts", "evaluation", "fitted",
           "flagship", "imputation", "inference", "joining", "models", "profiles", "ranking", "saturated"]
