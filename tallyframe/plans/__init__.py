"""Named queries over the driver's tables."""

from tallyframe.plans import answers, budgets, cells, inference, records, reports, rounds, studies
from tallyframe.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "answers", "budgets", "cells", "inference", "records", "reports", "rounds", "studies"]
