"""Importing this package registers every query."""

from terrashift.plans.catalog import evaluation, folds_pool, regions, scans, statistics, surfaces  # noqa: F401
