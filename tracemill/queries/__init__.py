"""Registered queries of the library and their SQL."""

from . import core, files, models  # noqa: F401
from .base import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)


def directly_follows(spark, sf_dir):
    """Directly-follows counts with mean and median durations of the user-day log."""
    return core.g2_edge_durations(spark, sf_dir)
