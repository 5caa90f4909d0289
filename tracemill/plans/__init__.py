"""Whole analyses made of several operators."""

from .check_fit import check_fit

__all__ = ["check_fit"]
