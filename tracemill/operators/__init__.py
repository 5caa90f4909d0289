"""Operators on event logs, variants, relations and nets."""
