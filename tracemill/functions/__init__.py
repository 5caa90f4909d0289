"""Column functions."""

from .expressions import epoch_or_text_time, format_duration, natural_order, parse_timestamp, relative_difference, runs_of, sequence_text, typed_text, utc_offset_minutes

__all__ = ["epoch_or_text_time", "format_duration", "natural_order", "parse_timestamp", "relative_difference", "runs_of", "sequence_text", "typed_text", "utc_offset_minutes"]
