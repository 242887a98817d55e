"""Column functions."""

from .text import after_prefix, count_inside, format_3dp, is_heading, lines_of, starts_with_any, strip

__all__ = ["after_prefix", "count_inside", "format_3dp", "is_heading", "lines_of", "starts_with_any", "strip"]
