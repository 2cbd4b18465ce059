"""Column expressions whose semantics differ from Spark's plain operators."""

from .expressions import c, ieee_divide, ieee_log, quote, round_half_away, strip_blank
from .strftime import check_format, format_column, to_java, to_java_parse

__all__ = ["c", "check_format", "format_column", "ieee_divide", "ieee_log", "quote", "round_half_away", "strip_blank", "to_java", "to_java_parse"]
