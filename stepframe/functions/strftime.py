"""strftime directives on Spark's date patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Strftime directive -> Java pattern letters.
_FORMAT = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "y": "yy", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "p": "a", "I": "hh", "f": "SSSSSS"}
# Parsing accepts one or two digits.
_PARSE = _FORMAT | {"m": "M", "d": "d", "H": "H", "M": "m", "S": "s", "I": "h"}


def _split(fmt: str) -> list[tuple[str, str]]:
    """('directive', letter) and ('text', literal) parts of a format."""
    parts: list[tuple[str, str]] = []
    at = 0
    while at < len(fmt):
        if fmt[at] == "%":
            if at + 1 == len(fmt):
                raise ValueError(f"Format ends with a lone %: {fmt!r}")
            letter = fmt[at + 1]
            parts += [("text", "%")] if letter == "%" else {"F": [("directive", "Y"), ("text", "-"), ("directive", "m"), ("text", "-"), ("directive", "d")], "T": [("directive", "H"), ("text", ":"), ("directive", "M"), ("text", ":"), ("directive", "S")]}.get(letter, [("directive", letter)])
            at += 2
        else:
            end = fmt.find("%", at)
            end = len(fmt) if end < 0 else end
            parts.append(("text", fmt[at:end]))
            at = end
    return parts


def _java(fmt: str, letters: dict[str, str]) -> str:
    out, text = "", ""
    for kind, value in [*_split(fmt), ("end", "")]:
        if kind == "text":
            text += value
            continue
        if text:  # one quoted run, as two quotes in a row would be a quote
            out += "'" + text.replace("'", "''") + "'"
            text = ""
        if kind == "directive":
            if value not in letters:
                raise ValueError(f"Unsupported format directive: %{value}")
            out += letters[value]
    return out


def check_format(fmt: str) -> None:
    """Raise on directives that format_column() doesn't know."""
    for kind, value in _split(fmt):
        if kind == "directive" and value not in _FORMAT and value not in ("G", "V", "u"):
            raise ValueError(f"Unsupported format directive: %{value}")


def to_java(fmt: str) -> str:
    return _java(fmt, _FORMAT)


def to_java_parse(fmt: str) -> str:
    return _java(fmt, _PARSE)


def format_column(x: Column, fmt: str) -> Column:
    """strftime of a date or timestamp; ISO week directives are put together from fields."""
    runs: list[Column] = []
    pending = ""
    for kind, value in _split(fmt):
        field = {
            "G": lambda: F.extract(F.lit("YEAROFWEEK"), x).cast("string"),
            "V": lambda: F.lpad(F.weekofyear(x).cast("string"), 2, "0"),
            "u": lambda: F.extract(F.lit("DAYOFWEEK_ISO"), x).cast("string"),
        }.get(value) if kind == "directive" else None
        if field is None:
            pending += value.replace("%", "%%") if kind == "text" else f"%{value}"
            continue
        if pending:
            runs.append(_plain(x, pending))
            pending = ""
        runs.append(field())
    if pending or not runs:
        runs.append(_plain(x, pending))
    return runs[0] if len(runs) == 1 else F.concat(*runs)


def _plain(x: Column, fmt: str) -> Column:
    """Directives by date_format, literal text as literals."""
    runs: list[Column] = []
    for kind, value in _split(fmt):
        if kind == "text":
            runs.append(F.when(x.isNotNull(), F.lit(value)))
        else:
            runs.append(F.date_format(x, to_java(f"%{value}")))
    return F.concat(*runs) if len(runs) > 1 else runs[0] if runs else F.when(x.isNotNull(), F.lit(""))
