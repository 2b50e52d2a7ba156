"""Text expressions: lines, tokens, numbers.  JVM-side only; nothing throws under ANSI mode."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: White space and line ends as the bulletins' first readers define them, fixed values.
WHITE = r"[\s\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
#: Decimal numbers; nan, inf, hexadecimal and type suffixes count as missing.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INTEGER = r"^[+-]?\d+$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lines(value: Column) -> Column:
    """Lines of a text, without a last empty one; an empty text has none."""
    return let(F.split(value, LINE_END), lambda p: F.slice(p, 1, F.size(p) - F.when(F.try_element_at(p, F.lit(-1)) == "", 1).otherwise(0)))


def strip(value: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(value, f"^{WHITE}+|{WHITE}+$", "")


def tokens(value: Column) -> Column:
    """S3: white-space separated tokens, none of them empty."""
    return F.filter(F.split(value, WHITE + "+"), lambda t: t != "")


def fields(line: Column) -> Column:
    """Fields between pipes, stripped."""
    return F.transform(F.split(line, r"\|"), strip)


def unstarred(value: Column) -> Column:
    """Without asterisks."""
    return F.replace(value, F.lit("*"), F.lit(""))


def to_number(value: Column) -> Column:
    """A double, or null."""
    return F.when(value.rlike(NUMBER), value.try_cast("double"))


def to_integer(value: Column) -> Column:
    """An int from integer text, or null."""
    return F.when(value.rlike(INTEGER), value.try_cast("int"))


def truncated(number: Column) -> Column:
    """A double cut toward zero, or null if it is no int."""
    return number.try_cast("int")


def matched(value: Column, pattern: str, group: int) -> Column:
    """A group of the first match, or null."""
    return F.nullif(F.regexp_extract(value, pattern, group), F.lit(""))


def or_default(value: Column, default: Column) -> Column:
    """Value unless it is null or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), default)


def first_line(rows: Column, prefix: str) -> Column:
    """O3: the first line whose stripped lower-case text starts with prefix, or null."""
    return F.try_element_at(F.filter(rows, lambda l: F.startswith(F.lower(strip(l)), F.lit(prefix))), F.lit(1))


def escaped(value: Column) -> Column:
    """HTML text."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        value = F.replace(value, F.lit(raw), F.lit(safe))
    return value
