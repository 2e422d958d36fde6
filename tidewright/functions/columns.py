"""Column helpers: dates, nulls and text."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The strings that a CSV reader with default settings takes for missing.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


#: Fixed value: the white space that lines and fields are trimmed of.
WHITE = " \t\n\x0b\x0c\r"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_floor(c: Column | str) -> Column:
    """First day of the month, as a DATE."""
    return F.trunc(col(c), "month")


def month_number(c: Column | str) -> Column:
    return F.month(col(c))


def nan_to_null(c: Column | str) -> Column:
    """NaN measures become null, so that sums and means skip them and maxima ignore them."""
    return F.when(~F.isnan(col(c)), col(c))


def missing_to_null(c: Column | str) -> Column:
    return F.when(~F.coalesce(F.trim(col(c)).isin(*MISSING), F.lit(False)), col(c))


def falsy_coalesce(first: Column | str, second: Column | str) -> Column:
    """The first value unless it is null or zero."""
    return F.coalesce(F.nullif(col(first), F.lit(0)), col(second))


def key_value(c: Column | str) -> tuple[Column, Column, Column]:
    """(whether a line holds one, key, value) of `key = value` lines: split at the first =, trimmed; # starts a comment."""
    line = col(c)
    at, bare = F.instr(line, "="), lambda x: F.btrim(x, F.lit(WHITE))
    return (at > 0) & ~F.startswith(bare(line), F.lit("#")), bare(F.split_part(line, F.lit("="), F.lit(1))), bare(F.substring(line, at + 1, F.length(line)))


def contains_any_case(c: Column | str, part: str) -> Column:
    return F.coalesce(F.lower(col(c)).contains(part.lower()), F.lit(False))


def holds_none(c: Column | str, parts: Iterable[str]) -> Column:
    """Whether a text has none of the parts in it."""
    return reduce(lambda a, b: a & b, [~col(c).contains(p) for p in parts], F.lit(True))


def json_value(c: Column | str, name: str, kind: str) -> Column:
    """A field of a JSON object; null if it is not there or is of another kind."""
    return F.from_json(col(c), f"struct<`{name}`: {kind}>")[name]


def stamp(now: Column | None = None) -> Column:
    return F.date_format(F.current_timestamp() if now is None else now, "yyyy-MM-dd HH:mm")
