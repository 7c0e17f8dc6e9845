"""Cleaning and formatting of text columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ESTIMATE_PATTERN = r"^\s*([^\s%(]+)%?\s*\(\s*(\S+)\s+-\s+([^\s)]+)\s*\)\s*$"


def strip_censor(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Remove `<` and `>` from text columns, so that `<5` reads as 5."""
    names = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]

    def stripped(text: Column) -> Column:
        return F.when(text.contains("<") | text.contains(">"), F.translate(text, "<>", "")).otherwise(text)

    return df.withColumns({c: stripped(F.col(f"`{c}`")) for c in names})


def to_number(column: Column) -> Column:
    """Lenient numeric cast: unreadable text and NaN become null."""
    number = F.trim(column.cast("string")).try_cast("double")
    return F.nanvl(number, F.lit(None).cast("double"))


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: to_number(F.col(f"`{c}`")) for c in columns})


def require_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Strict numeric cast: unreadable text stops the job."""

    def strict(column: Column) -> Column:
        written = column.isNotNull() & (F.trim(column.cast("string")) != "")
        message = F.concat(F.lit("not a number: "), column.cast("string"))
        return F.coalesce(to_number(column), F.when(written, F.raise_error(message).cast("double")))

    return df.withColumns({c: strict(F.col(f"`{c}`")) for c in columns})


def map_literal(mapping: Mapping[str, object]) -> Column:
    return F.create_map(*[F.lit(part) for pair in mapping.items() for part in pair])


def recode(column: Column, mapping: Mapping[str, object], keep_unmapped: bool = True) -> Column:
    """Replace codes through a fixed map; codes outside it pass through or become null."""
    found = F.try_element_at(map_literal(mapping), column)
    return F.coalesce(found, column) if keep_unmapped else found


def format_percent_ci(point: Column, low: Column, high: Column) -> Column:
    """`85.0% (80.1 - 89.2)` from proportions; the bounds are rounded to 3 digits, then shown in percent.

    Without bounds there is no text.
    """
    shown = [F.round(point * 100, 1), F.round(F.round(low, 3) * 100, 1), F.round(F.round(high, 3) * 100, 1)]
    complete = point.isNotNull() & low.isNotNull() & high.isNotNull()
    return F.when(complete, F.format_string("%.1f%% (%.1f - %.1f)", *shown))


def format_auc_ci(auc: Column, low: Column, high: Column) -> Column:
    """`0.9 (0.88 - 0.92)`: three digits at most, trailing zeros dropped."""

    def short(value: Column) -> Column:
        text = F.when(value.isNotNull(), F.format_string("%.3f", F.round(value, 3)))
        return F.regexp_replace(text, r"(\.\d+?)0+$", "$1")

    return F.concat(short(auc), F.lit(" ("), short(low), F.lit(" - "), short(high), F.lit(")"))


def parse_ci(column: Column) -> tuple[Column, Column, Column]:
    """Read `a (l - u)` back into three numbers; text of another shape gives nulls."""
    parts = [F.regexp_extract(column, ESTIMATE_PATTERN, i).try_cast("double") for i in (1, 2, 3)]
    return parts[0], parts[1], parts[2]
