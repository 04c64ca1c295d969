"""Scalar text helpers shared by every operator (Catalyst expressions only)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed value: the characters trimmed from page texts
TRIM_CHARS = " \t\n\r\x00\x0b"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.transform(F.array(value), body).getItem(0)


def bind(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later steps read many times, each evaluated once per row.

    A plain ``withColumn`` may be inlined into every consumer (also into lambdas, and
    into filters pushed below it). A one-element generator is a line Catalyst does
    not move expressions across, and costs no shuffle.
    """
    keep = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    packed = F.array(F.struct(*[v.alias(k) for k, v in columns.items()]))
    return df.select(*keep, F.inline(packed))


def trim_text(c: Column | str) -> Column:
    return F.btrim(as_col(c), F.lit(TRIM_CHARS))


def is_present(c: Column | str) -> Column:
    """Never null: false for null, the empty string and '0'."""
    c = as_col(c)
    return F.coalesce(~c.isin("", "0"), F.lit(False))


def to_int(c: Column | str) -> Column:
    """Leading integer of a text, 0 when there is none; beyond the range of int, its end."""
    digits = F.regexp_extract(as_col(c).cast("string"), r"^\s*([+-]?\d+)", 1)
    value = digits.try_cast("decimal(38,0)")
    inside = F.greatest(F.lit(-(2**31)), F.least(F.lit(2**31 - 1), value))
    end = F.when(F.startswith(digits, F.lit("-")), -(2**31)).otherwise(2**31 - 1)
    found = F.when(value.isNotNull(), inside).when(digits != "", end)
    return F.coalesce(found, F.lit(0)).cast("int")


def split_lines(c: Column | str) -> Column:
    """One entry per line, trimmed, absent ones dropped, order kept."""
    return F.filter(F.transform(F.split(F.coalesce(as_col(c), F.lit("")), "\n"), trim_text), is_present)


def split_csv(c: Column | str) -> Column:
    """Comma list, trimmed, absent ones dropped, order kept."""
    return F.filter(F.transform(F.split(F.coalesce(as_col(c), F.lit("")), ","), trim_text), is_present)


def collapse_space(c: Column | str) -> Column:
    return F.regexp_replace(as_col(c), r"\s+", " ")


def strip_tags(c: Column | str) -> Column:
    """Script and style elements go with their text, other tags alone; trimmed."""
    c = F.regexp_replace(as_col(c), r"(?is)<(script|style)\b[^>]*+>.*?</\1\s*+>", "")
    return trim_text(F.regexp_replace(c, r"(?s)<!--.*?-->|</?[A-Za-z!?][^>]*+>", ""))


def trim_words(c: Column | str, count: int = 55, more: str = "...") -> Column:
    """First ``count`` words of the text without tags, ``more`` when it was cut."""
    words = F.filter(F.split(strip_tags(c), r"[\n\r\t ]+"), lambda w: w != "")
    return let(
        words,
        lambda w: F.when(
            F.size(w) > count, F.concat(F.array_join(F.slice(w, 1, count), " "), F.lit(more))
        ).otherwise(F.array_join(w, " ")),
    )


def last_segment(path: Column) -> Column:
    """Last part of a path, trailing slashes ignored."""
    return F.regexp_extract(F.coalesce(path, F.lit("")), r"([^/]+)/*$", 1)
