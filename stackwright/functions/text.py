"""Texts made from columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def elapsed(seconds: Column) -> Column:
    """Whole seconds as [DD:]HH:MM:SSs."""

    def two(c: Column) -> Column:
        return F.lpad(c.cast("long").cast("string"), 2, "0")

    days = F.when(seconds >= 86400, F.concat(two(F.floor(seconds / 86400)), F.lit(":"))).otherwise("")
    return F.concat(days, two(F.floor(seconds / 3600) % 24), F.lit(":"), two(F.floor(seconds / 60) % 60), F.lit(":"), two(seconds % 60), F.lit("s"))


def named(template: str, **values: Column) -> Column:
    """A name from a template with {fields}: each is replaced by its column's text."""
    out = F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), v.cast("string"))
    return out


def n_words(text: Column) -> Column:
    """Runs of characters that are not white space (space, U+0009 to U+000D)."""
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+"))


def n_lines(text: Column) -> Column:
    """Lines of a text, the last one counted also without a line end; an empty text has none."""
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(F.length(text) == 0, 0).otherwise(ends + F.when(text.endswith("\n"), 0).otherwise(1))
