"""Text expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as outer blanks of a label.
BLANKS = " \t\r\n\f\v ﻿"


def stripped(c: Column) -> Column:
    """``c`` without outer blanks, tabs and line ends."""
    return F.trim(c, F.lit(BLANKS))


def label(c: Column) -> Column:
    """A label for comparison: no outer blanks, lower case; null stays null."""
    return F.lower(stripped(c))


def lf(c: Column) -> Column:
    """CRLF line ends as LF."""
    return F.replace(c, F.lit("\r\n"), F.lit("\n"))


def truncated(c: Column, limit: int) -> Column:
    """``c`` trimmed and cut to ``limit`` UTF-8 bytes with ``...`` behind a cut.

    A character that straddles the limit is dropped as a whole, so the result stays valid text.
    """
    t = F.trim(c)
    fits = F.octet_length(t) <= limit
    ascii_only = F.octet_length(t) == F.char_length(t)
    by_char = F.aggregate(
        F.split(t, ""),
        F.struct(F.lit("").alias("s"), F.lit(True).alias("go")),
        lambda a, ch: F.struct(
            F.when(a.go & (F.octet_length(a.s) + F.octet_length(ch) <= limit), F.concat(a.s, ch)).otherwise(a.s).alias("s"),
            (a.go & (F.octet_length(a.s) + F.octet_length(ch) <= limit)).alias("go"),
        ),
        lambda a: a.s,
    )
    return F.when(fits, t).when(ascii_only, F.concat(F.left(t, F.lit(limit)), F.lit("..."))).otherwise(F.concat(by_char, F.lit("...")))
