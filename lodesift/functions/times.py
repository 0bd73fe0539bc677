"""Times in several notations, read without depending on the session's zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodesift.functions.text import stripped

_ISO = r"^\d{4}-\d{2}-\d{2}([Tt ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?)?\s*([Zz]|[+-]\d{2}(:?\d{2})?)?$"


def epoch_seconds(c: Column) -> Column:
    """Whole seconds since 1970 of a time text, or null where it can't be read.

    Read are ISO dates and times with ``T`` or a blank, fractions (cut), ``Z``, ``+hh``, ``+hhmm``
    or ``+hh:mm``; a text without zone is UTC; all-digit texts are such seconds already. The year
    0000, blank texts and anything else give null.
    """
    t = F.upper(stripped(c))
    zone = F.regexp_extract(t, r"[T ]\d{2}:\d{2}.*?([+-]\d{2}(?::?\d{2})?)$", 1)
    digits = F.regexp_replace(zone, r"[^0-9]", "")
    offset = F.when(zone == "", F.lit(0)).otherwise(
        F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1)
        * (F.substring(digits, 1, 2).cast("int") * 3600 + F.coalesce(F.nullif(F.substring(digits, 3, 2), F.lit("")).cast("int"), F.lit(0)) * 60)
    )
    day, clock = F.substring(t, 1, 10), F.regexp_extract(t, r"[T ](\d{2}:\d{2}(?::\d{2})?)", 1)
    clock = F.when(clock == "", "00:00:00").when(F.length(clock) == 5, F.concat(clock, F.lit(":00"))).otherwise(clock)
    utc = F.try_to_timestamp(F.concat(day, F.lit("T"), clock, F.lit("Z")), F.lit("yyyy-MM-dd'T'HH:mm:ssX"))
    read = F.when(t.rlike(_ISO) & ~F.startswith(t, F.lit("0000")), F.unix_seconds(utc) - offset)
    return F.when(t.rlike(r"^\d{1,18}$"), t.try_cast("bigint")).otherwise(read)
