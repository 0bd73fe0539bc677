"""One row per entity with counts, totals and recency for each event type.

Rows are first reduced to (entity, event type), in the map tasks already; only that compact long
table is pivoted, over an explicit type list, so no pass is needed to learn the types and no entity
has more rows in the pivot than there are types.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, keys: Sequence[str], first: Column) -> DataFrame:
    """One row per ``keys``: that with the lowest ``first``. Null keys equal each other.

    The keys name single entries, so even a hot entity is spread over many of them.
    """
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), first).alias("__r")).select(*keys, *[F.col("__r")[c].alias(c) for c in rest])


def long_features(df: DataFrame, entity: str, kind: str, measures: dict[str, Column]) -> DataFrame:
    """``entity, kind`` and the aggregate ``measures``; rows without entity or kind are left out."""
    return df.where(F.col(entity).isNotNull() & F.col(kind).isNotNull()).groupBy(entity, kind).agg(*[m.alias(n) for n, m in measures.items()])


def feature_table(long: DataFrame, entity: str, kind: str, measures: Sequence[str], kinds: Sequence[str], as_of: Column | None = None, recency_of: str | None = None) -> DataFrame:
    """A row per entity of ``long`` with ``<kind>__<measure>`` for each of ``kinds``.

    Counts and totals of a type that doesn't occur are 0, its ``recency_of`` measure is null. With
    ``as_of`` (seconds) that measure becomes an age in seconds. Types beyond the list are summed
    in ``other__<measure>`` (the newest for ``recency_of``), so that no row is lost. Column names
    have ``_`` for every run of other characters than letters, digits and ``*``.
    """
    columns = [*kinds, "other"]
    place = {k: i for i, k in enumerate(kinds)}
    number = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in place.items() for x in kv]), F.col(kind)), F.lit(len(kinds))) if place else F.lit(0)
    folded = long.withColumn("__at", number).groupBy(entity, "__at").agg(*[(F.max(m) if m == recency_of else F.sum(m)).alias(m) for m in measures])
    # an entity's types, at most one struct for each of the list, laid out at their places; the columns are then read off one array
    held = folded.groupBy(entity).agg(F.map_from_entries(F.collect_list(F.struct("__at", F.struct(*measures)))).alias("__held"))
    none = F.struct(*[(F.lit(None) if m == recency_of else F.lit(0)).cast(folded.schema[m].dataType).alias(m) for m in measures])
    wide = held.select(entity, (F.lit(None) if as_of is None else as_of).cast("bigint").alias("__as_of"), F.transform(F.sequence(F.lit(0), F.lit(len(kinds))), lambda i: F.coalesce(F.try_element_at("__held", i), none)).alias("__row"))

    def column(i: int, k: str, m: str) -> str:
        aged = m == recency_of and as_of is not None
        c = f"get(__row, {i}).`{m}`"
        return f"{f'__as_of - {c}' if aged else c} AS `{column_name(k)}__{'age_s' if aged else m}`"

    return wide.selectExpr(f"`{entity}`", *[column(i, k, m) for i, k in enumerate(columns) for m in measures])


def column_name(kind: str) -> str:
    """A type's name as part of a column name."""
    out = "".join(ch if ch.isalnum() or ch == "*" else "_" for ch in kind)
    return out.replace("*", "any")
