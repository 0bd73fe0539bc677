"""One surviving record per duplicate group by skyline selection.

Every record has three qualities: trust (an ordered policy vector), recency and completeness
(the set of filled fields). A record is dominated by one that the policy prefers and that is no
less recent and fills at least the same fields. The skyline is the set of undominated records; the
policy's first record is always in it and survives. Its blank fields are filled from the other
members, layer after layer of dominance: whoever dominates a record that fills a field fills it too, so every field that any
member fills is filled in the first layer, and the later ones have nothing left to give.

Scale: members that agree in group, trust and filled fields are reduced, before the shuffle, to the
newest of them (the others are dominated by it and can fill nothing it can't). Dominance is a running maximum: in the
policy's order, a record is dominated if a record before it, among those that fill at least its fields, is no less recent. Each record is
laid beside every set of fields of its group that it covers, and one sorted pass over group and set tells; nothing is
gathered, rows are compared once and not in pairs, and a large group is sorted on disk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def survivors(
    df: DataFrame,
    keys: Sequence[str],
    record_id: str,
    recency: str,
    trust: Sequence[Column],
    fields: dict[str, Column],
    fill: bool = True,
) -> DataFrame:
    """The survivor of each group of two or more records.

    ``trust``: the policy's columns, the higher the better, compared one after the other; ties go to
    the newest ``recency``, then to the smallest ``record_id``. Text columns that should count
    downwards are passed as arrays of negated code points (see ``descending``). ``fields``: name and
    value of the fields to fill; null means blank. Without ``fill`` they only tell which are filled, and their values
    aren't carried along.

    Result: the keys, ``first_id``, ``best_id``, ``n_members``, ``n_skyline``, the
    filled fields and ``filled_from`` (a map of field to the record it was taken from, without the
    survivor's own). Rows with a null key are in no group; a null recency is the oldest; rows that
    repeat a ``record_id`` are one member; an empty table gives no row. Extra columns are ignored.
    """
    own = [f"__k{i}" for i in range(len(keys))]
    names = list(fields)
    rec = df.select(
        *[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)],
        F.col(record_id).alias("__id"),
        F.col(recency).alias("__at"),
        F.struct(*[c.alias(f"t{i}") for i, c in enumerate(trust)]).alias("__trust"),
        sum((F.when(c.isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, c in enumerate(fields.values())), F.lit(0).cast("bigint")).alias("__mask"),
        (F.struct(*[c.alias(n) for n, c in fields.items()]) if fill and fields else F.lit(True)).alias("__f"),
    ).where(F.forall(F.array(*[F.col(o).isNotNull() for o in own]), lambda x: x) & F.col("__id").isNotNull())
    cells = (
        rec.groupBy(*own, "__trust", "__mask")
        .agg(
            F.max_by(F.struct("__id", "__at", "__f"), F.struct(F.col("__at"), -F.col("__id"))).alias("__r"),
            F.min("__id").alias("__first"),
            F.max("__id").alias("__last"),
            F.count(F.lit(1)).alias("__n"),
        )
    )
    group = Window.partitionBy(*own)
    members = (
        cells.select(
            *own,
            F.struct(F.col("__trust").alias("trust"), F.col("__r.__at").alias("at"), (-F.col("__r.__id")).alias("neg_id")).alias("__policy"),
            F.coalesce(F.unix_micros(F.col("__r.__at").cast("timestamp")), F.lit(-(1 << 62)).cast("bigint")).alias("__at"),
            "__mask",
            F.col("__r.__f").alias("__f"),
            F.min("__first").over(group).alias("first_id"),
            F.max("__last").over(group).alias("__end"),
            F.sum("__n").over(group).alias("n_members"),
            F.collect_set("__mask").over(group).alias("__masks"),
        )
        .where(F.col("first_id") != F.col("__end"))
    )
    # a record stands beside each set of fields that it covers; its own set comes with its values
    covered = F.filter("__masks", lambda m: m.bitwiseAND(F.col("__mask")) == m)
    laid = members.withColumn("__set", F.explode(covered)).withColumn("__f", F.when(F.col("__set") == F.col("__mask"), F.col("__f")))
    before = Window.partitionBy(*own, "__set").orderBy(F.col("__policy").desc()).rowsBetween(Window.unboundedPreceding, -1)
    newest = F.max("__at").over(before)
    skyline = laid.withColumn("__newest", newest).where((F.col("__set") == F.col("__mask")) & (F.col("__newest").isNull() | (F.col("__newest") < F.col("__at"))))
    kept = [F.first("first_id").alias("first_id"), (-F.max("__policy")["neg_id"]).alias("best_id"), F.first("n_members").alias("n_members"), F.count(F.lit(1)).cast("int").alias("n_skyline")]
    back = [F.col(o).alias(k) for o, k in zip(own, keys, strict=True)]
    if not fill or not fields:
        return skyline.groupBy(*own).agg(*kept).select(*back, "first_id", "best_id", "n_members", "n_skyline")

    def given(n: str) -> Column:
        """The value and record of the first of the skyline that fills the field."""
        value = F.col("__f").getField(n)
        return F.max_by(F.struct(value.alias("v"), (-F.col("__policy.neg_id")).alias("id")), F.when(value.isNotNull(), F.col("__policy"))).alias(f"__g_{n}")

    filled = skyline.groupBy(*own).agg(*kept, *[given(n) for n in names])
    donors = F.map_filter(
        F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(f"__g_{n}")["id"] for n in names])),
        lambda k, v: v.isNotNull() & (v != F.col("best_id")),
    )
    return filled.select(*back, "first_id", "best_id", "n_members", "n_skyline", *[F.col(f"__g_{n}")["v"].alias(n) for n in names], donors.alias("filled_from"))


def descending(c: Column) -> Column:
    """A text as a value that sorts the other way round: the lowest text becomes the highest value."""
    points = F.transform(F.split(F.coalesce(c, F.lit("")), ""), lambda ch: -F.coalesce(F.ascii(F.nullif(ch, F.lit(""))), F.lit(0)))
    return F.concat(points, F.array(F.lit(0)))  # the end of a text is lower than any character
