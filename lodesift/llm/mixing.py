"""A mix of sources at target shares of the total size, with a cap on repeats.

Sizes per source are summed first; the shares are then found on that table (one row per
target) by capped water-filling: a source that can't fill its part even with all repeats is taken
that often, and what it lacks is spread over the others in proportion to their targets, until all fit.
Sources are clamped in the order of how soon they are full, so sums over those before tell for each whether it is clamped: the
targets are sorted and summed up in ranges, and neither they nor the sizes come to the driver.
Whole repeats are copies of every document; of the fraction, those documents are taken whose seeded
hash lies below a bound, which is set from a histogram of sizes over the hash, so that the fraction is met to
about one part in the number of bins. No source is sorted or gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodesift.llm import tokens
from lodesift.session import cut

#: Bins of the size histogram of a source.
BINS = 1 << 14
#: Targets up to which their table (under 100 bytes a row) is broadcast to the documents; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000


def source_name(c: Column) -> Column:
    """A source's name: no outer blanks, lower case, ``_`` for ``-`` and blanks."""
    return F.regexp_replace(F.lower(F.trim(c, F.lit(" \t\r\n"))), r"[\s\-]+", "_")


def plan(docs: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """``source, target_share, max_repeats, n_docs, n_tokens, planned`` per target; ``docs`` has ``source, n_tokens``.

    ``total`` is the size of the mix, by default that of all documents of the targeted sources. Repeated targets count as the
    first by share, null sources and shares as none; sources without documents or with a cap of 0 give nothing. Shares are
    scaled to 1, and the sum of ``planned`` is ``total`` unless all sources are at their cap. There may be any number of targets.
    """
    goal = targets.select(source_name(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.coalesce(F.col("max_repeats").cast("int"), F.lit(1)).alias("cap")).where("source IS NOT NULL AND share IS NOT NULL AND share >= 0").groupBy("source").agg(F.max(F.struct("share", "cap")).alias("x")).select("source", "x.*")
    have = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    none = F.lit(0).cast("bigint")
    rows = goal.join(have, "source", "left").withColumns({"n_docs": F.coalesce("n_docs", none), "n_tokens": F.coalesce("n_tokens", none)})
    most = F.when(F.col("share") > 0, F.greatest("cap", F.lit(0)) * F.col("n_tokens")).otherwise(0).cast("double")
    # ranges of sources by when they are full: within a range a window sums up, the sums of the ranges before are added
    ranged = cut(rows.withColumn("most", most).withColumn("full_at", F.when(F.col("share") > 0, F.col("most") / F.col("share")).otherwise(0.0)).repartitionByRange("full_at", "source").withColumn("range", F.spark_partition_id()))
    of_range = ranged.groupBy("range").agg(F.sum("most").alias("most"), F.sum("share").alias("share"), F.sum("n_tokens").alias("tokens"))
    # one row per range, at most as many as shuffle partitions
    before = of_range.select(
        "range",
        (F.sum("most").over(Window.orderBy("range")) - F.col("most")).alias("most_before"),
        (F.sum("share").over(Window.orderBy("range")) - F.col("share")).alias("share_before"),
        F.sum("share").over(Window.partitionBy()).alias("all_shares"),
        (F.sum("tokens").over(Window.partitionBy()) if total is None else F.lit(total)).cast("double").alias("total"),
    )
    so_far = Window.partitionBy("range").orderBy("full_at", "source").rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.join(before, "range").withColumns({c: F.col(f"{c}_before") + F.coalesce(F.sum(c).over(so_far), F.lit(0.0)) for c in ("most", "share")} | {"own_most": F.col("most"), "own_share": F.col("share")})
    # a source is clamped if, with those before full and all others filled as far as itself, no more than the total is given
    clamped = summed.withColumn("clamped", F.col("most") + F.col("full_at") * (F.col("all_shares") - F.col("share")) <= F.col("total"))
    level = clamped.agg(
        F.coalesce(F.sum(F.when(F.col("clamped"), F.col("own_most"))), F.lit(0.0)).alias("given"),
        F.sum(F.when(~F.col("clamped"), F.col("own_share"))).alias("open"),
    )
    scale = F.when(F.col("all_shares") > 0, F.col("all_shares")).otherwise(1.0)
    filled = clamped.join(F.broadcast(level)).select(
        "source",
        (F.col("own_share") / scale).alias("target_share"),
        F.col("cap").alias("max_repeats"),
        "n_docs",
        "n_tokens",
        F.when(F.col("clamped"), F.col("own_most")).otherwise((F.col("total") - F.col("given")) * F.col("own_share") / F.col("open")).alias("planned"),
    )
    return cut(filled)


def mix(docs: DataFrame, the_plan: DataFrame, seed: int = 0, bins: int = BINS) -> DataFrame:
    """``doc_id, source, n_tokens, n_copies`` of the documents taken; ``docs`` has ``doc_id, source, n_tokens``.

    The same seed gives the same mix, whatever the partitioning. No document has more copies than
    its source's ``max_repeats``.
    """
    goal = the_plan.select("source", "max_repeats", F.when(F.col("n_tokens") > 0, F.col("planned") / F.col("n_tokens")).otherwise(0.0).alias("epochs"), "n_tokens").withColumn("whole", F.floor(F.col("epochs") + 1e-9).cast("int")).withColumn("rest", F.greatest(F.lit(0.0), (F.col("epochs") - F.col("whole")) * F.col("n_tokens")))
    small = the_plan.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS

    def sent(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if small else df

    binned = docs.withColumn("bin", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(bins)).cast("int"))
    hist = binned.groupBy("source", "bin").agg(F.sum("n_tokens").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("bin"))
    # bins up to the one in which the fraction is reached, with that one if this is nearer
    bound = (
        hist.join(sent(goal.select("source", "rest")), "source")
        .withColumn("upto", upto)
        .where(F.col("upto") - F.col("n") / 2 <= F.col("rest"))
        .groupBy("source")
        .agg(F.max("bin").alias("last_bin"))
    )
    chosen = goal.join(bound, "source", "left").withColumn("last_bin", F.when(F.col("rest") > 0, F.coalesce("last_bin", F.lit(-1))).otherwise(-1)).select("source", "whole", "max_repeats", "last_bin")
    taken = binned.join(sent(chosen), "source").withColumn("n_copies", F.least(F.col("whole") + F.when(F.col("bin") <= F.col("last_bin"), 1).otherwise(0), F.col("max_repeats")))
    return taken.where("n_copies > 0").select("doc_id", "source", "n_tokens", "n_copies")


def report(the_plan: DataFrame, taken: DataFrame) -> DataFrame:
    """Per target: what there is, what was planned and taken, the share reached, and whether the target can be reached."""
    got = taken.groupBy("source").agg(F.count(F.lit(1)).alias("docs_taken"), F.sum("n_copies").alias("copies"), F.sum(F.col("n_tokens") * F.col("n_copies")).alias("tokens_taken"))
    joined = the_plan.join(got, "source", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("docs_taken", "copies", "tokens_taken")})
    whole = F.sum("tokens_taken").over(Window.partitionBy())
    return joined.withColumns(
        {
            "share_reached": F.when(whole > 0, F.col("tokens_taken") / whole).otherwise(0.0),
            "epochs": F.when(F.col("n_tokens") > 0, F.col("tokens_taken") / F.col("n_tokens")).otherwise(0.0),
            "at_cap": F.col("planned") >= F.col("max_repeats") * F.col("n_tokens"),
        }
    )


def sized(documents: DataFrame, name: str = "byte_bpe_50k", folder: str = tokens.TOKENIZERS) -> DataFrame:
    """``doc_id, source, n_tokens`` of the documents with a source and tokens, written once for the passes that follow."""
    keyed = documents.select(F.struct("doc_id", source_name(F.col("source")).alias("source")).alias("k"), F.when(F.col("source").isNotNull(), F.col("text")).alias("text"))
    return cut(tokens.counts(keyed, "k", "text", name, folder).select("k.*", "n_tokens").where("n_tokens > 0 AND source IS NOT NULL"))
