"""From the findings of all layers to one decision per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodesift.functions.paths import is_test
from lodesift.functions.scoring import base_confidence, blocks, boosted, category, confidence_label, severity_label, tier
from lodesift.operators.survivors import descending

_RANK = {"high": 3, "medium": 2, "low": 1}


def confidence_rank(c: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in _RANK.items() for x in kv]), F.lower(c)), F.lit(0))


def scored(findings: DataFrame) -> DataFrame:
    """With the layer's ``tier`` and a positive ``confidence_score``."""
    t = tier(F.col("tags"), F.col("rule_id"))
    return findings.withColumn("tier", t).withColumn("confidence_score", base_confidence(F.col("confidence_score"), F.col("tier"), F.lower("confidence")))


def merged(findings: DataFrame, scan: str = "entry_id", order: str = "finding_id") -> DataFrame:
    """One finding per (scan, file, line, CWE): the winner by tier, severity, confidence and rule id, with all members' tags
    (its own first), and a tenth more confidence per further tier, at most 1.

    Findings without CWE or line pass through. Ties beyond the rule id go to the lowest ``order``. One aggregation with
    partial results: of a hot group each map task sends one winner and its distinct tag lists, which are few (tags name layers and topics).
    """
    f = scored(findings)
    alone = F.coalesce(F.col("cwe_id"), F.lit("")) == ""
    alone = alone | (F.coalesce(F.col("line_number"), F.lit(0)) == 0)
    keys = [scan, "file_path", "line_number", "cwe_id"]
    rest = [c for c in f.columns if c not in keys]
    rank = F.struct("tier", F.coalesce("severity", F.lit(-1)), confidence_rank(F.col("confidence")), descending(F.col("rule_id")), -F.col(order))
    none = F.array().cast("array<string>")
    out = (
        f.where(~alone)
        .groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), rank).alias("__w"), F.collect_set("tier").alias("__t"), F.count(F.lit(1)).alias("n_merged"), F.collect_set("tags").alias("__tags"))
        .select(
            *keys,
            *[F.col("__w")[c].alias(c) for c in rest if c not in ("tags", "confidence_score")],
            F.array_distinct(F.concat(F.coalesce(F.col("__w")["tags"], none), F.array_compact(F.array_sort(F.flatten("__tags"))))).alias("tags"),
            F.when(F.size("__t") > 1, boosted(F.col("__w")["confidence_score"], F.size("__t"))).otherwise(F.col("__w")["confidence_score"]).alias("confidence_score"),
            "n_merged",
        )
    )
    passing = f.where(alone).withColumns({"tags": F.coalesce("tags", F.array().cast("array<string>")), "n_merged": F.lit(1).cast("bigint")})
    return out.unionByName(passing.select(*out.columns))


def downgraded(findings: DataFrame) -> DataFrame:
    """Findings of test files: severity Low at most, confidence 0.3 at most, tag ``test-file``; all with labels by score."""
    test = is_test(F.col("file_path"))
    f = findings.withColumn("__test", test)
    f = f.withColumns(
        {
            "severity": F.when(F.col("__test"), F.least("severity", F.lit(1))).otherwise(F.col("severity")),
            "confidence_score": F.when(F.col("__test"), F.least("confidence_score", F.lit(0.3))).otherwise(F.col("confidence_score")),
            "tags": F.when(F.col("__test"), F.array_union(F.coalesce("tags", F.array().cast("array<string>")), F.array(F.lit("test-file")))).otherwise(F.col("tags")),
        }
    )
    return f.withColumns({"confidence": confidence_label(F.col("confidence_score")), "severity_label": severity_label(F.col("severity"))}).drop("__test")


def decisions(findings: DataFrame, scan: str = "entry_id") -> DataFrame:
    """Per scan and file: findings by severity, the highest severity, whether to warn and whether to block."""
    n = {name: F.count_if(F.col("severity") == i).alias(f"n_{name}") for i, name in enumerate(("info", "low", "medium", "high", "critical"))}
    return findings.groupBy(scan, "file_path").agg(
        F.count(F.lit(1)).alias("n_findings"),
        *n.values(),
        F.max("severity").alias("max_severity"),
        F.bool_or(F.col("severity") >= 3).alias("warned"),
        F.bool_or(blocks(F.col("severity"), F.col("confidence_score"))).alias("blocked"),
    )


def categories(findings: DataFrame) -> DataFrame:
    """Findings, files and blocking findings per category of rule."""
    c = category(F.col("rule_id"))
    return findings.groupBy(c.alias("category")).agg(F.count(F.lit(1)).alias("n_findings"), F.countDistinct("file_path").alias("n_files"), F.count_if(blocks(F.col("severity"), F.col("confidence_score"))).alias("n_blocking"))
