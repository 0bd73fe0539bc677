"""Scores, tiers and labels of findings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severities in order.
SEVERITY_LABELS = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")
# The sign of each severity.
SEVERITY_ICONS = ("i", "L", "M", "H", "!")
# Base confidence of the layers without a score of their own.
BASE_CONFIDENCE = {40: 0.6, 30: 0.7, 20: 0.8}
BASE_REGEX = {"high": 0.5, "medium": 0.4}
BASE_OTHER = 0.3
# Parts of a rule id that name its category; the first that occurs counts.
CATEGORY_PARTS = (
    ("INJ", "injection"),
    ("XSS", "xss"),
    ("SEC", "secrets"),
    ("CRY", "crypto"),
    ("TRV", "traversal"),
    ("AUTH", "auth"),
    ("SSRF", "ssrf"),
    ("TAINT", "taint"),
    ("DESER", "deserialize"),
    ("REDIR", "redirect"),
    ("NOSQL", "injection"),
    ("XXE", "xxe"),
    ("CORS", "cors"),
    ("LOG", "logging"),
    ("MEM", "memory"),
    ("PROTO", "prototype"),
    ("MASS", "massassign"),
    ("GQL", "graphql"),
    ("MISCONF", "misconfig"),
    ("INTERPROC", "interprocedural"),
)


def tier(tags: Column, rule_id: Column) -> Column:
    """The layer that reported a finding: 20 between functions, 40 taint, 30 tree, 10 pattern; null tags count as none."""
    def tagged(t: str) -> Column:
        return F.coalesce(F.array_contains(tags, t), F.lit(False))

    return F.when(tagged("interprocedural"), 20).when(tagged("taint-analysis"), 40).when(F.contains(F.coalesce(rule_id, F.lit("")), F.lit("AST")), 30).otherwise(10)


def base_confidence(score: Column, the_tier: Column, confidence: Column) -> Column:
    """The score where it is positive, else that of the layer."""
    out = F.when(score > 0, score)
    for t, v in BASE_CONFIDENCE.items():
        out = out.when(the_tier == t, F.lit(v))
    for name, v in BASE_REGEX.items():
        out = out.when(confidence == name, F.lit(v))
    return out.otherwise(F.lit(BASE_OTHER))


def boosted(score: Column, n_tiers: Column) -> Column:
    """A tenth more for each further layer that agrees, at most 1."""
    return F.least(F.lit(1.0), score + (n_tiers - 1) * F.lit(0.1))


def confidence_label(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.4, "medium").otherwise("low")


def severity_label(severity: Column) -> Column:
    return F.coalesce(F.get(F.array(*[F.lit(x) for x in SEVERITY_LABELS]), severity.cast("int")), F.lit("UNKNOWN"))


def severity_icon(severity: Column) -> Column:
    """The sign of a severity; ``?`` for an unknown one."""
    return F.coalesce(F.get(F.array(*[F.lit(x) for x in SEVERITY_ICONS]), severity.cast("int")), F.lit("?"))


def blocks(severity: Column, score: Column) -> Column:
    return (severity >= 4) & (score >= 0.7)


def category(rule_id: Column) -> Column:
    """The category of a rule id by the first part of ``CATEGORY_PARTS`` it has, else ``general``."""
    r, out = F.upper(rule_id), None
    for part, name in CATEGORY_PARTS:
        out = (F if out is None else out).when(F.contains(r, F.lit(part)), name)
    return out.otherwise("general")
