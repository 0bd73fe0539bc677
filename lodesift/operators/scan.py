"""The whole scan of files: the findings of all layers, merged, suppressed, downgraded and decided on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodesift.functions.scoring import blocks
from lodesift.operators import comments, fusion, interproc, pyast, pyflow, rules, suppress, taint
from lodesift.operators.catalogs import CORE, Catalog
from lodesift.session import cut

#: Columns of a finding of any layer, besides the file's key.
FINDING = ("file_path", "lang", "layer", "rule_id", "severity", "title", "line_number", "matched_text", "cwe_id", "confidence", "confidence_score", "tags")


def _shaped(df: DataFrame, key: str, layer: str) -> DataFrame:
    return df.withColumn("layer", F.lit(layer)).select(key, *FINDING)


def text_layers(files: DataFrame, key: str, table: Sequence[rules.Rule]) -> DataFrame:
    """The findings of the line rules, but for those that begin in a comment, and of the syntax tree of ``files`` (``key, path, lang, content``), in one shape: ``key`` and ``FINDING``."""
    lines = rules.apply(comments.with_spans(files, key), table, key, "comment_spans").withColumnRenamed("path", "file_path").withColumn("confidence_score", F.lit(0.0))
    tree = pyast.findings(files, key).withColumn("confidence_score", F.lit(0.0))
    return _shaped(lines, key, "line").unionByName(_shaped(_placed(tree, files, key), key, "tree"))


def flow_layers(files: DataFrame, key: str, catalog: Catalog = CORE) -> DataFrame:
    """The findings of taint within and between functions, in the same shape."""
    # Python has a tree to walk, other languages are folded line by line
    within = taint.as_findings(pyflow.flows(files, key, catalog).unionByName(taint.flows(files.where("lang <> 'python'"), key, catalog))).withColumn("matched_text", F.lit("")).withColumn("layer", F.lit("taint"))
    between = interproc.as_findings(interproc.flows(files, key, catalog)).withColumn("layer", F.lit("interprocedural"))
    own = [c for c in (key, *FINDING) if c not in ("file_path", "lang")]
    return _placed(within.select(own).unionByName(between.select(own)), files, key).select(key, *FINDING)


def _placed(found: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Findings with the path and language of their file."""
    return found.join(files.select(key, F.col("path").alias("file_path"), "lang"), key)


def findings(files: DataFrame, key: str, table: Sequence[rules.Rule], catalog: Catalog = CORE, keyword: str = suppress.KEYWORD) -> DataFrame:
    """The merged findings of every file, with ``suppressed``, ``suppress_reason`` and ``n_merged``.

    In order: findings that begin in a comment are left out (tree and taint layers have none there), those of one line and weakness are merged, directives
    suppress, findings in test files are downgraded and labels follow the scores. Ties of a merge go to the first by rule, line and text.
    """
    said = text_layers(files, key, table).unionByName(flow_layers(files, key, catalog))
    # written once, since the merge reads them twice; they are few beside the files
    numbered = cut(said.withColumn("finding_id", F.xxhash64(key, "rule_id", "line_number", "matched_text", "layer")))
    merged = fusion.merged(numbered, key, "finding_id")
    return fusion.downgraded(suppress.split(merged, suppress.covered(files, key, keyword), key)).drop("finding_id")


def decisions(the_findings: DataFrame, key: str) -> DataFrame:
    """Per file: what was found and not suppressed by severity, whether to warn and to block, and the number and rules of the suppressed."""
    on, severity = ~F.col("suppressed"), F.col("severity")
    names = ("info", "low", "medium", "high", "critical")
    return the_findings.groupBy(key, "file_path").agg(
        F.count_if(on).alias("n_findings"),
        *[F.count_if(on & (severity == i)).alias(f"n_{n}") for i, n in enumerate(names)],
        F.count_if("suppressed").alias("n_suppressed"),
        F.max(F.when(on, severity)).alias("max_severity"),
        F.bool_or(on & (severity >= 3)).alias("warned"),
        F.bool_or(on & blocks(severity, F.col("confidence_score"))).alias("blocked"),
        F.array_sort(F.collect_set(F.when(F.col("suppressed"), F.col("rule_id")))).alias("suppressed_rules"),
    )
