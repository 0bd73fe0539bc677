"""Hints for the author of a file: flows first, then findings no flow covers, then the shape of the whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodesift.functions.scoring import category

#: Findings of a category in one file from which its design is worth a hint.
MANY = 3


def hints(findings: DataFrame, flows: DataFrame | None = None, scan: str = "entry_id") -> DataFrame:
    """``scan, file_path, kind, category, line_number, priority, n``: ``flow``, ``finding`` (lines no flow's sink covers), ``architecture`` (``MANY`` of a category).

    ``priority`` is 5 less the severity, so the lowest comes first.
    """
    f = findings.select(scan, "file_path", "line_number", "severity", category(F.col("rule_id")).alias("category"), F.col("rule_id"))
    if flows is not None:
        sinks = flows.select(scan, "line_number").distinct()
        f = f.join(sinks, [scan, "line_number"], "left_anti")
    each = f.select(scan, "file_path", F.lit("finding").alias("kind"), "category", "line_number", (5 - F.col("severity")).alias("priority"), F.lit(1).cast("bigint").alias("n"))
    many = findings.select(scan, "file_path", "severity", category(F.col("rule_id")).alias("category")).groupBy(scan, "file_path", "category").agg(F.count(F.lit(1)).alias("n"), F.max("severity").alias("severity")).where(F.col("n") >= MANY)
    design = many.select(scan, "file_path", F.lit("architecture").alias("kind"), "category", F.lit(None).cast("int").alias("line_number"), (5 - F.col("severity")).alias("priority"), "n")
    out = each.unionByName(design)
    if flows is not None:
        out = out.unionByName(flows.select(scan, F.lit(None).cast("string").alias("file_path"), F.lit("flow").alias("kind"), F.col("sink_category").alias("category"), "line_number", (5 - F.col("severity")).alias("priority"), F.lit(1).cast("bigint").alias("n")))
    return out


def caller_hints(impacted: DataFrame, functions: DataFrame) -> DataFrame:
    """``start, file_path, kind, priority, n, affected``: for each changed function with sinks, how many functions call it over some edges, and the first of them by distance.

    ``impacted``: ``callgraph.impacted``; ``functions``: ``id, file_path``.
    """
    near = F.slice(F.array_sort(F.collect_list(F.struct("distance", "caller"))), 1, 5)
    per = impacted.groupBy("start").agg(F.max("severity").alias("severity"), F.count(F.lit(1)).alias("n"), F.transform(near, lambda x: x["caller"]).alias("affected"))
    return per.join(functions.select(F.col("id").alias("start"), "file_path"), "start").select("start", "file_path", F.lit("callers").alias("kind"), (5 - F.col("severity")).alias("priority"), "n", "affected")


def positive(files: DataFrame, found: DataFrame, scan: str = "entry_id") -> DataFrame:
    """``scan, file_path, kind, priority``: the files (``scan, file_path``) without any hint."""
    return files.join(found.select(scan).distinct(), scan, "left_anti").select(scan, "file_path", F.lit("positive").alias("kind"), F.lit(5).alias("priority"))


# Fixed values of our own: what to do about a kind of sink.
ADVICE = {
    "sql_query": "Pass values as parameters of the statement, not as parts of its text.",
    "command_exec": "Call the program with a list of arguments and without a shell.",
    "code_eval": "Don't run text; look the wanted action up in a table.",
    "file_write": "Resolve the path and check that it stays below the folder meant for it.",
    "html_output": "Escape the value for the place in the page where it is put.",
    "redirect": "Compare the target with a list of allowed ones.",
    "ldap_query": "Escape the value for the filter.",
    "xpath_query": "Bind the value as a variable of the expression.",
    "http_header": "Reject values with line ends.",
    "template_render": "Render a fixed template and pass the value as data.",
    "deserialize": "Read a format that holds data only.",
    "log_output": "Take line ends out of the value before it is logged.",
    "crypto_input": "Derive keys by a function meant for it, from a secret.",
    "url_fetch": "Check host and scheme against a list before the request.",
}


def with_advice(some: DataFrame) -> DataFrame:
    """``some`` (with ``category``) and ``advice``, and the directive that would turn the finding off for its line."""
    known = F.create_map(*[F.lit(x) for kv in ADVICE.items() for x in kv])
    return some.withColumn("advice", F.coalesce(F.try_element_at(known, F.col("category")), F.lit("Check the finding against the rule's description.")))
