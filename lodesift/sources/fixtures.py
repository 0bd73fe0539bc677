"""Labelled source files: folders of vulnerable and safe files by language, with what is expected in their first lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodesift.functions.paths import language

#: Lines from the top in which the keys of the heading are looked for.
HEADING = 10


def load(spark: SparkSession, folder: str) -> DataFrame:
    """``path, folder_lang, label, name, lang, content, source, expected, owasp`` of ``<folder>/**/<lang>/<vulnerable|safe>/<file>``.

    Whole files are read in parallel. Hidden files are left out. ``source``, ``expected`` (rule ids, without explanations in parentheses) and ``owasp`` come
    from comment lines ``Source:``, ``Expected:`` and ``OWASP:`` among the first ``HEADING`` lines; those without are null or empty.
    """
    files = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    part = lambda back: F.element_at(F.split("path", "/"), -back)
    rows = files.select("path", part(3).alias("folder_lang"), part(2).alias("label"), part(1).alias("name"), "content").where(F.col("label").isin("vulnerable", "safe") & ~F.startswith("name", F.lit(".")))
    return heading(rows.withColumn("lang", language(F.col("name"))))


def heading(files: DataFrame) -> DataFrame:
    """``files`` (with ``content``) and the keys of their heading."""
    top = F.array_join(F.slice(F.split(F.regexp_replace("content", "\r\n", "\n"), "\n", -1), 1, HEADING), "\n")

    def key(name: str) -> Column:
        return F.nullif(F.trim(F.regexp_extract(top, rf"(?m)^[ \t]*(?://|#|--|/?\*)[ \t]*{name}:[ \t]*(.*)$", 1)), F.lit(""))

    ids = F.transform(F.split(F.regexp_replace(F.coalesce(key("Expected"), F.lit("")), r"\([^)]*\)", ""), ","), lambda x: F.trim(x))
    return files.withColumns({"source": key("Source"), "expected": F.filter(ids, lambda x: x != ""), "owasp": F.regexp_extract(F.coalesce(key("OWASP"), F.lit("")), r"(A\d\d)", 1)})


def scorecard(fixtures: DataFrame, findings: DataFrame) -> DataFrame:
    """Per language: vulnerable and safe files, how many of the former are detected and of the latter reported; ``findings`` has ``path, rule_id``.

    A file is detected if the id of a finding begins with an expected one, or has its category (the part before the last hyphen); without an expected
    one, if there is any finding.
    """
    part = lambda c: F.regexp_extract(c, r"^(.*)-[^-]*$", 1)
    found = findings.groupBy("path").agg(F.collect_set("rule_id").alias("found"))
    f = fixtures.join(found, "path", "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
    met = F.exists("expected", lambda e: F.exists("found", lambda r: F.startswith(r, e) | ((part(e) != "") & (part(r) == part(e)))))
    hit = F.when(F.size("expected") > 0, met).otherwise(F.size("found") > 0)
    bad, good = F.col("label") == "vulnerable", F.col("label") == "safe"
    return f.groupBy("folder_lang").agg(F.count_if(bad).alias("n_vulnerable"), F.count_if(bad & hit).alias("n_detected"), F.count_if(good).alias("n_safe"), F.count_if(good & (F.size("found") > 0)).alias("n_false"))
