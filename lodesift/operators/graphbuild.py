"""Function nodes with calls and signatures, built from files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodesift.operators import taint
from lodesift.operators.callgraph import CALL_FORMS, NO_CALLS
from lodesift.operators.catalogs import CORE, Catalog

# Types of parameters that carry foreign data.
SOURCE_TYPES = (
    (r"http\.Request|gin\.Context|echo\.Context|fiber\.Ctx|HttpServletRequest", "user_input"),
    (r"http\.ResponseWriter", "external"),
    (r"sql\.Rows?|gorm\.DB", "database"),
    (r"io\.Reader|io\.ReadCloser|net\.Conn", "network"),
)


def _bodies(files: DataFrame, key: str) -> DataFrame:
    """``key, path, lang, name, start_line, end_line, content_hash, body``; the body is cut from the file's lines."""
    found = taint.function_scopes(files, key)
    base = files.select(key, "path", "lang", F.split("content", "\n", -1).alias("__ls"))
    cut = F.array_join(F.slice("__ls", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    return found.join(base, key).select(key, "path", "lang", "name", "start_line", "end_line", "content_hash", cut.alias("body"))


def _calls() -> Column:
    plain = F.regexp_extract_all("body", F.lit(r"\b(\w+)\s*\("), F.lit(1))
    extra = F.array().cast("array<string>")
    for lang, patterns in CALL_FORMS.items():
        extra = F.when(F.col("lang") == lang, F.flatten(F.array(*[F.regexp_extract_all("body", F.lit(p), F.lit(1)) for p in patterns]))).otherwise(extra)
    return F.array_except(F.array_distinct(F.concat(plain, extra)), F.concat(F.array(*[F.lit(w) for w in NO_CALLS]), F.array("name")))


def nodes(files: DataFrame, key: str) -> DataFrame:
    """``key, id, path, lang, name, start_line, end_line, content_hash, calls``: calls by name, resolved to functions of the same file.

    Of functions of one name in a file the first counts. A function's own name is no call of it.
    """
    f = _bodies(files, key).withColumn("__calls", _calls())
    one = f.groupBy(key, "path", "lang", "name").agg(F.min_by(F.struct("start_line", "end_line", "content_hash", "__calls"), F.struct("start_line", "end_line")).alias("n"))
    named = one.select(key, F.col("name").alias("__callee")).distinct()
    calls = one.select(key, "name", F.explode("n.__calls").alias("__callee")).join(named, [key, "__callee"]).groupBy(key, "name").agg(F.sort_array(F.collect_set("__callee")).alias("__to"))
    ident = lambda n: F.concat("path", F.lit(":"), n)
    return one.join(calls, [key, "name"], "left").select(
        key, ident(F.col("name")).alias("id"), "path", "lang", "name", "n.start_line", "n.end_line", "n.content_hash", F.transform(F.coalesce("__to", F.array().cast("array<string>")), ident).alias("calls")
    )


def signatures(files: DataFrame, key: str, catalog: Catalog = CORE) -> DataFrame:
    """``key, id, sink_calls, tainted_params, is_pure``: flows that lie in a function's lines, per function; pure is a function without any."""
    n = nodes(files, key).select(key, "id", "start_line", "end_line")
    flow = taint.flows(files, key, catalog).select(key, "line_number", "source_line", "sink_category", "sink_id")
    inside = n.join(flow, key).where(F.col("line_number").between(F.col("start_line"), F.col("end_line")) | F.col("source_line").between(F.col("start_line"), F.col("end_line")))
    per = inside.groupBy(key, "id").agg(F.sort_array(F.collect_set(F.struct(F.col("sink_category").alias("category"), F.col("sink_id").alias("method"), F.col("line_number").alias("line")))).alias("sink_calls"))
    return n.join(per, [key, "id"], "left").select(key, "id", F.coalesce("sink_calls", F.array().cast(per.schema["sink_calls"].dataType)).alias("sink_calls"), F.col("sink_calls").isNull().alias("is_pure"))


def source_kind(declared: Column) -> Column:
    """What a parameter of a declared type carries, or null; the first type that matches counts."""
    out = F.lit(None).cast("string")
    for pattern, kind in reversed(SOURCE_TYPES):
        out = F.when(declared.rlike(pattern), kind).otherwise(out)
    return out


def changed(new: DataFrame, old: DataFrame) -> DataFrame:
    """The nodes of ``new`` that ``old`` doesn't have with the same id and hash."""
    return new.join(old.select("id", "content_hash"), ["id", "content_hash"], "left_anti")


def tainted_returns(files: DataFrame, key: str, catalog: Catalog = CORE) -> DataFrame:
    """``key, caller, callee, source_line, sink_line, sink_category``: the value of a call of a function with a source, assigned to a variable that a later sink's line uses.

    A sanitizer of the category between them, on a line with the variable, cancels it. Both ends lie in one function.
    """
    own = {lang: catalog.of(lang) for lang in ("python", "javascript", "typescript", "go", "java", "php", "ruby")}

    def union(rows: tuple, language: str) -> str:
        return "|".join(f"(?:{r.pattern})" for r in rows) or "(?!)"

    n = _bodies(files, key)
    has_source = F.lit(False)
    for lang, cat in own.items():
        has_source = F.when(F.col("lang") == lang, F.col("body").rlike(union(cat.sources, lang))).otherwise(has_source)
    callee = n.where(has_source & F.col("body").rlike(r"\breturn\b")).select(key, F.col("name").alias("callee")).distinct()
    lines = n.select(key, "path", "lang", F.col("name").alias("caller"), "start_line", F.posexplode(F.split("body", "\n", -1)).alias("i", "text")).withColumn("line", F.col("start_line") + F.col("i"))
    made = lines.withColumn("var", F.regexp_extract("text", r"^\s*(?:(?:var|let|const|final|String|int)\s+)?(\$?\w+)(?:\s*,\s*\w+)*\s*:?=[^=]", 1)).withColumn("__call", F.explode(F.regexp_extract_all("text", F.lit(r"=.*?\b(\w+)\s*\("), F.lit(1)))).where("var <> ''")
    calls = made.join(callee.withColumnRenamed("callee", "__call"), [key, "__call"]).where(F.col("__call") != F.col("caller")).select(key, "caller", F.col("__call").alias("callee"), "var", F.col("line").alias("source_line"))
    # the categories each line is a sink of, and those it sanitises, as two arrays
    sinks, cleans = [], []
    for lang, cat in own.items():
        for category in sorted({s.category for s in cat.sinks}):
            here = F.col("lang") == lang
            sinks.append(F.when(here & F.col("text").rlike(union(tuple(s for s in cat.sinks if s.category == category), lang)), category))
            some = tuple(s for s in cat.sanitizers if category in s.neutralizes)
            if some:
                cleans.append(F.when(here & F.col("text").rlike(union(some, lang)), category))
    marked = lines.withColumns({"__sinks": F.filter(F.array(*sinks), lambda x: x.isNotNull()), "__cleans": F.filter(F.array(*cleans), lambda x: x.isNotNull())})
    marked = marked.where((F.size("__sinks") > 0) | (F.size("__cleans") > 0)).withColumn("sink_category", F.explode(F.array_union("__sinks", "__cleans")))
    out = marked.select(key, "caller", "text", F.col("line").alias("sink_line"), "sink_category", F.array_contains("__sinks", F.col("sink_category")).alias("__sink"), F.array_contains("__cleans", F.col("sink_category")).alias("__clean"))
    uses = calls.join(out, [key, "caller"]).where((F.col("sink_line") >= F.col("source_line")) & F.expr(r"text rlike concat('(^|[^\\w$])', replace(var, '$', '\\$'), '\\b')"))
    keys = [key, "caller", "callee", "var", "source_line", "sink_category"]
    first_clean = uses.where("__clean").groupBy(*keys).agg(F.min("sink_line").alias("__c"))
    hits = uses.where("__sink AND sink_line > source_line").join(first_clean, keys, "left").where("__c IS NULL OR __c > sink_line")
    return hits.select(key, "caller", "callee", "source_line", "sink_line", "sink_category").distinct()
