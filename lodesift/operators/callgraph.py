"""The call graph as tables: functions, edges, callers within a distance, and what a change reaches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodesift.operators.orphans import last_versions, node_name
from lodesift.session import cut

#: Edges a caller may be away, for analysis.
MAX_DEPTH = 5
# Words before a parenthesis that are no calls.
NO_CALLS = ("if", "for", "while", "switch", "return", "catch", "throw", "new", "delete", "typeof", "sizeof", "function", "func", "def", "class", "print", "println", "printf", "else", "elif", "case", "try", "with", "in", "and", "or", "not", "super", "this", "self", "await", "async", "yield", "lambda", "import", "from", "export", "require", "var", "let", "const", "do", "end", "then", "fi", "foreach", "using", "lock")
# How a call is written, by language, besides ``name(``.
CALL_FORMS = {
    "python": (r"\.(\w+)\s*\(",),
    "javascript": (r"\.(\w+)\s*\(", r"\bnew\s+(\w+)\s*\("),
    "typescript": (r"\.(\w+)\s*\(", r"\bnew\s+(\w+)\s*\("),
    "java": (r"\.(\w+)\s*\(", r"\bnew\s+(\w+)\s*\("),
    "csharp": (r"\.(\w+)\s*\(", r"\bnew\s+(\w+)\s*\("),
    "php": (r"->(\w+)\s*\(", r"::(\w+)\s*\("),
    "ruby": (r"\.(\w+)",),
    "c": (r"->(\w+)\s*\(", r"::(\w+)\s*\("),
    "cpp": (r"->(\w+)\s*\(", r"::(\w+)\s*\("),
}
# Weakness, rating and severity of each kind of sink between functions.
SINKS = {
    "sql_query": ("CWE-89", "A03", 4),
    "command_exec": ("CWE-78", "A03", 4),
    "code_eval": ("CWE-94", "A03", 4),
    "deserialize": ("CWE-502", "A08", 4),
    "file_write": ("CWE-22", "A01", 3),
    "html_output": ("CWE-79", "A03", 3),
    "redirect": ("CWE-601", "A01", 3),
    "ldap_query": ("CWE-90", "A03", 3),
    "xpath_query": ("CWE-643", "A03", 3),
    "http_header": ("CWE-113", "A03", 3),
    "template_render": ("CWE-1336", "A03", 3),
    "url_fetch": ("CWE-918", "A10", 3),
    "crypto_input": ("CWE-327", "A02", 3),
    "log_output": ("CWE-117", "A09", 3),
}


def functions(nodes: DataFrame) -> DataFrame:
    """The existing functions, each in its newest version: ``id, file_path, lang, calls, called_by, taint_sig, content_hash``."""
    state = last_versions(nodes).where("exists").select("id", "node_seq")
    rest = nodes.select("node_seq", "file_path", "lang", "calls", "called_by", "taint_sig", "content_hash")
    return state.join(rest, "node_seq").drop("node_seq")


def edges(the_functions: DataFrame) -> DataFrame:
    """``caller, callee``, each once, from both arrays; only between existing functions."""
    forth = the_functions.select(F.col("id").alias("caller"), F.explode("calls").alias("callee")).withColumn("callee", node_name(F.col("callee")))
    back = the_functions.select(F.explode("called_by").alias("caller"), F.col("id").alias("callee")).withColumn("caller", node_name(F.col("caller")))
    ids = the_functions.select("id")
    both = forth.unionByName(back).where("caller IS NOT NULL AND callee IS NOT NULL").distinct()
    return both.join(ids.withColumnRenamed("id", "caller"), "caller", "left_semi").join(ids.withColumnRenamed("id", "callee"), "callee", "left_semi").select("caller", "callee")


def callers(the_edges: DataFrame, starts: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """``start, caller, distance``: all that call ``starts`` (``id``) over at most ``depth`` edges, at the shortest distance, without the start itself.

    Breadth-first: each step joins the newest frontier with the edges and drops what was reached before; its lineage is cut.
    """
    e = the_edges.select(F.col("callee").alias("at"), "caller")
    frontier = starts.select(F.col("id").alias("start"), F.col("id").alias("at")).distinct()
    seen = frontier.select("start", "at", F.lit(0).alias("distance"))
    for d in range(1, depth + 1):
        step = frontier.join(e, "at").select("start", F.col("caller").alias("at")).distinct().join(seen.select("start", "at"), ["start", "at"], "left_anti")
        frontier = cut(step)
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.withColumn("distance", F.lit(d)))
    return seen.where("distance > 0").select("start", F.col("at").alias("caller"), "distance")


def stats(the_functions: DataFrame, the_edges: DataFrame) -> DataFrame:
    """One row: functions, edges, files, functions with tainted parts."""
    sig = F.col("taint_sig")
    tainted = (F.coalesce(F.size(sig["tainted_params"]), F.lit(0)) > 0) | (F.coalesce(F.size(sig["sink_calls"]), F.lit(0)) > 0)
    rows = the_functions.select(F.lit(1).alias("f"), "file_path", F.coalesce(tainted, F.lit(False)).alias("t"), F.lit(0).alias("e"))
    both = rows.unionByName(the_edges.select(F.lit(0).alias("f"), F.lit(None).cast("string").alias("file_path"), F.lit(False).alias("t"), F.lit(1).alias("e")))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return both.agg(total("f").alias("n_functions"), F.countDistinct("file_path").alias("n_files"), F.count_if("t").alias("n_tainted"), total("e").alias("n_edges"))


def without_file(the_functions: DataFrame, the_edges: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """The graph after a file was removed: its functions and all edges at them."""
    left = the_functions.where(F.col("file_path") != path)
    ids = left.select("id")
    return left, the_edges.join(ids.withColumnRenamed("id", "caller"), "caller", "left_semi").join(ids.withColumnRenamed("id", "callee"), "callee", "left_semi")


def signature_size() -> Column:
    """What a signature is compared by: purity, and the sizes of its parts."""
    s = F.col("taint_sig")
    n = lambda c: F.coalesce(F.size(s[c]), F.lit(0))
    return F.struct(F.coalesce(s["is_pure"], F.lit(False)).alias("pure"), n("tainted_params").alias("params"), n("tainted_returns").alias("returns"), n("source_params").alias("sources"), n("sink_calls").alias("sinks"), n("sanitized_paths").alias("clean"))


def changes(nodes: DataFrame) -> DataFrame:
    """``id, content_changed, signature_changed`` of functions with several versions: the newest against the one before."""
    v = nodes.select(node_name(F.col("id")).alias("id"), F.struct("last_scan_at", "node_seq").alias("at"), F.struct("content_hash", signature_size().alias("sig")).alias("v"))
    two = v.groupBy("id").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("at", "v")))), 1, 2).alias("x")).where(F.size("x") == 2)
    a, b = F.element_at("x", 1)["v"], F.element_at("x", 2)["v"]
    return two.select("id", (~a["content_hash"].eqNullSafe(b["content_hash"])).alias("content_changed"), (~a["sig"].eqNullSafe(b["sig"])).alias("signature_changed"))


def impacted(the_functions: DataFrame, the_edges: DataFrame, starts: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """``start, caller, distance, severity``: callers of functions with sinks, rated High at least and as the worst sink."""
    rating = F.create_map(*[F.lit(x) for k, (_, _, s) in SINKS.items() for x in (k, s)])
    sinks = the_functions.select(F.col("id").alias("start"), F.explode("taint_sig.sink_calls").alias("c")).groupBy("start").agg(F.max(F.coalesce(F.try_element_at(rating, F.col("c.category")), F.lit(3))).alias("worst"))
    with_sinks = starts.join(sinks.select(F.col("start").alias("id")), "id", "left_semi")
    return callers(the_edges, with_sinks, depth).join(sinks, "start").select("start", "caller", "distance", F.greatest(F.lit(3), "worst").alias("severity"))


def called_names(files: DataFrame, key: str) -> DataFrame:
    """``key, name``: the names called in each file, once each, without key words."""
    none = F.array().cast("array<string>")
    forms = F.array_distinct(F.regexp_extract_all("content", F.lit(r"\b(\w+)\s*\("), F.lit(1)))
    extra = none
    for lang, patterns in CALL_FORMS.items():
        found = F.flatten(F.array(*[F.regexp_extract_all("content", F.lit(p), F.lit(1)) for p in patterns]))
        extra = F.when(F.col("lang") == lang, found).otherwise(extra)
    names = F.array_except(F.array_union(forms, extra), F.array(*[F.lit(w) for w in NO_CALLS]))
    return files.where("content IS NOT NULL").select(key, F.explode(names).alias("name"))


def tainted_arguments(the_functions: DataFrame, the_edges: DataFrame) -> DataFrame:
    """``caller, callee, category, param``: a caller that passes its own tainted parameters to a callee whose parameter meets a sink of a category that isn't sanitised for it."""
    callee = the_functions.select(F.col("id").alias("callee"), F.explode("taint_sig.sink_calls").alias("c"), F.col("taint_sig.sanitized_paths").alias("clean"))
    open_ = callee.select("callee", F.col("c.category").alias("category"), F.col("c.arg_from_param").alias("param"), "clean").where(
        F.col("category").isNotNull() & ~F.exists(F.coalesce("clean", F.array().cast(the_functions.select("taint_sig.sanitized_paths").schema[0].dataType)), lambda x: (x["param_index"] == F.col("param")) & (x["sink_category"] == F.col("category")))
    )
    tainted = the_functions.where(F.size("taint_sig.tainted_params") > 0).select(F.col("id").alias("caller"))
    return the_edges.join(open_.distinct(), "callee").join(tainted, "caller", "left_semi").select("caller", "callee", "category", "param").distinct()
