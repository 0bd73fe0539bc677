"""The pN_ queries of the text problems, and the SQL that gives the same rows where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodesift.llm import mixing, secrets, subjects, syntax, tokens
from lodesift.session import spread
from lodesift.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return secrets.find(spread(secrets.source_texts(table(spark, d, "hook_inputs"), table(spark, d, "findings"))))


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    return secrets.redact(spread(secrets.source_texts(table(spark, d, "hook_inputs"), table(spark, d, "findings"))))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return syntax.verdicts(syntax.written_files(table(spark, d, "hook_inputs"), table(spark, d, "ledger_entries")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).where(~F.col("valid")).select("input_id")


def p3_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d)


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return syntax.report(_judged(spark, d))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"), "doc_id", "text")


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = mixing.sized(table(spark, d, "documents"))
    the_plan = mixing.plan(docs, table(spark, d, "mix_targets"))
    return the_plan, mixing.mix(docs, the_plan)


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(*_mix(spark, d)).select("source", "target_share", "share_reached", "max_repeats", "epochs", "n_docs", "n_tokens", F.round("planned").cast("long").alias("planned_tokens"), "docs_taken", "copies", "tokens_taken", "at_cap")


def p8_plan_chars(spark: SparkSession, d: str) -> DataFrame:
    """The same plan with sizes in characters, which SQL can count too."""
    docs = table(spark, d, "documents").select(mixing.source_name(F.col("source")).alias("source"), F.char_length("text").cast("long").alias("n_tokens")).where("source IS NOT NULL AND n_tokens > 0")
    p = mixing.plan(docs, table(spark, d, "mix_targets"))
    return p.select("source", F.round("target_share", 9).alias("target_share"), "max_repeats", "n_docs", F.col("n_tokens").alias("n_chars"), F.round("planned", 2).alias("planned"))


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return subjects.assign(docs, subjects.fit(docs, table(spark, d, "subject_labels"), table(spark, d, "subject_areas")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "subject")


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    return subjects.composition(_subjects(spark, d), table(spark, d, "documents"), table(spark, d, "subject_areas"))


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_redacted": p1_redacted,
    "p3_found": p3_found,
    "p3_verdicts": p3_verdicts,
    "p3_report": p3_report,
    "p7_ids": p7_ids,
    "p8_mix": p8_mix,
    "p8_report": p8_report,
    "p8_plan_chars": p8_plan_chars,
    "p9_found": p9_found,
    "p9_composition": p9_composition,
}
_SOURCE = "regexp_replace(lower(trim({c}, ' ' || chr(9) || chr(13) || chr(10))), '[-\\s]+', '_', 'g')"
ORACLE: dict[str, str] = {
    # whether a source is full, by the sums over those that are full before it; then what is left goes to the others by share
    "p8_plan_chars": f"""WITH g AS (SELECT {_SOURCE.format(c='source')} AS source, target_share AS share, coalesce(max_repeats, 1) AS cap FROM mix_targets WHERE source IS NOT NULL AND target_share >= 0),
o AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY source ORDER BY share DESC, cap DESC) = 1),
h AS (SELECT {_SOURCE.format(c='source')} AS source, count(*) AS n_docs, sum(length(text))::bigint AS n FROM documents WHERE source IS NOT NULL AND length(text) > 0 GROUP BY 1),
r AS (SELECT o.*, coalesce(n_docs, 0) AS n_docs, coalesce(n, 0) AS n, CASE WHEN share > 0 THEN greatest(cap, 0) * coalesce(n, 0) ELSE 0 END::double AS most FROM o LEFT JOIN h USING (source)),
s AS (SELECT *, CASE WHEN share > 0 THEN most / share ELSE 0 END AS full_at, sum(share) OVER () AS all_shares, (sum(n) OVER ())::double AS total FROM r),
c AS (SELECT *, coalesce(sum(most) OVER w, 0) + full_at * (all_shares - coalesce(sum(share) OVER w, 0)) <= total AS clamped FROM s WINDOW w AS (ORDER BY full_at, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT coalesce(sum(most) FILTER (WHERE clamped), 0) AS given, sum(share) FILTER (WHERE NOT clamped) AS open FROM c)
SELECT source, round(share / all_shares, 9) AS target_share, cap AS max_repeats, n_docs, n AS n_chars, round(CASE WHEN clamped THEN most ELSE (total - given) * share / open END, 2) AS planned FROM c, l""",
}
