"""References to records that do not exist, by run-compressed keys and an as-of match.

Sorted integer parent keys are compressed into contiguous runs ``(start, end)``. A referring key is
matched to the last run that starts at or before it and is an orphan when it lies beyond that run's
end. Runs are cut at block borders, so the as-of match is a window per block of keys, and both sides
of it are bounded by the block, however often one key is referred to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodesift.functions.text import stripped
from lodesift.session import cut

#: Keys per block of the as-of match; a task holds a block's run starts and distinct references.
BLOCK = 1 << 14


def runs(keys: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """``start, end`` of the contiguous runs of the distinct, non-null integers ``key``, cut at block borders."""
    k = keys.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("k")).distinct()
    k = k.withColumn("b", F.shiftright("k", block.bit_length() - 1))
    island = F.col("k") - F.row_number().over(Window.partitionBy("b").orderBy("k"))
    return k.withColumn("i", island).groupBy("b", "i").agg(F.min("k").alias("start"), F.max("k").alias("end")).drop("i")


def missing_keys(parents: DataFrame, parent_key: str, refs: DataFrame, ref_key: str, block: int = BLOCK) -> DataFrame:
    """The distinct keys of ``refs`` that ``parents`` doesn't have, as ``key``.

    Both are integers; ``block`` is a power of two. Null references refer to nothing and null
    parents are none; repeated keys count once; without parents every reference is missing.
    """
    if block & (block - 1):
        raise ValueError("block must be a power of two")
    shift = block.bit_length() - 1
    starts = runs(parents, parent_key, block).select("b", F.col("start").alias("k"), F.col("end"), F.lit(0).alias("side"))
    asked = (
        refs.where(F.col(ref_key).isNotNull())
        .select(F.col(ref_key).cast("bigint").alias("k"))
        .distinct()
        .select(F.shiftright("k", shift).alias("b"), "k", F.lit(None).cast("bigint").alias("end"), F.lit(1).alias("side"))
    )
    w = Window.partitionBy("b").orderBy("k", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    matched = starts.unionByName(asked).withColumn("upto", F.last("end", ignorenulls=True).over(w))
    return matched.where((F.col("side") == 1) & (F.col("upto").isNull() | (F.col("k") > F.col("upto")))).select(F.col("k").alias("key"))


def dictionary(texts: DataFrame, text: str, flags: list[str]) -> DataFrame:
    """Text keys as integers: ``text, key`` and the ``or`` of boolean ``flags``, written to the shared folder.

    Texts are range-partitioned and numbered in order, so neighbours in the order have neighbouring
    numbers. The numbers depend on the sampled range borders; cutting the lineage makes every
    later use see the same ones, also after the loss of an executor.
    """
    one = texts.where(F.col(text).isNotNull()).groupBy(text).agg(*[F.max(f).alias(f) for f in flags])
    parts = int(one.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(one.repartitionByRange(parts, text).sortWithinPartitions(text).withColumn("key", F.monotonically_increasing_id()))


def missing_texts(parents: DataFrame, refs: DataFrame, text: str) -> DataFrame:
    """The distinct values of ``refs[text]`` that ``parents[text]`` doesn't have, by way of integer keys."""
    both = parents.select(text, F.lit(True).alias("is_parent"), F.lit(False).alias("is_ref")).unionByName(refs.select(text, F.lit(False).alias("is_parent"), F.lit(True).alias("is_ref")))
    d = dictionary(both, text, ["is_parent", "is_ref"])
    gone = missing_keys(d.where("is_parent"), "key", d.where("is_ref"), "key")
    return d.join(gone, "key").select(text)


def node_name(c: Column) -> Column:
    """A function's id for comparison: trimmed, with forward slashes, and with ``.`` and ``..`` resolved in the path before the last colon.

    ``..`` at the root stays at the root; a relative path keeps a leading ``..``. Repeated slashes
    are kept. An id without colon is a path as a whole. Null stays null.
    """
    t = F.translate(stripped(c), "\\", "/")
    name = F.regexp_extract(t, r"(:[^:]*)$", 1)
    path = F.left(t, F.char_length(t) - F.char_length(name))
    parts = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda acc, x: F.when(x == ".", acc)
        .when(
            x == "..",
            F.when(F.size(acc) == 0, F.array(x))
            .when((F.size(acc) == 1) & (F.element_at(acc, -1) == ""), acc)
            .when(F.element_at(acc, -1) == "..", F.concat(acc, F.array(x)))
            .otherwise(F.slice(acc, 1, F.size(acc) - 1)),
        )
        .otherwise(F.concat(acc, F.array(x))),
    )
    return F.when(path.rlike(r"(^|/)\.{1,2}(/|$)"), F.concat(F.array_join(parts, "/"), name)).otherwise(t)


def last_versions(nodes: DataFrame) -> DataFrame:
    """The newest row of each function id (``last_scan_at``, then ``node_seq``; null times are the oldest), with ``exists``."""
    v = nodes.select(
        node_name(F.col("id")).alias("id"),
        F.struct(F.col("last_scan_at"), F.col("node_seq")).alias("__v"),
        F.struct(F.coalesce(F.lower(stripped(F.col("op"))) != "remove", F.lit(True)).alias("exists"), "calls", "called_by", "last_scan_at", "node_seq").alias("__r"),
    )
    v = v.where(F.col("id").isNotNull() & (F.col("id") != ""))
    return v.groupBy("id").agg(F.max_by("__r", "__v").alias("__r")).select("id", "__r.*")


def graph_references(nodes: DataFrame, graphs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The newest state of every id (``last_versions``, written once for the passes over it), and the references ``ref_field, owner_id, ref_id, at`` of existing functions and of all graphs.

    Null arrays, null elements and blank names refer to nothing. Repeated references stay repeated.
    """
    state = cut(last_versions(nodes))
    existing = state.where("exists")

    def of(df: DataFrame, field: str, column: str, owner: Column, at: str) -> DataFrame:
        return df.select(F.lit(field).alias("ref_field"), owner.alias("owner_id"), F.explode(column).alias("ref_id"), F.col(at).alias("at"))

    refs = (
        of(existing, "calls", "calls", F.col("id"), "last_scan_at")
        .unionByName(of(existing, "called_by", "called_by", F.col("id"), "last_scan_at"))
        .unionByName(of(graphs, "nodes", "node_ids", F.col("graph_id").cast("string"), "last_updated"))
        .withColumn("ref_id", node_name(F.col("ref_id")))
        .where(F.col("ref_id").isNotNull() & (F.col("ref_id") != ""))
    )
    return state, refs


def orphan_references(nodes: DataFrame, graphs: DataFrame) -> DataFrame:
    """The references to functions that don't exist at the end: ``ref_field, owner_id, missing_id``, each once."""
    state, refs = graph_references(nodes, graphs)
    gone = missing_texts(state.where("exists").select(F.col("id").alias("ref_id")), refs, "ref_id")
    return refs.join(gone, "ref_id", "left_semi").select("ref_field", "owner_id", F.col("ref_id").alias("missing_id")).distinct()


def orphan_report(nodes: DataFrame, graphs: DataFrame) -> DataFrame:
    """``ref_field, month, n_refs, n_missing, n_deleted`` over the distinct references; of the missing, ``n_deleted`` were recorded and removed, the others never recorded.

    ``month`` (yyyy-MM) is that of the referring row, null if it has no time. A name that turns up later is no fault, whenever it was referred to.
    """
    state, refs = graph_references(nodes, graphs)
    gone = missing_texts(state.where("exists").select(F.col("id").alias("ref_id")), refs, "ref_id").withColumn("gone", F.lit(True))
    removed = state.where("NOT exists").select(F.col("id").alias("ref_id"), F.lit(True).alias("removed"))
    one = refs.groupBy("ref_field", "owner_id", "ref_id").agg(F.max("at").alias("at")).join(gone.join(removed, "ref_id", "left"), "ref_id", "left")
    return one.groupBy("ref_field", F.date_format("at", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n_refs"), F.count("gone").alias("n_missing"), F.count("removed").alias("n_deleted"))
