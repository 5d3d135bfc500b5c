"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import BROADCAST_ROWS, collect_shuffles, drop, drop_parts, drop_paths, paths_of, sized_join, tables_made, written_paths
from ..functions.tables import ship as _ship
from ..functions.tables import written as table

#: ASCII white space that separates words in every word rule below: \x20 and \x09-\x0D.
SPACES = " \t\n\x0b\f\r"


__all__ = ["collect_shuffles", "drop", "drop_parts", "drop_paths", "paths_of", "sized_join", "table", "tables_made", "written_paths"]


def let(value: Column, body) -> Column:
    """Evaluate `value` once per row and bind it as a variable of `body`."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Array of the maximal runs of non-space characters of `text` (null or blank: empty)."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def word_count(text: Column) -> Column:
    """Number of words of `text` (null: 0)."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def key_of(column: Column) -> Column:
    """Nullable string as a never-null key that orders null last."""
    return F.when(column.isNull(), F.lit("~")).otherwise(F.concat(F.lit("="), column))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that `df` does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, and keep their batches small: texts may be very long."""
    _ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "512")


def small_join(left: DataFrame, right: DataFrame, on: list[str], salts: int = 64) -> DataFrame:
    """Left join to a written summary table whose size is counted: broadcast up to BROADCAST_ROWS rows,
    else a sort-merge join with both sides salted so that a hot key spreads over `salts` tasks."""
    if right.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), on, "left")
    salt = fresh(left, "_salt")
    copies = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = left.withColumn(salt, F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    return dealt.join(copies.hint("merge"), [*on, salt], "left").drop(salt)


def prefix_sums(blocks: DataFrame, group: list[str], block: str, sums: dict[str, str], chunk: int = 4096) -> DataFrame:
    """Exclusive prefix sums over `block` (a long, 0-based) inside each group, in two levels:
    chunks of blocks are summed and scanned first, then blocks inside each chunk. No task sees a whole group.

    `sums` maps each output column to the summed one."""
    from pyspark.sql import Window as W

    part = fresh(blocks, "_chunk")
    cut = blocks.withColumn(part, F.floor(F.col(block) / chunk))
    tops = cut.groupBy(*group, part).agg(*(F.sum(v).alias(f"_top_{k}") for k, v in sums.items()))
    over = W.partitionBy(*group).orderBy(part).rowsBetween(W.unboundedPreceding, -1) if group else W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    tops = tops.select(*group, part, *(F.coalesce(F.sum(f"_top_{k}").over(over), F.lit(0)).alias(f"_top_{k}") for k in sums))
    inside = W.partitionBy(*group, part).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    cut = cut.select("*", *(F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_in_{k}") for k, v in sums.items()))
    joined = cut.join(tops.hint("merge"), [*group, part])
    return joined.select(*blocks.columns, *((F.col(f"_in_{k}") + F.col(f"_top_{k}")).alias(k) for k in sums))
