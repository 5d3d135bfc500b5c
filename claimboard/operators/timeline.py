"""Running records, windows anchored at the data, and headline rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tables import numbered


def running_records(df: DataFrame, group: list[str], date: str, metric: str, key: str) -> DataFrame:
    """Rows above 0 and strictly above every earlier one in (date, metric, key) order; null dates and metrics drop.

    Works by day: a row can only be a record if it beats the maximum of all earlier days, which is a running maximum
    over one row per day; rows are then compared inside their day alone. No task sees a whole series."""
    rows = df.filter(F.col(date).isNotNull() & F.col(metric).isNotNull() & (F.col(metric) > 0))
    days = rows.groupBy(*group, date).agg(F.max(metric).alias("_top"))
    before = F.max("_top").over(W.partitionBy(*group).orderBy(date).rowsBetween(W.unboundedPreceding, -1))
    days = days.select(*group, F.col(date).alias("_day"), before.alias("_before"))
    same = F.col(f"r.{date}") == F.col("d._day")
    for g in group:
        same = same & F.col(f"r.{g}").eqNullSafe(F.col(f"d.{g}"))
    met = rows.alias("r").join(days.alias("d"), same).filter(F.col("d._before").isNull() | (F.col(f"r.{metric}") > F.col("d._before"))).select("r.*")
    inside = F.max(metric).over(W.partitionBy(*group, date).orderBy(metric, key).rowsBetween(W.unboundedPreceding, -1))
    return met.withColumn("_inside", inside).filter(F.col("_inside").isNull() | (F.col(metric) > F.col("_inside"))).drop("_inside")


def capped_records(df: DataFrame, weight: str, caps: list[int | None], date: str, metric: str, key: str) -> DataFrame:
    """Running records among rows up to each cap (None: all), with the cap's label."""
    member = F.array_compact(F.array(*(F.lit("any") if c is None else F.when(F.col(weight) <= c, F.lit(f"w<={c}")) for c in caps)))
    return running_records(df.withColumn("cap", F.explode(member)), ["cap"], date, metric, key)


def record_events(records: DataFrame, date: str, metric: str, key: str) -> DataFrame:
    """One event per key, its earliest, with its place by (date, metric, key). There are as many as records."""
    one = records.groupBy(key).agg(F.min(F.struct(date, metric)).alias("e")).select(key, f"e.{date}", f"e.{metric}")
    return numbered(one, [F.col(date), F.col(metric), F.col(key)], "ordinal")


def first_per_year(events: DataFrame, date: str) -> DataFrame:
    """(year, ordinal): the first event of each year."""
    return events.groupBy(F.substring(F.col(date).cast("string"), 1, 4).alias("year")).agg(F.min("ordinal").alias("ordinal"))


def trailing_window(df: DataFrame, date: str, days: int) -> DataFrame:
    """Rows of the last `days` days counted from the latest date in the data, both ends included."""
    last = df.agg(F.max(date).alias("_last"))
    return df.crossJoin(F.broadcast(last)).filter(F.datediff("_last", date) <= days).drop("_last")


def top_groups(df: DataFrame, name: str, blank: str, n: int, order: list[str]) -> DataFrame:
    """Rows of the n groups with most rows, names compared without case and shown as first seen; blank names go by
    `blank`. Adds `group_name`."""
    named = df.withColumn("_name", F.when(F.trim(F.coalesce(name, F.lit(""))) == "", F.lit(blank)).otherwise(F.trim(name)))
    named = named.withColumn("_fold", F.lower("_name"))
    sizes = named.groupBy("_fold").agg(F.count("*").alias("_n"), F.min_by("_name", F.struct(*order)).alias("group_name"))
    top = sizes.orderBy(F.desc("_n"), "_fold").limit(n).select("_fold", "group_name")
    return named.join(F.broadcast(top), "_fold").drop("_fold", "_name")


def headline(df: DataFrame, metric: str, size: str, key: str, counts: Column | None = None) -> DataFrame:
    """One row: the best metric, ties to the smaller size and then the smaller key."""
    rows = df.filter(counts) if counts is not None else df
    return rows.filter(F.col(metric).isNotNull()).orderBy(F.desc(metric), size, key).limit(1)


def recent(df: DataFrame, notes: DataFrame, date: str, days: int, key: str) -> DataFrame:
    """Rows of the trailing window with a flag for those that have a note."""
    flags = notes.select(key).distinct().withColumn("has_note", F.lit(True))
    return trailing_window(df, date, days).join(flags, key, "left").withColumn("has_note", F.coalesce("has_note", F.lit(False)))
