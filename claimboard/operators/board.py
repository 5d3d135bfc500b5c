"""Filters, orders, facets and views of the board table."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scoring
from .normalize import ensemble_text

#: Parts of a cell that keep their own first rows.
TOP_SALTS = 256

_TERM = re.compile(r"^(n|k|d|w|eff|g)(>=|<=|>|<|=)(-?[0-9.]+)$")


def build_entries(docs: DataFrame, reports: DataFrame, earned: DataFrame, measured: DataFrame, certs: DataFrame, notes: DataFrame, key: str = "key") -> DataFrame:
    """The board's table: one row for each document that passes all rules and has an earned distance.

    docs: (key, name, n, k, family, origin, novelty, authors array, model, date, construction, contributed_by); reports:
    (key, ok); earned: (key, d, x, z); measured: (key, w, locality_class, layers, radius), layers and radius null without
    a layout; certs: (key, certified, cert_d, cert_x, cert_z); notes: (key, note). One row per key in each. Absent
    fields get their defaults; a certificate that contradicts the distance earns nothing."""
    kept = docs.join(reports.filter("ok").select(key), key, "left_semi").join(earned.filter("d IS NOT NULL").select(key, "d", "x", "z"), key)
    full = kept.join(measured.select(key, "w", "locality_class", "layers", "radius"), key, "left").join(certs.select(key, "certified", "cert_d", "cert_x", "cert_z"), key, "left").join(notes.select(key, "note"), key, "left")
    c, text = F.col, lambda name, default="": F.coalesce(F.col(name), F.lit(default)).alias(name)
    laid_out = c("radius") > 0
    return full.select(
        key, "name", "n", "k", "d", scoring.efficiency(c("n"), c("k"), c("d")).alias("eff"),
        scoring.tier(c("certified"), c("cert_d"), c("d"), c("cert_x"), c("x"), c("cert_z"), c("z")).alias("tier"),
        F.round(scoring.geometric_score(c("n"), c("k"), c("d"), c("layers"), c("radius")), 4).alias("geo"),
        F.when(laid_out, F.round("radius", 4)).alias("geo_r"), F.when(laid_out, F.coalesce("layers", F.lit(1))).alias("geo_rho"),
        "w", text("family", "other"), text("locality_class", "unrestricted"), F.coalesce(scoring.weight_class(c("w")), F.lit(scoring.WEIGHT_ORDER[-1])).alias("weight_class"),
        text("origin", "submission"), text("novelty", "unknown"), F.array_join("authors", ", ").alias("authors"), c("authors").alias("authors_list"),
        "contributed_by", ensemble_text(c("model")).alias("model"), text("date"), text("construction"), "note",
    )


def board_filter(terms: list[str], columns: dict[str, str] | None = None, haystack: str | None = None, cells: str = "cells", record: str = "record") -> Column:
    """Condition that all terms hold: comparisons such as `n<=72`, `record`, `cell:NAME`, or free text found in the
    haystack column. A null value matches no comparison."""
    out = F.lit(True)
    for term in terms:
        m = _TERM.match(term.lower())
        if m:
            column, value = F.col((columns or {}).get(m[1], m[1])), float(m[3])
            test = {">=": column >= value, "<=": column <= value, ">": column > value, "<": column < value, "=": column == value}[m[2]]
        elif term.lower() in ("record", "frontier"):
            test = F.col(record)
        elif term.lower().startswith("cell:"):
            test = F.array_contains(cells, term[5:])
        else:
            test = F.contains(F.lower(F.col(haystack)), F.lit(term.lower()))
        out = out & F.coalesce(test, F.lit(False))
    return out


def haystack(*parts: Column) -> Column:
    """Lower-case text that free terms are looked up in."""
    return F.lower(F.concat_ws(" ", *parts))


def in_ranges(ranges: dict[str, tuple[float, float]]) -> Column:
    """Closed ranges whose bounds may be given in either order."""
    out = F.lit(True)
    for column, (a, b) in ranges.items():
        out = out & F.col(column).between(min(a, b), max(a, b))
    return out


def default_order() -> list[Column]:
    """Best efficiency first, then greater k, greater d, smaller n."""
    return [F.desc("eff"), F.desc("k"), F.desc("d"), F.asc("n")]


def composite_key(n: Column, k: Column, d: Column) -> Column:
    """One number that sorts like (n, k, d)."""
    return (n * 1_000_000 + k * 1000 + d).cast("long")


def shown_of_total(df: DataFrame, condition: Column, facets: list[str]) -> DataFrame:
    """One row: rows that match, all rows, and each facet's bounds."""
    bounds = [f(c).alias(f"{n}_{c}") for c in facets for f, n in ((F.min, "min"), (F.max, "max"))]
    return df.agg(F.count_if(condition).alias("shown"), F.count("*").alias("total"), *bounds)


def latest(df: DataFrame, records: DataFrame, n: int, date: str = "date", key: str = "key") -> DataFrame:
    """The last n rows by (date, key) with a record flag."""
    top = df.filter(F.col(date).isNotNull()).orderBy(F.desc(date), F.desc(key)).limit(n)
    flags = records.select(key).distinct().withColumn("record", F.lit(True))
    return top.join(flags, key, "left").withColumn("record", F.coalesce("record", F.lit(False)))


def facets(df: DataFrame, family: str, local: Column) -> DataFrame:
    """(families, any_local): distinct families in order and whether any row is local."""
    return df.agg(F.sort_array(F.collect_set(family)).alias("families"), F.bool_or(local).alias("any_local"))


def collapsed(df: DataFrame, condition: Column, order: list[Column], n: int = 10) -> DataFrame:
    """Rows that match; only the first n in order when nothing is filtered out."""
    counted = df.agg(F.count_if(condition).alias("_shown"), F.count("*").alias("_total"))
    first = df.orderBy(*order).limit(n)
    every = df.filter(condition).crossJoin(F.broadcast(counted)).filter("_shown < _total").drop("_shown", "_total")
    return every.unionByName(first.crossJoin(F.broadcast(counted)).filter("_shown = _total").drop("_shown", "_total"))


def plot_guard(df: DataFrame, group: list[str], x: Column, y: Column, least: int = 4) -> DataFrame:
    """(group..., points, plotted): whether a group has enough distinct rounded points."""
    points = df.select(*group, x.alias("x"), y.alias("y")).distinct().groupBy(*group).agg(F.count("*").alias("points"))
    return points.withColumn("plotted", F.col("points") >= least)


def ranked(df: DataFrame, partition_by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Rows numbered inside each partition."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*partition_by).orderBy(*order)))


def top_of_either(df: DataFrame, cell: list[str], first: list[Column], second: list[Column], counts: Column, n: int = 3) -> DataFrame:
    """Rows among a cell's first n by one order, or by the other among rows that count for it.

    Each of TOP_SALTS parts of a cell keeps its own first rows, which include the cell's, so no task sorts a whole cell."""

    def tops(rows: DataFrame, part: list[str]) -> DataFrame:
        a = F.row_number().over(W.partitionBy(*part).orderBy(*first))
        b = F.row_number().over(W.partitionBy(*part, counts).orderBy(*second))
        both = rows.withColumns({"_a": a, "_b": F.when(counts, b)})
        return both.filter(f"_a <= {n} OR _b <= {n}").drop("_a", "_b")

    dealt = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(TOP_SALTS)))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tops(tops(dealt.repartition(parts, *cell, "_salt"), [*cell, "_salt"]).drop("_salt"), cell)


def orphans(published: DataFrame, live: DataFrame, key: str = "key") -> DataFrame:
    """Published keys without a live entry."""
    return published.select(key).join(live.select(key), key, "left_anti")
