"""Contributor credit and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tables import numbered

HANDLE = "^@[A-Za-z0-9-]+$"


def handles(df: DataFrame, keys: list[str], names: str, order: list[str]) -> DataFrame:
    """(keys..., handle, shown): one row per key and contributor; only names that are handles, compared without case,
    shown as first spelt in `order`."""
    rows = df.select(*dict.fromkeys([*keys, *order]), F.explode(names).alias("_raw")).withColumn("_raw", F.trim("_raw"))
    rows = rows.filter(F.col("_raw").rlike(HANDLE)).withColumn("handle", F.lower("_raw"))
    first = rows.groupBy("handle").agg(F.min_by("_raw", F.struct(*order, "_raw")).alias("shown"))
    return rows.select(*keys, "handle").distinct().join(first, "handle").select(*keys, "handle", "shown")


def credit(rows: DataFrame, by: list[str]) -> DataFrame:
    """Per contributor: codes, front, exact, best efficiency and geometric score with the keys that hold them.

    rows: (by..., key, record, exact, eff, geo, d, n). The geometric headline needs d >= 3."""
    return _shown(_totals(rows, by), by)


def _totals(rows: DataFrame, by: list[str]) -> DataFrame:
    """Counts and the two best rows, which merge by sum and by maximum."""
    best = lambda value, ok: F.max(F.when(ok, F.struct(F.col(value).alias("v"), (-F.col("n")).alias("s"), (-F.col("key")).alias("o"))))
    return rows.groupBy(*by).agg(
        F.count("*").alias("codes"), F.count_if("record").alias("front"), F.count_if("exact").alias("n_exact"),
        best("eff", F.col("eff").isNotNull()).alias("e"), best("geo", F.col("geo").isNotNull() & (F.col("d") >= 3)).alias("g"),
    )


def _shown(totals: DataFrame, by: list[str]) -> DataFrame:
    return totals.select(*by, "codes", "front", "n_exact", F.col("e.v").alias("best_eff"), (-F.col("e.o")).alias("eff_key"), F.col("g.v").alias("best_geo"), (-F.col("g.o")).alias("geo_key"))


def secondary(layouts: DataFrame, authors: DataFrame, key: str = "key") -> DataFrame:
    """(key, handle, role): authors, and layout contributors who are not authors of the row."""
    extra = layouts.select(key, "handle").distinct().join(authors.select(key, "handle"), [key, "handle"], "left_anti")
    return authors.select(key, "handle").distinct().withColumn("role", F.lit("author")).unionByName(extra.withColumn("role", F.lit("layout")))


def rankings(df: DataFrame, partition_by: list[str] | None = None, name: str = "handle") -> DataFrame:
    """Two places per contributor: by efficiency and by geometric score (nulls last)."""
    part = list(partition_by or [])
    shared = [F.desc("front"), F.desc("codes"), F.asc(name)]
    if not part:
        return numbered(numbered(df, [F.desc("best_eff"), *shared], "eff_rank"), [F.desc_nulls_last("best_geo"), *shared], "geo_rank")
    over = lambda *o: F.row_number().over(W.partitionBy(*part).orderBy(*o, *shared))
    return df.withColumns({"eff_rank": over(F.desc("best_eff")), "geo_rank": over(F.desc_nulls_last("best_geo"))})


def by_cap(rows: DataFrame, weight: str) -> DataFrame:
    """Every row once for each whole weight cap from its own weight to the greatest there is."""
    top = rows.agg(F.max(weight).alias("_top"))
    return rows.crossJoin(F.broadcast(top)).withColumn("cap", F.explode(F.sequence(F.col(weight), F.col("_top")))).drop("_top")


def credit_by_cap(rows: DataFrame, weight: str, by: list[str]) -> DataFrame:
    """credit() for every whole weight cap. Totals per weight come first, so what is repeated for each cap is one row
    a contributor and weight, not the rows."""
    capped = by_cap(_totals(rows, [*by, weight]), weight)
    sums = [F.sum(c).alias(c) for c in ("codes", "front", "n_exact")]
    return _shown(capped.groupBy("cap", *by).agg(*sums, F.max("e").alias("e"), F.max("g").alias("g")), ["cap", *by])


def steps(ranked: DataFrame, cap: str, rank: str, name: str) -> DataFrame:
    """(cap, version): caps with the same ordered ranking share a version, numbered by first cap.

    A ranking is known by its length and two sums (as exclusive or) of hashes of rank and name, which merge in any
    order; no row holds a ranking."""
    marks = [F.count("*").alias("_n"), F.bit_xor(F.xxhash64(rank, name)).alias("_a"), F.bit_xor(F.xxhash64(name, F.lit("/"), rank)).alias("_b")]
    same = ["_n", "_a", "_b"]
    known = ranked.groupBy(cap).agg(*marks)
    first = known.groupBy(*same).agg(F.min(cap).alias("_first"))
    numbered = first.withColumn("version", (F.row_number().over(W.orderBy("_first")) - 1).cast("long"))
    return known.join(numbered.hint("merge"), same).select(cap, "version")


def origin_split(df: DataFrame, origin: str) -> DataFrame:
    """One row: contributed and baseline rows and those eligible for the geometric ranking."""
    base = F.col(origin) == "baseline"
    return df.agg(F.count_if(~base).alias("contributed"), F.count_if(base).alias("baseline"), F.count_if(~base & F.col("geo").isNotNull()).alias("eligible"))


def work_list(rows: DataFrame, by: str, order: list) -> DataFrame:
    """Each contributor's rows with their `place` in its list, one row a work. A contributor's list is sorted in one
    task, which can spill, and never held as one row."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy(*order)))
