"""Exploding nested documents into incidence tables, and packing them again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def incidence(docs: DataFrame, key: str = "key", checks: str = "checks", sides: tuple[str, ...] = ("X", "Z")) -> DataFrame:
    """(key, side, check_idx, qubit) of a struct column with one array of supports per side."""
    out = None
    for side in sides:
        rows = docs.select(F.col(key), F.lit(side).alias("side"), F.posexplode(f"{checks}.{side}").alias("check_idx", "support"))
        rows = rows.select(key, "side", "check_idx", F.explode("support").alias("qubit"))
        out = rows if out is None else out.unionByName(rows)
    return out


def witness_rows(docs: DataFrame, key: str = "key", distance: str = "distance", sides: tuple[str, ...] = ("X", "Z")) -> DataFrame:
    """(key, side, qubit) of the witness arrays in a distance struct."""
    out = None
    for side in sides:
        rows = docs.select(F.col(key), F.lit(side).alias("side"), F.explode(f"{distance}.{side}.witness").alias("qubit"))
        out = rows if out is None else out.unionByName(rows)
    return out


def coords(docs: DataFrame, key: str = "key", coordinates: str = "locality.coordinates") -> DataFrame:
    """(key, qubit, x, y) of an array of points."""
    rows = docs.select(F.col(key), F.posexplode(coordinates).alias("qubit", "p"))
    return rows.select(key, "qubit", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"))


def explode_list(df: DataFrame, keys: list[str], column: str, alias: str, outer: bool = True) -> DataFrame:
    """One row per list member with its position; an empty list leaves one row of nulls if `outer`."""
    make = F.posexplode_outer if outer else F.posexplode
    return df.select(*keys, make(column).alias("pos", alias))


def xor_normalise(df: DataFrame, row: list[str], element: str) -> DataFrame:
    """Members of each row that occur an odd number of times."""
    return df.groupBy(*row, element).agg(F.count("*").alias("_times")).filter("_times % 2 = 1").drop("_times")


def bit_pack(df: DataFrame, row: list[str], element: str, bits: int = 64) -> DataFrame:
    """(row..., word, packed): bit `element % bits` of word `element / bits`, repeats cancelling."""
    word = F.floor(F.col(element) / bits).cast("int")
    place = F.pmod(F.col(element), F.lit(bits)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place)
    return df.groupBy(*row, word.alias("word")).agg(F.bit_xor(bit).alias("packed"))


def pack_rows(packed: DataFrame, row: list[str]) -> DataFrame:
    """One array of (word, packed) structs per row, by word."""
    return packed.groupBy(*row).agg(F.sort_array(F.collect_list(F.struct("word", "packed"))).alias("words"))


def ensemble_text(model: Column) -> Column:
    """Display string of a model given as text or as a JSON list of texts."""
    listed = F.from_json(model, "array<string>")
    return F.coalesce(F.when(model.startswith("["), F.array_join(listed, ", ")), model, F.lit(""))


def ensemble_parts(display: Column) -> Column:
    """Names behind a display string, split at + and commas."""
    parts = F.transform(F.split(F.coalesce(display, F.lit("")), "[+,]"), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def repack(rows: DataFrame, claims: DataFrame, key: str = "key") -> DataFrame:
    """Canonical nested document as JSON from incidence (key, side, check_idx, qubit) and claims (key, side, value)."""
    supports = rows.groupBy(key, "side", "check_idx").agg(F.sort_array(F.collect_list("qubit")).alias("support"))
    sides = supports.groupBy(key, "side").agg(F.transform(F.sort_array(F.collect_list(F.struct("check_idx", "support"))), lambda s: s["support"]).alias("rows"))
    pick = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    nested = sides.groupBy(key).agg(F.struct(F.coalesce(pick("X", "rows"), F.array().cast("array<array<bigint>>")).alias("X"), F.coalesce(pick("Z", "rows"), F.array().cast("array<array<bigint>>")).alias("Z")).alias("checks"))
    values = claims.groupBy(key).agg(F.struct(F.min("value").alias("d"), pick("X", "value").alias("X"), pick("Z", "value").alias("Z")).alias("distance"))
    joined = nested.join(values, key)
    return joined.select(key, F.to_json(F.struct(F.col(key), "checks", "distance")).alias("document"))
