"""Classes, scores, labels and the board's entry table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Class orders from tight to loose, weight caps, and what a label falls back to.
LOCALITY_ORDER = ["local-2d-single", "local-2d-bilayer", "unrestricted"]
WEIGHT_ORDER = ["weight-4", "weight-6", "weight-8", "weight-any"]
WEIGHT_CAPS = [4, 6, 8]
FAMILY_LABELS = {
    "bivariate-bicycle": "bivariate bicycle", "generalized-bicycle": "generalized bicycle", "2bga-coset": "2BGA coset",
    "hypergraph-product": "hypergraph product", "lifted-product": "lifted product", "balanced-product": "balanced product",
    "quantum-tanner": "quantum Tanner", "tile": "tile", "topological": "topological", "other": "other",
}


def weight_class(w: Column) -> Column:
    """Tightest class whose cap holds."""
    out = F.lit(WEIGHT_ORDER[-1])
    for cap, name in reversed(list(zip(WEIGHT_CAPS, WEIGHT_ORDER))):
        out = F.when(w <= cap, F.lit(name)).otherwise(out)
    return out


def tightness(label: Column, order: list[str], unknown: int = 9) -> Column:
    """Place of a label in a class order."""
    return F.coalesce(F.create_map(*(F.lit(x) for i, k in enumerate(order) for x in (k, i)))[label], F.lit(unknown))


def nested_cells(df: DataFrame, axes: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """Every row once for each combination of its own and all looser classes.

    axes: output column -> (class column, order from tight to loose); an unknown class counts as the loosest."""
    out = df
    for name, (column, order) in axes.items():
        place = F.least(tightness(F.col(column), order, len(order) - 1), F.lit(len(order) - 1))
        members = F.slice(F.array(*map(F.lit, order)), place + 1, F.lit(len(order)))
        out = out.withColumn(name, F.explode(members))
    return out


def efficiency(n: Column, k: Column, d: Column) -> Column:
    """k d^2 / n, 0 where n is 0, to three places."""
    return F.when(n == 0, F.lit(0.0)).otherwise(F.bround(k * d * d / n, 3))


def geometric_score(n: Column, k: Column, d: Column, layers: Column, radius: Column) -> Column:
    """4 k d^2 / (n layers^2 radius^4); null without a layout or with a radius of 0."""
    return F.when(radius > 0, 4.0 * k * d * d / (n * F.coalesce(layers, F.lit(1)) ** 2 * radius**4))


def tier(certified: Column, cert_d: Column, d: Column, cert_x: Column, x: Column, cert_z: Column, z: Column) -> Column:
    """`exact` if an exact certificate agrees wherever both sides report, else `ub`."""
    agree = lambda a, b: a.isNull() | b.isNull() | (a == b)
    return F.when(F.coalesce(certified, F.lit(False)) & agree(cert_d, d) & agree(cert_x, x) & agree(cert_z, z), F.lit("exact")).otherwise(F.lit("ub"))


def is_reference(family: Column, origin: Column) -> Column:
    """Seeded topological rows, against which the geometric score is normalised."""
    return (family == "topological") & (origin == "baseline")


def label_lookup(df: DataFrame, labels: DataFrame, column: str, out: str, default: Column | None = None) -> DataFrame:
    """`out`: the label of a value in labels (value, label), else the default or the value itself. Labels are a short
    list of literals, so they are broadcast."""
    named = labels.select(F.col("value").alias(column), F.col("label").alias(out))
    joined = df.join(F.broadcast(named), column, "left")
    return joined.withColumn(out, F.coalesce(out, default if default is not None else F.col(column)))
