"""Distances, sites and boxes over coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tables import numbered, setting, ship, written

#: Locality classes by tightness with their caps on layers and radius.
LOCALITY_CAPS = [("local-2d-single", 1, 4.0), ("local-2d-bilayer", 2, 7.0)]
UNRESTRICTED = "unrestricted"
#: Points of a group that are compared inside one row.
FEW_POINTS = 64
#: Points that a task should take.
TASK_POINTS = 1_000_000


def _outer(points: DataFrame, group: list[str], id_: str) -> DataFrame:
    """Points that may end a widest pair of different ids, two ids per place at most, the least ones.

    The widest of the distances between opposite extremes in four directions bounds the diameter from below; a point
    whose farthest corner of the group's box is nearer than that ends no widest pair. Ids may repeat."""
    extreme = lambda f, by: f(F.struct("x", "y", F.col(id_).alias("id")), by)
    axes = {"h": F.col("x"), "v": F.col("y"), "u": F.col("x") + F.col("y"), "w": F.col("x") - F.col("y")}
    ends = [extreme(f, by).alias(f"{end}_{c}") for c, by in axes.items() for end, f in (("lo", F.min_by), ("hi", F.max_by))]
    box = points.groupBy(*group).agg(*ends)
    length = lambda dx, dy: F.sqrt(F.pow(dx, 2) + F.pow(dy, 2))
    span = lambda c: F.when(F.col(f"hi_{c}.id") != F.col(f"lo_{c}.id"), length(F.col(f"hi_{c}.x") - F.col(f"lo_{c}.x"), F.col(f"hi_{c}.y") - F.col(f"lo_{c}.y")))
    least = F.greatest(*map(span, axes), F.lit(0.0))
    box = box.select(*group, least.alias("_least"), F.col("lo_h.x").alias("_x0"), F.col("hi_h.x").alias("_x1"), F.col("lo_v.y").alias("_y0"), F.col("hi_v.y").alias("_y1"))
    far = length(F.greatest(F.col("x") - F.col("_x0"), F.col("_x1") - F.col("x")), F.greatest(F.col("y") - F.col("_y0"), F.col("_y1") - F.col("y")))
    kept = points.join(box, group).filter(far >= F.col("_least") * (1 - 1e-9)).select(*group, id_, "x", "y").distinct()
    place = F.row_number().over(W.partitionBy(*group, "x", "y").orderBy(id_))
    return kept.withColumn("_place", place).filter("_place <= 2").drop("_place")


def _pairs(points: DataFrame, group: list[str], id_: str) -> DataFrame:
    """(group..., a, b, dist) of the pairs of different ids among the outer points."""
    points = _outer(points, group, id_)
    a = points.select(*group, F.col(id_).alias("a"), F.col("x").alias("xa"), F.col("y").alias("ya"))
    b = points.select(*group, F.col(id_).alias("b"), F.col("x").alias("xb"), F.col("y").alias("yb"))
    met = a.join(b.hint("merge"), group).filter("a < b")
    return met.select(*group, "a", "b", F.sqrt(F.pow(F.col("xa") - F.col("xb"), 2) + F.pow(F.col("ya") - F.col("yb"), 2)).alias("dist"))


def hull(xs, ys):
    """Places in the arrays of the corners of the convex hull, counter-clockwise; points are distinct."""
    import numpy as np

    order = np.lexsort((ys, xs)).tolist()
    if len(order) < 3:
        return order
    px, py = xs.tolist(), ys.tolist()

    def chain(places):
        out: list[int] = []
        for i in places:
            while len(out) > 1 and (px[out[-1]] - px[out[-2]]) * (py[i] - py[out[-2]]) - (py[out[-1]] - py[out[-2]]) * (px[i] - px[out[-2]]) <= 0:
                out.pop()
            out.append(i)
        return out[:-1]

    return chain(order) + chain(order[::-1])


def opposite(xs: list[float], ys: list[float]):
    """Pairs of corners of a convex polygon that parallel lines can hold it by, among them all pairs at the greatest distance."""
    n, j = len(xs), 1
    if n < 2:
        return
    if n == 2:
        yield 0, 1
        return
    for i in range(n):
        k = (i + 1) % n
        ex, ey = xs[k] - xs[i], ys[k] - ys[i]
        while True:
            after = (j + 1) % n
            turn = ex * (ys[after] - ys[j]) - ey * (xs[after] - xs[j])
            if turn <= 0:
                break
            j = after
        yield i, j
        yield k, j
        if turn == 0:
            yield i, after
            yield k, after


def _hull_pairs(points: DataFrame, group: list[str], id_: str) -> DataFrame:
    """(group..., a, b, dist) of groups of distinct places of distinct ids: tasks take hulls of their batches, and each
    group's hull of those is walked round once. `points` has the least ids of every place as id and (or null) other."""
    import pandas as pd

    ship(points.sparkSession)
    kinds = dict(points.dtypes)
    keys = ", ".join(f"`{g}` {kinds[g]}" for g in group)

    def partial(batches):
        for pdf in batches:
            for _, part in pdf.groupby(group, dropna=False):
                yield part.iloc[hull(part["x"].to_numpy(), part["y"].to_numpy())]

    def final(key, pdf):
        pdf = pdf.iloc[hull(pdf["x"].to_numpy(), pdf["y"].to_numpy())]
        xs, ys, ids = pdf["x"].tolist(), pdf["y"].tolist(), pdf[id_].tolist()
        best = None
        if len(ids) == 1 and pdf["other"].notna().all():
            best = (0.0, ids[0], pdf["other"].iloc[0])
        for i, j in opposite(xs, ys):
            dist = ((xs[i] - xs[j]) ** 2 + (ys[i] - ys[j]) ** 2) ** 0.5
            if best is None or dist >= best[0]:
                a, b = sorted((ids[i], ids[j]))
                if best is None or dist > best[0] or (a, b) < best[1:]:
                    best = (dist, a, b)
        return pd.DataFrame([[*key, best[1], best[2], best[0]]] if best else [], columns=[*group, "a", "b", "dist"])

    some = points.select(*group, id_, "other", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    corners = some.mapInPandas(partial, f"{keys}, `{id_}` {kinds[id_]}, other {kinds[id_]}, x double, y double")
    return corners.groupBy(*group).applyInPandas(final, f"{keys}, a {kinds[id_]}, b {kinds[id_]}, dist double")


def _widest(points: DataFrame, group: list[str], id_: str) -> DataFrame:
    """(group..., a, b, dist), one row a group, null where it has no two ids: the widest pair of different ids, the first on ties.

    `points` is counted and read, so it is best a written table; both windows share one sort, in tasks of about TASK_POINTS
    points. Groups of at most FEW_POINTS points compare them inside one row. In larger ones, a widest pair joins two corners of
    the convex hull; only where an id stands at several places are outer points paired instead."""
    spark, order = points.sparkSession, W.partitionBy(*group).orderBy(id_, "x", "y")
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-points.count() // TASK_POINTS))
    few = points.repartition(tasks, *group).select(*group, F.struct(F.col(id_).alias("id"), "x", "y").alias("p"), F.count("*").over(whole).alias("n"), F.row_number().over(order).alias("rn")).filter(F.col("rn") <= FEW_POINTS)
    with setting(spark, "spark.sql.execution.useObjectHashAggregateExec", "false"):  # the rows are in order of their groups already
        rows = written(few.groupBy(*group).agg(F.max("n").alias("n"), F.array_sort(F.collect_list("p")).alias("ps")), "geometry-groups")
    span = lambda p, q: F.sqrt(F.pow(p["x"] - q["x"], 2) + F.pow(p["y"] - q["y"], 2))
    # an id's first place stands for it, so of equal distances the pair with the least ids is the greatest
    pair = lambda p, q: F.when((q["r"] > p["r"]) & span(p["p"], q["p"]).isNotNull(), F.struct(span(p["p"], q["p"]).alias("dist"), (-p["r"]).alias("i"), (-q["r"]).alias("j")))
    after = lambda p, i: F.array_max(F.transform(F.slice("qs", i + 2, F.size("qs")), lambda q: pair(p, q)))
    small = rows.filter(F.col("n") <= FEW_POINTS).select(*group, "ps", F.transform("ps", lambda p: p["id"]).alias("ids"))
    small = small.select(*group, "ids", F.transform("ps", lambda p: F.struct(p.alias("p"), F.array_position("ids", p["id"]).alias("r"))).alias("qs"))
    small = small.select(*group, "ids", F.array_max(F.transform("qs", after)).alias("p"))
    at = lambda c: F.get("ids", (-F.col(c) - 1).cast("int"))
    small = small.select(*group, at("p.i").alias("a"), at("p.j").alias("b"), "p.dist")
    large = rows.filter(F.col("n") > FEW_POINTS).select(*group)
    if large.isEmpty():
        return small
    same = lambda df, other, how: df.alias("l").join(other.alias("r").hint("merge"), [F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}")) for g in group], how)
    places = written(same(points.select(*group, id_, "x", "y"), large, "left_semi").distinct(), "geometry-places")
    spread = written(places.groupBy(*group, id_).count().filter("count > 1").select(*group).distinct(), "geometry-spread")
    one = same(places, spread, "left_anti").withColumn("place", F.row_number().over(W.partitionBy(*group, "x", "y").orderBy(id_))).filter("place <= 2")
    sites = one.groupBy(*group, "x", "y").agg(F.min(id_).alias(id_), F.min(F.when(F.col("place") == 2, F.col(id_))).alias("other"))
    best = F.max_by(F.struct("a", "b", "dist"), F.struct("dist", (-F.col("a")).alias("na"), (-F.col("b")).alias("nb")))
    found = _hull_pairs(sites, group, id_).unionByName(_pairs(same(places, spread, "left_semi"), group, id_).groupBy(*group).agg(best.alias("p")).select(*group, "p.*"))
    lacking = same(large, found, "left_anti").select(*group, *(F.lit(None).cast(t).alias(c) for c, t in found.dtypes if c not in group))
    return small.unionByName(found).unionByName(lacking)


def group_diameter(points: DataFrame, group: list[str], id_: str) -> DataFrame:
    """(group..., diameter): greatest distance inside each group, 0 for one point."""
    return _widest(points, group, id_).select(*group, F.coalesce("dist", F.lit(0.0)).alias("diameter"))


def widest_pair(points: DataFrame, group: list[str], id_: str) -> DataFrame:
    """(group..., a, b, dist): the pair at the greatest distance, the first in order on ties."""
    return _widest(points, group, id_).filter("dist IS NOT NULL")


def site_multiplicity(points: DataFrame, group: list[str]) -> DataFrame:
    """(group..., multiplicity): most points at one place."""
    return points.groupBy(*group, "x", "y").agg(F.count("*").alias("c")).groupBy(*group).agg(F.max("c").alias("multiplicity"))


def min_spacing(points: DataFrame, group: list[str]) -> DataFrame:
    """(group..., spacing): least distance between distinct places, null for one place.

    Neighbours in (x, y) order bound it from above; squares of that side are then joined with the nine around."""
    sites = points.select(*group, "x", "y").distinct()
    order = W.partitionBy(*group).orderBy("x", "y")
    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(order), 2) + F.pow(F.col("y") - F.lag("y").over(order), 2))
    bound = sites.withColumn("step", step).groupBy(*group).agg(F.min("step").alias("side"))
    placed = sites.join(bound, group).filter("side IS NOT NULL")
    cell = lambda c: F.floor(F.col(c) / F.col("side"))
    placed = placed.withColumns({"i": cell("x"), "j": cell("y")})
    around = F.explode(F.expr("flatten(transform(sequence(-1, 1), p -> transform(sequence(-1, 1), q -> struct(p, q))))"))
    spread = placed.select(*group, F.col("x").alias("xb"), F.col("y").alias("yb"), "i", "j", around.alias("o"))
    spread = spread.select(*group, "xb", "yb", (F.col("i") + F.col("o.p")).alias("i"), (F.col("j") + F.col("o.q")).alias("j"))
    near = placed.join(spread, [*group, "i", "j"]).filter("x < xb OR (x = xb AND y < yb)")
    least = near.groupBy(*group).agg(F.min(F.sqrt(F.pow(F.col("x") - F.col("xb"), 2) + F.pow(F.col("y") - F.col("yb"), 2))).alias("spacing"))
    return sites.select(*group).distinct().join(least, group, "left")


def bounding_box(points: DataFrame, group: list[str]) -> DataFrame:
    """(group..., width, height, density): box and points per unit area, null where the area is 0."""
    box = points.groupBy(*group).agg((F.max("x") - F.min("x")).alias("width"), (F.max("y") - F.min("y")).alias("height"), F.count("*").alias("n"))
    return box.select(*group, "width", "height", (F.col("n") / F.nullif(F.col("width") * F.col("height"), F.lit(0.0))).alias("density"))


def locality_class(covered: Column, layers: Column, multiplicity: Column, spacing: Column, radius: Column, slack: float = 1e-9, by_layers: bool = True) -> Column:
    """Tightest class whose caps an honest layout meets. `by_layers`: places may hold as many points as the layout
    declares layers; otherwise as many as the class allows. The strict variant has slack 0 and by_layers False."""
    spaced = spacing.isNull() | (spacing >= 1.0 - slack)
    out = F.lit(UNRESTRICTED)
    for name, cap, reach in reversed(LOCALITY_CAPS):
        shared = multiplicity <= (layers if by_layers else F.lit(cap))
        out = F.when(covered & spaced & shared & (layers <= cap) & (radius <= reach + slack), F.lit(name)).otherwise(out)
    return out


def corner_pinned(points: DataFrame, group: list[str], size: str, radius: str) -> DataFrame:
    """(group..., pinned): the support's box is smaller than the radius and near an edge on both axes of the grid."""
    box = points.groupBy(*group, size, radius).agg(*(f(c).alias(f"{n}{c}") for c in ("x", "y") for f, n in ((F.min, "lo"), (F.max, "hi"))))
    near = lambda c: (F.col(f"hi{c}") - F.col(f"lo{c}") < F.col(radius)) & ((F.col(f"lo{c}") < F.col(radius)) | (F.col(f"hi{c}") > F.col(size) - 1 - F.col(radius)))
    return box.select(*group, (near("x") & near("y")).alias("pinned"))


def bounded(finds: DataFrame, key: str) -> DataFrame:
    """(key, weight): the weight found at both of two sizes if it is the same and pinned at both, else null.
    finds: (key, size_rank 1 or 2, weight, pinned)."""
    at = lambda r, c: F.max(F.when(F.col("size_rank") == r, F.col(c)))
    both = finds.groupBy(key).agg(at(1, "weight").alias("w1"), at(2, "weight").alias("w2"), at(1, "pinned").alias("p1"), at(2, "pinned").alias("p2"))
    return both.select(key, F.when(F.col("p1") & F.col("p2") & (F.col("w1") == F.col("w2")), F.col("w1")).alias("weight"))


def grid(spark, width: int, height: int, keep: DataFrame | None = None) -> DataFrame:
    """(qubit, x, y) of a grid in row order; with `keep` (id) only those, numbered anew in order."""
    points = spark.range(width * height).select("id", F.floor(F.col("id") / height).alias("x"), (F.col("id") % height).alias("y"))
    if keep is None:
        return points.select(F.col("id").alias("qubit"), "x", "y")
    kept = points.join(keep, "id", "left_semi")
    return numbered(kept, [F.col("id")], "place").select((F.col("place") - 1).cast("long").alias("qubit"), "x", "y")
