"""Candidate generation as relational products."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tables import written
from .graph import cosets, normaliser
from .normalize import xor_normalise

#: Rows of a hypergraph product that a task should make.
PRODUCT_ROWS = 2_000_000


def torus_code(specs: DataFrame) -> DataFrame:
    """(spec, side, check_idx, qubit) of two-block codes on an l x m torus. specs: (spec, l, m, a, b) with arrays of
    struct(x, y) terms. Row (i, j) of X meets the shifts of A in block 0 and of B in block 1; Z has both transposed
    and swapped. Repeated terms cancel."""
    cells = specs.withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("l") * F.col("m") - 1)))
    cells = cells.withColumns({"i": F.floor(F.col("cell") / F.col("m")), "j": F.col("cell") % F.col("m")})
    out = None
    for side, block, terms, sign in (("X", 0, "a", 1), ("X", 1, "b", 1), ("Z", 0, "b", -1), ("Z", 1, "a", -1)):
        rows = cells.select("spec", F.lit(side).alias("side"), F.col("cell").alias("check_idx"), "l", "m", "i", "j", F.explode(terms).alias("t"))
        at = F.pmod(F.col("i") + sign * F.col("t.x"), F.col("l")) * F.col("m") + F.pmod(F.col("j") + sign * F.col("t.y"), F.col("m"))
        rows = rows.select("spec", "side", "check_idx", (at + block * F.col("l") * F.col("m")).cast("long").alias("qubit"))
        out = rows if out is None else out.unionByName(rows)
    return xor_normalise(out, ["spec", "side", "check_idx"], "qubit")


def _square(specs: DataFrame, size: Column) -> DataFrame:
    """Every (g, h) below each spec's size; groups are small, specs are many."""
    rows = specs.select("*", F.explode(F.sequence(F.lit(0).cast("long"), size - 1)).alias("g"))
    return rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), size - 1)).alias("h"))


def cyclic_tables(specs: DataFrame) -> DataFrame:
    """(grp, g, h, gh) of Z_a x Z_b for each spec (grp, a, b); element (x, y) is x * b + y."""
    rows = _square(specs, (F.col("a") * F.col("b")).cast("long"))
    x = (F.floor(F.col("g") / F.col("b")) + F.floor(F.col("h") / F.col("b"))) % F.col("a")
    y = (F.col("g") % F.col("b") + F.col("h") % F.col("b")) % F.col("b")
    return rows.select("grp", "g", "h", (x * F.col("b") + y).cast("long").alias("gh"))


def table_product(a: DataFrame, b: DataFrame, sizes: DataFrame) -> DataFrame:
    """Tables of A x B for groups of the same name in both; element (x, y) is x * |B| + y. sizes: (grp, size_b)."""
    x = a.select("grp", F.col("g").alias("ga"), F.col("h").alias("ha"), F.col("gh").alias("gha"))
    y = b.select("grp", F.col("g").alias("gb"), F.col("h").alias("hb"), F.col("gh").alias("ghb"))
    both = x.join(y, "grp").join(sizes, "grp")
    pack = lambda p, q: (F.col(p) * F.col("size_b") + F.col(q)).cast("long")
    return both.select("grp", pack("ga", "gb").alias("g"), pack("ha", "hb").alias("h"), pack("gha", "ghb").alias("gh"))


def metacyclic_tables(specs: DataFrame) -> DataFrame:
    """(grp, g, h, gh) of <a, b | a^n, b^k, b a b^-1 = a^r> for each spec (grp, n, k, r); a^i b^j is i * k + j. Specs
    whose r^k is not 1 modulo n give no rows; r = n - 1, k = 2 is the dihedral group."""
    power = lambda j: F.aggregate(F.sequence(F.lit(1).cast("long"), j), F.lit(1).cast("long"), lambda acc, _: acc * F.col("r") % F.col("n"))
    at = lambda j: F.when(j == 0, F.lit(1).cast("long") % F.col("n")).otherwise(power(F.greatest(j, F.lit(1).cast("long"))))
    valid = specs.select("grp", *(F.col(c).cast("long").alias(c) for c in ("n", "k", "r"))).filter(power(F.col("k")) % F.col("n") == F.lit(1) % F.col("n"))
    rows = _square(valid, F.col("n") * F.col("k"))
    k = F.col("k")
    i, j, p, q = F.floor(F.col("g") / k), F.col("g") % k, F.floor(F.col("h") / k), F.col("h") % k
    return rows.select("grp", "g", "h", (F.pmod(i + at(j) * p, F.col("n")) * k + (j + q) % k).cast("long").alias("gh"))


def group_code(mul: DataFrame, left: DataFrame, right: DataFrame, sizes: DataFrame) -> DataFrame:
    """(grp, side, check_idx, qubit) of a two-block code: left multiplication by one support, right by the other.
    left, right: (grp, s); sizes: (grp, size)."""
    by_left = mul.join(left.select("grp", F.col("s").alias("g")).hint("merge"), ["grp", "g"]).select("grp", F.col("h").alias("x"), F.col("gh").alias("y"))
    by_right = mul.join(right.select("grp", F.col("s").alias("h")).hint("merge"), ["grp", "h"]).select("grp", F.col("g").alias("x"), F.col("gh").alias("y"))
    return _two_blocks(by_left, by_right, sizes)


def _two_blocks(by_left: DataFrame, by_right: DataFrame, sizes: DataFrame) -> DataFrame:
    """X = [left | right] and Z = [right transposed | left transposed] of two (grp, x, y) relations."""

    def rows(df: DataFrame, side: str, row: str, q: str, block: int) -> DataFrame:
        return df.join(sizes.hint("merge"), "grp").select("grp", F.lit(side).alias("side"), F.col(row).cast("long").alias("check_idx"), (F.col(q) + block * F.col("size")).cast("long").alias("qubit"))

    every = rows(by_left, "X", "x", "y", 0).unionByName(rows(by_right, "X", "x", "y", 1)).unionByName(rows(by_right, "Z", "y", "x", 0)).unionByName(rows(by_left, "Z", "y", "x", 1))
    return xor_normalise(every, ["grp", "side", "check_idx"], "qubit")


def coset_code(mul: DataFrame, subgroup: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """The same over the cosets of a subgroup; right supports outside the normaliser are left out."""
    numbered = cosets(mul, subgroup).select("grp", "g", "rep", "coset")
    reps = numbered.filter("g = rep").select("grp", F.col("rep").alias("h"), F.col("coset").alias("x"))
    image = numbered.select("grp", F.col("g").alias("gh"), F.col("coset").alias("y"))
    by_left = mul.join(left.select("grp", F.col("s").alias("g")).hint("merge"), ["grp", "g"]).join(reps.hint("merge"), ["grp", "h"]).join(image.hint("merge"), ["grp", "gh"]).select("grp", "x", "y")
    allowed = right.select("grp", F.col("s").alias("g")).join(normaliser(mul, subgroup), ["grp", "g"], "left_semi").select("grp", F.col("g").alias("h"))
    own = reps.select("grp", F.col("h").alias("g"), "x")
    by_right = mul.join(allowed.hint("merge"), ["grp", "h"]).join(own.hint("merge"), ["grp", "g"]).join(image.hint("merge"), ["grp", "gh"]).select("grp", "x", "y")
    return _two_blocks(by_left, by_right, numbered.groupBy("grp").agg(F.count_distinct("coset").alias("size")))


def hypergraph_product(a: DataFrame, b: DataFrame, sizes: DataFrame) -> DataFrame:
    """(key, side, check_idx, qubit) of the product of two classical incidence tables (key, row, col).
    sizes: (key, ra, ca, rb, cb), rows and columns of each. Qubits: ca * cb, then ra * rb."""
    s = sizes.withColumn("off", F.col("ca") * F.col("cb"))
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("u")
    # dealt by the rows that will be made of them, which the sizes of what is joined do not show
    made = lambda df, x, y: df.join(s.hint("merge"), "key").agg(F.sum(F.col(x) + F.col(y))).first()[0] or 0
    tasks = max(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(made(a, "cb", "rb") + made(b, "ra", "ca")) // PRODUCT_ROWS))
    ea, eb = (df.repartition(tasks, "key").join(s.hint("merge"), "key") for df in (a, b))
    put = lambda df, side, row, q: df.select("key", F.lit(side).alias("side"), row.cast("long").alias("check_idx"), q.cast("long").alias("qubit"))
    r, c, u = F.col("row"), F.col("col"), F.col("u")
    parts = [
        put(ea.select("*", span("cb")), "X", r * F.col("cb") + u, c * F.col("cb") + u),
        put(eb.select("*", span("ra")), "X", u * F.col("cb") + c, F.col("off") + u * F.col("rb") + r),
        put(eb.select("*", span("ca")), "Z", u * F.col("rb") + r, u * F.col("cb") + c),
        put(ea.select("*", span("rb")), "Z", c * F.col("rb") + u, F.col("off") + r * F.col("rb") + u),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return xor_normalise(out, ["key", "side", "check_idx"], "qubit")


def product_of_group_codes(mul: DataFrame, left: DataFrame, right: DataFrame, sizes: DataFrame) -> DataFrame:
    """Hypergraph product of the X side of each group's two-block code with itself."""
    rows = group_code(mul, left, right, sizes).filter("side = 'X'").select(F.col("grp").alias("key"), F.col("check_idx").alias("row"), F.col("qubit").alias("col"))
    rows = written(rows, "group-code")
    dims = sizes.select(F.col("grp").alias("key"), F.col("size").alias("ra"), (2 * F.col("size")).alias("ca"), F.col("size").alias("rb"), (2 * F.col("size")).alias("cb"))
    return hypergraph_product(rows, rows, dims)


def planar_code(specs: DataFrame) -> DataFrame:
    """(spec, side, check_idx, qubit) on an open lx x ly grid. specs: (spec, lx, ly, xa, xb, za, zb) with arrays of
    struct(x, y) offsets for both qubit blocks of both kinds of row.

    An X row may lose members beyond the first and last grid rows only, a Z row beyond the first and last columns
    only; other truncated rows are dropped, and so are X rows that overlap a Z row oddly."""
    lo = F.array_min(F.transform(F.concat("xa", "xb", "za", "zb"), lambda t: F.least(t["x"], t["y"])))
    hi = F.array_max(F.transform(F.concat("xa", "xb", "za", "zb"), lambda t: F.greatest(t["x"], t["y"])))
    anchors = specs.select("*", F.explode(F.sequence(-hi, F.col("lx") - 1 - lo)).alias("i")).select("*", F.explode(F.sequence(-hi, F.col("ly") - 1 - lo)).alias("j"))
    member = lambda c, b: F.transform(c, lambda t: F.struct(t["x"].alias("x"), t["y"].alias("y"), F.lit(b).alias("b")))
    out = None
    for side, first, second in (("X", "xa", "xb"), ("Z", "za", "zb")):
        rows = anchors.select("spec", "lx", "ly", "i", "j", F.lit(side).alias("side"), F.explode(F.concat(member(first, 0), member(second, 1))).alias("t"))
        rows = rows.select("spec", "lx", "ly", "i", "j", "side", (F.col("i") + F.col("t.x")).alias("p"), (F.col("j") + F.col("t.y")).alias("q"), F.col("t.b").alias("b"))
        inside = F.col("p").between(0, F.col("lx") - 1) & F.col("q").between(0, F.col("ly") - 1)
        # a member may hang off only the edges of the side's own axis
        hangs = F.col("q").between(0, F.col("ly") - 1) if side == "X" else F.col("p").between(0, F.col("lx") - 1)
        bad = rows.filter(~inside & ~hangs).select("spec", "i", "j").distinct()
        kept = rows.filter(inside).join(bad.hint("merge"), ["spec", "i", "j"], "left_anti")
        kept = kept.select("spec", "side", "i", "j", (F.col("b") * F.col("lx") * F.col("ly") + F.col("p") * F.col("ly") + F.col("q")).cast("long").alias("qubit"))
        out = kept if out is None else out.unionByName(kept)
    rows = xor_normalise(out, ["spec", "side", "i", "j"], "qubit")
    x, z = rows.filter("side = 'X'"), rows.filter("side = 'Z'")
    odd = x.join(z.select("spec", F.col("i").alias("zi"), F.col("j").alias("zj"), "qubit").hint("merge"), ["spec", "qubit"]).groupBy("spec", "i", "j", "zi", "zj").agg(F.count("*").alias("c")).filter("c % 2 = 1")
    good = x.join(odd.select("spec", "i", "j").distinct().hint("merge"), ["spec", "i", "j"], "left_anti").unionByName(z)
    index = F.dense_rank().over(W.partitionBy("spec", "side").orderBy("i", "j")) - 1
    return good.select("spec", "side", index.cast("long").alias("check_idx"), "qubit")


def sample_specs(spark: SparkSession, seed: int, count: int, limits: dict[str, int], picks: int) -> DataFrame:
    """(spec, parameters..., terms): seeded draws by hash; each parameter in [2, limit], `picks` distinct terms of the
    product of the first two parameters. The same seed gives the same rows on any cluster."""
    draw = lambda j, n: F.pmod(F.xxhash64(F.lit(seed), F.col("spec"), F.lit(j)), n)
    out = spark.range(count).withColumnRenamed("id", "spec")
    for j, (name, limit) in enumerate(limits.items()):
        out = out.withColumn(name, (2 + draw(j, F.lit(limit - 1))).cast("long"))
    names = list(limits)
    cells = F.col(names[0]) * F.col(names[1])
    # a spec's terms stay in its row, in the order of their hashes
    ranked = F.array_sort(F.transform(F.sequence(F.lit(0).cast("long"), cells - 1), lambda x: F.struct(F.xxhash64(F.lit(seed), F.col("spec"), x, F.lit("t")).alias("rank"), x.alias("term"))))
    chosen = F.array_sort(F.transform(F.slice(ranked, 1, picks), lambda x: x["term"]))
    return out.withColumn("terms", chosen).filter(F.size("terms") > 0)


__all__ = ["coset_code", "cyclic_tables", "group_code", "hypergraph_product", "metacyclic_tables", "planar_code", "product_of_group_codes", "sample_specs", "table_product", "torus_code"]
