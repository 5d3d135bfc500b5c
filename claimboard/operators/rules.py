"""Data-quality rules; each gives rows of (key, stage, check, ok, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .geometry import group_diameter

#: Vocabularies and limits of a submission.
FAMILIES = [
    "bivariate-bicycle", "generalized-bicycle", "2bga-coset", "hypergraph-product", "lifted-product", "balanced-product",
    "quantum-tanner", "tile", "topological", "other",
]
NOVELTIES = ["unknown", "known_parameters", "new_parameters"]
MAX_N, MAX_ROWS, MAX_SUPPORT, MAX_WEIGHT, MAX_CELLS, MAX_COORDINATES = 700, 10_000, 200_000, 32, 50_000_000, 700


def rule(df: DataFrame, name: str, ok: Column, detail: Column, stage: int = 0, key: str = "key") -> DataFrame:
    """Rows of one rule; a null verdict fails."""
    passed = F.coalesce(ok, F.lit(False))
    return df.select(F.col(key), F.lit(stage).alias("stage"), F.lit(name).alias("check"), passed.alias("ok"), F.when(passed, F.lit("")).otherwise(F.coalesce(detail.cast("string"), F.lit(""))).alias("detail"))


def missing_fields(required: list[str]) -> Column:
    """Messages for required fields that are null."""
    return F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in required)))


def _version(text: Column) -> Column:
    """Numbers between a version's dots, which compare in order; a part that is no number counts as null, the least."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "[.]"), lambda p: p.try_cast("int"))


def gated(block: Column, version: Column, least: str) -> Column:
    """A message when a block occurs in a document older than the version that introduced it."""
    return F.when(block.isNotNull() & (_version(version) < _version(F.lit(least))), F.lit(f"block needs version {least}"))


def document_shape(docs: DataFrame, required: list[str], nested: dict[str, list[str]], gates: dict[str, str], version: str = "schema_version", key: str = "key") -> DataFrame:
    """Rule rows: all required fields are there, and so are the members that each nested block must have where the
    block itself is there, and no block is newer than the document's version. A null field counts as absent."""
    inside = [F.when(F.col(b).isNotNull() & F.col(f"{b}.{m}").isNull(), F.lit(f"missing {b}.{m}")) for b, members in nested.items() for m in members]
    newer = [F.when(gated(F.col(b), F.col(version), least).isNotNull(), F.lit(f"{b} needs version {least}")) for b, least in gates.items()]
    messages = F.concat(missing_fields(required), F.array_compact(F.array(*inside, *newer, F.lit(None).cast("string"))))
    return rule(docs, "structure", F.size(messages) == 0, F.array_join(messages, "; "), 0, key)


def over_caps(n: Column, x: Column, z: Column, coordinates: Column) -> Column:
    """Messages for every resource limit that a document exceeds."""
    rows, support = F.size(x) + F.size(z), lambda s: F.aggregate(s, F.lit(0), lambda a, r: a + F.size(r))
    widest = F.greatest(*(F.coalesce(F.array_max(F.transform(s, F.size)), F.lit(0)) for s in (x, z)))
    limits = [
        ("n", n, MAX_N), ("rows", F.greatest(F.size(x), F.size(z)), MAX_ROWS), ("support", support(x) + support(z), MAX_SUPPORT),
        ("weight", widest, MAX_WEIGHT), ("rows times n", rows.cast("long") * n, MAX_CELLS), ("row pairs", F.size(x).cast("long") * F.size(z), MAX_CELLS),
        ("coordinates", F.coalesce(F.size(coordinates), F.lit(0)), MAX_COORDINATES),
    ]
    return F.array_compact(F.array(*(F.when(value > limit, F.lit(f"too large: {name}")) for name, value, limit in limits)))


def index_range(rows: DataFrame, sizes: DataFrame, element: str, key: str = "key") -> DataFrame:
    """Every element lies in [0, n); a key without elements fails."""
    seen = rows.groupBy(key).agg(F.min(element).alias("lo"), F.max(element).alias("hi"))
    df = sizes.join(seen, key, "left")
    return rule(df, "index_range", (F.col("lo") >= 0) & (F.col("hi") < F.col("n")), F.concat_ws("..", F.col("lo").cast("string"), F.col("hi").cast("string")), 1, key)


def repeated_members(rows: DataFrame, key: str, row: str, element: str, shown: int = 5) -> DataFrame:
    """No row names an element twice; the first offenders are listed."""
    times = rows.groupBy(key, row, element).agg(F.count("*").alias("c"))
    bad = times.groupBy(key).agg(F.slice(F.sort_array(F.collect_set(F.when(F.col("c") > 1, F.col(row)))), 1, shown).alias("bad"))
    return rule(bad, "no_repeats", F.size("bad") == 0, F.array_join(F.col("bad").cast("array<string>"), ","), 2, key)


def claimed_dimension(claims: DataFrame, computed: DataFrame, key: str = "key") -> DataFrame:
    """The claimed k is the computed one and at least 1; both tables: (key, k). A key without a computed k fails."""
    both = claims.select(key, "k").join(computed.select(key, F.col("k").alias("_found")).hint("merge"), key, "left")
    detail = F.concat(F.lit("claimed "), F.coalesce(F.col("k").cast("string"), F.lit("none")), F.lit(", computed "), F.coalesce(F.col("_found").cast("string"), F.lit("none")))
    return rule(both, "logical_dimension", (F.col("k") == F.col("_found")) & (F.col("_found") >= 1), detail, 3, key)


def layout_claims(layouts: DataFrame, points: DataFrame, checks: DataFrame, key: str = "key") -> DataFrame:
    """A layout has one coordinate for each of n elements; if it has, and claims a radius, no two elements of a check
    are farther apart than that. layouts: (key, n, radius), a row for each document with a layout; points: (key,
    qubit, x, y); checks: (key, side, check_idx, qubit). Without checks the radius is 0."""
    given = points.groupBy(key).agg(F.count("*").alias("_given"))
    sized = layouts.join(given, key, "left").withColumn("_given", F.coalesce("_given", F.lit(0)))
    cover = rule(sized, "coordinates_cover", F.col("_given") == F.col("n"), F.concat(F.col("_given").cast("string"), F.lit(" coordinates")), 4, key)
    placed = checks.select(key, "side", "check_idx", "qubit").join(points, [key, "qubit"])
    reach = group_diameter(placed, [key, "side", "check_idx"], "qubit").groupBy(key).agg(F.max("diameter").alias("_reach"))
    claimed = sized.filter("_given = n AND radius IS NOT NULL").join(reach, key, "left").withColumn("_reach", F.coalesce("_reach", F.lit(0.0)))
    within = rule(claimed, "radius_within_claim", F.col("_reach") <= F.col("radius") + 1e-9, F.concat(F.lit("measured "), F.col("_reach").cast("string")), 4, key)
    return cover.unionByName(within)


def vocabulary(value: Column, known: list[str], open_tag: bool) -> Column:
    """A known word, or a well-formed new tag where the vocabulary is open."""
    listed = value.isin(known)
    return listed | value.rlike("^[a-z0-9]+(-[a-z0-9]+)*$") if open_tag else listed


def model_versioned(model: Column) -> Column:
    """Every comma part of a named model has a digit; no model or `human` is exempt."""
    name = F.trim(F.coalesce(model, F.lit("")))
    return (F.lower(name).isin("", "human")) | F.forall(F.split(name, ","), lambda p: p.rlike("[0-9]"))


def max_weight(rows: DataFrame, key: str, row: str, limit: int = MAX_WEIGHT) -> DataFrame:
    """Rows name at most `limit` elements, repeats counted."""
    sizes = rows.groupBy(key, row).agg(F.count("*").alias("c")).groupBy(key).agg(F.max("c").alias("w"))
    return rule(sizes, "max_weight", F.col("w") <= limit, F.col("w"), 2, key)


def global_claim(claims: DataFrame, key: str = "key") -> DataFrame:
    """(key, d): the least of the two earned sides, null unless both are earned. claims: (key, side, value, earned)."""
    side = lambda s: F.min(F.when((F.col("side") == s) & F.col("earned"), F.col("value")))
    both = claims.groupBy(key).agg(side("X").alias("x"), side("Z").alias("z"))
    return both.select(key, F.when(F.col("x").isNotNull() & F.col("z").isNotNull(), F.least("x", "z")).alias("d"))


def earned_confidence(confidence: Column) -> Column:
    """A claim of exactness is recorded but earns an upper bound only."""
    return F.when(confidence == "exact", F.lit("upper_bound")).otherwise(confidence)


def report(checks: DataFrame, key: str = "key", shown: int = 4) -> DataFrame:
    """(key, ok, failed, messages): all rules passed, the failed ones, the first messages by rule name."""
    bad = F.sort_array(F.collect_list(F.when(~F.col("ok"), F.struct("check", "detail"))))
    out = checks.groupBy(key).agg(F.bool_and("ok").alias("ok"), bad.alias("bad"))
    return out.select(key, "ok", F.transform("bad", lambda b: b["check"]).alias("failed"), F.slice(F.transform("bad", lambda b: F.concat_ws(": ", b["check"], b["detail"])), 1, shown).alias("messages"))


def short_circuit(checks: DataFrame, key: str = "key") -> DataFrame:
    """Rules up to the first stage with a failure; later ones did not run."""
    first = F.min(F.when(~F.col("ok"), F.col("stage"))).over(W.partitionBy(key))
    return checks.withColumn("_first", first).filter("_first IS NULL OR stage <= _first").drop("_first")


def fail_closed(expected: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Every expected piece of work with its verdict; a missing or null one fails."""
    return expected.join(results, keys, "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
