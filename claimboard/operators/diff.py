"""Snapshot diffs, permissions and the price of checking a change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Protected paths, and the coefficients that turn a size into a search budget.
PROTECTED_PREFIXES = [".github/workflows/", "schema/", "verify/"]
PROTECTED_FILES = ["site/build.py", "pyproject.toml", "uv.lock", "run_tests.py"]
TRIAL_COST_BASE, TRIAL_COST_PER_N = 0.0005, 2.5e-6
DEEP = {"base": 25_000, "per_n": 120, "least": 120.0, "most": 240.0, "factor": 3}
PLAIN = {"base": 2_500, "per_n": 40, "least": 10.0, "most": 90.0, "factor": 4}


def parse_changes(lines: DataFrame, line: str = "line") -> DataFrame:
    """(path, status) of name-status lines; a rename is a deletion and an addition."""
    parts = F.split(line, "\t")
    status, first, second = F.substring(F.get(parts, F.lit(0)), 1, 1), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    pair = lambda p, s: F.struct(p.alias("path"), s.alias("status"))
    moved = F.array(pair(first, F.lit("D")), pair(second, F.lit("A")))
    rows = lines.filter(F.size(parts) >= 2).select(F.explode(F.when((status == "R") & second.isNotNull(), moved).otherwise(F.array(pair(first, status)))).alias("c"))
    return rows.select("c.*").filter(F.col("path").endswith(".json"))


def affected(paths: DataFrame, path: str = "path", seq: str = "seq") -> DataFrame:
    """(entity, seq): files to check, a sidecar change standing for its owner, in order of first mention."""
    owner = F.regexp_extract(path, "^circuits/([^/]+)/", 1)
    entity = F.when(owner != "", F.concat(F.lit("codes/"), owner, F.lit(".json"))).otherwise(F.col(path))
    return paths.select(entity.alias("entity"), seq).filter(F.col("entity").endswith(".json")).groupBy("entity").agg(F.min(seq).alias(seq))


def snapshot_pair(base: DataFrame, head: DataFrame, path: str = "path") -> DataFrame:
    """(path, base, head): both contents of each path as structs, null where it is absent."""
    b = base.select(F.col(path), F.struct(*[c for c in base.columns if c != path]).alias("base"))
    h = head.select(F.col(path), F.struct(*[c for c in head.columns if c != path]).alias("head"))
    return b.join(h, path, "full_outer")


def base_counterpart(changed: DataFrame, changes: DataFrame) -> DataFrame:
    """(path, counterpart): itself if modified, else the only deleted path with the same n-k- beginning, else null.
    changed: (path, prefix)."""
    modified = changes.filter("status = 'M'").select("path", F.lit(True).alias("own"))
    gone = changes.filter("status = 'D'").select(F.regexp_extract("path", "^(.*/[0-9]+-[0-9]+-)", 1).alias("prefix"), F.col("path").alias("old")).filter("prefix <> ''")
    only = gone.groupBy("prefix").agg(F.count("*").alias("c"), F.min("old").alias("old")).filter("c = 1").drop("c")
    out = changed.join(modified, "path", "left").join(only, "prefix", "left")
    return out.select("path", F.when(F.col("own"), F.col("path")).otherwise(F.col("old")).alias("counterpart"))


def raised(before: Column, after: Column) -> Column:
    """A stamp was added or raised."""
    return after.isNotNull() & (before.isNull() | (after > before))


def classify(pairs: DataFrame, frozen: list[str], sides: tuple[str, str] = ("x", "z")) -> DataFrame:
    """(path, cls, reason) of snapshot pairs whose structs have the frozen fields, d, layout, and per side a value,
    a witness weight, a confidence and a stamp (x_value, x_weight, x_confidence, x_stamp, ...)."""
    b, h = (lambda c: F.col(f"base.{c}")), (lambda c: F.col(f"head.{c}"))
    stamp = F.lit(False)
    for s in sides:
        stamp = stamp | F.coalesce(raised(b(f"{s}_stamp"), h(f"{s}_stamp")), F.lit(False))
    fields = [f"{s}_{c}" for s in sides for c in ("value", "weight", "confidence")]
    same_distance = b("d").eqNullSafe(h("d"))
    for c in fields:
        same_distance = same_distance & b(c).eqNullSafe(h(c))
    same_layout = b("layout").eqNullSafe(h("layout"))
    rules: list[tuple[Column, str, Column]] = [
        (F.col("head").isNull(), "gone", F.lit("no head")), (F.col("base").isNull(), "new", F.lit("no base counterpart")), (stamp, "stamp", F.lit("survival stamp raised")),
    ]
    rules += [(~b(c).eqNullSafe(h(c)), "full", F.lit(f"{c} changed")) for c in frozen]
    rules += [(same_distance & ~same_layout, "layout-only", F.lit("layout changed")), (same_distance, "layout-only", F.lit("metadata only")), (~same_layout, "full", F.lit("distance and layout changed"))]
    lower = F.lit(0)
    for s in sides:
        kept = F.lit(True)
        for c in ("value", "weight", "confidence"):
            kept = kept & b(f"{s}_{c}").eqNullSafe(h(f"{s}_{c}"))
        rules += [
            (b(f"{s}_value").isNull() | h(f"{s}_value").isNull(), "full", F.lit(f"{s} missing")),
            (~kept & ~(h(f"{s}_value") < b(f"{s}_value")), "full", F.lit(f"{s} did not decrease")),
            (~kept & ~h(f"{s}_weight").eqNullSafe(h(f"{s}_value")), "full", F.lit(f"{s} witness weight")),
            (~kept & ~h(f"{s}_confidence").eqNullSafe(F.lit("upper_bound")), "full", F.lit(f"{s} confidence")),
        ]
        lower = lower + F.when(kept, 0).otherwise(1)
    rules += [(lower == 0, "full", F.lit("no side decreased")), (~h("d").eqNullSafe(F.least(*(h(f"{s}_value") for s in sides))), "full", F.lit("d is not the least side"))]
    cls, reason = F.lit("tightening"), F.concat(lower.cast("string"), F.lit(" side(s) decreased"))
    for when, name, why in reversed(rules):
        cls, reason = F.when(when, F.lit(name)).otherwise(cls), F.when(when, why).otherwise(reason)
    return pairs.select("path", cls.alias("cls"), reason.alias("reason"))


def entered_tighter(rank_before: Column, rank_after: Column) -> Column:
    """The row moved into a tighter class than it had; a row that was not there had the loosest."""
    return rank_after < F.coalesce(rank_before, F.lit(2))


def refutation_bound(same_else: Column, notes_before: Column, notes_after: Column, sides: list[dict[str, Column]], d: Column, author: Column) -> Column:
    """Empty if a change only lowers a claim and says who found it, else the first reason against it.

    sides: per side `before`, `after`, `found_by` (array of handles), `stamp_only`."""
    changed = [~s["before"].eqNullSafe(s["after"]) for s in sides]
    rules = [(~same_else, "other fields changed"), (~notes_after.startswith(notes_before), "notes not append-only")]
    for s, c in zip(sides, changed):
        rules += [(c & ~F.coalesce(F.array_contains(s["found_by"], author), F.lit(False)), "finder not credited"), (c & ~((s["after"] < s["before"]) | s["stamp_only"]), "not strictly lower")]
    touched = changed[0]
    for c in changed[1:]:
        touched = touched | c
    rules += [(~touched & ~sides[0]["stamp_only"], "nothing lowered"), (d != F.least(*(s["after"] for s in sides)), "d is not the least side")]
    out = F.lit("")
    for when, why in reversed(rules):
        out = F.when(when, F.lit(why)).otherwise(out)
    return out


def layout_bound(layout_before: Column, layout_after: Column, same_else: Column, contributors: Column, author: Column) -> Column:
    """Empty if a change only adds the first layout and lists its author, else the reason against it."""
    return (
        F.when(layout_before.isNotNull(), F.lit("already has a layout")).when(layout_after.isNull(), F.lit("adds no layout")).when(~same_else, F.lit("other fields changed"))
        .when(~F.coalesce(F.array_contains(contributors, author), F.lit(False)), F.lit("contributor not listed")).otherwise(F.lit(""))
    )


def authorship(author: Column, exempt: list[str], authors_before: Column, authors_after: Column, refutation: Column, layout: Column) -> Column:
    """Why an author may make a change, or `violation`."""
    who = F.lower(author)
    listed = F.array_contains(F.coalesce(authors_before, authors_after), who)
    return (
        F.when(who.isin(*exempt), F.lit("exempt")).when(F.coalesce(listed, F.lit(False)), F.lit("author"))
        .when(authors_before.eqNullSafe(authors_after) & (refutation == ""), F.lit("refutation")).when(authors_before.eqNullSafe(authors_after) & (layout == ""), F.lit("layout")).otherwise(F.lit("violation"))
    )


def change_scope(changes: DataFrame, group: list[str]) -> DataFrame:
    """(group..., n_new, n_protected, n_data, ok): at most one new entity, and no data next to protected paths."""
    path, data = F.col("path"), F.col("path").startswith("codes/") & F.col("path").endswith(".json")
    guarded = path.isin(*PROTECTED_FILES)
    for p in PROTECTED_PREFIXES:
        guarded = guarded | path.startswith(p)
    out = changes.groupBy(*group).agg(F.count_if(data & (F.col("status") == "A")).alias("n_new"), F.count_if(guarded).alias("n_protected"), F.count_if(data).alias("n_data"))
    return out.withColumn("ok", (F.col("n_new") <= 1) & ((F.col("n_protected") == 0) | (F.col("n_data") == 0)))


def sidecar_search(before: Column, after: Column, is_new: Column, files_changed: Column) -> Column:
    """A sidecar's claim needs a search: it is new, its block changed or its files did."""
    return after.isNotNull() & (is_new | ~before.eqNullSafe(after) | files_changed)


def manifest_drift(pinned: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, drift): missing, changed or stale files of two (path, sha) tables."""
    a, b = pinned.select("path", F.col("sha").alias("was")), actual.select("path", F.col("sha").alias("now"))
    both = a.join(b, "path", "full_outer")
    drift = F.when(F.col("now").isNull(), F.lit("missing")).when(F.col("was").isNull(), F.lit("stale")).when(F.col("was") != F.col("now"), F.lit("changed"))
    return both.select("path", drift.alias("drift")).filter("drift IS NOT NULL")


def budget(n: Column, deep: Column, fast: Column) -> list[Column]:
    """Trials, seconds and seeds of a search over n elements."""
    cost = TRIAL_COST_BASE + TRIAL_COST_PER_N * n

    def at(p):
        trials = p["base"] + p["per_n"] * n
        return trials, F.least(F.lit(p["most"]), F.greatest(F.lit(p["least"]), trials * cost * p["factor"]))

    (dt, ds), (pt, ps) = at(DEEP), at(PLAIN)
    return [F.when(deep, dt).otherwise(pt).cast("long").alias("trials"), F.when(deep, ds).otherwise(ps).alias("seconds"), F.when(deep & ~fast, 3).otherwise(1).alias("seeds")]


def route(cls: Column, record: Column, tighter: Column) -> list[Column]:
    """The class after escalation, and whether its search is deep; null where none is made."""
    final = F.when((cls == "layout-only") & record & tighter, F.lit("layout-record")).otherwise(cls)
    deep = F.when(final.isin("stamp", "layout-record"), True).when(final == "tightening", False).when(final == "layout-only", F.lit(None)).otherwise(record)
    return [final.alias("routed"), deep.cast("boolean").alias("deep")]
