"""Analytics over ordered operation lines and fault-mechanism columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .parity import independent_modulo, syndrome

# Instruction names by what they do, and the budget of a fault model.
MEASURES = ["M", "MZ", "MX", "MR", "MRX", "MRZ"]
NOISE = ["DEPOLARIZE1", "DEPOLARIZE2", "X_ERROR", "Z_ERROR"]
ALLOWED = [*MEASURES, *NOISE, "R", "RX", "RZ", "H", "CX", "CZ", "CNOT", "TICK", "DETECTOR", "OBSERVABLE_INCLUDE", "QUBIT_COORDS", "SHIFT_COORDS"]
MOST_MECHANISMS = 25_000
#: Rows of witnesses that a task should take.
WITNESS_ROWS = 500_000


def absolute_records(ops: DataFrame, measured: Column, offset: str, file: str = "file", line: str = "line") -> DataFrame:
    """Adds `record`: the number of records measured before a line plus the line's relative offset. Operation files
    are bounded, so one window per file is one task's work."""
    before = F.sum(measured).over(W.partitionBy(file).orderBy(line).rowsBetween(W.unboundedPreceding, -1))
    return ops.withColumn("record", (F.coalesce(before, F.lit(0)) + F.col(offset)).cast("long"))


def layers(ops: DataFrame, separator: Column, file: str = "file", line: str = "line") -> DataFrame:
    """Adds `layer`: separators up to and with a line."""
    return ops.withColumn("layer", F.count_if(separator).over(W.partitionBy(file).orderBy(line).rowsBetween(W.unboundedPreceding, 0)))


def without_noise(ops: DataFrame, name: str = "name", arg: str = "arg") -> DataFrame:
    """Operations without noise channels, measurements without their argument."""
    return ops.filter(~F.col(name).isin(NOISE)).withColumn(arg, F.when(~F.col(name).isin(MEASURES), F.col(arg)))


def not_allowed(ops: DataFrame, file: str = "file", name: str = "name", allowed: list[str] | None = None) -> DataFrame:
    """(file, name, n): instructions outside the allowed ones."""
    return ops.filter(~F.col(name).isin(allowed or ALLOWED)).groupBy(file, name).agg(F.count("*").alias("n"))


def expected_noise(targets: DataFrame, data: DataFrame, packed: bool = False) -> DataFrame:
    """(file, layer, channel, qubit) that the canonical model asks for: a two-qubit channel after two-qubit gates, a
    flip after resets and before measurements, and a one-qubit channel on data that a layer leaves idle.
    targets: (file, layer, name, qubit); data: (file, qubit). A data qubit's busy layers are taken from its file's, so
    only as many rows are shuffled as come in, not one for each idle layer of each qubit. `packed` gives (file, channel,
    qubit, layers), with all idle layers of a qubit in one row."""
    kind = F.when(F.col("name").isin("CX", "CZ", "CNOT"), "two").when(F.col("name").isin("R", "RX", "RZ"), "reset").when(F.col("name").isin(MEASURES), "measure")
    busy = targets.withColumn("channel", kind)
    asked = busy.filter("channel IS NOT NULL").select("file", "layer", "channel", "qubit")
    layer = F.struct("layer")  # keeps a null layer, which no target keeps busy
    slots = targets.groupBy("file").agg(F.collect_set(layer).alias("layers"))
    used = targets.filter("layer IS NOT NULL").groupBy("file", "qubit").agg(F.collect_set(layer).alias("used"))
    free = data.select("file", "qubit").join(used.hint("merge"), ["file", "qubit"], "left").join(slots.hint("merge"), "file")
    left = F.when(F.col("used").isNull(), F.col("layers")).otherwise(F.array_except("layers", "used"))
    if packed:
        idle = free.select("file", F.lit("idle").alias("channel"), "qubit", F.transform(left, lambda s: s["layer"]).alias("layers"))
        return _packed(asked).unionByName(idle.filter("size(layers) > 0"))
    idle = free.select("file", "qubit", F.explode(left).alias("slot"))
    return asked.unionByName(idle.select("file", "slot.layer", F.lit("idle").alias("channel"), "qubit"))


def _packed(rows: DataFrame) -> DataFrame:
    return rows if "layers" in rows.columns else rows.select("file", "channel", "qubit", F.array("layer").alias("layers"))


def noise_differences(expected: DataFrame, present: DataFrame) -> DataFrame:
    """(file, first, n): channels asked for or present but not both, or not as often; the first in (layer, channel,
    qubit) order. Inputs have rows (file, layer, channel, qubit) or, packed, (file, channel, qubit, layers). A null
    matches nothing. A channel's layers on one qubit are compared as lists."""
    keys = ["file", "channel", "qubit"]
    a = _packed(expected).select(*keys, F.col("layers").alias("a"))
    b = _packed(present).select(*keys, F.col("layers").alias("b"))
    every = a.unionByName(b, allowMissingColumns=True).repartition(*keys).groupBy(*keys)
    met = every.agg(*(F.flatten(F.collect_list(c)).alias(c) for c in "ab"))
    full = lambda c: F.filter(c, lambda x: x.isNotNull())
    nulls = sum((F.size(c) > F.size(full(c))).cast("long") for c in "ab")
    met = met.select(*keys, full("a").alias("a"), full("b").alias("b"), nulls.alias("nulls"))
    times = lambda c, x: F.size(F.filter(c, lambda y: y == x))
    repeated = sum(F.size(c) - F.size(F.array_distinct(c)) for c in "ab") > 0
    uneven = F.when(repeated, F.filter(F.array_intersect("a", "b"), lambda x: times("a", x) != times("b", x)))
    odd = F.array_union(F.array_except("a", "b"), F.array_except("b", "a"))
    odd = F.when(uneven.isNull(), odd).otherwise(F.concat(odd, uneven))
    apart = F.concat(F.array_distinct("a"), F.array_distinct("b"))
    unknown = F.col("file").isNull() | F.col("channel").isNull() | F.col("qubit").isNull()
    found = met.select(*keys, "nulls", F.when(unknown, apart).otherwise(odd).alias("odd"))
    found = found.withColumn("n", F.size("odd") + F.col("nulls")).filter("n > 0")
    first = F.struct(F.when(F.col("nulls") == 0, F.array_min("odd")).alias("layer"), "channel", "qubit")
    return found.groupBy("file").agg(F.min(first).alias("first"), F.sum("n").alias("n"))


def readout_covers(ops: DataFrame, data: DataFrame) -> DataFrame:
    """(file, ok): after the last measurement of other qubits, every data qubit is measured once.
    ops: (file, line, qubit) measurements; data: (file, qubit)."""
    others = ops.join(data, ["file", "qubit"], "left_anti").groupBy("file").agg(F.max("line").alias("last"))
    final = ops.join(data, ["file", "qubit"], "left_semi").join(others, "file", "left").filter(F.col("last").isNull() | (F.col("line") > F.col("last")))
    times = final.groupBy("file", "qubit").agg(F.count("*").alias("c"))
    joined = data.join(times, ["file", "qubit"], "left")
    return joined.groupBy("file").agg(F.bool_and(F.coalesce(F.col("c") == 1, F.lit(False))).alias("ok"))


def rounds(measurements: DataFrame, file: str = "file", qubit: str = "qubit") -> DataFrame:
    """(file, rounds): most measurements of one qubit."""
    return measurements.groupBy(file, qubit).agg(F.count("*").alias("c")).groupBy(file).agg(F.max("c").alias("rounds"))


def observables_complete(observables: DataFrame, sizes: DataFrame) -> DataFrame:
    """(file, ok): observable numbers are exactly 0..k-1 and none names a record twice. observables: (file, obs,
    record); sizes: (file, k)."""
    seen = observables.groupBy("file").agg(F.sort_array(F.collect_set("obs")).alias("ids"), (F.count("*") == F.count_distinct("obs", "record")).alias("apart"))
    wanted = F.when(F.col("k") > 0, F.sequence(F.lit(0), F.col("k").cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return sizes.join(seen.hint("merge"), "file", "left").select("file", F.coalesce((F.col("ids").cast("array<int>") == wanted) & F.col("apart"), F.lit(False)).alias("ok"))


def observables_hold(observables: DataFrame, finals: DataFrame, opposite: DataFrame, own: DataFrame, sizes: DataFrame) -> DataFrame:
    """(file, ok): the numbers are complete, every record is a final one, no check of the opposite side overlaps an
    observable oddly, and the observables are independent modulo their own side's checks (so none is trivial).
    observables: (file, obs, record); finals: (file, record, qubit); opposite, own: (file, check_idx, qubit); sizes: (file, k)."""
    support = observables.join(finals.hint("merge"), ["file", "record"], "left")
    stray = support.groupBy("file").agg(F.bool_or(F.col("qubit").isNull()).alias("stray"))
    vectors = support.filter("qubit IS NOT NULL").select("file", "obs", "qubit").distinct()
    odd = syndrome(vectors, opposite, ["file", "qubit"], ["file", "obs", "check_idx"]).select("file").distinct().withColumn("odd", F.lit(True))
    apart = independent_modulo(vectors, own.withColumnRenamed("check_idx", "obs"), ["file"], "obs", "qubit")
    out = observables_complete(observables, sizes).join(stray.hint("merge"), "file", "left").join(odd.hint("merge"), "file", "left").join(apart.hint("merge"), "file", "left")
    holds = F.col("ok") & ~F.coalesce("stray", F.lit(False)) & F.col("odd").isNull() & F.coalesce("independent", F.lit(False))
    return out.select("file", holds.alias("ok"))


def multiset_difference(declared: DataFrame, found: DataFrame, group: list[str]) -> DataFrame:
    """(group..., missing, unexpected): supports (sorted arrays in `support`) declared and not found, and the reverse,
    with multiplicity."""
    keys = [*group, "support"]
    a = declared.groupBy(*keys).agg(F.count("*").alias("a"))
    b = found.groupBy(*keys).agg(F.count("*").alias("b"))
    both = a.join(b, keys, "full_outer").select(*keys, (F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))).alias("d"))
    return both.groupBy(*group).agg(F.sum(F.greatest("d", F.lit(0))).alias("missing"), F.sum(F.greatest(-F.col("d"), F.lit(0))).alias("unexpected"))


def model_match(a: DataFrame, b: DataFrame, file: str = "file", position: str = "idx", relative: float = 1e-9, absolute: float = 1e-12) -> DataFrame:
    """(file, ok, n_different): same length, order and targets, and probabilities within the tolerances."""
    x = a.select(file, position, F.col("targets").alias("ta"), F.col("p").alias("pa"))
    y = b.select(file, position, F.col("targets").alias("tb"), F.col("p").alias("pb"))
    same = F.col("ta").eqNullSafe(F.col("tb")) & (F.abs(F.col("pa") - F.col("pb")) <= absolute + relative * F.greatest(F.abs("pa"), F.abs("pb")))
    both = x.join(y, [file, position], "full_outer").withColumn("same", F.coalesce(same, F.lit(False)))
    return both.groupBy(file).agg(F.bool_and("same").alias("ok"), F.count_if(~F.col("same")).alias("n_different"))


def fault_witness(witness: DataFrame, mechanisms: DataFrame, targets: DataFrame, claims: DataFrame) -> DataFrame:
    """(file, ok): the witness is strictly increasing, in range and of the claimed size, its detectors cancel and its
    observables do not. witness: (file, pos, idx); mechanisms: (file, idx); targets: (file, idx, kind D or L, target);
    claims: (file, value)."""
    # everything is dealt once, by file; no task has more than about WITNESS_ROWS rows of the witness, but whole files
    tasks = max(int(witness.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-witness.count() // WITNESS_ROWS))
    null = lambda kind: F.lit(None).cast(kind)
    kinds = dict(witness.dtypes) | dict(targets.dtypes)
    rows = witness.select("file", "idx", "pos", F.lit(1).alias("w"), F.lit(False).alias("known"), null("string").alias("kind"), null(kinds["target"]).alias("target"))
    rows = rows.unionByName(mechanisms.select("file", "idx", null(kinds["pos"]).alias("pos"), F.lit(0).alias("w"), F.lit(True).alias("known"), null("string").alias("kind"), null(kinds["target"]).alias("target")))
    rows = rows.unionByName(targets.select("file", "idx", null(kinds["pos"]).alias("pos"), F.lit(0).alias("w"), F.lit(False).alias("known"), "kind", "target"))
    dealt = rows.filter("file IS NOT NULL AND idx IS NOT NULL OR w = 1").repartition(tasks, "file")
    same = W.partitionBy("file", "idx")
    before = W.partitionBy("file").orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    seen = dealt.select("*", F.sum("w").over(same).alias("times"), F.bool_or("known").over(same).alias("there"), F.last("pos", ignorenulls=True).over(before).alias("last"))
    # a witness is strictly increasing if it names no mechanism twice and its places rise with the mechanisms
    shape = F.col("w") == 1
    fine = F.coalesce(F.col("pos") > F.col("last"), F.lit(True)) & (F.col("times") == 1) & F.col("there") & F.col("idx").isNotNull()
    kept = seen.filter(shape | (F.col("kind").isNotNull() & (F.col("times") % 2 == 1) & F.col("idx").isNotNull()))
    kept = kept.select("file", "w", F.when(shape, "").otherwise(F.col("kind")).alias("kind"), "target", fine.alias("fine"))
    odd = kept.groupBy("file", "kind", "target").agg(F.count("*").alias("size"), F.bool_and("fine").alias("fine"), (F.count("*") % 2 == 1).alias("odd"))
    shape = F.col("kind") == ""
    of = odd.groupBy("file").agg(
        F.sum(F.when(shape, F.col("size"))).alias("size"), F.bool_and(F.when(shape, F.col("fine"))).alias("fine"),
        F.count_if((F.col("kind") == "D") & F.col("odd")).alias("dets"), F.count_if((F.col("kind") == "L") & F.col("odd")).alias("obs"),
    )
    ok = (F.col("size") == F.col("value")) & F.col("fine") & (F.col("dets") == 0) & (F.col("obs") > 0)
    return claims.join(of.hint("merge"), "file", "left").select("file", F.coalesce(ok, F.lit(False)).alias("ok"))


def within_budget(mechanisms: DataFrame, file: str = "file", most: int = MOST_MECHANISMS) -> DataFrame:
    """(file, n, ok): mechanisms per file against the budget."""
    return mechanisms.groupBy(file).agg(F.count("*").alias("n")).withColumn("ok", F.col("n") <= most)


def earned(bases: DataFrame, sizes: DataFrame) -> DataFrame:
    """(file, earned): the least value of both bases if all rules hold in each, no value exceeds d, there are at least
    d rounds and the tool's version is named; else null. bases: (file, basis, ok, value, rounds); sizes: (file, d, version)."""
    fine = F.col("ok") & (F.col("value") <= F.col("d")) & (F.col("rounds") >= F.col("d")) & F.coalesce(F.col("version") != "", F.lit(False))
    out = bases.join(sizes, "file").groupBy("file").agg(F.bool_and(F.coalesce(fine, F.lit(False))).alias("all"), F.count_distinct("basis").alias("n"), F.min("value").alias("least"))
    return out.select("file", F.when(F.col("all") & (F.col("n") == 2), F.col("least")).alias("earned"))


def ancilla_coordinates(files: DataFrame) -> DataFrame:
    """(file, ok): as many ancilla coordinates as qubits beyond the data; none given is fine. files: (file, qubits, n, coordinates)."""
    return files.select("file", (F.col("coordinates").isNull() | (F.size("coordinates") == F.col("qubits") - F.col("n"))).alias("ok"))
