"""Noise that a circuit asks for and has, compared in packed form."""

from pyspark.sql import functions as F

from claimboard.operators import circuits

ROWS = "file string, layer int, channel string, qubit int"


def test_idle_layers_are_not_shuffled_one_by_one(spark):
    """Layers of a qubit stay one row up to the comparison; rows and packed rows mean the same, nulls and repeats too."""
    targets = [("f", 1, "CX", 1), ("f", 2, "R", 4), ("f", 3, "H", 8), ("f", 3, "M", 4), ("f", None, "M", 1), ("g", 1, "M", None), ("g", 2, "R", 4)]
    targets = spark.createDataFrame(targets, "file string, layer int, name string, qubit int")
    data = spark.createDataFrame([("f", 4), ("f", 8), ("g", None), ("g", 4), (None, 4), ("absent", 4)], "file string, qubit int")
    rows = circuits.expected_noise(targets, data)
    idle = {tuple(r) for r in rows.filter("channel = 'idle'").select("file", "layer", "qubit").collect()}
    assert idle == {("f", 1, 4), ("f", None, 4), ("f", 1, 8), ("f", 2, 8), ("f", None, 8), ("g", 1, None), ("g", 2, None), ("g", 1, 4)}
    packed = circuits.expected_noise(targets, data, packed=True)
    assert sorted(map(str, packed.select("file", F.explode("layers").alias("layer"), "channel", "qubit").collect())) == sorted(map(str, rows.collect()))
    plan = circuits.noise_differences(packed, packed)._jdf.queryExecution().executedPlan().toString()
    assert "explode" not in plan and "FullOuter" not in plan


def test_differences_count_repeats_and_nulls(spark):
    a = [("f", 1, "two", 1), ("f", 2, "two", 1), ("f", 2, "two", 1), ("f", 3, "idle", 2), ("g", 1, "two", 1), ("g", 1, "two", 1), ("h", None, "two", 1), ("i", 1, "two", None), ("k", 5, "two", 1)]
    b = [("f", 1, "two", 1), ("f", 2, "two", 1), ("f", 4, "idle", 2), ("g", 1, "two", 1), ("g", 1, "two", 1), ("h", None, "two", 1), ("i", 1, "two", None), ("j", 7, "two", 1), ("j", 7, "two", 1)]
    out = circuits.noise_differences(spark.createDataFrame(a, ROWS), spark.createDataFrame(b, ROWS))
    got = {r["file"]: (r["n"], tuple(r["first"])) for r in out.collect()}
    assert got == {"f": (3, (2, "two", 1)), "h": (2, (None, "two", 1)), "i": (2, (1, "two", None)), "j": (1, (7, "two", 1)), "k": (1, (5, "two", 1))}
