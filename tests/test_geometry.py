"""Widest pairs of large groups against all pairs, and a circle of a million points."""

import math
import random

import pytest
from pyspark.sql import functions as F

from claimboard.operators import geometry


def widest(pts):
    pairs = [(-math.sqrt((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2), p[0], q[0]) for p in pts for q in pts if p[0] < q[0]]
    return min(pairs) if pairs else None


@pytest.mark.parametrize("few", [5, 64])
def test_widest_pair_of_all_kinds_of_groups(spark, monkeypatch, few):
    monkeypatch.setattr(geometry, "FEW_POINTS", few)
    rng = random.Random(2)
    groups = {
        "cloud": [(i, rng.randint(0, 30) * 1.0, rng.randint(0, 30) * 1.0) for i in range(150)],
        "line": [(i, i * 1.0, 2.0 * i) for i in range(100)],
        "square": [(i, float(i % 12), float(i // 12)) for i in range(144)],
        "place": [(i, 3.0, 4.0) for i in range(90)],
        "one": [(7, 1.0, 1.0)],
        "same id": [(7, 1.0, 1.0), (7, 9.0, 1.0)],
        "spread": [(i % 40, rng.random() * 9, rng.random() * 9) for i in range(120)],
        "twins": [(i, float(i // 2 % 6), float(i // 12)) for i in range(120)],
        None: [(i, rng.random(), rng.random()) for i in range(80)],
    }
    rows = [(g, *p) for g, pts in groups.items() for p in pts]
    df = spark.createDataFrame(rows, "g string, i int, x double, y double").repartition(5)
    got = {r["g"]: (r["a"], r["b"], r["dist"]) for r in geometry.widest_pair(df, ["g"], "i").collect()}
    want = {g: widest(pts) for g, pts in groups.items()}
    assert got.keys() == {g for g, w in want.items() if w}
    for g, (a, b, dist) in got.items():
        assert (a, b) == want[g][1:] and abs(dist + want[g][0]) < 1e-12, g
    far = {r["g"]: r["diameter"] for r in geometry.group_diameter(df, ["g"], "i").collect()}
    assert far.keys() == groups.keys() and far["one"] == far["same id"] == far["place"] == 0 and abs(far["line"] + want["line"][0]) < 1e-12


def test_a_million_points_on_a_circle(spark):
    angle = F.col("id") * (2 * math.pi / 1_000_000)
    df = spark.range(1_000_000).select(F.lit("o").alias("g"), "id", (1000 * F.cos(angle)).alias("x"), (1000 * F.sin(angle)).alias("y"))
    r = geometry.widest_pair(df, ["g"], "id").first()
    assert abs(r["dist"] - 2000) < 1e-6 and abs(abs(r["a"] - r["b"]) - 500_000) <= 1
