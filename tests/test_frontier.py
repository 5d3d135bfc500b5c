"""Skylines of nested cells from the skylines of classes."""

from claimboard.operators import scoring, skyline
from claimboard.plans import ranking
from claimboard.plans.base import CELL_AXES


def test_only_class_skylines_are_repeated_per_cell(spark, monkeypatch):
    rows = [(i, i * 7 % 11, i * 5 % 13, i * 3 % 7, 1 + i % 3, ("local-2d-single", "local-2d-bilayer", "unrestricted")[i % 3], ("weight-4", "weight-6")[i // 3 % 2]) for i in range(300)]
    e = spark.createDataFrame([*rows, (300, None, 99, 99, 1, "unrestricted", "weight-4")], "key long, n long, k long, d long, w long, loc string, wc string")
    want = skyline.skyline(scoring.nested_cells(e, CELL_AXES), ranking.MIN, ranking.MAX, ["cell_loc", "cell_w"])
    seen, real = [], scoring.nested_cells
    monkeypatch.setattr(scoring, "nested_cells", lambda df, axes: seen.append(df.count()) or real(df, axes))
    got = ranking.front(spark, None, e)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count()
    assert seen and max(seen) < 150
