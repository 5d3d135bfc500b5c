"""Blocks of the skyline, dominators and the parity product against brute force, with blocks and limits forced small."""

import random

import pytest
from pyspark.sql import functions as F

from claimboard.operators import parity, skyline


def beats(b, a, minimize, maximize):
    le = all(b[c] <= a[c] for c in minimize) and all(b[c] >= a[c] for c in maximize)
    return le and any(b[c] != a[c] for c in [*minimize, *maximize])


@pytest.fixture()
def small_blocks(monkeypatch):
    monkeypatch.setattr(skyline, "CELL_ROWS", 5)
    monkeypatch.setattr(skyline, "BLOCK_ROWS", 7)


ROWS = "key int, g string, n int, k int, d int, w int"


def board(seed, size, top=9):
    rng = random.Random(seed)
    return [(i, rng.choice(["a", "b", None]), *(rng.choice([rng.randint(1, top), None]) if rng.random() < 0.1 else rng.randint(1, top) for _ in range(4))) for i in range(size)]


def as_dicts(rows):
    return [dict(zip(("key", "g", "n", "k", "d", "w"), r)) for r in rows]


def complete(r):
    return None not in (r["n"], r["k"], r["d"], r["w"])


@pytest.mark.parametrize("peers", [None, ["w"]])
def test_skyline_in_many_blocks(spark, small_blocks, peers):
    rows = board(1, 400, 25)
    axes = (["n"], ["k", "d"]) if peers else (["n", "w"], ["k", "d"])
    df = spark.createDataFrame(rows, ROWS).withColumns({c: F.lit(1) for c in ("grp", "block", "cell", "salt", "v0", "lo_v0", "data", "first")}).repartition(5)
    got = {r["key"] for r in skyline.skyline(df, *axes, ["g"], peers).collect()}
    full = [r for r in as_dicts(rows) if complete(r)] if not peers else [r for r in as_dicts(rows) if complete(r)]
    rule = lambda b, a: b["g"] == a["g"] and beats(b, a, *axes) and (not peers or b["w"] <= a["w"])
    assert got == {a["key"] for a in full if not any(rule(b, a) for b in full)}


def test_skyline_keeps_a_large_front(spark, small_blocks):
    """Anti-correlated rows of one group are all on the front; equal rows all stay."""
    rows = [(i, i // 2, i // 2) for i in range(3000)]
    df = spark.createDataFrame(rows, "key int, n int, k int").repartition(4)
    assert skyline.skyline(df, ["n"], ["k"]).count() == 3000
    assert skyline.skyline(df.filter("false"), ["n"], ["k"]).count() == 0
    assert [r["key"] for r in skyline.skyline(df, ["n", "k"], []).orderBy("key").collect()] == [0, 1]


def test_dominators_and_landing(spark, small_blocks):
    rows = as_dicts(board(2, 250, 12))
    df = spark.createDataFrame(board(2, 250, 12), ROWS).fillna({"g": "c"})
    for r in rows:
        r["g"] = r["g"] or "c"
    few = df.filter("key % 5 = 0")
    axes = (["n", "w"], ["k", "d"])
    full = [r for r in rows if complete(r)]
    mine = [r for r in full if r["key"] % 5 == 0]
    got = sorted((r["key"], r["by"], r["dominator"]) for r in skyline.dominators(few, df, *axes).collect())
    assert got == sorted((a["key"], b["key"], f"[[{b['n']},{b['k']},{b['d']}]] {b['key']}") for a in mine for b in full if beats(b, a, *axes))
    got = {r["key"]: (r["g"], r["on_front"], r["n_beats"]) for r in skyline.landing(few, df, ["g"], *axes).collect()}
    same = lambda a: [b for b in full if b["g"] == a["g"]]
    assert got == {a["key"]: (a["g"], not any(beats(b, a, *axes) for b in same(a)), sum(beats(a, b, *axes) for b in same(a))) for a in mine}
    assert skyline.dominators(few.filter("false"), df, *axes).count() == 0 and skyline.landing(few, df.filter("false"), ["g"], *axes).filter("on_front AND n_beats = 0").count() == len(mine)


@pytest.mark.parametrize("heavy_pairs", [10**9, 40, 0])
def test_parity_product_of_light_and_heavy_elements(spark, heavy_pairs):
    rng = random.Random(4)
    make = lambda: [(g, r, e) for g in "xy" for r in range(40) for e in range(80) if rng.random() < (0.6 if e < 3 else 0.05)]
    a, b = make(), make()
    a += a[:5]  # a repeated member cancels
    left, right = spark.createDataFrame(a, "g string, a int, e int"), spark.createDataFrame(b, "g string, b int, e int")
    got = {tuple(r) for r in parity.parity_product(left, right, ["g", "e"], "a", "b", ["g"], heavy_pairs).select("g", "a", "b").collect()}
    want = {(g, x, y) for g in "xy" for x in range(40) for y in range(40) if sum(a.count((g, x, e)) * b.count((g, y, e)) for e in range(80)) % 2}
    assert got == want
    flat = parity.parity_product(left.drop("g"), right.drop("g"), ["e"], "a", "b", None, heavy_pairs)
    assert {tuple(r) for r in flat.collect()} == {(x, y) for x in range(40) for y in range(40) if sum(sum(u[1:] == (x, e) for u in a) * sum(v[1:] == (y, e) for v in b) for e in range(80)) % 2}


def test_an_element_in_all_rows_makes_no_pair_list(spark):
    """Two elements that always come together cancel; the pairs of rows are never listed."""
    one = spark.range(100_000).select(F.col("id").alias("a"), F.explode(F.array(F.lit(1), F.lit(2))).alias("e"))
    two = one.withColumnRenamed("a", "b")
    assert parity.parity_product(one, two, ["e"], "a", "b").count() == 0
