"""Small fixtures: a known code and single changes to it, brute force, and invariances."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from claimboard.functions import tables
from claimboard.operators import circuits, geometry, graph, normalize, parity, rules, skyline, timeline
from claimboard.sources import files
from claimboard.streaming import incremental

FACES = [[3, 4, 5, 6], [1, 2, 5, 6], [0, 2, 4, 6]]


def steane(**change):
    doc = {
        "schema_version": "0.1", "name": "seven", "code_type": "CSS", "n": 7, "k": 1, "checks": {"X": FACES, "Z": FACES},
        "distance": {"d": 3, "X": {"value": 3, "confidence": "exact", "witness": [1, 3, 5]}, "Z": {"value": 3, "confidence": "exact", "witness": [2, 4, 5]}},
        "provenance": {"authors": ["A, B."], "origin": "baseline", "construction": "c", "date": "1996-01-29", "references": [], "notes": ""},
    }
    return doc | change


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "7-1-3.json").write_text(json.dumps(steane()))
    (tmp_path / "light.json").write_text(json.dumps(steane(distance={"d": 3, "X": {"value": 3, "confidence": "exact", "witness": [1, 3]}, "Z": {"value": 3, "confidence": "exact", "witness": [2, 4, 5]}})))
    (tmp_path / "row.json").write_text(json.dumps(steane(distance={"d": 4, "X": {"value": 4, "confidence": "exact", "witness": FACES[0]}, "Z": {"value": 3, "confidence": "exact", "witness": [2, 4, 5]}})))
    (tmp_path / "broken.json").write_text("{ not json")
    (tmp_path / "Bad_Key.json").write_text(json.dumps(steane()))
    return tmp_path


def test_quarantine_and_witnesses(spark, folder):
    good, bad = files.split_quarantine(files.read_submissions(spark, str(folder)))
    assert {r["key"]: r["problem"] for r in bad.collect()} == {"broken": "malformed document", "Bad_Key": "unsafe key"}
    rows, wit = normalize.incidence(good), normalize.witness_rows(good)
    claims = good.select("key", F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"distance.{s}.value").alias("value")) for s in "XZ"))).alias("c")).select("key", "c.*")
    ok = {(r["key"], r["side"]): r["ok"] for r in parity.validate_witness(wit, rows, claims).collect()}
    assert ok[("7-1-3", "X")] and ok[("7-1-3", "Z")] and ok[("light", "Z")]
    assert not ok[("light", "X")] and not ok[("row", "X")]
    ranks = parity.gf2_rank(rows, ["key", "side"], "check_idx", "qubit")
    assert {r["k"] for r in parity.logical_dimension(ranks, good.select("key", "n"), "key").collect()} == {1}
    odd = parity.parity_product(rows.filter("side = 'X'").withColumnRenamed("check_idx", "a"), rows.filter("side = 'Z'").withColumnRenamed("check_idx", "b").drop("side"), ["key", "qubit"], "a", "b", ["key"])
    assert odd.count() == 0


def test_fingerprint_ignores_row_order_and_sums(spark):
    base = [("a", s, i, q, 7) for s in "XZ" for i, f in enumerate(FACES) for q in f]
    turned = [("b", s, i, q, 7) for s in "XZ" for i, f in enumerate(FACES[::-1]) for q in f]
    mixed = [FACES[0], sorted(set(FACES[0]) ^ set(FACES[1])), FACES[2]]
    summed = [("c", s, i, q, 7) for s in "XZ" for i, f in enumerate(mixed) for q in f]
    other = [("d", s, i, q, 7) for s in "XZ" for i, f in enumerate([[0, 1], [1, 2], [2, 3]]) for q in f]
    df = spark.createDataFrame(base + turned + summed + other, "key string, side string, check_idx int, qubit int, n int")
    fp = {r["key"]: r["fingerprint"] for r in parity.gf2_fingerprint(df, ["key"], "side", "check_idx", "qubit", "n").collect()}
    assert fp["a"] == fp["b"] == fp["c"] != fp["d"]
    kernel = parity.kernel_basis(df.filter("key = 'a' AND side = 'X'"), ["key"], "check_idx", "qubit", "n").collect()
    vectors = {}
    for r in kernel:
        vectors.setdefault(r["basis_idx"], set()).add(r["qubit"])
    assert len(vectors) == 4 and all(len(v & set(f)) % 2 == 0 for v in vectors.values() for f in FACES)


def test_independence(spark):
    rows = spark.createDataFrame([("a", 0, 0), ("a", 0, 1)], "key string, r int, q int")
    new = spark.createDataFrame([("a", 0, 2)], "key string, r int, q int")
    same = spark.createDataFrame([("a", 0, 0), ("a", 0, 1)], "key string, r int, q int")
    assert parity.independent_modulo(new, rows, ["key"], "r", "q").first()["independent"]
    assert not parity.independent_modulo(same, rows, ["key"], "r", "q").first()["independent"]


@pytest.mark.parametrize("partitions", [1, 7])
def test_skyline_equals_brute_force(spark, partitions):
    rng = random.Random(3)
    rows = [(i, rng.choice("ab"), rng.randint(1, 9), rng.randint(1, 9), rng.randint(1, 9)) for i in range(200)]
    df = spark.createDataFrame(rows, "key int, g string, n int, k int, d int").repartition(partitions)

    def beats(b, a):
        return b[1] == a[1] and b[2] <= a[2] and b[3] >= a[3] and b[4] >= a[4] and b[2:] != a[2:]

    want = {a[0] for a in rows if not any(beats(b, a) for b in rows)}
    assert {r["key"] for r in skyline.skyline(df, ["n"], ["k", "d"], ["g"]).collect()} == want
    empty = df.filter("false")
    assert skyline.skyline(empty, ["n"], ["k", "d"]).count() == 0


def test_min_spacing_and_radius(spark):
    rng = random.Random(5)
    pts = [(g, i, rng.randint(0, 30) / 2, rng.randint(0, 30) / 2) for g in "abc" for i in range(25)] + [("one", 0, 1.0, 1.0), ("one", 1, 1.0, 1.0)]
    df = spark.createDataFrame(pts, "g string, i int, x double, y double")
    got = {r["g"]: r["spacing"] for r in geometry.min_spacing(df, ["g"]).collect()}
    for g in "abc":
        sites = {(p[2], p[3]) for p in pts if p[0] == g}
        want = min(((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2) ** 0.5 for a, b in itertools.combinations(sites, 2))
        assert abs(got[g] - want) < 1e-12
    assert got["one"] is None


def test_running_records_on_ties_and_nulls(spark):
    rows = [("a", "2026-01-02", 5.0, 1), ("a", "2026-01-01", 3.0, 2), ("a", "2026-01-02", 5.0, 3), ("a", None, 9.0, 4), ("a", "2026-01-03", 4.0, 5), ("a", "2026-01-04", 0.0, 6)]
    df = spark.createDataFrame(rows, "g string, date string, m double, key int")
    assert {r["key"] for r in timeline.running_records(df, ["g"], "date", "m", "key").collect()} == {1, 2}


def test_refinement_separates_graphs(spark):
    path = [("p", i, i + 1) for i in range(4)]
    ring = [("r", i, (i + 1) % 5) for i in range(5)]
    both = path + ring
    edges = spark.createDataFrame(both + [(g, b, a) for g, a, b in both], "graph string, src int, dst int")
    nodes = edges.select("graph", F.col("src").alias("node")).distinct().withColumn("colour", F.lit(0))
    out = graph.wl_refine(nodes, edges)
    assert {r["graph"]: r["c"] for r in out.groupBy("graph").agg(F.countDistinct("colour").alias("c")).collect()} == {"p": 3, "r": 1}
    sizes = spark.createDataFrame([("p", 1, 1, 1), ("r", 1, 1, 1)], "graph string, n int, k int, d int")
    assert graph.graph_signature(sizes, out).select("signature").distinct().count() == 2


def test_closed_rules_and_caps(spark):
    df = spark.createDataFrame([("a", [[0, 1]], [[1]], None), ("b", [list(range(40))], [[1]], None)], "key string, x array<array<int>>, z array<array<int>>, c array<int>")
    out = {r["key"]: r["e"] for r in df.select("key", rules.over_caps(F.lit(10), F.col("x"), F.col("z"), F.col("c")).alias("e")).collect()}
    assert out == {"a": [], "b": ["too large: weight"]}


def test_files_of_operations(spark, tmp_path):
    (tmp_path / "m.txt").write_text("R 0 1\nTICK\nCX 0 1 # gate\nerror(0.25) D0 L0\nM(0.1) 1\nerror(0.5) D1\n")
    text = files.read_texts(spark, str(tmp_path))
    ops = files.circuit_ops(text).orderBy("line").collect()
    assert [(r["name"], r["arg"], r["targets"]) for r in ops[:3]] == [("R", None, ["0", "1"]), ("TICK", None, []), ("CX", None, ["0", "1"])]
    mech = files.mechanisms(text).orderBy("idx").collect()
    assert [(r["idx"], r["p"], r["detectors"], r["observables"]) for r in mech] == [(0, 0.25, [0], [0]), (1, 0.5, [1], [])]
    assert files.hash_files(spark, str(tmp_path)).count() == 1
    assert circuits.not_allowed(files.circuit_ops(text)).first()["name"] == "error"


def test_bibliography(spark, tmp_path):
    (tmp_path / "r.bib").write_text('@article{one,\n author = {Last, First and Other, B.},\n doi = {10.1/AB},\n title={The {Big} one}\n}\n\n@misc{two,\n eprint = {2504.08887},\n author = {G{\\"o}del, K.}\n}\n')
    rows = {r["ref"]: r for r in files.bibliography(files.read_texts(spark, str(tmp_path))).collect()}
    assert rows["one"]["doi"] == "10.1/AB" and rows["one"]["title"] == "The Big one" and rows["two"]["eprint"] == "2504.08887" and rows["two"]["author"] == "Godel, K."


def test_streaming_leaderboard_equals_batch(spark, tmp_path):
    schema = "fp string, key int, eff double"
    rows = [("a", 1, 1.0), ("a", 2, 3.0), ("b", 3, 2.0)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    incremental.upsert_leaderboard(stream, str(tmp_path / "board"), str(tmp_path / "state"), "fp", [("eff", False)]).awaitTermination()
    assert {(r["fp"], r["key"]) for r in incremental.leaderboard(spark, str(tmp_path / "board"), schema, "fp").collect()} == {("a", 2), ("b", 3)}


def test_streaming_intake(spark, folder):
    query = incremental.intake(spark, str(folder)).select("key", "problem").writeStream.format("memory").queryName("intake").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r["key"] for r in spark.sql("SELECT key FROM intake WHERE problem IS NOT NULL").collect()} == {"broken", "Bad_Key"}


def test_entry_survives_without_llm(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "claimboard", tmp_path / "claimboard", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op1_') for n in q); print(len(q))"], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_texts_that_name_an_outside_place_may_cite_its_paths(spark):
    from claimboard.operators import text

    rows = [("a", "see `codes/9.json`"), ("b", "from the authors' own repo: `codes/9.json`"), ("c", "at Zenodo, codes/9.json"), ("d", None)]
    df = spark.createDataFrame(rows, "label string, text string")
    assert [r["label"] for r in text.without_external(df).collect()] == ["a"]


def test_ranks_of_groups_with_nulls_repeats_and_names_for_elements(spark):
    rng = random.Random(5)
    rows = [(g, r, e) for g in [None, 1, 2, 3] for r in range(6) for e in rng.sample("abcdefgh", 3)] + [(1, 0, "a"), (4, 0, None), (5, 0, "a"), (5, 0, "a")]

    def rank(group):
        span = {frozenset()}
        for r in {r for g, r, _ in rows if g == group}:
            v = frozenset()
            for g, s, e in rows:
                if g == group and s == r and e is not None:
                    v ^= {e}
            span |= {s ^ v for s in span}
        return len(span).bit_length() - 1

    df = spark.createDataFrame(rows, "g int, r int, e string").repartition(7)
    assert {(r.g, r["rank"]) for r in parity.gf2_rank(df, ["g"], "r", "e").collect()} == {(g, rank(g)) for g in [None, 1, 2, 3, 4, 5]}
    assert parity.gf2_rank(df.filter("false"), ["g"], "r", "e").count() == 0


def test_widest_pair_with_ties_repeated_ids_and_one_place(spark):
    rng = random.Random(6)
    points = [(g, rng.randrange(12), float(rng.randrange(6)), float(rng.randrange(6))) for g in range(30) for _ in range(rng.randrange(1, 14))]
    points += [(90, i, 1.0, 2.0) for i in (3, 1, 2)]
    expected = {}
    for g in {p[0] for p in points}:
        pairs = [(-((x - u) ** 2 + (y - v) ** 2), a, b) for h, a, x, y in points if h == g for k, b, u, v in points if k == g and a < b]
        if pairs:
            expected[g] = min(pairs)[1:]
    df = spark.createDataFrame(points, "g int, id int, x double, y double")
    assert {r.g: (r.a, r.b) for r in geometry.widest_pair(df, ["g"], "id").collect()} == expected
    assert {r.g for r in geometry.group_diameter(df, ["g"], "id").collect()} == {p[0] for p in points}


def test_places_over_ranges(spark):
    rows = [(i * 7 % 101, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "v int, key int").repartition(5)
    got = {r.key: r.place for r in tables.numbered(df, [F.desc("v"), F.asc("key")], "place").collect()}
    assert got == {key: i + 1 for i, (_, key) in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])))}


def test_oversized_files_are_reported_and_not_opened(spark, folder):
    (folder / "large.json").write_text("{ not json" + " " * 3000)
    (folder / "Large_Key.json").write_text(" " * 3000)
    docs = files.read_submissions(spark, str(folder), 2000)
    good, bad = files.split_quarantine(docs)
    assert {r["key"]: r["problem"] for r in bad.collect()} == {"broken": "malformed document", "Bad_Key": "unsafe key", "large": "file too large", "Large_Key": "unsafe key"}
    assert {r["key"] for r in good.collect()} == {"7-1-3", "light", "row"}


def test_certificates_that_cannot_be_read_are_absent(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"name": "a", "d": 3, "solver": "s", "sides": {}, "d_exact": True}))
    (tmp_path / "b.json").write_text("{ not json")
    (tmp_path / "c.json").write_text("{}")
    assert [(r["key"], r["d"], r["d_exact"]) for r in files.read_certs(spark, str(tmp_path)).collect()] == [("a", 3, True)]


def test_shape_of_documents_and_versions(spark):
    rows = [("a", "0.1", "x", (1,)), ("b", "0.2", None, (None,)), ("c", "0.10", "x", (1,)), ("d", None, "x", None), ("e", "draft", "x", (1,))]
    docs = spark.createDataFrame(rows, "key string, schema_version string, name string, circuit struct<rounds:int>")
    out = {r["key"]: (r["ok"], r["detail"]) for r in rules.document_shape(docs, ["schema_version", "name"], {"circuit": ["rounds"]}, {"circuit": "0.2"}).collect()}
    newer = "circuit needs version 0.2"
    assert out == {"a": (False, newer), "b": (False, "missing name; missing circuit.rounds"), "c": (True, ""), "d": (False, "missing schema_version"), "e": (False, newer)}


def test_claimed_dimension(spark):
    claims = spark.createDataFrame([("a", 1), ("b", 2), ("c", 0), ("d", 1), ("e", None)], "key string, k int")
    computed = spark.createDataFrame([("a", 1), ("b", 1), ("c", 0), ("e", 1)], "key string, k int")
    out = {r["key"]: r["ok"] for r in rules.claimed_dimension(claims, computed).collect()}
    assert out == {"a": True, "b": False, "c": False, "d": False, "e": False}


def test_layouts_cover_all_and_stay_within_their_radius(spark):
    layouts = spark.createDataFrame([("a", 2, 5.0), ("b", 2, 4.9), ("c", 3, 9.0), ("d", 2, None), ("e", 1, 0.0), ("f", 1, 0.0)], "key string, n int, radius double")
    points = spark.createDataFrame([(k, q, 3.0 * q, 4.0 * q) for k in "abcd" for q in (0, 1)] + [("e", 0, 0.0, 0.0)], "key string, qubit int, x double, y double")
    checks = spark.createDataFrame([(k, "X", 0, q) for k in "abcd" for q in (0, 1)], "key string, side string, check_idx int, qubit int")
    out = {(r["key"], r["check"]): r["ok"] for r in rules.layout_claims(layouts, points, checks).collect()}
    cover, within = "coordinates_cover", "radius_within_claim"
    assert out == {("a", cover): True, ("a", within): True, ("b", cover): True, ("b", within): False, ("c", cover): False, ("d", cover): True, ("e", cover): True, ("e", within): True, ("f", cover): False}


def test_logical_representatives(spark):
    rows = [("a", s, i, q, 7) for s in "XZ" for i, f in enumerate(FACES) for q in f] + [("x", "X", 0, 0, 2), ("z", "Z", 0, 0, 2)]
    df = spark.createDataFrame(rows, "key string, side string, check_idx int, qubit int, n int")
    found = {}
    for r in parity.logical_basis(df, ["key"], "side", "check_idx", "qubit", "n").collect():
        found.setdefault(r["key"], {}).setdefault(r["basis_idx"], set()).add(r["qubit"])
    assert len(found["a"]) == 1 and all(len(v & set(f)) % 2 == 0 for v in found["a"].values() for f in FACES) and len(found["a"][0]) % 2 == 1
    assert found["x"] == {0: {1}} and found["z"] == {0: {1}}


def test_observables_hold(spark):
    checks = spark.createDataFrame([(f, i, q) for f in "abcdef" for i, face in enumerate(FACES) for q in face], "file string, check_idx int, qubit int")
    finals = spark.createDataFrame([(f, r, r - 10) for f in "abcdef" for r in range(10, 17)], "file string, record int, qubit int")
    every = list(range(10, 17))
    taken = {"a": (0, every), "b": (0, [10]), "c": (0, [13, 14, 15, 16]), "d": (1, every), "e": (0, [*every, 3])}
    obs = spark.createDataFrame([(f, j, r) for f, (j, rs) in taken.items() for r in rs], "file string, obs int, record int")
    sizes = spark.createDataFrame([(f, 1) for f in "abcdef"], "file string, k int")
    out = {r["file"]: r["ok"] for r in circuits.observables_hold(obs, finals, checks, checks, sizes).collect()}
    assert out == {"a": True, "b": False, "c": False, "d": False, "e": False, "f": False}
