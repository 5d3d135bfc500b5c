"""Streams over many micro-batches, files beyond a row's size, and products of codes against matrices."""

import hashlib
import random

import pytest

from claimboard.functions.tables import setting
from claimboard.operators import generate, text
from claimboard.sources import files
from claimboard.streaming import incremental


def test_leaderboard_over_many_micro_batches(spark, tmp_path):
    """One file a batch; the newest batch's best row of a fingerprint stays, whatever the older ones had."""
    rng = random.Random(3)
    schema = "fp string, key int, eff double"
    want, stamp = {}, 1_700_000_000
    (tmp_path / "in").mkdir()
    for i in range(6):
        rows = [(rng.choice(["a", "b", None, "d"]), 10 * i + j, rng.choice([1.0, 2.0, None])) for j in range(4)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
        (one,) = (tmp_path / f"part{i}").glob("*.parquet")
        to = one.rename(tmp_path / "in" / f"{i}.parquet")
        import os

        os.utime(to, (stamp + 10 * i, stamp + 10 * i))
        best = {}
        for fp, key, eff in rows:
            rank = (eff is None, -(eff or 0), key)
            if fp not in best or rank < best[fp][0]:
                best[fp] = (rank, key)
        want |= {fp: key for fp, (_, key) in best.items()}
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = incremental.upsert_leaderboard(stream, str(tmp_path / "board"), str(tmp_path / "state"), "fp", [("eff", False), ("key", True)])
    query.awaitTermination()
    assert {r["fp"]: r["key"] for r in incremental.leaderboard(spark, str(tmp_path / "board"), schema, "fp").collect()} == want
    assert len(list((tmp_path / "board").glob("epoch=*"))) == 6


def test_a_file_larger_than_a_row_is_hashed(spark, tmp_path):
    with open(tmp_path / "large.bin", "wb") as f:
        f.truncate(2_200_000_000)
        f.seek(2_199_999_000)
        f.write(b"end")
    (tmp_path / "small.bin").write_bytes(b"abc")
    digest, zeros = hashlib.sha256(), bytes(1 << 24)
    left = 2_199_999_000
    while left:
        digest.update(zeros[: min(left, len(zeros))])
        left -= min(left, len(zeros))
    digest.update(b"end" + bytes(997))
    got = {r["path"].rsplit("/", 1)[1]: r["sha"] for r in files.hash_files(spark, str(tmp_path)).collect()}
    assert got == {"large.bin": digest.hexdigest(), "small.bin": hashlib.sha256(b"abc").hexdigest()}


def test_long_runs_are_looked_up_at_known_lengths_only(spark):
    refs = spark.createDataFrame([("a", 1, "", "10.1000/Abc", ""), ("b", 0, "", "10.1000/abcd", ""), ("c", 2, "2101.12345", "", ""), ("d", 3, "", "", "Smith, J.")], "ref string, seq int, eprint string, doi string, author string")
    long = "10.1000/abcde" + "x" * 1_000_000
    rows = [(long,), ("10.1000/ABC",), ("see 10.1000/ab",), ("2101.12345 and 10.1000/abcd",), ("9999.99999",), ("Smith",), (None,), ("",)]
    got = {r["cite"]: r["ref"] for r in text.resolve(spark.createDataFrame(rows, "cite string"), refs).collect()}
    assert got == {long: "b", "10.1000/ABC": "a", "see 10.1000/ab": None, "2101.12345 and 10.1000/abcd": "b", "9999.99999": None, "Smith": "d", None: None, "": None}


@pytest.mark.parametrize("a,b", [(2, 2), (3, 2)])
def test_product_of_codes_equals_matrices(spark, a, b):
    """Both sides of the product are the block matrices of the parents' rows, entry by entry."""
    import numpy as np

    n = a * b
    groups = spark.createDataFrame([(1, a, b)], "grp long, a long, b long")
    mul = generate.cyclic_tables(groups)
    left, right = [0, 1], [1, 3]
    support = lambda s: spark.createDataFrame([(1, x) for x in s], "grp long, s long")
    got = {(r["side"], r["check_idx"], r["qubit"]) for r in generate.product_of_group_codes(mul, support(left), support(right), spark.createDataFrame([(1, n)], "grp long, size long")).collect()}
    product = lambda g, h: ((g // b + h // b) % a) * b + (g % b + h % b) % b
    matrix = np.zeros((n, 2 * n), int)
    for x in range(n):
        for s in left:
            matrix[x, product(s, x)] ^= 1
        for s in right:
            matrix[x, n + product(x, s)] ^= 1
    one = lambda m: np.eye(m, dtype=int)
    hx = np.hstack([np.kron(matrix, one(2 * n)), np.kron(one(n), matrix.T)])
    hz = np.hstack([np.kron(one(2 * n), matrix), np.kron(matrix.T, one(n))])
    assert not (hx @ hz.T % 2).any()
    assert got == {(side, int(i), int(j)) for side, m in (("X", hx), ("Z", hz)) for i, j in zip(*np.nonzero(m))}


def test_intake_leaves_large_files_closed(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"name": "x", "n": 7}')
    (tmp_path / "large.json").write_text('{"name": "x", "n": 7, "pad": "' + "p" * 5000 + '"}')
    (tmp_path / "large.json").chmod(0)  # unreadable: opening it would fail
    stream = files.stream_submissions(spark, str(tmp_path), 1000).select("key", "problem", "n")
    stream.writeStream.format("memory").queryName("capped").trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in spark.sql("SELECT key, problem, n FROM capped").collect()} == {("good", None, 7), ("large", "file too large", None)}


def test_many_small_files_are_hashed_in_few_tasks(spark, tmp_path):
    """Before, a task read 32 files; names may have a subfolder, and texts over the bound are hashed as well."""
    rows = [(f"{k % 40}/f{k}.txt", f"text {k} " * (1 + k % 3 * 200)) for k in range(600)]
    files.write_files(spark.createDataFrame(rows, "name string, content string"), f"file://{tmp_path}/many")
    group, tracker = "hashed-files", spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        with setting(spark, "spark.sql.files.maxPartitionBytes", str(1 << 24)):  # four files a task as Spark counts them
            got = {r["path"].split("/many/")[1]: r["sha"] for r in files.hash_files(spark, f"{tmp_path}/many", whole_bytes=4000).collect()}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {name: hashlib.sha256(text.encode()).hexdigest() for name, text in rows}
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    assert max(i.numTasks for i in map(tracker.getStageInfo, stages) if i) < 60
