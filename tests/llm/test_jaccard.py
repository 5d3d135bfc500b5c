"""Which nodes of the n-gram Jaccard join stay open."""

import numpy as np
from pyspark.sql import functions as F

from claimboard.functions.tables import setting
from claimboard.llm import ngram_jaccard

OPEN = "token long, node long, n long, comp long, top long"


def _need(n, m):
    both = -(-4 * (n + m) // 9)
    return max(min(both - -(-4 * x // 5) + 1 for x in (n, m)), 1)


def _open(spark, postings):
    rows = [(token, node, n, node, 1 << 62) for token, node, n in postings]
    return {r["node"] for r in ngram_jaccard._open(spark.createDataFrame(rows, OPEN)).select("node").distinct().collect()}


def test_a_larger_node_of_a_token_closes_no_link(spark):
    """The need may rise by one towards a larger partner; the node that needs less is still met."""
    n, m = next((n, m) for n in range(40, 200) for m in range(n + 2, n * 5 // 4) if _need(n, m) > _need(n, m - 1) and _need(n, n) > _need(n, m - 1))
    least = _need(n, m - 1)
    postings = [(t, node, size) for t in range(least) for node, size in ((1, n), (2, m - 1))] + [(0, 3, m)]
    assert {1, 2} <= _open(spark, postings)


def test_tokens_count_for_the_sizes_they_are_met_at(spark):
    """Node 1 shares three tokens with partners that need 19 and more, and only one with another: no link is possible."""
    n, sizes = 2000, (1640, 1700, 1800)
    assert min(_need(n, m) for m in sizes) > 3
    shared = [(t, 1, n) for t in range(4)] + [(t, 10 + t, m) for t, m in enumerate(sizes)]
    assert 1 not in _open(spark, [*shared, (3, 14, 1603)])
    assert 1 in _open(spark, [*shared, (3, 14, 1600)])


def test_sets_that_are_asked_for_are_found(spark):
    sets = spark.range(1000).select((F.col("id") * 7919 - 3000000).alias("node"), F.lit(b"x").alias("tokens"))
    nodes = sets.select("node").filter("node % 3 = 0")
    got = {r["node"] for r in ngram_jaccard._sets_in(sets, nodes).collect()}
    assert {r["node"] for r in nodes.collect()} <= got and len(got) < 600


def _jobs(spark, run):
    """Jobs and tasks of a run whose shuffles have 64 partitions that are not merged."""
    group, tracker = f"count-{id(run)}", spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        with setting(spark, "spark.sql.shuffle.partitions", "64"), setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"):
            out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = tracker.getJobIdsForGroup(group)
    stages = {s for j in jobs for s in (tracker.getJobInfo(j).stageIds if tracker.getJobInfo(j) else ())}
    return out, len(jobs), sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i)


def test_a_map_is_read_in_few_jobs(spark):
    """Before, each partition of the shuffle was a job of its own."""
    keys = spark.range(500).select((F.col("id") * 31).alias("k"))
    (sent, size), jobs, _ = _jobs(spark, lambda: ngram_jaccard._bit_map(keys, lambda n: F.pmod("k", F.lit(n)), 64))
    assert jobs < 30
    marked = ngram_jaccard._marked(sent.value, np.arange(size))
    assert set(np.flatnonzero(marked).tolist()) == {31 * k % size for k in range(500)}


def test_few_links_are_joined_in_few_tasks(spark, monkeypatch):
    """A chain and a star: the same components either way; few labels are not shuffled to as many tasks as large ones."""
    links = [(k, k + 1) for k in range(20)] + [(100, 100 + k) for k in range(1, 30)] + [(101, 100)]
    df = spark.createDataFrame(links, "a long, b long")
    want = {k: 0 for k in range(21)} | {100 + k: 100 for k in range(30)}
    found, _, few = _jobs(spark, lambda: {r["node"]: r["comp"] for r in ngram_jaccard.components(df).collect()})
    assert found == want
    monkeypatch.setattr(ngram_jaccard, "BROADCAST_ROWS", 0)
    found, _, many = _jobs(spark, lambda: {r["node"]: r["comp"] for r in ngram_jaccard.components(df).collect()})
    assert found == want and 4 * few < many


def test_pairs_that_share_one_passage_are_not_verified(spark, monkeypatch):
    """Each of 14 texts shares another passage with each other one, so all are open, but no two share enough to be compared
    as wholes: before, each pair had both sets shuffled. A text close to one of them is still linked."""
    words = lambda name, n: " ".join(f"{name}x{i}" for i in range(n))
    texts = [" ".join(words(f"p{min(i, j)}y{max(i, j)}", 30) for j in range(14) if j != i) for i in range(14)]
    rows = list(enumerate(texts)) + [(20, texts[3] + " " + words("end", 10))]
    verified, verify = [], ngram_jaccard.verify
    monkeypatch.setattr(ngram_jaccard, "verify", lambda pairs, sets: verified.append(pairs.count()) or verify(pairs, sets))
    got = {r["doc_id"]: r["component_id"] for r in ngram_jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i for i in range(14)} | {20: 3}
    assert sum(verified) <= 1


def test_postings_are_dealt_once_by_token(spark):
    """The join by token and size reads one exchange on both sides; only the windows of a node need another."""
    df = spark.range(4000).select((F.col("id") % 97).alias("token"), (F.col("id") % 311).alias("node"), (50 + F.col("id") % 311 % 9).alias("n"))
    df = df.select("*", F.col("node").alias("comp"), F.lit(1 << 62).alias("top"))
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        made = ngram_jaccard._open_table(df, repeated=True)
        with setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
            again = ngram_jaccard._open(df, repeated=True)
            rows = sorted(map(tuple, again.collect()))
    plan = again._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    assert plan.count(" Exchange ") - plan.count("ReusedExchange") == 2 and plan.count("ReusedExchange") == 1
    assert rows == sorted(map(tuple, made.collect())) and len(set(r[:2] for r in rows)) == len(rows) > 0
