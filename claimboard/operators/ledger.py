"""Roll-ups of a trial ledger, verdicts and leaderboard merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lightest(trials: DataFrame, keys: list[str], weight: str, tie: str) -> DataFrame:
    """(keys..., weight, witness): the least weight and the trial that found it first."""
    return trials.groupBy(*keys).agg(F.min(weight).alias("weight"), F.min_by(tie, F.struct(weight, tie)).alias("witness"))


def verdict(found: Column, claim: Column) -> Column:
    """Below the claim refutes it, equal corroborates it, above or nothing says nothing."""
    return F.when(found < claim, F.lit("refuted")).when(found == claim, F.lit("corroborated")).otherwise(F.lit("inconclusive"))


def combined(by_method: DataFrame, key: str) -> DataFrame:
    """(key, agree, verdict): whether methods found the same weight, and corroborated only if all of them are."""
    out = by_method.groupBy(key).agg((F.count_distinct("weight") <= 1).alias("agree"), F.bool_or(F.col("verdict") == "refuted").alias("r"), F.bool_and(F.col("verdict") == "corroborated").alias("c"))
    return out.select(key, "agree", F.when(F.col("r"), F.lit("refuted")).when(F.col("c"), F.lit("corroborated")).otherwise(F.lit("inconclusive")).alias("verdict"))


def any_hit(trials: DataFrame, claims: DataFrame, key: str, shown: int = 5) -> DataFrame:
    """(key, hit, n_hits, hits): trials below the claim, with the lightest few."""
    below = trials.join(claims, key).withColumn("below", F.col("weight") < F.col("claim"))
    few = F.slice(F.sort_array(F.collect_set(F.when(F.col("below"), F.struct("weight", "method")))), 1, shown)
    return below.groupBy(key).agg(F.bool_or("below").alias("hit"), F.count_if("below").alias("n_hits"), few.alias("hits"))


def accepted(proposals: DataFrame, validated: DataFrame, keys: list[str]) -> DataFrame:
    """Proposals with `accepted`: only those that were validated independently; the others are misses."""
    return proposals.join(validated.select(*keys, "ok"), keys, "left").withColumn("accepted", F.coalesce("ok", F.lit(False))).drop("ok")


def stable_seed(key: Column, run_seed: int) -> Column:
    """(run seed + first four bytes of the key's SHA-256) modulo 2^31."""
    head = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    return F.pmod(head + run_seed, F.lit(2**31)).cast("long")


def sweep_summary(results: DataFrame) -> DataFrame:
    """One row: checked, refuted, errored, passed. A null verdict is an error."""
    out = results.agg(F.count("*").alias("checked"), F.count_if(F.col("verdict") == "refuted").alias("refuted"), F.count_if(F.col("verdict").isNull()).alias("errored"))
    return out.withColumn("passed", (F.col("refuted") == 0) & (F.col("errored") == 0))


def certificate(sides: DataFrame, key: str, expected: int = 2) -> DataFrame:
    """(key, d, exact): exact only if every expected side is there and exact; d is the least exact value."""
    out = sides.groupBy(key).agg(F.count("*").alias("c"), F.bool_and("exact").alias("all"), F.min("value").alias("d"))
    return out.select(key, "d", ((F.col("c") >= expected) & F.col("all")).alias("exact"))


def best_of_restarts(runs: DataFrame, group: list[str], order: list[str], score: str, target: float) -> DataFrame:
    """(group..., best, first_reaching): the least score and the place of the first run that reaches the target."""
    place = F.struct(*order)
    return runs.groupBy(*group).agg(F.min(score).alias("best"), F.min(F.when(F.col(score) <= target, place)).alias("first_reaching"))


def merge_leaderboard(existing: DataFrame, new: DataFrame, fingerprint: str, order: list[Column]) -> DataFrame:
    """Upsert by fingerprint: a new row replaces an old one; among rows of the same age the first in order stays."""
    both = existing.withColumn("_age", F.lit(1)).unionByName(new.withColumn("_age", F.lit(0)))
    rank = F.row_number().over(W.partitionBy(fingerprint).orderBy("_age", *order))
    return both.withColumn("_rank", rank).filter("_rank = 1").drop("_rank", "_age")


def screen(candidates: DataFrame, valid: Column, least_k: int, least_d: int, fingerprint: list[str], score: Column, order: list[str], keep: int) -> DataFrame:
    """Valid candidates with enough k, the first of each fingerprint, with enough d, best score first, `keep` of them."""
    ok = candidates.filter(valid & (F.col("k") >= least_k))
    rank = F.row_number().over(W.partitionBy(*fingerprint).orderBy(*order))
    one = ok.withColumn("_rank", rank).filter("_rank = 1").drop("_rank").filter(F.col("d") >= least_d)
    return one.withColumn("score", score).orderBy(F.desc("score"), *order).limit(keep)


def candidate_verdict(df: DataFrame, key: str) -> DataFrame:
    """(key, passed, labels) from verified, refuted, exact_of, similar_of and n_dominators."""
    duplicate = F.col("exact_of").isNotNull()
    passed = F.coalesce(F.col("verified"), F.lit(False)) & ~F.coalesce(F.col("refuted"), F.lit(True)) & ~duplicate
    labels = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("verified"), F.lit(False)), F.lit("rejected")), F.when(F.coalesce(F.col("refuted"), F.lit(True)), F.lit("refuted")), F.when(duplicate, F.lit("duplicate")),
        F.when(~duplicate & F.col("similar_of").isNotNull(), F.lit("similar")), F.when((F.col("n_dominators") == 0) & ~duplicate, F.lit("advances")),
    ))
    return df.select(key, passed.alias("passed"), labels.alias("labels"))
