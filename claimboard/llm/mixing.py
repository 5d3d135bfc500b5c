"""Mixing sources to target weights by weighted fair queueing (operator 2). DataFrame functions only.

Documents of a source are dealt in an order given by a hash, twice over. A copy's virtual finish time is the
source's words up to and with it, divided by the source's target. All copies are then taken by ascending
finish time until the total budget is reached: a global range sort, done as a histogram of finish times that
finds the range in which the budget ends, and an exact running sum inside that range alone. Running sums
inside a source are sums of hash ranges first and rows second, so no task sees a whole source.

Defined results: a null text has size 0; documents of size 0 are never taken; null sources form the last source;
a source without words has target 0; repeated rows count as documents of their own; an empty table gives an
empty table; other columns are ignored by mix() and carried by keep_mixed().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop, fresh, key_of, prefix_sums, small_join, table, word_count

WEIGHTS = (3, 1, 2)
#: Share of all words that the mix takes, and the most a source's words may be repeated.
BUDGET, EPOCHS = 1.5, 2
#: Rows that a hash range or finish-time range should hold.
RANGE_ROWS = 8192


def deal(doc_id: Column) -> Column:
    """Place of a document in its source's order: 60 bits of its id's MD5."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """Targets per source of (sk, source_size): BUDGET of all words by weight, capped at EPOCHS times a source's
    words, the excess reshared by weight. Sources reach their caps in the order of cap over weight; the level is that of the first that does not."""
    order = W.orderBy("sk")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    weighed = sizes.withColumn("weight", weight).withColumn("cap", EPOCHS * F.col("source_size"))
    full = W.orderBy(F.col("cap") / F.col("weight"), "sk")
    everything = W.partitionBy()
    filled = weighed.select(
        "sk", "source_size", "weight", "cap",
        (F.sum("source_size").over(everything) * BUDGET - F.coalesce(F.sum("cap").over(full.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("left"),
        F.sum("weight").over(full.rowsBetween(0, W.unboundedFollowing)).alias("weights"),
    ).withColumn("level", F.col("left") / F.col("weights"))
    level = F.max(F.when(F.col("cap") > F.col("weight") * F.col("level"), F.col("level"))).over(everything)
    return filled.withColumn("flat", level).select("sk", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(F.col("weight") * F.col("flat"), F.col("cap").cast("double"))).alias("target"))


def mix(docs: DataFrame) -> DataFrame:
    """Per row of `docs` (doc_id, text, source): doc_id, size, source_size, target, copies, taken."""
    narrow = table(docs.select("doc_id", key_of(F.col("source")).alias("sk"), word_count(F.col("text")).alias("size"), deal(F.col("doc_id")).alias("h")), "mix-sizes")
    return _mix(narrow)


def _mix(narrow: DataFrame, ties: tuple[str, ...] = ()) -> DataFrame:
    """The same for a written table (doc_id, sk, size, h, ...), whose other columns are carried; `ties` order rows
    alike in h, doc_id and size."""
    counted = table(narrow.groupBy("sk").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")), "mix-sources")
    aims = targets(counted.select("sk", "source_size")).join(counted.select("sk", "docs").hint("merge"), "sk")
    aims = table(aims, "mix-targets")
    rows = small_join(narrow, aims, ["sk"])
    width = F.greatest(F.floor((1 << 60) * F.lit(float(RANGE_ROWS)) / F.col("docs")), F.lit(1))
    rows = rows.withColumn("block", F.floor(F.col("h") / width))
    offsets = prefix_sums(rows.groupBy("sk", "block").agg(F.sum("size").alias("words")), ["sk"], "block", {"before": "words"})
    offsets = table(offsets.select("sk", "block", "before"), "mix-offsets")
    inside = W.partitionBy("sk", "block").orderBy("h", "doc_id", "size", *ties).rowsBetween(W.unboundedPreceding, 0)
    placed = rows.withColumn("upto", F.sum("size").over(inside)).join(offsets.hint("merge"), ["sk", "block"])
    placed = table(placed.withColumn("upto", F.col("upto") + F.col("before")).drop("before", "block", "docs"), "mix-placed")

    finish = (F.col("upto") + F.col("epoch") * F.col("source_size")) / F.col("target")
    epochs = F.explode(F.array(*map(F.lit, range(EPOCHS)))).alias("epoch")
    copies = placed.filter("size > 0").select("*", epochs).withColumn("finish", finish)
    total = table(placed.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("words"), F.count("*").alias("rows")), "mix-total").first()
    budget, slots = total["words"] * BUDGET, EPOCHS * total["rows"] // RANGE_ROWS + 1
    slot = F.floor(F.col("finish") * slots)
    ranges = table(prefix_sums(copies.groupBy(slot.alias("slot")).agg(F.sum("size").alias("words")), [], "slot", {"before": "words"}), "mix-ranges")
    edge = ranges.filter(F.col("before") <= budget).agg(F.max("slot").alias("slot"), F.max("before").alias("before")).first()
    last, before = (-1, 0) if edge["slot"] is None else edge
    within = copies.filter(slot == last).select("finish", "size").groupBy("finish").agg(F.sum("size").alias("words"))
    running = within.withColumn("sum", before + F.sum("words").over(W.orderBy("finish").rowsBetween(W.unboundedPreceding, 0)))
    cut = running.filter(F.col("sum") <= budget).agg(F.max("finish")).first()[0]
    cut = -1.0 if cut is None else float(cut)
    taken = sum((F.when((F.col("upto") + e * F.col("source_size")) / F.col("target") <= F.lit(cut), 1).otherwise(0) if cut >= 0 else F.lit(0)) for e in range(EPOCHS))
    early = sum(F.when(F.floor((F.col("upto") + e * F.col("source_size")) / F.col("target") * slots) < last, 1).otherwise(0) for e in range(EPOCHS))
    copies_taken = F.when(F.col("size") > 0, F.greatest(taken, early)).otherwise(0)
    return placed.withColumn("copies", copies_taken).withColumn("taken", F.col("copies") * F.col("size"))


def _row_key(docs: DataFrame) -> list[Column]:
    """Two hashes, 128 bits, of a row's columns and of which are null (map columns cannot be hashed and stay out)."""
    columns = [F.col(c) for c, kind in docs.dtypes if "map<" not in kind]
    nulls = F.concat(*(F.when(c.isNull(), "1").otherwise("0") for c in columns))
    return [F.xxhash64(nulls, *columns), F.xxhash64(F.lit(1), nulls, *columns)]


def keep_mixed(docs: DataFrame) -> DataFrame:
    """`docs` as the mix takes them: rows that it takes twice stand twice, those that it leaves are gone.

    Texts are read from `docs` again rather than written with a number per row: rows are told apart by what they hold,
    and what the mix takes of rows that are alike is shared among them."""
    one, two, n, rows, copy = (fresh(docs, c) for c in ("_one", "_two", "_taken", "_rows", "_copy"))
    keys = dict(zip((one, two), _row_key(docs)))
    narrow = docs.select("doc_id", key_of(F.col("source")).alias("sk"), word_count(F.col("text")).alias("size"), deal(F.col("doc_id")).alias("h"), *(k.alias(c) for c, k in keys.items()))
    mixed = _mix(table(narrow, "mix-rows"), (one, two)).groupBy(one, two).agg(F.sum("copies").alias(n), F.count("*").alias(rows))
    chosen = table(mixed.filter(F.col(n) > 0), "mix-chosen")
    joined = docs.withColumns(keys).join(chosen.hint("merge"), [one, two])
    times = lambda df, k: df.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), k.cast("int"))).alias(copy)).select(*docs.columns)
    out, odd = times(joined, F.floor(F.col(n) / F.col(rows))), F.col(n) % F.col(rows)
    if chosen.filter(odd > 0).isEmpty():
        return out
    return out.union(times(joined.filter(odd > 0).dropDuplicates([one, two]), odd))


def op2(spark, sf_dir: str) -> DataFrame:
    """Query: what the mix takes of each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = """
WITH d AS (SELECT doc_id, coalesce('=' || source, '~') AS sk, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT sk, sum(size)::BIGINT AS source_size FROM d GROUP BY sk),
w AS (SELECT sk, source_size, [3, 1, 2][((row_number() OVER (ORDER BY sk) - 1) % 3 + 1)] AS weight, 2 * source_size AS cap FROM s),
f AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, sk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / sum(weight) OVER (ORDER BY cap / weight, sk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT sk, source_size, least(cap::DOUBLE, coalesce(weight * max(CASE WHEN cap > weight * level THEN level END) OVER (), cap::DOUBLE)) AS target FROM f),
p AS (SELECT d.*, source_size, target, sum(size) OVER (PARTITION BY d.sk ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS upto
  FROM d JOIN t ON d.sk = t.sk),
c AS (SELECT doc_id, sk, h, size, ((upto + e * source_size)::DOUBLE / target) AS finish FROM p, unnest([0, 1]) AS u(e) WHERE size > 0),
r AS (SELECT *, sum(size) OVER (ORDER BY finish RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto_all FROM c),
k AS (SELECT doc_id, sk, h, size, count(*) FILTER (upto_all <= (SELECT sum(size) * 1.5 FROM d)) AS copies FROM r GROUP BY doc_id, sk, h, size)
SELECT p.doc_id, p.size, p.source_size, p.target, (coalesce(k.copies, 0) * p.size)::BIGINT AS taken
FROM p LEFT JOIN k ON p.doc_id = k.doc_id AND p.sk = k.sk AND p.h = k.h AND p.size = k.size
"""
