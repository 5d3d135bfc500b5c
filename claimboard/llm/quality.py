"""Quality rules with adaptive thresholds (operator 1). DataFrame functions only.

Each text gives four bounded metrics in thousandths. A metric's distribution per language and source is kept
as a histogram of its integer values: a quantile sketch with an error of one thousandth that merges by adding
counts. A group's fence is its upper quantile (HIGH per cent) plus REACH times that quantile's distance from the
median. Fences of small groups lean on coarser ones: a group's is averaged with its language's, and that with the
corpus', by their numbers of documents against PRIOR. A document fails a rule when its metric lies above the fence
by more than the rule's margin (RULES): the margin is a parameter in the metric's own unit, as most groups of clean
text have no symbols or repeated lines at all and a quantile alone would make every such text fail.

Defined results: a null text has no words and fails the base rule; null languages and sources are groups of
their own; repeated rows are judged alike; an empty table gives an empty table; other columns are ignored by
score() and carried by keep_good().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACES, fresh, key_of, let, small_join, table, words_of

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Rules and how far above its group's fence a text may lie, in thousandths.
RULES = {"symbols": 60, "dup_lines": 400, "repeats": 440, "capitals": 160}
HIGH, REACH = 80, 2
#: Documents that a coarser group's fence counts for.
PRIOR = 100
MIN_WORDS = 50


def _repeats(w: Column) -> Column:
    """Words inside 3-word windows found twice or more in the array.

    Windows are sorted as hash * n + position, so that equal ones are neighbours; neighbours of equal hash
    are compared word by word."""
    n = F.size(w)
    wide = n.cast("long")
    room = F.floor(F.lit(float(1 << 62)) / n)
    packed = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: F.pmod(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), room) * wide + i,
    )

    def same(a: Column, b: Column) -> Column:
        i, j = (a % wide).cast("int"), (b % wide).cast("int")
        alike = [F.get(w, i + k) == F.get(w, j + k) for k in range(3)]
        return F.coalesce(((a - a % wide) == (b - b % wide)) & alike[0] & alike[1] & alike[2], F.lit(False))

    def positions(s: Column) -> Column:
        found = F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)))
        return F.sort_array(F.transform(found, lambda x: (x % wide).cast("int")))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)

    return F.when(n < 3, F.lit(0).cast("long")).otherwise(let(F.sort_array(packed), lambda s: let(positions(s), covered)))


def _share(count: Column, total: Column) -> Column:
    """count of total, in thousandths rounded down; 0 of nothing."""
    return F.when(total > 0, F.floor(count * 1000 / total)).otherwise(0).cast("int")


def measure(text: Column) -> Column:
    """The base counts and the rules' metrics of a text, as a struct."""
    t = F.coalesce(text, F.lit(""))
    chars = F.length(F.translate(t, SPACES, "")).cast("long")
    symbols = (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long")
    capitals = (F.length(t) - F.length(F.regexp_replace(t, "\\p{Lu}+", ""))).cast("long")
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    counted = let(words_of(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeats(w).alias("r")))
    lined = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))
    raw = F.struct(counted.alias("w"), lined.alias("l"), chars.alias("c"), symbols.alias("s"), capitals.alias("u"))
    return let(
        raw,
        lambda x: F.struct(
            x["w"]["n"].alias("n_words"),
            x["c"].alias("word_chars"),
            x["s"].alias("n_symbols"),
            x["l"]["d"].alias("n_dup_lines"),
            x["w"]["r"].alias("n_repeat_words"),
            ((x["w"]["n"] < MIN_WORDS) | (100 * x["w"]["r"] > 50 * x["w"]["n"])).alias("base_failed"),
            _share(x["s"], x["c"]).alias("symbols"),
            _share(x["l"]["d"], x["l"]["n"]).alias("dup_lines"),
            _share(x["w"]["r"], x["w"]["n"]).alias("repeats"),
            _share(x["u"], x["c"]).alias("capitals"),
        ),
    )


def sketches(measured: DataFrame, quality: str) -> DataFrame:
    """Counts of each metric's values per language and source: (lk, sk, rule, value, n)."""
    pairs = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(quality)[r].alias("value")) for r in RULES)))
    rows = measured.select(key_of(F.col("lang")).alias("lk"), key_of(F.col("source")).alias("sk"), pairs.alias("p"))
    return rows.groupBy("lk", "sk", "p.rule", "p.value").agg(F.count("*").alias("n"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row per language and source with the upper limit of each rule."""

    def fences(level: int, keys: list[str]) -> DataFrame:
        merged = sketch.groupBy(*keys, "rule", "value").agg(F.sum("n").alias("n"))
        group = W.partitionBy(*keys, "rule")
        ranked = merged.select(
            *keys, "rule", "value", F.sum("n").over(group).alias("all"),
            F.sum("n").over(group.orderBy("value").rowsBetween(W.unboundedPreceding, 0)).alias("upto"),
        )
        quantile = lambda q: F.min(F.when(100 * F.col("upto") >= q * F.col("all"), F.col("value")))
        cut = ranked.groupBy(*keys, "rule").agg(quantile(50).alias("mid"), quantile(HIGH).alias("high"), F.max("all").alias("docs"))
        fence = F.col("high") + REACH * (F.col("high") - F.col("mid"))
        return cut.select(*keys, "rule", F.struct("docs", fence.cast("long").alias("fence")).alias(f"at{level}"))

    groups = sketch.select("lk", "sk", "rule").distinct()
    found = groups.join(fences(0, ["lk", "sk"]).hint("shuffle_hash"), ["lk", "sk", "rule"])
    found = found.join(fences(1, ["lk"]).hint("shuffle_hash"), ["lk", "rule"]).join(fences(2, []).hint("shuffle_hash"), ["rule"])
    lean = lambda at, coarser: F.floor((F.col(f"{at}.docs") * F.col(f"{at}.fence") + PRIOR * coarser) / (F.col(f"{at}.docs") + PRIOR))
    margin = F.create_map(*(F.lit(x) for pair in RULES.items() for x in pair))[F.col("rule")]
    limit = lean("at0", lean("at1", F.col("at2.fence"))) + margin
    return found.groupBy("lk", "sk").agg(*(F.max(F.when(F.col("rule") == r, limit)).alias(f"max_{r}") for r in RULES))


def judge(measured: DataFrame, quality: str) -> DataFrame:
    """Add `<quality>_kept` to a written table that has lang, source and the struct column `quality`."""
    limits = table(thresholds(sketches(measured, quality)), "quality-limits")
    lk, sk = fresh(measured, "_lk"), fresh(measured, "_sk")
    limit = fresh(measured, "_limits")
    limits = table(limits.select(F.col("lk").alias(lk), F.col("sk").alias(sk), F.struct(*(f"max_{r}" for r in RULES)).alias(limit)), "quality-limits-keyed")
    keyed = measured.withColumns({lk: key_of(F.col("lang")), sk: key_of(F.col("source"))})
    joined = small_join(keyed, limits, [lk, sk])
    good = ~F.col(quality)["base_failed"]
    for r in RULES:
        good &= F.col(quality)[r] <= F.col(limit)[f"max_{r}"]
    return joined.withColumn(f"{quality}_kept", good).drop(lk, sk, limit)


def score(docs: DataFrame) -> DataFrame:
    """Base counts, metrics and verdict per row of `docs` (doc_id, text, lang, source)."""
    narrow = docs.select("doc_id", "lang", "source", measure(F.col("text")).alias("q"))
    return judge(table(narrow, "quality"), "q").select("doc_id", "q.*", F.col("q_kept").alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that pass, with all their columns."""
    name = fresh(docs, "_quality")
    measured = table(docs.withColumn(name, measure(F.col("text"))), "quality-docs")
    judged = judge(measured, name)
    return judged.filter(f"{name}_kept").select(*docs.columns)


def op1(spark, sf_dir: str) -> DataFrame:
    """Query: quality verdicts over all documents."""
    out = score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP1_SQL = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, lang, source FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
m AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
r AS (SELECT rid, count(DISTINCT i + k) AS n FROM m, unnest([0, 1, 2]) AS u(k) GROUP BY rid),
b AS (SELECT w.rid, doc_id, coalesce(lang, '~~') AS lk, coalesce(source, '~~') AS sk, len(ws) AS n_words,
  length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(ls) AS n_lines, coalesce(r.n, 0) AS n_repeat_words,
  length(t) - length(regexp_replace(t, '\\p{Lu}', '', 'g')) AS n_caps
  FROM w LEFT JOIN r ON w.rid = r.rid),
q AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  CASE WHEN word_chars > 0 THEN n_symbols * 1000 // word_chars ELSE 0 END AS m1,
  CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END AS m2,
  CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END AS m3,
  CASE WHEN word_chars > 0 THEN n_caps * 1000 // word_chars ELSE 0 END AS m4 FROM b),
v AS (SELECT lk, sk, 'm1' AS rule, 60 AS margin, m1 AS x FROM q UNION ALL SELECT lk, sk, 'm2', 400, m2 FROM q
  UNION ALL SELECT lk, sk, 'm3', 440, m3 FROM q UNION ALL SELECT lk, sk, 'm4', 160, m4 FROM q),
l0 AS (SELECT lk, sk, rule, margin, count(*) AS docs, (3 * quantile_disc(x, 0.8) - 2 * quantile_disc(x, 0.5))::BIGINT AS f FROM v GROUP BY lk, sk, rule, margin),
l1 AS (SELECT lk, rule, count(*) AS docs, (3 * quantile_disc(x, 0.8) - 2 * quantile_disc(x, 0.5))::BIGINT AS f FROM v GROUP BY lk, rule),
l2 AS (SELECT rule, (3 * quantile_disc(x, 0.8) - 2 * quantile_disc(x, 0.5))::BIGINT AS f FROM v GROUP BY rule),
t AS (SELECT l0.lk, l0.sk, l0.rule, (l0.docs * l0.f + 100 * ((l1.docs * l1.f + 100 * l2.f) // (l1.docs + 100))) // (l0.docs + 100) + margin AS lim
  FROM l0 JOIN l1 ON l0.lk = l1.lk AND l0.rule = l1.rule JOIN l2 ON l0.rule = l2.rule),
p AS (SELECT lk, sk, max(CASE WHEN rule = 'm1' THEN lim END) AS t1, max(CASE WHEN rule = 'm2' THEN lim END) AS t2,
  max(CASE WHEN rule = 'm3' THEN lim END) AS t3, max(CASE WHEN rule = 'm4' THEN lim END) AS t4 FROM t GROUP BY lk, sk)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND m1 <= t1 AND m2 <= t2 AND m3 <= t3 AND m4 <= t4 AS kept
FROM q JOIN p ON q.lk = p.lk AND q.sk = p.sk
"""
