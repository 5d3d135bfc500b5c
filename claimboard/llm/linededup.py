"""Line dedup by a deletion-neighbourhood join (operator 7). DataFrame functions only.

Lines are compared as lower-case words; the edit bound is one word inserted, deleted or replaced. Equal lines
collapse to their earliest occurrence first. Each remaining line emits its variants with one word deleted as
hashed keys: (length, place, variant) meets the lines that replace the same word, (length, variant) meets the
shorter line itself. Each key keeps its earliest line only, so no group emits pairs; a later line that meets an
earlier one is verified word by word and dropped. Earliest means least (doc_id, line number).

Only lines that share their first or last half with another line can lie within the bound, so a count of hashed
halves comes first and only those lines emit variants; it loses nothing.

Defined results: equal lines collapse however short they are; lines of fewer than LEAST_WORDS words have no near
copies, as one word is too much of them; lines without a word are always kept; a null text has no lines (op7
lists it with 0); rows that share a doc_id are ordered by their text's hash, and rows alike in doc_id and text are one
document, whose lines keep their first place in each such row; rows without doc_id come first; a line is dropped if any earlier line
is within the bound, whether that one is kept or not; an empty table gives an empty table; other columns are
ignored by judge() and carried by dedup().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop, fresh, let, table, words_of

#: Words that a line must have for the edit bound of one word to apply to it.
LEAST_WORDS = 4


def _lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, th, line_no, words) of all lines."""
    exploded = docs.select("doc_id", F.xxhash64(text).alias("th"), F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    return exploded.select("doc_id", "th", "line_no", F.lower("line").alias("line"))


def _halves(w: Column) -> Column:
    """Hashes of the first and last half of a line, for both half lengths that a neighbour may have."""

    def keys(n: Column) -> Column:
        sizes = F.array_distinct(F.array(F.floor(n / 2), F.floor((n - 1) / 2)).cast("array<int>"))
        return F.flatten(F.transform(sizes, lambda k: F.array(F.xxhash64(F.lit("first"), k, F.slice(w, 1, k)), F.xxhash64(F.lit("last"), k, F.slice(w, n - k + 1, k)))))

    return keys(F.size(w))


def _line_facts(lines: DataFrame) -> DataFrame:
    """Lines with length, two hashes and, where they are long enough for the edit bound, hashed halves."""
    facts = let(
        words_of(F.col("line")),
        lambda w: F.struct(F.size(w).alias("n"), F.xxhash64(w).alias("h1"), F.xxhash64(F.lit("second"), w).alias("h2"), F.when(F.size(w) >= LEAST_WORDS, _halves(w)).alias("halves")),
    )
    return lines.select("doc_id", "th", "line_no", facts.alias("f")).select("doc_id", "th", "line_no", "f.*")


def judge(docs: DataFrame) -> DataFrame:
    """Per line of `docs` (doc_id, text): doc_id, th (its text's hash), line_no, exact, near. `exact` says that an
    equal line comes earlier, `near` that an earlier line is within the bound."""
    base = docs.select("doc_id", "text")
    facts = table(_line_facts(_lines(base)), "line-facts")
    place = F.struct("doc_id", "th", "line_no")
    firsts = facts.filter("n > 0").groupBy("h1", "h2").agg(F.min(place).alias("first"), F.min("n").alias("n"), F.min("halves").alias("halves"))
    firsts = table(firsts, "line-firsts")

    halves = firsts.select("h1", "h2", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("c")).filter("c > 1").select("half")
    halves_hint = halves.join(shared.hint("merge"), "half", "left_semi").select("h1", "h2").distinct()
    near = firsts.join(halves_hint.hint("merge"), ["h1", "h2"], "left_semi").select("h1", "h2", "first.*")
    near = table(near.withColumnsRenamed({"doc_id": "d", "th": "t", "line_no": "l"}), "line-candidates", collect=True)
    here = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")) & (F.col("line_no") == F.col("l"))
    texts = _lines(base).join(near.hint("merge"), here).select("h1", "h2", place.alias("first"), words_of(F.col("line")).alias("words"))
    # a word's key at its own place and one place earlier; all but word i is the running XOR of the first kind before i
    # and, after i, the total of the second kind less its running XOR. Totals are written, else they are made per word
    zero = F.lit(0).cast("long")
    total = lambda back: F.aggregate(F.transform("words", lambda w, i: F.xxhash64(w, i - back)), zero, lambda acc, x: acc.bitwiseXOR(x))
    texts = table(texts.dropDuplicates(["h1", "h2"]).select("*", total(0).alias("whole"), total(1).alias("rest")), "line-words", collect=True)
    rows = texts.select("h1", "h2", "first", F.size("words").alias("n"), "whole", "rest", F.posexplode("words").alias("i", "w"))
    rows = rows.select("h1", "h2", "first", "n", "whole", "rest", "i", F.xxhash64("w", "i").alias("a"), F.xxhash64("w", F.col("i") - 1).alias("b"))
    upto = W.partitionBy("h1", "h2").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.select(
        "h1", "h2", "first", "n", "i", "whole",
        F.bit_xor("a").over(upto).bitwiseXOR(F.col("a")).alias("head"),
        F.bit_xor("b").over(upto).bitwiseXOR(F.col("rest")).alias("tail"),
    )
    variant = F.col("head").bitwiseXOR(F.col("tail"))
    key = lambda kind, m, at, x, role: F.struct(F.lit(kind).alias("kind"), m.alias("m"), at.alias("at"), x.alias("x"), F.lit(role).alias("role"))
    nowhere = F.lit(-1)
    emitted = F.array(key("r", F.col("n"), F.col("i"), variant, "r"), key("d", F.col("n") - 1, nowhere, variant, "v"))
    own = F.array(key("d", F.col("n"), nowhere, F.col("whole"), "s"))
    keys = rows.select("h1", "h2", "first", "i", F.explode(F.when(F.col("i") == 0, F.concat(emitted, own)).otherwise(emitted)).alias("k")).select("h1", "h2", "first", "i", "k.*")
    keys = table(keys, "line-keys", collect=True)

    best = keys.groupBy("kind", "m", "at", "x").agg(
        F.count("*").alias("c"),
        F.min(F.when(F.col("role") != "v", F.struct("first", "i", "h1", "h2"))).alias("plain"),
        F.min(F.when(F.col("role") == "v", F.struct("first", "i", "h1", "h2"))).alias("longer"),
    )
    best = best.filter("c > 1")
    met = keys.join(best.hint("merge"), ["kind", "m", "at", "x"])
    other = F.when(F.col("role") == "s", F.col("longer")).otherwise(F.col("plain"))
    met = met.withColumn("other", other).filter(F.col("other").isNotNull() & (F.col("other.first") < F.col("first")))
    met = met.select("h1", "h2", "role", "i", F.col("other.h1").alias("o1"), F.col("other.h2").alias("o2"), F.col("other.i").alias("j")).distinct()
    met = table(met, "line-met", collect=True)
    drop(keys, near)
    mine, theirs = texts.select("h1", "h2", F.col("words").alias("p")), texts.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), F.col("words").alias("q"))
    pairs = met.join(mine.hint("merge"), ["h1", "h2"]).join(theirs.hint("merge"), ["o1", "o2"])
    without = lambda w, i: F.concat(F.slice(w, F.lit(1), i), F.slice(w, i + 2, F.size(w)))
    within = (
        F.when(F.col("role") == "r", without(F.col("p"), F.col("i")) == without(F.col("q"), F.col("i")))
        .when(F.col("role") == "v", without(F.col("p"), F.col("i")) == F.col("q"))
        .otherwise(F.col("p") == without(F.col("q"), F.col("j")))
    )
    dropped = table(pairs.filter(within).select("h1", "h2").distinct(), "line-dropped")
    drop(met, texts)

    firsts_known = firsts.select("h1", "h2", "first").join(dropped.withColumn("near", F.lit(True)).hint("merge"), ["h1", "h2"], "left")
    out = facts.select("doc_id", "th", "line_no", "n", "h1", "h2").join(firsts_known.hint("merge"), ["h1", "h2"], "left")
    earlier = F.coalesce(F.col("first") != F.struct("doc_id", "th", "line_no"), F.lit(False))
    return out.select("doc_id", "th", "line_no", earlier.alias("exact"), F.coalesce("near", F.lit(False)).alias("near"))


def dedup(docs: DataFrame) -> DataFrame:
    """`docs` with the dropped lines taken out of their texts, all other columns as they are."""
    id_, th, gone = fresh(docs, "_id"), fresh(docs, "_th"), fresh(docs, "_gone")
    dropped = judge(docs).filter("exact OR near").groupBy(F.col("doc_id").alias(id_), F.col("th").alias(th)).agg(F.collect_set("line_no").alias(gone))
    keyed = docs.withColumns({id_: F.col("doc_id"), th: F.xxhash64("text")})
    joined = keyed.join(dropped.hint("merge"), keyed[id_].eqNullSafe(dropped[id_]) & (keyed[th] == dropped[th]), "left")
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(gone, i))
    return joined.select(*(F.when(F.col(gone).isNull(), keyed["text"]).otherwise(F.array_join(kept, "\n")).alias("text") if c == "text" else keyed[c] for c in docs.columns))


def op7(spark, sf_dir: str) -> DataFrame:
    """Query: per document the lines, those dropped and a digest of the kept lines' numbers."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    numbers = lambda condition: F.collect_set(F.when(condition, F.col("line_no")))
    dropped = F.col("exact") | F.col("near")
    # sets, so that rows which repeat a document do not count its lines again
    by_doc = judge(docs).groupBy("doc_id", "th").agg(
        (F.max("line_no") + 1).cast("long").alias("n_lines"), F.size(numbers(F.col("exact"))).cast("long").alias("n_exact"),
        F.size(numbers(F.col("near") & ~F.col("exact"))).cast("long").alias("n_near"), F.sort_array(numbers(~dropped)).alias("kept"),
    ).drop("th")
    nothing = F.lit(0).cast("long")
    empty = docs.filter("text IS NULL").select("doc_id").distinct().select("doc_id", nothing.alias("n_lines"), nothing.alias("n_exact"), nothing.alias("n_near"), F.array().cast("array<int>").alias("kept"))
    return by_doc.unionByName(empty).withColumn("kept_sha256", F.sha2(F.array_join(F.col("kept").cast("array<string>"), ","), 256)).drop("kept")


OP7_SQL = """
WITH d AS (SELECT DISTINCT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, text, i - 1 AS line_no, list_filter(regexp_split_to_array(lower(ls[i]), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM d, unnest(range(1, len(ls) + 1)) AS u(i)),
f AS (SELECT ws, min({'d': doc_id, 'l': line_no}) AS first FROM l WHERE len(ws) > 0 GROUP BY ws),
b AS (SELECT * FROM f WHERE len(ws) >= 4),
v AS (SELECT ws, first, len(ws) AS n, i, ws[1 : i - 1] || ws[i + 1 : len(ws)] AS x FROM b, unnest(range(1, len(ws) + 1)) AS u(i)),
r AS (SELECT ws FROM (SELECT ws, first, min(first) OVER (PARTITION BY n, i, x) AS best FROM v) WHERE best < first),
s AS (SELECT v.ws FROM v JOIN b ON v.x = b.ws WHERE b.first < v.first UNION SELECT b.ws FROM v JOIN b ON v.x = b.ws WHERE v.first < b.first),
g AS (SELECT ws FROM r UNION SELECT ws FROM s),
j AS (SELECT l.doc_id, l.text, l.line_no, coalesce(f.first <> {'d': l.doc_id, 'l': l.line_no}, false) AS exact, g.ws IS NOT NULL AS near
  FROM l LEFT JOIN f ON l.ws = f.ws LEFT JOIN g ON l.ws = g.ws),
k AS (SELECT doc_id, text, count(*) AS n_lines, count(*) FILTER (exact) AS n_exact, count(*) FILTER (near AND NOT exact) AS n_near,
  string_agg(line_no::VARCHAR, ',' ORDER BY line_no) FILTER (NOT exact AND NOT near) AS kept FROM j GROUP BY doc_id, text)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_exact, 0)::BIGINT AS n_exact, coalesce(n_near, 0)::BIGINT AS n_near, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id IS NOT DISTINCT FROM d.doc_id AND k.text = d.text
"""
