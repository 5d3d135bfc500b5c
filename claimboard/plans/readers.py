"""Queries over files: each writes files from a given table, reads them back and returns what was read (families A, S)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import numbered, shared_dir
from ..sources import files
from ..streaming import incremental
from .base import E_SQL, EXACT_E_SQL, entries, query, t


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _saved(spark, rows: DataFrame, name: str) -> str:
    """A folder of files (name, content) written from `rows`."""
    path = _folder(spark, name)
    files.write_files(rows, path)
    return path


# ---- A1 to A3, S3: per supplier a document; every tenth is over the cap, every seventh broken, every ninth misnamed

CAP = 3000
DOC_SQL = """sd AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 9 = 0 THEN 'S_' ELSE 's-' END || s_suppkey AS key, s_suppkey % 7 = 0 AS broken, s_suppkey % 10 = 0 AS large, s_name AS name, s_nationkey + 3 AS n, s_suppkey % 4 AS k FROM supplier),
  sp AS (SELECT *, CASE WHEN id % 9 = 0 THEN 'unsafe key' WHEN large THEN 'file too large' WHEN broken THEN 'malformed document' END AS problem FROM sd)"""


def _documents(spark, sf) -> str:
    s = t(spark, sf, "supplier").repartition("s_suppkey")  # a small table of many files is one partition as it is read
    key = F.concat(F.when(F.col("s_suppkey") % 9 == 0, "S_").otherwise("s-"), F.col("s_suppkey").cast("string"))
    nested = F.to_json(F.struct(
        F.col("s_name").alias("name"), (F.col("s_nationkey") + 3).alias("n"), (F.col("s_suppkey") % 4).alias("k"),
        F.struct(F.array(F.array(F.col("s_nationkey"), F.col("s_nationkey") + 1)).alias("X"), F.array(F.array(F.lit(0))).alias("Z")).alias("checks"),
        F.struct(F.when(F.col("s_suppkey") % 10 == 0, F.repeat(F.lit("n"), CAP)).otherwise("short").alias("notes")).alias("provenance"),
    ))
    # broken documents end early, or are a list in place of an object
    text = F.when(F.col("s_suppkey") % 14 == 0, F.lit("[1, 2]")).when((F.col("s_suppkey") % 7 == 0) & (F.col("s_suppkey") % 10 != 0), F.substring(nested, 1, 25)).otherwise(nested)
    text = F.when((F.col("s_suppkey") % 14 == 0) & (F.col("s_suppkey") % 10 == 0), F.rpad(text, CAP + 10, " ")).otherwise(text)
    return _saved(spark, s.select(F.concat(key, F.lit(".json")).alias("name"), text.alias("content")), "documents")


@query("a1_read_submissions", f"WITH {DOC_SQL} SELECT key, name, n, k, '[[' || (n - 3) || ',' || (n - 2) || ']]' AS x FROM sp WHERE problem IS NULL")
def _(spark, sf):
    good, _ = files.split_quarantine(files.read_submissions(spark, _documents(spark, sf), CAP))
    return good.select("key", "name", F.col("n").cast("long").alias("n"), F.col("k").cast("long").alias("k"), F.to_json("checks.X").alias("x"))


@query("a2_size_capped", f"WITH {DOC_SQL} SELECT key FROM sp WHERE problem = 'file too large'")
def _(spark, sf):
    _, bad = files.split_quarantine(files.read_submissions(spark, _documents(spark, sf), CAP))
    return bad.filter("problem = 'file too large'").select("key")


@query("a3_quarantine", f"WITH {DOC_SQL} SELECT key, problem FROM sp WHERE problem IS NOT NULL")
def _(spark, sf):
    _, bad = files.split_quarantine(files.read_submissions(spark, _documents(spark, sf), CAP))
    return bad


#: Files of a micro-batch at least, and batches that the intake takes at most beyond that.
LEAST_FILES, MOST_BATCHES = 20, 16


def _files_a_batch(files: int) -> int:
    return max(LEAST_FILES, -(-files // MOST_BATCHES))


@query("s3_streaming_intake", f"WITH {DOC_SQL} SELECT key, problem, CASE WHEN NOT broken AND NOT large THEN name END AS name, CASE WHEN NOT broken AND NOT large THEN n END AS n FROM sp")
def _(spark, sf):
    """The same documents in micro-batches of at most 20 files, or of a sixteenth of the files where these are more, so
    that the number of batches doesn't grow with the files."""
    path, base = _documents(spark, sf), _folder(spark, "intake")
    stream = incremental.intake(spark, path, CAP, _files_a_batch(t(spark, sf, "supplier").count())).select("key", "problem", "name", F.col("n").cast("long").alias("n"))

    def save(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")

    stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("epoch")


@query("a4_read_certs", "SELECT 'c-' || s_suppkey AS key, s_nationkey AS d, s_nationkey % 2 = 0 AS d_exact, s_nationkey + 1 AS x FROM supplier WHERE s_suppkey % 5 <> 0 AND s_suppkey % 6 <> 0")
def _(spark, sf):
    s = t(spark, sf, "supplier")
    nested = F.to_json(F.struct(
        F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 6 != 0, F.col("s_nationkey")).alias("d"), F.lit("solver").alias("solver"),
        F.create_map(F.lit("X"), F.struct((F.col("s_nationkey") + 1).alias("value"), F.lit(True).alias("exact"), F.lit("").alias("note"))).alias("sides"), (F.col("s_nationkey") % 2 == 0).alias("d_exact"),
    ))
    text = F.when(F.col("s_suppkey") % 5 == 0, F.substring(nested, 1, 30)).otherwise(nested)
    path = _saved(spark, s.select(F.concat(F.lit("c-"), F.col("s_suppkey").cast("string"), F.lit(".json")).alias("name"), text.alias("content")), "certs")
    return files.read_certs(spark, path).select("key", F.col("d").cast("long").alias("d"), "d_exact", F.col("sides")["X"]["value"].cast("long").alias("x"))


# ---- A7 to A9, A12: texts


@query("a7_bibliography", """SELECT 'p' || p_partkey AS ref, CASE WHEN p_partkey % 2 = 0 THEN 'article' ELSE 'misc' END AS type, p_name AS title, 'Poincare, ' || p_brand || ' and Godel, K.' AS author,
  CASE WHEN p_partkey % 3 = 0 THEN '10.1000/' || p_partkey || '.X' ELSE '' END AS doi, CASE WHEN p_partkey % 2 = 1 THEN (2000 + p_partkey % 500) || '.' || (10000 + p_partkey) ELSE '' END AS eprint, (1990 + p_size)::VARCHAR AS year FROM part""")
def _(spark, sf):
    """One file per brand with an entry per part."""
    p, k = t(spark, sf, "part"), F.col("p_partkey").cast("string")
    even = F.col("p_partkey") % 2 == 0
    entry = F.concat(
        F.when(even, F.lit("@Article{p")).otherwise(F.lit("@misc { p")), k, F.lit(",\n  title = {{"), F.col("p_name"), F.lit("}},\n  author = {Poincar{\\'e}, "), F.col("p_brand"), F.lit(' and G{\\"o}del, K.},\n'),
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("  DOI = {10.1000/"), k, F.lit(".X},\n"))).otherwise(""),
        F.when(~even, F.concat(F.lit("  eprint = {"), (2000 + F.col("p_partkey") % 500).cast("string"), F.lit("."), (10000 + F.col("p_partkey")).cast("string"), F.lit("},\n"))).otherwise(""),
        F.lit("  year = "), (1990 + F.col("p_size")).cast("string"), F.lit("\n}\n"),
    )
    texts = p.groupBy(F.concat(F.regexp_replace("p_brand", "#", "-"), F.lit(".bib")).alias("name")).agg(F.array_join(F.collect_list(entry), "\n").alias("content"))
    read = files.bibliography(files.read_texts(spark, _saved(spark, texts, "bibliography"), "*.bib"))
    return read.select("ref", "type", "title", "author", "doi", "eprint", "year")


OPS_SQL = "ol AS (SELECT l_suppkey AS file, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS seq, l_linenumber % 3 AS kind, l_partkey % 50 AS a, l_orderkey % 9 AS b, l_quantity::BIGINT AS q FROM lineitem)"


def _operations(spark, sf) -> DataFrame:
    """(file, text): per supplier a text with an operation per line item, between comments and blank lines."""
    line = t(spark, sf, "lineitem")
    a, b = (F.col("l_partkey") % 50).cast("string"), (F.col("l_orderkey") % 9).cast("string")
    op = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("CX "), a, F.lit(" "), b)).when(F.col("l_linenumber") % 3 == 1, F.concat(F.lit("error(0."), F.col("l_quantity").cast("long").cast("string"), F.lit(") D"), a, F.lit(" L"), b))
    op = F.concat(op.otherwise(F.concat(F.lit("  M "), a, F.lit("  # measured"))), F.lit("\n# note\n"))
    listed = F.sort_array(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", op.alias("op"))))
    text = F.array_join(F.transform(listed, lambda x: x["op"]), "\n")
    rows = line.groupBy(F.concat(F.lit("s"), F.col("l_suppkey").cast("string"), F.lit(".txt")).alias("name")).agg(text.alias("content"))
    return files.read_texts(spark, _saved(spark, rows, "operations"), "*.txt").withColumn("file", F.substring("key", 2, 20).cast("long"))


@query("a8_circuit_operations", f"WITH {OPS_SQL} SELECT file, 3 * seq AS line, CASE kind WHEN 0 THEN 'CX' WHEN 1 THEN 'error' ELSE 'M' END AS name, CASE WHEN kind = 1 THEN ('0.' || q)::DOUBLE END AS arg, CASE kind WHEN 0 THEN a || ' ' || b WHEN 1 THEN 'D' || a || ' L' || b ELSE a::VARCHAR END AS targets FROM ol")
def _(spark, sf):
    return files.circuit_ops(_operations(spark, sf)).select("file", F.col("line").cast("long").alias("line"), "name", "arg", F.array_join("targets", " ").alias("targets"))


@query("a9_mechanisms", f"WITH {OPS_SQL} SELECT file, row_number() OVER (PARTITION BY file ORDER BY seq) - 1 AS idx, ('0.' || q)::DOUBLE AS p, a AS detector, b AS observable FROM ol WHERE kind = 1")
def _(spark, sf):
    out = files.mechanisms(_operations(spark, sf))
    return out.select("file", F.col("idx").cast("long").alias("idx"), "p", F.get("detectors", F.lit(0)).cast("long").alias("detector"), F.get("observables", F.lit(0)).cast("long").alias("observable"))


@query("a12_hash_files", "SELECT 'd' || doc_id || '.txt' AS name, sha256(coalesce(text, '')) AS sha FROM documents")
def _(spark, sf):
    """Texts as files, a row each, in subfolders of at most 4,096; those over 20,000 bytes are hashed in chunks. The number
    before a file's name keeps rows of one doc_id apart."""
    docs = t(spark, sf, "documents").select(F.monotonically_increasing_id().alias("at"), F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.coalesce("text", F.lit("")).alias("content"))
    name = F.concat(F.shiftright("at", 12).cast("string"), F.lit("/"), F.col("at").cast("string"), F.lit("-"), F.coalesce("name", F.lit("")))
    found = files.hash_files(spark, _saved(spark, docs.select(name.alias("name"), "content"), "hashed"), whole_bytes=20_000)
    return found.select(F.nullif(F.regexp_extract("path", "/[0-9]+-([^/]*)$", 1), F.lit("")).alias("name"), "sha")


# ---- A13, A16: saved state and feeds


@query("a13_resume_state", f"WITH {E_SQL} SELECT key, n, eff, 1 AS run FROM e WHERE key % 2 = 0")
def _(spark, sf):
    """The first run finds no state; what it saves is there for the second."""
    path, schema = _folder(spark, "resume"), "key long, n long, eff double, run int"
    before = files.resume_state(spark, path, schema)
    found = entries(spark, sf).filter("key % 2 = 0").select("key", "n", "eff", F.lit(1).alias("run"))
    before.unionByName(found).write.parquet(path)
    return files.resume_state(spark, path, schema)


@query("a16_feeds", f"WITH {EXACT_E_SQL}, r AS (SELECT key, n, k, d, eff, row_number() OVER (ORDER BY eff DESC, k DESC, d DESC, n, key) AS place FROM e) SELECT key, n, k, d, eff, place FROM r")
def _(spark, sf):
    """Chart rows written as JSON lines and read back."""
    path = _folder(spark, "feed")
    order = [F.desc("eff"), F.desc("k"), F.desc("d"), F.asc("n"), F.asc("key")]
    files.write_json(numbered(entries(spark, sf), order, "place").select("key", "n", "k", "d", "eff", "place"), path)
    return spark.read.schema("key long, n long, k long, d long, eff double, place long").json(path)
