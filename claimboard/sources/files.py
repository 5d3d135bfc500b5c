"""Readers and writers of the catalogue's files. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tables import ship, written

# Document schema, key format, file cap.
SIDE = "struct<value:int,confidence:string,witness:array<int>,witness_provenance:struct<found_by:array<string>,date:string,found_at_samples:bigint,survived_samples:bigint,tool:string,seeds:array<bigint>>>"
BASIS = "struct<value:int,confidence:string,witness:array<int>>"
SUBMISSION = (
    "schema_version string, name string, code_type string, n int, k int, checks struct<X:array<array<int>>,Z:array<array<int>>>, "
    f"distance struct<d:int,X:{SIDE},Z:{SIDE}>, "
    "locality struct<coordinates:array<array<double>>,layers:int,interaction_radius:double,contributed_by:struct<by:array<string>,date:string,method:string>>, "
    "provenance struct<authors:array<string>,construction:string,references:array<string>,date:string,notes:string,origin:string,novelty:string,model:string>, "
    f"family string, circuit struct<d_circ:struct<X:{BASIS},Z:{BASIS}>,rounds:int,stim_version:string,notes:string,ancilla_coordinates:array<array<double>>>"
)
CERTIFICATE = "name string, d int, solver string, sides map<string,struct<value:int,exact:boolean,note:string>>, d_exact boolean"
KEY, MOST_BYTES = "^[a-z0-9]+(-[a-z0-9]+)*$", 5_000_000
#: Bytes of a file that one row may hold, and of a chunk of a larger file.
WHOLE_BYTES, CHUNK_BYTES = 1 << 28, 1 << 22
#: Files and bytes that a task hashes, listed files of a batch, and tasks that list subfolders.
TASK_FILES, TASK_BYTES, BATCH_FILES, MOST_LISTERS = 4096, 1 << 28, 10_000, 256


def _stem(column: str = "_metadata.file_name"):
    return F.regexp_replace(F.col(column), "\\.[^.]*$", "")


def judged(raw: DataFrame, key=None) -> DataFrame:
    """Documents as read with `_corrupt`, with their key and `problem` (null if the document may be used)."""
    empty = F.col("n").isNull() & F.col("checks").isNull() & F.col("name").isNull()
    problem = F.when(~F.col("key").rlike(KEY), F.lit("unsafe key")).when(F.col("_corrupt").isNotNull() | empty, F.lit("malformed document"))
    return raw.select("*", (_stem() if key is None else key).alias("key")).withColumn("problem", problem).drop("_corrupt")


def read_submissions(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row per JSON document: all fields, key, `problem` (null if the document may be used).

    Malformed documents are rows with a problem and without fields. So are files over `most_bytes`, which are left out
    of the listing by their size and never opened."""
    options = {"multiLine": True, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    raw = spark.read.schema(SUBMISSION + ", _corrupt string").options(**options, pathGlobFilter="*.json").json(path).filter(F.col("_metadata.file_size") <= most_bytes)
    return judged(raw).unionByName(_oversized(spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path), most_bytes), allowMissingColumns=True)


def _path_key():
    return F.regexp_replace(F.element_at(F.split("path", "/"), -1), "[.][^.]*$", "").alias("key")


def _oversized(listed: DataFrame, most_bytes: int) -> DataFrame:
    """(key, problem) of listed files over the cap; only names and sizes are read."""
    large = listed.filter(F.col("length") > most_bytes).select(_path_key())
    return large.withColumn("problem", F.when(~F.col("key").rlike(KEY), F.lit("unsafe key")).otherwise(F.lit("file too large")))


def stream_submissions(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES, files_a_batch: int = 1000) -> DataFrame:
    """The stream of what read_submissions() reads: one row per new JSON document, `files_a_batch` files at a time.

    Files come through the listing of the binary source, whose filter on the size keeps larger ones closed; these are
    reported by a second stream over the same folder, which reads names and sizes only."""
    listing = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").options(pathGlobFilter="*.json", maxFilesPerTrigger=files_a_batch)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    small = listing.load(path).filter(F.col("length") <= most_bytes).select(_path_key(), F.from_json(F.decode("content", "UTF-8"), SUBMISSION + ", _corrupt string", options).alias("d"))
    return judged(small.select("d.*", F.col("key").alias("_key")), F.col("_key")).drop("_key").unionByName(_oversized(listing.load(path), most_bytes), allowMissingColumns=True)


def split_quarantine(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable documents, quarantine of key and problem)."""
    return docs.filter("problem IS NULL").drop("problem"), docs.filter("problem IS NOT NULL").select("key", "problem")


def read_certs(spark: SparkSession, path: str) -> DataFrame:
    """Certificates by key; unreadable ones are absent."""
    raw = spark.read.schema(CERTIFICATE).options(multiLine=True, mode="DROPMALFORMED", pathGlobFilter="*.json").json(path)
    return raw.select(_stem().alias("key"), "*").filter("d IS NOT NULL")


def read_texts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(key, file, text) of whole text files."""
    return spark.read.option("pathGlobFilter", glob).text(path, wholetext=True).select(_stem().alias("key"), F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def front_matter(docs: DataFrame, keys: list[str], text: str = "text", file: str = "file") -> DataFrame:
    """Adds one column per key of a leading `---` block and `body`; a missing date comes from the file's name."""
    block = F.regexp_extract(text, "(?s)^\\s*---\\n(.*?)\\n---\\n", 1)
    found = lambda k: F.btrim(F.trim(F.regexp_extract(block, f"(?m)^{k}[ \\t]*:[ \\t]*(.*)$", 1)), F.lit('"'))
    out = docs.withColumns({k: found(k) for k in keys if k != "date"})
    if "date" in keys:
        named = F.regexp_extract(file, "^([0-9]{4}-[0-9]{2}-[0-9]{2})", 1)
        out = out.withColumn("date", F.coalesce(F.nullif(found("date"), F.lit("")), named))
    return out.withColumn("body", F.regexp_replace(text, "(?s)^\\s*---\\n.*?\\n---\\n", ""))


def bibliography(files: DataFrame, text: str = "text") -> DataFrame:
    """(ref, seq, type, eprint, doi, url, author, title, howpublished, year) of BibTeX text; braces and a few accents
    are removed. Entries are cut at lines that begin with @."""
    entries = files.select(F.posexplode(F.filter(F.split(text, "(?m)^(?=@)"), lambda e: e.rlike("^@\\w+\\s*\\{"))).alias("seq", "entry"))
    plain = F.col("entry")
    for raw, letter in (("{\\'e}", "e"), ("\\'e", "e"), ('{\\"o}', "o"), ('\\"o', "o")):
        plain = F.replace(plain, F.lit(raw), F.lit(letter))

    def field(name: str):
        value = F.regexp_extract("plain", f"(?is)[,\\s]{name}\\s*=\\s*(?:\\{{((?:[^{{}}]|\\{{[^{{}}]*\\}})*)\\}}|([^,\\n]+))", 1)
        bare = F.regexp_extract("plain", f"(?is)[,\\s]{name}\\s*=\\s*([^{{,\\n]+)", 1)
        return F.trim(F.regexp_replace(F.regexp_replace(F.when(value == "", bare).otherwise(value), "[{}]", ""), "\\s+", " ")).alias(name)

    out = entries.withColumn("plain", plain)
    return out.select(
        F.trim(F.regexp_extract("plain", "^@\\w+\\s*\\{\\s*([^,]+),", 1)).alias("ref"), "seq", F.lower(F.regexp_extract("plain", "^@(\\w+)", 1)).alias("type"),
        *(field(n) for n in ("eprint", "doi", "url", "author", "title", "howpublished", "year")),
    )


def circuit_ops(files: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """(file, line, name, arg, targets) of flat operation text; comments and blank lines are left out."""
    rows = files.select(file, F.posexplode(F.split(text, "\n")).alias("line", "raw")).withColumn("raw", F.trim(F.regexp_replace("raw", "#.*$", "")))
    rest = F.trim(F.regexp_replace("raw", "^[A-Za-z_0-9]+(?:\\([^)]*\\))?", ""))
    return rows.filter("raw <> ''").select(
        file, "line", F.regexp_extract("raw", "^([A-Za-z_0-9]+)", 1).alias("name"), F.nullif(F.regexp_extract("raw", "^[A-Za-z_0-9]+\\(([^),]*)", 1), F.lit("")).cast("double").alias("arg"),
        F.filter(F.split(rest, "\\s+"), lambda t: t != "").alias("targets"),
    )


def mechanisms(files: DataFrame, file: str = "file", text: str = "text") -> DataFrame:
    """(file, idx, p, detectors, observables) of fault-model text, numbered in file order among error lines."""
    ops = circuit_ops(files, file, text).filter("name = 'error'")
    pick = lambda letter: F.transform(F.filter("targets", lambda t: t.startswith(letter)), lambda t: F.substring(t, 2, 20).cast("int"))
    idx = F.row_number().over(W.partitionBy(file).orderBy("line")) - 1
    return ops.select(file, idx.alias("idx"), F.col("arg").alias("p"), pick("D").alias("detectors"), pick("L").alias("observables"))


def _for_arrow(path: str) -> str:
    """A folder's path as pyarrow takes it: local ones plain, as a URI would need its blanks quoted."""
    if "://" in path and not path.startswith("file:"):
        return path.rstrip("/")
    return os.path.abspath(re.sub("^file:/+", "/", path))


def _listed(system, where: str, recursive: bool):
    """(name below `where`, bytes, whether it is a folder) of what lies there; as in Spark, names that begin with `_` or `.` are hidden."""
    from pyarrow import fs

    for x in system.get_file_info(fs.FileSelector(where, recursive=recursive)):
        name = x.path[len(where.rstrip("/")) + 1 :]
        if not any(p[0] == "." or p[0] == "_" and "=" not in p for p in name.split("/")):
            yield name, x.size or 0, x.type == fs.FileType.Directory


LISTED = "name string, size long, folder boolean"


def list_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(name below the path, size) of every file, empty ones too, which Spark's file sources leave out, written. The folder
    is listed by a task, and each of its subfolders, with all below, by another; nothing is held by the driver."""
    ship(spark)
    path = _for_arrow(path)
    matches = spark.sparkContext._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern()

    def rows(found):
        import pyarrow as pa

        columns = [pa.array(c, k) for c, k in zip(map(list, zip(*found)), (pa.string(), pa.int64(), pa.bool_()))]
        return pa.RecordBatch.from_arrays(columns, ["name", "size", "folder"])

    def top(batches):
        from pyarrow import fs

        for b in batches:
            for root in b.column("path").to_pylist():
                found = list(_listed(*fs.FileSystem.from_uri(root), recursive=False))
                for at in range(0, len(found), BATCH_FILES):
                    yield rows(found[at : at + BATCH_FILES])

    def below(batches):
        from pyarrow import fs

        system, where = fs.FileSystem.from_uri(path)
        for b in batches:
            for folder in b.column("name").to_pylist():
                found = [(f"{folder}/{name}", size, False) for name, size, inner in _listed(system, f"{where.rstrip('/')}/{folder}", recursive=True) if not inner]
                for at in range(0, len(found), BATCH_FILES):
                    yield rows(found[at : at + BATCH_FILES])

    first = written(spark.createDataFrame([(path,)], "path string").coalesce(1).mapInArrow(top, LISTED), "listed-top")
    folders = first.filter("folder").select("name")
    tasks = min(max(1, folders.count()), MOST_LISTERS)
    found = first.filter("NOT folder").union(folders.repartition(tasks, "name").mapInArrow(below, LISTED))
    return written(found.filter(F.element_at(F.split("name", "/"), -1).rlike(f"(?s)^(?:{matches})$")).select("name", "size"), "listed")


def hash_files(spark: SparkSession, path: str, glob: str = "*", whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """(path, sha) of every file, written. Tasks list the folder and read the files through pyarrow's file systems: those
    over `whole_bytes` in chunks, the others at once. Names are dealt by hash, TASK_FILES of them or TASK_BYTES a task."""
    path = _for_arrow(path)
    listed = list_files(spark, path, glob)
    files, size = listed.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    shown = path if "://" in path else f"file:{path}"

    def run(batches):
        import hashlib

        import pyarrow as pa
        from pyarrow import fs

        system, where = fs.FileSystem.from_uri(path)
        for b in batches:
            names, shas = b.column("name").to_pylist(), []
            for name, size in zip(names, b.column("size").to_pylist()):
                digest = hashlib.sha256()
                with system.open_input_stream(f"{where.rstrip('/')}/{name}", compression=None) as f:
                    while chunk := f.read(CHUNK_BYTES if size > whole_bytes else size + 1):
                        digest.update(chunk)
                shas.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([pa.array([f"{shown}/{n}" for n in names], pa.string()), pa.array(shas, pa.string())], ["path", "sha"])

    tasks = max(1, -(-files // TASK_FILES), -(-size // TASK_BYTES))
    dealt = listed.repartition(max(tasks, min(files, spark.sparkContext.defaultParallelism)), "name")
    return written(dealt.mapInArrow(run, "path string, sha string"), "hashes")


def write_files(files: DataFrame, path: str) -> None:
    """Write rows (name, content) as files of a folder that all executors share; a repeated task writes the same files.
    A name may begin with a subfolder."""
    ship(files.sparkSession)

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        system, where = fs.FileSystem.from_uri(path)
        system.create_dir(where)
        made = set()
        for b in batches:
            for name, content in zip(b.column("name").to_pylist(), b.column("content").to_pylist()):
                if "/" in name and (folder := name.rpartition("/")[0]) not in made:
                    system.create_dir(f"{where}/{folder}")
                    made.add(folder)
                with system.open_output_stream(f"{where}/{name}", compression=None) as f:
                    f.write(content)
            yield pa.RecordBatch.from_arrays([b.column("name")], ["name"])

    rows = files.select("name", F.col("content").cast("binary").alias("content"))
    rows.mapInArrow(run, "name string").write.format("noop").mode("overwrite").save()


def resume_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A saved leaderboard, or an empty one where none was saved."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(schema).parquet(path) if exists else spark.createDataFrame([], schema)


def write_json(df: DataFrame, path: str, one_file: bool = False) -> None:
    """One JSON object per row; `one_file` only for summaries of a few rows."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").json(path)


def changed_files(now: DataFrame, before: DataFrame) -> DataFrame:
    """Files whose (name, mtime, size) is not among those of the last run."""
    return now.join(before, ["name", "mtime", "size"], "left_anti")
