"""Token counts by a separator scan of flat, unindexed token files (operator 4).

A flat file is one run of ids, each document closed by the end-of-document id; nothing says where documents
begin. Files are read as blocks of BLOCK_IDS ids that ignore documents. Each block is searched for separators
with one vectorised comparison; running sums and running maxima over the blocks of a file, in two levels,
give every block the ids, documents and last separator before it, which stitches documents that cross blocks.

Defined results: an empty document is a separator alone and has 0 tokens; ids after a file's last separator are
a document with complete = false; an empty file has no rows; files are independent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ship, table
from .encoding import encoder, in_groups

BLOCK_IDS, END_OF_TEXT = 16_384, 50_256
#: Blocks of a file that one task scans after the per-chunk totals are known.
CHUNK_BLOCKS = 4096
WRITTEN = "file int, block long, ids binary, first long, doc_ids array<long>"


def _write(vocabulary: str, end_id: int, block_ids: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        file, enc = TaskContext.get().partitionId(), encoder(vocabulary, True)
        end, size = np.array([end_id], enc.kind).tobytes(), block_ids * np.dtype(enc.kind).itemsize
        names = [x.split()[0] for x in WRITTEN.split(", ")]
        types = [pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64())]
        row = lambda *values: pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names)
        block, first, rest = 0, 0, b""
        for b in batches:
            rows = zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist())
            for group in in_groups(rows, lambda r: len(r[1] or "")):
                rest = b"".join([rest, *(data + end for data in enc.texts([t or "" for _, t in group]))])
                yield row(file, None, None, first, [doc for doc, _ in group])
                first += len(group)
                for at in range(0, len(rest) - size + 1, size):
                    yield row(file, block, rest[at : at + size], None, None)
                    block += 1
                rest = rest[len(rest) // size * size :]
        if rest:
            yield row(file, block, rest, None, None)

    return run


def write_flat(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = END_OF_TEXT) -> tuple[DataFrame, DataFrame]:
    """Encode `docs` (doc_id, text) into flat files, one per task: their blocks (file, block, ids) for scan(), and
    which documents they hold (file, ordinal, doc_id), which the scan does not see. Documents stand in the order in
    which the task reads them. Ids take 16 bits (`encoding.Encoder.kind`). Strings of special tokens in a text are
    encoded as ordinary text, so `end_id` only separates."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    written = table(rows.mapInArrow(_write(vocabulary, end_id, BLOCK_IDS), WRITTEN), "flat-tokens")
    held = written.filter("ids IS NULL").select("file", "first", F.posexplode("doc_ids").alias("i", "doc_id"))
    return written.filter("ids IS NOT NULL").select("file", "block", "ids"), held.select("file", (F.col("first") + F.col("i")).alias("ordinal"), "doc_id")


def _read_ranges(size: int):
    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        for b in batches:
            for path, block in zip(b.column("file").to_pylist(), b.column("block").to_pylist()):
                system, inside = fs.FileSystem.from_uri(path)
                with system.open_input_file(inside) as f:
                    f.seek(block * size)
                    data = f.read(size)
                yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([block], pa.int64()), pa.array([data], pa.binary())], ["file", "block", "ids"])

    return run


def read_flat(spark: SparkSession, path: str, block_ids: int = BLOCK_IDS, kind: str = "<u4") -> DataFrame:
    """Blocks of flat files of little-endian unsigned ids of 16 or 32 bits (`kind`), as scan() takes them; files are
    told apart by their whole path. Spark lists the files; each task reads only the byte ranges dealt to it, so files
    may be of any size. pyarrow must know the paths' file system. A part of an id at a file's end is not read."""
    width = int(kind[2:])
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), (F.col("length") / width).cast("long").alias("n"))
    ranges = files.filter("n > 0").select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block_ids))).alias("block"))
    ship(spark)
    blocks = ranges.repartition("file", "block").mapInArrow(_read_ranges(width * block_ids), "file string, block long, ids binary")
    whole = F.length("ids") - F.length("ids") % width
    return blocks.select("file", "block", F.substring("ids", F.lit(1), whole).alias("ids"))


def _scan(end_id: int, kind: str):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            n, places = [], []
            for data in b.column("ids").to_pylist():
                ids = np.frombuffer(data, kind)
                n.append(len(ids))
                places.append(np.flatnonzero(ids == end_id).astype("int32"))
            arrays = [b.column("file"), b.column("block"), pa.array(n, pa.int64()), pa.array(places, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, ["file", "block", "n", "places"])

    return run


def scan(blocks: DataFrame, end_id: int = END_OF_TEXT, kind: str = "<u4") -> DataFrame:
    """Documents of flat files (file, block, ids): file, ordinal (0-based in the file), start (place of the first id
    in the file), n_tokens (without the separator) and complete, from the ids alone."""
    ship(blocks.sparkSession)
    shape = f"file {dict(blocks.dtypes)['file']}, block long, n long, places array<int>"
    found = table(blocks.select("file", "block", "ids").mapInArrow(_scan(end_id, kind), shape), "separators")
    chunk = F.floor(F.col("block") / CHUNK_BLOCKS)
    lean = found.select("file", "block", chunk.alias("chunk"), "n", F.size("places").cast("long").alias("docs"), F.try_element_at("places", F.lit(-1)).alias("last"))

    inside = W.partitionBy("file", "chunk").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    over = W.partitionBy("file").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    tops = lean.groupBy("file", "chunk").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    tops = tops.select("file", "chunk", *(F.coalesce(F.sum(c).over(over), zero).alias(f"top_{c}") for c in ("n", "docs")))
    summed = lean.select("*", *(F.coalesce(F.sum(c).over(inside), zero).alias(f"in_{c}") for c in ("n", "docs")))
    summed = summed.join(tops.hint("merge"), ["file", "chunk"])
    base, first = F.col("in_n") + F.col("top_n"), F.col("in_docs") + F.col("top_docs")
    summed = summed.select("file", "block", "chunk", "n", base.alias("base"), first.alias("first"), (base + F.col("last") + 1).alias("after"))
    marks = summed.groupBy("file", "chunk").agg(F.max("after").alias("after"))
    marks = marks.select("file", "chunk", F.coalesce(F.max("after").over(over), zero).alias("top_after"))
    opened = F.greatest(F.coalesce(F.max("after").over(inside), zero), F.col("top_after"))
    placed = summed.join(marks.hint("merge"), ["file", "chunk"]).select("file", "block", "base", "first", opened.alias("open"))

    rows = found.join(placed.hint("merge"), ["file", "block"])
    doc = F.posexplode("places").alias("i", "place")
    ended = rows.select("file", "base", "first", "open", "places", doc)
    start = F.when(F.col("i") == 0, F.col("open")).otherwise(F.col("base") + F.get("places", F.col("i") - 1) + 1)
    ended = ended.select("file", (F.col("first") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("base") + F.col("place") - start).alias("n_tokens"), F.lit(True).alias("complete"))
    sizes = summed.groupBy("file").agg(F.max(F.col("base") + F.col("n")).alias("all"), F.max("after").alias("after"), F.max("first").alias("first"))
    docs = lean.groupBy("file").agg(F.sum("docs").alias("ordinal"))
    tail = sizes.join(docs.hint("merge"), "file").withColumn("start", F.coalesce("after", zero)).filter("`all` > start")
    tail = tail.select("file", "ordinal", "start", (F.col("all") - F.col("start")).alias("n_tokens"), F.lit(False).alias("complete"))
    return ended.unionByName(tail)


def op4(spark, sf_dir: str) -> DataFrame:
    """Query: token counts of all documents from the flat files they were written to. Counts come from the scan;
    only doc_id comes from what the writer noted."""
    blocks, held = write_flat(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = scan(blocks, kind=encoder().kind)
    return found.join(held.hint("merge"), ["file", "ordinal"], "left").select("doc_id", "n_tokens", "complete")
