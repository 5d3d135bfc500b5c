"""Token-ID / binary output in patched frame-of-reference blocks (operator 10).

Documents are dealt to shards by ranges of doc_id and encoded in that order inside each task. A shard is a run
of chunks of whole documents; a chunk's payload is

    "PFR1", uint32 number of ids, uint32 number of blocks, uint32 start of each block in the payload,
    then per block of BLOCK ids (the last may be shorter):
        uint32 minimum, uint8 width, uint16 number of exceptions,
        the ids minus the minimum, packed `width` bits each, least bit first,
        uint16 place of each exception, uint32 value (minus the minimum) of each exception.

The width is the least that holds EXACT_SHARE of a block's values; the others are exceptions, and their packed
bits are the low ones. All integers are little-endian. Payloads are rows of a Parquet table in the shared
folder, so that Spark's own commit covers lost executors; the row also names the chunk's documents, their
lengths and the chunk's first id within its shard, and a block can be read by its start alone.

Defined results: a null or empty text is the end id alone; rows that share a doc_id follow each other in the
order of their text's hash; null ids come first; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ship, small_join, table
from .encoding import encoder, in_groups

BLOCK, CHUNK_IDS, EXACT_SHARE, END_ID = 4096, 65_536, 0.9, 2
FILES = "shard int, chunk int, first long, doc_ids array<long>, lengths array<long>, payload binary"
INDEX = "doc_id long, start long, n_tokens long, ids_crc32 long"


def pack_block(ids) -> bytes:
    """One block of up to BLOCK unsigned 32-bit ids."""
    import numpy as np

    low = int(ids.min())
    rest = (ids - np.uint32(low)).astype("<u4")
    at = int(np.ceil(EXACT_SHARE * len(rest))) - 1
    width = int(np.partition(rest, at)[at]).bit_length()
    bits = np.unpackbits(_bytes_of(rest, width), axis=1, bitorder="little")[:, :width]
    out = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, int)
    head = np.array([low], "<u4").tobytes() + bytes([width]) + np.array([len(out)], "<u2").tobytes()
    return head + np.packbits(bits.ravel(), bitorder="little").tobytes() + out.astype("<u2").tobytes() + rest[out].astype("<u4").tobytes()


def _bytes_of(values, width: int):
    """Low bytes of each value, as many as `width` bits need, one row a value."""
    import numpy as np

    kind = "<u2" if width <= 16 else "<u4"
    return values.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize)


def unpack_block(data: bytes, at: int, count: int):
    """The `count` ids of the block that starts at `at`."""
    import numpy as np

    low = int.from_bytes(data[at : at + 4], "little")
    width, n_out = data[at + 4], int.from_bytes(data[at + 5 : at + 7], "little")
    at += 7
    size = (count * width + 7) // 8
    kind = "<u2" if width <= 16 else "<u4"
    values = np.zeros((count, 8 * np.dtype(kind).itemsize), np.uint8)
    if width:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), bitorder="little", count=count * width)
        values[:, :width] = bits.reshape(count, width)
    ids = np.packbits(values, axis=1, bitorder="little").view(kind).ravel().astype("<u4")
    at += size
    places = np.frombuffer(data, "<u2", n_out, at)
    ids[places] = np.frombuffer(data, "<u4", n_out, at + 2 * n_out)
    return ids + np.uint32(low)


def pack_chunk(ids) -> bytes:
    """A chunk's payload."""
    import numpy as np

    blocks = [pack_block(ids[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)]
    starts = 12 + 4 * len(blocks) + np.cumsum([0, *map(len, blocks)])[:-1]
    return b"PFR1" + np.array([len(ids), len(blocks), *starts], "<u4").tobytes() + b"".join(blocks)


def unpack_chunk(data: bytes):
    """All ids of a payload."""
    import numpy as np

    if data[:4] != b"PFR1":
        raise ValueError("not a patched frame-of-reference chunk")
    total, blocks = np.frombuffer(data, "<u4", 2, 4).tolist()
    starts = np.frombuffer(data, "<u4", blocks, 12).tolist()
    parts = [unpack_block(data, s, min(BLOCK, total - i * BLOCK)) for i, s in enumerate(starts)]
    return np.concatenate(parts) if parts else np.zeros(0, "<u4")


def _write(vocabulary: str, end_id: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        shard, chunk, first = TaskContext.get().partitionId(), 0, 0
        enc = encoder(vocabulary)
        end, size = np.array([end_id], enc.kind).tobytes(), np.dtype(enc.kind).itemsize
        names = [x.split()[0] for x in FILES.split(", ")]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]

        def row(docs):
            ids = np.frombuffer(b"".join(d[1] for d in docs), enc.kind).astype("<u4", copy=False)
            values = [shard, chunk, first, [d[0] for d in docs], [len(d[1]) // size for d in docs], pack_chunk(ids)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names), len(ids)

        def encoded():
            for b in batches:
                rows = zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist())
                for group in in_groups(rows, lambda r: len(r[1] or "")):
                    for (doc, _), data in zip(group, enc.texts([t or "" for _, t in group])):
                        yield doc, data + end

        for docs in in_groups(encoded(), lambda d: len(d[1]) // size, CHUNK_IDS):
            out, n = row(docs)
            yield out
            chunk, first = chunk + 1, first + n

    return run


def write_ids(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = END_ID) -> DataFrame:
    """Encode `docs` (doc_id, text) in ascending doc_id order and write the chunk table; returns it as read back."""
    ship(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    dealt = rows.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    return table(dealt.mapInArrow(_write(vocabulary, end_id), FILES), "token-ids")


def _read(end_id: int):
    def run(batches):
        for b in batches:
            yield from _documents(b, end_id)

    return run


def _documents(b, end_id: int):
    import numpy as np
    import pyarrow as pa

    for base, first, docs, lengths, payload in zip(*(b.column(c).to_pylist() for c in ("base", "first", "doc_ids", "lengths", "payload"))):
        ids = unpack_chunk(payload).astype("<u4", copy=False)
        ends = np.cumsum(lengths)
        if ends[-1] != len(ids) or (ids[ends - 1] != end_id).any():
            raise ValueError("the lengths beside a chunk disagree with its ids")
        data, at = ids.tobytes(), 0
        starts = base + first + np.concatenate([[0], ends[:-1]]).astype("int64")
        sums = []
        for n in lengths:
            sums.append(zlib.crc32(data[4 * at : 4 * (at + n)]))
            at += n
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())], [x.split()[0] for x in INDEX.split(", ")])


def read_index(files: DataFrame, end_id: int = END_ID) -> DataFrame:
    """Per document of a chunk table: doc_id, start, n_tokens and the crc32 of its ids, from the payloads; each
    document must end with `end_id` where its noted length says.

    A shard's base is the sum of the shards before it; shards are as many as the tasks that wrote them."""
    shards = files.groupBy("shard").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = table(shards.select("shard", before.alias("base")), "token-shards")
    return small_join(files, bases, ["shard"]).mapInArrow(_read(end_id), INDEX)


def op10(spark, sf_dir: str) -> DataFrame:
    """Query: the index of all documents' ids, from the written files."""
    return read_index(write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet")))
