"""Alignment of two tokenizers' ids on the same bytes (operator 12).

Tokenizer A (byte-level BPE) encodes a space and the text; tokenizer B (pieces with byte fallback) the text, before which
it puts that space itself. Byte offsets at which tokens of both end cut the tokens into groups; every A and B token of
a group are linked.

Each batch is worked on as Arrow columns: the documents' id lists are flattened beside their parent indices, token
lengths become end offsets by a cumulative sum per document, an Acero hash join on (document, end) finds the common
ends, sums over those number the groups, and a second join on the group makes the links. Groups of more than
LINKS_APART links first count their equal ids on either side, so a long stretch without a common end makes as many rows
as it has different id pairs, not tokens squared. Table.group_by counts links per document and pair, and documents per
pair and block; Spark merges the partial counts of all blocks. A block (about BLOCK_PAIRS pairs of consecutive
documents) gets back the counts of the pairs it lists, never the whole table, and its documents' links are summed up.

Defined results: null and empty texts, and texts that a tokenizer doesn't give back byte for byte (such as those with
U+2581), have no tokens: zeros and an empty hash. Strings of special tokens are plain text. Repeated rows are documents
of their own; doc_id may be null; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, table
from .encoding import MEMO_CHARS, MEMO_PIECES, encoder, in_groups, vocabulary_path

VOCABULARY_A, MODEL_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Links of a group from which equal ids are counted before they are paired.
LINKS_APART = 64
#: Document-pair entries of a block.
BLOCK_PAIRS = 2_000_000
#: Characters that are aligned in one step.
STEP_CHARS = 400_000
#: An id pair as one number: a * ID_RANGE + b.
ID_RANGE = 1 << 21

GATHERED = "kind int, block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, slots array<int>, times array<int>, slot int, pair long, n long"
DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
GROUPS = "doc_id long, start long, stop long, a_ids array<int>, b_ids array<int>"
_CHUNKS = re.compile(" +[^ ]*")
_sides: dict = {}


class PieceEncoder(dict):
    """Ids of sentence pieces, and a bounded memo of the ids of chunks (spaces and what follows them).

    No piece has a space mark after another character, so pieces never join across the start of a chunk and a text's
    ids are its chunks' ids in a row. A model with other pieces is asked for whole texts."""

    def __init__(self, model: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(model))
        self.pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.whole = any("▁" in p.lstrip("▁") for p in self.pieces)
        self.mark = self.model.piece_to_id("▁")

    def _ids(self, ids) -> bytes:
        import numpy as np

        return np.array(ids, "<u4").tobytes()

    def __missing__(self, chunk: str) -> bytes:
        ids = self._ids([self.mark] if chunk == " " else self.model.encode(chunk[1:]))
        if len(chunk) <= MEMO_CHARS:
            self[chunk] = ids
        return ids

    def texts(self, texts: list[str]) -> list[bytes]:
        if self.whole:
            return [self._ids(x) for x in self.model.encode(texts, num_threads=1)]
        if len(self) > MEMO_PIECES:
            self.clear()
        find = self.__getitem__
        return [b"".join(map(find, _CHUNKS.findall(" " + t))) for t in texts]

    def token_bytes(self) -> list[bytes]:
        return [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(self.pieces)]


class _Side:
    """One tokenizer: how it encodes, and per id its bytes, their number, and its decimal form."""

    def __init__(self, encode, tokens: list[bytes]):
        import numpy as np
        import pyarrow as pa

        self.encode = encode
        self.bytes = pa.array(tokens, pa.large_binary())
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.text = pa.array([str(i) for i in range(len(tokens))])


def sides(vocabulary_a: str = VOCABULARY_A, model_b: str = MODEL_B):
    """This worker's two tokenizers."""
    import numpy as np

    if (vocabulary_a, model_b) not in _sides:
        enc, pieces = encoder(vocabulary_a, plain_specials=True), PieceEncoder(model_b)
        byte_of = {c: b for b, c in enumerate(enc.names)}
        names = [enc.tokenizer.id_to_token(i) or "" for i in range(enc.tokenizer.get_vocab_size())]
        tokens = [bytes(byte_of[c] for c in x) if all(c in byte_of for c in x) else x.encode() for x in names]
        a = _Side(lambda ts: [np.frombuffer(x, enc.kind) for x in enc.texts([" " + t for t in ts])], tokens)
        b = _Side(lambda ts: [np.frombuffer(x, "<u4") for x in pieces.texts(ts)], pieces.token_bytes())
        _sides[vocabulary_a, model_b] = a, b
    return _sides[vocabulary_a, model_b]


class Step:
    """Texts of one step, aligned: per document the numbers of ids (`n`), per token its document, id, end and group."""

    def __init__(self, texts: list, a: _Side, b: _Side):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        self.sides, asked = (a, b), [i for i, t in enumerate(texts) if t]
        ids = [side.encode([texts[i] for i in asked]) for side in (a, b)]
        good = self._same_bytes([b" " + texts[i].encode() for i in asked], ids)
        self.n, self.doc, self.id, self.end = [], [], [], []
        for side, mine in zip((a, b), ids):
            n = np.zeros(len(texts), np.int64)
            for i, ok, x in zip(asked, good, mine):
                n[i] = len(x) if ok else 0
            flat = np.concatenate([x for x, ok in zip(mine, good) if ok] or [np.zeros(0, "<u4")]).astype(np.int64)
            lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)])), pa.array(flat))
            doc, flat = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists).to_numpy()
            total = pc.cumulative_sum(pa.array(side.length[flat])).to_numpy() if len(flat) else flat
            base = np.concatenate([[0], total])[np.cumsum(n) - n]  # what documents before have
            self.n.append(n)
            self.doc.append(doc)
            self.id.append(flat)
            self.end.append(total - base[doc])
        keys = [pa.table({"key": doc << 40 | end, f"row_{s}": np.arange(len(doc))}) for s, doc, end in zip("ab", self.doc, self.end)]
        common = keys[0].join(keys[1], "key", join_type="inner", use_threads=False)
        self.last = [np.zeros(len(d), np.int64) for d in self.doc]
        for s, last in zip("ab", self.last):
            last[common.column(f"row_{s}").to_numpy()] = 1
        self.group = [np.cumsum(x) - x for x in self.last]
        self.groups = int(self.last[0].sum())
        #: Documents of the groups, and each document's number of groups.
        self.group_doc = self.doc[0][self.last[0] == 1]
        self.n_groups = np.bincount(self.group_doc, minlength=len(texts))
        self.size = [np.bincount(g, minlength=self.groups) for g in self.group]
        self.n_links = np.bincount(self.group_doc, self.size[0] * self.size[1], len(texts)).astype(np.int64)

    def _same_bytes(self, wanted: list[bytes], ids) -> list[bool]:
        """Whether the ids of either side spell each text."""
        import numpy as np
        import pyarrow as pa

        good = [True] * len(wanted)
        for side, mine in zip(self.sides, ids):
            taken = side.bytes.take(pa.array(np.concatenate(mine or [np.zeros(0, "<u4")]).astype(np.int64)))
            data = memoryview(taken.buffers()[2] or b"").cast("B")
            at = 0
            for i, (want, x) in enumerate(zip(wanted, mine)):
                n = int(side.length[x].sum())
                good[i] &= n == len(want) and data[at : at + n] == want
                at += n
        return good

    def links(self):
        """(document, pair, how often it is linked there), each pair of a document once."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        large = self.size[0] * self.size[1] > LINKS_APART
        parts = []
        for apart in (False, True) if large.any() else (False,):
            mine = [large[g] == apart for g in self.group]
            a, b = (pa.table({"group": g[m], f"id_{s}": i[m]}) for s, g, i, m in zip("ab", self.group, self.id, mine))
            if apart:
                a, b = (t.group_by(["group", f"id_{s}"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["group", f"id_{s}", f"n_{s}"]) for s, t in zip("ab", (a, b)))
            t = a.join(b, "group", join_type="inner", use_threads=False)
            doc = self.group_doc[t.column("group").to_numpy()]
            pair = t.column("id_a").to_numpy() * ID_RANGE + t.column("id_b").to_numpy()
            times = t.column("n_a").to_numpy() * t.column("n_b").to_numpy() if apart else np.ones(len(doc), np.int64)
            parts.append(pa.table({"doc": doc, "pair": pair, "times": times}))
        t = pa.concat_tables(parts).group_by(["doc", "pair"], use_threads=False).aggregate([("times", "sum")])
        t = t.take(pc.sort_indices(t, [("doc", "ascending"), ("pair", "ascending")]))
        return t.column("doc").to_numpy(), t.column("pair").to_numpy(), t.column("times_sum").to_numpy()

    def listed(self, values):
        """Per group, the list of `values` (one Arrow array a side) of its tokens."""
        import numpy as np
        import pyarrow as pa

        return [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), v) for n, v in zip(self.size, values)]

    def hashes(self) -> list[str]:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        names = self.listed([side.text.take(pa.array(i)) for side, i in zip(self.sides, self.id)])
        each = pc.binary_join_element_wise(*(pc.binary_join(x, ",") for x in names), "|")
        whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(self.n_groups)]), pa.int32()), each), ";")
        return [hashlib.sha256(x.as_buffer()).hexdigest() if n else "" for x, n in zip(whole, self.n_groups)]


def _steps_of(batches, vocabulary_a, model_b):
    a, b = sides(vocabulary_a, model_b)
    for batch in batches:
        rows = zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
        for some in in_groups(rows, lambda r: len(r[1] or ""), STEP_CHARS):
            yield [r[0] for r in some], Step([r[1] for r in some], a, b)


def _gather(vocabulary_a: str, model_b: str, block_pairs: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        names = [x.split()[0] for x in GATHERED.split(", ")]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.int64(), pa.int64()]
        part, number, held, total = TaskContext.get().partitionId(), 0, [], 0

        def rows(size: int, **columns):
            return pa.RecordBatch.from_arrays([(columns[c] if isinstance(columns[c], pa.Array) else pa.array(columns[c], t)) if c in columns else pa.nulls(size, t) for c, t in zip(names, types)], names)

        def close():
            block = part << 32 | number
            pairs = np.concatenate([p for _, _, _, p, _ in held] or [np.zeros(0, np.int64)])
            known, slots = np.unique(pairs, return_inverse=True)
            counts = pa.table({"slot": slots.astype(np.int32)}).group_by("slot", use_threads=False).aggregate([([], "count_all")])  # documents of each pair
            at = 0
            for ids, step, doc, p, times in held:
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(ids)))]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (slots[at : at + len(p)], times)]
                yield rows(len(ids), kind=np.zeros(len(ids)), block=np.full(len(ids), block), doc_id=ids, **step, slots=lists[0], times=lists[1])
                at += len(p)
            slot, n = counts.column("slot").to_numpy(), counts.column("count_all").to_numpy()
            for i in range(0, len(slot), 1 << 18):
                some = slot[i : i + (1 << 18)]
                yield rows(len(some), kind=np.ones(len(some)), block=np.full(len(some), block), slot=some, pair=known[some], n=n[i : i + (1 << 18)])

        for ids, step in _steps_of(batches, vocabulary_a, model_b):
            doc, pair, times = step.links()
            figures = {"n_a": step.n[0], "n_b": step.n[1], "n_groups": step.n_groups, "n_links": step.n_links, "groups_sha256": step.hashes()}
            held.append((ids, figures, doc, pair, times))
            total += len(pair)
            if total >= block_pairs:
                yield from close()
                number, held, total = number + 1, [], 0
        yield from close()

    return run


def _digest(_key, docs, known):
    import numpy as np
    import pyarrow as pa

    slot, n, best = (known.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("slot", "n", "best"))
    count, top = np.zeros(len(slot), np.int64), np.zeros(len(slot), np.int64)
    count[slot], top[slot] = n, best
    out = []
    for b in docs.to_batches():
        slots, times = b.column("slots"), b.column("times").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        stops = slots.offsets.to_numpy() - slots.offsets[0].as_py()
        at = slots.flatten().to_numpy(zero_copy_only=False)
        add = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[stops])
        figures = {"n_best": add(times * top[at]), "count_sum": add(times * count[at])}
        out.append(pa.RecordBatch.from_arrays([pa.array(figures[c], pa.int64()) if c in figures else b.column(c) for c in (x.split()[0] for x in DIGEST.split(", "))], [x.split()[0] for x in DIGEST.split(", ")]))
    return pa.Table.from_batches(out)


def _gathered(docs: DataFrame, vocabulary_a: str, model_b: str, block_pairs: int) -> DataFrame:
    ship(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return table(rows.mapInArrow(_gather(vocabulary_a, model_b, block_pairs), GATHERED), "aligned")


def _counts(gathered: DataFrame) -> DataFrame:
    """Documents per id pair, and whether no pair of the same A id has more."""
    merged = gathered.where("kind = 1").groupBy("pair").agg(F.sum("n").alias("n"))
    merged = table(merged, "aligned-pairs").withColumn("a", F.floor(F.col("pair") / ID_RANGE))
    most = merged.groupBy("a").agg(F.max("n").alias("most"))
    return merged.join(most.hint("merge"), "a").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))


def pair_counts(docs: DataFrame, vocabulary_a: str = VOCABULARY_A, model_b: str = MODEL_B) -> DataFrame:
    """(a, b, documents, best): in how many documents A id `a` and B id `b` are linked, and whether that is most for `a`."""
    counts = _counts(_gathered(docs, vocabulary_a, model_b, BLOCK_PAIRS))
    return counts.select(F.floor(F.col("pair") / ID_RANGE).alias("a"), (F.col("pair") % ID_RANGE).alias("b"), F.col("n").alias("documents"), (F.col("best") == 1).alias("best"))


def groups(docs: DataFrame, vocabulary_a: str = VOCABULARY_A, model_b: str = MODEL_B) -> DataFrame:
    """The alignment itself, GROUPS: per document and group its bytes (of the space and the text) and both sides' ids."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for ids, step in _steps_of(batches, vocabulary_a, model_b):
            stop = step.end[0][step.last[0] == 1]
            start = np.concatenate([[0], stop[:-1]])
            start[np.concatenate([[True], step.group_doc[1:] != step.group_doc[:-1]])[: len(start)]] = 0
            lists = [x.cast(pa.list_(pa.int32())) for x in step.listed([pa.array(i, pa.int32()) for i in step.id])]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()).take(pa.array(step.group_doc)), pa.array(start[: len(stop)], pa.int64()), pa.array(stop, pa.int64()), *lists], [x.split()[0] for x in GROUPS.split(", ")])

    ship(docs.sparkSession)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, GROUPS)


def align(docs: DataFrame, vocabulary_a: str = VOCABULARY_A, model_b: str = MODEL_B, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): DIGEST."""
    gathered = _gathered(docs, vocabulary_a, model_b, block_pairs)
    asked = gathered.where("kind = 1").select(F.col("block").alias("of_block"), "slot", "pair")
    known = asked.join(_counts(gathered).hint("merge"), "pair").select("of_block", "slot", "n", "best")
    texts = gathered.where("kind = 0").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "slots", "times")
    return texts.groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(_digest, DIGEST)


def op12(spark, sf_dir: str) -> DataFrame:
    """Query: alignment figures of all documents."""
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
