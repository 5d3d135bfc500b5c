"""Language-model scores by prediction by partial matching (operator 13).

A text's tokens are its lower-cased words (A-Z only), then one end. The model reads them as bytes, each word followed by
a space, the end as a line feed, and predicts every byte from the ORDER bytes before it (line feeds before the text).
Its trie of byte contexts holds, for every context of up to ORDER bytes in the training texts, how often each byte
followed. The longest context met in training predicts first; a byte new to a context costs an escape to the context one
byte shorter, where bytes that the longer one has predicted are excluded. Escapes follow method D: in a context met T
times with D different bytes, a byte seen c times has probability (2c - 1) / 2T and the escape D / 2T, both reduced by
what is excluded; where all is excluded the escape is free. Below the empty context all 256 bytes are equally likely.
A text's score is the log10 of the product over its bytes: a pretrained code length.

One Python pass deals the texts to blocks of about BLOCK_BYTES and writes, beside each block's texts (as numbers of its
words), its distinct windows (ORDER bytes and the byte that follows) and words with their counts in training texts.
Spark sums the counts over all blocks. The trie is cut by the last two bytes of the context: all that a window's escapes meet below the
second order lies in one shard, and the counts of the first order are at most 65,536 numbers that every task gets. Each
shard yields its windows' log-probabilities, which are joined back to the blocks that asked for them; a block is then
scored with its own windows only. No task holds the whole trie, and no part of it is dropped.

Log-probabilities travel to the blocks in single precision and are summed in double, so a score is exact to some seven
digits.

Defined results: a null or blank text is the end alone; a null doc_id counts as the empty text in the fold rule, which
puts it into training; each row is scored and counted by itself, repeated rows too; without training rows the byte
scores are uniform and the base is 0; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, drop_parts, ship, table

#: Bytes of context, at most 6: a byte and its context are a non-negative long.
ORDER = 5
#: Bytes of normalised text in a block, which bounds what its lookup may hold.
BLOCK_BYTES = 1 << 25
#: Bytes whose windows are sorted or looked up at once.
STEP_BYTES = 1 << 21
SPACE, END = 32, 10
_NORMAL = bytes(SPACE if b in b" \t\n\x0b\f\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))

GATHERED = "kind int, block long, doc_id long, held_out boolean, numbers binary, slot int, word binary, win long, n long"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(doc_id):
    """The fold rule of the query: crc32 of the id as text, mod 7, is 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 == 2


def normal(texts: list[bytes]) -> list[bytes]:
    """Each text as the model reads it: words each followed by a space, then the end."""
    import numpy as np

    if not texts:
        return []
    arr = np.frombuffer(b" \n".join([t.translate(_NORMAL) for t in texts]) + b" \n", np.uint8)
    keep = arr != SPACE
    keep[1:] |= keep[:-1] & (arr[:-1] != END)
    arr = arr[keep]
    data, at, out = arr.tobytes(), 0, []
    for end in (np.flatnonzero(arr == END) + 1).tolist():
        out.append(data[at:end])
        at = end
    return out


def windows_of(seqs: list[bytes]):
    """(windows of all bytes of the sequences in one array, which of them belong to a sequence, where each sequence begins)."""
    import numpy as np

    pad = bytes([END]) * ORDER
    buf = pad + pad.join(seqs) + bytes(7 - ORDER)
    n = len(buf) - 7
    win = (np.ndarray((n,), ">u8", buf, strides=(1,)) >> np.uint64(8 * (7 - ORDER))).astype(np.int64)
    starts = np.cumsum([0, *(len(s) + ORDER for s in seqs[:-1])])
    own = np.ones(n, bool)
    for gap in range(1, ORDER + 1):
        own[starts[1:] - gap] = False
    return win, own, starts


def words_in(seq: bytes):
    """Arrow array of the words of one or more joined sequences."""
    import numpy as np
    import pyarrow as pa

    arr = np.frombuffer(seq, np.uint8)
    inside = (arr != SPACE) & (arr != END)
    ends = np.cumsum(inside)[arr == SPACE]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(arr[inside].tobytes())])


def _steps(items: list, size, most: int):
    group, total = [], 0
    for x in items:
        group.append(x)
        total += size(x)
        if total >= most:
            yield group
            group, total = [], 0
    if group:
        yield group


def _summed(keys, counts):
    """Distinct keys in order, and the sums of their counts."""
    import numpy as np

    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def packed(numbers, lengths) -> list[bytes]:
    """Lists of numbers below 2^30, given in one array, as 16-bit integers: those from 65,535 on as 65,535 and two halves of 15 bits."""
    import numpy as np

    large = np.flatnonzero(numbers >= 65535)
    width = np.ones(len(numbers), np.int64)
    width[large] = 3
    at = np.cumsum(width) - width
    out = np.empty(int(width.sum()), "<u2")
    out[at] = np.minimum(numbers, 65535)
    out[at[large] + 1], out[at[large] + 2] = numbers[large] & 32767, numbers[large] >> 15
    stops = np.concatenate([at, [len(out)]])[np.concatenate([[0], np.cumsum(lengths)])]
    data = out.tobytes()
    return [data[2 * i : 2 * j] for i, j in zip(stops.tolist(), stops[1:].tolist())]


def unpacked(lists: list[bytes]):
    """(all numbers of the lists of packed(), how many each has)."""
    import numpy as np

    data = np.frombuffer(b"".join(lists), "<u2")
    large = np.flatnonzero(data == 65535)
    numbers, keep = data.astype(np.int64), np.ones(len(data), bool)
    numbers[large] = numbers[large + 1] | numbers[large + 2] << 15
    keep[large + 1] = keep[large + 2] = False
    before = np.concatenate([[0], np.cumsum(keep)])
    return numbers[keep], np.diff(before[np.cumsum([0, *(len(x) // 2 for x in lists)])])


class _Block:
    """Texts gathered so far as word numbers, and their distinct windows and words with counts in training texts."""

    def __init__(self):
        self.size, self.ends, self.docs, self.windows, self.names, self.slots, self.trained = 0, 0, [], [], [], [], []

    def add(self, ids: list, held: list[bool], texts: list[bytes]) -> None:
        import numpy as np

        seqs = normal(texts)
        self.size += sum(map(len, seqs))
        self.ends += held.count(False)
        for flag in (False, True):
            if some := [s for s, h in zip(seqs, held) if h == flag]:
                win, own, _ = windows_of(some)
                win = np.sort(win[own])
                first = np.flatnonzero(np.concatenate([[True], win[1:] != win[:-1]]))
                self.windows.append((win[first], np.zeros(len(first), np.int64) if flag else np.diff(np.concatenate([first, [len(win)]]))))
        if sum(len(w) for w, _ in self.windows) > 2 * len(self.windows[0][0]) + STEP_BYTES:
            self.fold()
        words = words_in(b"".join(seqs)).dictionary_encode()
        lengths = np.array([s.count(b" ") for s in seqs])
        self.docs.append((ids, held, lengths))
        self.names.append(words.dictionary)
        self.slots.append(words.indices.to_numpy())
        self.trained.append(np.repeat(~np.array(held, bool), lengths))

    def fold(self) -> None:
        import numpy as np

        self.windows = [_summed(np.concatenate([w for w, _ in self.windows]), np.concatenate([n for _, n in self.windows]))]

    def rows(self, at: int):
        """The block's rows: its documents, windows and words. Frequent words have the smaller numbers."""
        import numpy as np
        import pyarrow as pa

        if not self.docs:
            return
        self.fold()
        (wins, n), = self.windows
        every = pa.chunked_array(self.names).combine_chunks().dictionary_encode()
        bases, places = np.cumsum([0, *map(len, self.names)]), every.indices.to_numpy()
        slots = [places[b + x] for b, x in zip(bases, self.slots)]
        all_slots = np.concatenate(slots)
        uses = np.bincount(all_slots, minlength=len(every.dictionary))
        order = np.argsort(-uses, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        for (ids, held, lengths), x in zip(self.docs, slots):
            yield _rows(at, 0, len(ids), doc_id=ids, held_out=held, numbers=packed(rank[x], lengths))
        for i in range(0, len(wins), 1 << 18):
            yield _rows(at, 1, len(wins[i : i + (1 << 18)]), win=wins[i : i + (1 << 18)], n=n[i : i + (1 << 18)])
        trained = np.bincount(all_slots, np.concatenate(self.trained), len(order)).astype(np.int64)[order]
        names = every.dictionary.take(pa.array(order))
        for i in range(0, len(order), 1 << 16):
            some, n = names.slice(i, 1 << 16), trained[i : i + (1 << 16)]
            yield _rows(at, 2, len(some), slot=np.arange(i, i + len(some)), word=some, n=n)
            yield _rows(at, 0, 1, slot=[i], word=[b" ".join(some.to_pylist())], numbers=[n.astype("<u4").tobytes()])  # a block has fewer words than 2^32
        yield _rows(at, 2, 1, slot=[-1], word=[bytes([END])], n=[self.ends])


def _rows(block: int, kind: int, size: int, **columns):
    import numpy as np
    import pyarrow as pa

    types = {"kind": pa.int32(), "block": pa.int64(), "doc_id": pa.int64(), "held_out": pa.bool_(), "numbers": pa.binary(), "slot": pa.int32(), "word": pa.binary(), "win": pa.int64(), "n": pa.int64()}
    columns |= {"kind": np.full(size, kind), "block": np.full(size, block)}

    def made(c, t):
        if c not in columns:
            return pa.nulls(size, t)
        return columns[c].cast(t) if isinstance(columns[c], pa.Array) else pa.array(columns[c], t)

    return pa.RecordBatch.from_arrays([made(c, t) for c, t in types.items()], list(types))


def _gather(block_bytes: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, number, block = TaskContext.get().partitionId(), 0, _Block()
        for b in batches:
            rows = list(zip(b.column("doc_id").to_pylist(), b.column("held_out").to_pylist(), b.column("text").cast(pa.large_binary()).to_pylist()))
            for some in _steps(rows, lambda r: len(r[2] or b""), STEP_BYTES):
                block.add([r[0] for r in some], [r[1] for r in some], [r[2] or b"" for r in some])
                if block.size >= block_bytes:
                    yield from block.rows(part << 32 | number)
                    number, block = number + 1, _Block()
        yield from block.rows(part << 32 | number)
        del block
        pa.default_memory_pool().release_unused()

    return run


class _Level:
    """Contexts of `k` bytes: how often each byte followed (`key`: context and byte), and sums per context."""

    def __init__(self, k: int, key, count, below: _Level | None):
        import numpy as np

        self.k, self.key, self.count = k, key, count
        ctx = key >> 8
        first = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if len(key) else np.zeros(0, int)
        sums = (lambda v: np.add.reduceat(v, first) if len(first) else np.zeros(0, np.int64))
        self.ctx, self.total, self.different = ctx[first], sums(count), np.diff(np.concatenate([first, [len(key)]])).astype(np.int64)
        #: What the bytes seen here count one order below.
        self.excluded = sums(below.find(key & _mask(k))[0]) if below else np.zeros(len(first), np.int64)

    @staticmethod
    def _look(keys, wanted, *columns):
        import numpy as np

        if not len(keys):
            return [np.zeros(len(wanted), np.int64) for _ in columns]
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        hit = keys[at] == wanted
        return [np.where(hit, c[at], 0) for c in columns]

    def find(self, key):
        """Of each key (context and byte): its count, and the context's total, different bytes and exclusions."""
        return [*self._look(self.key, key, self.count), *self._look(self.ctx, key >> 8, self.total, self.different, self.excluded)]


def _mask(n_bytes: int) -> int:
    return (1 << 8 * n_bytes) - 1


def log_probabilities(win, n, first_order):
    """log10 of each window's probability. `win`, `n`: distinct windows, in order, with their training counts, and with
    them all that share their last two context bytes; `first_order`: keys and counts of contexts of one byte."""
    import numpy as np

    key, count = first_order
    low = _Level(0, *_summed(key & 255, count), None)
    levels = [low, _Level(1, key, count, low)]
    seen = n > 0
    grams = {ORDER: (win[seen], n[seen])}
    for k in range(ORDER - 1, 1, -1):
        grams[k] = _summed(grams[k + 1][0] & _mask(k + 1), grams[k + 1][1])
    for k in range(2, ORDER + 1):
        levels.append(_Level(k, *grams[k], levels[-1]))
    out, open_ = np.zeros(len(win)), np.ones(len(win), bool)
    gone, gone_bytes = np.zeros(len(win), np.int64), np.zeros(len(win), np.int64)
    for level in reversed(levels):
        c, total, different, excluded = level.find(win & _mask(level.k + 1))
        left = 2 * (total - gone)
        with np.errstate(divide="ignore", invalid="ignore"):
            out += np.where(open_ & (c > 0), np.log10((2 * c - 1) / left), 0)
            open_ &= c == 0
            out += np.where(open_ & (left > 0), np.log10((different - gone_bytes) / left), 0)
        gone, gone_bytes = excluded, different
    left = 256 - low.different.sum()
    return out - np.where(open_, np.log10(max(left, 1)), 0)


def _model(key, count):
    def run(t):
        import numpy as np
        import pyarrow as pa

        win, n = (t.column(c).combine_chunks().to_numpy() for c in ("win", "n"))
        order = np.argsort(win)
        win = win[order]
        return pa.table({"win": win, "lp": log_probabilities(win, n[order], (key, count))})

    return run


class Lookup:
    """Hash table of distinct non-negative keys in arrays, asked for many keys at once."""

    def __init__(self, keys):
        import numpy as np

        self.bits = max(8, int(len(keys) * 3).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.place = np.zeros(1 << self.bits, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[left[free]]  # of several for one slot, the last one stays
            done = free & (self.keys[at] == keys[left])
            self.place[at[done]] = left[done]
            left, at = left[~done], (at[~done] + 1) & (len(self.keys) - 1)

    def _slot(self, keys):
        import numpy as np

        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys):
        """Place of each key, all of which must be known."""
        import numpy as np

        at = self._slot(keys)
        out = self.place[at]
        missed = np.flatnonzero(self.keys[at] != keys)
        at = at[missed]
        steps = 0
        while len(missed):
            at = (at + 1) & (len(self.keys) - 1)
            found = self.keys[at] == keys[missed]
            out[missed[found]] = self.place[at[found]]
            missed, at, steps = missed[~found], at[~found], steps + 1
            if steps > len(self.keys):
                raise KeyError("a window that its block did not list")
        return out


def _spelt(lists: list[bytes]):
    """Arrow array of the words of lists joined by spaces, each with a space after it."""
    import numpy as np
    import pyarrow as pa

    data = b" ".join(lists) + b" "
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == SPACE) + 1
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(data)])


def _score(total: int, different: int):
    def run(_key, docs, known):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        is_word = pc.is_valid(docs.column("word"))
        names = docs.filter(is_word).sort_by("slot")
        counts = np.concatenate([np.zeros(1), *(np.frombuffer(x, "<u4") for x in names.column("numbers").to_pylist())])  # the end is the first
        spelt = _spelt([bytes([END]), *names.column("word").to_pylist()])
        is_win = pc.is_valid(known.column("win"))
        wins, more = known.filter(is_win), known.filter(pc.invert(is_win))
        look, lp = Lookup(wins.column("win").combine_chunks().to_numpy()), wins.column("lp").combine_chunks().to_numpy().astype(np.float64)
        counts[more.column("slot").to_numpy() + 1] = more.column("n").to_numpy()
        logs = np.log10((counts + 1) / (total + different + 1))
        out = []
        for b in docs.filter(pc.invert(is_word)).to_batches():
            at, lengths = unpacked(b.column("numbers").to_pylist())
            at += 1
            stops = np.concatenate([[0], np.cumsum(lengths)])
            add = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[stops])
            figures = {"n_tokens": lengths + 1, "n_known": add(counts[at] > 0) + int(counts[0] > 0), "train_tokens": np.full(len(lengths), total), "base_score": add(logs[at]) + logs[0], "score": np.zeros(len(lengths))}
            done = 0
            for some in _steps(lengths.tolist(), lambda n: 8 * n + 1, STEP_BYTES):
                text = spelt.take(pa.array(at[stops[done] : stops[done + len(some)]]))
                data, ends = (text.buffers()[2] or pa.py_buffer(b"")).to_pybytes(), np.frombuffer(text.buffers()[1] or bytes(8), np.int64)
                cut = ends[stops[done : done + len(some) + 1] - stops[done]].tolist()
                win, own, starts = windows_of([data[i:j] + bytes([END]) for i, j in zip(cut, cut[1:])])
                value = np.zeros(len(win))
                value[own] = lp[look.find(win[own])]
                figures["score"][done : done + len(some)] = np.add.reduceat(value, starts)
                done += len(some)
            names = [c.split()[0] for c in SCORES.split(", ")]
            out.append(pa.RecordBatch.from_arrays([b.column(c) if c in ("doc_id", "held_out") else pa.array(figures[c], pa.float64() if c.endswith("score") else pa.int64()) for c in names], names))
        return pa.Table.from_batches(out)

    return run


def score(docs: DataFrame, train=None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of `docs` (doc_id, text): SCORES. `train` is a condition on `docs`, true for rows to learn from;
    without it the query's fold rule holds."""
    spark = docs.sparkSession
    ship(spark)
    held = held_out(F.col("doc_id")) if train is None else ~F.coalesce(train, F.lit(False))
    rows = docs.select("doc_id", held.alias("held_out"), F.col("text").cast("string").alias("text"))
    gathered = table(rows.mapInArrow(_gather(block_bytes), GATHERED), "ppm-gathered", partition_by="kind")
    asked = gathered.where("kind = 1").select("block", "win", "n")
    asked_words = gathered.where("kind = 2").select("block", "slot", "word", "n")
    windows = table(asked.groupBy("win").agg(F.sum("n").alias("n")), "ppm-windows", collect=True)
    words = table(asked_words.groupBy("word").agg(F.sum("n").alias("n")), "ppm-words", collect=True)
    totals = words.where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("different")).first()
    low = windows.where("n > 0").groupBy(F.col("win").bitwiseAND(65535).alias("key")).agg(F.sum("n").alias("n")).orderBy("key").toPandas()  # at most 65,536 rows
    shard = F.shiftright("win", 8).bitwiseAND(65535)
    shards = int(spark.conf.get("spark.sql.shuffle.partitions")) * 4
    dealt = windows.withColumn("shard", F.pmod(F.hash(shard), F.lit(shards)))
    model = dealt.groupBy("shard").applyInArrow(_model(low["key"].to_numpy("int64"), low["n"].to_numpy("int64")), "win long, lp double")
    model = table(model, "ppm-model", collect=True)
    drop(windows)
    known = asked.join(model.hint("merge"), "win").select(F.col("block").alias("of_block"), "win", F.lit(None).cast("int").alias("slot"), F.col("lp").cast("float").alias("lp"), F.lit(None).cast("long").alias("n"))
    # a block knows its own counts of words; it is told those that other blocks add to, and how often texts end
    counted = asked_words.withColumnRenamed("n", "own").join(words.hint("merge"), "word").where("n <> own OR slot < 0")
    counted = counted.select(F.col("block").alias("of_block"), F.lit(None).cast("long").alias("win"), "slot", F.lit(None).cast("float").alias("lp"), "n")
    known = table(known.unionAll(counted), "ppm-known", collect=True)
    drop(model, words)
    drop_parts(gathered, "kind=1", "kind=2")
    texts = gathered.where("kind = 0").select("block", "doc_id", "held_out", "numbers", "slot", "word")
    scored = texts.groupBy("block").cogroup(known.groupBy("of_block"))
    return scored.applyInArrow(_score(int(totals["total"]), int(totals["different"])), SCORES)


def op13(spark, sf_dir: str) -> DataFrame:
    """Query: scores of all documents, learnt from those outside the held-out fold."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
