"""Spelling variants in the corpus's own vocabulary (operator 11).

Words are maximal runs of Latin letters, lower-cased (A-Z only), one in VARY_ONE_IN of which loses a letter by the
query's rule; those of LEAST_LETTERS or more that occur LEAST_COUNT times make the vocabulary. Two words are near if one
inserted, deleted or replaced letter makes them equal; a word's form is its most frequent near word if that is
FORM_TIMES as frequent, and its root is where following forms ends.

Near words are found by scanning sorted lists. For every word the scan walks a sorted list of words and keeps, per letter
of the current list word, the banded row (three cells wide) of the edit matrix; the next list word reuses the rows of
their longest common prefix, and where all of a row exceeds one edit, all list words that share that prefix are skipped.
The vocabulary is dealt into lists so that no list is the whole vocabulary: two near words, the shorter of m letters, are
equal but for one of PARTS parts of it, so a word stands in the lists of (m, part, all letters outside that part), for m
its own length and one less. A list thus holds words that differ within one part only; Spark sorts each, and a task
streams through many.

Defined results: null texts have no words; a null doc_id counts as the empty text in the rule of lost letters; repeated
rows count each; of near words equally frequent the first in code-point order is the form; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, ship, table

LEAST_LETTERS, LEAST_COUNT, FORM_TIMES, VARY_ONE_IN = 6, 5, 5, 199
#: Parts of a word, of which one holds the edit.
PARTS = 3
#: Distinct words that a task counts before it passes its counts on.
HELD_WORDS = 1_000_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def runs_of(text: bytes):
    """Arrow array of the letter runs of a lower-cased UTF-8 text, and where each begins in it. U+00C0 to U+00FF are
    the byte C3 and one byte after it."""
    import numpy as np
    import pyarrow as pa

    arr = np.frombuffer(text, np.uint8)
    lead = arr == 0xC3
    inside = ((arr >= 97) & (arr <= 122)) | lead
    inside[1:] |= lead[:-1]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(arr[inside].tobytes())]), starts


def shortened(run: bytes, h: int) -> bytes:
    """The run without its code point h % length."""
    word = run.decode()
    at = h % len(word)
    return (word[:at] + word[at + 1 :]).encode()


def _count(vary: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        held, total = [], 0

        def folded():
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

        def out():
            for b in folded().to_batches(max_chunksize=1 << 16):
                yield pa.RecordBatch.from_arrays([b.column("word").cast(pa.large_string()).cast(pa.string()), b.column("n")], ["word", "n"])

        for b in batches:
            texts = [(t or b"").translate(_LOWER) for t in b.column("text").cast(pa.large_binary()).to_pylist()]
            words, starts = runs_of(b" ".join(texts))
            if not len(words):
                continue
            words = words.dictionary_encode()
            names, slots = words.dictionary.to_pylist(), words.indices.to_numpy()
            ends = np.cumsum([len(t) + 1 for t in texts])
            doc = np.searchsorted(ends, starts, "right")
            pairs, uses = np.unique(doc * len(names) + slots, return_counts=True)
            counts = np.bincount(slots, minlength=len(names)).astype(np.int64)
            heads = [zlib.crc32(f"{'' if i is None else i}:".encode()) for i in b.column("doc_id").to_pylist()]
            docs, slots = np.divmod(pairs, len(names))
            sums = np.array([zlib.crc32(names[s], heads[d]) for d, s in zip(docs.tolist(), slots.tolist())], np.int64)
            lost: dict[bytes, int] = {}
            for at in np.flatnonzero(sums % vary == 0).tolist():
                s, n = int(slots[at]), int(uses[at])
                counts[s] -= n
                short = shortened(names[s], int(sums[at]))
                lost[short] = lost.get(short, 0) + n
            held.append(pa.table({"word": words.dictionary, "n": counts}))
            held.append(pa.table({"word": pa.array(list(lost), pa.large_binary()), "n": pa.array(list(lost.values()), pa.int64())}))
            total += len(names) + len(lost)
            if total >= HELD_WORDS:
                held = [folded()]
                total = held[0].num_rows
                if total >= HELD_WORDS // 2:
                    yield from out()
                    held, total = [], 0
        if held:
            yield from out()

    return run


def word_counts(docs: DataFrame, vary: int = VARY_ONE_IN) -> DataFrame:
    """(word, n): how often each word results from the texts' letter runs, all words."""
    ship(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    counts = rows.mapInArrow(_count(vary), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where("n > 0 AND word <> ''")


def lcp(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


def near_in_sorted(words: list[str]):
    """Pairs (i, j), i < j, of places in a sorted list of distinct words that are one edit apart.

    For word i, rows[d] has the edits between the first d letters of the list word and the first d - 1, d and d + 1
    letters of word i (2 stands for more than one)."""
    n = len(words)
    common = [0] + [lcp(a, b) for a, b in zip(words, words[1:])]  # of each word and the one before it
    for i in range(n - 1):
        q = words[i]
        m = len(q)
        rows = [(2, 0, 1)]
        j, keep = i + 1, 0
        while j < n:
            w = words[j]
            del rows[keep + 1 :]
            dead = 0
            for d in range(keep + 1, len(w) + 1):
                up_left, up, up_right = rows[-1]
                c = w[d - 1]
                # cell e: d letters of w against d + e letters of q, e = -1, 0, 1
                left = min(up_left + (d - 2 < 0 or d - 2 >= m or q[d - 2] != c), up + 1, 2) if 1 <= d <= m + 1 else 2
                here = min(up + (q[d - 1] != c), left + 1, up_right + 1, 2) if d <= m else 2
                right = min(up_right + (q[d] != c), here + 1, 2) if d + 1 <= m else 2
                row = (left, here, right)
                rows.append(row)
                if left > 1 and here > 1 and right > 1:
                    dead = d
                    break
            if not dead and abs(len(w) - m) <= 1 and rows[len(w)][m - len(w) + 1] == 1:
                yield i, j
            j += 1
            if dead:  # words that share the first `dead` letters are too far as well
                while j < n and common[j] >= dead:
                    j += 1
            keep = min(common[j], len(rows) - 1) if j < n else 0


def _near(batches):
    import pyarrow as pa

    names = ["word", "near"]
    key, words = None, []
    found: tuple[list, list] = ([], [])

    def close():
        for i, j in near_in_sorted(words):
            found[0].extend((words[i], words[j]))
            found[1].extend((words[j], words[i]))

    def flushed():
        batch = pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in found], names)
        found[0].clear()
        found[1].clear()
        return batch

    for b in batches:
        for k, w in zip(b.column("list").to_pylist(), b.column("word").to_pylist()):
            if k != key:
                close()
                key, words = k, []
                if len(found[0]) > 1 << 16:
                    yield flushed()
            words.append(w)
    close()
    yield flushed()


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, near): all near pairs of `vocabulary` (word, distinct), both ways."""
    size = F.length("word")
    lists = []
    for shorter in (0, 1):
        m = size - shorter
        for part in range(PARTS):
            head, tail = F.floor(m * part / PARTS).cast("int"), (m - F.floor(m * (part + 1) / PARTS)).cast("int")
            # letters before the part, and as many after it as the shorter word has
            outside = F.concat_ws(" ", m.cast("string"), F.lit(str(part)), F.substring(F.col("word"), F.lit(1), head), F.when(tail > 0, F.substring(F.col("word"), size - tail + 1, tail)).otherwise(""))
            lists.append(F.when(m >= 1, outside))
    rows = vocabulary.select("word", F.explode(F.array(*lists)).alias("list")).where("list IS NOT NULL")
    spark = vocabulary.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "list").sortWithinPartitions("list", "word")
    return dealt.mapInArrow(_near, "word string, near string").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form), one row a word and no cycles: where following forms ends, by doubling steps."""
    now = table(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        onward = now.select(F.col("word").alias("via"), F.col("root").alias("further"))
        joined = now.join(onward.hint("merge"), F.col("root") == F.col("via"), "left")
        after = table(joined.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        moved = after.where("moved").limit(1).count()
        drop(now)
        now = after.select("word", "root")
        if not moved:
            return now


def variants(docs: DataFrame, vary: int = VARY_ONE_IN, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, form_times: int = FORM_TIMES) -> DataFrame:
    """The vocabulary of `docs` (doc_id, text): word, form, root, n, n_near, form_n."""
    counts = word_counts(docs, vary).where((F.length("word") >= least_letters) & (F.col("n") >= least_count))
    words = table(counts, "spelling-words", collect=True)
    pairs = table(near_words(words.select("word")), "spelling-pairs", collect=True)
    other = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    # the best near word: most frequent, then first; its order is that of (-n, word)
    best = pairs.join(other.hint("merge"), "near").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    best = best.select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))
    whole = words.join(best.hint("merge"), "word", "left")
    has = F.col("near_n") >= form_times * F.col("n")
    whole = table(whole.select("word", F.when(has, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("near_n")).alias("form_n")), "spelling-forms")
    ends = roots(whole.where("form IS NOT NULL"))
    out = whole.join(ends.hint("merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11(spark, sf_dir: str) -> DataFrame:
    """Query: the spelling variants of all documents' words."""
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
