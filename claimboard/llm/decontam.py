"""Benchmark decontamination with a generalised suffix automaton of the test items (operator 9).

Items and texts are normalised to lower-case words. The automaton holds every run of words of every item; a
text is streamed through it word by word, and at each word the longest run that ends there and occurs in an
item is known. A run of WINDOW words, or a whole shorter item, is a hit: its words are marked. Words that no
item has reset the automaton, so only stretches of known words are streamed.

Items are dealt to automata of at most AUTOMATON_WORDS words (an item is never cut), so what is broadcast has
a fixed bound; each text passes through all of them and the marks are joined.

Defined results: null and empty texts and items have no words and hit nothing; an empty benchmark hits nothing;
repeated rows are judged alike; an item_id that stands twice counts once; other columns are carried by clean()
and ignored by scan().
"""

from __future__ import annotations

import hashlib
from itertools import repeat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

WINDOW = 10
#: Most words of one automaton (a few hundred bytes a word in each worker).
AUTOMATON_WORDS = 200_000
#: clean(): share of a text's words that, once hit, condemns the whole text.
MOST_HIT = 0.5
SCAN = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:int,end:int>>"
#: Bytes of UTF-8 texts: A-Z to lower case, other ASCII but letters and digits to space.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_loaded: dict = {}


def words(text: str | None) -> list[bytes]:
    """Normalised words of a text."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class Automaton:
    """Suffix automaton of several word sequences; states are numbers, edges are dicts."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[set[str]] = [set()]
        self.whole: dict[int, list[tuple[int, str]]] = {}
        self.least = window
        for name, ws in items:
            last = 0
            for w in ws:
                last = self._extend(last, self.vocabulary.setdefault(w, len(self.vocabulary)))
                while len(ends) < len(self.next):
                    ends.append(set())
                ends[last].add(name)
            if len(ws) < window:
                self.whole.setdefault(last, []).append((len(ws), name))
                self.least = min(self.least, len(ws))
        # items in which a state's runs occur: its own and those of the states that link to it
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0 and self.length[self.link[s]] >= window:
                ends[self.link[s]] |= ends[s]
        self.items = {s: frozenset(e) for s, e in enumerate(ends) if self.length[s] >= window}

    def _extend(self, last: int, c: int) -> int:
        step = self.next[last].get(c)
        if step is not None:
            if self.length[step] == self.length[last] + 1:
                return step
            return self._clone(last, c, step)
        new = self._state(self.length[last] + 1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p < 0:
            self.link[new] = 0
        else:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = self._state(self.length[p] + 1)
        self.next[copy] = dict(self.next[q])
        self.link[copy], self.link[q] = self.link[q], copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def hits(self, ws: list[bytes], np) -> tuple[list[tuple[int, int]], set[str]]:
        """Marked stretches [start, end) of words, ascending and apart, and the items that occur."""
        known = np.fromiter(map(self.vocabulary.get, ws, repeat(-1)), np.int32, len(ws))
        edges = np.flatnonzero(np.diff(np.concatenate([[False], known >= 0, [False]]).astype(np.int8)))
        spans, found = [], set()
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a >= self.least:
                self._stream(known[a:b].tolist(), a, spans, found)
        return spans, found

    def _stream(self, ids: list[int], at: int, spans: list, found: set[str]) -> None:
        state = run = 0
        edge, link, length, whole = self.next, self.link, self.length, self.whole
        for i, c in enumerate(ids):
            while state and c not in edge[state]:
                state = link[state]
                run = length[state]
            step = edge[state].get(c)
            if step is None:
                continue
            state, run = step, run + 1
            if run < self.least:
                continue
            back = 0
            s = state
            while s > 0:
                if s in whole and (run >= length[s] or s != state):
                    for n, item in whole[s]:
                        if n <= run:
                            found.add(item)
                            back = max(back, n)
                s = link[s] if whole else 0
            if run >= self.window:
                back = self.window
                s = state
                while length[link[s]] >= self.window:
                    s = link[s]
                found |= self.items[s]
            if back:
                start, end = at + i + 1 - back, at + i + 1
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, end))


def _load(shards: list, i: int, window: int) -> Automaton:
    """Automaton of the i-th broadcast; one at a time is kept."""
    key = (shards[i].value[0], window)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Automaton(shards[i].value[1], window)
    return _loaded[key]


def _join(lists: list[list[tuple[int, int]]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(x for spans in lists for x in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def broadcast_items(benchmark: DataFrame, window: int = WINDOW, most: int = AUTOMATON_WORDS) -> list:
    """The benchmark's items (item_id, text) as broadcasts of at most `most` words each, or of one longer item."""
    import uuid

    spark = benchmark.sparkSession
    out, shard, total = [], [], 0

    def close():
        if shard:
            out.append(spark.sparkContext.broadcast((uuid.uuid4().hex, list(shard))))
            shard.clear()

    for r in benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").toLocalIterator():
        ws = words(r["text"])
        if not ws:
            continue
        if total and total + len(ws) > most:
            close()
            total = 0
        shard.append((str(r["item_id"]), ws))
        total += len(ws)
    close()
    return out


def _scan(shards: list, window: int, text: str, columns: list[str]):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for b in batches:
            cut = [words(t) for t in b.column(text).to_pylist()]
            spans: list = [[] for _ in cut]
            found: list = [set() for _ in cut]
            for i in range(len(shards)):
                automaton = _load(shards, i, window)
                for k, ws in enumerate(cut):
                    if ws:
                        s, f = automaton.hits(ws, np)
                        if s:
                            spans[k].append(s)
                            found[k] |= f
            spans = [_join(s) for s in spans]
            hit = [sum(y - x for x, y in s) for s in spans]
            shas = [hashlib.sha256(",".join(sorted(f)).encode()).hexdigest() for f in found]
            new = [
                pa.array(map(len, cut), pa.int64()), pa.array(hit, pa.int64()), pa.array(map(len, found), pa.int64()),
                pa.array(shas, pa.string()), pa.array([h > 0 for h in hit], pa.bool_()),
                pa.array([[{"start": x, "end": y} for x, y in s] for s in spans], span),
            ]
            names = [x.split(" ")[0] for x in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), *new], [*columns, *names])

    return run


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of `docs`: doc_id, counts, the items that occur and the marked stretches of words."""
    ship(docs.sparkSession)
    shards = broadcast_items(benchmark, window)
    narrow = docs.select("doc_id", "text")
    kind = dict(narrow.dtypes)["doc_id"]
    out = narrow.mapInArrow(_scan(shards, window, "text", ["doc_id"]), f"doc_id {kind}, {SCAN}")
    return out


def _without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the marked words and what stands between them."""
    at, places, data = 0, [], text.encode("utf-8", "surrogatepass")
    folded = data.translate(_FOLD)
    for w in folded.split():
        start = folded.index(w, at)
        at = start + len(w)
        places.append((start, at))
    out, last = [], 0
    for a, b in spans:
        out.append(data[last : places[a][0]])
        last = places[b - 1][1]
    return b"".join([*out, data[last:]]).decode("utf-8", "surrogatepass")


def _clean(shards: list, window: int, columns: list[str], most_hit: float):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            texts, keep = b.column("text").to_pylist(), []
            cut = [words(t) for t in texts]
            marks: list = [[] for _ in cut]
            for i in range(len(shards)):
                automaton = _load(shards, i, window)
                for k, ws in enumerate(cut):
                    if ws:
                        marks[k].append(automaton.hits(ws, np)[0])
            changed = False
            for k, ws in enumerate(cut):
                spans = _join(marks[k])
                keep.append(sum(y - x for x, y in spans) <= most_hit * len(ws))
                if spans and keep[-1]:
                    texts[k] = _without(texts[k], spans)
                    changed = True
            if changed:
                place = b.schema.get_field_index("text")
                b = b.set_column(place, b.schema.field(place), pa.array(texts, b.schema.field(place).type))
            if "n_chars" in columns and changed:
                place = b.schema.get_field_index("n_chars")
                old = b.column("n_chars").to_pylist()
                sizes = [len(t) if marks[k] and any(marks[k]) and t is not None else old[k] for k, t in enumerate(texts)]
                b = b.set_column(place, b.schema.field(place), pa.array(sizes, b.schema.field(place).type))
            yield b.filter(pa.array(keep, pa.bool_()))

    return run


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_hit: float = MOST_HIT) -> DataFrame:
    """`docs` without the marked stretches (n_chars follows); texts hit in more than `most_hit` of their words go."""
    ship(docs.sparkSession)
    shards = broadcast_items(benchmark, window)
    return docs.mapInArrow(_clean(shards, window, docs.columns, most_hit), docs.schema)


def op9(spark, sf_dir: str) -> DataFrame:
    """Query: contamination of all documents by all items."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return scan(docs, items).drop("spans")


OP9_SQL = """
WITH i AS (SELECT item_id::VARCHAR AS item, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
g AS (SELECT DISTINCT item, CASE WHEN len(ws) < 10 THEN len(ws) ELSE 10 END AS n, array_to_string(ws[p + 1 : p + CASE WHEN len(ws) < 10 THEN len(ws) ELSE 10 END], ' ') AS g
  FROM i, unnest(range(0, greatest(1, len(ws) - 9))) AS u(p) WHERE len(ws) > 0),
d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM documents),
l AS (SELECT DISTINCT n FROM g),
w AS (SELECT rid, p, n, array_to_string(ws[p + 1 : p + n], ' ') AS g FROM d, l, unnest(range(0, len(ws) - n + 1)) AS u(p) WHERE len(ws) >= n),
m AS (SELECT rid, p, w.n, item FROM w JOIN g ON w.g = g.g AND w.n = g.n),
h AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM m) GROUP BY rid),
f AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM m) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.rid = h.rid LEFT JOIN f ON d.rid = f.rid
"""
