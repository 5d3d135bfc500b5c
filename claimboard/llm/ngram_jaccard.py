"""N-gram Jaccard join by multiple-global-order filtering (operator 6).

A document's set is its distinct 5-word shingles as 64-bit hashes; equal sets are one node. Two sets with
100 * intersection >= 80 * union share, under any global order of tokens, at least min(p - (n - o)) of the first
p = n - ceil(0.8 n) + 1 tokens of each, where o is the intersection they need. Four orders are used: frequent tokens
last and the rest by a hash (A), ascending (B) and descending (C) token value, and, among the tokens of A's prefixes
that are shared at all, rarest first (D).

A node stays open while, for some size of a partner, as many tokens of its A prefix as a link of these sizes needs also
stand in the A prefix of nodes of other components, with sizes up to or from that one; most texts, even those with a
passage that many share, close at once, and only open nodes' sets are made. Every open node is first compared with its
star, the node that is most often the most central among those of its tokens (about its size); links merge components
and close more nodes. A node that shares only v tokens with its star, where every link that it may still have needs
o > v, must share o - v tokens outside the star with whatever it links to: it is met through those alone, rarest first.
That is done where the star has at least a fifth of its set, as else nearly all of the set is outside, which is far more
than its prefix. Other open nodes of different components are candidates if they share a token of their D prefixes. Of both
kinds only pairs that share as many tokens of their A prefixes as linked sets of their sizes do stay candidates; these are
counted on the open nodes' few tokens, as pairs that share one passage grow with the square of its texts. Of
the candidates found past stars, each node's best is tried first, and pairs that links have joined by then are left out.
Candidates must also share enough of their B and C prefixes; what passes all orders is verified on whole sets. No group
of copies emits all its pairs: copies of one component are never paired, and a token's largest component is only met by
the nodes outside it.

Which tokens count as frequent is found over all documents (counts per run of TALLY_TOKENS tokens, summed) and
bounded at FREQUENT_MOST; any such choice gives a valid order, so the bound costs time only, never a pair. A token
that is not found frequent is looked at in one task with the others of its bucket.

Defined results: null, empty and blank texts have no set, 0 shingles and are linked with nothing, each being its
own component; rows that share a doc_id are one document whose rows are linked; rows without doc_id are reported
with a null component and linked with nothing; an empty table gives an empty table; other columns are ignored
by join() and carried by one_of_each().
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tables import setting
from .common import BROADCAST_ROWS, drop, fresh, ship, sized_join, table

WORDS, SHARE = 5, 80
TALLY_TOKENS, TALLY_LEAST, FREQUENT_LEAST, FREQUENT_MOST = 2_000_000, 3, 8, 200_000
#: Postings a bucket should hold, and the width of size classes in which stars are formed.
BUCKET_POSTINGS, CLASS_WIDTH = 400_000, 1.1
#: Words hashed at a time and the base of the hash.
PIECE, BASE = 100_000, 0x9E3779B97F4A7C15
#: Bits of the map of documents whose sets are wanted, for each of them, and at most (128 MB); beyond that, a join.
MAP_SHARE, MAP_BITS = 64, 1 << 30
#: Tasks that a map is read from, one after the other (at most 16 MB each), or that make a table counted as small.
FEW_TASKS = 8
#: The same for maps of tokens; tokens that such a map lets through meet nothing, so their bound costs time only.
TOKEN_SHARE = 32
#: Rows that a counted table of two or three numbers may have to be broadcast.
SLIM_ROWS = 500_000
_memo: dict = {}


def _mix(x, seed: int):
    """Bijective 64-bit mixing."""
    import numpy as np

    x = x ^ np.uint64(seed)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int):
    """Byte values, and powers of an odd base and of its inverse, modulo 2^64."""
    import numpy as np

    if len(_memo.get("up", ())) < n:
        size = max(n, 1 << 17)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _memo[name] = np.multiply.accumulate(steps)
        _memo["byte"] = _mix(np.arange(1, 257, dtype=np.uint64), 0x5EED)
    return _memo["byte"], _memo["up"], _memo["down"]


def shingles(text: str | None):
    """Sorted distinct shingle hashes of a text: polynomial hashes of the bytes from a word's start to the end of the
    fourth word after it, taken from running sums, PIECE words at a time."""
    import numpy as np

    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return np.zeros(0, np.uint64)
    out = []
    for at in range(0, max(len(ws) - WORDS + 1, 1), PIECE):
        part = ws[at : at + PIECE + WORDS - 1]
        data = np.frombuffer(b" ".join(part), np.uint8)
        byte, up, down = _powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(byte[data] * up[: len(data)], out=total[1:])
        gaps = np.flatnonzero(data == 32)
        starts = np.concatenate(([0], gaps + 1))
        ends = np.concatenate((gaps, [len(data)]))
        width = min(len(part), WORDS)
        starts, ends = starts[: len(part) - width + 1], ends[width - 1 :]
        out.append(_mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64), 0))
    found = np.concatenate(out) if len(out) > 1 else out[0]
    found.sort()
    new = np.empty(len(found), bool)
    new[0] = True
    np.not_equal(found[1:], found[:-1], out=new[1:])
    return found[new]


def prefix_length(n: int) -> int:
    """Tokens of a set of n of which one must be shared."""
    return n - (SHARE * n + 99) // 100 + 1


def _node(tokens) -> int:
    import numpy as np
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64))


def _tally(batches):
    import numpy as np
    import pyarrow as pa

    held, size = [], 0

    def emit():
        tokens, counts = np.unique(np.concatenate(held), return_counts=True)
        keep = counts >= TALLY_LEAST
        return pa.RecordBatch.from_arrays([pa.array(tokens[keep].astype(np.int64)), pa.array(counts[keep].astype(np.int64))], ["token", "n"])

    for b in batches:
        for t in b.column("text").to_pylist():
            held.append(shingles(t))
            size += len(held[-1])
            if size >= TALLY_TOKENS:
                yield emit()
                held, size = [], 0
    if held:
        yield emit()


NODES = "doc_id long, n long, node long"


def _nodes(batches):
    import pyarrow as pa

    for b in batches:
        sets = [shingles(t) for t in b.column("text").to_pylist()]
        node = [_node(s) if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(list(map(len, sets)), pa.int64()), pa.array(node, pa.int64())], ["doc_id", "n", "node"])


POSTINGS = "bucket int, part int, tokens binary, nodes binary, sizes binary"


def _postings(frequent, bits: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        often, part = frequent.value, TaskContext.get().partitionId()
        names = [x.split()[0] for x in POSTINGS.split(", ")]

        def flush(tokens, nodes, sizes):
            t = np.concatenate(tokens)
            counts = list(map(len, tokens))
            d, s = np.repeat(np.array(nodes, np.int64), counts), np.repeat(np.array(sizes, np.int32), counts)
            # frequent tokens leave in rows of their own, with bucket -1 and this task's part
            at = np.searchsorted(often, t)
            heavy = (often[np.minimum(at, len(often) - 1)] == t) if len(often) else np.zeros(len(t), bool)
            bucket = np.where(heavy, -1, (t >> np.uint64(64 - bits)).astype(np.int64) if bits else 0)
            order = np.argsort(bucket, kind="stable")
            t, d, s, bucket = t[order], d[order], s[order], bucket[order]
            keys, starts = np.unique(bucket, return_index=True)
            ends = [*starts[1:].tolist(), len(t)]
            rows = [[k, part if k < 0 else 0, t[a:z].tobytes(), d[a:z].tobytes(), s[a:z].tobytes()] for k, a, z in zip(keys.tolist(), starts.tolist(), ends)]
            columns = [pa.array(c, k) for c, k in zip(map(list, zip(*rows)), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, names)

        tokens, nodes, sizes, held = [], [], [], 0
        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                s = shingles(text)
                if not len(s) or doc is None:
                    continue
                rank = _mix(s, 0x1234567) >> np.uint64(1)
                if len(often):
                    at = np.minimum(np.searchsorted(often, s), len(often) - 1)
                    rank = rank | ((often[at] == s).astype(np.uint64) << np.uint64(63))
                p = prefix_length(len(s))
                tokens.append(s[np.argpartition(rank, p - 1)[:p]])
                nodes.append(_node(s))
                sizes.append(len(s))
                held += p
                if held >= 1_000_000:
                    yield flush(tokens, nodes, sizes)
                    tokens, nodes, sizes, held = [], [], [], 0
        if held:
            yield flush(tokens, nodes, sizes)

    return run


SHARED = "token long, node long, n long"


def _shared(group):
    """Postings of one bucket whose token another node of a size that could link has too. Frequent tokens pass."""
    import numpy as np
    import pyarrow as pa

    read = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in group.column(c).to_pylist()])
    t, d, n = read("tokens", np.uint64), read("nodes", np.int64), read("sizes", np.int32).astype(np.int64)
    if group.column("bucket")[0].as_py() >= 0:
        order = np.lexsort((d, n, t))
        t, d, n = t[order], d[order], n[order]
        new = np.concatenate([[True], (t[1:] != t[:-1]) | (d[1:] != d[:-1])])
        t, d, n = t[new], d[new], n[new]
        # sizes ascend inside a token, so the nearest ones are neighbours
        near = (t[1:] == t[:-1]) & (100 * n[:-1] >= SHARE * n[1:])
        keep = np.concatenate([near, [False]]) | np.concatenate([[False], near])
        t, d, n = t[keep], d[keep], n[keep]
    return pa.Table.from_arrays([pa.array(t.astype(np.int64)), pa.array(d), pa.array(n)], names=["token", "node", "n"])


SETS = "node long, tokens binary"


def _sets(wanted):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        bits = wanted.value if wanted else None
        for b in batches:
            if bits is not None:
                place = b.column("place").to_numpy(zero_copy_only=False)
                b = b.take(pa.array(np.flatnonzero(_marked(bits, place))))
            sets = [x for x in map(shingles, b.column("text").to_pylist()) if len(x)]
            yield pa.RecordBatch.from_arrays([pa.array([_node(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "tokens"])

    return run


def _bit_map(keys: DataFrame, place, share: int):
    """A broadcast bit map of the keys' places, `share` bits a key and at most MAP_BITS, and its size. `place` gives a
    key's place in a map of a given size."""
    import numpy as np

    size = min(MAP_BITS, max(1 << 15, 1 << (share * max(keys.count(), 1) - 1).bit_length()))
    maps = keys.groupBy(F.bitmap_bucket_number(place(size) + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place(size) + 1)).alias("bits"))
    out = np.zeros(size // 8, np.uint8)
    for r in maps.coalesce(FEW_TASKS).toLocalIterator():  # a job a task: of as many as shuffles have, each would do little
        # bucket b holds the values (b - 1) * 32768 + 1 to b * 32768
        out[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return keys.sparkSession.sparkContext.broadcast(out), size


def _marked(bits, place):
    """Which places of an array are set in a bit map."""
    import numpy as np

    return (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def _sets_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Written sets of the nodes of the documents `wanted` (doc_id), made anew from their texts. Documents are found
    by a bit map of their hashed ids, MAP_SHARE bits each, which lets a few more through; they find no partner."""
    known = texts.filter("doc_id IS NOT NULL")
    if MAP_SHARE * wanted.count() > MAP_BITS:
        return table(known.join(wanted.hint("merge"), "doc_id", "left_semi").select("text").mapInArrow(_sets(None), SETS), "jaccard-sets")
    place = lambda size: F.pmod(F.xxhash64("doc_id"), F.lit(size))
    sent, size = _bit_map(wanted, place, MAP_SHARE)
    return table(known.select("text", place(size).alias("place")).mapInArrow(_sets(sent), SETS), "jaccard-sets")


def _asked(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Sets of `nodes` (node) and a few more, found by a bit map, so that the others are not shuffled."""
    sent, size = _bit_map(nodes, lambda size: F.pmod("node", F.lit(size)), MAP_SHARE)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            place = b.column("node").to_numpy(zero_copy_only=False) & np.int64(size - 1)
            yield b.filter(pa.array(_marked(sent.value, place)))

    return sets.select("node", "tokens").mapInArrow(run, SETS)


def _sets_in(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """The same, written."""
    return table(_asked(sets, nodes), "jaccard-asked")


def _slim_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """sized_join() to a written table of two or three numbers a row, of which more may be broadcast."""
    return left.join(F.broadcast(right) if right.count() <= SLIM_ROWS else right.hint("merge"), on, how)


def _needed(na, nb):
    """Prefix tokens that two linked sets of these sizes must share."""
    both = F.floor((SHARE * (na + nb) + 99 + SHARE) / (100 + SHARE))
    spare = lambda n: (n - F.ceil(n * SHARE / 100) + 1) - (n - both)
    return F.greatest(F.least(spare(na), spare(nb)), F.lit(1))


def linked(x, y, np) -> bool:
    """Whether two sorted sets link: they must share as many prefix tokens under orders B and C as linked sets do;
    their whole intersection decides."""
    nx, ny = len(x), len(y)
    if 100 * min(nx, ny) < SHARE * max(nx, ny):
        return False
    px, py = prefix_length(nx), prefix_length(ny)
    both = -(-SHARE * (nx + ny) // (100 + SHARE))
    least = max(min(px - (nx - both), py - (ny - both)), 1)
    shared = lambda p, q: len(np.intersect1d(p, q, assume_unique=True))
    if shared(x[:px], y[:py]) < least or shared(x[-px:], y[-py:]) < least:
        return False
    return 100 * (both := shared(x, y)) >= SHARE * (nx + ny - both)


def _verify(batches):
    import numpy as np
    import pyarrow as pa

    for b in batches:
        x, y = b.column("x").to_pylist(), b.column("y").to_pylist()
        keep = [linked(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), np) for p, q in zip(x, y)]
        yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that link, written; `pairs` are written."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    sets = _sets_in(sets, table(nodes, "jaccard-asked-nodes"))
    first = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
    second = sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    joined = sized_join(first, pairs, ["a"]).join(second.hint("merge"), "b").select("a", "b", "x", "y")
    out = table(joined.mapInArrow(_verify, "a long, b long").distinct(), "jaccard-linked")
    drop(sets)
    return out


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for the nodes of `links` (a, b): least node reachable. Each round takes the least label among
    a node and its neighbours and then that label's label; labels are written each round. Where links are counted as
    few, labels are broadcast and made in few tasks, so that a round shuffles once and writes few files."""
    edges = table(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "jaccard-edges")
    few = edges.count() <= BROADCAST_ROWS
    sent = lambda df: F.broadcast(df) if few else df.hint("merge")
    made = lambda df: table(df.coalesce(FEW_TASKS) if few else df, "jaccard-labels")
    labels = made(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("comp")))
    while True:
        near = edges.join(sent(labels.select(F.col("node").alias("b"), F.col("comp").alias("other"))), "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("other"))
        best = near.join(sent(labels), "node").select("node", "comp", F.least("comp", "other").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("comp").alias("far"))
        best = made(best.join(sent(jump), "new").select("node", F.col("comp").alias("old"), F.least("new", "far").alias("comp")))
        drop(labels)
        labels = best.select("node", "comp")
        if best.filter("old <> comp").isEmpty():
            drop(edges)
            return labels


def _open(shared: DataFrame, repeated: bool = False) -> DataFrame:
    """Postings (token, node, n, comp, top) that may still serve a link between components: their token stands in another
    component at a size that could link and is below `top`, and for some size their node has as many such tokens as a link
    to it needs. Nodes are given with their number of them (`c`), how many more that is than the least that a link needs,
    plus 1 (`spare`), and the least size that a partner may have (`least`). Postings that may be `repeated` count once."""
    near = math.ceil(-math.log(SHARE / 100) * 1e9) + 2
    # dealt by token once: both sides of the join read the same exchange, as they use the same columns and filters
    shared = shared.filter(" AND ".join(f"{c} IS NOT NULL" for c in shared.columns)).repartition("token")
    once = shared.dropDuplicates(["token", "node"]) if repeated else shared
    sizes = shared.groupBy("token", "n").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.struct("node", "top")).alias("any")).filter("any.node IS NOT NULL AND any.top IS NOT NULL")
    around = W.partitionBy("token").orderBy((F.log("n") * 1e9).cast("long")).rangeBetween(-near, near)
    ranged = sizes.select("token", "n", F.min("lo").over(around).alias("lo"), F.max("hi").over(around).alias("hi"), F.min("n").over(around).alias("from"), F.max("n").over(around).alias("to"))
    mixed = once.join(ranged.filter("lo <> hi").hint("merge"), ["token", "n"]).filter("from < top")
    # the need rises up to a partner of equal size and falls beyond, where rounding may lift it by one before it falls
    low, high = _needed(F.col("n"), F.col("from")), F.least(_needed(F.col("n"), F.col("to")), _needed(F.col("n"), F.col("to") - 1))
    mine = W.partitionBy("node")
    # the tokens that a partner of some size shares all have a `from` up to it and a `to` from it
    fits = (F.row_number().over(mine.orderBy("from")) >= low) | (F.row_number().over(mine.orderBy(F.desc("to"))) >= high)
    met = mixed.select("token", "node", "n", "comp", "top", "from", fits.alias("fits"), F.least(low, high).alias("need"))
    nodes = met.select("*", F.count("*").over(mine).alias("c"), F.min("from").over(mine).alias("least"), F.max("fits").over(mine).alias("open"), F.min("need").over(mine).alias("needed"))
    nodes = nodes.filter("open").withColumn("spare", F.col("c") - F.col("needed") + 1).filter("spare > 0")
    return nodes.select("node", "token", "n", "comp", "top", "c", "least", "spare")


def _open_table(shared: DataFrame, repeated: bool = False) -> DataFrame:
    """_open(), written; its join by token and size takes sides that are dealt by token."""
    with setting(shared.sparkSession, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
        return table(_open(shared, repeated), "jaccard-open")


def _stars(shared: DataFrame) -> DataFrame:
    """One pair (a, b) for each open node a, if any: b is most often the most central node, by the share of its
    prefix that is shared and then by size, among those of a's tokens and size class."""
    classed = shared.select("token", "node", "n", "c").repartition("token").withColumn("class", F.floor(F.log("n") / math.log(CLASS_WIDTH)))
    prefix = F.col("n") - F.ceil(F.col("n") * SHARE / 100) + 1
    rank = F.struct((F.col("c") / prefix).alias("share"), F.col("n").alias("size"), F.col("node").alias("b"))
    order = W.partitionBy("token", "class").orderBy(F.desc("best")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    met = classed.withColumn("best", rank).select("node", F.first("best").over(order).alias("p"), F.nth_value("best", 2).over(order).alias("q"))
    other = F.when(F.col("p.b") != F.col("node"), F.col("p")).otherwise(F.col("q"))
    votes = met.select(F.col("node").alias("a"), other.alias("other")).filter("a <> other.b")
    votes = votes.groupBy("a", F.col("other.b").alias("b"), F.col("other.share").alias("share"), F.col("other.size").alias("size")).agg(F.count("*").alias("votes"))
    return votes.groupBy("a").agg(F.max_by("b", F.struct("votes", "share", "size", "b")).alias("b"))


COMPARED = "a long, b long, n long, both long, linked boolean, outside array<long>"


def _compare(batches):
    import numpy as np
    import pyarrow as pa

    for b in batches:
        out = []
        for p, q in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
            x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            rest = np.setdiff1d(x, y, assume_unique=True)
            both = len(x) - len(rest)
            near = 100 * both >= SHARE * (len(y) + len(rest))
            out.append([len(x), both, near, None if near or 5 * both < len(x) else rest.view(np.int64)])
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()))
        arrays = [pa.array(c, k) for c, k in zip(map(list, zip(*out)), kinds)] if out else [pa.array([], k) for k in kinds]
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), *arrays], [x.split()[0] for x in COMPARED.split(", ")])


def _explode_sets(marked, size: int):
    """(token, node) of sets, for the tokens that a bit map has."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            parts = [np.frombuffer(x, np.int64) for x in b.column("tokens").to_pylist()]
            parts = [x[_marked(marked.value, x & np.int64(size - 1))] for x in parts]
            owner = np.repeat(np.arange(len(parts)), list(map(len, parts)))
            token = pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([token, b.column("node").take(pa.array(owner))], ["token", "node"])

    return run


def _past_stars(nodes: DataFrame, compared: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For the open nodes (node, n, comp, least) whose star has a fifth of their set and does not link to them: (node, top), and
    all pairs (a, b) of one of them (`node`) and an open node of another component and of size `top` or more that share
    one of the rarest tokens outside the star, with how many (`votes`). Up to `top` a link may need no such token."""
    far = sized_join(compared.filter("outside IS NOT NULL").select(F.col("a").alias("node"), "both", "outside"), nodes, ["node"])
    top = F.floor((100 + SHARE) * F.col("both") / SHARE) - F.col("n") + 1
    meets = F.floor((SHARE * (F.col("n") + F.greatest(F.col("least"), top)) + 99 + SHARE) / (100 + SHARE))
    far = table(far.select("node", "n", "comp", top.alias("top"), (meets - F.col("both")).alias("need"), "outside"), "jaccard-far")
    own = table(far.select("node", F.explode("outside").alias("token")), "jaccard-outside")
    tokens = table(own.select("token").distinct(), "jaccard-outside-tokens")
    marked, size = _bit_map(tokens, lambda size: F.pmod("token", F.lit(size)), TOKEN_SHARE)
    every = sets.select("node", "tokens").mapInArrow(_explode_sets(marked, size), "token long, node long")
    every = _slim_join(every, nodes.select("node", "n", "comp"), ["node"])
    every = table(every.select("token", "node", "n", "comp"), "jaccard-met")
    lists = every.groupBy("token").agg(F.count("*").alias("df"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
    mine = W.partitionBy("node")
    met = own.join(lists.select("token", "df").hint("merge"), "token")
    met = met.select("node", "token", F.row_number().over(mine.orderBy("df", "token")).alias("place"), F.count("*").over(mine).alias("c"))
    met = sized_join(met, far.drop("outside"), ["node"])
    prefix = table(met.filter("place <= c - need + 1").select("token", "node", "n", "comp", "top"), "jaccard-outside-prefix")
    x, y = prefix.alias("x"), every.alias("y")
    close = (F.col("x.comp") != F.col("y.comp")) & (100 * F.least("x.n", "y.n") >= SHARE * F.greatest("x.n", "y.n")) & (F.col("y.n") >= F.col("x.top"))
    found = x.join(y.hint("merge"), (F.col("x.token") == F.col("y.token")) & close)
    found = found.groupBy(F.col("x.node").alias("node"), F.col("y.node").alias("other")).agg(F.count("*").alias("votes"))
    pairs = table(found.select("node", F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"), "votes"), "jaccard-past-stars")
    drop(own, tokens, every, prefix)
    return far.select("node", "top"), pairs


def _across(shared: DataFrame) -> DataFrame:
    """Pairs (a, b) of open nodes of different components and near sizes, each smaller than the other's `top`, that
    share a token of their D prefixes."""
    lists = shared.groupBy("token", "comp").agg(F.count("*").alias("size"))
    lists = lists.groupBy("token").agg(F.sum("size").alias("df"), F.max(F.struct("size", "comp"))["comp"].alias("main"))
    ordered = shared.join(lists.hint("merge"), "token").withColumn("place", F.row_number().over(W.partitionBy("node").orderBy("df", "token")))
    prefix = table(ordered.filter("place <= spare").select("token", "node", "n", "comp", "top", (F.col("comp") == F.col("main")).alias("inside")), "jaccard-prefix")
    x, y = prefix.filter("NOT inside").alias("x"), prefix.alias("y")
    close = (F.col("x.comp") != F.col("y.comp")) & (100 * F.least("x.n", "y.n") >= SHARE * F.greatest("x.n", "y.n")) & (F.col("y.inside") | (F.col("x.node") < F.col("y.node")))
    close &= (F.col("y.n") < F.col("x.top")) & (F.col("x.n") < F.col("y.top"))
    found = x.join(y.hint("merge"), (F.col("x.token") == F.col("y.token")) & close)
    return table(found.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), "jaccard-across")


def _sharing(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """Those of the written `pairs` (a, b) of open nodes that share as many tokens of their A prefixes as a link of their
    sizes needs; `lists` has the open nodes' (node, n, tokens). What two nodes of different components share is in both lists."""
    met = pairs
    for node, n, tokens in (("a", "na", "x"), ("b", "nb", "y")):
        met = met.join(lists.select(F.col("node").alias(node), F.col("n").alias(n), F.col("tokens").alias(tokens)).hint("merge"), node)
    return met.filter(F.size(F.array_intersect("x", "y")) >= _needed(F.col("na"), F.col("nb"))).select(*pairs.columns)


def join(docs: DataFrame) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, n_shingles and component_id."""
    import numpy as np

    spark = docs.sparkSession
    ship(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    often = texts.select("text").mapInArrow(_tally, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    often = often.filter(F.col("n") >= FREQUENT_LEAST).orderBy(F.desc("n"), "token").limit(FREQUENT_MOST).select("token").collect()
    frequent = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in often], np.int64).astype(np.uint64)))

    nodes = table(texts.mapInArrow(_nodes, NODES), "jaccard-nodes")
    named = nodes.filter("doc_id IS NOT NULL AND node IS NOT NULL")
    reps = table(named.groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")), "jaccard-reps")
    total = reps.agg(F.coalesce(F.sum(F.col("n") - F.ceil(F.col("n") * SHARE / 100) + 1), F.lit(0))).first()[0]
    bits = max(0, int(np.ceil(np.log2(max(total, 1) / BUCKET_POSTINGS)))) if total > BUCKET_POSTINGS else 0

    postings = texts.mapInArrow(_postings(frequent, bits), POSTINGS).groupBy("bucket", "part").applyInArrow(_shared, SHARED)
    shared = table(postings, "jaccard-shared")
    endless = F.lit((1 << 62)).alias("top")
    left = _open_table(shared.select("*", F.col("node").alias("comp"), endless), repeated=True)
    drop(shared)
    open_ids = reps.join(left.select("node").distinct().hint("merge"), "node", "left_semi").select(F.col("rep").alias("doc_id"))
    sets = _sets_of(texts, table(open_ids, "jaccard-wanted"))

    pairs = table(_stars(left), "jaccard-stars")
    stars = _asked(sets, table(pairs.select(F.col("b").alias("node")).distinct(), "jaccard-asked-nodes"))
    first = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x"))
    second = stars.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    compared = _slim_join(first, pairs, ["a"]).join(second.hint("merge"), "b").select("a", "b", "x", "y")
    compared = table(compared.mapInArrow(_compare, COMPARED).dropDuplicates(["a"]), "jaccard-compared")
    links = compared.filter("linked").select("a", "b")

    def relabelled(postings: DataFrame, found: DataFrame) -> DataFrame:
        return _slim_join(postings, found, ["node"], "left").withColumn("comp", F.coalesce("comp", "node"))

    left = _open_table(relabelled(left.select("token", "node", "n", "top"), components(links)))
    open_nodes = table(left.select("node", "n", "comp", "least").distinct(), "jaccard-open-nodes")
    lists = table(left.groupBy("node").agg(F.max("n").alias("n"), F.collect_list("token").alias("tokens")), "jaccard-lists")
    far, past = _past_stars(open_nodes, compared, sets)
    past = table(_sharing(past, lists), "jaccard-past-stars")
    near = _slim_join(left.select("token", "node", "n", "comp"), far, ["node"], "left").withColumn("top", F.coalesce("top", endless))
    near = _open_table(near)
    # each node's most promising candidate first: what it links to may join it to all others
    # by how much the candidate has of its own star
    held = compared.select(F.col("a").alias("other"), "both")
    best = sized_join(past.withColumn("other", F.when(F.col("a") == F.col("node"), F.col("b")).otherwise(F.col("a"))), held, ["other"], "left")
    best = best.groupBy("node").agg(F.max_by(F.struct("a", "b"), F.struct(F.coalesce("both", F.lit(0)), "votes", F.xxhash64("a", "b"))).alias("best"))
    links = links.union(verify(table(best.select("best.*").distinct(), "jaccard-best"), sets))
    joined = components(links)
    pairs = past.select("a", "b").union(_sharing(_across(near), lists)).distinct()
    for node, comp in (("a", "ca"), ("b", "cb")):
        pairs = _slim_join(pairs, joined.select(F.col("node").alias(node), F.col("comp").alias(comp)), [node], "left").withColumn(comp, F.coalesce(comp, node))
    rest = table(pairs.filter("ca <> cb").select("a", "b"), "jaccard-rest")
    links = links.union(verify(rest, sets))
    same_id = named.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a <> b")
    same_id = named.join(same_id.hint("merge"), "doc_id").filter("node <> a").select("a", F.col("node").alias("b"))
    found = components(links.union(same_id))
    drop(sets, left, near, lists)

    comp_of = sized_join(reps.select("node", "rep"), found, ["node"], "left")
    grouped = table(comp_of.select("node", "rep", F.coalesce("comp", "node").alias("comp")), "jaccard-comps")
    least = grouped.groupBy("comp").agg(F.min("rep").alias("component_id"))
    by_node = table(grouped.join(least.hint("merge"), "comp").select("node", "component_id"), "jaccard-by-node")
    out = sized_join(nodes.select("doc_id", "n", "node"), by_node, ["node"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """`docs` with one document of each component: the one with the least doc_id (with all its rows)."""
    name, gone = fresh(docs, "_doc"), table(join(docs).filter("doc_id <> component_id").select("doc_id").distinct(), "jaccard-gone")
    gone = gone.withColumnRenamed("doc_id", name)
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone.hint("merge")
    return docs.withColumn(name, F.col("doc_id").cast("long")).join(gone, name, "left_anti").select(*docs.columns)


def op6(spark, sf_dir: str) -> DataFrame:
    """Query: components of near-duplicate documents."""
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[p + 1 : p + 5], ' ') AS g FROM d, unnest(range(0, greatest(1, len(ws) - 4))) AS u(p) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = d.doc_id
"""
