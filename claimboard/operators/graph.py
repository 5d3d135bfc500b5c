"""Graph refinement, fingerprint groups, closure under a product table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tables import ship, written


#: Nodes and edges up to which a graph is refined inside one task, and rows of whole graphs refined at a time.
FEW_ROWS, CHUNK_ROWS = 1_000_000, 200_000


def wl_refine(nodes: DataFrame, edges: DataFrame, rounds: int = 6, graph: str = "graph", few_rows: int = FEW_ROWS) -> DataFrame:
    """(graph, node, colour) after up to `rounds` rounds: a node's colour becomes the rank, within its graph, of its
    colour and the sorted colours of its neighbours. Stops when no colour changes.

    nodes: (graph, node, colour) with whole-number colours; edges: (graph, src, dst), both directions. Both are read
    twice. Graphs of at most `few_rows` nodes and edges stream through the tasks once, many at a time; larger ones are
    refined by joins, a table a round."""
    current = nodes.select(graph, "node", F.col("colour").cast("int").alias("colour")).filter(F.col(graph).isNotNull() & F.col("colour").isNotNull())
    edges = edges.select(graph, "src", "dst")
    if not rounds:
        return current
    sizes = current.select(graph).unionByName(edges.select(graph)).groupBy(graph).count()
    large = written(sizes.filter(F.col("count") > few_rows).select(graph), "large-graphs")
    if large.isEmpty():
        return _refine_streamed(current, edges, rounds, graph)
    part = lambda how: (df.join(large.hint("merge"), graph, how) for df in (current, edges))
    return _refine_streamed(*part("left_anti"), rounds, graph).unionByName(_refine_joined(*part("left_semi"), rounds, graph))


def _refine_joined(current: DataFrame, edges: DataFrame, rounds: int, graph: str) -> DataFrame:
    for _ in range(rounds):
        near = edges.join(current.select(graph, F.col("node").alias("dst"), F.col("colour").alias("c")).hint("merge"), [graph, "dst"])
        near = near.groupBy(graph, F.col("src").alias("node")).agg(F.sort_array(F.collect_list("c")).alias("around"))
        joined = current.join(near.hint("merge"), [graph, "node"], "left").withColumn("around", F.coalesce("around", F.array().cast("array<int>")))
        # rank the distinct signatures only, so that a graph's window holds as many rows as it has colours
        kinds = joined.select(graph, "colour", "around").distinct()
        kinds = kinds.withColumn("new", F.dense_rank().over(W.partitionBy(graph).orderBy("colour", "around")) - 1)
        after = written(joined.join(kinds.hint("merge"), [graph, "colour", "around"]).select(graph, "node", F.col("colour").alias("old"), F.col("new").alias("colour")), "colours")
        changed = after.filter("old <> colour").limit(1).count()
        current = after.select(graph, "node", "colour")
        if not changed:
            break
    return current


def refined(graphs, colours, src, dst, rounds: int):
    """Colours of nodes after the rounds. Nodes are their places in `graphs` (ascending) and `colours`, which edges name."""
    import numpy as np

    order = np.argsort(src, kind="stable")
    src, dst = src[order], dst[order]
    ends = np.cumsum(np.bincount(src, minlength=len(graphs))) * 4
    cuts = list(zip([0, *ends[:-1].tolist()], ends.tolist()))
    for _ in range(rounds):
        near = colours[dst]
        # big-endian bytes sort as the lists of colours do
        data = (near[np.lexsort((near, src))] + (1 << 31)).astype(">u4").tobytes()
        lists = [data[a:z] for a, z in cuts]
        place = {x: i for i, x in enumerate(sorted(set(lists)))}
        code = np.unique(colours, return_inverse=True)[1]
        key = (graphs * (code.max() + 1) + code) * len(place) + np.fromiter(map(place.__getitem__, lists), np.int64, len(lists))
        kinds, new = np.unique(key, return_inverse=True)
        first = np.full(graphs[-1] + 1, len(kinds))
        np.minimum.at(first, graphs, new)
        new = new - first[graphs]
        if np.array_equal(new, colours):
            break
        colours = new
    return colours


def _refine_streamed(nodes: DataFrame, edges: DataFrame, rounds: int, graph: str) -> DataFrame:
    """Rows are dealt by graph and sorted by it; a task holds whole graphs of about CHUNK_ROWS rows."""
    ship(nodes.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def refine(rows):
            is_node = pc.is_valid(rows.column("colour"))
            own, links = rows.filter(is_node), rows.filter(pc.invert(is_node))
            starts = pc.dictionary_encode(pa.chunked_array([*own.column(0).chunks, *links.column(0).chunks])).combine_chunks()
            names = pa.chunked_array([*own.column("a").chunks, *links.column("a").chunks, *links.column("b").chunks])
            names = names.dictionary_encode(null_encoding="encode").combine_chunks()
            g, name, n = starts.indices.to_numpy().astype(np.int64), names.indices.to_numpy().astype(np.int64), own.num_rows
            m, width = links.num_rows, len(names.dictionary) + 1
            key = np.concatenate((g[:n], g[n:], g[n:])) * width + name
            order = np.argsort(key[:n], kind="stable")
            known = key[:n][order]
            at = np.minimum(np.searchsorted(known, key[n:]), max(n - 1, 0))
            found = known[at] == key[n:] if n else np.zeros(2 * m, bool)
            both = found[:m] & found[m:]
            own = own.take(pa.array(order))
            colours = own.column("colour").to_numpy().astype(np.int64)
            if n:
                colours = refined(g[:n][order], colours, at[:m][both], at[m:][both], rounds)
            return pa.Table.from_arrays([own.column(0), own.column("a"), pa.array(colours.astype(np.int32))], names=[graph, "node", "colour"]).to_batches()

        held, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.num_rows
            if size < CHUNK_ROWS:
                continue
            rows = pa.Table.from_batches(held)
            # the last graph may go on in the next batch
            cut = size - pc.sum(pc.cast(pc.equal(rows.column(0), rows.column(0)[size - 1]), pa.int64())).as_py()
            if cut:
                yield from refine(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
                size -= cut
        if held:
            yield from refine(pa.Table.from_batches(held))

    kinds = dict(nodes.dtypes)
    null = lambda name, kind: F.lit(None).cast(kind).alias(name)
    rows = nodes.select(graph, F.col("node").alias("a"), null("b", kinds["node"]), "colour")
    rows = rows.unionByName(edges.select(graph, F.col("src").alias("a"), F.col("dst").alias("b"), null("colour", "int")).filter("a IS NOT NULL AND b IS NOT NULL"))
    dealt = rows.filter(F.col(graph).isNotNull()).repartition(graph).sortWithinPartitions(graph)
    return dealt.mapInArrow(run, f"`{graph}` {kinds[graph]}, node {kinds['node']}, colour int")


def graph_signature(sizes: DataFrame, colours: DataFrame, graph: str = "graph") -> DataFrame:
    """(graph, signature): 16 hex digits of the SHA-256 of the JSON text of [n, k, d, sorted colours]."""
    lists = colours.groupBy(graph).agg(F.sort_array(F.collect_list("colour")).alias("c"))
    text = F.concat(F.lit("["), F.concat_ws(", ", *(F.col(x).cast("string") for x in ("n", "k", "d"))), F.lit(", ["), F.array_join(F.col("c").cast("array<string>"), ", "), F.lit("]]"))
    return sizes.join(lists, graph).select(graph, F.substring(F.sha2(text, 256), 1, 16).alias("signature"))


def duplicate_groups(df: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """(fingerprint, key, n): the keys of fingerprints that `n` keys, more than one, share, one row a key."""
    pairs = df.filter(F.col(fingerprint).isNotNull()).select(fingerprint, key).distinct()
    shared = pairs.groupBy(fingerprint).agg(F.count("*").alias("n")).filter("n > 1")
    return pairs.join(shared.hint("merge"), fingerprint).select(fingerprint, key, "n")


def soft_duplicate_groups(df: DataFrame, key: str, signature: str, fingerprint: str) -> DataFrame:
    """(signature, key, n): the same of signatures, without those whose keys all have one fingerprint."""
    kinds = df.groupBy(signature).agg(F.min(fingerprint).alias("_lo"), F.max(fingerprint).alias("_hi")).filter("_lo <> _hi").select(signature)
    return duplicate_groups(df, key, signature).join(kinds.hint("merge"), signature, "left_semi")


def duplicate_of(candidates: DataFrame, board: DataFrame, key: str = "key") -> DataFrame:
    """(key, exact_of, similar_of): the first board key with the same fingerprint, else with the same signature and
    another fingerprint. Both tables: (key, fp, sig).

    Of each signature the two fingerprints with the least keys are enough: a candidate takes the first of them that is
    not its own. So no candidate meets all rows of its signature."""
    exact = board.groupBy("fp").agg(F.min(key).alias("exact_of"))
    firsts = board.filter("fp IS NOT NULL").groupBy("sig", "fp").agg(F.min(key).alias("_k"))
    place = F.row_number().over(W.partitionBy("sig").orderBy("_k", "fp"))
    two = firsts.withColumn("_place", place).filter("_place <= 2").groupBy("sig")
    at = lambda n, c: F.max(F.when(F.col("_place") == n, F.col(c)))
    two = two.agg(at(1, "_k").alias("_k1"), at(1, "fp").alias("_fp1"), at(2, "_k").alias("_k2"))
    out = candidates.select(key, "fp", "sig").join(exact.hint("merge"), "fp", "left").join(two.hint("merge"), "sig", "left")
    similar = F.when(F.col("fp") == F.col("_fp1"), F.col("_k2")).when(F.col("fp").isNotNull(), F.col("_k1"))
    return out.select(key, "exact_of", F.when(F.col("exact_of").isNull(), similar).alias("similar_of"))


def first_wins(df: DataFrame, fingerprint: list[str], order: list) -> DataFrame:
    """The first row of each fingerprint."""
    rank = F.row_number().over(W.partitionBy(*fingerprint).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def degrees(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """Members per key."""
    return rows.groupBy(*by).agg(F.count("*").alias(name))


def closure(generators: DataFrame, mul: DataFrame, group: str = "grp") -> DataFrame:
    """(grp, g): least set that holds the generators and is closed under the table mul(grp, g, h, gh).

    Semi-naive: only products with an element found in the last round are formed."""
    known = written(generators.select(group, "g").distinct(), "closure")
    frontier = known
    while True:
        left = frontier.join(mul, [group, "g"]).join(known.select(group, F.col("g").alias("h")), [group, "h"]).select(group, F.col("gh").alias("g"))
        right = frontier.select(group, F.col("g").alias("h")).join(mul, [group, "h"]).join(known, [group, "g"]).select(group, F.col("gh").alias("g"))
        fresh = written(left.union(right).distinct().join(known, [group, "g"], "left_anti"), "frontier")
        if not fresh.limit(1).count():
            return known
        known, frontier = written(known.union(fresh), "closure"), fresh


def cosets(mul: DataFrame, subgroup: DataFrame, group: str = "grp") -> DataFrame:
    """(grp, g, rep, coset): each element's least element of gH, and the coset's number by representative."""
    least = mul.join(subgroup.select(group, F.col("g").alias("h")), [group, "h"]).groupBy(group, "g").agg(F.min("gh").alias("rep"))
    return least.withColumn("coset", F.dense_rank().over(W.partitionBy(group).orderBy("rep")) - 1)


def inverses(mul: DataFrame, group: str = "grp", identity: int = 0) -> DataFrame:
    """(grp, g, inv)."""
    return mul.filter(F.col("gh") == identity).select(group, "g", F.col("h").alias("inv"))


def normaliser(mul: DataFrame, subgroup: DataFrame, group: str = "grp") -> DataFrame:
    """(grp, g): elements that conjugate every member of the subgroup into it (relational division)."""
    gh = mul.join(subgroup.select(group, F.col("g").alias("h")), [group, "h"]).select(group, "g", "gh")
    inv = inverses(mul, group)
    back = mul.select(group, F.col("g").alias("gh"), F.col("h").alias("inv"), F.col("gh").alias("image"))
    images = gh.join(inv, [group, "g"]).join(back, [group, "gh", "inv"])
    outside = images.join(subgroup.select(group, F.col("g").alias("image")), [group, "image"], "left_anti").select(group, "g").distinct()
    return mul.select(group, "g").distinct().join(outside, [group, "g"], "left_anti")


def group_index(mul: DataFrame, subgroup: DataFrame, group: str = "grp") -> DataFrame:
    """(grp, idx): elements over members of the subgroup."""
    whole = mul.groupBy(group).agg(F.count_distinct("g").alias("a"))
    part = subgroup.groupBy(group).agg(F.count_distinct("g").alias("b"))
    return whole.join(part, group).select(group, (F.col("a") / F.col("b")).cast("long").alias("idx"))


def slot_conflicts(ops: DataFrame, group: list[str], element: str, shown: int = 3) -> DataFrame:
    """Groups in which an element is used more than once, with the first such elements."""
    twice = ops.groupBy(*group, element).agg(F.count("*").alias("c")).filter("c > 1")
    return twice.groupBy(*group).agg(F.count("*").alias("n_conflicts"), F.slice(F.sort_array(F.collect_list(element)), 1, shown).alias("shown"))
