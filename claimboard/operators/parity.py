"""Parity (GF(2)) algebra as relations; packed group jobs only where ranks are needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import numbered, ship, written
from .normalize import bit_pack, xor_normalise

parity_agg = xor_normalise

#: Pairs of rows from which an element is heavy.
HEAVY_PAIRS = 1_000_000
#: Patterns of heavy elements in a block, and tasks that share a block's partners.
PATTERN_ROWS, PATTERN_SALTS = 4096, 16


def parity_product(a: DataFrame, b: DataFrame, on: list[str], row_a: str, row_b: str, group: list[str] | None = None, heavy_pairs: int = HEAVY_PAIRS) -> DataFrame:
    """Pairs of rows with an odd overlap: the product of A and B transposed. An empty result means they commute.

    An element that joins at most `heavy_pairs` pairs of rows is light: rows that share one meet in a join. The heavy
    elements of a row are packed into bit words; rows with the same words are one pattern, patterns are compared by
    the parity of common bits in blocks, and only odd pairs leave a block. A pair's parity is the sum of both parts,
    so an element in very many rows makes no pair list of its own. `on` has the columns of `group`, if any, among it."""
    group = list(group or [])
    keys = [*group, row_a, row_b]
    spark = a.sparkSession
    degrees = a.groupBy(*on).agg(F.count("*").alias("_na")).join(b.groupBy(*on).agg(F.count("*").alias("_nb")).hint("merge"), on)
    heavy = written(degrees.filter(F.col("_na").cast("double") * F.col("_nb") > heavy_pairs).select(*on), "heavy-elements")
    if heavy.isEmpty():
        return _odd(a, b, on, keys)
    ship(spark)
    numbers = written(numbered(heavy, [F.col(c) for c in on], "_bit"), "heavy-numbers")
    light = _odd(a.join(heavy.hint("merge"), on, "left_anti"), b.join(heavy.hint("merge"), on, "left_anti"), on, keys)
    packed = [_patterns(rows, numbers, on, group, row) for rows, row in ((a, row_a), (b, row_b))]
    blocks = [_pattern_blocks(rows, group) for rows in packed]
    salt = F.explode(F.sequence(F.lit(0), F.lit(PATTERN_SALTS - 1)))
    left = blocks[0].select(F.col("_grp").alias("_ga"), F.col("ids").alias("ids_a"), F.col("words").alias("words_a"), F.pmod(F.xxhash64("ids"), F.lit(PATTERN_SALTS)).cast("int").alias("_sa"))
    right = blocks[1].select("_grp", "ids", "words", salt.alias("_sb"))
    odd = left.join(right.hint("merge"), (F.col("_ga") == F.col("_grp")) & (F.col("_sa") == F.col("_sb"))).select("ids_a", "words_a", "ids", "words").mapInArrow(_odd_patterns, "_pa string, _pb string")
    rows_a = packed[0].select(F.col("_pattern").alias("_pa"), *group, row_a)
    rows_b = packed[1].select(F.col("_pattern").alias("_pb"), row_b)
    dense = written(odd, "odd-patterns").join(rows_a.hint("merge"), "_pa").join(rows_b.hint("merge"), "_pb").select(*keys)
    return light.unionByName(dense).groupBy(*keys).count().filter("count = 1").drop("count")


def _odd(a: DataFrame, b: DataFrame, on: list[str], keys: list[str]) -> DataFrame:
    met = a.join(b.hint("merge"), on).groupBy(*keys).agg(F.count("*").alias("_shared"))
    return met.filter("_shared % 2 = 1").drop("_shared")


def _patterns(rows: DataFrame, numbers: DataFrame, on: list[str], group: list[str], row: str) -> DataFrame:
    """(group..., row, _grp, _pattern): the row's heavy elements as 64-bit words, in a text that names group and words."""
    bits = xor_normalise(rows.join(numbers.hint("merge"), on).select(*group, row, (F.col("_bit") - 1).alias("_bit")), [*group, row], "_bit")
    words = bit_pack(bits, [*group, row], "_bit").groupBy(*group, row).agg(F.array_sort(F.collect_list(F.struct("word", "packed"))).alias("_words"))
    grp = F.to_json(F.struct(*group)) if group else F.lit("")
    text = F.array_join(F.transform("_words", lambda w: F.concat_ws(":", w["word"], w["packed"])), ",")
    return written(words.select(*group, row, grp.alias("_grp"), F.concat_ws(" ", text, grp).alias("_pattern")), "heavy-rows")


def _pattern_blocks(rows: DataFrame, group: list[str]) -> DataFrame:
    """(_grp, ids, words): blocks of at most PATTERN_ROWS distinct patterns of a group, as texts."""
    patterns = rows.select("_grp", "_pattern").distinct()
    sizes = patterns.groupBy("_grp").count()
    block = F.pmod(F.xxhash64("_pattern"), F.ceil(F.col("count") / PATTERN_ROWS) * 2)  # hashed evenly, so that a block is about half full
    dealt = patterns.join(sizes.hint("merge"), "_grp").groupBy("_grp", block.alias("_block")).agg(F.collect_list("_pattern").alias("ids"))
    return dealt.select("_grp", "ids", F.transform("ids", lambda p: F.split_part(p, F.lit(" "), F.lit(1))).alias("words"))


def _odd_patterns(batches):
    """Pairs of patterns with an odd number of common bits, block by block."""
    import numpy as np
    import pyarrow as pa

    def matrix(texts, words):
        out = np.zeros((len(texts), len(words)), np.uint64)
        at = {w: i for i, w in enumerate(words)}
        for i, t in enumerate(texts):
            for part in t.split(","):
                w, bits = part.split(":")
                if w in at:
                    out[i, at[w]] = np.uint64(int(bits) & (1 << 64) - 1)
        return out

    for b in batches:
        for ids_a, words_a, ids_b, words_b in zip(*(b.column(c).to_pylist() for c in ("ids_a", "words_a", "ids", "words"))):
            common = sorted({p.split(":")[0] for t in words_a for p in t.split(",")} & {p.split(":")[0] for t in words_b for p in t.split(",")})
            one, two = matrix(words_a, common), matrix(words_b, common)
            for i in range(0, len(one), 64):
                odd = np.zeros((len(one[i : i + 64]), len(two)), np.uint64)
                for j in range(len(common)):
                    odd ^= one[i : i + 64, j, None] & two[None, :, j]  # the parity of a xor is the sum of parities
                x, y = np.nonzero(np.bitwise_count(odd) & 1)
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array([ids_a[i + k] for k in x.tolist()]), pa.array([ids_b[k] for k in y.tolist()])], ["_pa", "_pb"])


def syndrome(vector: DataFrame, checks: DataFrame, on: list[str], check: list[str]) -> DataFrame:
    """Checks with an odd overlap with a vector. Neither side is broadcast: both may come from explode, whose size Spark
    underrates, as it does that of a written table that Parquet packs well."""
    met = checks.join(vector.hint("merge"), on).groupBy(*check).agg(F.count("*").alias("_shared"))
    return met.filter("_shared % 2 = 1").drop("_shared")


def nontrivial(vector: DataFrame, basis: DataFrame, on: list[str], keys: list[str], basis_row: str) -> DataFrame:
    """Keys whose vector overlaps some basis row oddly."""
    return syndrome(vector, basis, on, [*keys, basis_row]).select(*keys).distinct()


def _insert(basis: dict[int, int], v: int) -> None:
    """Add a vector to an echelon basis by leading bit."""
    while v:
        top = v.bit_length() - 1
        if top not in basis:
            basis[top] = v
            return
        v ^= basis[top]


def _stream(df: DataFrame, group: list[str], order: list[str], element: str, columns: str, open_group, numbered_elements: bool = True) -> DataFrame:
    """Groups of GF(2) vectors, one task after another: rows (group..., order..., element) are sorted by group and
    `order`, whose values name a vector, and handed over vector by vector, so a task holds what `open_group` keeps and
    never a group's rows.

    open_group() gives (feed, finish) for a new group: feed(names, vector) takes the values of `order` and the vector as
    an integer with a bit per element, and finish() yields the group's rows of `columns`. With `numbered_elements` a
    group numbers its own elements, so they need not be small, nor numbers; else an element is its bit. Repeats cancel,
    a null element adds nothing, null groups are a group. `element` may hold arrays, of all or some of a vector's elements:
    they need no row an element on the way."""
    ship(df.sparkSession)
    kinds = dict(df.dtypes)
    width, names, batch = len(group), [*group, *(c.split()[0] for c in columns.split(", "))], 10_000

    def run(batches):
        import pyarrow as pa

        done: list[tuple] = []
        at, current, numbers, vector, feed, finish, kind = None, None, {}, 0, None, None, None

        def table():
            made = [pa.array([d[i] for d in done], kind.field(i).type) if i < width else pa.array([d[i] for d in done], types[i - width]) for i in range(len(names))]
            return pa.RecordBatch.from_arrays(made, names)

        for b in batches:
            kind = b.schema
            for *row, es in zip(*(b.column(c).to_pylist() for c in range(width + len(order) + 1))):
                key, tag = row[:width], row[width:]
                if key != at or tag != current:
                    if at is not None:
                        feed(current, vector)
                    vector, current = 0, tag
                    if key != at:
                        if at is not None:
                            done.extend((*at, *r) for r in finish())
                        at, numbers = key, {}
                        feed, finish = open_group()
                for e in es:
                    vector ^= 1 << (numbers.setdefault(e, len(numbers)) if numbered_elements else int(e))
            if len(done) >= batch:
                yield table()
                done.clear()
        if at is not None:
            feed(current, vector)
            done.extend((*at, *r) for r in finish())
            yield table()

    import pyarrow as pa

    types = [{"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}[c.split()[1]] for c in columns.split(", ")]
    schema = ", ".join([*(f"`{g}` {kinds[g]}" for g in group), columns])
    # a vector's elements travel as one row, so Python takes a step a vector; null ones are left out
    if kinds[element].startswith("array"):
        vectors = df.select(*group, *order, F.coalesce(F.array_compact(element), F.array()).alias(element)).repartition(*group)
    else:
        vectors = df.select(*group, *order, element).repartition(*group).groupBy(*group, *order).agg(F.collect_list(element).alias(element))
    dealt = vectors.sortWithinPartitions(*group, *order)
    return dealt.mapInArrow(run, schema)


def gf2_rank(df: DataFrame, group: list[str], row: str, element: str) -> DataFrame:
    """(group..., rank). A group's task holds its echelon basis; a group of null elements alone has rank 0."""

    def open_group():
        basis: dict[int, int] = {}
        return (lambda _tag, v: _insert(basis, v)), (lambda: [(len(basis),)])

    return _stream(df, group, [row], element, "rank int", open_group)


def _over_rows(vectors: DataFrame, rows: DataFrame, group: list[str], row: str, element: str, vector: str | None, columns: str, open_group) -> DataFrame:
    """Streams a group's rows (kind 0) and then its vectors (kind 1, by `vector`)."""
    name = F.col(vector).cast("string") if vector else F.lit(None).cast("string")
    listed = [dict(df.dtypes)[element].startswith("array") for df in (rows, vectors)]
    if any(listed):
        rows, vectors = (df if done else df.withColumn(element, F.array(element)) for df, done in zip((rows, vectors), listed))
    both = rows.select(*group, F.lit(0).alias("_kind"), F.col(row).cast("string").alias("_row"), F.col(element).alias("_element"))
    both = both.unionByName(vectors.select(*group, F.lit(1).alias("_kind"), name.alias("_row"), F.col(element).alias("_element")))
    return _stream(both, group, ["_kind", "_row"], "_element", columns, open_group)


def _left_over(basis: dict[int, int], v: int) -> int:
    """What is left of a vector after reduction by an echelon basis by leading bit."""
    out = 0
    while v:
        top = v.bit_length() - 1
        if top in basis:
            v ^= basis[top]
        else:
            out, v = out | 1 << top, v ^ 1 << top
    return out


def in_rowspace(vectors: DataFrame, rows: DataFrame, group: list[str], row: str, element: str, vector: str | None = None) -> DataFrame:
    """(group..., inside): whether the group's vector (group..., element) is a sum of its rows; an absent vector is.
    With `vector`, a column that names a group's vectors, (group..., vector, inside) for each: all meet one basis."""

    def open_group():
        basis: dict[int, int] = {}
        found: list[tuple] = []

        def feed(tag, v):
            if tag[0] == 0:
                _insert(basis, v)
            else:
                found.append((tag[1], _left_over(basis, v) == 0))

        return feed, (lambda: found) if vector else (lambda: [(found[0][1] if found else True,)])

    return _over_rows(vectors, rows, group, row, element, vector, "vector string, inside boolean" if vector else "inside boolean", open_group)


def _bytes(rows: list[int], n: int) -> bytes:
    return b"".join(bytes((r >> j) & 1 for j in range(n)) for r in rows)


def _add_reduced(pivots: dict[int, int], v: int) -> None:
    """Add a vector to a reduced echelon form, kept by each row's lowest bit."""
    for p, b in pivots.items():
        if v >> p & 1:
            v ^= b
    if v:
        p = (v & -v).bit_length() - 1
        for q in pivots:
            if pivots[q] >> p & 1:
                pivots[q] ^= v
        pivots[p] = v


def gf2_fingerprint(df: DataFrame, group: list[str], side: str, row: str, element: str, size: str, sides: tuple[str, str] = ("X", "Z")) -> DataFrame:
    """(group..., fingerprint): first 16 hex digits of the SHA-256 of both sides' reduced rows as bytes, joined by |.

    Invariant to the order of rows and to sums of rows. `size` is the column with the number of elements; elements are
    0 to size - 1. A group's task holds both reduced forms as packed integers, not its rows."""
    import hashlib

    def open_group():
        forms: dict[str, dict[int, int]] = {s: {} for s in sides}
        n = [0]

        def feed(tag, v):
            n[0] = max(n[0], int(tag[1] or 0))
            if tag[0] in forms:
                _add_reduced(forms[tag[0]], v)

        def finish():
            digest = hashlib.sha256()
            for i, s in enumerate(sides):
                digest.update(b"|" if i else b"")
                for p in sorted(forms[s]):
                    digest.update(_bytes([forms[s][p]], n[0]))
            return [(digest.hexdigest()[:16],)]

        return feed, finish

    return _stream(df, group, [side, size, row], element, "fingerprint string", open_group, numbered_elements=False)


def logical_dimension(ranks: DataFrame, sizes: DataFrame, key: str, side: str = "side") -> DataFrame:
    """(key, k): size minus the ranks of both sides; a missing side has rank 0."""
    total = ranks.groupBy(key).agg(F.sum("rank").alias("_ranks"))
    return sizes.join(total.hint("merge"), key, "left").select(key, (F.col("n") - F.coalesce("_ranks", F.lit(0))).cast("int").alias("k"))


def validate_witness(witness: DataFrame, rows: DataFrame, claims: DataFrame) -> DataFrame:
    """(key, side, weight_ok, commutes, nontrivial, ok) for witnesses (key, side, qubit), incidence rows and claims
    (key, side, value): the weight is as claimed, no check of the other side overlaps oddly, and the witness is no
    sum of its own side's rows."""
    v = xor_normalise(witness, ["key", "side"], "qubit")
    weight = v.groupBy("key", "side").agg(F.count("*").alias("weight"))
    other = v.select("key", F.when(F.col("side") == "X", "Z").otherwise("X").alias("side"), "qubit")
    odd = syndrome(other, rows, ["key", "side", "qubit"], ["key", "side", "check_idx"])
    odd = odd.select("key", F.when(F.col("side") == "X", "Z").otherwise("X").alias("side")).distinct().withColumn("odd", F.lit(True))
    inside = in_rowspace(v, rows, ["key", "side"], "check_idx", "qubit")
    out = claims.join(weight.hint("merge"), ["key", "side"], "left").join(odd.hint("merge"), ["key", "side"], "left").join(inside.hint("merge"), ["key", "side"], "left")
    out = out.select(
        "key", "side", F.coalesce(F.col("weight") == F.col("value"), F.lit(False)).alias("weight_ok"),
        (F.col("weight").isNotNull() & F.col("odd").isNull()).alias("commutes"), F.coalesce(~F.col("inside"), F.lit(False)).alias("nontrivial"),
    )
    return out.withColumn("ok", F.col("weight_ok") & F.col("commutes") & F.col("nontrivial"))


def independent_modulo(vectors: DataFrame, rows: DataFrame, group: list[str], row: str, element: str) -> DataFrame:
    """(group..., independent): whether the vectors add their number to the rank of the group's rows. One pass: each
    vector must be new to the basis of the rows and the vectors before it."""

    def open_group():
        basis: dict[int, int] = {}
        new: list[bool] = []

        def feed(tag, v):
            before = len(basis)
            _insert(basis, v)
            if tag[0] == 1:
                new.append(len(basis) > before)

        return feed, (lambda: [(all(new),)] if new else [])

    return _over_rows(vectors, rows, group, row, element, row, "independent boolean", open_group)


def _free(lead: dict[int, int], n: int) -> list[int]:
    """Basis of the vectors of n bits with even overlap with every row of a reduced form, one per free bit."""
    return [1 << f | sum(1 << p for p, r in lead.items() if r >> f & 1) for f in range(n) if f not in lead]


def _members(v: int) -> list[int]:
    return [j for j in range(v.bit_length()) if v >> j & 1]


def kernel_basis(df: DataFrame, group: list[str], row: str, element: str, size: str) -> DataFrame:
    """(group..., basis_idx, element): a basis of the vectors with even overlap with every row. A group's task holds
    the reduced form of its rows, not the rows."""

    def open_group():
        pivots: dict[int, int] = {}
        n = [0]

        def feed(tag, v):
            n[0] = int(tag[0])
            _add_reduced(pivots, v)

        return feed, lambda: [(i, j) for i, v in enumerate(_free(pivots, n[0])) for j in _members(v)]

    return _stream(df, group, [size, row], element, f"basis_idx int, {element} int", open_group, numbered_elements=False)


def logical_basis(df: DataFrame, group: list[str], side: str, row: str, element: str, size: str, sides: tuple[str, str] = ("X", "Z")) -> DataFrame:
    """(group..., basis_idx, element): representatives of the second side: vectors that overlap every row of the first
    side evenly, of which no sum is a sum of the second side's rows. As many as n less both ranks if the sides commute.

    A group's task holds the reduced form of the first side and an echelon basis of the second, not their rows."""

    def open_group():
        pivots: dict[int, int] = {}
        known: dict[int, int] = {}
        n = [0]

        def feed(tag, v):
            n[0] = int(tag[1])
            if tag[0] == sides[0]:
                _add_reduced(pivots, v)
            elif tag[0] == sides[1]:
                _insert(known, v)

        def finish():
            kept = []
            for v in _free(pivots, n[0]):
                before = len(known)
                _insert(known, v)
                if len(known) > before:
                    kept.append(v)
            return [(i, j) for i, v in enumerate(kept) for j in _members(v)]

        return feed, finish

    return _stream(df, group, [side, size, row], element, f"basis_idx int, {element} int", open_group, numbered_elements=False)


def self_dual(df: DataFrame, key: str) -> DataFrame:
    """(key, self_dual): whether both sides have the same multiset of supports."""
    supports = df.groupBy(key, "side", "check_idx").agg(F.sort_array(F.collect_list("qubit")).alias("s"))
    sides = supports.groupBy(key).agg(*(F.sort_array(F.collect_list(F.when(F.col("side") == s, F.col("s")))).alias(s) for s in ("X", "Z")))
    return sides.select(key, (F.col("X") == F.col("Z")).alias("self_dual"))
