"""Queries over whole documents: their shape and claims, codes with commuting sides, and the board's entry table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.tables import written
from ..operators import board, circuits, graph, normalize, parity, rules
from .base import E_SQL, I_SQL, entries, incidence, query, t
from .structure import CLAIMS_SQL, WL_ROUNDS_SQL, _claims, _nested, wl_graphs

# ---- shape and claims


@query("b2_witness_rows", "SELECT l_orderkey AS key, CASE WHEN l_linestatus = 'F' THEN 'X' ELSE 'Z' END AS side, l_partkey AS qubit FROM lineitem")
def _(spark, sf):
    member = lambda s: F.struct(F.collect_list(F.when(F.col("l_linestatus") == ("F" if s == "X" else "O"), F.col("l_partkey"))).alias("witness")).alias(s)
    docs = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(member("X"), member("Z")).select("key", F.struct("X", "Z").alias("distance"))
    return normalize.witness_rows(docs)


@query("c1_structure", """SELECT key, m = '' AS ok, m AS detail FROM (SELECT o_orderkey AS key, concat_ws('; ', CASE WHEN o_orderpriority = '5-LOW' THEN 'missing name' END,
  CASE WHEN o_custkey % 4 = 0 AND o_orderstatus = 'P' THEN 'missing circuit.rounds' END, CASE WHEN o_custkey % 4 = 0 AND o_orderstatus = 'F' THEN 'circuit needs version 0.2' END) AS m FROM orders)""")
def _(spark, sf):
    rounds = F.struct(F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("rounds"))
    docs = t(spark, sf, "orders").select(
        F.col("o_orderkey").alias("key"), F.when(F.col("o_orderstatus") == "F", "0.1").otherwise("0.2").alias("schema_version"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("name"), F.when(F.col("o_custkey") % 4 == 0, rounds).alias("circuit"),
    )
    return rules.document_shape(docs, ["schema_version", "name"], {"circuit": ["rounds"]}, {"circuit": "0.2"}).select("key", "ok", "detail")


@query("c2_resource_caps", f"""WITH {I_SQL}, c AS (SELECT key, side, check_idx, count(*) AS w FROM i GROUP BY ALL),
  s AS (SELECT key, 10 * key AS n, count(*) FILTER (side = 'X') AS x, count(*) FILTER (side = 'Z') AS z, sum(w) AS sup, max(w) AS w FROM c GROUP BY key)
  SELECT key, concat_ws('; ', CASE WHEN n > 700 THEN 'too large: n' END, CASE WHEN greatest(x, z) > 10000 THEN 'too large: rows' END, CASE WHEN sup > 200000 THEN 'too large: support' END,
  CASE WHEN w > 32 THEN 'too large: weight' END, CASE WHEN (x + z) * n > 50000000 THEN 'too large: rows times n' END, CASE WHEN x * z > 50000000 THEN 'too large: row pairs' END) AS messages FROM s""")
def _(spark, sf):
    over = rules.over_caps(10 * F.col("key"), F.col("checks.X"), F.col("checks.Z"), F.lit(None).cast("array<int>"))
    return _nested(spark, sf).select("key", F.array_join(over, "; ").alias("messages"))


@query("c10_layout_claims", """WITH n AS (SELECT l_orderkey AS key, count(*) AS n, CASE WHEN l_orderkey % 5 > 0 THEN 200.0 + 100 * (l_orderkey % 7) END AS radius FROM lineitem GROUP BY l_orderkey),
  pt AS (SELECT DISTINCT l_orderkey AS key, l_partkey AS qubit, p_size::DOUBLE AS x, floor(p_retailprice)::DOUBLE AS y FROM lineitem JOIN part ON l_partkey = p_partkey),
  c AS (SELECT DISTINCT l_orderkey AS key, l_linestatus AS side, l_partkey AS qubit FROM lineitem), g AS (SELECT key, count(*) AS given FROM pt GROUP BY key),
  m AS (SELECT a.key, max(sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2))) AS r FROM c a JOIN c b ON a.key = b.key AND a.side = b.side AND a.qubit < b.qubit
  JOIN pt p ON p.key = a.key AND p.qubit = a.qubit JOIN pt q ON q.key = b.key AND q.qubit = b.qubit GROUP BY a.key)
  SELECT n.key, 'coordinates_cover' AS "check", given = n AS ok FROM n JOIN g ON n.key = g.key
  UNION ALL SELECT n.key, 'radius_within_claim', coalesce(r, 0) <= radius + 1e-9 FROM n JOIN g ON n.key = g.key LEFT JOIN m ON n.key = m.key WHERE given = n AND radius IS NOT NULL""")
def _(spark, sf):
    lines = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linestatus").alias("side"), F.lit(0).alias("check_idx"), F.col("l_partkey").alias("qubit"))
    radius = F.when(F.col("key") % 5 > 0, 200.0 + 100 * (F.col("key") % 7))
    layouts = lines.groupBy("key").agg(F.count("*").alias("n")).withColumn("radius", radius)
    parts = t(spark, sf, "part").select(F.col("p_partkey").alias("qubit"), F.col("p_size").cast("double").alias("x"), F.floor("p_retailprice").cast("double").alias("y"))
    points = lines.select("key", "qubit").distinct().join(parts, "qubit").select("key", "qubit", "x", "y")
    return rules.layout_claims(layouts, points, lines.distinct()).select("key", "check", "ok")


@query("c11_earned_confidence", f"WITH {CLAIMS_SQL} SELECT key, side, CASE WHEN earned THEN 'upper_bound' ELSE 'lower_bound' END AS confidence FROM cl")
def _(spark, sf):
    claimed = F.when(F.col("earned") & (F.col("value") % 2 == 0), "exact").when(F.col("earned"), "upper_bound").otherwise("lower_bound")
    return _claims(spark, sf).select("key", "side", rules.earned_confidence(claimed).alias("confidence"))


# ---- codes with commuting sides: per customer, each order's price as a vector of ten bits that is repeated, on both sides

BITS = 10
V_SQL = f"v AS (SELECT o_custkey AS key, o_orderkey AS row_, floor(o_totalprice)::BIGINT % {1 << BITS} AS x FROM orders)"


def _span_sql(source: str, name: str) -> str:
    """Recursive CTEs: all sums of a key's vectors, and `name`: (key, span, rank)."""
    return f"""{name}w AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY row_) AS pos, x FROM {source}),
  {name}r(key, span, n) AS (SELECT DISTINCT key, [0::BIGINT], 0::BIGINT FROM {name}w UNION ALL SELECT r.key, list_distinct(r.span || list_transform(r.span, lambda s: xor(s, w.x))), r.n + 1 FROM {name}r r JOIN {name}w w ON w.key = r.key AND w.pos = r.n + 1),
  {name} AS (SELECT key, arg_max(span, n) AS span, log2(max(len(span)))::BIGINT AS rank FROM {name}r GROUP BY key)"""


def _vectors(spark, sf):
    return t(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("check_idx"), (F.floor("o_totalprice") % (1 << BITS)).cast("int").alias("x"))


def _bits(x: str) -> Column:
    return F.explode(F.expr(f"filter(sequence(0, {BITS - 1}), b -> shiftright({x}, b) % 2 = 1)"))


def _code(spark, sf):
    once = _vectors(spark, sf).select("key", "check_idx", _bits("x").alias("bit"))
    both = F.explode(F.array(F.col("bit"), F.col("bit") + BITS)).alias("qubit")
    return once.select("key", F.explode(F.array(F.lit("X"), F.lit("Z"))).alias("side"), "check_idx", "bit").select("key", "side", "check_idx", both, F.lit(2 * BITS).alias("n"))


def _code_vectors(spark, sf):
    """The same, one row a check with all its qubits."""
    bits = F.expr(f"filter(sequence(0, {BITS - 1}), b -> shiftright(x, b) % 2 = 1)")
    both = _vectors(spark, sf).filter("x <> 0").select("key", "check_idx", F.concat(bits, F.transform(bits, lambda b: b + BITS)).alias("qubit"), F.lit(2 * BITS).alias("n"))
    return both.select("key", F.explode(F.array(F.lit("X"), F.lit("Z"))).alias("side"), "check_idx", "qubit", "n")


@query("c7_claimed_dimension", f"WITH RECURSIVE {V_SQL}, {_span_sql('v', 's')}, c AS (SELECT key, {2 * BITS} - 2 * least(count(*), {BITS}) AS k FROM v GROUP BY key) SELECT key, k = {2 * BITS} - 2 * rank AND k >= 1 AS ok FROM c JOIN s USING (key)")
def _(spark, sf):
    claims = _vectors(spark, sf).groupBy("key").agg(F.count("*").alias("rows")).select("key", (2 * BITS - 2 * F.least("rows", F.lit(BITS))).alias("k"), F.lit(2 * BITS).alias("n"))
    ranks = parity.gf2_rank(_code_vectors(spark, sf), ["key", "side"], "check_idx", "qubit")
    return rules.claimed_dimension(claims, parity.logical_dimension(ranks, claims.select("key", "n"), "key")).select("key", "ok")


@query("d5_in_rowspace", f"WITH RECURSIVE {V_SQL}, {_span_sql('v', 's')} SELECT key, list_contains(span, key % {1 << BITS}) AS inside FROM s")
def _(spark, sf):
    rows = _vectors(spark, sf).select("key", "check_idx", _bits("x").alias("bit"))
    keys = _vectors(spark, sf).select("key").distinct()
    vectors = keys.withColumn("x", (F.col("key") % (1 << BITS)).cast("int")).select("key", _bits("x").alias("bit"))
    inside = parity.in_rowspace(vectors, rows, ["key"], "check_idx", "bit")
    return keys.join(inside.hint("merge"), "key", "left").select("key", F.coalesce("inside", F.lit(True)).alias("inside"))


@query("d11_logical_basis", f"WITH RECURSIVE {V_SQL}, {_span_sql('v', 's')} SELECT key, {2 * BITS} - 2 * rank AS representatives, true AS commute, true AS independent FROM s WHERE rank > 0 AND rank < {BITS}")
def _(spark, sf):
    """Representatives, that none overlaps a row of the other side oddly, and that none is a sum of others and rows."""
    code = written(_code_vectors(spark, sf), "code")
    side = lambda s: code.filter(F.col("side") == s).select("key", F.col("check_idx").cast("string").alias("row_"), "qubit")
    basis = written(parity.logical_basis(code, ["key"], "side", "check_idx", "qubit", "n"), "logical-basis")
    counts = basis.groupBy("key").agg(F.count_distinct("basis_idx").cast("long").alias("representatives"))
    checks = side("X").withColumn("qubit", F.explode("qubit"))
    odd = parity.syndrome(basis, checks, ["key", "qubit"], ["key", "row_", "basis_idx"]).select("key").distinct().withColumn("odd", F.lit(True))
    new = parity.independent_modulo(basis.select("key", F.col("basis_idx").cast("string").alias("row_"), "qubit"), side("Z"), ["key"], "row_", "qubit")
    return counts.join(odd.hint("merge"), "key", "left").join(new.hint("merge"), "key").select("key", "representatives", F.col("odd").isNull().alias("commute"), "independent")


@query("d6_fingerprint", f"""WITH RECURSIVE {V_SQL}, {_span_sql('v', 's')}, m AS (SELECT key, span, list_aggregate(list_transform(span, lambda x: x & -x), 'bit_or') AS pivots FROM s),
  f AS (SELECT key, list_sort(list_transform(list_filter(span, lambda x: bit_count(x & pivots) = 1), lambda x: [x & pivots, x])) AS rows FROM m),
  h AS (SELECT key, array_to_string(list_transform(rows, lambda r: array_to_string(list_transform(range({2 * BITS}), lambda j: CASE WHEN (r[2] >> (j % {BITS})::INT) & 1 = 1 THEN '01' ELSE '00' END), '')), '') AS hx FROM f)
  SELECT key, substr(sha256(unhex(hx || '7C' || hx)), 1, 16) AS fingerprint FROM h WHERE hx <> ''""")
def _(spark, sf):
    return parity.gf2_fingerprint(_code_vectors(spark, sf), ["key"], "side", "check_idx", "qubit", "n")


@query("d7_logical_dimension", f"WITH RECURSIVE {V_SQL}, {_span_sql('v', 's')} SELECT key, {2 * BITS} - 2 * rank AS k FROM s")
def _(spark, sf):
    sizes = _vectors(spark, sf).select("key", F.lit(2 * BITS).alias("n")).distinct()
    ranks = parity.gf2_rank(_code_vectors(spark, sf), ["key", "side"], "check_idx", "qubit")
    return parity.logical_dimension(ranks, sizes, "key").select("key", F.col("k").cast("long").alias("k"))


def _witnesses(spark, sf):
    """Per key and side one witness: both copies of bit key % 10, or only the first one for every third key."""
    keys = _vectors(spark, sf).select("key").distinct().withColumn("bit", (F.col("key") % BITS).cast("int"))
    bits = F.when(F.col("key") % 3 == 0, F.array("bit")).otherwise(F.array(F.col("bit"), F.col("bit") + BITS))
    return keys.select("key", F.explode(F.array(F.lit("X"), F.lit("Z"))).alias("side"), bits.alias("bits")).select("key", "side", F.explode("bits").alias("qubit"))


@query("d8_validate_witness", f"""WITH RECURSIVE {V_SQL}, {_span_sql('v', 's')}, o AS (SELECT key, bit_or(x) AS x FROM v GROUP BY key),
  w AS (SELECT s.key, key % 3 = 0 AS single, 1::BIGINT << (key % {BITS})::INT AS e, span, x FROM s JOIN o USING (key)),
  r AS (SELECT key, CASE WHEN single THEN 1 ELSE 2 END = 1 + key % 2 AS weight_ok, NOT single OR x & e = 0 AS commutes, single OR NOT list_contains(span, e) AS nontrivial FROM w)
  SELECT key, u.side, weight_ok, commutes, nontrivial, weight_ok AND commutes AND nontrivial AS ok FROM r, (VALUES ('X'), ('Z')) AS u(side)""")
def _(spark, sf):
    witness = _witnesses(spark, sf)
    claims = witness.select("key", "side", (1 + F.col("key") % 2).alias("value")).distinct()
    return parity.validate_witness(witness, written(_code(spark, sf), "code"), claims)


@query("d9_independent_modulo", f"""WITH RECURSIVE {V_SQL}, u AS (SELECT key, -1 - u.j AS row_, 1::BIGINT << u.j::INT AS x FROM (SELECT DISTINCT key FROM v), unnest(range(0, 1 + key % 3)) AS u(j)),
  a AS (SELECT * FROM v UNION ALL SELECT * FROM u), {_span_sql('v', 's')}, {_span_sql('a', 'q')} SELECT s.key, q.rank = s.rank + 1 + s.key % 3 AS independent FROM s JOIN q USING (key)""")
def _(spark, sf):
    rows = _vectors(spark, sf).select("key", "check_idx", _bits("x").alias("bit"))
    units = _vectors(spark, sf).select("key").distinct().select("key", F.explode(F.sequence(F.lit(0), (F.col("key") % 3).cast("int"))).alias("bit"))
    return parity.independent_modulo(units.select("key", F.col("bit").alias("check_idx"), "bit"), rows, ["key"], "check_idx", "bit")


@query("p8_observables_hold", f"""WITH RECURSIVE {V_SQL}, k AS (SELECT DISTINCT key FROM v), u AS (SELECT key, -1 - u.j AS row_, 1::BIGINT << u.j::INT AS x FROM k, unnest(range(CASE WHEN key % 5 = 0 THEN 1 ELSE 0 END, 1 + key % 3)) AS u(j)),
  a AS (SELECT * FROM v UNION ALL SELECT * FROM u), {_span_sql('v', 's')}, {_span_sql('a', 'q')}, added AS (SELECT key, count(*) AS c FROM u GROUP BY key), o AS (SELECT key, bit_or(x) AS x FROM v GROUP BY key)
  SELECT o.key AS file, q.rank = s.rank + coalesce(c, 0) AND (o.key % 5 <> 0 OR o.x % 2 = 0) AS ok FROM o JOIN s ON s.key = o.key JOIN q ON q.key = o.key LEFT JOIN added ON added.key = o.key""")
def _(spark, sf):
    code = _code(spark, sf).select(F.col("key").alias("file"), "side", "check_idx", "qubit")
    files = _vectors(spark, sf).select(F.col("key").alias("file")).distinct().withColumn("k", (1 + F.col("file") % 3).cast("int"))
    obs = files.select("file", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("obs"))
    single = (F.col("file") % 5 == 0) & (F.col("obs") == 0)
    obs = obs.select("file", "obs", F.explode(F.when(single, F.array("obs")).otherwise(F.array(F.col("obs"), F.col("obs") + BITS))).alias("record"))
    finals = files.select("file", F.explode(F.sequence(F.lit(0), F.lit(2 * BITS - 1))).alias("record")).withColumn("qubit", F.col("record"))
    side = lambda s: code.filter(F.col("side") == s).drop("side")
    return circuits.observables_hold(written(obs, "observables"), written(finals, "finals"), written(side("X"), "opposite"), written(side("Z"), "own"), files)


@query("e2_graph_signature", f"""WITH {I_SQL}, ed AS (SELECT DISTINCT key AS graph, 'c' || check_idx AS src, 'q' || qubit AS dst FROM i), e2 AS (SELECT * FROM ed UNION ALL SELECT graph, dst, src FROM ed),
  c0 AS (SELECT DISTINCT graph, src AS node, CASE WHEN src LIKE 'c%' THEN 0 ELSE 1 END AS colour FROM e2),
  {WL_ROUNDS_SQL}, sz AS (SELECT graph, count(DISTINCT dst) AS n, count(DISTINCT src) AS k, count(*) AS d FROM ed GROUP BY graph)
  SELECT sz.graph, substr(sha256('[' || n || ', ' || k || ', ' || d || ', [' || (SELECT string_agg(colour, ', ' ORDER BY colour) FROM c6 WHERE c6.graph = sz.graph) || ']]'), 1, 16) AS signature FROM sz""")
def _(spark, sf):
    nodes, edges = wl_graphs(spark, sf)
    edge = edges.filter("src % 2 = 0")
    sizes = edge.groupBy("graph").agg(F.count_distinct("dst").alias("n"), F.count_distinct("src").alias("k"), F.count("*").alias("d"))
    return graph.graph_signature(sizes, graph.wl_refine(nodes, edges))


# ---- entries


@query("g10_build_entries", f"""WITH {E_SQL} SELECT key, 'code ' || key AS name, n, k, d, eff, CASE WHEN exact AND key % 2 = 0 THEN 'exact' ELSE 'ub' END AS tier, geo,
  CASE WHEN layers IS NOT NULL THEN round(1 + w / 4, 4) END AS geo_r, layers::BIGINT AS geo_rho, w, CASE WHEN family = '5-LOW' THEN 'other' ELSE family END AS family, loc AS locality_class, wc AS weight_class, origin,
  CASE WHEN key % 4 = 0 THEN 'new_parameters' ELSE 'unknown' END AS novelty, 'A' || author || ', B' AS authors, 2::BIGINT AS n_authors, CASE WHEN key % 3 = 0 THEN 'C' END AS contributed_by,
  CASE WHEN key % 2 = 0 THEN 'm1, m2' ELSE '' END AS model, date, '' AS construction, CASE WHEN key % 10 = 0 THEN 'see ' || key END AS note FROM e WHERE key % 11 <> 0 AND key % 13 <> 0""")
def _(spark, sf):
    e = entries(spark, sf)
    key, when = F.col("key"), lambda m, value: F.when(F.col("key") % m == 0, value)
    docs = e.select(
        "key", F.concat(F.lit("code "), key).alias("name"), "n", "k", F.when(F.col("family") != "5-LOW", F.col("family")).alias("family"), F.when(F.col("origin") != "submission", F.col("origin")).alias("origin"),
        when(4, "new_parameters").alias("novelty"), F.array(F.concat(F.lit("A"), F.col("author")), F.lit("B")).alias("authors"), when(2, '["m1", "m2"]').alias("model"), "date",
        F.lit(None).cast("string").alias("construction"), when(3, "C").alias("contributed_by"),
    )
    null = F.lit(None).cast("long")
    measured = e.select("key", "w", F.when(F.col("loc") != "unrestricted", F.col("loc")).alias("locality_class"), "layers", F.when(F.col("layers").isNotNull(), 1 + F.col("w") / 4).alias("radius"))
    out = board.build_entries(
        docs, e.select("key", (key % 11 != 0).alias("ok")), e.select("key", F.when(key % 13 != 0, F.col("d")).alias("d"), null.alias("x"), null.alias("z")), measured,
        e.filter("exact").select("key", F.lit(True).alias("certified"), (F.col("d") + key % 2).alias("cert_d"), null.alias("cert_x"), null.alias("cert_z")),
        e.filter("key % 10 = 0").select("key", F.concat(F.lit("see "), key).alias("note")),
    )
    return out.withColumn("geo_rho", F.col("geo_rho").cast("long")).withColumn("n_authors", F.size("authors_list").cast("long")).drop("authors_list")
