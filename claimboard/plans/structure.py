"""Queries over documents, incidence, parity, graphs and geometry (families A to F)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tables import written
from ..operators import board, geometry, graph, normalize, parity, rules, scoring, text
from ..sources import files
from .base import CELLS_SQL, E_SQL, G_SQL, I_SQL, P_SQL, cells, entries, groups, incidence, points, query, t

# ---- A: sources and sinks


@query("a5_truncated_note", """SELECT doc_id, octet_length(encode(x))::BIGINT AS bytes, md5(x) AS digest FROM (
  SELECT doc_id, CASE WHEN strlen(text) <= 10240 THEN text ELSE decode(unhex(CASE WHEN regexp_matches(substr(hex(encode(text)), 20481, 2), '^[89AB]')
    THEN regexp_replace(substr(hex(encode(text)), 1, 20480), '[C-F][0-9A-F](?:[89AB][0-9A-F]){0,2}$', '') ELSE substr(hex(encode(text)), 1, 20480) END)) END AS x FROM documents)""")
def _(spark, sf):
    cut = text.truncated(F.col("text"))
    return t(spark, sf, "documents").select("doc_id", F.octet_length(cut).cast("long").alias("bytes"), F.md5(cut).alias("digest"))


@query("a6_front_matter", """SELECT conv_id, turn, 'conv ' || conv_id AS title, role AS author,
  CASE WHEN turn % 2 = 0 THEN '2026-02-01' ELSE '2026-01-15' END AS date, md5(text) AS body_digest FROM conversations""")
def _(spark, sf):
    c = t(spark, sf, "conversations")
    dated = F.when(F.col("turn") % 2 == 0, F.lit("date: 2026-02-01\n")).otherwise(F.lit(""))
    raw = c.select("conv_id", "turn", F.lit("2026-01-15-note.md").alias("file"), F.concat(F.lit('---\ntitle: "conv '), F.col("conv_id").cast("string"), F.lit('"\nauthor: '), F.col("role"), F.lit("\n"), dated, F.lit("---\n"), F.col("text")).alias("text"))
    return files.front_matter(raw, ["title", "author", "date"]).select("conv_id", "turn", "title", "author", "date", F.md5("body").alias("body_digest"))


@query("a14_board_stats", f"""WITH {E_SQL} SELECT '{{"codes":' || count(*) || ',"exact":' || count(*) FILTER (exact) || ',"cells":' || count(DISTINCT loc || wc) || ',"max_n":' || max(n) || '}}' AS stats FROM e""")
def _(spark, sf):
    one = entries(spark, sf).agg(F.count("*").alias("codes"), F.count_if("exact").alias("exact"), F.count_distinct("loc", "wc").alias("cells"), F.max("n").alias("max_n"))
    return one.select(F.to_json(F.struct("codes", "exact", "cells", "max_n")).alias("stats"))


@query("a15_receipt", f"""WITH {E_SQL} SELECT key, '{{"item":' || key || ',"claim":{{"n":' || n || ',"k":' || k || ',"d":' || d || '}},"routing":"' || CASE WHEN exact THEN 'deferred' ELSE 'searched' END || '"}}' AS receipt FROM e""")
def _(spark, sf):
    routing = F.when(F.col("exact"), "deferred").otherwise("searched")
    return entries(spark, sf).select("key", F.to_json(F.struct(F.col("key").alias("item"), F.struct("n", "k", "d").alias("claim"), routing.alias("routing"))).alias("receipt"))


@query("a17_repack", f"""WITH {I_SQL}, s AS (SELECT key, side, check_idx, '[' || string_agg(qubit, ',' ORDER BY qubit) || ']' AS sup, count(*) AS c FROM i GROUP BY ALL),
  d AS (SELECT key, side, '[' || string_agg(sup, ',' ORDER BY check_idx) || ']' AS js, min(c) AS v FROM s GROUP BY key, side)
  SELECT key, md5('{{"key":' || key || ',"checks":{{"X":' || coalesce(max(js) FILTER (side = 'X'), '[]') || ',"Z":' || coalesce(max(js) FILTER (side = 'Z'), '[]') || '}},"distance":{{"d":' || min(v)
  || CASE WHEN max(v) FILTER (side = 'X') IS NULL THEN '' ELSE ',"X":' || max(v) FILTER (side = 'X') END || CASE WHEN max(v) FILTER (side = 'Z') IS NULL THEN '' ELSE ',"Z":' || max(v) FILTER (side = 'Z') END || '}}}}') AS digest FROM d GROUP BY key""")
def _(spark, sf):
    rows = incidence(spark, sf)
    claims = rows.groupBy("key", "side", "check_idx").agg(F.count("*").alias("c")).groupBy("key", "side").agg(F.min("c").alias("value"))
    return normalize.repack(rows, claims).select("key", F.md5("document").alias("digest"))


@query("a18_orphans", "SELECT c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(spark, sf):
    return board.orphans(t(spark, sf, "customer").select(F.col("c_custkey").alias("key")), t(spark, sf, "orders").select(F.col("o_custkey").alias("key")))


# ---- B: normalisation


def _nested(spark, sf):
    rows = incidence(spark, sf).groupBy("key", "side", "check_idx").agg(F.sort_array(F.collect_list("qubit")).alias("s"))
    side = lambda s: F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct("check_idx", "s")))), lambda x: x["s"]).alias(s)
    return rows.groupBy("key").agg(side("X"), side("Z")).select("key", F.struct("X", "Z").alias("checks"))


@query("b1_incidence", f"""WITH {I_SQL}, n AS (SELECT DISTINCT key, side, check_idx FROM i), r AS (SELECT *, row_number() OVER (PARTITION BY key, side ORDER BY check_idx) - 1 AS idx FROM n)
  SELECT i.key, i.side, r.idx AS check_idx, i.qubit FROM i JOIN r ON i.key = r.key AND i.side = r.side AND i.check_idx = r.check_idx""")
def _(spark, sf):
    return normalize.incidence(_nested(spark, sf)).select("key", "side", F.col("check_idx").cast("long").alias("check_idx"), "qubit")


@query("b3_coordinates", f"WITH {P_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY qubit, x, y) - 1 AS q FROM p) SELECT key, q AS qubit, x, y FROM r")
def _(spark, sf):
    docs = points(spark, sf).groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("qubit", "x", "y"))), lambda p: F.array(p["x"], p["y"])).alias("c"))
    return normalize.coords(docs, coordinates="c").select("key", F.col("qubit").cast("long").alias("qubit"), "x", "y")


@query("b4_explode_lists", """SELECT doc_id, u.i - 1 AS pos, string_split(text, chr(10))[u.i] AS line FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)""")
def _(spark, sf):
    docs = t(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    return normalize.explode_list(docs, ["doc_id"], "lines", "line").select("doc_id", F.col("pos").cast("long").alias("pos"), "line")


@query("b5_xor_normalise", f"WITH {I_SQL} SELECT key, check_idx, qubit FROM i GROUP BY ALL HAVING count(*) % 2 = 1")
def _(spark, sf):
    return normalize.xor_normalise(incidence(spark, sf).select("key", "check_idx", "qubit"), ["key", "check_idx"], "qubit")


@query("b6_bit_pack", f"""WITH {I_SQL} SELECT check_idx, (qubit % 4096) // 64 AS word, bit_xor(CASE WHEN qubit % 64 = 63 THEN -9223372036854775808 ELSE 1::BIGINT << (qubit % 64)::INT END) AS packed FROM i GROUP BY ALL""")
def _(spark, sf):
    rows = incidence(spark, sf).select("check_idx", (F.col("qubit") % 4096).alias("q"))
    return normalize.bit_pack(rows, ["check_idx"], "q").select("check_idx", F.col("word").cast("long").alias("word"), "packed")


@query("b7_ensemble", """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand || ', ' || p_type ELSE p_brand || ' + ' || p_name END AS display,
  len(list_filter(list_transform(regexp_split_to_array(CASE WHEN p_partkey % 2 = 0 THEN p_brand || ', ' || p_type ELSE p_brand || ' + ' || p_name END, '[+,]'), lambda x: trim(x)), lambda x: x <> ''))::BIGINT AS parts FROM part""")
def _(spark, sf):
    listed = F.to_json(F.array("p_brand", "p_type"))
    shown = normalize.ensemble_text(F.when(F.col("p_partkey") % 2 == 0, listed).otherwise(F.concat("p_brand", F.lit(" + "), "p_name")))
    return t(spark, sf, "part").select("p_partkey", shown.alias("display"), F.size(normalize.ensemble_parts(shown)).cast("long").alias("parts"))


# ---- C: rules


@query("c3_index_range", f"WITH {I_SQL} SELECT c_custkey AS key, coalesce(min(qubit) >= 0 AND max(qubit) < 10 * max(check_idx), false) AS ok FROM customer LEFT JOIN i ON c_custkey = i.key GROUP BY c_custkey")
def _(spark, sf):
    rows = incidence(spark, sf)
    n = rows.groupBy("key").agg((10 * F.max("check_idx")).alias("n"))
    sizes = t(spark, sf, "customer").select(F.col("c_custkey").alias("key")).join(n, "key", "left")
    return rules.index_range(rows, sizes, "qubit").select("key", "ok")


@query("c4_no_repeats", f"""WITH {I_SQL}, r AS (SELECT key, check_idx, qubit, count(*) AS c FROM i GROUP BY ALL)
  SELECT key, max(c) = 1 AS ok, coalesce(array_to_string(list_sort(list(DISTINCT check_idx) FILTER (c > 1))[1:5], ','), '') AS detail FROM r GROUP BY key""")
def _(spark, sf):
    return rules.repeated_members(incidence(spark, sf), "key", "check_idx", "qubit").select("key", "ok", "detail")


@query("c5_vocabulary", """SELECT doc_id, source IN ('tile', 'other') OR regexp_full_match(source, '[a-z0-9]+(-[a-z0-9]+)*') AS family_ok, lang IN ('en', 'de') AS novelty_ok FROM documents""")
def _(spark, sf):
    return t(spark, sf, "documents").select("doc_id", rules.vocabulary(F.col("source"), ["tile", "other"], True).alias("family_ok"), rules.vocabulary(F.col("lang"), ["en", "de"], False).alias("novelty_ok"))


@query("c6_model_version", """SELECT p_partkey, trim(lower(p_type)) IN ('', 'human') OR len(list_filter(string_split(p_brand || CASE WHEN p_partkey % 3 = 0 THEN ',' || p_type ELSE '' END, ','), lambda x: NOT regexp_matches(x, '[0-9]'))) = 0 AS ok FROM part""")
def _(spark, sf):
    model = F.concat(F.col("p_brand"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(","), F.col("p_type"))).otherwise(F.lit("")))
    return t(spark, sf, "part").select("p_partkey", rules.model_versioned(model).alias("ok"))


@query("c8_max_weight", f"WITH {I_SQL}, r AS (SELECT key, check_idx, count(*) AS c FROM i GROUP BY ALL) SELECT key, max(c) <= 2 AS ok FROM r GROUP BY key")
def _(spark, sf):
    return rules.max_weight(incidence(spark, sf), "key", "check_idx", 2).select("key", "ok")


CLAIMS_SQL = "cl AS (SELECT l_orderkey AS key, CASE WHEN l_linestatus = 'F' THEN 'X' ELSE 'Z' END AS side, min(l_quantity)::BIGINT AS value, bool_or(l_returnflag <> 'R') AS earned FROM lineitem GROUP BY 1, 2)"


def _claims(spark, sf):
    lines = t(spark, sf, "lineitem").withColumn("side", F.when(F.col("l_linestatus") == "F", "X").otherwise("Z"))
    return lines.groupBy(F.col("l_orderkey").alias("key"), "side").agg(F.min("l_quantity").cast("long").alias("value"), F.bool_or(F.col("l_returnflag") != "R").alias("earned"))


@query("c9_global_claim", f"WITH {CLAIMS_SQL}, b AS (SELECT key, min(value) FILTER (side = 'X' AND earned) AS x, min(value) FILTER (side = 'Z' AND earned) AS z FROM cl GROUP BY key) SELECT key, CASE WHEN x IS NOT NULL AND z IS NOT NULL THEN least(x, z) END AS d FROM b")
def _(spark, sf):
    return rules.global_claim(_claims(spark, sf))


CHECKS_SQL = """k AS (SELECT o_orderkey AS key, 0 AS stage, 'price' AS "check", o_totalprice > 20000 AS ok FROM orders UNION ALL SELECT o_orderkey, 1, 'status', o_orderstatus <> 'P' FROM orders UNION ALL SELECT o_orderkey, 2, 'priority', o_orderpriority NOT LIKE '1%' FROM orders)"""


def _checks(spark, sf):
    o = t(spark, sf, "orders").withColumn("key", F.col("o_orderkey"))
    a = rules.rule(o, "price", F.col("o_totalprice") > 20000, F.lit("low"), 0)
    b = rules.rule(o, "status", F.col("o_orderstatus") != "P", F.lit("pending"), 1)
    return a.unionByName(b).unionByName(rules.rule(o, "priority", ~F.col("o_orderpriority").startswith("1"), F.lit("urgent"), 2))


@query("c12_report", f"""WITH {CHECKS_SQL} SELECT key, bool_and(ok) AS ok, coalesce(string_agg("check", ',' ORDER BY "check") FILTER (NOT ok), '') AS failed FROM k GROUP BY key""")
def _(spark, sf):
    return rules.report(_checks(spark, sf)).select("key", "ok", F.array_join("failed", ",").alias("failed"))


@query("c13_short_circuit", f"""WITH {CHECKS_SQL}, f AS (SELECT *, min(stage) FILTER (NOT ok) OVER (PARTITION BY key) AS first FROM k) SELECT key, stage::BIGINT AS stage, "check", ok FROM f WHERE first IS NULL OR stage <= first""")
def _(spark, sf):
    return rules.short_circuit(_checks(spark, sf)).select("key", F.col("stage").cast("long").alias("stage"), "check", "ok")


@query("c14_fail_closed", "SELECT doc_id, coalesce(quality = 1, false) AS ok FROM documents LEFT JOIN labels USING (doc_id)")
def _(spark, sf):
    results = t(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("ok"))
    return rules.fail_closed(t(spark, sf, "documents").select("doc_id"), results, ["doc_id"])


# ---- D: parity


@query("d1_parity_agg", "SELECT l_suppkey, l_partkey % 50 AS element FROM lineitem GROUP BY ALL HAVING count(*) % 2 = 1")
def _(spark, sf):
    lines = t(spark, sf, "lineitem").select("l_suppkey", (F.col("l_partkey") % 50).alias("element"))
    return parity.parity_agg(lines, ["l_suppkey"], "element")


OVER_SQL = "o AS (SELECT x.check_idx AS a, z.check_idx AS b, count(*) AS c FROM i x JOIN i z ON x.qubit = z.qubit WHERE x.side = 'X' AND z.side = 'Z' GROUP BY ALL)"


def _sides(spark, sf):
    rows = incidence(spark, sf)
    return rows.filter("side = 'X'").select(F.col("check_idx").alias("a"), "qubit"), rows.filter("side = 'Z'").select(F.col("check_idx").alias("b"), "qubit")


@query("d2_parity_product", f"WITH {I_SQL}, {OVER_SQL} SELECT a, count(*) AS odd FROM o WHERE c % 2 = 1 GROUP BY a")
def _(spark, sf):
    x, z = _sides(spark, sf)
    return parity.parity_product(x, z, ["qubit"], "a", "b").groupBy("a").agg(F.count("*").alias("odd"))


@query("d3_syndrome", f"WITH {I_SQL} SELECT key, side, check_idx FROM i WHERE qubit % 3 = 0 GROUP BY ALL HAVING count(*) % 2 = 1")
def _(spark, sf):
    rows = incidence(spark, sf)
    vector = t(spark, sf, "part").select(F.col("p_partkey").alias("qubit")).filter("qubit % 3 = 0")
    return parity.syndrome(vector, rows, ["qubit"], ["key", "side", "check_idx"])


@query("d4_gf2_rank", """WITH RECURSIVE w AS (SELECT l_orderkey AS key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS pos, (l_partkey % 4096)::BIGINT AS x FROM lineitem),
  r(key, span, n) AS (SELECT DISTINCT key, [0::BIGINT], 0::BIGINT FROM w UNION ALL SELECT r.key, list_distinct(r.span || list_transform(r.span, lambda s: xor(s, w.x))), r.n + 1 FROM r JOIN w ON w.key = r.key AND w.pos = r.n + 1)
  SELECT key, log2(max(len(span)))::BIGINT AS rank FROM r GROUP BY key""")
def _(spark, sf):
    bits = F.expr("filter(sequence(0, 11), b -> shiftright(v, b) % 2 = 1)")
    lines = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("row"), (F.col("l_partkey") % 4096).cast("int").alias("v"))
    rows = lines.select("key", "row", bits.alias("bit")).filter("size(bit) > 0")
    ranks = parity.gf2_rank(rows, ["key"], "row", "bit")
    return lines.select("key").distinct().join(ranks.hint("merge"), "key", "left").select("key", F.coalesce(F.col("rank"), F.lit(0)).cast("long").alias("rank"))


@query("d10_nontrivial", f"WITH {I_SQL}, o AS (SELECT key, check_idx FROM i WHERE side = 'Z' AND qubit % 2 = 0 GROUP BY ALL HAVING count(*) % 2 = 1) SELECT DISTINCT key FROM o")
def _(spark, sf):
    rows = incidence(spark, sf)
    vector = rows.select("key", "qubit").distinct().filter("qubit % 2 = 0")
    return parity.nontrivial(vector, rows.filter("side = 'Z'"), ["key", "qubit"], ["key"], "check_idx")


@query("d12_self_dual", f"""WITH {I_SQL}, s AS (SELECT key, side, check_idx, list_sort(list(qubit % 2)) AS sup FROM i GROUP BY key, side, check_idx),
  m AS (SELECT key, list_sort(coalesce(list(sup) FILTER (side = 'X'), [])) AS x, list_sort(coalesce(list(sup) FILTER (side = 'Z'), [])) AS z FROM s GROUP BY key) SELECT key, x = z AS self_dual FROM m""")
def _(spark, sf):
    return parity.self_dual(incidence(spark, sf).withColumn("qubit", F.col("qubit") % 2), "key")


# ---- E: graphs and groups


WL_ROUNDS_SQL = ",\n  ".join(
    f"n{r} AS (SELECT e2.graph, src AS node, list_sort(list(colour)) AS near FROM e2 JOIN c{r - 1} c ON e2.graph = c.graph AND e2.dst = c.node GROUP BY ALL), "
    f"c{r} AS (SELECT c.graph, c.node, dense_rank() OVER (PARTITION BY c.graph ORDER BY colour, near) - 1 AS colour FROM c{r - 1} c JOIN n{r} n ON c.graph = n.graph AND c.node = n.node)"
    for r in range(1, 7)
)


def wl_graphs(spark, sf):
    """Nodes and edges, both directions, of each supplier's graph of checks (even names, colour 0) and qubits (odd names, colour 1)."""
    check, qubit = 2 * F.col("check_idx"), 2 * F.col("qubit") + 1
    edge = incidence(spark, sf).select(F.col("key").alias("graph"), check.alias("src"), qubit.alias("dst")).distinct()
    edges = written(edge.select("graph", F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("graph", "e.*"), "wl-edges")
    nodes = edges.select("graph", F.col("src").alias("node")).distinct().withColumn("colour", (F.col("node") % 2).cast("int"))
    return written(nodes, "wl-nodes"), edges


@query("e1_wl_refine", f"""WITH {I_SQL}, ed AS (SELECT DISTINCT key AS graph, 'c' || check_idx AS src, 'q' || qubit AS dst FROM i), e2 AS (SELECT * FROM ed UNION ALL SELECT graph, dst, src FROM ed),
  c0 AS (SELECT DISTINCT graph, src AS node, CASE WHEN src LIKE 'c%' THEN 0 ELSE 1 END AS colour FROM e2),
  {WL_ROUNDS_SQL}
  SELECT graph, colour, count(*) AS nodes FROM c6 GROUP BY ALL""")
def _(spark, sf):
    nodes, edges = wl_graphs(spark, sf)
    return graph.wl_refine(nodes, edges).groupBy("graph", F.col("colour").cast("long").alias("colour")).agg(F.count("*").alias("nodes"))


FP_SQL = "f AS (SELECT l_orderkey AS key, md5(string_agg(l_partkey % 40, ',' ORDER BY l_partkey % 40)) AS fp, md5(string_agg(l_partkey % 8, ',' ORDER BY l_partkey % 8)) AS sig FROM lineitem GROUP BY l_orderkey)"


def _prints(spark, sf):
    listed = lambda m: F.md5(F.array_join(F.sort_array(F.collect_list(F.col("l_partkey") % m)).cast("array<string>"), ","))
    return t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(listed(40).alias("fp"), listed(8).alias("sig"))


@query("e3_hard_duplicates", f"WITH {FP_SQL}, n AS (SELECT fp, count(*) AS n FROM f GROUP BY fp HAVING count(*) > 1) SELECT f.fp, f.key, n.n FROM f JOIN n ON f.fp = n.fp")
def _(spark, sf):
    return graph.duplicate_groups(_prints(spark, sf), "key", "fp")


@query("e4_soft_duplicates", f"WITH {FP_SQL}, n AS (SELECT sig, count(*) AS n FROM f GROUP BY sig HAVING count(*) > 1 AND count(DISTINCT fp) > 1) SELECT f.sig, f.key, n.n FROM f JOIN n ON f.sig = n.sig")
def _(spark, sf):
    return graph.soft_duplicate_groups(_prints(spark, sf), "key", "sig", "fp")


@query("e5_duplicate_of", f"""WITH {FP_SQL}, b AS (SELECT * FROM f WHERE key % 2 = 0), c AS (SELECT * FROM f WHERE key % 2 = 1), x AS (SELECT fp, min(key) AS k FROM b GROUP BY fp),
  y AS (SELECT c.key, min(b.key) AS k FROM c JOIN b ON c.sig = b.sig AND c.fp <> b.fp GROUP BY c.key) SELECT c.key, x.k AS exact_of, CASE WHEN x.k IS NULL THEN y.k END AS similar_of FROM c LEFT JOIN x ON c.fp = x.fp LEFT JOIN y ON c.key = y.key""")
def _(spark, sf):
    f = _prints(spark, sf)
    return graph.duplicate_of(f.filter("key % 2 = 1"), f.filter("key % 2 = 0"))


@query("e6_first_wins", f"WITH {FP_SQL} SELECT fp, min(key) AS key FROM f GROUP BY fp")
def _(spark, sf):
    return graph.first_wins(_prints(spark, sf), ["fp"], [F.col("key")]).select("fp", "key")


@query("e7_degrees", f"WITH {I_SQL}, w AS (SELECT key, check_idx, count(*) AS c FROM i GROUP BY ALL), q AS (SELECT key, qubit, count(*) AS c FROM i GROUP BY ALL) SELECT w.key, max(w.c) AS max_weight, (SELECT max(c) FROM q WHERE q.key = w.key) AS max_degree FROM w GROUP BY w.key")
def _(spark, sf):
    rows = incidence(spark, sf)
    a = graph.degrees(rows, ["key", "check_idx"], "c").groupBy("key").agg(F.max("c").alias("max_weight"))
    return a.join(graph.degrees(rows, ["key", "qubit"], "c").groupBy("key").agg(F.max("c").alias("max_degree")), "key")


def _tables(spark, sf):
    from ..operators.generate import cyclic_tables

    mul = written(cyclic_tables(groups(spark, sf)), "mul")
    return mul, mul.select("grp", "g").distinct().filter("g = grp % 2 + 1 OR g = 0")


@query("e8_closure", f"""WITH RECURSIVE {G_SQL}, gen AS (SELECT DISTINCT grp, g FROM mul WHERE g = grp % 2 + 1 OR g = 0), r AS (SELECT grp, g FROM gen UNION SELECT r.grp, m.gh FROM r JOIN gen ON r.grp = gen.grp JOIN mul m ON m.grp = r.grp AND m.g = r.g AND m.h = gen.g) SELECT grp, g FROM r""")
def _(spark, sf):
    mul, gens = _tables(spark, sf)
    return graph.closure(gens, mul)


SUB_SQL = f"RECURSIVE {G_SQL}, gen AS (SELECT DISTINCT grp, g FROM mul WHERE g = grp % 2 + 1 OR g = 0), r AS (SELECT grp, g FROM gen UNION SELECT r.grp, m.gh FROM r JOIN gen ON r.grp = gen.grp JOIN mul m ON m.grp = r.grp AND m.g = r.g AND m.h = gen.g)"


@query("e9_cosets", f"WITH {SUB_SQL}, k AS (SELECT m.grp, m.g, min(m.gh) AS rep FROM mul m JOIN r ON m.grp = r.grp AND m.h = r.g GROUP BY ALL) SELECT grp, g, rep, dense_rank() OVER (PARTITION BY grp ORDER BY rep) - 1 AS coset FROM k")
def _(spark, sf):
    mul, gens = _tables(spark, sf)
    return graph.cosets(mul, graph.closure(gens, mul)).select("grp", "g", "rep", F.col("coset").cast("long").alias("coset"))


MC_SQL = """s AS (SELECT s_suppkey AS grp, 3 + s_suppkey % 4 AS n FROM supplier), mul AS (SELECT grp, u.g AS g, v.h AS h,
  ((u.g // 2 + CASE WHEN u.g % 2 = 0 THEN v.h // 2 ELSE (n - 1) * (v.h // 2) END) % n) * 2 + (u.g % 2 + v.h % 2) % 2 AS gh FROM s, unnest(range(0, 2 * n)) AS u(g), unnest(range(0, 2 * n)) AS v(h))"""


def _dihedral(spark, sf):
    from ..operators.generate import metacyclic_tables

    n = 3 + F.col("s_suppkey") % 4
    return metacyclic_tables(t(spark, sf, "supplier").select(F.col("s_suppkey").alias("grp"), n.alias("n"), F.lit(2).alias("k"), (n - 1).alias("r")))


@query("e10_normaliser", f"""WITH {MC_SQL}, sub AS (SELECT DISTINCT grp, g FROM mul WHERE g = 0 OR g = 1), inv AS (SELECT grp, g, h AS inv FROM mul WHERE gh = 0),
  im AS (SELECT a.grp, a.g, b.gh AS image FROM mul a JOIN sub ON a.grp = sub.grp AND a.h = sub.g JOIN inv ON inv.grp = a.grp AND inv.g = a.g JOIN mul b ON b.grp = a.grp AND b.g = a.gh AND b.h = inv.inv)
  SELECT DISTINCT m.grp, m.g FROM mul m WHERE NOT EXISTS (SELECT 1 FROM im WHERE im.grp = m.grp AND im.g = m.g AND NOT EXISTS (SELECT 1 FROM sub WHERE sub.grp = im.grp AND sub.g = im.image))""")
def _(spark, sf):
    mul = written(_dihedral(spark, sf), "dihedral")
    return graph.normaliser(mul, mul.select("grp", "g").distinct().filter("g <= 1"))


@query("e11_group_index", f"WITH {SUB_SQL} SELECT r.grp, (max(s.a * s.b) // count(*))::BIGINT AS idx FROM r JOIN s ON r.grp = s.grp GROUP BY r.grp")
def _(spark, sf):
    mul, gens = _tables(spark, sf)
    return graph.group_index(mul, graph.closure(gens, mul))


@query("e12_slot_conflicts", f"WITH {I_SQL}, c AS (SELECT key, side, qubit, count(*) AS c FROM i GROUP BY ALL HAVING count(*) > 1) SELECT key, side, count(*) AS n_conflicts, array_to_string(list_sort(list(qubit))[1:3], ',') AS shown FROM c GROUP BY key, side")
def _(spark, sf):
    out = graph.slot_conflicts(incidence(spark, sf), ["key", "side"], "qubit")
    return out.withColumn("shown", F.array_join(F.col("shown").cast("array<string>"), ","))


# ---- F: geometry

DIST_SQL = f"{P_SQL}, d AS (SELECT a.key, a.qubit AS qa, b.qubit AS qb, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS dist FROM p a JOIN p b ON a.key = b.key AND a.qubit < b.qubit)"


@query("f1_group_diameter", f"WITH {DIST_SQL} SELECT p.key, round(coalesce(max(d.dist), 0.0), 6) AS diameter FROM (SELECT DISTINCT key FROM p) p LEFT JOIN d ON p.key = d.key GROUP BY p.key")
def _(spark, sf):
    return geometry.group_diameter(written(points(spark, sf), "points"), ["key"], "qubit").select("key", F.round("diameter", 6).alias("diameter"))


@query("f2_widest_pair", f"WITH {DIST_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY dist DESC, qa, qb) AS rn FROM d) SELECT key, qa::BIGINT AS a, qb::BIGINT AS b FROM r WHERE rn = 1")
def _(spark, sf):
    return geometry.widest_pair(written(points(spark, sf), "points"), ["key"], "qubit").select("key", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))


@query("f3_site_multiplicity", f"WITH {P_SQL}, s AS (SELECT key, x, y, count(*) AS c FROM p GROUP BY ALL) SELECT key, max(c) AS multiplicity FROM s GROUP BY key")
def _(spark, sf):
    return geometry.site_multiplicity(points(spark, sf), ["key"])


@query("f4_min_spacing", f"WITH {P_SQL}, s AS (SELECT DISTINCT key, x, y FROM p), d AS (SELECT a.key, min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS m FROM s a JOIN s b ON a.key = b.key AND (a.x < b.x OR (a.x = b.x AND a.y < b.y)) GROUP BY a.key) SELECT k.key, round(d.m, 6) AS spacing FROM (SELECT DISTINCT key FROM p) k LEFT JOIN d ON d.key = k.key")
def _(spark, sf):
    return geometry.min_spacing(points(spark, sf), ["key"]).select("key", F.round("spacing", 6).alias("spacing"))


@query("f5_bounding_box", f"WITH {P_SQL} SELECT key, max(x) - min(x) AS width, max(y) - min(y) AS height, round(count(*) / nullif((max(x) - min(x)) * (max(y) - min(y)), 0), 6) AS density FROM p GROUP BY key")
def _(spark, sf):
    return geometry.bounding_box(points(spark, sf), ["key"]).select("key", "width", "height", F.round("density", 6).alias("density"))


@query("f6_locality_class", f"""WITH {DIST_SQL}, r AS (SELECT key, max(dist) / 10 AS radius, min(dist) FILTER (dist > 0) AS sp FROM d GROUP BY key), s AS (SELECT key, x, y, count(*) AS c FROM p GROUP BY ALL), m AS (SELECT key, max(c) AS mu FROM s GROUP BY key)
  SELECT m.key, CASE WHEN (sp IS NULL OR sp >= 1 - 1e-9) AND mu <= 1 AND 1 + m.key % 2 <= 1 AND coalesce(radius, 0) <= 4 + 1e-9 THEN 'local-2d-single' WHEN (sp IS NULL OR sp >= 1 - 1e-9) AND mu <= 1 + m.key % 2 AND coalesce(radius, 0) <= 7 + 1e-9 THEN 'local-2d-bilayer' ELSE 'unrestricted' END AS cls,
  CASE WHEN (sp IS NULL OR sp >= 1) AND mu <= 1 AND 1 + m.key % 2 <= 1 AND coalesce(radius, 0) <= 4 THEN 0 WHEN (sp IS NULL OR sp >= 1) AND mu <= 2 AND coalesce(radius, 0) <= 7 THEN 1 ELSE 2 END AS strict FROM m LEFT JOIN r ON m.key = r.key""")
def _(spark, sf):
    p = written(points(spark, sf), "points")
    j = geometry.group_diameter(p, ["key"], "qubit").join(geometry.site_multiplicity(p, ["key"]), "key").join(geometry.min_spacing(p, ["key"]), "key")
    args = (F.lit(True), 1 + F.col("key") % 2, F.col("multiplicity"), F.col("spacing"), F.col("diameter") / 10)
    strict = scoring.tightness(geometry.locality_class(*args, slack=0.0, by_layers=False), scoring.LOCALITY_ORDER)
    return j.select("key", geometry.locality_class(*args).alias("cls"), strict.alias("strict"))


@query("f7_strict_locality_rank", f"""WITH {P_SQL}, q AS (SELECT key, qubit, x * (1 - (key % 2) * 1e-10::DOUBLE) AS x, y * (1 - (key % 2) * 1e-10::DOUBLE) AS y FROM p),
  d AS (SELECT a.key, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS dist FROM q a JOIN q b ON a.key = b.key AND a.qubit < b.qubit), r AS (SELECT key, max(dist) / 10 AS radius FROM d GROUP BY key),
  st AS (SELECT key, x, y, count(*) AS c FROM q GROUP BY ALL), m AS (SELECT key, max(c) AS mu FROM st GROUP BY key),
  g AS (SELECT a.key, min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS sp FROM st a JOIN st b ON a.key = b.key AND (a.x < b.x OR (a.x = b.x AND a.y < b.y)) GROUP BY a.key)
  SELECT m.key, CASE WHEN (sp IS NULL OR sp >= 1) AND mu <= 1 AND 1 + m.key % 3 % 2 <= 1 AND coalesce(radius, 0) <= 4 THEN 0 WHEN (sp IS NULL OR sp >= 1) AND mu <= 2 AND coalesce(radius, 0) <= 7 THEN 1 ELSE 2 END AS rank FROM m LEFT JOIN r ON m.key = r.key LEFT JOIN g ON m.key = g.key""")
def _(spark, sf):
    """Places of every other key lie a ten-thousand-millionth nearer together than they should: the strict variant sees it."""
    shrink = 1 - (F.col("key") % 2) * F.lit(1e-10)
    p = written(points(spark, sf).withColumns({"x": F.col("x") * shrink, "y": F.col("y") * shrink}), "points")
    j = geometry.group_diameter(p, ["key"], "qubit").join(geometry.site_multiplicity(p, ["key"]), "key").join(geometry.min_spacing(p, ["key"]), "key")
    cls = geometry.locality_class(F.lit(True), 1 + F.col("key") % 3 % 2, F.col("multiplicity"), F.col("spacing"), F.col("diameter") / 10, slack=0.0, by_layers=False)
    return j.select("key", scoring.tightness(cls, scoring.LOCALITY_ORDER).alias("rank"))


@query("f8_corner_pinned", f"WITH {P_SQL}, b AS (SELECT key, min(x) AS lx, max(x) AS hx, min(y) - 900 AS ly, max(y) - 900 AS hy FROM p GROUP BY key) SELECT key, hx - lx < 20 AND hy - ly < 20 AND (lx < 20 OR hx > 100 - 1 - 20) AND (ly < 20 OR hy > 100 - 1 - 20) AS pinned FROM b")
def _(spark, sf):
    p = points(spark, sf).withColumns({"y": F.col("y") - 900, "size": F.lit(100), "radius": F.lit(20)})
    return geometry.corner_pinned(p, ["key"], "size", "radius")


@query("f9_bounded", """WITH r AS (SELECT l_partkey AS key, 1 + l_linenumber % 2 AS sr, min(l_quantity)::BIGINT AS w, bool_or(l_discount < 0.05) AS p FROM lineitem GROUP BY ALL), b AS (SELECT key, max(w) FILTER (sr = 1) AS w1, max(w) FILTER (sr = 2) AS w2, bool_or(p) FILTER (sr = 1) AS p1, bool_or(p) FILTER (sr = 2) AS p2 FROM r GROUP BY key) SELECT key, CASE WHEN p1 AND p2 AND w1 = w2 THEN w1 END AS weight FROM b""")
def _(spark, sf):
    finds = t(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("key"), (1 + F.col("l_linenumber") % 2).alias("size_rank")).agg(F.min("l_quantity").cast("long").alias("weight"), F.bool_or(F.col("l_discount") < 0.05).alias("pinned"))
    return geometry.bounded(finds, "key")


@query("f10_grid", "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS qubit, p_partkey // 50 AS x, p_partkey % 50 AS y FROM part WHERE p_size % 2 = 0")
def _(spark, sf):
    part = t(spark, sf, "part")
    n = part.agg(F.max("p_partkey")).first()[0] + 1
    return geometry.grid(spark, -(-n // 50), 50, part.filter("p_size % 2 = 0").select(F.col("p_partkey").alias("id")))


# ---- G: classes and scores


@query("g1_weight_class", f"WITH {E_SQL} SELECT key, wc FROM e")
def _(spark, sf):
    return entries(spark, sf).select("key", "wc")


@query("g2_tightness", f"WITH {E_SQL} SELECT key, CASE wc WHEN 'weight-4' THEN 0 WHEN 'weight-6' THEN 1 WHEN 'weight-8' THEN 2 ELSE 3 END AS w_rank, CASE loc WHEN 'local-2d-single' THEN 0 WHEN 'local-2d-bilayer' THEN 1 ELSE 9 END AS l_rank FROM e")
def _(spark, sf):
    return entries(spark, sf).select("key", scoring.tightness(F.col("wc"), scoring.WEIGHT_ORDER).alias("w_rank"), scoring.tightness(F.col("loc"), scoring.LOCALITY_ORDER[:2]).alias("l_rank"))


@query("g4_cell_population", f"WITH {CELLS_SQL} SELECT cell_loc, cell_w, count(*) AS rows_, max(k) AS best_k FROM c GROUP BY ALL")
def _(spark, sf):
    return cells(spark, sf).groupBy("cell_loc", "cell_w").agg(F.count("*").alias("rows_"), F.max("k").alias("best_k"))


@query("g5_efficiency", f"WITH {E_SQL} SELECT key, eff, geo FROM e")
def _(spark, sf):
    return entries(spark, sf).select("key", "eff", "geo")


@query("g7_tier", "SELECT d.doc_id, CASE WHEN quality IS NOT NULL AND quality = 1 AND (toxic IS NULL OR toxic = d.doc_id % 2) THEN 'exact' ELSE 'ub' END AS tier FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def _(spark, sf):
    j = t(spark, sf, "documents").select("doc_id").join(t(spark, sf, "labels"), "doc_id", "left")
    null = F.lit(None).cast("int")
    return j.select("doc_id", scoring.tier(F.col("quality") == 1, F.col("toxic"), F.col("doc_id") % 2, null, null, null, null).alias("tier"))


@query("g8_reference_rows", f"WITH {E_SQL} SELECT key, coalesce(family = '5-LOW' AND origin = 'baseline', false) AS ref FROM e")
def _(spark, sf):
    family = F.when(F.col("family") == "5-LOW", "topological").otherwise(F.col("family"))
    return entries(spark, sf).select("key", scoring.is_reference(family, F.col("origin")).alias("ref"))


@query("g9_labels", "SELECT doc_id, CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' ELSE lang END AS label FROM documents")
def _(spark, sf):
    labels = spark.createDataFrame([("en", "English"), ("de", "German")], "value string, label string")
    return scoring.label_lookup(t(spark, sf, "documents").select("doc_id", "lang"), labels, "lang", "label").select("doc_id", "label")

