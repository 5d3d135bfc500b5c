"""Queries over text, snapshots, trial ledgers, generators and operation lines (families A, L to S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tables import written
from ..operators import circuits, diff, generate, ledger, text
from ..streaming import incremental
from .base import E_SQL, G_SQL, I_SQL, entries, groups, incidence, query, t

# ---- A10, A11: change lists and snapshots

LINES_SQL = """ln AS (SELECT o_orderkey AS seq, CASE o_orderkey % 4 WHEN 0 THEN 'M' || chr(9) || 'codes/' || o_orderkey || '.json' WHEN 1 THEN 'R100' || chr(9) || 'codes/' || o_orderkey || '.json' || chr(9) || 'codes/x' || o_orderkey || '.json'
  WHEN 2 THEN 'A' || chr(9) || 'notes/' || o_orderkey || '.md' ELSE 'D' || chr(9) || 'codes/' || o_orderkey || '.json' END AS line FROM orders)"""


def _change_lines(spark, sf):
    k = F.col("o_orderkey").cast("string")
    kind = F.col("o_orderkey") % 4
    line = (
        F.when(kind == 0, F.concat(F.lit("M\tcodes/"), k, F.lit(".json"))).when(kind == 1, F.concat(F.lit("R100\tcodes/"), k, F.lit(".json\tcodes/x"), k, F.lit(".json")))
        .when(kind == 2, F.concat(F.lit("A\tnotes/"), k, F.lit(".md"))).otherwise(F.concat(F.lit("D\tcodes/"), k, F.lit(".json")))
    )
    return t(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), line.alias("line"))


@query("a10_change_list", f"WITH {LINES_SQL}, p AS (SELECT string_split(line, chr(9)) AS p FROM ln) SELECT * FROM (SELECT p[2] AS path, CASE WHEN left(p[1], 1) = 'R' THEN 'D' ELSE p[1] END AS status FROM p UNION ALL SELECT p[3], 'A' FROM p WHERE left(p[1], 1) = 'R') WHERE path LIKE '%.json'")
def _(spark, sf):
    return diff.parse_changes(_change_lines(spark, sf))


SNAP_SQL = """b AS (SELECT o_orderkey AS path, o_totalprice AS price, o_orderstatus AS st FROM orders WHERE o_orderkey % 7 <> 0), h AS (SELECT o_orderkey AS path, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice / 2 ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS st FROM orders WHERE o_orderkey % 11 <> 0)"""


def _snapshots(spark, sf):
    o = t(spark, sf, "orders")
    base = o.filter("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("path"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("st"))
    head = o.filter("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("path"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") / 2).otherwise(F.col("o_totalprice")).alias("price"), F.when(F.col("o_orderkey") % 3 == 0, "X").otherwise(F.col("o_orderstatus")).alias("st"))
    return base, head


@query("a11_snapshot_pair", f"WITH {SNAP_SQL} SELECT coalesce(b.path, h.path) AS path, b.price AS was, h.price AS now, b.st AS st_was, h.st AS st_now FROM b FULL JOIN h ON b.path = h.path")
def _(spark, sf):
    pair = diff.snapshot_pair(*_snapshots(spark, sf))
    return pair.select("path", F.col("base.price").alias("was"), F.col("head.price").alias("now"), F.col("base.st").alias("st_was"), F.col("head.st").alias("st_now"))


# ---- L: text

#: Every line of every text is a citation to read; each text also gets a last line that cites something.
CITE_SQL = """ci AS (SELECT doc_id AS key, unnest(string_split(coalesce(text, '') || chr(10) || CASE doc_id % 5 WHEN 0 THEN 'arXiv:' || (2000 + doc_id % 150) || '.' || (10000 + doc_id % 150) WHEN 1 THEN 'see doi 10.1000/' || doc_id % 150 || '.x'
  WHEN 2 THEN 'Name' || doc_id % 150 || ', Other' || doc_id % 150 WHEN 3 THEN 'arXiv:9999.99999' ELSE 'in 10.1000/' || doc_id % 150 || '.xyz and ' || (2000 + doc_id % 150) || '.' || (10000 + doc_id % 150) END, chr(10))) AS cite FROM documents),
  rf AS (SELECT 'ref' || s_suppkey AS ref, s_suppkey AS seq, CASE WHEN s_suppkey % 2 = 0 THEN (2000 + s_suppkey % 1000) || '.' || (10000 + s_suppkey % 90000) ELSE '' END AS eprint, CASE WHEN s_suppkey % 3 = 0 THEN '10.1000/' || s_suppkey || '.X' ELSE '' END AS doi, ['name' || s_suppkey, 'other' || s_suppkey] AS names FROM supplier)"""


def _cites(spark, sf):
    k = F.col("doc_id")
    m = (k % 150).cast("string")
    code = F.concat((2000 + k % 150).cast("string"), F.lit("."), (10000 + k % 150).cast("string"))
    cite = (
        F.when(k % 5 == 0, F.concat(F.lit("arXiv:"), code)).when(k % 5 == 1, F.concat(F.lit("see doi 10.1000/"), m, F.lit(".x")))
        .when(k % 5 == 2, F.concat(F.lit("Name"), m, F.lit(", Other"), m)).when(k % 5 == 3, F.lit("arXiv:9999.99999")).otherwise(F.concat(F.lit("in 10.1000/"), m, F.lit(".xyz and "), code))
    )
    whole = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), cite)
    return t(spark, sf, "documents").select(k.alias("key"), F.explode(F.split(whole, "\n")).alias("cite"))


def _refs(spark, sf):
    n = F.col("s_suppkey")
    s = n.cast("string")
    return t(spark, sf, "supplier").select(
        F.concat(F.lit("ref"), s).alias("ref"), n.alias("seq"), F.when(n % 2 == 0, F.concat((2000 + n % 1000).cast("string"), F.lit("."), (10000 + n % 90000).cast("string"))).otherwise("").alias("eprint"),
        F.when(n % 3 == 0, F.concat(F.lit("10.1000/"), s, F.lit(".X"))).otherwise("").alias("doi"), F.concat(F.lit("Name"), s, F.lit(", A. and B. Other"), s).alias("author"),
    )


RES_SQL = f"""{CITE_SQL}, cc AS (SELECT DISTINCT cite, lower(cite) AS low, nullif(regexp_extract(lower(cite), '([0-9]{{4}}\\.[0-9]{{4,5}}|[a-z-]+(?:\\.[a-z]{{2}})?/[0-9]{{7}})', 1), '') AS aid FROM ci),
  dr AS (SELECT cite, arg_min(ref, seq) AS ref FROM cc JOIN rf ON (aid IS NOT NULL AND eprint = aid) OR (doi <> '' AND contains(low, lower(doi))) GROUP BY cite),
  tk AS (SELECT cite, list_filter(regexp_split_to_array(low, '[,\\s]+'), lambda x: length(x) > 2) AS tk FROM cc WHERE aid IS NULL),
  nr AS (SELECT cite, arg_min(ref, seq) AS ref FROM tk JOIN rf ON len(tk) > 0 AND list_has_all(names, tk) GROUP BY cite), rs AS (SELECT cc.cite, coalesce(dr.ref, nr.ref) AS ref FROM cc LEFT JOIN dr ON cc.cite = dr.cite LEFT JOIN nr ON cc.cite = nr.cite)"""


@query("l1_arxiv_id", f"WITH {CITE_SQL} SELECT key, cite, nullif(regexp_extract(lower(cite), '([0-9]{{4}}\\.[0-9]{{4,5}}|[a-z-]+(?:\\.[a-z]{{2}})?/[0-9]{{7}})', 1), '') AS aid FROM ci")
def _(spark, sf):
    return _cites(spark, sf).select("key", "cite", text.arxiv_id(F.col("cite")).alias("aid"))


@query("l2_resolve", f"WITH {RES_SQL} SELECT cite, ref FROM rs")
def _(spark, sf):
    return text.resolve(_cites(spark, sf), written(_refs(spark, sf), "refs"))


@query("l3_surnames", "SELECT s_suppkey, 'name' || s_suppkey || ',other' || s_suppkey AS names FROM supplier")
def _(spark, sf):
    return _refs(spark, sf).select(F.col("seq").alias("s_suppkey"), F.array_join(text.surnames(F.col("author")), ",").alias("names"))


@query("l4_citations", f"WITH {RES_SQL}, p AS (SELECT DISTINCT ref, key FROM ci JOIN rs ON ci.cite = rs.cite WHERE ref IS NOT NULL) SELECT ref, key, count(*) OVER (PARTITION BY ref) AS n FROM p")
def _(spark, sf):
    c = _cites(spark, sf)
    return text.citations(c, text.resolve(c, written(_refs(spark, sf), "refs"))).select("ref", "key", "n")


@query("l5_best_url", """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://doi.org/10.1/' || page_id WHEN 1 THEN 'https://arxiv.org/abs/' || page_id WHEN 2 THEN 'https://doi.org/10.48550/arXiv.' || page_id ELSE url END AS best FROM pages""")
def _(spark, sf):
    p, k = t(spark, sf, "pages"), F.col("page_id")
    s = k.cast("string")
    doi = F.when(k % 4 == 0, F.concat(F.lit("10.1/"), s)).when(k % 4 == 2, F.concat(F.lit("10.48550/arXiv."), s))
    return p.select("page_id", text.best_url(doi, F.when(k % 4 < 2, s), F.when(k % 2 == 1, F.col("url")), F.lit(None).cast("string")).alias("best"))


@query("l6_log_union", "SELECT 'submission note' AS kind, doc_id::VARCHAR AS title, lang AS author FROM documents UNION ALL SELECT 'fieldnote', page_id::VARCHAR, 'web' FROM pages")
def _(spark, sf):
    shape = lambda df, title, author, body: df.select(F.lit("2026-01-01").alias("date"), F.col(title).cast("string").alias("title"), author.alias("author"), F.lit("").alias("model"), F.col(body).alias("body"))
    out = text.log_union(shape(t(spark, sf, "documents"), "doc_id", F.col("lang"), "text"), shape(t(spark, sf, "pages"), "page_id", F.lit("web"), "html"))
    return out.select("kind", "title", "author")


@query("l7_compact_names", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN '@a and @b' ELSE c_name || ' et al.' END AS authors, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE c_mktsegment || ' +1' END AS models FROM customer")
def _(spark, sf):
    k = F.col("c_custkey")
    names = F.when(k % 3 == 0, F.array("c_name")).when(k % 3 == 1, F.array(F.lit("@a"), F.lit("@b"))).otherwise(F.array(F.concat("c_name", F.lit(", J.")), F.lit("Second")))
    models = F.when(k % 2 == 0, F.array("c_mktsegment")).otherwise(F.array(F.col("c_mktsegment"), F.lit("y")))
    return t(spark, sf, "customer").select("c_custkey", text.compact_authors(names).alias("authors"), text.compact_models(models).alias("models"))


@query("l8_powers", "SELECT p_partkey, 'x<sup>' || p_size || '</sup> + y<sup>-' || p_size || '</sup>' AS shown FROM part")
def _(spark, sf):
    s = F.col("p_size").cast("string")
    return t(spark, sf, "part").select("p_partkey", text.powers(F.concat(F.lit("x**"), s, F.lit(" + y^-"), s)).alias("shown"))


@query("l9_compact_integer", "WITH v AS (SELECT o_orderkey, (o_orderkey * o_orderkey * 37)::BIGINT AS v FROM orders), m AS (SELECT *, length(v::VARCHAR) - 1 AS e FROM v), f AS (SELECT *, regexp_replace(printf('%.1f', v / pow(10, e)), '\\.0$', '') AS m FROM m) SELECT o_orderkey, CASE WHEN v < 10000 THEN v::VARCHAR WHEN m = '1' THEN '10^' || e ELSE m || 'x10^' || e END AS shown FROM f")
def _(spark, sf):
    v = F.col("o_orderkey") * F.col("o_orderkey") * 37
    return t(spark, sf, "orders").select("o_orderkey", text.compact_integer(v).alias("shown"))


@query("l10_safe_url", "SELECT page_id, page_id % 4 < 2 AS safe FROM pages")
def _(spark, sf):
    k = F.col("page_id")
    url = F.when(k % 4 == 0, F.concat(F.lit("https://h/"), F.col("url"))).when(k % 4 == 1, F.lit("a/b.html")).when(k % 4 == 2, F.concat(F.lit("javascript:"), F.col("url"))).otherwise(F.concat(F.lit("//"), F.col("url")))
    return t(spark, sf, "pages").select("page_id", text.safe_url(url).alias("safe"))


@query("l11_html_safe_json", "SELECT page_id, strlen(replace(replace(replace(html, '&', ''), '<', ''), '>', '')) < strlen(html) AS had, false AS left_over FROM pages")
def _(spark, sf):
    safe = text.html_safe_json(F.struct("html"))
    return t(spark, sf, "pages").select("page_id", F.col("html").rlike("[&<>]").alias("had"), safe.rlike("[&<>]").alias("left_over"))


@query("l12_descriptor", f"WITH {E_SQL} SELECT key, 'Add [[' || n || ',' || k || ',' || d || ']]' || CASE WHEN key % 2 = 0 THEN ' torus code' ELSE ' ' || family || ' code' END AS title FROM e")
def _(spark, sf):
    con = F.when(F.col("key") % 2 == 0, F.lit("torus code (l=3); swept."))
    tag = text.descriptor(con, F.col("family"))
    return entries(spark, sf).select("key", text.title(F.col("n"), F.col("k"), F.col("d"), tag).alias("title"))


@query("l13_complete_id", f"WITH {CITE_SQL} SELECT key, cite, regexp_full_match(cite, '(?i)arxiv:\\s*(?:[0-9]{{4}}\\.[0-9]{{4,5}}|[a-z-]+(?:\\.[a-z]{{2}})?/[0-9]{{7}})(?:v[0-9]+)?\\s*') AS complete FROM ci")
def _(spark, sf):
    return _cites(spark, sf).select("key", "cite", text.complete_id(F.col("cite")).alias("complete"))


NOTE_SQL = """nt AS (SELECT doc_id || '-1-2.md' AS label, coalesce(text, '') || CASE doc_id % 6 WHEN 0 THEN ' see /home/me/x.py now' WHEN 1 THEN ' <!-- edit --> TODO' WHEN 2 THEN ' https://chatgpt.com/c/9' WHEN 3 THEN ' `codes/' || doc_id % 30 || '.json` and build/out.txt' WHEN 4 THEN ' [[' || doc_id || ',1,2]]' ELSE ' [[5,6,7]]' END AS text FROM documents)"""


def _notes(spark, sf):
    k = F.col("doc_id")
    extra = (
        F.when(k % 6 == 0, F.lit(" see /home/me/x.py now")).when(k % 6 == 1, F.lit(" <!-- edit --> TODO")).when(k % 6 == 2, F.lit(" https://chatgpt.com/c/9"))
        .when(k % 6 == 3, F.concat(F.lit(" `codes/"), (k % 30).cast("string"), F.lit(".json` and build/out.txt"))).when(k % 6 == 4, F.concat(F.lit(" [["), k.cast("string"), F.lit(",1,2]]"))).otherwise(F.lit(" [[5,6,7]]"))
    )
    return t(spark, sf, "documents").select(F.concat(k.cast("string"), F.lit("-1-2.md")).alias("label"), F.concat(F.coalesce("text", F.lit("")), extra).alias("text"))


@query("l14_lint_absolute", f"WITH {NOTE_SQL} SELECT label, 'absolute local path' AS why, '/home/me/x.py' AS detail FROM nt WHERE contains(text, '/home/me/x.py')")
def _(spark, sf):
    return text.lint_absolute(_notes(spark, sf))


@query("l15_lint_session", f"WITH {NOTE_SQL} SELECT label, 'session URL' AS why, 'links a private session' AS detail FROM nt WHERE contains(text, 'chatgpt.com/c/')")
def _(spark, sf):
    return text.lint_session(_notes(spark, sf))


@query("l16_lint_scaffolding", f"WITH {NOTE_SQL} SELECT label, 'leftover scaffolding' AS why, 'HTML comment' AS detail FROM nt WHERE contains(text, '<!--') UNION ALL SELECT label, 'leftover scaffolding', 'placeholder' FROM nt WHERE regexp_matches(text, '\\bTODO\\b')")
def _(spark, sf):
    return text.lint_scaffolding(_notes(spark, sf))


@query("l17_path_tokens", f"WITH {NOTE_SQL} SELECT label, unnest(list_distinct(regexp_extract_all(text, 'codes/[0-9]+\\.json|build/out\\.txt'))) AS token FROM nt")
def _(spark, sf):
    rows = _notes(spark, sf).filter(F.contains("text", F.lit("codes/"))).select("label", F.explode(text.tokens(F.col("text"))).alias("token"))
    return rows.filter(text.pathlike(F.col("token"), ["codes/", "notes/"]))


@query("l18_unresolved_paths", f"WITH {NOTE_SQL}, tk AS (SELECT label, unnest(list_distinct(regexp_extract_all(text, 'codes/[0-9]+\\.json'))) AS token FROM nt WHERE NOT regexp_matches(text, '(?i)https?://|github\\.com|gitlab\\.com|zenodo|doi\\.org|arxiv\\.org/abs')) SELECT label, token FROM tk WHERE token NOT IN (SELECT 'codes/' || n_nationkey || '.json' FROM nation)")
def _(spark, sf):
    rows = text.without_external(_notes(spark, sf)).select("label", F.explode(text.tokens(F.col("text"))).alias("token"))
    rows = rows.filter(text.pathlike(F.col("token"), ["codes/", "notes/"]) & ~text.ignored_citation(F.col("token")) & ~F.col("token").startswith("/"))
    listing = t(spark, sf, "nation").select(F.concat(F.lit("codes/"), F.col("n_nationkey").cast("string"), F.lit(".json")).alias("path"))
    return text.unresolved(rows, listing, ["label"])


@query("l19_ignored_citation", f"WITH {NOTE_SQL} SELECT label FROM nt WHERE contains(text, 'build/out.txt')")
def _(spark, sf):
    rows = _notes(spark, sf).select("label", F.explode(text.tokens(F.col("text"))).alias("token"))
    return rows.filter(text.ignored_citation(F.col("token"))).select("label")


@query("l20_header_check", f"WITH {NOTE_SQL}, h AS (SELECT label, nullif(regexp_replace(regexp_extract(text, '\\[\\[\\s*[0-9]+\\s*,\\s*[0-9]+\\s*,\\s*[0-9]+\\s*\\]\\]'), '[\\[\\]\\s]', '', 'g'), '') AS own FROM nt) SELECT label, CASE WHEN own IS NULL THEN 'no header' ELSE 'header disagrees' END AS why FROM h WHERE own IS NULL OR replace(own, ',', '-') || '.md' <> label")
def _(spark, sf):
    return text.header_mismatch(_notes(spark, sf)).select("label", "why")


@query("l21_problem_set", f"WITH {NOTE_SQL}, c AS (SELECT label, CASE WHEN label = '0-1-2.md' THEN 0 ELSE contains(text, '/home/me/x.py')::INT + contains(text, 'chatgpt.com/c/')::INT + contains(text, '<!--')::INT + regexp_matches(text, '\\bTODO\\b')::INT END AS n FROM nt) SELECT label, n = 0 AS ok, n::BIGINT AS n_problems FROM c")
def _(spark, sf):
    n = _notes(spark, sf)
    found = text.lint_absolute(n).unionByName(text.lint_session(n)).unionByName(text.lint_scaffolding(n))
    return text.problems(found, n, n.filter("label = '0-1-2.md'").select("label"))


@query("l22_marker_audit", "SELECT page_id, ((length(html) - length(replace(html, '<p>', ''))) // 3)::BIGINT AS times FROM pages WHERE (length(html) - length(replace(html, '<p>', ''))) // 3 <> 1")
def _(spark, sf):
    return text.marker_audit(t(spark, sf, "pages"), "<p>").select("page_id", "times")


@query("l23_key_numbers", f"WITH {E_SQL} SELECT key, n, k, d FROM e")
def _(spark, sf):
    named = entries(spark, sf).select("key", F.concat_ws("-", F.col("n").cast("string"), F.col("k").cast("string"), F.col("d").cast("string")).alias("name"))
    return named.select("key", *text.key_numbers(F.col("name")))


# ---- M: snapshot diffs


@query("m1_affected", f"SELECT 'codes/' || doc_id % 50 || '.json' AS entity, min(doc_id) AS seq FROM documents WHERE doc_id % 3 <> 2 GROUP BY 1")
def _(spark, sf):
    k = F.col("doc_id")
    s = (k % 50).cast("string")
    path = F.when(k % 3 == 0, F.concat(F.lit("circuits/"), s, F.lit("/memory.txt"))).when(k % 3 == 1, F.concat(F.lit("codes/"), s, F.lit(".json"))).otherwise(F.concat(F.lit("notes/"), s, F.lit(".md")))
    return diff.affected(t(spark, sf, "documents").select(path.alias("path"), k.alias("seq")))


@query("m2_base_counterpart", """WITH g AS (SELECT o_custkey AS c, count(*) FILTER (WHERE o_orderstatus = 'F') AS n, min('codes/' || o_custkey || '-1-' || o_orderkey || '.json') FILTER (WHERE o_orderstatus = 'F') AS old FROM orders GROUP BY o_custkey)
  SELECT 'codes/' || o_custkey || '-1-' || o_orderkey || '.json' AS path, CASE WHEN o_orderstatus = 'O' THEN 'codes/' || o_custkey || '-1-' || o_orderkey || '.json' WHEN n = 1 THEN old END AS counterpart FROM orders JOIN g ON c = o_custkey WHERE o_orderstatus <> 'F'""")
def _(spark, sf):
    path = F.concat(F.lit("codes/"), F.col("o_custkey").cast("string"), F.lit("-1-"), F.col("o_orderkey").cast("string"), F.lit(".json"))
    o = t(spark, sf, "orders").select(path.alias("path"), F.concat(F.lit("codes/"), F.col("o_custkey").cast("string"), F.lit("-1-")).alias("prefix"), F.when(F.col("o_orderstatus") == "F", "D").when(F.col("o_orderstatus") == "O", "M").otherwise("A").alias("status"))
    return diff.base_counterpart(o.filter("status <> 'D'").select("path", "prefix"), o.select("path", "status"))


@query("m3_stamp_raised", f"WITH {SNAP_SQL} SELECT h.path, h.price IS NOT NULL AND (b.price IS NULL OR h.price > b.price) AS up FROM h LEFT JOIN b ON b.path = h.path")
def _(spark, sf):
    base, head = _snapshots(spark, sf)
    both = head.join(base.select("path", F.col("price").alias("was")), "path", "left")
    return both.select("path", diff.raised(F.col("was"), F.col("price")).alias("up"))


M4_SQL = """m AS (SELECT o_orderkey AS path, o_orderkey % 9 AS c, 2 + o_orderkey % 5 AS v FROM orders)"""


def _pairs(spark, sf):
    k = F.col("o_orderkey")
    c, v = k % 9, 2 + k % 5

    def state(after: bool):
        a = F.lit(after)
        low = F.when(a & c.isin(3, 4, 5, 6), v - 1).otherwise(v)
        return F.struct(
            F.when(a & (c == 1), F.lit("other")).otherwise(F.lit("CSS")).alias("kind"), F.when(a & (c == 6), v).otherwise(F.least(low, v)).alias("d"), F.when(a & c.isin(2, 5), F.lit("L2")).otherwise(F.lit("L1")).alias("layout"),
            low.alias("x_value"), F.when(a & (c == 4), v).otherwise(low).alias("x_weight"), F.lit("upper_bound").alias("x_confidence"), F.when(a & (c == 7), F.lit(9)).otherwise(F.lit(1)).alias("x_stamp"),
            v.alias("z_value"), v.alias("z_weight"), F.lit("exact").alias("z_confidence"), F.lit(None).cast("int").alias("z_stamp"),
        )

    return t(spark, sf, "orders").select(k.alias("path"), F.when(c != 8, state(False)).alias("base"), state(True).alias("head"))


@query("m4_classify", f"WITH {M4_SQL} SELECT path, CASE c WHEN 8 THEN 'new' WHEN 7 THEN 'stamp' WHEN 1 THEN 'full' WHEN 2 THEN 'layout-only' WHEN 0 THEN 'layout-only' WHEN 5 THEN 'full' WHEN 4 THEN 'full' WHEN 6 THEN 'full' ELSE 'tightening' END AS cls FROM m")
def _(spark, sf):
    return diff.classify(_pairs(spark, sf), ["kind"]).select("path", "cls")


@query("m5_entered_tighter", f"WITH {E_SQL} SELECT key, CASE loc WHEN 'local-2d-single' THEN 0 WHEN 'local-2d-bilayer' THEN 1 ELSE 2 END < CASE WHEN key % 2 = 0 THEN 1 ELSE 2 END AS tighter FROM e")
def _(spark, sf):
    from ..operators.scoring import LOCALITY_ORDER, tightness

    return entries(spark, sf).select("key", diff.entered_tighter(F.when(F.col("key") % 2 == 0, 1), tightness(F.col("loc"), LOCALITY_ORDER)).alias("tighter"))


M6_SQL = """r AS (SELECT o_orderkey AS key, o_orderkey % 6 AS c FROM orders), v AS (SELECT *, CASE c WHEN 0 THEN 'other fields changed' WHEN 1 THEN 'notes not append-only' WHEN 2 THEN 'finder not credited' WHEN 3 THEN 'not strictly lower' ELSE '' END AS ref,
  CASE WHEN key % 2 = 0 THEN 'already has a layout' WHEN c = 0 THEN 'other fields changed' WHEN key % 5 = 0 THEN 'contributor not listed' ELSE '' END AS lay FROM r)"""


def _bindings(spark, sf):
    k = F.col("o_orderkey")
    c, me = k % 6, F.lit("@me")
    sides = [
        {"before": F.lit(5), "after": F.when(c == 3, 6).otherwise(4), "found_by": F.when(c == 2, F.array(F.lit("@you"))).otherwise(F.array(me)), "stamp_only": F.lit(False)},
        {"before": F.lit(7), "after": F.lit(7), "found_by": F.array().cast("array<string>"), "stamp_only": F.lit(False)},
    ]
    d = F.least(sides[0]["after"], sides[1]["after"])
    ref = diff.refutation_bound(c != 0, F.lit("a"), F.when(c == 1, F.lit("b")).otherwise(F.lit("ab")), sides, d, me)
    lay = diff.layout_bound(F.when(k % 2 == 0, F.lit("L")), F.lit("L2"), c != 0, F.when(k % 5 == 0, F.array(F.lit("@you"))).otherwise(F.array(me)), me)
    return t(spark, sf, "orders").select(k.alias("key"), ref.alias("ref"), lay.alias("lay"))


@query("m6_refutation_bound", f"WITH {M6_SQL} SELECT key, ref FROM v")
def _(spark, sf):
    return _bindings(spark, sf).select("key", "ref")


@query("m7_layout_bound", f"WITH {M6_SQL} SELECT key, lay FROM v")
def _(spark, sf):
    return _bindings(spark, sf).select("key", "lay")


@query("m8_authorship", f"WITH {M6_SQL} SELECT key, CASE WHEN key % 13 = 0 THEN 'exempt' WHEN key % 7 = 0 THEN 'author' WHEN ref = '' THEN 'refutation' WHEN lay = '' THEN 'layout' ELSE 'violation' END AS verdict FROM v")
def _(spark, sf):
    k = F.col("key")
    authors = F.when(k % 7 == 0, F.array(F.lit("@me"))).otherwise(F.array(F.lit("@you")))
    who = F.when(k % 13 == 0, F.lit("@Bot")).otherwise(F.lit("@ME"))
    return _bindings(spark, sf).select("key", diff.authorship(who, ["@bot"], authors, authors, F.col("ref"), F.col("lay")).alias("verdict"))


@query("m9_change_scope", """SELECT o_custkey, count(*) FILTER (WHERE o_orderkey % 3 = 0 AND o_orderstatus = 'F') AS n_new, count(*) FILTER (WHERE o_orderkey % 3 = 1) AS n_protected, count(*) FILTER (WHERE o_orderkey % 3 = 0) AS n_data,
  count(*) FILTER (WHERE o_orderkey % 3 = 0 AND o_orderstatus = 'F') <= 1 AND (count(*) FILTER (WHERE o_orderkey % 3 = 1) = 0 OR count(*) FILTER (WHERE o_orderkey % 3 = 0) = 0) AS ok FROM orders GROUP BY o_custkey""")
def _(spark, sf):
    k, s = F.col("o_orderkey"), F.col("o_orderkey").cast("string")
    path = F.when(k % 3 == 0, F.concat(F.lit("codes/"), s, F.lit(".json"))).when(k % 3 == 1, F.concat(F.lit("verify/"), s)).otherwise(F.concat(F.lit("notes/"), s))
    rows = t(spark, sf, "orders").select("o_custkey", path.alias("path"), F.when(F.col("o_orderstatus") == "F", "A").otherwise("M").alias("status"))
    return diff.change_scope(rows, ["o_custkey"])


@query("m10_sidecar_search", f"WITH {SNAP_SQL} SELECT h.path, b.path IS NULL OR b.st IS DISTINCT FROM h.st OR h.path % 2 = 0 AS search FROM h LEFT JOIN b ON h.path = b.path")
def _(spark, sf):
    base, head = _snapshots(spark, sf)
    both = head.join(base.select("path", F.col("st").alias("was"), F.lit(True).alias("old")), "path", "left")
    return both.select("path", diff.sidecar_search(F.col("was"), F.col("st"), F.col("old").isNull(), F.col("path") % 2 == 0).alias("search"))


@query("m11_manifest_drift", f"WITH {SNAP_SQL} SELECT coalesce(b.path, h.path) AS path, CASE WHEN h.path IS NULL THEN 'missing' WHEN b.path IS NULL THEN 'stale' ELSE 'changed' END AS drift FROM b FULL JOIN h ON b.path = h.path WHERE b.st IS NULL OR h.st IS NULL OR b.st <> h.st")
def _(spark, sf):
    base, head = _snapshots(spark, sf)
    sha = lambda df: df.select("path", F.sha2("st", 256).alias("sha"))
    return diff.manifest_drift(sha(base), sha(head))


@query("m12_budget", f"WITH {E_SQL} SELECT key, CASE WHEN exact THEN 25000 + 120 * n ELSE 2500 + 40 * n END AS trials, round(CASE WHEN exact THEN least(240, greatest(120, (25000 + 120 * n) * (0.0005::DOUBLE + 2.5e-6 * n) * 3)) ELSE least(90, greatest(10, (2500 + 40 * n) * (0.0005::DOUBLE + 2.5e-6 * n) * 4)) END, 6) AS seconds, CASE WHEN exact AND key % 2 = 1 THEN 3 ELSE 1 END AS seeds FROM e")
def _(spark, sf):
    return entries(spark, sf).select("key", *diff.budget(F.col("n"), F.col("exact"), F.col("key") % 2 == 0)).withColumn("seconds", F.round("seconds", 6))


@query("m13_route", f"WITH {M4_SQL}, k AS (SELECT path, CASE c WHEN 8 THEN 'new' WHEN 7 THEN 'stamp' WHEN 2 THEN 'layout-only' WHEN 0 THEN 'layout-only' WHEN 3 THEN 'tightening' ELSE 'full' END AS cls FROM m), r AS (SELECT path, CASE WHEN cls = 'layout-only' AND path % 2 = 0 AND path % 4 = 0 THEN 'layout-record' ELSE cls END AS routed FROM k) SELECT path, routed, CASE WHEN routed IN ('stamp', 'layout-record') THEN true WHEN routed = 'tightening' THEN false WHEN routed = 'layout-only' THEN NULL ELSE path % 2 = 0 END AS deep FROM r")
def _(spark, sf):
    cls = diff.classify(_pairs(spark, sf), ["kind"])
    return cls.select("path", *diff.route(F.col("cls"), F.col("path") % 2 == 0, F.col("path") % 4 == 0))


# ---- N: trial ledger

T_SQL = "t AS (SELECT l_partkey AS key, CASE WHEN l_linestatus = 'F' THEN 'X' ELSE 'Z' END AS side, l_returnflag AS method, l_orderkey AS trial, l_quantity::BIGINT AS weight FROM lineitem)"


def _trials(spark, sf):
    side = F.when(F.col("l_linestatus") == "F", "X").otherwise("Z")
    return t(spark, sf, "lineitem").select(F.col("l_partkey").alias("key"), side.alias("side"), F.col("l_returnflag").alias("method"), F.col("l_orderkey").alias("trial"), F.col("l_quantity").cast("long").alias("weight"))


@query("n1_lightest", f"WITH {T_SQL} SELECT key, side, min(weight) AS weight, arg_min(trial, {{'w': weight, 't': trial}}) AS witness FROM t GROUP BY key, side")
def _(spark, sf):
    return ledger.lightest(_trials(spark, sf), ["key", "side"], "weight", "trial")


METHOD_SQL = f"{T_SQL}, bm AS (SELECT key, method, min(weight) AS weight, 2 + key % 4 AS claim FROM t GROUP BY key, method), bv AS (SELECT *, CASE WHEN weight < claim THEN 'refuted' WHEN weight = claim THEN 'corroborated' ELSE 'inconclusive' END AS verdict FROM bm)"


def _by_method(spark, sf):
    rows = _trials(spark, sf).groupBy("key", "method").agg(F.min("weight").alias("weight"))
    return rows.withColumn("verdict", ledger.verdict(F.col("weight"), 2 + F.col("key") % 4))


@query("n2_verdict", f"WITH {METHOD_SQL} SELECT key, method, weight, verdict FROM bv")
def _(spark, sf):
    return _by_method(spark, sf)


@query("n3_combined", f"WITH {METHOD_SQL} SELECT key, count(DISTINCT weight) <= 1 AS agree, CASE WHEN bool_or(verdict = 'refuted') THEN 'refuted' WHEN bool_and(verdict = 'corroborated') THEN 'corroborated' ELSE 'inconclusive' END AS verdict FROM bv GROUP BY key")
def _(spark, sf):
    return ledger.combined(_by_method(spark, sf), "key")


@query("n4_any_hit", f"WITH {T_SQL}, b AS (SELECT *, weight < 2 + key % 4 AS below FROM t) SELECT key, bool_or(below) AS hit, count(*) FILTER (below) AS n_hits, coalesce(array_to_string(list_sort(list(DISTINCT weight || method) FILTER (below))[1:5], ','), '') AS hits FROM b GROUP BY key")
def _(spark, sf):
    trials = _trials(spark, sf)
    out = ledger.any_hit(trials, trials.select("key").distinct().withColumn("claim", 2 + F.col("key") % 4), "key")
    return out.withColumn("hits", F.array_join(F.transform("hits", lambda h: F.concat(h["weight"].cast("string"), h["method"])), ","))


@query("n5_accepted", "SELECT doc_id, coalesce(quality = 1, false) AS accepted FROM documents LEFT JOIN labels USING (doc_id)")
def _(spark, sf):
    good = t(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("ok"))
    return ledger.accepted(t(spark, sf, "documents").select("doc_id"), good, ["doc_id"])


@query("n6_stable_seed", "SELECT o_orderkey, (('0x' || left(sha256(o_orderkey::VARCHAR), 8))::BIGINT + 7) % 2147483648 AS seed FROM orders")
def _(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", ledger.stable_seed(F.col("o_orderkey").cast("string"), 7).alias("seed"))


@query("n7_sweep_summary", f"WITH {METHOD_SQL} SELECT count(*) AS checked, count(*) FILTER (verdict = 'refuted') AS refuted, 0::BIGINT AS errored, count(*) FILTER (verdict = 'refuted') = 0 AS passed FROM bv")
def _(spark, sf):
    return ledger.sweep_summary(_by_method(spark, sf))


@query("n8_certificate", f"WITH {T_SQL}, s AS (SELECT key, side, min(weight) AS value, bool_or(method = 'N') AS exact FROM t GROUP BY key, side) SELECT key, min(value) AS d, count(*) >= 2 AND bool_and(exact) AS exact FROM s GROUP BY key")
def _(spark, sf):
    sides = _trials(spark, sf).groupBy("key", "side").agg(F.min("weight").alias("value"), F.bool_or(F.col("method") == "N").alias("exact"))
    return ledger.certificate(sides, "key")


@query("n9_best_of_restarts", f"WITH {T_SQL} SELECT key, min(weight) AS best, min(trial) FILTER (weight <= 5) AS first_trial FROM t GROUP BY key")
def _(spark, sf):
    out = ledger.best_of_restarts(_trials(spark, sf), ["key"], ["trial"], "weight", 5)
    return out.select("key", "best", F.col("first_reaching.trial").alias("first_trial"))


LB_SQL = f"{E_SQL}, lb AS (SELECT n || '/' || d AS fp, key, eff, CASE WHEN key % 3 = 0 THEN 1 ELSE 0 END AS age FROM e), lm AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY age, eff DESC, key) AS rn FROM lb)"


def _board_rows(spark, sf):
    return entries(spark, sf).select(F.concat_ws("/", F.col("n").cast("string"), F.col("d").cast("string")).alias("fp"), "key", "eff")


@query("n10_merge_leaderboard", f"WITH {LB_SQL} SELECT fp, key, eff FROM lm WHERE rn = 1")
def _(spark, sf):
    rows = _board_rows(spark, sf)
    return ledger.merge_leaderboard(rows.filter("key % 3 = 0"), rows.filter("key % 3 <> 0"), "fp", [F.desc("eff"), F.asc("key")])


@query("n11_screen", f"WITH {E_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY n, w ORDER BY key) AS rn FROM e WHERE loc <> 'unrestricted' AND k >= 20) SELECT key, eff AS score FROM f WHERE rn = 1 AND d >= 3 ORDER BY score DESC, key LIMIT 50")
def _(spark, sf):
    return ledger.screen(entries(spark, sf), F.col("loc") != "unrestricted", 20, 3, ["n", "w"], F.col("eff"), ["key"], 50).select("key", "score")


@query("n12_candidate_verdict", f"WITH {E_SQL} SELECT key, exact AND key % 2 = 0 AND NOT key % 5 = 0 AS passed, array_to_string(list_filter([CASE WHEN NOT exact THEN 'rejected' END, CASE WHEN key % 2 = 1 THEN 'refuted' END, CASE WHEN key % 5 = 0 THEN 'duplicate' END, CASE WHEN key % 5 <> 0 AND key % 7 = 0 THEN 'similar' END, CASE WHEN w = 1 AND key % 5 <> 0 THEN 'advances' END], lambda x: x IS NOT NULL), ',') AS labels FROM e")
def _(spark, sf):
    k = F.col("key")
    rows = entries(spark, sf).select("key", F.col("exact").alias("verified"), (k % 2 == 1).alias("refuted"), F.when(k % 5 == 0, k).alias("exact_of"), F.when(k % 7 == 0, k).alias("similar_of"), (F.col("w") - 1).alias("n_dominators"))
    return ledger.candidate_verdict(rows, "key").withColumn("labels", F.array_join("labels", ","))


# ---- O: generators

TORUS_SQL = """s AS (SELECT s_suppkey AS spec, 3 + s_suppkey % 4 AS l, 3 + s_nationkey % 3 AS m FROM supplier), c AS (SELECT spec, l, m, u.c AS c, u.c // m AS i, u.c % m AS j FROM s, unnest(range(0, l * m)) AS u(c)),
  tm AS (SELECT 'X' AS side, 0 AS blk, 1 AS sg, unnest([{'x': 3, 'y': 0}, {'x': 0, 'y': 1}, {'x': 0, 'y': 2}]) AS t UNION ALL SELECT 'X', 1, 1, unnest([{'x': 0, 'y': 3}, {'x': 1, 'y': 0}, {'x': 2, 'y': 0}]) UNION ALL SELECT 'Z', 0, -1, unnest([{'x': 0, 'y': 3}, {'x': 1, 'y': 0}, {'x': 2, 'y': 0}]) UNION ALL SELECT 'Z', 1, -1, unnest([{'x': 3, 'y': 0}, {'x': 0, 'y': 1}, {'x': 0, 'y': 2}])),
  r AS (SELECT spec, side, c AS check_idx, (((i + sg * t.x) % l + l) % l) * m + (((j + sg * t.y) % m + m) % m) + blk * l * m AS qubit FROM c, tm)"""


def _torus(spark, sf):
    terms = lambda *p: F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in p))
    specs = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("spec"), (3 + F.col("s_suppkey") % 4).alias("l"), (3 + F.col("s_nationkey") % 3).alias("m"), terms((3, 0), (0, 1), (0, 2)).alias("a"), terms((0, 3), (1, 0), (2, 0)).alias("b"))
    return generate.torus_code(specs)


@query("o1_torus_code", f"WITH {TORUS_SQL} SELECT spec, side, check_idx, qubit FROM r GROUP BY ALL HAVING count(*) % 2 = 1")
def _(spark, sf):
    return _torus(spark, sf)


@query("o2_cyclic_tables", f"WITH {G_SQL} SELECT grp, g, h, gh FROM mul")
def _(spark, sf):
    return generate.cyclic_tables(groups(spark, sf))


@query("o3_table_product", "WITH s AS (SELECT s_suppkey AS grp, 2 + s_suppkey % 2 AS a, 2 + s_nationkey % 2 AS b FROM supplier), p AS (SELECT grp, a, b, u.g AS g, v.h AS h FROM s, unnest(range(0, a * b)) AS u(g), unnest(range(0, a * b)) AS v(h)) SELECT grp, g, h, ((g // b + h // b) % a) * b + (g % b + h % b) % b AS gh FROM p")
def _(spark, sf):
    s = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("grp"), (2 + F.col("s_suppkey") % 2).alias("a"), (2 + F.col("s_nationkey") % 2).alias("b"))
    left = generate.cyclic_tables(s.select("grp", "a", F.lit(1).alias("b")))
    right = generate.cyclic_tables(s.select("grp", F.col("b").alias("a"), F.lit(1).alias("b")))
    return generate.table_product(left, right, s.select("grp", F.col("b").alias("size_b")))


@query("o4_metacyclic_tables", "WITH s AS (SELECT s_suppkey AS grp, 3 + s_suppkey % 4 AS n FROM supplier) SELECT grp, u.g AS g, v.h AS h, ((u.g // 2 + CASE WHEN u.g % 2 = 0 THEN v.h // 2 ELSE (n - 1) * (v.h // 2) END) % n) * 2 + (u.g % 2 + v.h % 2) % 2 AS gh FROM s, unnest(range(0, 2 * n)) AS u(g), unnest(range(0, 2 * n)) AS v(h)")
def _(spark, sf):
    n = 3 + F.col("s_suppkey") % 4
    return generate.metacyclic_tables(t(spark, sf, "supplier").select(F.col("s_suppkey").alias("grp"), n.alias("n"), F.lit(2).alias("k"), (n - 1).alias("r")))


GC_SQL = f"""{G_SQL}, lf AS (SELECT grp, unnest([0, 1]) AS s FROM s), rt AS (SELECT grp, unnest([1, 3]) AS s FROM s),
  bl AS (SELECT m.grp, a * b AS sz, h AS x, gh AS y FROM mul m JOIN lf ON m.grp = lf.grp AND m.g = lf.s), br AS (SELECT m.grp, a * b AS sz, g AS x, gh AS y FROM mul m JOIN rt ON m.grp = rt.grp AND m.h = rt.s),
  gr AS (SELECT grp, 'X' AS side, x AS check_idx, y AS qubit FROM bl UNION ALL SELECT grp, 'X', x, y + sz FROM br UNION ALL SELECT grp, 'Z', y, x FROM br UNION ALL SELECT grp, 'Z', y, x + sz FROM bl),
  gc AS (SELECT grp, side, check_idx, qubit FROM gr GROUP BY ALL HAVING count(*) % 2 = 1)"""


def _supports(spark, sf):
    g = groups(spark, sf)
    mul = written(generate.cyclic_tables(g), "mul")
    pick = lambda *s: g.select("grp", F.explode(F.array(*(F.lit(x).cast("long") for x in s))).alias("s"))
    return mul, pick(0, 1), pick(1, 3), g.select("grp", (F.col("a") * F.col("b")).alias("size"))


@query("o5_group_code", f"WITH {GC_SQL} SELECT * FROM gc")
def _(spark, sf):
    return generate.group_code(*_supports(spark, sf))


@query("o6_coset_code", f"""WITH {G_SQL}, sub AS (SELECT grp, unnest([0::BIGINT, ((a * b) // 2)::BIGINT]) AS g FROM s WHERE (a % 2 = 0 AND b = 2 AND a = 2) OR (a = 4 AND b = 2) OR (a = 2 AND b = 4) OR (a = 4 AND b = 4) OR (a = 2 AND b = 3) OR (a = 4 AND b = 3)),
  k AS (SELECT m.grp, m.g, min(m.gh) AS rep FROM mul m JOIN sub ON m.grp = sub.grp AND m.h = sub.g GROUP BY ALL), n AS (SELECT *, dense_rank() OVER (PARTITION BY grp ORDER BY rep) - 1 AS cs FROM k), z AS (SELECT grp, count(DISTINCT cs) AS sz FROM n GROUP BY grp),
  rp AS (SELECT grp, rep, cs FROM n WHERE g = rep), lf AS (SELECT grp, unnest([0, 1]) AS s FROM s), rt AS (SELECT grp, unnest([1, 3]) AS s FROM s),
  bl AS (SELECT m.grp, rp.cs AS x, n.cs AS y FROM mul m JOIN lf ON m.grp = lf.grp AND m.g = lf.s JOIN rp ON rp.grp = m.grp AND rp.rep = m.h JOIN n ON n.grp = m.grp AND n.g = m.gh),
  br AS (SELECT m.grp, rp.cs AS x, n.cs AS y FROM mul m JOIN rt ON m.grp = rt.grp AND m.h = rt.s JOIN rp ON rp.grp = m.grp AND rp.rep = m.g JOIN n ON n.grp = m.grp AND n.g = m.gh),
  gr AS (SELECT grp, 'X' AS side, x AS check_idx, y AS qubit FROM bl UNION ALL SELECT br.grp, 'X', x, y + sz FROM br JOIN z ON br.grp = z.grp UNION ALL SELECT grp, 'Z', y, x FROM br UNION ALL SELECT bl.grp, 'Z', y, x + sz FROM bl JOIN z ON bl.grp = z.grp)
  SELECT grp, side, check_idx, qubit FROM gr GROUP BY ALL HAVING count(*) % 2 = 1""")
def _(spark, sf):
    mul, left, right, _ = _supports(spark, sf)
    g = groups(spark, sf).filter("(a = 2 AND b IN (2, 3, 4)) OR (a = 4 AND b IN (2, 3, 4))")
    half = ((F.col("a") * F.col("b")) / 2).cast("long")
    sub = g.select("grp", F.explode(F.array(F.lit(0).cast("long"), half)).alias("g"))
    return generate.coset_code(mul, sub, left, right)


HP_SQL = """w AS (SELECT s_suppkey AS key, 2 + s_suppkey % 3 AS r FROM supplier), a AS (SELECT key, u.i AS rw, (u.i + d) % (r + 1) AS cl FROM w, unnest(range(0, r)) AS u(i), unnest([0, 1]) AS v(d)),
  z AS (SELECT key, r, r + 1 AS c FROM w), hr AS (SELECT a.key, 'X' AS side, rw * c + u.k AS check_idx, cl * c + u.k AS qubit FROM a JOIN z ON a.key = z.key, unnest(range(0, c)) AS u(k)
  UNION ALL SELECT a.key, 'X', u.k * c + cl, c * c + u.k * r + rw FROM a JOIN z ON a.key = z.key, unnest(range(0, r)) AS u(k) UNION ALL SELECT a.key, 'Z', u.k * r + rw, u.k * c + cl FROM a JOIN z ON a.key = z.key, unnest(range(0, c)) AS u(k)
  UNION ALL SELECT a.key, 'Z', cl * r + u.k, c * c + rw * r + u.k FROM a JOIN z ON a.key = z.key, unnest(range(0, r)) AS u(k))"""


@query("o7_hypergraph_product", f"WITH {HP_SQL} SELECT key, side, check_idx, qubit FROM hr GROUP BY ALL HAVING count(*) % 2 = 1")
def _(spark, sf):
    w = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), (2 + F.col("s_suppkey") % 3).alias("r"))
    chain = w.select("key", "r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("r") - 1)).alias("row")).select("key", "r", "row", F.explode(F.array(F.lit(0), F.lit(1))).alias("d"))
    rows = chain.select("key", "row", ((F.col("row") + F.col("d")) % (F.col("r") + 1)).alias("col"))
    sizes = w.select("key", F.col("r").alias("ra"), (F.col("r") + 1).alias("ca"), F.col("r").alias("rb"), (F.col("r") + 1).alias("cb"))
    return generate.hypergraph_product(rows, rows, sizes)


@query("o8_product_of_codes", f"""WITH {GC_SQL}, h AS (SELECT gc.grp AS key, a * b AS n, check_idx AS r, qubit AS c FROM gc JOIN s ON gc.grp = s.grp WHERE side = 'X'),
  pr AS (SELECT key, 'X' AS side, r * 2 * n + u.k AS check_idx, c * 2 * n + u.k AS qubit FROM h, unnest(range(0, 2 * n)) AS u(k) UNION ALL SELECT key, 'X', u.k * 2 * n + c, 4 * n * n + u.k * n + r FROM h, unnest(range(0, n)) AS u(k)
  UNION ALL SELECT key, 'Z', u.k * n + r, u.k * 2 * n + c FROM h, unnest(range(0, 2 * n)) AS u(k) UNION ALL SELECT key, 'Z', c * n + u.k, 4 * n * n + r * n + u.k FROM h, unnest(range(0, n)) AS u(k)),
  od AS (SELECT key, side, check_idx, qubit FROM pr GROUP BY ALL HAVING count(*) % 2 = 1)
  SELECT key, side, count(*) AS entries, count(DISTINCT check_idx) AS checks, sum((check_idx + 1) * (qubit + 3) % 1000003)::BIGINT AS mixed FROM od GROUP BY key, side""")
def _(spark, sf):
    out = generate.product_of_group_codes(*_supports(spark, sf))
    mixed = F.sum((F.col("check_idx") + 1) * (F.col("qubit") + 3) % 1000003).alias("mixed")
    return out.groupBy("key", "side").agg(F.count("*").alias("entries"), F.count_distinct("check_idx").alias("checks"), mixed)


@query("o9_planar_code", """WITH s AS (SELECT s_suppkey AS spec, 3 + s_suppkey % 3 AS lx, 3 + s_nationkey % 2 AS ly FROM supplier),
  a AS (SELECT spec, lx, ly, u.i AS i, v.j AS j FROM s, unnest(range(-1, lx + 1)) AS u(i), unnest(range(-1, ly + 1)) AS v(j)), o AS (SELECT 'X' AS side, 0 AS b, 0 AS x, 0 AS y UNION ALL SELECT 'X', 0, 1, 0 UNION ALL SELECT 'X', 1, 0, 0 UNION ALL SELECT 'X', 1, 0, 1 UNION ALL SELECT 'Z', 0, 0, 0 UNION ALL SELECT 'Z', 0, 0, -1 UNION ALL SELECT 'Z', 1, 0, 0 UNION ALL SELECT 'Z', 1, -1, 0),
  r AS (SELECT spec, lx, ly, side, i, j, b, i + x AS p, j + y AS q FROM a, o), bad AS (SELECT DISTINCT spec, side, i, j FROM r WHERE NOT (p >= 0 AND p < lx AND q >= 0 AND q < ly) AND NOT CASE WHEN side = 'X' THEN q >= 0 AND q < ly ELSE p >= 0 AND p < lx END),
  k AS (SELECT spec, side, i, j, b * lx * ly + p * ly + q AS qubit FROM r WHERE p >= 0 AND p < lx AND q >= 0 AND q < ly AND (spec, side, i, j) NOT IN (SELECT spec, side, i, j FROM bad) GROUP BY ALL HAVING count(*) % 2 = 1),
  od AS (SELECT x.spec, x.i, x.j FROM k x JOIN k z ON x.spec = z.spec AND x.qubit = z.qubit WHERE x.side = 'X' AND z.side = 'Z' GROUP BY x.spec, x.i, x.j, z.i, z.j HAVING count(*) % 2 = 1), g AS (SELECT * FROM k WHERE side = 'Z' OR (spec, i, j) NOT IN (SELECT spec, i, j FROM od))
  SELECT spec, side, dense_rank() OVER (PARTITION BY spec, side ORDER BY i, j) - 1 AS check_idx, qubit FROM g""")
def _(spark, sf):
    terms = lambda *p: F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in p))
    specs = t(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("spec"), (3 + F.col("s_suppkey") % 3).cast("int").alias("lx"), (3 + F.col("s_nationkey") % 2).cast("int").alias("ly"),
        terms((0, 0), (1, 0)).alias("xa"), terms((0, 0), (0, 1)).alias("xb"), terms((0, 0), (0, -1)).alias("za"), terms((0, 0), (-1, 0)).alias("zb"),
    )
    return generate.planar_code(specs)


@query("o10_sample_specs")
def _(spark, sf):
    n = t(spark, sf, "orders").count()
    return generate.sample_specs(spark, 42, n, {"l": 12, "m": 9}, 3).withColumn("terms", F.array_join(F.col("terms").cast("array<string>"), ","))


# ---- P: operation lines

C_SQL = "op AS (SELECT conv_id AS file, turn AS line, role AS name, length(text) AS len FROM conversations)"


def _ops(spark, sf):
    return t(spark, sf, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("line"), F.col("role").alias("name"), F.length("text").alias("len"))


@query("p1_absolute_records", f"WITH {C_SQL} SELECT file, line, coalesce(sum(CASE WHEN name = 'user' THEN len ELSE 0 END) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT - 1 AS record FROM op")
def _(spark, sf):
    ops = _ops(spark, sf).withColumn("off", F.lit(-1))
    return circuits.absolute_records(ops, F.when(F.col("name") == "user", F.col("len")).otherwise(0), "off").select("file", "line", "record")


@query("p2_layers", f"WITH {C_SQL} SELECT file, line, count(*) FILTER (name = 'user') OVER (PARTITION BY file ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS layer FROM op")
def _(spark, sf):
    return circuits.layers(_ops(spark, sf), F.col("name") == "user").select("file", "line", "layer")


@query("p3_without_noise", f"WITH {C_SQL} SELECT file, line FROM op WHERE len % 3 <> 0")
def _(spark, sf):
    ops = _ops(spark, sf).withColumns({"name": F.when(F.col("len") % 3 == 0, "X_ERROR").otherwise("M"), "arg": F.lit(0.1)})
    return circuits.without_noise(ops).filter("arg IS NULL").select("file", "line")


@query("p4_not_allowed", f"WITH {C_SQL} SELECT file, name, count(*) AS n FROM op WHERE name <> 'user' GROUP BY ALL")
def _(spark, sf):
    return circuits.not_allowed(_ops(spark, sf), allowed=["user"])


@query("p5_noise_differences", f"""WITH {I_SQL}, tg AS (SELECT key AS file, check_idx % 40 AS layer, CASE check_idx % 3 WHEN 0 THEN 'two' WHEN 1 THEN 'reset' ELSE 'measure' END AS channel, qubit FROM i WHERE side = 'X'),
  dq AS (SELECT DISTINCT file, qubit FROM tg WHERE qubit % 4 = 0), sl AS (SELECT DISTINCT file, layer FROM tg), asked AS (SELECT file, layer, channel, qubit FROM tg UNION ALL
  SELECT sl.file, sl.layer, 'idle', dq.qubit FROM sl JOIN dq ON sl.file = dq.file WHERE NOT EXISTS (SELECT 1 FROM tg WHERE tg.file = sl.file AND tg.layer = sl.layer AND tg.qubit = dq.qubit)),
  x AS (SELECT file, layer, channel, qubit, count(*) AS c FROM asked GROUP BY ALL), y AS (SELECT * FROM x WHERE (qubit + layer) % 10 <> 0),
  df AS (SELECT x.* FROM x LEFT JOIN y ON x.file = y.file AND x.layer = y.layer AND x.channel = y.channel AND x.qubit = y.qubit WHERE y.c IS NULL), fi AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY layer, channel, qubit) AS rn, count(*) OVER (PARTITION BY file) AS n FROM df)
  SELECT file, n, layer || ' ' || channel || ' ' || qubit AS first FROM fi WHERE rn = 1""")
def _(spark, sf):
    """A file's operations in forty layers; its data are every fourth qubit, asked for an idle channel where a layer leaves them out."""
    name = F.when(F.col("check_idx") % 3 == 0, "CX").when(F.col("check_idx") % 3 == 1, "R").otherwise("M")
    rows = written(incidence(spark, sf).filter("side = 'X'").select(F.col("key").alias("file"), (F.col("check_idx") % 40).alias("layer"), name.alias("name"), "qubit"), "operations")
    asked = written(circuits.expected_noise(rows, rows.filter("qubit % 4 = 0").select("file", "qubit").distinct(), packed=True), "noise")
    out = circuits.noise_differences(asked, asked.withColumn("layers", F.filter("layers", lambda layer: (F.col("qubit") + layer) % 10 != 0)))
    return out.select("file", "n", F.concat_ws(" ", F.col("first.layer").cast("string"), "first.channel", F.col("first.qubit").cast("string")).alias("first"))


@query("p6_readout_covers", f"WITH m AS (SELECT l_suppkey AS file, l_orderkey AS line, l_partkey % 10 AS qubit FROM lineitem), dq AS (SELECT DISTINCT file, qubit FROM m WHERE qubit < 2), o AS (SELECT file, max(line) AS last FROM m WHERE qubit >= 2 GROUP BY file), f AS (SELECT m.file, m.qubit, count(*) AS c FROM m LEFT JOIN o ON m.file = o.file WHERE m.qubit < 2 AND (last IS NULL OR line > last) GROUP BY ALL) SELECT dq.file, bool_and(coalesce(c = 1, false)) AS ok FROM dq LEFT JOIN f ON dq.file = f.file AND dq.qubit = f.qubit GROUP BY dq.file")
def _(spark, sf):
    m = t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_orderkey").alias("line"), (F.col("l_partkey") % 10).alias("qubit"))
    return circuits.readout_covers(m, m.filter("qubit < 2").select("file", "qubit").distinct())


@query("p7_rounds", f"WITH {I_SQL}, c AS (SELECT key AS file, qubit, count(*) AS c FROM i GROUP BY ALL) SELECT file, max(c) AS rounds FROM c GROUP BY file")
def _(spark, sf):
    return circuits.rounds(incidence(spark, sf).select(F.col("key").alias("file"), "qubit"))


@query("p8_observables", "SELECT o_orderkey AS file, coalesce(max(l_linenumber) = count(DISTINCT l_linenumber) AND count(DISTINCT l_linenumber) = o_orderkey % 5 AND count(*) = count(DISTINCT (l_linenumber, l_partkey)), false) AS ok FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def _(spark, sf):
    obs = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file"), (F.col("l_linenumber") - 1).alias("obs"), F.col("l_partkey").alias("record"))
    sizes = t(spark, sf, "orders").select(F.col("o_orderkey").alias("file"), (F.col("o_orderkey") % 5).alias("k"))
    return circuits.observables_complete(obs, sizes)


@query("p9_multiset_difference", f"WITH {I_SQL}, s AS (SELECT key, side, check_idx, list_sort(list(qubit % 5)) AS sup FROM i GROUP BY key, side, check_idx), d AS (SELECT key, sup, count(*) FILTER (side = 'X') - count(*) FILTER (side = 'Z') AS d FROM s GROUP BY key, sup) SELECT key, sum(greatest(d, 0))::BIGINT AS missing, sum(greatest(-d, 0))::BIGINT AS unexpected FROM d GROUP BY key")
def _(spark, sf):
    s = incidence(spark, sf).groupBy("key", "side", "check_idx").agg(F.sort_array(F.collect_list(F.col("qubit") % 5)).alias("support"))
    return circuits.multiset_difference(s.filter("side = 'X'"), s.filter("side = 'Z'"), ["key"])


@query("p10_model_match", "WITH a AS (SELECT l_suppkey AS file, l_orderkey AS idx, sum(l_discount) AS p FROM lineitem GROUP BY ALL) SELECT file, count(*) FILTER (idx % 101 = 0 AND p > 0) = 0 AS ok, count(*) FILTER (idx % 101 = 0 AND p > 0) AS n_different FROM a GROUP BY file")
def _(spark, sf):
    a = t(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("file"), F.col("l_orderkey").alias("idx")).agg(F.sum("l_discount").alias("p"), F.sort_array(F.collect_list("l_partkey")).alias("targets"))
    b = a.withColumn("p", F.when(F.col("idx") % 101 == 0, F.col("p") * 1.5).otherwise(F.col("p") * (1 + 1e-11)))
    return circuits.model_match(written(a, "model-a"), written(b, "model-b"))


@query("p11_fault_witness", f"WITH w AS (SELECT l_orderkey AS file, l_partkey AS idx, count(*) AS c FROM lineitem GROUP BY ALL), sz AS (SELECT l_orderkey AS file, count(*) AS n FROM lineitem GROUP BY ALL), par AS (SELECT w.file, CASE WHEN k = 0 THEN 'D' ELSE 'L' END AS kind, CASE WHEN k = 0 THEN idx % 2 ELSE idx % 3 END AS target FROM w, unnest([0, 1]) AS u(k) WHERE c = 1 GROUP BY ALL HAVING count(*) % 2 = 1), s AS (SELECT file, count(*) FILTER (kind = 'D') AS d, count(*) FILTER (kind = 'L') AS l FROM par GROUP BY file) SELECT sz.file, sz.n = 2 + sz.file % 3 AND coalesce(s.d, 0) = 0 AND coalesce(s.l, 0) > 0 AND NOT EXISTS (SELECT 1 FROM w WHERE w.file = sz.file AND c > 1) AS ok FROM sz LEFT JOIN s ON s.file = sz.file")
def _(spark, sf):
    from pyspark.sql import Window as W

    rows = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_partkey").alias("idx"))
    witness = rows.withColumn("pos", F.row_number().over(W.partitionBy("file").orderBy("idx")))
    known = rows.distinct()
    targets = known.select("file", "idx", F.explode(F.array(F.struct(F.lit("D").alias("kind"), (F.col("idx") % 2).alias("target")), F.struct(F.lit("L").alias("kind"), (F.col("idx") % 3).alias("target")))).alias("x")).select("file", "idx", "x.*")
    claims = known.select("file").distinct().withColumn("value", 2 + F.col("file") % 3)
    return circuits.fault_witness(witness, known, targets, claims)


@query("p12_budget", f"WITH {I_SQL} SELECT key AS file, count(*) AS n, count(*) <= 25000 AS ok FROM i GROUP BY key")
def _(spark, sf):
    return circuits.within_budget(incidence(spark, sf).select(F.col("key").alias("file")))


@query("p13_earned", f"WITH b AS (SELECT l_orderkey AS file, l_linestatus AS basis, min(l_quantity)::BIGINT AS value, count(*) AS rounds, bool_and(l_discount < 0.09) AS ok FROM lineitem GROUP BY ALL), s AS (SELECT o_orderkey AS file, o_orderkey % 40 AS d FROM orders) SELECT b.file, CASE WHEN bool_and(b.ok AND value <= d AND rounds >= d % 3 AND true) AND count(DISTINCT basis) = 2 THEN min(value) END AS earned FROM b JOIN s ON b.file = s.file GROUP BY b.file")
def _(spark, sf):
    b = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("file"), F.col("l_linestatus").alias("basis")).agg(F.min("l_quantity").cast("long").alias("value"), F.count("*").alias("rounds"), F.bool_and(F.col("l_discount") < 0.09).alias("ok"))
    s = t(spark, sf, "orders").select(F.col("o_orderkey").alias("file"), (F.col("o_orderkey") % 40).alias("d"), F.lit("1.0").alias("version"))
    shifted = b.join(s.select("file", F.col("d").alias("dd")), "file").withColumn("rounds", F.when(F.col("rounds") >= F.col("dd") % 3, F.lit(1000)).otherwise(F.lit(-1))).drop("dd")
    return circuits.earned(shifted, s)


@query("p14_ancillas", "SELECT o_orderkey AS file, count(l_partkey) = 4 AS ok FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def _(spark, sf):
    rows = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("file")).agg(F.collect_list(F.array("l_quantity", "l_tax")).alias("coordinates"))
    files = t(spark, sf, "orders").select(F.col("o_orderkey").alias("file")).join(rows, "file", "left").select("file", F.lit(9).alias("qubits"), F.lit(5).alias("n"), F.coalesce("coordinates", F.array().cast("array<array<double>>")).alias("coordinates"))
    return circuits.ancilla_coordinates(files)


# ---- S: streaming


def _stream(spark, sf, name):
    """A table as a file stream; Spark takes a folder or a glob, so single files are named by one."""
    table = spark.read.parquet(f"{sf}/{name}.parquet")
    return spark.readStream.schema(table.schema).parquet(f"{sf}/{name}*.parquet")


@query("s1_streaming_leaderboard", f"WITH {E_SQL}, lb AS (SELECT n || '/' || d AS fp, key, eff, row_number() OVER (PARTITION BY n || '/' || d ORDER BY key % 4 DESC, eff DESC, key) AS rn FROM e) SELECT fp, key, eff FROM lb WHERE rn = 1")
def _(spark, sf):
    """Entries arrive in four deliveries; after each the stream goes on from its checkpoint with one more batch."""
    import uuid

    from ..functions.tables import shared_dir

    base = f"{shared_dir(spark)}/leaderboard-{uuid.uuid4().hex}"
    rows = written(_board_rows(spark, sf), "board-rows")
    for part in range(4):
        rows.filter(F.col("key") % 4 == part).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        incremental.upsert_leaderboard(stream, f"{base}/board", f"{base}/state", "fp", [("eff", False), ("key", True)]).awaitTermination()
    return incremental.leaderboard(spark, f"{base}/board", "fp string, key long, eff double", "fp")


@query("s2_streaming_lightest", "SELECT l_partkey AS key, min(l_quantity)::BIGINT AS weight, arg_min(l_orderkey, {'w': l_quantity, 't': l_orderkey}) AS witness FROM lineitem GROUP BY l_partkey")
def _(spark, sf):
    from ..functions.tables import shared_dir
    import uuid

    base = f"{shared_dir(spark)}/lightest-{uuid.uuid4().hex}"
    rows = _stream(spark, sf, "lineitem").select(F.col("l_partkey").alias("key"), F.col("l_quantity").cast("long").alias("weight"), F.col("l_orderkey").alias("trial"))
    running = incremental.running_lightest(rows, ["key"], "weight", "trial")
    last = running.writeStream.outputMode("complete").foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{base}/out")).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    last.awaitTermination()
    return spark.read.parquet(f"{base}/out")


@query("s4_changed_inputs", f"WITH {SNAP_SQL} SELECT h.path AS name FROM h WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.path = h.path AND b.price = h.price AND b.st = h.st)")
def _(spark, sf):
    from ..sources.files import changed_files

    base, head = _snapshots(spark, sf)
    shape = lambda df: df.select(F.col("path").alias("name"), F.col("st").alias("mtime"), F.col("price").alias("size"))
    return changed_files(shape(head), shape(base)).select("name")

