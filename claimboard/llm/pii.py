"""Personal data by bootstrapped contextual extraction (operator 8). DataFrame functions only.

Seeds are the spans of four base patterns: email, ip, card (Luhn) and phone, and long runs of hexadecimal digits as
seeds of secrets. Units are the seeds, all other words with a digit or an @, and runs of digit groups with single
separators. A lexical pattern is what stands around a unit: its two words before, or the word before and the word
after. Pattern and instance form a bipartite graph that is scored until nothing new is found, each round adding to what is known: a
pattern's confidence for a kind is the share of its distinct values that are known to be of that kind, and a unit of
plausible shape is found if one minus the product of its good patterns' doubts reaches LEAST_SCORE; it is a seed from
then on. Patterns need LEAST_SEEDS distinct values, so that copies of one text prove nothing. A secret is only
reported where such a pattern confirms it. Of found units that overlap, the first and then longest stays.

Positions are code points, found natively: the text between matches and the matches are measured in turn. Long texts
are cut into segments of about SEGMENT characters where a letter stands before a space, which no match spans; the words
around a unit may stand in the segments beside its own. Single separators inside digits, and dots inside host names, are first
replaced by a control character of equal length, so that every pattern is a plain run of characters and no text is too
long for the regular expression's stack.

Defined results: a null text is an empty one; repeated rows get the same spans; rows without doc_id are treated
like others; an empty table gives an empty table; other columns are ignored by find() and carried by mask().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, drop, fresh, let, table

KINDS = ["email", "ip", "card", "phone"]
FOUND_KINDS = [*KINDS, "secret"]
LEAST_SEEDS, LEAST_CONFIDENCE, LEAST_SCORE, CONTEXT, SEGMENT = 4, 0.8, 0.9, 48, 4000
#: Digits that an unseen value of a kind must have at least.
LEAST_DIGITS = {"email": 0, "ip": 4, "card": 10, "phone": 7, "secret": 4}
_LOCAL = "A-Za-z0-9._%+\\u0002-"
EMAIL = f"(?:(?<![{_LOCAL}])|\\G)[{_LOCAL}]++@[A-Za-z0-9-]++\\u0002[A-Za-z0-9\\u0002-]+"
IP = "(?<![0-9])[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++"
CARD = "[0-9][0-9\\u0001]{13,}"
PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"
UNIT = "(?<![^\\x20\\x09-\\x0D])[^\\x20\\x09-\\x0D0-9@]*+[0-9@][^\\x20\\x09-\\x0D]*+"
RUN = "(?<![A-Za-z0-9@._%+-])[+(]?[0-9][0-9\\x20().-]*[0-9](?![A-Za-z0-9@])"
SECRET, SECRET_SHAPE = "^[0-9a-fA-F]{32,}$", "^(?=.*[A-Za-z])[A-Za-z0-9_+/=-]{16,}$"
SEGMENTS = "(?s)(?:.{%d}.*?[A-Za-z](?= )|.+)" % SEGMENT
SPAN = "struct<s:int,e:int,kind:string,value:string>"


def _matches(text: Column, pattern: str, kind: str) -> Column:
    """Leftmost non-overlapping matches of a text, as an array of spans."""
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(acc: Column, pair: Column) -> Column:
        s = acc["at"] + F.length(pair["gap"])
        e = s + F.length(pair["hit"])
        span = F.struct(s.alias("s"), e.alias("e"), F.lit(kind).alias("kind"), pair["hit"].alias("value"))
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def walk(h: Column) -> Column:
        paired = F.zip_with(F.slice(gaps, F.lit(1), F.size(h)), h, lambda g, x: F.struct(g.alias("gap"), x.alias("hit")))
        return F.when(F.size(h) == 0, start["out"]).otherwise(F.aggregate(paired, start, step, lambda acc: acc["out"]))

    return let(hits, walk)


def _only(text: Column, condition: Column, spans: Column) -> Column:
    return F.when(condition, spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def _luhn(value: Column) -> Column:
    """Whether 14 to 19 digits, separators aside, pass the Luhn test."""
    digits = F.reverse(F.split(F.regexp_replace(value, "[^0-9]", ""), ""))

    def total(d: Column) -> Column:
        doubled = F.transform(d, lambda x, i: F.when(i % 2 == 1, (x.cast("int") * 2) - F.when(x.cast("int") > 4, 9).otherwise(0)).otherwise(x.cast("int")))
        return F.aggregate(doubled, F.lit(0), lambda acc, x: acc + x) % 10 == 0

    return let(F.filter(digits, lambda x: x != ""), lambda d: F.size(d).between(14, 19) & total(d))


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start and then by kind as listed."""
    t = F.translate(F.coalesce(text, F.lit("")), "\x01\x02", "\x03\x03")

    def found(x: Column) -> Column:
        hosts = F.regexp_replace(x, "(?<=[A-Za-z0-9-])\\.(?=[A-Za-z0-9-])", "\x02")
        runs = F.regexp_replace(x, "(?<=[0-9])[\\x20-](?=[0-9])", "\x01")
        email = _only(x, F.contains(x, F.lit("@")), _matches(hosts, EMAIL, "email"))
        part = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.try_to_number(F.ltrim(p, F.lit("0")), F.lit("999")).cast("int"), F.lit(0)) <= 255)
        ip = _only(x, x.rlike("[0-9]\\.[0-9]"), _matches(x, IP, "ip"))
        ip = F.filter(ip, lambda s: F.forall(F.split(s["value"], "\\."), part))
        card = _only(x, x.rlike("[0-9][0-9\\x20-]{12,}[0-9]"), _matches(runs, CARD, "card"))
        card = F.filter(card, lambda s: _luhn(s["value"]))
        phone = _only(x, F.contains(x, F.lit("+")), _matches(x, PHONE, "phone"))
        phone = F.filter(phone, lambda s: F.length(F.regexp_replace(s["value"], "[^0-9]", "")).between(10, 15))
        order = lambda a, b: F.when(a["s"] != b["s"], a["s"] - b["s"]).otherwise(_rank(a["kind"]) - _rank(b["kind"]))
        every = F.concat(email, ip, card, phone)
        return let(every, lambda v: F.when(F.size(v) < 2, v).otherwise(F.array_sort(v, order)))

    return let(t, found)


def _is(kind: str):
    return lambda span: span["kind"] == kind


def _rank(kind: Column) -> Column:
    out = F.lit(len(FOUND_KINDS))
    for i, k in reversed(list(enumerate(FOUND_KINDS))):
        out = F.when(kind == k, i).otherwise(out)
    return out


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def _free_units(text: Column, spans: Column) -> Column:
    """Trimmed words with a digit or an @, and runs of digit groups, that no base span touches."""
    digits = lambda u: F.length(F.regexp_replace(u["value"], "[^0-9]", ""))
    words = F.filter(F.transform(_only(text, text.rlike("[0-9@]"), _matches(text, UNIT, "")), _trimmed), lambda u: F.length(u["value"]) >= 4)
    runs = F.filter(
        _only(text, text.rlike("[0-9][\\x20().-]{1,2}[0-9]"), _matches(text, RUN, "")),
        lambda u: u["value"].rlike("[0-9][\\x20().-]+[0-9]") & ~u["value"].rlike("[\\x20.-]{2}") & digits(u).between(7, 19),
    )
    return F.filter(F.concat(words, runs), lambda u: ~F.exists(spans, lambda b: (b["s"] < u["e"]) & (b["e"] > u["s"])))


def _trimmed(unit: Column) -> Column:
    """A unit without punctuation at its edges."""
    lead = F.length(F.regexp_extract(unit["value"], "^[^A-Za-z0-9+]*", 0))
    value = F.regexp_extract(unit["value"], "[A-Za-z0-9+](?:.*[A-Za-z0-9])?", 0)
    return F.struct((unit["s"] + lead).alias("s"), (unit["s"] + lead + F.length(value)).alias("e"), unit["kind"].alias("kind"), value.alias("value"))


def units(docs: DataFrame) -> DataFrame:
    """(doc_id, th, base, units) per row: base spans, and seeds and free units with the words around them."""
    t = F.coalesce(F.col("text"), F.lit(""))

    def around(text: Column, u: Column, lead: Column, rest: Column) -> Column:
        """`lead` and `rest`: what stands beside the segment, so that the words around a unit are those of the whole text."""
        from_ = F.greatest(u["s"] - CONTEXT, F.lit(0))
        left_part, right_part = F.substring(text, from_ + 1, u["s"] - from_), F.substring(text, u["e"] + 1, F.lit(CONTEXT))
        before = F.lower(F.btrim(F.right(F.concat(lead, left_part), F.lit(CONTEXT)), F.lit(SPACES)))
        after = F.lower(F.btrim(F.left(F.concat(right_part, rest), F.lit(CONTEXT)), F.lit(SPACES)))
        plain = lambda c: F.regexp_replace(c, "[0-9]", "0")
        left, right = F.split(before, "[\\x20\\x09-\\x0D]+"), F.split(after, "[\\x20\\x09-\\x0D]+")
        one = plain(F.try_element_at(left, F.lit(-1)))
        two = F.concat_ws(" ", plain(F.try_element_at(left, F.lit(-2))), one)
        patterns = F.array(F.concat(F.lit("2 "), two), F.concat(F.lit("1 "), one, F.lit(" _ "), plain(F.get(right, F.lit(0)))))
        return F.struct(u["s"].alias("s"), u["e"].alias("e"), u["kind"].alias("kind"), F.regexp_replace(u["value"], "[\\u0001\\u0002]", "").alias("value"), patterns.alias("patterns"))

    def shifted(u: Column, by: Column, *more: str) -> Column:
        return F.struct((u["s"] + by).alias("s"), (u["e"] + by).alias("e"), *(u[c].alias(c) for c in ("kind", "value", *more)))

    def searched(segment: Column, by: Column, lead: Column, rest: Column) -> Column:
        def both(b: Column) -> Column:
            spelled = F.transform(F.concat(b, _free_units(segment, b)), lambda u: around(segment, u, lead, rest))
            return F.struct(F.transform(b, lambda u: shifted(u, by)).alias("base"), F.transform(spelled, lambda u: shifted(u, by, "patterns")).alias("all"))

        return let(base_spans(segment), both)

    def whole(segments: Column) -> Column:
        before = lambda i: F.aggregate(F.slice(segments, F.lit(1), i), F.lit(0), lambda acc, x: acc + F.length(x))
        beside = lambda i, cut: F.coalesce(cut(F.get(segments, i), F.lit(CONTEXT)), F.lit(""))
        return F.transform(segments, lambda x, i: let(before(i), lambda by: searched(x, by, beside(i - 1, F.right), beside(i + 1, F.left))))

    segments = F.when(F.length(t) <= SEGMENT, F.array(t)).otherwise(F.regexp_extract_all(t, F.lit(SEGMENTS), F.lit(0)))
    narrow = docs.select("doc_id", F.xxhash64("text").alias("th"), let(segments, whole).alias("f"))
    every = F.flatten(F.transform("f", lambda x: x["all"]))
    return narrow.select("doc_id", "th", F.flatten(F.transform("f", lambda x: x["base"])).alias("base"), F.when(F.size(every) > 0, every).alias("units"))


def _bootstrap(found: DataFrame) -> DataFrame:
    """(v, kind) of values that high-confidence patterns discover beyond the seeds, and of the secrets they confirm."""
    rows = found.select(F.explode("units").alias("u")).select(F.sha2("u.value", 256).alias("v"), F.col("u.value").alias("value"), F.nullif("u.kind", F.lit("")).alias("kind"), F.explode("u.patterns").alias("pattern"))
    rows = rows.withColumn("kind", F.coalesce("kind", F.when(F.col("value").rlike(SECRET) & F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Fa-f]"), "secret")))
    digits = F.length(F.regexp_replace("value", "[^0-9]", ""))
    edges = rows.groupBy("v", "kind", "pattern").agg(F.max(digits).alias("digits"), F.max(F.contains("value", F.lit("@"))).alias("at"), F.max(F.col("value").rlike(SECRET_SHAPE)).alias("dense"))
    edges = table(edges, "pii-edges")
    known = None
    while True:  # ends, as every round but the last adds values
        labelled = edges if known is None else edges.join(known.select("v", F.col("kind").alias("found")).hint("merge"), "v", "left").withColumn("kind", F.coalesce("kind", "found")).drop("found")
        counts = labelled.groupBy("pattern").agg(F.count("*").alias("all"), *(F.count_if(F.col("kind") == k).alias(k) for k in FOUND_KINDS))
        kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in FOUND_KINDS)))
        scored = counts.filter(F.col("all") >= LEAST_SEEDS).select("pattern", "all", kinds.alias("k"))
        scored = scored.select("pattern", F.col("k.kind").alias("kind"), F.col("k.n").alias("n"), (F.col("k.n") / F.col("all")).alias("confidence"))
        good = table(scored.filter((F.col("n") >= LEAST_SEEDS) & (F.col("confidence") >= LEAST_CONFIDENCE)), "pii-patterns")
        unseen = edges.filter("kind IS NULL OR kind = 'secret'").withColumnRenamed("kind", "seed").join(good.hint("merge"), "pattern")
        least = F.create_map(*(F.lit(x) for p in LEAST_DIGITS.items() for x in p))[F.col("kind")]
        unseen = unseen.filter((F.col("digits") >= least) & ((F.col("kind") != "email") | F.col("at")) & ((F.col("kind") != "secret") | F.col("dense")))
        unseen = unseen.filter(F.col("seed").isNull() | (F.col("seed") == F.col("kind")))
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))
        votes = unseen.groupBy("v", "kind").agg((1 - doubt).alias("score")).filter(F.col("score") >= LEAST_SCORE)
        new = votes.groupBy("v").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
        if known is not None:
            new = new.join(known.hint("merge"), "v", "left_anti")
        new = table(new, "pii-new")
        drop(good)
        if known is None:
            known = new
        elif not new.isEmpty():
            both = table(known.unionByName(new), "pii-known")
            drop(known, new)
            known = both
            continue
        else:
            drop(new)
            break
        if new.isEmpty():
            break
    drop(edges)
    return known


def find(docs: DataFrame) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, th (its text's hash), base and spans (arrays of s, e, kind)."""
    rows = table(units(docs.select("doc_id", "text")), "pii-units")
    known = _bootstrap(rows)
    free = rows.select("doc_id", "th", F.explode("units").alias("u")).filter("u.kind = ''").select("doc_id", "th", "u.s", "u.e", F.sha2("u.value", 256).alias("v"))
    added = free.join(known.hint("merge"), "v").groupBy("doc_id", "th").agg(F.collect_set(F.struct("s", "e", "kind")).alias("more"))
    plain = F.transform("base", lambda b: F.struct(b["s"].alias("s"), b["e"].alias("e"), b["kind"].alias("kind")))
    lean = rows.select("doc_id", "th", plain.alias("base"))
    a, b = lean.alias("a"), added.alias("b")
    joined = a.join(b.hint("merge"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.th") == F.col("b.th")), "left")
    order = lambda x, y: F.when(x["s"] != y["s"], x["s"] - y["s"]).otherwise(_rank(x["kind"]) - _rank(y["kind"]))
    first = lambda x, y: F.when(x["s"] != y["s"], x["s"] - y["s"]).otherwise(y["e"] - x["e"])
    last = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1))["e"], F.lit(-1))
    apart = F.aggregate(F.array_sort("b.more", first), F.array().cast("array<struct<s:int,e:int,kind:string>>"), lambda acc, x: F.when(x["s"] < last(acc), acc).otherwise(F.concat(acc, F.array(x))))
    spans = F.when(F.col("b.more").isNull(), F.col("a.base")).otherwise(F.array_sort(F.concat("a.base", apart), order))
    return joined.select("a.doc_id", "a.th", "a.base", spans.alias("spans"))


def mask(docs: DataFrame) -> DataFrame:
    """`docs` with every span of its texts replaced by its kind in angle brackets, all other columns as they are."""
    id_, th, s, of_id, of_th = (fresh(docs, c) for c in ("_id", "_th", "_spans", "_of_id", "_of_th"))
    spans = find(docs).filter(F.size("spans") > 0).select(F.col("doc_id").alias(of_id), F.col("th").alias(of_th), F.col("spans").alias(s)).dropDuplicates([of_id, of_th])
    keyed = docs.withColumns({id_: F.col("doc_id"), th: F.xxhash64("text")})
    joined = keyed.join(spans.hint("merge"), F.col(id_).eqNullSafe(F.col(of_id)) & (F.col(th) == F.col(of_th)), "left")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        kept = F.substring(F.col("text"), acc["at"] + 1, x["s"] - acc["at"])
        return F.when(x["s"] < acc["at"], acc).otherwise(F.struct(x["e"].alias("at"), F.concat(acc["out"], kept, F.lit("<"), x["kind"], F.lit(">")).alias("out")))

    masked = F.aggregate(F.col(s), zero, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return joined.select(*(F.when(F.col(s).isNull(), F.col("text")).otherwise(masked).alias("text") if c == "text" else F.col(c) for c in docs.columns))


def op8(spark, sf_dir: str) -> DataFrame:
    """Query: personal data in all documents."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
