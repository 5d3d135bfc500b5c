"""Reference resolution, scalar text functions and text lint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tables import written

# Identifier formats, lint patterns, known extensions and prefixes.
ARXIV = "([0-9]{4}\\.[0-9]{4,5}|(?<![a-z-])[a-z-]++(?:\\.[a-z]{2})?/[0-9]{7})"
DOI = "10\\.[0-9]+/\\S+"
ABSOLUTE = "(?:^|[\\s(`\"'])((?:/Users/|/home/|/tmp/|/private/tmp/|/var/folders/|~/|C:\\\\)[\\w./\\\\~-]+)"
EXTERNAL = "(?i)https?://|github\\.com|gitlab\\.com|zenodo|doi\\.org|arxiv\\.org/abs|upstream repo|authors'? (?:own )?(?:published )?(?:repo|artifact)"
SESSION = "(?i)claude\\.ai/code/session[_/]|chatgpt\\.com/c/"
SCAFFOLDING = {
    "draft footer": "(?i)edit before requesting review",
    "HTML comment": "<!--",
    "unticked box": "(?m)^\\s*[-*]\\s*\\[ \\]",
    "placeholder": "\\b(?:TODO|FIXME|TBD)\\b",
}
BACKTICKED = "`([^`\\n]+)`"
SLASHED = "(?<![\\w/`])((?:\\.{0,2}/)?[\\w.-]+(?:/[\\w.-]+)+)"
PARAMETERS = "\\[\\[\\s*([0-9]+)\\s*,\\s*([0-9]+)\\s*,\\s*([0-9]+)\\s*\\]\\]"
EXTENSIONS = ["py", "json", "md", "npz", "npy", "txt", "csv", "tex", "yml", "yaml", "ipynb", "sh", "lean", "log", "pkl"]
IGNORED = ["research/candidates/", "research/out/", "research/runs/", "build/", ".venv/", "__pycache__"]


def arxiv_id(text: Column) -> Column:
    """First new or old arXiv identifier of a text, null without one."""
    return F.nullif(F.regexp_extract(F.lower(text), ARXIV, 1), F.lit(""))


def surnames(authors: Column) -> Column:
    """Lower-case surnames of `Last, First and First Last` lists."""
    people = F.filter(F.transform(F.split(F.coalesce(authors, F.lit("")), " and "), lambda p: F.trim(p)), lambda p: p != "")
    last = lambda p: F.when(F.contains(p, F.lit(",")), F.trim(F.get(F.split(p, ","), F.lit(0)))).otherwise(F.element_at(F.split(p, "\\s+"), -1))
    return F.filter(F.transform(people, lambda p: F.lower(last(p))), lambda s: s != "")


def resolve(cites: DataFrame, refs: DataFrame, text: str = "cite") -> DataFrame:
    """(cite, ref): cited entry of each distinct text, or null.

    First the first entry in file order whose identifier is the text's or whose DOI the text contains; a text with
    an identifier but without such an entry has none; otherwise the first entry whose surnames cover all of the
    text's words of three or more letters. refs: (ref, seq, eprint, doi, author).

    A text contains a DOI if that is a beginning of one of its runs that look like DOIs. Only beginnings as long as
    some known DOI are looked up, so a run costs as many as there are such lengths, however long it is."""
    c = written(cites.select(text).distinct().withColumns({"_low": F.lower(text), "_id": arxiv_id(F.col(text))}), "cites")
    ids = refs.filter("eprint <> ''").groupBy(F.trim("eprint").alias("_id")).agg(F.min(F.struct("seq", "ref")).alias("_entry"))
    by_id = c.filter("_id IS NOT NULL").join(ids.hint("merge"), "_id").select(text, "_entry")
    dois = written(refs.filter(F.lower("doi").rlike(DOI + "$")).groupBy(F.lower("doi").alias("_doi")).agg(F.min(F.struct("seq", "ref")).alias("_entry")), "dois")
    lengths = dois.agg(F.array_sort(F.collect_set(F.length("_doi"))).alias("_lengths"))  # one row with the few lengths there are
    runs = c.select(text, F.explode(F.array_distinct(F.regexp_extract_all("_low", F.lit(DOI), F.lit(0)))).alias("_run")).crossJoin(F.broadcast(lengths))
    fit = F.filter("_lengths", lambda n: n <= F.length("_run"))
    starts = written(runs.select(text, F.explode(F.transform(fit, lambda n: F.substring("_run", F.lit(1), n))).alias("_doi")), "doi-starts")
    by_doi = starts.join(dois.hint("merge"), "_doi").select(text, "_entry")
    first = by_id.union(by_doi).groupBy(text).agg(F.min("_entry").alias("_direct"))
    tokens = F.filter(F.split("_low", "[,\\s]+"), lambda t: F.length(t) > 2)
    words = c.filter("_id IS NULL").withColumn("_tokens", tokens).filter("size(_tokens) > 0")
    people = refs.select("ref", "seq", surnames(F.col("author")).alias("_names")).filter("size(_names) > 0")
    covered = F.size(F.array_except("_tokens", "_names")) == 0
    lead = written(people.select("ref", "seq", "_names", F.explode(F.array_distinct("_names")).alias("_one")), "surnames")
    by_name = words.withColumn("_one", F.get("_tokens", F.lit(0))).join(lead.hint("merge"), "_one").filter(covered).groupBy(text).agg(F.min(F.struct("seq", "ref")).alias("_named"))
    joined = c.join(first.hint("merge"), text, "left").join(by_name.hint("merge"), text, "left")
    return joined.select(text, F.coalesce("_direct.ref", "_named.ref").alias("ref"))


def citations(citing: DataFrame, resolved: DataFrame, text: str = "cite", key: str = "key") -> DataFrame:
    """(ref, key, n): the `n` distinct citing keys of each entry, one row each."""
    pairs = citing.join(resolved.filter("ref IS NOT NULL").hint("merge"), text).select("ref", key).distinct()
    return pairs.join(pairs.groupBy("ref").agg(F.count("*").alias("n")).hint("merge"), "ref")


def best_url(doi: Column, eprint: Column, url: Column, free: Column) -> Column:
    """A real DOI, else the arXiv page, else the arXiv DOI, else the url, else a URL in free text, else null."""
    some = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    own = F.when(~F.lower(some(doi)).startswith("10.48550/arxiv"), some(doi))
    page = lambda base, c: F.concat(F.lit(base), c)
    return F.coalesce(page("https://doi.org/", own), page("https://arxiv.org/abs/", some(eprint)), page("https://doi.org/", some(doi)), some(url), F.nullif(F.regexp_extract(F.coalesce(free, F.lit("")), "https?://[^\\s}]+", 0), F.lit("")))


def log_union(notes: DataFrame, fieldnotes: DataFrame) -> DataFrame:
    """Both kinds of notes in one shape (date, kind, title, author, model, body), newest first."""
    shape = ["date", "kind", "title", "author", "model", "body"]
    both = notes.withColumn("kind", F.lit("submission note")).select(*shape).unionByName(fieldnotes.withColumn("kind", F.lit("fieldnote")).select(*shape))
    return both.orderBy(F.desc("date"))


def compact_authors(authors: Column) -> Column:
    """All names if there is one or all are handles, else the first surname et al."""
    full = F.array_join(authors, " and ")
    first = F.trim(F.get(F.split(F.get(authors, F.lit(0)), ","), F.lit(0)))
    return F.when((F.size(authors) == 1) | F.forall(authors, lambda a: F.trim(a).startswith("@")), full).otherwise(F.concat(first, F.lit(" et al.")))


def compact_models(parts: Column) -> Column:
    """The one name, or the first and how many more."""
    more = F.concat(F.get(parts, F.lit(0)), F.lit(" +"), (F.size(parts) - 1).cast("string"))
    return F.when(F.size(parts) == 0, F.lit("")).when(F.size(parts) == 1, F.get(parts, F.lit(0))).otherwise(more)


def powers(text: Column) -> Column:
    """x**3 and x^-2 with the exponent in superscript tags."""
    return F.regexp_replace(text, "(?:\\*\\*|\\^)(-?[0-9]+)", "<sup>$1</sup>")


def compact_integer(value: Column) -> Column:
    """Below 10,000 as it is, else m x 10^e with one decimal place, without a factor of 1."""
    e = F.length(value.cast("string")) - 1
    m = F.regexp_replace(F.format_string("%.1f", F.bround(value / F.pow(F.lit(10.0), e), 1)), "\\.0$", "")
    power = F.concat(F.lit("10^"), e.cast("string"))
    return F.when(value < 10_000, value.cast("string")).when(m == "1", power).otherwise(F.concat(m, F.lit("x"), power))


def safe_url(url: Column) -> Column:
    """No control character, no leading // and no backslash; a scheme must be http or https and have a host."""
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    clean = (url != "") & ~url.rlike("[\\x00-\\x1f\\x7f]") & ~url.startswith("//") & ~F.contains(url, F.lit("\\"))
    return F.coalesce(clean & ((scheme == "") | (scheme.isin("http", "https") & url.rlike("^[A-Za-z]+://[^/?#]+"))), F.lit(False))


def html_safe_json(value: Column) -> Column:
    """JSON text that cannot end an HTML element."""
    out = F.to_json(value)
    for raw, safe in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e"), ("\u2028", "\\u2028"), ("\u2029", "\\u2029")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def descriptor(construction: Column, family: Column) -> Column:
    """Short tag: the head of the construction if it has 1 to 60 characters, else the family, else nothing."""
    head = F.btrim(F.get(F.split(F.get(F.split(F.trim(F.coalesce(construction, F.lit(""))), "\\("), F.lit(0)), ";"), F.lit(0)), F.lit(" ,."))
    return F.when(F.length(head).between(1, 60), head).when(F.coalesce(family, F.lit("")) != "", F.concat(family, F.lit(" code"))).otherwise(F.lit(""))


def title(n: Column, k: Column, d: Column, tag: Column) -> Column:
    """Title of a change that adds a row."""
    return F.rtrim(F.concat(F.lit("Add [["), F.concat_ws(",", n.cast("string"), k.cast("string"), d.cast("string")), F.lit("]] "), tag))


def complete_id(cite: Column) -> Column:
    """Whether a citation is `arXiv:` and a whole identifier, with or without a version."""
    return cite.rlike("(?i)^arxiv:\\s*(?:[0-9]{4}\\.[0-9]{4,5}|[a-z-]+(?:\\.[a-z]{2})?/[0-9]{7})(?:v[0-9]+)?\\s*$")


def lint_absolute(docs: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """(label, why, detail): absolute local paths."""
    found = F.explode(F.regexp_extract_all(F.col(text), F.lit(ABSOLUTE), F.lit(1)))
    return docs.select(label, F.lit("absolute local path").alias("why"), found.alias("detail")).distinct()


def lint_session(docs: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Links to private sessions."""
    return docs.filter(F.col(text).rlike(SESSION)).select(label, F.lit("session URL").alias("why"), F.lit("links a private session").alias("detail")).distinct()


def lint_scaffolding(docs: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """Leftovers of the template."""
    found = F.array_compact(F.array(*(F.when(F.col(text).rlike(p), F.lit(why)) for why, p in SCAFFOLDING.items())))
    return docs.select(label, F.lit("leftover scaffolding").alias("why"), F.explode(found).alias("detail")).distinct()


def tokens(text: Column) -> Column:
    """Distinct backticked spans and slash-separated words, trimmed of punctuation."""
    both = F.concat(F.regexp_extract_all(text, F.lit(BACKTICKED), F.lit(1)), F.regexp_extract_all(F.regexp_replace(text, BACKTICKED, " "), F.lit(SLASHED), F.lit(1)))
    trimmed = F.transform(both, lambda t: F.ltrim(F.rtrim(F.trim(t), F.lit(".,;:)`")), F.lit("(")))
    return F.array_distinct(F.filter(trimmed, lambda t: t != ""))


def pathlike(token: Column, prefixes: list[str]) -> Column:
    """Whether a token claims to be a path of this tree: under a known prefix, or with a slash and a known ending."""
    bare = F.ltrim(token, F.lit("./"))
    other = F.contains(token, F.lit(" ")) | token.rlike("^(?:http|www\\.|@|#)|^(?:quant-ph|math|cs|cond-mat|physics)/|[<>*]")
    known = F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.startswith(bare, p)) if prefixes else F.lit(False)
    return ~other & (known | (F.contains(bare, F.lit("/")) & bare.rlike("\\.(?:" + "|".join(EXTENSIONS) + ")$")))


def without_external(docs: DataFrame, text: str = "text") -> DataFrame:
    """Texts that name no place outside this tree; those that do may cite paths that lie there. Null texts go."""
    return docs.filter(~F.col(text).rlike(EXTERNAL))


def unresolved(paths: DataFrame, listing: DataFrame, keys: list[str], token: str = "token") -> DataFrame:
    """(keys..., token) of tokens without a file: as they are, before `::`, the module's head with or without .py, or
    any file of that stem. listing: (path)."""
    bare = F.rtrim(F.ltrim(F.col(token), F.lit("./")), F.lit("/"))
    before = F.get(F.split(bare, "::"), F.lit(0))
    head = F.regexp_replace(bare, "\\.[^.]*$", "")
    named = bare.rlike("\\.(?:" + "|".join(EXTENSIONS) + ")$")
    forms = F.concat(F.array(bare, before), F.when(named, F.array().cast("array<string>")).otherwise(F.array(head, F.concat(head, F.lit(".py")), F.concat(bare, F.lit(".py")))))
    wanted = paths.select(*keys, token, F.explode(F.array_distinct(forms)).alias("_form"))
    exact = listing.select(F.col("path").alias("_form"))
    stems = listing.select(F.regexp_replace("path", "\\.[^./]*$", "").alias("_form"))
    found = wanted.join(exact.union(stems).distinct(), "_form", "left_semi").select(*keys, token).distinct()
    return paths.select(*keys, token).distinct().join(found, [*keys, token], "left_anti")


def ignored_citation(token: Column) -> Column:
    """Whether a token lies under a prefix that is never committed."""
    return F.exists(F.array(*map(F.lit, IGNORED)), lambda p: F.contains(F.ltrim(token, F.lit("./")), p))


def header_mismatch(docs: DataFrame, text: str = "text", label: str = "label") -> DataFrame:
    """(label, why, detail): the first [[n,k,d]] of a text against the n-k-d of its label."""
    key = F.regexp_extract(label, "([0-9]+-[0-9]+-[0-9]+)(?:\\.[a-z]+)?$", 1)
    own = F.concat_ws("-", *(F.regexp_extract(text, PARAMETERS, i) for i in (1, 2, 3)))
    why = F.when(own == "--", F.lit("no header")).when(own != key, F.lit("header disagrees"))
    return docs.filter(key != "").select(label, why.alias("why"), F.concat_ws(" vs ", F.when(own != "--", own), key).alias("detail")).filter("why IS NOT NULL")


def problems(found: DataFrame, docs: DataFrame, exempt: DataFrame, label: str = "label") -> DataFrame:
    """(label, ok, n_problems): distinct problems per document, exempt ones without any."""
    counted = found.distinct().join(exempt, label, "left_anti").groupBy(label).agg(F.count("*").alias("n_problems"))
    out = docs.select(label).distinct().join(counted, label, "left").withColumn("n_problems", F.coalesce("n_problems", F.lit(0)))
    return out.select(label, (F.col("n_problems") == 0).alias("ok"), "n_problems")


def marker_audit(pages: DataFrame, marker: str, text: str = "html") -> DataFrame:
    """Pages in which a marker does not occur exactly once, with how often it does."""
    import re

    return pages.withColumn("times", F.regexp_count(text, F.lit(re.escape(marker))).cast("long")).filter("times <> 1")


def key_numbers(name: Column) -> list[Column]:
    """n, k and d of an n-k-d name, null if it is none."""
    return [F.nullif(F.regexp_extract(name, "^([0-9]+)-([0-9]+)-([0-9]+)$", i), F.lit("")).cast("long").alias(c) for i, c in ((1, "n"), (2, "k"), (3, "d"))]


def truncated(text: Column, most: int = 10_240) -> Column:
    """Text cut to `most` bytes of UTF-8 without splitting a character: of the next byte and the cut, trailing
    continuation bytes and their lead byte go if the character does not end at the cut."""
    raw = F.hex(F.encode(text, "UTF-8"))
    kept = F.substring(raw, 1, 2 * most)
    split = F.substring(raw, 2 * most + 1, 2).rlike("^[89AB]")
    whole = F.regexp_replace(kept, "[C-F][0-9A-F](?:[89AB][0-9A-F]){0,2}$", "")
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.unhex(F.when(split, whole).otherwise(kept)), "UTF-8"))


def newest_first_rank(df: DataFrame, date: str, key: str) -> DataFrame:
    """Rows numbered by descending date inside each month, so that no task numbers the whole log."""
    return df.withColumn("place", F.row_number().over(W.partitionBy(F.substring(date, 1, 7)).orderBy(F.desc(date), F.desc(key))))
