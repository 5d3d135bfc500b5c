"""Language scores in plain Python, contexts of personal data at every offset, and the pipeline's tables and odd inputs."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from claimboard.functions.tables import tables_made, written_paths
from claimboard.llm import langid, mixing, pii

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("shift", [-60, -9, 0, 7, 60])
def test_contexts_reach_over_segments(spark, shift):
    """A number without a seed's shape is found wherever a segment of the long text happens to end."""
    rng = random.Random(1)
    seeds = [(i, f"call me on +1 555 {rng.randint(100, 999)} {rng.randint(1000, 9999)} please") for i in range(20)]
    filler = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(2000))
    rows, at = list(seeds), {}
    for k in range(3900 + shift * 2, 4100 + shift * 2, 13):
        lead = filler[:k].rstrip() + " word "
        text = lead + "call me on 555 321 9876 please " + filler[:900]
        at[100_000 + k] = lead
        rows.append((100_000 + k, text))
    found = {r["doc_id"]: [(x["s"], x["e"], x["kind"]) for x in r["spans"]] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, lead in at.items():
        s = len(lead) + len("call me on ")
        assert (s, s + len("555 321 9876"), "phone") in found[i], i


def test_discovery_has_no_last_round(spark):
    """Each pattern is known only once the one before it has given it seeds, for more rounds than any fixed number."""
    rng = random.Random(2)
    number = lambda: f"{rng.randint(200, 999)} {rng.randint(100, 999)} {rng.randint(1000, 9999)}"
    words = [a + b for a in "abcdefghijkl" for b in "mnopqrstuv"]
    rows, values = [], [f"+1 {number()}" for _ in range(16)]
    for step in range(24):  # four of five values must be known before a pattern counts, so the four before must have been found
        lead = f"{words[2 * step]} {words[2 * step + 1]}"
        values += [number() for _ in range(4)]
        rows += [f"x {lead} {v} end{step}" for v in values[-20:]]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    missing = [r["doc_id"] for r in pii.find(df).collect() if not any(x["kind"] == "phone" for x in r["spans"])]
    assert not missing


def test_pipeline_rows_of_other_calls_stay(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a = pipeline.quality_rules(spark, docs.filter("doc_id % 2 = 0"), sf)
    b = pipeline.quality_rules(spark, docs.filter("doc_id % 2 = 1"), sf)
    first, second = pipeline.run(spark, sf), pipeline.run(spark, sf)
    assert a.count() > 0 and b.count() > 0
    assert sorted(first.collect()) == sorted(second.collect()) and first.count() > 0


def test_pipeline_takes_odd_tables(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    good = spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()
    rows = [tuple(r)[:5] for r in good] + [(None, None, None, None, None), (None, "", None, None, 0), (7, None, "en", "s", 0), tuple(good[0])[:5], tuple(good[0])[:5]]
    odd = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("_quality", "_held", "_copy", "_doc", "h", "sk", "size", "row", "taken", "kept", "copies")})
    for docs in (odd, odd.filter("false")):
        whole = docs.count()
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, sf)
            assert name == "token-ID output" or out.columns == odd.columns, name
            docs = out
        assert docs.columns[:4] == ["doc_id", "start", "n_tokens", "ids_crc32"]
        assert (docs.count() > 0) == (whole > 0)


def language_by_hand(rows, text):
    """Word-first backoff from the raw rows, where all documents are learned from and all words and grams are kept."""
    letters = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    grams = lambda w, n: [(f"^{w}$" if n > 1 else w)[i : i + n] for i in range(len(f"^{w}$" if n > 1 else w) - n + 1)]
    counts, docs = [defaultdict(Counter) for _ in range(5)], Counter()
    for i, t, lang in rows:
        if lang is None or i is None or t is None:
            continue
        docs[lang] += 1
        for w in letters(t):
            counts[0][w][lang] += 1
            for n in range(1, 5):
                for g in grams(w, n):
                    counts[n][g][lang] += 1
    langs = sorted(docs)
    if not letters(text) or not langs:
        return "und", 0.0
    totals = [{k: sum(c[k] + 0.5 for c in kind.values()) + 0.5 for k in langs} for kind in counts]
    log = lambda n, g, k: math.log((counts[n][g][k] + 0.5) / totals[n][k])
    sums = {k: math.log(docs[k] / sum(docs.values())) for k in langs}
    for w in letters(text):
        if w in counts[0]:
            for k in langs:
                sums[k] += log(0, w, k)
            continue
        for n in (4, 3, 2, 1):
            known = [g for g in grams(w, n) if g in counts[n]]
            if known:
                for k in langs:
                    sums[k] += sum(log(n, g, k) for g in known) / len(known)
                break
    best = max(sums.values())
    return next(k for k in langs if sums[k] == best), 1 / sum(math.exp(v - best) for v in sums.values())


def test_languages_and_scores_equal_plain_python(spark):
    """Training rows, texts of unseen words, ties, nulls and texts without letters, beside columns with clashing names."""
    rng = random.Random(4)
    letters = {"aa": "abcdé", "bb": "cdefñ", "cc": "xyz"}
    word = lambda k: "".join(rng.choice(letters[k]) for _ in range(rng.randint(1, 6)))
    vocabulary = {k: [word(k) for _ in range(30)] for k in letters}
    rows = [(i, " ".join(rng.choice(vocabulary[k] + [word(k)]) for _ in range(rng.randint(1, 25))), rng.choice([k, k, k, None])) for i in range(90) for k in [rng.choice("ab") * 2, ]]
    rows += [(200, "xyz zyx", "cc"), (201, None, "aa"), (None, "abc", "aa"), (202, "12 -- !", "bb"), (203, "", None)]
    tests = [(300 + i, word(rng.choice(list(letters))) + " " + word("aa"), None) for i in range(60)]
    tests += [(400, "qqqq", None), (401, "É É", None), (402, "c d", None), (403, None, None), (None, "xyz", None), (404, "abcd " * 4000, None)]
    docs = spark.createDataFrame(rows + tests, "doc_id long, text string, lang string")
    clash = docs.withColumns({c: F.lit("x") for c in ("kind", "gram", "n", "words", "rank", "held_out", "score")}).repartition(3)
    model = langid.learn(clash.filter("doc_id IS NULL OR doc_id < 300"))
    got = sorted(((r["doc_id"], r["lang_pred"], r["score"]) for r in langid.predict(clash, model).collect()), key=str)
    want = sorted(((i, *language_by_hand(rows, t)) for i, t, _ in rows + tests), key=str)
    assert len(got) == len(want)
    by_id = defaultdict(list)
    for i, k, s in want:
        by_id[i].append((k, s))
    for i, k, s in got:
        assert any(k == wk and s == pytest.approx(ws, abs=1e-4) for wk, ws in by_id[i]), (i, k, s, by_id[i])


def test_the_mix_writes_no_texts_and_shares_what_it_takes_of_rows_alike(spark):
    """Rows alike in all columns, others alike but for a null, and rows whose copies do not divide evenly."""
    rows = [(7, "one row many times over", "en", "s1", 0)] * 31 + [(7, "one row many times over", None, "s1", 0)] * 4
    rows += [(100 + k, "a few words of the last source " * 3, "en", "s2", k) for k in range(9)]
    df = spark.createDataFrame(rows, SCHEMA)
    with tables_made() as made:
        kept = mixing.keep_mixed(df)
    assert made and all("text" not in spark.read.parquet(p).columns and not any("struct" in kind for _, kind in spark.read.parquet(p).dtypes) for p in written_paths() if p in made)
    want = {r["doc_id"]: r["n"] for r in mixing.mix(df).groupBy("doc_id").agg(F.sum("copies").alias("n")).collect() if r["n"]}
    got = Counter(kept.collect())
    assert Counter(r["doc_id"] for r in got.elements()) == want
    assert {tuple(r) for r in got} <= set(rows) and all(n <= 2 * rows.count(tuple(r)) for r, n in got.items())
