"""Training-data operators against plain Python, with nulls, empty and long texts, ties, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from claimboard.llm import decontam, encoding, langid, linededup, mixing, ngram_jaccard, pii, quality, queries, tokenbin, tokencount, toxicity
from claimboard.llm.common import prefix_sums

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as extra columns of the input.
CLASHES = ["_quality", "_lk", "kept", "q", "size", "taken", "h", "sk", "_doc", "node", "words", "spans", "_salt", "_row", "copies"]


def word(rng):
    return "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    texts = [" ".join(word(rng) for _ in range(rng.randint(1, 120))) for _ in range(n)]
    base = " ".join(word(rng) for _ in range(150)).split()
    for k in range(12):
        copy = list(base)
        for _ in range(k % 4):
            copy[rng.randrange(len(copy))] = word(rng)
        texts.append(" ".join(copy))
    texts += [texts[0], texts[0], "", None, " \n\t ", "One", "one", "a b c d", "A  b\nc d", "x " * 30000, "Line one is here now\nLine two is here now\nline ONE is here now\nLine one was here now\nLine one is here"]
    return [(i, t, ["en", "de", None][i % 3], ["s0", "s0", "s1", None][i % 4], len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASHES}).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split_words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w]


# ---- operator 1


def test_quality_counts(docs):
    got = {r["doc_id"]: r for r in quality.score(docs).collect()}
    for i, t, *_ in corpus():
        ws, r = split_words(t), got[i]
        grams = [tuple(ws[k : k + 3]) for k in range(len(ws) - 2)]
        hit = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)} if len(ws) < 1000 else set(range(len(ws)))
        lines = [x for x in (t or "").split("\n") if split_words(x)]
        want = (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in "".join(ws)), len(lines) - len(set(lines)), len(hit))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(ws) < 50 or 100 * len(hit) > 50 * len(ws)) and (not r["kept"] or not r["base_failed"])


def test_quality_threshold_drops_outliers(spark):
    rng = random.Random(2)
    plain = [" ".join(word(rng) for _ in range(60)) for _ in range(150)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(plain)] + [(999, " ".join(word(rng) + "***" for _ in range(60)), "en", "s", 0)]
    kept = {r["doc_id"] for r in quality.keep_good(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert 999 not in kept and len(kept) >= 148


# ---- operator 2


def mix_by_hand(rows):
    size = {i: len(split_words(t)) for i, t, *_ in rows}
    key = lambda s: (s is None, s or "")
    sources = sorted({r[3] for r in rows}, key=key)
    total = {s: sum(size[r[0]] for r in rows if r[3] == s) for s in sources}
    weight = {s: [3, 1, 2][k % 3] for k, s in enumerate(sources)}
    aim, open_, left = {}, set(sources), 1.5 * sum(total.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * total[s]]
        if not over:
            aim |= share
            break
        for s in over:
            aim[s] = 2.0 * total[s]
            left -= aim[s]
            open_.discard(s)
    return size, total, aim


def test_mix_targets_and_takes(docs):
    rows = corpus()
    size, total, aim = mix_by_hand(rows)
    got = mixing.mix(docs).collect()
    by = {r[0]: r[3] for r in rows}
    taken = {}
    for r in got:
        s = by[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == total[s] and abs(r["target"] - aim[s]) < 1e-6 and r["taken"] <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    for s in total:
        assert abs(taken[s] - aim[s]) <= max(size[r[0]] for r in rows if r[3] == s)
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got}
    kept = mixing.keep_mixed(docs)
    assert kept.columns == docs.columns
    counts = {r["doc_id"]: r["count"] for r in kept.groupBy("doc_id").count().collect()}
    assert counts == {r["doc_id"]: r["taken"] // r["size"] for r in got if r["taken"]}


def test_mix_over_many_ranges(spark, monkeypatch):
    rows = corpus(n=300)
    df = spark.createDataFrame(rows, SCHEMA)
    whole = {r["doc_id"]: r["taken"] for r in mixing.mix(df).collect()}
    monkeypatch.setattr(mixing, "RANGE_ROWS", 5)
    assert {r["doc_id"]: r["taken"] for r in mixing.mix(df).collect()} == whole


def test_mix_keeps_rows_without_ids_and_repeated_rows(spark):
    rows = [(None, f"{k} words without an id", "en", "s0", 0) for k in range(9)] + [(7, "one row many times over", "en", "s1", 0)] * 30
    rows += [(100 + k, "a few words of the last source", "en", "s2", k) for k in range(9)]
    df = spark.createDataFrame(rows, SCHEMA)
    placed = mixing.mix(df).groupBy("source_size", "doc_id").agg(F.sum("copies").alias("n"), F.count_distinct("copies").alias("kinds")).collect()
    want = {(r["source_size"], r["doc_id"]): r["n"] for r in placed if r["n"]}
    # the cut falls among the repeated rows, and rows without id are taken
    assert next(r["kinds"] for r in placed if r["doc_id"] == 7) > 1 and any(i is None for _, i in want)
    kept = mixing.keep_mixed(df).collect()
    size = {s: sum(len(split_words(r[1])) for r in rows if r[3] == s) for s in ("s0", "s1", "s2")}
    got = {}
    for r in kept:
        got[size[r["source"]], r["doc_id"]] = got.get((size[r["source"]], r["doc_id"]), 0) + 1
    assert got == want and {r["text"] for r in kept} <= {r[1] for r in rows}


def test_prefix_sums(spark):
    rows = [(g, b, (7 * b + 1) % 5) for g in "ab" for b in range(50)]
    df = spark.createDataFrame(rows, "g string, block long, n long")
    got = {(r["g"], r["block"]): r["before"] for r in prefix_sums(df, ["g"], "block", {"before": "n"}, chunk=8).collect()}
    assert all(v == sum(n for g, b, n in rows if (g, b) < k and g == k[0]) for k, v in got.items())


# ---- operator 3


def test_language_is_learned_and_held_out(spark):
    rng = random.Random(4)
    vocab = {"aa": ["stra", "kolo", "prus", "vik"], "bb": ["ment", "tion", "oux", "elle"]}
    rows = [(i, " ".join("".join(rng.choice(vocab[k]) for _ in range(rng.randint(1, 3))) for _ in range(20)), k, "s", 0) for i in range(300) for k in ["aa" if i % 2 else "bb"]]
    rows += [(1000, None, "aa", "s", 0), (1001, "123 !!", "aa", "s", 0), (1002, "日本語", None, "s", 0), (None, "strakolo", "bb", "s", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = langid.predict(df, langid.learn(df.filter(langid.fold(F.col("doc_id"), 5) != 0))).collect()
    got = {r["doc_id"]: r for r in out}
    held = [r for r in out if r["held_out"]]
    assert len(out) == len(rows) and held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out if r["doc_id"] is not None)
    assert all(got[i]["lang_pred"] == k for i, _, k, *_ in rows[:300])
    assert got[1000]["lang_pred"] == got[1001]["lang_pred"] == "und" and got[1002]["lang_pred"] in ("aa", "bb") and got[None]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in out)


def test_backoff_goes_to_shorter_grams():
    import numpy as np

    table = lambda **rows: (list(rows), np.array(list(rows.values())).reshape(-1, 2))
    model = {"langs": ["a", "b"], "prior": [0.0, 0.0], "tables": [table(), table(z=[-1.0, -9.0]), table(), table(), table(**{"^xyz": [-9.0, -1.0]})]}
    scorer = langid.Scorer(model)
    assert scorer.predict("xyzz")[0] == "b" and scorer.predict("zzzz")[0] == "a"


# ---- operators 4 and 10


def library_ids(texts, plain=False):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(encoding.vocabulary_path())
    tok.encode_special_tokens = plain
    return [tok.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_pieces_encode_like_whole_texts():
    rng = random.Random(6)
    parts = [*"ab  \n\t.,'’é1²½_*", "'s", "<|endoftext|>", "日本", "word ", "Ünder "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(800)] + ["", " ", " a", "a ", "\n"]
    got = [list(memoryview(x).cast("H")) for x in encoding.encoder().texts(texts)]
    assert got == library_ids(texts)


def test_token_counts_across_blocks(docs, spark, monkeypatch):
    monkeypatch.setattr(tokencount, "BLOCK_IDS", 16)
    monkeypatch.setattr(tokencount, "CHUNK_BLOCKS", 3)
    blocks, held = tokencount.write_flat(docs)
    found = {(r["file"], r["ordinal"]): (r["n_tokens"], r["complete"]) for r in tokencount.scan(blocks, kind="<u2").collect()}
    assert held.count() == len(found) and blocks.columns == ["file", "block", "ids"]
    got = {r["doc_id"]: found[r["file"], r["ordinal"]] for r in held.collect()}
    rows = corpus()
    assert got == {r[0]: (len(ids), True) for r, ids in zip(rows, library_ids([r[1] for r in rows], True))}


def test_flat_files_without_a_last_separator(spark, tmp_path):
    import numpy as np

    e = tokencount.END_OF_TEXT
    ids = [1, 2, e, e, 3, 4, 5, e, 6, 7]
    np.array(ids, "<u4").tofile(tmp_path / "f.bin")
    (tmp_path / "none.bin").write_bytes(b"")
    rows = tokencount.scan(tokencount.read_flat(spark, str(tmp_path), 3)).orderBy("ordinal").collect()
    with open(tmp_path / "g.bin", "wb") as f:
        f.write(np.array(ids, "<u2").tobytes() + b"\0")
    short = tokencount.scan(tokencount.read_flat(spark, str(tmp_path / "g.bin"), 4, "<u2"), kind="<u2").orderBy("ordinal")
    assert [r["n_tokens"] for r in short.collect()] == [2, 0, 3, 2]
    assert [(r["ordinal"], r["start"], r["n_tokens"], r["complete"]) for r in rows] == [(0, 0, 2, True), (1, 3, 0, True), (2, 4, 3, True), (3, 8, 2, False)]


def test_token_files_round_trip(docs):
    got = {r["doc_id"]: r for r in tokenbin.read_index(tokenbin.write_ids(docs)).collect()}
    at = 0
    for (i, *_), ids in zip(corpus(), library_ids([r[1] for r in corpus()])):
        data = b"".join(x.to_bytes(4, "little") for x in [*ids, 2])
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids) + 1, zlib.crc32(data))
        at += len(ids) + 1


def test_token_queries_over_hard_rows(spark, tmp_path):
    """Every column of op4 and op10 from the library's own ids: nulls, empties, repeats, long texts, clashing names."""
    rows = [(None, "no id here", "x"), (None, None, "x"), (7, "", "x"), (3, "same\nrow", "x"), (3, "same\nrow", "x"), (9, "long text. " * 20000, "x"), (1, "<|endoftext|> a", "x"), (2, " \n ", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, payload string").withColumns({c: F.lit("clash") for c in ("file", "block", "ids", "first", "h", "shard")}).write.parquet(f"{tmp_path}/documents.parquet")
    plain, special = library_ids([r[1] for r in rows], True), library_ids([r[1] for r in rows])
    low = lambda xs: sorted(xs, key=repr)
    got = tokencount.op4(spark, str(tmp_path)).select("doc_id", "n_tokens", "complete").collect()
    assert low(tuple(r) for r in got) == low((r[0], len(i), True) for r, i in zip(rows, plain))
    out = sorted(tokenbin.op10(spark, str(tmp_path)).collect(), key=lambda r: r["start"])
    data = [b"".join(x.to_bytes(4, "little") for x in [*i, 2]) for i in special]
    assert low((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out) == low((r[0], len(d) // 4, zlib.crc32(d)) for r, d in zip(rows, data))
    at = 0
    for r in out:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in out]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


@pytest.mark.parametrize("high", [1, 2, 300, 50257, 2**32 - 1])
def test_blocks_round_trip(high):
    import numpy as np

    rng = np.random.default_rng(0)
    for n in (1, 7, 4095, 4096, 4097, 9000):
        ids = rng.integers(0, high, n, dtype=np.uint64).astype("<u4")
        ids[n // 2] = 2**32 - 1
        assert (tokenbin.unpack_chunk(tokenbin.pack_chunk(ids)) == ids).all()


# ---- operator 5


def test_toxicity_and_neutral_mentions(spark):
    rng = random.Random(8)
    rows, marks = [], []
    for i in range(400):
        bad = i % 2
        ws = [word(rng) for _ in range(30)] + (["vile", "scum"][: 1 + i % 2] if bad else [])
        if rng.random() < (0.5 if bad else 0.05):
            ws.append("muslim")  # the group is named mostly in toxic texts
        rng.shuffle(ws)
        rows.append((i, " ".join(ws), "en", "s", 0))
        marks.append((i, 1, bad))
    df, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    train = labels.filter(langid.fold(F.col("doc_id"), 3) != 1)
    model = toxicity.learn(df, train)
    loose = toxicity.learn(df, train, swap_weight=0.0)
    neutral = "the muslim family went to the market today"
    moved = lambda m: toxicity.score_text(neutral, m) - toxicity.score_text(neutral.replace("muslim", "people"), m)
    assert moved(model) < moved(loose) and toxicity.score_text(neutral, model) < 0.5
    out = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(out[i]["held_out"] for i in held) and sum(out[i]["predicted"] == i % 2 for i in held) > 0.95 * len(held)
    none = toxicity.learn(df, train.filter("toxic = 0"))
    assert toxicity.score_text("vile", none) == 0


def test_counterfactuals_equal_swapped_texts():
    for text in ["the muslim family and a musli bar", "die frauen und die frau", "los judíos y los ateos", "nobody is named", ""]:
        words = toxicity.words_in(text)
        want = []
        for language, groups in toxicity.IDENTITY.items():
            for terms in groups.values():
                for a in [t for t in terms if t in words]:
                    for b in [*terms, toxicity.NEUTRAL[language]]:
                        if b != a:
                            now = toxicity.features_in(" ".join(b if w == a else w for w in text.split()))
                            want.append((sorted(toxicity.features_in(text) - now), sorted(now - toxicity.features_in(text))))
        every = toxicity.features_in(text).union(*(set(b) for _, b in want))
        assert toxicity.swaps(words, every) == sorted(want)
    assert ("musl*" in toxicity.swaps(toxicity.words_in("muslim"), {"musl*"})[0][0]) and not any("musl*" in a for a, _ in toxicity.swaps({"muslim", "musli"}, {"musl*"}))


@pytest.mark.parametrize("term, neutral", [("muslime", "menschen"), ("musulmanes", "personas"), ("musulmans", "personnes")])
def test_group_mentions_in_other_languages_move_scores_less(spark, term, neutral):
    rng = random.Random(9)
    rows, marks = [], []
    for i in range(300):
        bad = i % 2
        ws = [word(rng) for _ in range(20)] + (["vile"] if bad and i % 4 == 1 else []) + ([term] if rng.random() < (0.6 if bad else 0.05) else [])
        rows.append((i, " ".join(ws), "en", "s", 0))
        marks.append((i, 1, bad))
    rows, marks = [*rows, (900, rows[0][1], "en", "s", 0), (None, "vile", None, None, 0), (901, None, None, None, 0)], [*marks, (900, 1, 1), (901, 1, 0)]
    df, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model, loose = toxicity.learn(df, labels), toxicity.learn(df, labels, swap_weight=0.0)
    groups = [g for language in toxicity.IDENTITY.values() for g in language.values()]
    named = sum(len(g) for r in rows[:300] for g in groups for t in g if t in r[1].split())
    assert model["copies"] == loose["copies"] == named > 0
    moved = lambda m: abs(toxicity.score_text(f"x {term} y", m) - toxicity.score_text(f"x {neutral} y", m))
    assert moved(model) < 0.5 * moved(loose)
    again = toxicity.learn(df.repartition(5), labels)
    assert again["index"] == model["index"] and again["weights"] == model["weights"]
    for r in toxicity.score(df.withColumn("toxic", F.lit(1)).withColumn("score", F.lit("x")), model).collect():
        text = {row[0]: row[1] for row in rows}[r["doc_id"]]
        z = model["bias"] + sum(model["weights"][model["index"][f]] for f in toxicity.features_in(text) if f in model["index"])
        assert abs(r["score"] - 1 / (1 + 2.718281828459045 ** -z)) < 1e-9 and r["predicted"] == int(r["score"] >= 0.7)


# ---- operator 6


def sets_of(t):
    ws = [w.decode() for w in (t or "").encode().lower().split()]
    return {tuple(ws[k : k + 5]) for k in range(max(len(ws) - 4, 1))} if ws else set()


def components_by_hand(rows):
    sets = {r[0]: sets_of(r[1]) for r in rows}
    comp = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(comp[a], comp[b])
            changed |= comp[a] != low or comp[b] != low
            comp[a] = comp[b] = low
    return {i: (len(s), comp[i]) for i, s in sets.items()}


def test_jaccard_components(docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.join(docs).collect()}
    assert got == components_by_hand(corpus())
    kept = ngram_jaccard.one_of_each(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {c for _, c in got.values()}


def test_jaccard_of_a_large_chained_group(spark, monkeypatch):
    """Copies that drift apart: neighbours link, far ones do not; list and frequency bounds are forced low."""
    rng = random.Random(9)
    ws, rows = [word(rng) for _ in range(120)], []
    for i in range(60):
        rows.append((i, " ".join(ws), "en", "s", 0))
        ws[(i * 7) % 120] = word(rng) + "x"
    shared = " ".join(word(rng) for _ in range(60))
    rows += [(100 + i, shared + " " + " ".join(word(rng) for _ in range(8)), "en", "s", 0) for i in range(30)]
    rows += [(200 + i, shared + " " + " ".join(word(rng) for _ in range(30)), "en", "s", 0) for i in range(30)]
    want = components_by_hand(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.join(df).collect()} == want
    monkeypatch.setattr(ngram_jaccard, "FREQUENT_LEAST", 10**9)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.join(df).collect()} == want


# ---- operator 7


def within_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    s, l = sorted((a, b), key=len)
    return any(l[:i] + l[i + 1 :] == s for i in range(len(l)))


def test_line_dedup(spark):
    rng = random.Random(10)
    lines = [[word(rng) for _ in range(rng.randint(1, 9))] for _ in range(40)]
    rows = []
    for i in range(60):
        out = []
        for _ in range(rng.randint(0, 6)):
            w = list(rng.choice(lines))
            kind = rng.randint(0, 4)
            if kind == 1 and w:
                w[rng.randrange(len(w))] = word(rng)
            elif kind == 2 and len(w) > 1:
                del w[rng.randrange(len(w))]
            elif kind == 3:
                w.insert(rng.randint(0, len(w)), word(rng))
            out.append((" " if rng.random() < 0.2 else "") + "  ".join(w).upper() if rng.random() < 0.1 else " ".join(w))
        rows.append((i, "\n".join(out), "en", "s", 0))
    rows.append((99, None, "en", "s", 0))
    first = {}
    for i, t, *_ in rows:
        for k, x in enumerate(t.split("\n") if t is not None else []):
            w = tuple(x.lower().split())
            if w:
                first.setdefault(w, (i, k))
    long = [w for w in first if len(w) >= 4]
    gone = {w for w in long if any(first[v] < first[w] and within_one(list(w), list(v)) for v in long)}
    want = {}
    for i, t, *_ in rows:
        for k, x in enumerate(t.split("\n") if t is not None else []):
            w = tuple(x.lower().split())
            want[i, k] = (len(w) > 0 and first[w] != (i, k), w in gone)
    df = spark.createDataFrame(rows, SCHEMA)
    assert {(r["doc_id"], r["line_no"]): (r["exact"], r["near"]) for r in linededup.judge(df).collect()} == want
    texts = {r["doc_id"]: r["text"] for r in linededup.dedup(df).collect()}
    for i, t, *_ in rows:
        assert texts[i] == (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if not any(want[i, k])))


def test_line_dedup_of_short_lines(spark):
    rows = [(1, "Read more\nfirst of all\n\nfoo", "en", "s", 0), (2, "READ  more\nfirst of some\n\n ", "en", "s", 0), (3, "foo\nread more\nread", "en", "s", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    gone = {(r["doc_id"], r["line_no"]) for r in linededup.judge(df).filter("exact").collect()}
    assert gone == {(2, 0), (3, 0), (3, 1)} and not linededup.judge(df).filter("near").count()
    assert {r["doc_id"]: r["text"] for r in linededup.dedup(df).collect()} == {1: rows[0][1], 2: "first of some\n\n ", 3: "read"}


def test_line_dedup_against_rows_without_ids(spark):
    rows = [(None, "some words stand in here\nshort one", "en", "s", 0), (1, "some words stood in here\nSHORT one\nother words are in here", "en", "s", 0), (2, "some words stand in\nsome words stand in here", "en", "s", 0)]
    out = linededup.judge(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r["doc_id"], r["line_no"]): (r["exact"], r["near"]) for r in out if r["exact"] or r["near"]} == {(1, 0): (False, True), (1, 1): (True, False), (2, 0): (False, True), (2, 1): (True, False)}


def test_line_dedup_of_a_book_on_one_line(spark):
    ws = [f"w{k * 7919 % 50021}" for k in range(200_000)]
    near = [*ws[:150_000], "other", *ws[150_001:]]
    rows = [(1, " ".join(ws), "en", "s", 0), (2, "short\n" + " ".join(near), "en", "s", 0), (3, " ".join(ws[:-2]), "en", "s", 0)]
    out = linededup.judge(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r["doc_id"], r["line_no"]) for r in out if r["near"]} == {(2, 1)} and not any(r["exact"] for r in out)


def test_line_dedup_query_lists_null_texts_and_repeated_rows(spark, tmp_path):
    rows = [(1, "a line of words here\nx", "en", "s", 0), (1, "a line of words here\nx", "de", "s", 0), (2, None, "en", "s", 0), (3, "", "en", "s", 0), (4, "X\na line of words there\nnew", "en", "s", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    digest = lambda *kept: hashlib.sha256(",".join(map(str, kept)).encode()).hexdigest()
    got = {tuple(r) for r in linededup.op7(spark, str(tmp_path)).select("doc_id", "n_lines", "n_exact", "n_near", "kept_sha256").collect()}
    assert got == {(1, 2, 0, 0, digest(0, 1)), (2, 0, 0, 0, digest()), (3, 1, 0, 0, digest(0)), (4, 3, 1, 1, digest(2))}


# ---- operator 8

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_by_hand(t):
    out = []
    for rank, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            twice = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(d))]
            luhn = sum(x - 9 if x > 9 else x for x in twice) % 10 == 0
            if (kind == "ip" and any(int(x) > 255 for x in m[0].split("."))) or (kind == "card" and not (14 <= len(d) <= 19 and luhn)) or (kind == "phone" and not 10 <= len(d) <= 15):
                continue
            out.append((m.start(), rank, m.end()))
    return sorted(out)


def test_personal_data_base(spark):
    rng = random.Random(11)
    parts = ["a", "b.c", "@", ".", "1", "25", "4111 1111 1111 1111", "5500-0000-0000-0004", " ", "+1 (555) 123-4567", "1.2.3.4", "é", "%", "--", "x@y.zz", "\n", "日", "+", "\x01", "\x02"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    texts += [None, "", "1" * 3000, " ".join("1" * 4000), "a." * 3000 + "@b.c", "x@" + "b." * 3000 + "c", "+" * 3000, "a@b.c%x@d.e"]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: [(x["s"], pii.KINDS.index(x["kind"]), x["e"]) for x in r["base"]] for r in pii.find(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == base_by_hand(t), repr(t)[:200]


def test_personal_data_is_discovered_by_context(spark):
    rows = [(i, f"Some text about things. reach me by mail at user{i}@mail.example.org thanks", "en", "s", 0) for i in range(30)]
    rows.append((100, "Other words. reach me by mail at someone@intranet thanks", "en", "s", 0))
    rows.append((101, "Clean words with the number 12345678 in them", "en", "s", 0))
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r["doc_id"]: r for r in pii.find(df).collect()}
    assert [x["kind"] for x in out[100]["spans"]] == ["email"] and not out[100]["base"] and not out[101]["spans"]
    assert "<email>" in {r["doc_id"]: r["text"] for r in pii.mask(df).collect()}[100]


def test_personal_data_in_groups_of_digits_and_secrets(spark):
    rng = random.Random(13)
    some = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    rows = [(i, f"Plain words here. call me on +1 555 {1000 + 7 * i} {100 + i} please", "en", "s", 0) for i in range(20)]
    rows += [(30 + i, f'We set token = "{some(39)}a1" in this file', "en", "s", 0) for i in range(20)]
    rows += [(100, "Other words. call me on 555 123 4567 please", "en", "s", 0), (101, 'And token = "Zx81-kk20_LmQ77vTz" there', "en", "s", 0), (102, "Lone 777 888 9999 elsewhere", "en", "s", 0)]
    text = {r[0]: r[1] for r in rows}
    out = {r["doc_id"]: [(x["kind"], text[r["doc_id"]][x["s"] : x["e"]]) for x in r["spans"]] for r in pii.find(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[100] == [("phone", "555 123 4567")] and out[101] == [("secret", "Zx81-kk20_LmQ77vTz")] and out[102] == []
    assert all([k for k, _ in out[30 + i]] == ["secret"] for i in range(20))


def test_personal_data_of_a_long_text_and_the_query(spark, tmp_path):
    parts = ["some words about nothing", "mail a.b@c-d.org now", "at 10.20.30.40 or", "4111 1111 1111 1111", "call +1 (555) 123-4567,", "x9 y8 z7"]
    long = " ".join(parts[k * 7 % 6] for k in range(30_000))
    rows = [(1, long, "clash"), (2, None, "clash"), (3, "", "clash"), (4, "a@b.cc 1.2.3.4", "clash"), (4, "a@b.cc 1.2.3.4", "clash"), (None, "+49 30 1234567", "clash")]
    spark.createDataFrame(rows, "doc_id long, text string, spans string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in pii.op8(spark, str(tmp_path)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans").collect()), key=repr)
    want = []
    for i, t, _ in rows:
        base = base_by_hand(t)
        listed = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        want.append((i, *(sum(k == x for _, k, _ in base) for x in range(4)), hashlib.sha256(listed.encode()).hexdigest()))
    assert [g[:6] for g in got] == sorted(want, key=repr)
    assert all(set(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base_by_hand(t)) <= set(g[6].split(",")) for g in got for i, t, _ in rows if i == g[0] and base_by_hand(t))


# ---- operator 9


def contamination_by_hand(t, items, window=10):
    ws, hit, found = decontam.words(t), set(), set()
    for name, text in items:
        iw = decontam.words(text)
        n = min(window, len(iw))
        grams = {tuple(iw[k : k + n]) for k in range(len(iw) - n + 1)} if n else set()
        for k in range(len(ws) - n + 1):
            if n and tuple(ws[k : k + n]) in grams:
                hit |= set(range(k, k + n))
                found.add(str(name))
    return len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


@pytest.mark.parametrize("most", [10**6, 20])
def test_decontamination(spark, most, monkeypatch):
    rng = random.Random(12)
    vocab = [word(rng) for _ in range(12)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 25)))) for i in range(25)] + [(90, None), (91, ""), (92, "solo")]
    texts = []
    for _ in range(120):
        t = " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 40)))
        if rng.random() < 0.4:
            t += " X-y " + (rng.choice(items)[1] or "").upper()
        texts.append(t)
    texts += [None, "", "solo", "Solo, duo"]
    whole = decontam.broadcast_items
    monkeypatch.setattr(decontam, "broadcast_items", lambda b, w: whole(b, w, most))
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in decontam.scan(df, bench).collect()}
    want = {i: contamination_by_hand(t, items) for i, t in enumerate(texts)}
    assert got == want
    cleaned = {r["doc_id"]: r["text"] for r in decontam.clean(df, bench).collect()}
    for i, t in enumerate(texts):
        n, hit = want[i][:2]
        assert (i in cleaned) == (hit <= 0.5 * n)
        if i in cleaned and t is not None:
            assert len(decontam.words(cleaned[i])) == n - hit


# ---- all


@pytest.mark.parametrize("run", [
    quality.score, quality.keep_good, mixing.mix, mixing.keep_mixed, lambda d: langid.predict(d, langid.learn(d)), lambda d: tokencount.scan(tokencount.write_flat(d)[0], kind="<u2"),
    ngram_jaccard.join, ngram_jaccard.one_of_each, linededup.judge, linededup.dedup, pii.find, pii.mask, lambda d: tokenbin.read_index(tokenbin.write_ids(d)),
    lambda d: decontam.scan(d, d.selectExpr("doc_id AS item_id", "text")), lambda d: decontam.clean(d, d.selectExpr("doc_id AS item_id", "text")),
    lambda d: toxicity.score(d, toxicity.learn(d, d.selectExpr("doc_id", "1 AS toxic"))),
], ids=str)
def test_empty_tables(empty, run):
    assert run(empty).count() == 0


def test_rows_without_ids_and_repeated_rows(spark):
    rows = [(None, "same words in this text here", None, None, None), (None, None, None, None, None), (5, "same words in this text here", None, "s", 1), (5, "same words in this text here", None, "s", 1), (5, "other text of the same id in here", "en", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert quality.score(df).count() == mixing.mix(df).count() == 5
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in ngram_jaccard.join(df).collect()) == [(-1, -1), (-1, -1), (5, 5), (5, 5), (5, 5)]
    assert pii.find(df).count() == 5 and tokenbin.read_index(tokenbin.write_ids(df)).count() == 5
    assert tokencount.scan(tokencount.write_flat(df)[0], kind="<u2").count() == 5
    assert linededup.judge(df).count() == 4 and linededup.dedup(df).count() == 5
    bench = spark.createDataFrame([(1, "same words in this text here")], "item_id long, text string")
    assert decontam.scan(df, bench).filter("contaminated").count() == 3
    assert langid.predict(df, langid.learn(df)).count() == 5


def test_pipeline_keeps_columns_and_agrees_with_its_parts(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
    texts = sorted((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    ids = library_ids([t for _, t in texts])
    out = pipeline.run(spark, sf).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in out) == sorted((d, len(i) + 1) for (d, _), i in zip(texts, ids))
    assert sum(r["n_tokens"] for r in out) == max(r["start"] + r["n_tokens"] for r in out)


def test_sql_of_the_operators(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    for name, sql in queries.SQL.items():
        df = queries.QUERIES[name](spark, sf)
        names = sorted(df.columns)
        found = con.execute(sql)
        at = [[d[0] for d in found.description].index(c) for c in names]
        clean = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
        assert sorted(repr([clean(r[c]) for c in names]) for r in df.collect()) == sorted(repr([clean(r[i]) for i in at]) for r in found.fetchall()), name

