"""Operator 11 against plain Python, and the scan against edit distances of all pairs."""

import random
import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimboard.llm import spelling

SCHEMA = "doc_id long, text string"
CLASHES = ["word", "n", "list", "near", "root", "form", "via", "moved", "_salt"]


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def texts(seed=7):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeÀéÿ") for _ in range(rng.randint(5, 10))) for _ in range(60)]
    base += ["kitten", "kittens", "kitte", "aaaaaa", "aaaaaaa", "aaaaaaaa"]
    chain = ["flower", "flowers", "flowerss", "flowersss"]
    out = []
    for _ in range(220):
        words = []
        for _ in range(rng.randint(1, 60)):
            w = rng.choice(base)
            if rng.random() < 0.15:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "b", w[at] + "c"]) + w[at + 1 :]
            words.append(w.upper() if rng.random() < 0.1 else w)
        out.append(rng.choice([" ", "-", "0", " × "]).join(words))
    out += [" ".join([w] * (2000 // 6**k)) for k, w in enumerate(reversed(chain))]
    out += ["", None, "İstanbul ſtraße", "日本" * 50, "z" * 20000, "abcdef " * 9000, out[0], out[0]]
    return [(i, t) for i, t in enumerate(out)] + [(None, out[1]), (5, out[5]), (5, out[5])]


def by_hand(rows, vary):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % vary == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    form, near = {}, {}
    for w, n in words.items():
        close = [x for x in words if one_edit(w, x)]
        near[w] = len(close)
        best = min(close, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, near[w], words[form[w]] if form[w] else None))
    return out


def test_variants_equal_plain_python(spark):
    rows = texts()
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in CLASHES}).repartition(3)
    for vary in (3, 199):
        got = {tuple(r) for r in spelling.variants(docs, vary=vary).collect()}
        want = by_hand(rows, vary)
        assert got == set(want) and len(want) > 60
        assert any(r[2] != r[1] and r[1] for r in want) or vary == 3


def test_counts_flush_in_parts(spark, monkeypatch):
    rows = texts()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    whole = {tuple(r) for r in spelling.word_counts(docs).collect()}
    monkeypatch.setattr(spelling, "HELD_WORDS", 20)
    counted = Counter()
    for b in spelling._count(199)(docs.toArrow().select(["doc_id", "text"]).to_batches(max_chunksize=7)):
        for w, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist()):
            counted[w] += n
    assert {(w, n) for w, n in counted.items() if n and w} == whole


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abé", min_size=1, max_size=7), unique=True, max_size=25))
def test_scan_finds_all_near_pairs(words):
    words = sorted(words)
    got = sorted(spelling.near_in_sorted(words))
    assert got == [(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if one_edit(words[i], words[j])]


def test_lists_lose_no_pair(spark):
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(300)})
    got = {tuple(r) for r in spelling.near_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_empty_table(spark):
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, None), (2, "short")], SCHEMA)).count() == 0
