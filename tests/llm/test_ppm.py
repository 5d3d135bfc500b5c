"""Operator 13 against plain Python: a dictionary of contexts, walked byte by byte."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from claimboard.llm import ppm

SCHEMA = "doc_id long, text string"
CLASHES = ["kind", "block", "seq", "word", "win", "n", "held_out", "value", "_salt"]


def texts(seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(40)]
    out = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(50)]
    out += [out[0], out[0], "", None, " \n\t ", "One", "ONE  one\x0bone", "日本語 text 🙂", "z" * 3000, "x " * 2000, "q\x00w"]
    return [(i, t) for i, t in enumerate(out)] + [(3, out[3]), (3, out[3]), (None, "no id"), (None, None)]


def tokens(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return [w for w in re.split("[ \t\n\x0b\f\r]+", low) if w]


def sequence(t):
    return b"".join(w.encode() + b" " for w in tokens(t)) + b"\n"


def held(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2


def by_hand(rows):
    trie, unigrams = defaultdict(Counter), Counter()
    for i, t in rows:
        if not held(i):
            unigrams.update([*tokens(t), None])
            seq = b"\n" * ppm.ORDER + sequence(t)
            for at in range(ppm.ORDER, len(seq)):
                for k in range(ppm.ORDER + 1):
                    trie[seq[at - k : at]][seq[at]] += 1
    total, different = sum(unigrams.values()), len(unigrams)

    def log(context, byte):
        gone, out = set(), 0.0
        while True:
            left = {b: n for b, n in trie.get(context, {}).items() if b not in gone}
            if left:
                t = 2 * sum(left.values())
                if byte in left:
                    return out + math.log10((2 * left[byte] - 1) / t)
                out += math.log10(len(left) / t)
            gone |= set(trie.get(context, {}))
            if not context:
                return out - math.log10(256 - len(gone))
            context = context[1:]

    out = []
    for i, t in rows:
        seq = b"\n" * ppm.ORDER + sequence(t)
        score = sum(log(seq[at - ppm.ORDER : at], seq[at]) for at in range(ppm.ORDER, len(seq)))
        toks = [*tokens(t), None]
        base = sum(math.log10((unigrams[w] + 1) / (total + different + 1)) for w in toks)
        out.append((i, held(i), len(toks), sum(unigrams[w] > 0 for w in toks), total, base, score))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2], r[6]))


@pytest.mark.parametrize("block_bytes", [ppm.BLOCK_BYTES, 500])
def test_scores_equal_plain_python(spark, block_bytes):
    rows = texts()
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in CLASHES}).repartition(3)
    got = ordered([tuple(r) for r in ppm.score(docs, block_bytes=block_bytes).collect()])
    want = ordered(by_hand(rows))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(g[5] == pytest.approx(w[5], abs=1e-9, rel=1e-9) and g[6] == pytest.approx(w[6], rel=2e-7) for g, w in zip(got, want))


def test_probabilities_of_a_context_sum_to_one(spark):
    """Every context, met in training or not, shares exactly 1 among the 256 bytes."""
    import numpy as np

    rows = [t for i, t in texts()[:20] if t]
    win, own, _ = ppm.windows_of([sequence(t) for t in rows])
    keys, n = np.unique(win[own], return_counts=True)
    low, at = np.unique(keys & 65535, return_inverse=True)
    first_order = (low, np.bincount(at, n).astype(np.int64))
    contexts = [*np.unique(keys >> 8)[:40], int.from_bytes(b"\x01\x02\x03\x04ab"[-ppm.ORDER :], "big"), int.from_bytes(b"\xf0" * ppm.ORDER, "big")]
    for c in contexts:
        mine = np.array([c], np.int64)[0] & 65535
        family = (keys >> 8 & 65535) == mine
        asked = np.union1d(keys[family], (np.int64(c) << 8) + np.arange(256))
        counts = np.zeros(len(asked), np.int64)
        counts[np.searchsorted(asked, keys[family])] = n[family]
        p = 10 ** ppm.log_probabilities(asked, counts, first_order)
        assert p[asked >> 8 == c].sum() == pytest.approx(1)


def test_no_training_rows_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "ab c"), (2, None)], SCHEMA)
    got = {r["doc_id"]: r for r in ppm.score(docs, F.lit(False)).collect()}
    assert got[1]["score"] == pytest.approx(6 * -math.log10(256)) and got[2]["score"] == pytest.approx(-math.log10(256))
    assert got[1]["base_score"] == 0 and got[1]["n_tokens"] == 3 and got[1]["n_known"] == 0 and got[1]["held_out"]
    assert ppm.score(spark.createDataFrame([], SCHEMA)).count() == 0


def test_held_out_texts_are_better_predicted_than_by_words(spark):
    """On documents that were not learnt from, the byte model spells unseen words and still beats the unigram base."""
    rows = ppm.op13(spark, "/root/testdata/sf0.01").where("held_out").selectExpr("sum(score) / sum(n_tokens) AS s", "count(*) AS n").first()
    assert rows["n"] > 100 and -4.5 < rows["s"] < -2


def test_numbers_pack_and_unpack():
    import numpy as np

    rng = np.random.default_rng(1)
    lists = [rng.choice([0, 5, 65534, 65535, 65536, 98303, 131071, (1 << 30) - 1], rng.integers(0, 9)) for _ in range(50)]
    data = ppm.packed(np.concatenate(lists), np.array([len(x) for x in lists]))
    numbers, lengths = ppm.unpacked(data)
    assert lengths.tolist() == [len(x) for x in lists] and numbers.tolist() == np.concatenate(lists).tolist()
    assert [len(x) for x in ppm.unpacked([])] == [0, 0]
