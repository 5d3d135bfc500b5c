"""Operator 12 against plain Python: whole texts encoded by the libraries, tokens and links walked one by one."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from claimboard.llm import alignment, encoding

SCHEMA = "doc_id long, text string"
CLASHES = ["kind", "block", "slots", "times", "slot", "pair", "n", "n_a", "best", "_salt"]


def texts(seed=5):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgé漢") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    out = [rng.choice([" ", "  ", "\n"]).join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(40)]
    out += [out[0], out[0], "", None, " ", "  ", "   a  ", "a ", "\n\n", " \n\t x", "<s> </s> <unk> <0x41> <|endoftext|> x", "has ▁ mark", "🙂🙂  　nb", "q\x00w \x01", "ab" * 4000, "a" * 5000, " " * 700, "日本語" * 800, "don't they'll I've 12345 3.14"]
    return [(i, t) for i, t in enumerate(out)] + [(2, out[2]), (None, "no id here")]


def encoded(t):
    import sentencepiece
    from tokenizers import Tokenizer

    if not hasattr(encoded, "both"):
        a = Tokenizer.from_file(encoding.vocabulary_path("byte_bpe_50k.json"))
        a.encode_special_tokens = True
        encoded.both = a, sentencepiece.SentencePieceProcessor(model_file=encoding.vocabulary_path("piece_bpe_32k.model"))
    a, b = encoded.both
    if not t:
        return [], []
    plain = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255]
    names = dict(zip([*map(chr, plain), *map(chr, range(256, 512))], [*plain, *(x for x in range(256) if x not in plain)]))
    ids_a, ids_b = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
    bytes_a = [bytes(names[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if any(b"".join(x) != (" " + t).encode() for x in (bytes_a, bytes_b)):
        return [], []
    return list(zip(ids_a, bytes_a)), list(zip(ids_b, bytes_b))


def groups_by_hand(t):
    """[(stop, A ids, B ids)]."""
    sides, ends = encoded(t), []
    for side in sides:
        at, mine = 0, []
        for _, x in side:
            at += len(x)
            mine.append(at)
        ends.append(mine)
    out = []
    for stop in sorted(set(ends[0]) & set(ends[1])):
        low = out[-1][0] if out else 0
        out.append((stop, *([i for (i, _), e in zip(side, mine) if low < e <= stop] for side, mine in zip(sides, ends))))
    return out


def by_hand(rows):
    cut = [groups_by_hand(t) for _, t in rows]
    links = [Counter((a, b) for _, xs, ys in gs for a in xs for b in ys) for gs in cut]
    count = Counter(p for c in links for p in c)
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    out = []
    for (i, _), gs, c in zip(rows, cut, links):
        text = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for _, xs, ys in gs)
        out.append((i, sum(len(x) for _, x, _ in gs), sum(len(y) for _, _, y in gs), len(gs), sum(c.values()), sum(n for p, n in c.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in c.items()), hashlib.sha256(text.encode()).hexdigest() if gs else ""))
    return out, count, most


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, *r[1:4]))


@pytest.mark.parametrize("block_pairs", [alignment.BLOCK_PAIRS, 50])
def test_figures_equal_plain_python(spark, block_pairs):
    rows = texts()
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in CLASHES}).repartition(3)
    got, want = ordered(alignment.align(docs, block_pairs=block_pairs).collect()), ordered(by_hand(rows)[0])
    for g, w in zip(got, want):
        assert g == w
    assert len(got) == len(want)


def test_pair_counts_and_groups(spark):
    rows = texts()[:59]
    docs = spark.createDataFrame(rows, SCHEMA)
    _, count, most = by_hand(rows)
    got = {(r["a"], r["b"]): (r["documents"], r["best"]) for r in alignment.pair_counts(docs).collect()}
    assert got == {p: (n, n == most[p[0]]) for p, n in count.items()}
    found = defaultdict(list)
    for r in alignment.groups(docs).orderBy("doc_id", "stop").collect():
        found[r["doc_id"]].append((r["start"], r["stop"], r["a_ids"], r["b_ids"]))
    for i, t in rows[:50]:
        hand = groups_by_hand(t)
        assert found[i] == [(a, s, xs, ys) for a, (s, xs, ys) in zip([0, *(h[0] for h in hand)], hand)]


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], SCHEMA)).count() == 0
    assert alignment.groups(spark.createDataFrame([], SCHEMA)).count() == 0
    assert alignment.align(spark.createDataFrame([(1, None), (2, "")], SCHEMA)).where("n_links = 0 AND groups_sha256 = ''").count() == 2


def test_chunks_encode_as_whole_texts(spark):
    """The pieces of a text are those of its chunks, on every text of the smallest table."""
    enc = alignment.PieceEncoder("piece_bpe_32k.model")
    assert not enc.whole
    docs = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if r["text"]]
    docs += [t for _, t in texts() if t]
    import numpy as np

    for t, ids in zip(docs, enc.texts(docs)):
        assert np.frombuffer(ids, "<u4").tolist() == enc.model.encode(t)
