"""Language identification by word-first backoff (operator 3).

A known word adds its log frequency in each language. A word that was not learned adds the mean log frequency
of its longest character n-grams that were: those of NGRAM characters if any is known, else the next shorter
ones, down to single characters. The language with the greatest sum, with the languages' shares as prior, wins;
the score is its posterior probability.

Learning is fitted on at most about TRAIN_DOCS documents of each language (a hash of doc_id chooses them, at a
rate that follows the language's count), counted by Spark; each language keeps its own KNOWN_WORDS and KNOWN_GRAMS
most frequent entries (ties by code point), so that none is crowded out and what is broadcast is bounded.
Prediction covers all rows and whole texts. A word is a Unicode letter with the letters and marks after it.

Defined results: a null text, or one without a letter, is `und` with score 0; with nothing to learn from every
text is `und`; of languages with equal sums the first by code point wins; letters of which nothing is known give the most frequent language; rows without doc_id are
predicted but not learned from; repeated rows are predicted alike; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ship, table

TRAIN_DOCS, KNOWN_WORDS, KNOWN_GRAMS, NGRAM = 3000, 30_000, 20_000, 4
FOLDS, MEMO_WORDS = 5, 200_000
_ASCII = re.compile("[a-z]+")
_models: dict = {}


@cache
def _letters():
    import regex

    return regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words_in(text: str | None) -> list[str]:
    """Lower-case words of a text."""
    if not text:
        return []
    return (_ASCII if text.isascii() else _letters()).findall(text.lower())



def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds` (null without id)."""
    return F.crc32(doc_id.cast("string")) % folds


def grams_of(word: str, n: int) -> list[str]:
    """n-grams of a word between its edges."""
    padded = f"^{word}$" if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _batch(pa, counts: Counter):
    langs, kinds, grams = map(list, zip(*counts))
    arrays = [pa.array(langs, pa.string()), pa.array(kinds, pa.int32()), pa.array(grams, pa.string()), pa.array(list(counts.values()), pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, ["lang", "kind", "gram", "n"])


def _count_words(batches):
    import pyarrow as pa

    words: dict[str, Counter] = defaultdict(Counter)

    def emit():
        counts = Counter({(lang, 0, w): n for lang, found in words.items() for w, n in found.items()})
        words.clear()
        return _batch(pa, counts)

    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            words[lang].update(words_in(text))
            if sum(map(len, words.values())) > 100_000:
                yield emit()
    if any(words.values()):
        yield emit()


def _count_grams(batches):
    import pyarrow as pa

    counts: Counter = Counter()
    for b in batches:
        for lang, word, c in zip(*(b.column(x).to_pylist() for x in ("lang", "gram", "n"))):
            for n in range(1, NGRAM + 1):
                for g in grams_of(word, n):
                    counts[lang, n, g] += c
        if len(counts) > 100_000:
            yield _batch(pa, counts)
            counts.clear()
    if counts:
        yield _batch(pa, counts)


def learn(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> dict:
    """Model of the labelled rows of `docs` (doc_id, text, lang): languages, priors and log frequencies."""
    import numpy as np

    ship(docs.sparkSession)
    rows = docs.filter("lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return {"langs": [], "prior": [], "tables": []}
    rate = F.create_map(*(x for k in langs for x in (F.lit(k), F.lit(min(1.0, train_docs / sizes[k])))))
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("language")), F.lit(1_000_000)) / 1_000_000.0
    shape = "lang string, kind int, gram string, n long"
    summed = lambda df: df.groupBy("lang", "kind", "gram").agg(F.sum("n").alias("n"))
    words = table(summed(rows.filter(place < rate[F.col("lang")]).mapInArrow(_count_words, shape)), "language-words")
    counts = table(words.unionByName(summed(words.mapInArrow(_count_grams, shape))), "language-counts")
    order = W.partitionBy("lang", "words").orderBy(F.desc("n"), "kind", "gram")
    most = F.when(F.col("words"), KNOWN_WORDS).otherwise(KNOWN_GRAMS)
    chosen = counts.withColumn("words", F.col("kind") == 0).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    known = counts.join(chosen.select("kind", "gram").distinct().hint("merge"), ["kind", "gram"])
    known = known.groupBy("kind", "gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by")).orderBy("kind", "gram")
    tables: list[dict] = [{} for _ in range(NGRAM + 1)]
    for r in known.collect():
        tables[r["kind"]][r["gram"]] = [r["by"].get(k, 0) for k in langs]
    logs = []
    for entries in tables:
        counted = np.array(list(entries.values()), float).reshape(-1, len(langs)) + 0.5
        logs.append((list(entries), np.log(counted / (counted.sum(0) + 0.5)).astype("float32")))
    total = sum(sizes.values())
    return {"langs": langs, "prior": [math.log(sizes[k] / total) for k in langs], "tables": logs}


class Scorer:
    """A learned model in a worker. Words not learned get rows of their own, up to MEMO_WORDS of them."""

    def __init__(self, model: dict):
        import numpy as np

        self.np, self.langs, self.prior = np, model["langs"], np.array(model["prior"])
        tables = model["tables"] or [([], np.zeros((0, max(len(self.langs), 1))))]
        self.known = len(tables[0][0])
        self.index = {w: i for i, w in enumerate(tables[0][0])}
        self.rows = np.concatenate([tables[0][1], np.zeros((MEMO_WORDS, tables[0][1].shape[1]), tables[0][1].dtype)])
        self.grams = [dict(zip(names, map(tuple, rows.tolist()))) for names, rows in tables[1:]]
        self.nothing = (0.0,) * len(self.langs)

    def unseen(self, word: str) -> tuple:
        """Vector of a word that was not learned."""
        for n in range(min(NGRAM, len(self.grams)), 0, -1):
            rows = self.grams[n - 1]
            known = [rows[g] for g in grams_of(word, n) if g in rows]
            if known:
                return tuple(sum(x) / len(known) for x in zip(*known))
        return self.nothing

    def predict(self, text: str | None) -> tuple[str, float]:
        np, index = self.np, self.index
        words = words_in(text)
        if not words or not self.langs:
            return "und", 0.0
        extra = 0.0
        for w in set(words).difference(index):
            if len(w) < 40:
                if len(index) == len(self.rows):  # full: forget the words that were not learned
                    for k in [k for k, i in index.items() if i >= self.known]:
                        del index[k]
                self.rows[len(index)] = self.unseen(w)
                index[w] = len(index)
        try:
            at = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        except KeyError:  # words too long to remember, or more than fit
            at = np.array([index[w] for w in words if w in index], np.int64)
            extra = np.array([self.unseen(w) for w in words if w not in index]).sum(0)
        total = self.prior + np.bincount(at, minlength=len(self.rows)) @ self.rows if len(at) > len(self.rows) else self.prior + self.rows[at].sum(0, dtype=np.float64)
        total = total + extra
        best = int(total.argmax())
        return self.langs[best], float(1 / np.exp(np.minimum(total - total[best], 0)).sum())


def _predict(model):
    def run(batches):
        import pyarrow as pa

        if model.id not in _models:
            _models.clear()
            _models[model.id] = Scorer(model.value)
        scorer = _models[model.id]
        for b in batches:
            out = [scorer.predict(t) for t in b.column("text").to_pylist()]
            arrays = [b.column("doc_id"), b.column("held_out"), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: dict) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, held_out, lang_pred, score."""
    import uuid

    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    holder = _Sent(sent, uuid.uuid4().hex)
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == 0, F.lit(False))
    rows = docs.select("doc_id", "text", held.alias("held_out"))
    return rows.mapInArrow(_predict(holder), f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")


class _Sent:
    """A broadcast with a name by which workers keep what they derive from it."""

    def __init__(self, sent, name: str):
        self.sent, self.id = sent, name

    @property
    def value(self):
        return self.sent.value


def op3(spark, sf_dir: str) -> DataFrame:
    """Query: the language of all documents, learned from those outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, learn(docs.filter(fold(F.col("doc_id"), FOLDS) != 0)))
