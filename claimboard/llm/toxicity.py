"""Toxicity by a counterfactually regularised classifier (operator 5).

Logistic regression on which words and word beginnings (of PREFIXES characters) a text has. Features are chosen by
how far their share of toxic texts departs from their share of the others; every identity term is one too. For each
labelled text with an identity term, copies with the term swapped for the others of its language and group and for the
language's neutral word are made: the word and its beginnings leave, those of the other word come. The square of the
change of score is added to the loss, so that naming a group neither raises nor lowers a score.

The classifier is fitted on at most about TRAIN_TOXIC toxic and TRAIN_OTHER other labelled documents (a hash of
doc_id chooses them at a rate that follows the class' count; equal texts count once) with at most FEATURES
features, which bounds what is collected and broadcast; equal texts labelled both ways count as toxic. Scoring covers all rows and whole texts.

Defined results: a null or empty text gets the score of a text without any feature; a document labelled both
ways counts as toxic; without two classes to learn from every score is the toxic share (0 if none); rows without
doc_id are scored and not learned from; repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, table
from .langid import _Sent, fold
from .langid import words_in as letters_in

TRAIN_TOXIC, TRAIN_OTHER, FEATURES, FOLDS = 4000, 8000, 500, 3
LEAST_DOCS, RIDGE, SWAP_WEIGHT, STEPS, THRESHOLD = 4, 2e-4, 5.0, 500, 0.7
PREFIXES = (4, 5, 6, 7)
#: Identity terms by language and group, and each language's neutral word that any of them may be swapped for.
IDENTITY = {
    "en": {
        "religion": ["muslim", "jewish", "christian", "catholic", "hindu", "buddhist", "atheist"],
        "gender": ["women", "men", "woman", "man", "girls", "boys", "transgender"],
        "orientation": ["gay", "lesbian", "bisexual", "straight", "heterosexual"],
        "origin": ["black", "white", "asian", "african", "mexican", "chinese", "american", "european", "arab", "immigrant"],
        "ability": ["blind", "deaf", "disabled", "autistic"],
        "age": ["old", "young", "elderly", "teenage"],
    },
    "de": {
        "religion": ["muslime", "juden", "christen", "katholiken", "hindus", "buddhisten", "atheisten"],
        "gender": ["frauen", "männer", "frau", "mann", "mädchen", "jungen"],
        "orientation": ["schwule", "lesben", "bisexuelle", "heterosexuelle"],
        "origin": ["schwarze", "weiße", "asiaten", "afrikaner", "türken", "araber", "europäer", "einwanderer"],
        "ability": ["blinde", "gehörlose", "behinderte", "autisten"],
        "age": ["alte", "junge", "senioren", "jugendliche"],
    },
    "fr": {
        "religion": ["musulmans", "juifs", "chrétiens", "catholiques", "hindous", "bouddhistes", "athées"],
        "gender": ["femmes", "hommes", "femme", "homme", "filles", "garçons"],
        "orientation": ["gays", "lesbiennes", "bisexuels", "hétérosexuels"],
        "origin": ["noirs", "blancs", "asiatiques", "africains", "arabes", "européens", "immigrés"],
        "ability": ["aveugles", "sourds", "handicapés", "autistes"],
        "age": ["vieux", "jeunes", "retraités", "adolescents"],
    },
    "es": {
        "religion": ["musulmanes", "judíos", "cristianos", "católicos", "hindúes", "budistas", "ateos"],
        "gender": ["mujeres", "hombres", "mujer", "hombre", "chicas", "chicos"],
        "orientation": ["gais", "lesbianas", "bisexuales", "heterosexuales"],
        "origin": ["negros", "blancos", "asiáticos", "africanos", "mexicanos", "árabes", "europeos", "inmigrantes"],
        "ability": ["ciegos", "sordos", "discapacitados", "autistas"],
        "age": ["ancianos", "jóvenes", "jubilados", "adolescentes"],
    },
}
NEUTRAL = {"en": "people", "de": "menschen", "fr": "personnes", "es": "personas"}
TERMS = sorted({t for groups in IDENTITY.values() for terms in groups.values() for t in terms} | set(NEUTRAL.values()))
_models: dict = {}


def words_in(text: str | None) -> set[str]:
    """Distinct lower-case words of a text."""
    return set(letters_in(text))


def features_of(words: set[str]) -> set[str]:
    """Features of a text's words: they, and their beginnings with a star."""
    out = set(words)
    for n in PREFIXES:
        out.update(w[:n] + "*" for w in words if len(w) > n)
    return out


def features_in(text: str | None) -> set[str]:
    """Features of a text: its words, and the beginnings of its words with a star."""
    return features_of(words_in(text))


def swaps(words: set[str], known) -> list[tuple[list[str], list[str]]]:
    """(removed, added) known features of every counterfactual of a text with these words; a feature that another word
    of the text has too stays, and a term that stands in several languages is swapped in each."""
    out, has = [], None
    for language, groups in IDENTITY.items():
        for terms in groups.values():
            for a in words.intersection(terms):
                has = has or features_of(words)
                rest = features_of(words - {a})
                for b in [*terms, NEUTRAL[language]]:
                    if b != a:
                        after = rest | features_of({b})
                        out.append((sorted(f for f in has - after if f in known), sorted(f for f in after - has if f in known)))
    return sorted(out)


def fit(rows: list[list[int]], toxic: list[int], pairs: list[list[tuple[list[int], list[int]]]], width: int, swap_weight: float = SWAP_WEIGHT):
    """Weights and intercept by gradient descent with momentum on the regularised loss; classes weigh alike.

    pairs: per row the (removed, added) features of its counterfactuals."""
    import numpy as np

    y = np.array(toxic, float)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.array([c for r in rows for c in r], int)
    who = np.array([i for i, p in enumerate(pairs) for _ in p], int)
    copies = [x for p in pairs for x in p]
    gone, came = (np.array([c for x in copies for c in x[k]], int) for k in (0, 1))
    gone_of, came_of = (np.repeat(np.arange(len(copies)), [len(x[k]) for x in copies]) for k in (0, 1))
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max(len(y) - y.sum(), 1))
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    w, b = np.zeros(width), 0.0
    m, v, t = np.zeros(width + 1), np.zeros(width + 1), 0
    for t in range(1, STEPS + 1):
        z = b + np.bincount(owner, w[column], len(rows))
        error = weight * (sigmoid(z) - y)
        swapped = np.zeros(width)
        if len(who):
            p, q = sigmoid(z[who]), sigmoid(z[who] - np.bincount(gone_of, w[gone], len(who)) + np.bincount(came_of, w[came], len(who)))
            pull = 2 * swap_weight * (p - q) / len(who)
            error = error + np.bincount(who, pull * (p * (1 - p) - q * (1 - q)), len(rows))
            moved = pull * q * (1 - q)
            swapped = np.bincount(gone, moved[gone_of], width) - np.bincount(came, moved[came_of], width)
        g = np.bincount(column, error[owner], width) + swapped + RIDGE * w
        gb = error.sum()
        full = np.append(g, gb)
        m, v = 0.9 * m + 0.1 * full, 0.999 * v + 0.001 * full**2
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def _count(batches):
    import pyarrow as pa
    from collections import Counter

    for b in batches:
        counts = (Counter(), Counter())
        for toxic, text in zip(b.column("toxic").to_pylist(), b.column("text").to_pylist()):
            counts[toxic == 1].update(features_in(text))
        names = sorted(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([counts[k][n] for n in names], pa.int64()) for k in (1, 0))], ["word", "a", "b"])


def _index(sent):
    def run(batches):
        import pyarrow as pa

        known = sent.value.keys()
        for b in batches:
            texts = [words_in(t) for t in b.column("text").to_pylist()]
            sets = pa.array([sorted(features_of(w) & known) for w in texts], pa.list_(pa.string()))
            copies = [[{"gone": g, "came": c} for g, c in swaps(w, known)] for w in texts]
            kind = pa.list_(pa.struct([("gone", pa.list_(pa.string())), ("came", pa.list_(pa.string()))]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), sets, pa.array(copies, kind)], ["doc_id", "toxic", "words", "copies"])

    return run


def learn(docs: DataFrame, labels: DataFrame, most_toxic: int = TRAIN_TOXIC, most_other: int = TRAIN_OTHER, swap_weight: float = SWAP_WEIGHT) -> dict:
    """Model of `docs` (doc_id, text) that `labels` (doc_id, toxic) marks."""
    import numpy as np

    ship(docs.sparkSession)
    marks = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    n_toxic, n_other = sizes.get(1, 0), sum(n for k, n in sizes.items() if k != 1)
    share = n_toxic / max(n_toxic + n_other, 1)
    none = {"index": {}, "weights": [], "bias": float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))), "fixed": share}
    if not n_toxic or not n_other:
        return none
    rate = F.when(F.col("toxic") == 1, min(1.0, most_toxic / n_toxic)).otherwise(min(1.0, most_other / n_other))
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxicity")), F.lit(1_000_000)) / 1_000_000.0
    chosen = marks.filter(place < rate)  # about most_toxic + most_other rows, so it may be broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    rows = table(rows.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")), "toxicity-sample")
    seen = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    p, q = seen.get(1, 0), sum(n for k, n in seen.items() if k != 1)
    if not p or not q:
        return none
    by_word = rows.select("toxic", "text").mapInArrow(_count, "word string, a long, b long").groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    x, y = (F.col("a") + 0.5) / (p + 1), (F.col("b") + 0.5) / (q + 1)
    pooled = (F.col("a") + F.col("b") + 1) / (p + q + 2)
    far = F.abs(x - y) / F.sqrt(pooled * (1 - pooled) * (1 / p + 1 / q))
    top = by_word.filter(F.col("a") + F.col("b") >= LEAST_DOCS).filter(pooled < 0.95).orderBy(far.desc(), "word").limit(FEATURES).select("word").collect()
    names = sorted({r["word"] for r in top} | set(TERMS))
    index = {w: i for i, w in enumerate(names)}
    sent = _Sent(docs.sparkSession.sparkContext.broadcast(index), "toxicity-features")
    kept = rows.select("doc_id", "toxic", "text").mapInArrow(_index(sent), "doc_id long, toxic int, words array<string>, copies array<struct<gone:array<string>,came:array<string>>>").orderBy("doc_id").collect()
    places = lambda names: [index[x] for x in names]
    pairs = [[(places(c["gone"]), places(c["came"])) for c in r["copies"]] for r in kept]
    w, b = fit([places(r["words"]) for r in kept], [int(r["toxic"] == 1) for r in kept], pairs, len(names), swap_weight)
    return {"index": index, "weights": w.tolist(), "bias": float(b), "fixed": None, "copies": sum(map(len, pairs))}


def score_text(text: str | None, model: dict) -> float:
    """Score of one text."""
    import math

    if model["fixed"] is not None:
        return float(model["fixed"])
    index, weights = model["index"], model["weights"]
    # sorted, so that the sum does not depend on a set's order
    z = model["bias"] + sum(weights[i] for i in sorted(index[w] for w in features_in(text) & index.keys()))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _score(sent):
    def run(batches):
        import pyarrow as pa

        model = sent.value
        for b in batches:
            scores = pa.array([score_text(t, model) for t in b.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), scores], ["doc_id", "held_out", "score"])

    return run


def score(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of `docs` (doc_id, text): doc_id, held_out, score, predicted."""
    ship(docs.sparkSession)
    sent = _Sent(docs.sparkSession.sparkContext.broadcast(model), "toxicity")
    held = F.coalesce(fold(F.col("doc_id"), FOLDS) == 1, F.lit(False))
    rows = docs.select("doc_id", "text", held.alias("held_out"))
    out = rows.mapInArrow(_score(sent), f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double")
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def op5(spark, sf_dir: str) -> DataFrame:
    """Query: toxicity of all documents, learned outside the held-out fold."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, learn(docs, labels.filter(fold(F.col("doc_id"), FOLDS) != 1)))
