"""A training corpus from raw documents: quality, near duplicates, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. All but the last
return the columns of documents; the last returns the index of the token files it wrote.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from claimboard.llm import decontam, mixing, ngram_jaccard, quality, tokenbin
from claimboard.llm.common import collect_shuffles, drop_paths, paths_of, table, tables_made


def _stage(function):
    """A stage that deletes the tables it made on its way and that the rows it returns do not read. What they do read
    stays until release() or the end of the process, so rows of other calls are never touched."""

    @wraps(function)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        collect_shuffles(spark)
        with tables_made() as made:
            out = function(spark, docs, sf_dir)
        needed = set(paths_of(out))
        drop_paths([p for p in made if p not in needed])
        collect_shuffles(spark)
        return out

    return stage


def release(rows: DataFrame) -> None:
    """Delete the tables behind a stage's rows, once they are stored elsewhere or not needed any more."""
    drop_paths(paths_of(rows))


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the adaptive quality rules."""
    return quality.keep_good(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingle similarity."""
    return ngram_jaccard.one_of_each(docs)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; mostly contaminated documents go."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source mix takes them."""
    return mixing.keep_mixed(docs)


@_stage
def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Index of the token files written from the documents."""
    return tokenbin.read_index(tokenbin.write_ids(docs))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("source mix", source_mix),
    ("token-ID output", token_output),
]

#: SQL has no byte-level BPE, so the whole pipeline is tested against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written and read again; what lies behind written rows is released."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        rows = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return rows
        kept = table(rows, f"pipeline-{i}", collect=True)
        release(rows)
        release(docs)
        docs = kept
