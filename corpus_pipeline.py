"""A training corpus from ``documents``: five stages, each an operator of ``tsengine.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of ``documents``.
Equal rows, null and empty texts have the results that the operators state; an empty table passes
through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsengine.llm import decontaminate, jaccard, mixing, quality, sharding
from tsengine.llm.common import name, table, written
from tsengine.llm.labelled import in_fold

#: Documents that score less go. Lower than the 0.7 of the query: a doubtful document stays.
LEAST_QUALITY = 0.5
SHARDS = 16


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not reject."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~in_fold(4, 2))
    return quality.accepted(docs, model, LEAST_QUALITY)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every component of near copies: five-word shingles, Jaccard 0.8 or more."""
    return jaccard.one_of_each(docs, width=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by weight of what is left: a document appears as often as it is taken."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns, with ``shard`` and ``slot``."""
    order = [F.xxhash64(*[name(c) for c in mixing.hashable(docs)])]
    return sharding.shards(docs, SHARDS, order)


STAGES = [
    ("quality classifier", filter_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("mixing to target weights", mix_sources),
    ("sharding", shard),
]

#: A trained classifier, a balanced sample and a keyed permutation are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
