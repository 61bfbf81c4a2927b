"""The corpus pipeline: stages over documents, each one operator of tracewell.llm.

Each stage takes the session, documents and the tables' folder and returns documents; the last
returns token ids. Each is written as Parquet and reread as the next one's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.bpe import default_tokenizer, encode
from tracewell.llm.common import materialise, table
from tracewell.llm.exact_dedup import exact_duplicates
from tracewell.llm.mixing import replicate
from tracewell.llm.quality import keep_good
from tracewell.llm.similar import similar_documents

#: SQL cannot express the stages' models, hashes and tokenizer.
ORACLE_SQL = None


def _first(docs: DataFrame, groups: Callable[[DataFrame, str], DataFrame], group: str) -> DataFrame:
    """Of each group, the row with the smallest doc_id, null ids last and ties by the row's own key; groups gets the
    rows and the name of that key, which no column of docs has, and returns the key and the column group."""
    key = "_row"
    while key in {c.lower() for c in docs.columns}:
        key = f"_{key}"
    keyed = materialise(docs.withColumn(key, F.monotonically_increasing_id()))
    place = keyed.select(key, F.struct(F.col("doc_id").isNull(), "doc_id", F.col(key).alias("key")).alias("at"))
    stays = groups(keyed, key).select(key, group).join(place, key).groupBy(group).agg(F.min("at")["key"].alias(key))
    return keyed.join(stays.select(key), key, "left_semi").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps; it is fitted on this stage's own input. Null and empty texts are judged like any other, and
    rows of one text alike."""
    return keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, null as empty, the row with the smallest doc_id stays."""
    return _first(docs, exact_duplicates, "keep_id")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of Jaccard similarity 0.8 or more (sets of 5-word shingles) join, the one with the smallest doc_id stays.
    SimHash names the close candidates, bands of minima those beyond its radius, and the sets confirm.
    A pair of exactly 0.8 is a candidate with a probability of 1 - 5e-6, a closer one with more; texts without words are alike."""
    return _first(docs, lambda rows, key: similar_documents(rows, id_col=key), "component_id")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target rate makes them occur; copies are equal rows. A null source is one of its own,
    a null id draws like an empty one."""
    return replicate(docs).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every row; a null text is empty."""
    return encode(docs, default_tokenizer())


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("near-dedup", near),
    ("source mixing", mix),
    ("bpe encoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
