"""A written full-text index: postings by term, so that a search reads those of its terms and never a text."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import B, K1

WORD = r"[\p{L}\p{N}]+"


def postings(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(term, id, tf, len): how often each word, lower-cased, is in each document of len words. Rows that repeat an id count together.

    The words of a row are counted before anything is shuffled, so what travels is a row per distinct word of a document."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(WORD), F.lit(0))
    rows = docs.select(F.col(id_col).alias("id"), words.alias("w")).select("id", F.size("w").alias("len"), F.explode("w").alias("term"))
    return rows.groupBy("term", "id", "len").agg(F.count("*").alias("tf")).select("term", "id", "tf", "len")


@dataclass
class TextIndex:
    """An index in a folder: `postings` in the order of term and id, `totals` with the number of documents and words."""

    path: str

    def write(self, docs: DataFrame, id_col: str = "id", text_col: str = "text") -> TextIndex:
        """Indexes docs, whose texts are read here and at no search. Ranges of (term, id) go to a file each, so a term of very many
        documents spreads over files, and a reader of one term skips the others by their bounds."""
        found = postings(docs, id_col, text_col)
        found.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("overwrite").parquet(f"{self.path}/postings")
        words = F.size(F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(WORD), F.lit(0)))
        docs.select(words.alias("len")).agg(F.count("*").alias("n"), F.avg("len").alias("avg_len")).write.mode("overwrite").parquet(f"{self.path}/totals")
        return self

    def search(self, spark: SparkSession, terms: list[str], limit: int = 20, prefix: bool = True) -> DataFrame:
        """(id, score): the documents with any of the terms (prefixes of words) by BM25, best first, then by id; no terms find nothing."""
        wanted = [t.lower() for t in terms]
        fits = lambda t: F.col("term").startswith(t) if prefix else F.col("term") == t
        any_of: Column = reduce(lambda a, b: a | b, [fits(t) for t in wanted], F.lit(False))
        rows = spark.read.parquet(f"{self.path}/postings").filter(any_of)
        counts = [F.coalesce(F.sum(F.when(fits(t), F.col("tf"))), F.lit(0)).alias(f"f{i}") for i, t in enumerate(wanted)]
        hits = rows.groupBy("id", "len").agg(F.count("*").alias("words"), *counts)
        seen = hits.agg(F.count("*").alias("met"), *[F.count(F.when(F.col(f"f{i}") > 0, 1)).alias(f"d{i}") for i in range(len(wanted))])
        stats = seen.crossJoin(spark.read.parquet(f"{self.path}/totals"))  # one row each
        score = F.lit(0.0)
        for i in range(len(wanted)):
            f, df = F.col(f"f{i}"), F.col(f"d{i}")
            idf = F.log((F.col("n") - df + 0.5) / (df + 0.5))
            gain = F.when(idf <= 0, 1e-6).otherwise(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
            score = score + F.when(f > 0, gain).otherwise(0.0)
        found = hits.crossJoin(F.broadcast(stats)).select("id", score.alias("score"))
        return found.orderBy(F.desc("score"), "id").limit(limit)
