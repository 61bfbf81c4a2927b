"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source's target rate is the mean number of copies of each of its documents. A document's uniform
number comes from a hash of seed and id, the inverted Poisson distribution makes it a count, and
the copies are dealt out and ordered by a hash of seed, id and copy: the same at every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table


def _uniform(*parts: Column) -> Column:
    """52 bits of an MD5 as a number from 0 up to 1."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def rates(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, power: float = 0.5, source_col: str = "source") -> DataFrame:
    """source, n_docs, rate and cdf (the Poisson distribution function at 0, 1, ...), one row per source.

    weights: target shares by source (a source that is missing gets none); None: shares in
    proportion to n_docs ** power. total: documents wanted on average; None: as many as there are.
    """
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("n_docs"))
    if weights is None:
        share = F.pow(F.col("n_docs").cast("double"), F.lit(power))
    else:
        share = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("source")), F.lit(0.0)) if weights else F.lit(0.0)
    sizes = sizes.select("source", "n_docs", share.alias("share"))
    sums = sizes.agg(F.sum("share").alias("all_shares"), F.sum("n_docs").alias("all_docs"))
    wanted = F.lit(float(total)) if total is not None else F.col("all_docs")
    # One row of sums beside the few rows of sources.
    rate = F.when(F.col("all_shares") > 0, wanted * F.col("share") / F.col("all_shares") / F.col("n_docs")).otherwise(0.0)
    rated = sizes.crossJoin(F.broadcast(sums)).select("source", "n_docs", rate.alias("rate"))
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int")
    upto = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    terms = rated.select("*", F.explode(F.sequence(F.lit(0), last)).alias("k")).select(
        "*", F.sum(F.log(F.greatest("k", F.lit(1)).cast("double"))).over(upto).alias("log_fact")
    )
    mass = F.when(F.col("rate") > 0, F.exp(F.col("k") * F.log("rate") - F.col("rate") - F.col("log_fact"))).otherwise(1.0)
    cdf = terms.select("source", "n_docs", "rate", "k", F.sum(mass).over(upto).alias("cdf"))
    return cdf.groupBy("source", "n_docs", "rate").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("k", "cdf"))), lambda x: x["cdf"]).alias("cdf")
    )


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None, power: float = 0.5, seed: int = 42, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs' columns and copy (1, 2, ...), each row as often as its Poisson count says, in hash order.

    A null source is a source of its own, a null id hashes as an empty one; repeated rows of an id
    get the same count. A column named copy is replaced, other columns stay, whatever their names. An
    empty table gives an empty result; texts, null, empty or long, are carried as they are. The rates table has a row per source; it is
    broadcast only if Spark finds its written size under the broadcast threshold.
    """
    # Helper columns under names that docs has not, whatever it has.
    mark = "_" * (1 + max((len(c) - len(c.lstrip("_")) for c in docs.columns), default=0))
    its_source, cdf, n, place = (f"{mark}{x}" for x in ("source", "cdf", "n", "order"))
    by_source = materialise(rates(docs, weights, total, power, source_col)).select(F.col("source").alias(its_source), F.col("cdf").alias(cdf))
    columns = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "copy"]
    ident = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    counted = docs.select(*columns).join(by_source, F.col(f"`{source_col}`").eqNullSafe(F.col(its_source)))
    u = _uniform(F.lit(str(seed)), ident)
    # The counts' steps that lie at or below u; the last step is 1 up to rounding.
    times = F.size(F.filter(cdf, lambda c: c <= u))
    copies = counted.select(*columns, times.alias(n)).filter(F.col(n) > 0).select(*columns, F.explode(F.sequence(F.lit(1), F.col(n))).alias("copy"))
    order = F.md5(F.concat_ws("|", F.lit(str(seed + 1)), ident, F.col("copy").cast("string")))
    dealt = copies.select(*columns, "copy", order.alias(place)).repartition(place).sortWithinPartitions(place)
    return dealt.drop(place)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replicate(table(spark, sf_dir, "documents"))


ORACLE = """
WITH sizes AS (SELECT source, count(*) AS n_docs, sqrt(count(*)) AS share FROM documents GROUP BY source),
rated AS (
  SELECT source, (SELECT sum(n_docs) FROM sizes) * share / (SELECT sum(share) FROM sizes) / n_docs AS rate FROM sizes),
terms AS (
  SELECT source, rate, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS mass
  FROM rated, range(0, 400) AS r(k) WHERE k <= ceil(rate + 12 * sqrt(rate) + 30)),
steps AS (SELECT source, k, sum(mass) OVER (PARTITION BY source ORDER BY k) AS cdf FROM terms),
counted AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars,
         (SELECT count(*) FROM steps s WHERE s.source IS NOT DISTINCT FROM d.source
            AND s.cdf <= ('0x' || substr(md5('42|' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13))::BIGINT / pow(2, 52)) AS n
  FROM documents d)
SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(1, n + 1)) AS INTEGER) AS copy FROM counted WHERE n > 0
"""
