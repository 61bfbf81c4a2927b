"""Registry of the reference operators' queries over the driver tables, and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import assessment, casebook, causes, codegraph, incident, ingest, investigation, observability, overview, ranking, recall, resolution, rulebook, searching, sources

_MODULES = [observability, codegraph, searching, investigation, ingest, rulebook, recall, casebook, causes, sources, resolution, overview, assessment, incident, ranking]
QUERIES: dict = {k: f for m in _MODULES for k, f in m.query.queries.items()}
ORACLES: dict[str, str] = {k: s for m in _MODULES for k, s in m.query.oracles.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked causes of an investigation over all evidence."""
    return investigation.investigate(spark, sf_dir)
