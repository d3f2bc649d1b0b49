"""All queries of the library by name, with SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.operators import ranking
from plumbline.plans import corpus, counterfactual, records, relational, retrieval
from plumbline.session import table

_PARTS = (retrieval, corpus, counterfactual, records, relational)

QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rankers over all vectors, fused; the first ten of each query with their documents."""
    top = retrieval.fused(spark, sf_dir).where("rank <= 10")
    return ranking.attribute(top, table(spark, sf_dir, "documents"), "doc_id", {"source": "", "lang": "Unknown", "n_chars": 0})
