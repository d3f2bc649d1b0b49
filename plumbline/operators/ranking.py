"""Fusion, diversification, re-ranking and attribution of ranked lists.

A ranked list is a set of rows (query_id, ranker, id, score, rank); the rank is always a column. All operators work on
many queries at once and partition by query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import cut, python_ready

#: The constant of rank fusion in the pipeline, the balance of MMR, and sizes of pool and result.
RRF_K, LAMBDA, POOL, FINAL = 20, 0.6, 50, 10


def with_ranker(found: DataFrame, name: str, position: int) -> DataFrame:
    """A ranked list marked with its ranker's name and place among the rankers."""
    return found.withColumn("ranker", F.lit(name)).withColumn("ranker_pos", F.lit(position))


def both_rankers(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two ranked lists as one table of ranked rows."""
    return with_ranker(first, "first", 0).unionByName(with_ranker(second, "second", 1))


def fuse(ranked: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: query_id, id, rrf_score and rank; ties keep the order of first sight."""
    seen = F.min(F.struct("ranker_pos", "rank")).alias("seen")
    fused = ranked.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("rrf_score"), seen)
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "seen.ranker_pos", "seen.rank")
    return fused.select("query_id", "id", "rrf_score", F.row_number().over(order).alias("rank"))


def select_diverse(relevance: np.ndarray, vectors: np.ndarray, k: int, balance: float) -> tuple[list[int], list[float]]:
    """Places and scores that greedy MMR picks, in order; a running maximum keeps it linear in the pool for each pick."""
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)
    nearest, open_ = np.zeros(len(relevance)), np.ones(len(relevance), bool)
    picked: list[int] = []
    scores: list[float] = []
    for _ in range(min(k, len(relevance))):
        value = np.where(open_, np.round(balance * relevance - (1 - balance) * nearest, 12), -np.inf)
        at = int(np.argmax(value))  # the first of equal values: the better fused rank
        picked.append(at)
        scores.append(float(value[at]))
        open_[at] = False
        similar = unit @ unit[at]
        nearest = similar if len(picked) == 1 else np.maximum(nearest, similar)
    return picked, scores


def diversify(fused: DataFrame, vectors: DataFrame, k: int = FINAL, balance: float = LAMBDA, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Greedy maximal marginal relevance per query: query_id, id, rrf_score, mmr_score and rank.

    Relevance is scaled to 0..1 over all fused candidates; those without a vector are then left out. A pool (two lists
    of at most ``POOL``) is one group, so a group is bounded by the pool, not by the data.
    """
    python_ready(fused.sparkSession, 4096)
    span = Window.partitionBy("query_id")
    low, high = F.min("rrf_score").over(span), F.max("rrf_score").over(span)
    scaled = fused.withColumn("relevance", (F.col("rrf_score") - low) / F.when(high > low, high - low).otherwise(F.lit(1.0)))
    v = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where("vector IS NOT NULL")
    pool = scaled.join(v, "id")
    kinds = {f.name: f.dataType.simpleString() for f in fused.schema}

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank", ignore_index=True)
        at, scores = select_diverse(rows["relevance"].to_numpy(), np.stack(rows["vector"].to_numpy()).astype(float), k, balance)
        out = rows.loc[at, ["query_id", "id", "rrf_score"]].copy()
        out["mmr_score"], out["rank"] = scores, np.arange(1, len(at) + 1, dtype=np.int32)
        return out

    schema = f"query_id {kinds['query_id']}, id {kinds['id']}, rrf_score double, mmr_score double, rank int"
    return pool.select("query_id", "id", "rrf_score", "relevance", "rank", "vector").groupBy("query_id").applyInPandas(pick, schema)


def rerank(ranked: DataFrame, score: Column | None = None, top_k: int | None = None) -> DataFrame:
    """Ranks by ``score`` (default: one over the given rank, which passes the order through), ties by the given rank."""
    scored = ranked.withColumn("reranker_score", 1.0 / F.col("rank") if score is None else score)
    order = Window.partitionBy("query_id").orderBy(F.desc("reranker_score"), "rank")
    out = scored.withColumn("final_rank", F.row_number().over(order))
    return out if top_k is None else out.where(F.col("final_rank") <= top_k)


def late_interaction(ranked: DataFrame, query_tokens: DataFrame, chunk_tokens: DataFrame) -> DataFrame:
    """``ranked`` with ``interaction``: for each token of the query its best product with a token of the chunk, summed.

    ``query_tokens`` (query_id, tokens) and ``chunk_tokens`` (id, tokens) hold matrices (array<array<double>>), one row for a
    query or chunk. Only rows of the pool meet their matrices, by two joins; each pair is one product of two matrices in
    an Arrow batch. Without tokens on either side the score is 0.
    """
    python_ready(ranked.sparkSession, 512)
    names = ranked.columns
    q = query_tokens.select("query_id", F.col("tokens").cast("array<array<double>>").alias("_asked"))
    c = chunk_tokens.select("id", F.col("tokens").cast("array<array<double>>").alias("_held"))
    pool = ranked.join(c, "id", "left").join(q, "query_id", "left").select(*names, "_asked", "_held")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked, held = (batch.column(len(names) + k).to_pylist() for k in (0, 1))
            scores = [float((np.array(a) @ np.array(h).T).max(axis=1).sum()) if a and h else 0.0 for a, h in zip(asked, held)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(scores, pa.float64())], [*names, "interaction"])

    return pool.mapInArrow(run, ranked.schema.add("interaction", "double"))


def attribute(ranked: DataFrame, chunks: DataFrame, id_col: str, defaults: dict) -> DataFrame:
    """Ranked rows with the columns of ``defaults`` from ``chunks`` by one left join; missing values get the defaults."""
    c = chunks.select(F.col(id_col).alias("_id"), *[F.col(n).alias(f"_{n}") for n in defaults])
    joined = ranked.join(c, F.col("id") == F.col("_id"), "left")
    return joined.select(*ranked.columns, *[F.coalesce(f"_{n}", F.lit(v)).alias(n) for n, v in defaults.items()])


def distinct_first(ranked: DataFrame, group: list[str], key: Column | str, k: int, skip_empty: bool = False) -> DataFrame:
    """Within the first ``k`` ranks of each list, the best row of each key, ranked anew (column ``case_rank``)."""
    rows = ranked.where(F.col("rank") <= k).withColumn("case_id", F.col(key) if isinstance(key, str) else key)
    if skip_empty:
        rows = rows.where(F.col("case_id").isNotNull() & (F.col("case_id").cast("string") != ""))
    best = rows.groupBy(*group, "case_id").agg(F.min("rank").alias("rank"))
    return best.withColumn("case_rank", F.row_number().over(Window.partitionBy(*group).orderBy("rank")))


def compare_sets(lists: DataFrame, names: list[str]) -> DataFrame:
    """Per query: the size of every list and of the intersection of every two (columns n_a, n_a_b)."""
    flags = [F.max((F.col("ranker") == n).cast("int")).alias(f"_{n}") for n in names]
    seen = lists.groupBy("query_id", "id").agg(*flags)
    sizes = [F.sum(f"_{n}").alias(f"n_{n}") for n in names]
    shared = [F.sum(F.col(f"_{a}") * F.col(f"_{b}")).alias(f"n_{a}_{b}") for i, a in enumerate(names) for b in names[i + 1 :]]
    return seen.groupBy("query_id").agg(*sizes, *shared)


_COMPARE: dict[str, Callable[[Column, object], Column]] = {
    "$eq": lambda c, v: c == v,
    "$ne": lambda c, v: c != v,
    "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v,
    "$lte": lambda c, v: c <= v,
    "$in": lambda c, v: c.isin(list(v)),
    "$nin": lambda c, v: ~c.isin(list(v)),
}


def metadata_filter(where: dict | None) -> Column | None:
    """A nested filter dictionary as one column expression, which Catalyst pushes to the scan."""
    if not where:
        return None
    parts = []
    for key, value in where.items():
        if key in ("$and", "$or"):
            inner = [metadata_filter(w) for w in value]
            parts.append(reduce((lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b), inner))
        elif isinstance(value, dict):
            parts += [_COMPARE[op](F.col(key), v) for op, v in value.items()]
        else:
            parts.append(F.col(key) == value)
    return reduce(lambda a, b: a & b, parts)


MODES = ("full", "first_only", "second_only", "hybrid_no_mmr", "hybrid_no_reranker")


def retrieve_modes(
    first: DataFrame, second: DataFrame, vectors: DataFrame, modes: tuple[str, ...] = MODES, top_k: int = FINAL, k: int = RRF_K, balance: float = LAMBDA, score: Column | None = None, **names
) -> DataFrame:
    """The query pipeline and its ablations: mode, query_id, id, score, rank; what several modes need is computed once.

    Modes: full (fusion, MMR, re-ranker), hybrid_no_reranker, hybrid_no_mmr, first_only, second_only. ``score`` is the
    re-ranker's.
    """
    parts = [own.where(F.col("rank") <= top_k).select(F.lit(mode).alias("mode"), "query_id", "id", "score", "rank") for mode, own in (("first_only", first), ("second_only", second)) if mode in modes]
    hybrid = [m for m in modes if m not in ("first_only", "second_only")]
    fused = fuse(both_rankers(first, second), k) if hybrid else None
    fused = cut(fused) if len(hybrid) > 1 else fused
    if "hybrid_no_mmr" in modes:
        parts.append(fused.where(F.col("rank") <= top_k).select(F.lit("hybrid_no_mmr").alias("mode"), "query_id", "id", F.col("rrf_score").alias("score"), "rank"))
    if {"full", "hybrid_no_reranker"} & set(modes):
        chosen = diversify(fused, vectors, top_k, balance, **names)
        chosen = cut(chosen) if {"full", "hybrid_no_reranker"} <= set(modes) else chosen
        if "hybrid_no_reranker" in modes:
            parts.append(chosen.select(F.lit("hybrid_no_reranker").alias("mode"), "query_id", "id", F.col("mmr_score").alias("score"), "rank"))
        if "full" in modes:
            parts.append(rerank(chosen, score).select(F.lit("full").alias("mode"), "query_id", "id", F.col("reranker_score").alias("score"), F.col("final_rank").alias("rank")))
    return reduce(DataFrame.unionByName, parts)


def retrieve(first: DataFrame, second: DataFrame, vectors: DataFrame, top_k: int = FINAL, k: int = RRF_K, balance: float = LAMBDA, mode: str = "full", **names) -> DataFrame:
    """One of :func:`retrieve_modes`: query_id, id, score, rank."""
    return retrieve_modes(first, second, vectors, (mode,), top_k, k, balance, **names).drop("mode")
