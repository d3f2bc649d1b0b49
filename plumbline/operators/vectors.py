"""Exact vector search: a stated query set against all vectors, in blocks.

The query vectors are a small matrix that every task gets; each Arrow batch of vectors is a few matrix products, of which
a task keeps the best ``k`` per query over all its batches; only these leave it. The shuffle then carries ``tasks * queries * k`` short rows at most,
whatever the number of vectors, and a window per query picks the final ranking.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import cut, python_ready

#: Queries in one matrix, and matrices that one reading of the vectors is compared with; larger query sets take more readings.
QUERY_BLOCK, BLOCKS = 2048, 16
#: Decimals that scores are compared in, so that equal vectors tie whatever block they fall into.
DECIMALS = 9
#: Rows that are multiplied with a matrix of queries at once, and rows that a task keeps at most before it lets them go.
SLICE, HELD = 1024, 4_000_000


def matrix(column: pa.Array, dims: tuple[int, int] | None, width: int | None = None) -> np.ndarray:
    """Rows of an Arrow list column as a matrix of a width (default: the longest row's); a row that is null or of another length becomes zeros."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    if width is None:
        width = int(lengths.max()) if len(lengths) else 0
    if len(lengths) and (lengths == width).all() and column.null_count == 0:
        out = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lengths), width)
    else:
        out = np.zeros((len(lengths), width))
        for i, row in enumerate(column.to_pylist()):
            if row is not None and len(row) == width:
                out[i] = row
    return out if dims is None else out[:, dims[0] : dims[1]]


def normalised(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; zero rows stay zero, so that their cosine is 0."""
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best scores, ties by id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _search(blocks: list[tuple[list, np.ndarray]], k: int, cosine: bool, dims: tuple[int, int] | None, width: int):
    """A task's rows to the best ``k`` of each query among them; only rows that reach a query's last kept score are looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = [np.zeros(0)] * 2
        held = [[none] * len(names) for names, _ in blocks]
        least = [np.full(len(names), -np.inf) for names, _ in blocks]

        def leave(b: int) -> pa.RecordBatch:
            names, found = blocks[b][0], held[b]
            which = np.repeat(np.arange(len(names)), [len(x[0]) for x in found])
            some = [x for x in found if len(x[0])]
            columns = [pa.array([names[i] for i in which]), pa.array(np.concatenate([x[1] for x in some])), pa.array(np.concatenate([x[0] for x in some]))]
            held[b] = [none] * len(names)
            least[b][:] = -np.inf
            return pa.RecordBatch.from_arrays(columns, ["query_id", "id", "score"])

        for batch in batches:
            rows = matrix(batch.column(1), dims, width)
            rows = normalised(rows) if cosine else rows
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for b, (_, queries) in enumerate(blocks):
                for first in range(0, len(rows), SLICE):
                    own = ids[first : first + SLICE]
                    scores = queries @ rows[first : first + SLICE].T
                    np.round(scores, DECIMALS, out=scores)
                    scores += 0.0
                    for i in np.flatnonzero(scores.max(axis=1) >= least[b]):
                        new = np.flatnonzero(scores[i] >= least[b][i])
                        kept = held[b][i]
                        both = [scores[i, new], own[new]] if not len(kept[0]) else [np.concatenate([kept[0], scores[i, new]]), np.concatenate([kept[1], own[new]])]
                        at = best(*both, k)
                        held[b][i] = [x[at] for x in both]
                        least[b][i] = both[0][at[-1]] if len(at) == k else -np.inf
            if sum(len(x[0]) for part in held for x in part) > HELD:
                yield from (leave(b) for b in range(len(blocks)) if any(len(x[0]) for x in held[b]))
        yield from (leave(b) for b in range(len(blocks)) if any(len(x[0]) for x in held[b]))

    return run


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 50,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    metric: str = "cosine",
    dims: tuple[int, int] | None = None,
    where: Column | None = None,
) -> DataFrame:
    """query_id, id, score and rank (from 1) of the ``k`` best vectors for every row of ``queries`` (query_id, vector).

    ``metric``: ``cosine`` or ``dot``; ``dims``: a range of dimensions to use; ``where``: a filter on ``vectors``, pushed
    to their scan. Ties go to the smaller id. Zero vectors have cosine 0. The longest query tells the width: queries and
    vectors that are null or of another length are left out.
    """
    spark = vectors.sparkSession
    python_ready(spark, 4096)
    rows = vectors if where is None else vectors.where(where)
    rows = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).where(F.col("id").isNotNull())
    kinds = queries.schema["query_id"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()
    wanted = queries.select("query_id", F.col("vector").cast("array<double>")).where("query_id IS NOT NULL AND vector IS NOT NULL")
    width, n = wanted.agg(F.max(F.size("vector")), F.count(F.lit(1))).first()
    wanted = wanted.where(F.size("vector") == F.lit(width))
    rows = rows.where(F.size("vector") == F.lit(width))
    readings = -(-n // (QUERY_BLOCK * BLOCKS))
    parts = []
    for reading in range(readings):
        own = wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(readings)) == reading) if readings > 1 else wanted
        table = own.toArrow()
        if not table.num_rows:
            continue
        q = matrix(table.column("vector").combine_chunks(), dims, width)
        q = normalised(q) if metric == "cosine" else q
        names = table.column("query_id").to_pylist()
        blocks = [(names[i : i + QUERY_BLOCK], q[i : i + QUERY_BLOCK]) for i in range(0, len(names), QUERY_BLOCK)]
        parts.append(rows.mapInArrow(_search(blocks, k, metric == "cosine", dims, width), f"query_id {kinds[0]}, id {kinds[1]}, score double"))
    if not parts:
        return spark.createDataFrame([], T.StructType.fromDDL(f"query_id {kinds[0]}, id {kinds[1]}, score double, rank int"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def filter_share(rows: DataFrame, where: Column, id_col: str, sample: int = 10_000, risk: float = 0.01) -> tuple[float, float]:
    """Bounds of the share of rows that pass a filter, from about ``sample`` rows chosen by a hash of their id.

    By Hoeffding's inequality the share lies outside with a probability of ``risk`` at most.
    """
    total = rows.count()
    shares = max(1, total // sample)
    some = rows.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(2)), F.lit(shares)) == 0)
    n, passed = some.agg(F.count(F.lit(1)), F.count_if(where)).first()
    if not n:
        return 0.0, 1.0
    error = 0.0 if shares == 1 else math.sqrt(math.log(2 / risk) / (2 * n))
    return max(0.0, passed / n - error), min(1.0, passed / n + error)


def staged_search(
    vectors: DataFrame, queries: DataFrame, where: Column, k: int = 50, threshold: float = 0.5, sample: int = 10_000, id_col: str = "vec_id", **options
) -> DataFrame:
    """Like :func:`top_k` with a filter, in the order that fits the filter's selectivity; the rows are the same.

    A filter that surely keeps at most ``threshold`` of the rows goes first, to the scan. Otherwise the search goes first,
    for as many rows as should leave ``k``, and the filter after it; queries that end with fewer search again for twice as
    many, until they have ``k`` rows or have seen all.
    """
    low, high = filter_share(vectors, where, id_col, sample)
    if high <= threshold or low <= 0:
        return top_k(vectors, queries, k, id_col, where=where, **options)
    total = vectors.count()
    passing = vectors.where(where).select(F.col(id_col).alias("id"))
    wanted, open_, found = min(total, math.ceil(k / low)), queries, None
    while True:
        part = cut(top_k(vectors, open_, wanted, id_col, **options).join(passing, "id", "left_semi"))
        counts = part.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
        done = counts.where(F.lit(wanted >= total) | (F.col("_n") >= k)).select("query_id")
        ended = part.join(done, "query_id", "left_semi")
        found = ended if found is None else found.unionByName(ended)
        if wanted >= total:
            break
        open_ = cut(open_.join(done, "query_id", "left_anti"))
        if open_.isEmpty():
            break
        wanted = min(total, 2 * wanted)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.select("query_id", "id", "score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def half_cosine(found: DataFrame) -> DataFrame:
    """Scores of the second ranker: (1 + cosine) / 2, which is 1 minus half the cosine distance."""
    return found.withColumn("score", (1 + F.col("score")) / 2)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vector columns; 0 where one of them is zero or null."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    total = lambda v, w: F.aggregate(F.zip_with(v, w, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
    norms = F.sqrt(total(x, x)) * F.sqrt(total(y, y))
    return F.coalesce(F.when(norms == 0, F.lit(0.0)).otherwise(total(x, y) / norms), F.lit(0.0))


def hashed_encoder(text: Column, size: int = 64) -> Column:
    """A deterministic stand-in for a model: counts of words by the hash of the word, as an array<double>."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    slots = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(size)).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))
