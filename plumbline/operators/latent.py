"""An offline text encoder: latent vectors by a randomised truncated SVD of the tf-idf matrix, with distributed products.

The vocabulary is the ``features`` terms that most documents hold (a parameter, so a matrix of terms is bounded by it).
Documents become sparse rows of tf-idf weights of length one, staged once. The range finder multiplies them with a random
matrix and back: a task adds up its part of ``A' (A V)`` batch by batch, parts are summed by term in Spark, and the
driver makes the columns orthonormal, ``features * (rank + oversample)`` numbers whatever the number of documents. Each
power iteration is one more such pass over all rows. A last pass sums the small matrix ``(A V)' (A V)``, whose
eigenvectors turn the basis into right singular vectors; a text's vector is the product of its weights with them.

Tasks are at most as many as the session runs at once, so what they send grows with the cluster, not with the data.

Cases: a null text has no terms; a text without known terms has the zero vector; a matrix of lower rank gives vectors
with zeros at the end; an empty table gives an encoder without terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.explain import document_frequency, idf
from plumbline.operators.extract import terms
from plumbline.session import python_ready, release, staged

#: Entries of the sparse rows that are multiplied at once.
ENTRIES = 20_000


@dataclass(frozen=True)
class Encoder:
    """Terms in order, their idf, and the right singular vectors (terms x rank) with the singular values."""

    vocabulary: list[str]
    idf: np.ndarray
    vectors: np.ndarray
    values: np.ndarray


def vocabulary(docs: DataFrame, id_col: str, text_col: str = "text", features: int = 65_536, least: int = 1) -> DataFrame:
    """term, df and idf of the ``features`` terms that most documents hold, at least ``least`` of them; ties by name."""
    n = docs.agg(F.count(F.lit(1)).cast("double").alias("_n"))
    found = document_frequency(docs, id_col, text_col).where(F.col("df") >= least).orderBy(F.desc("df"), "term").limit(features)
    return idf(found.join(F.broadcast(n)), F.col("_n")).drop("_n")


def _rows_of(batch: pa.RecordBatch, index: dict[str, int], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, places and weights of the sparse rows of a list column of terms; a row has length one."""
    offsets, places, values = [0], [], []
    for found in batch.column(1).to_pylist():
        known = [index[t] for t in found or () if t in index]
        place, times = np.unique(np.array(known, np.int64), return_counts=True)
        value = times * weights[place]
        places.append(place)
        values.append(value / np.linalg.norm(value) if len(value) else value)
        offsets.append(offsets[-1] + len(place))
    flat = [np.concatenate(x) if x else np.zeros(0) for x in (places, values)]
    return np.array(offsets), flat[0].astype(np.int64), flat[1].astype(np.float64)


def tfidf(docs: DataFrame, words: list[str], weights: np.ndarray, id_col: str, text_col: str = "text") -> DataFrame:
    """id, places (array<int>, of the vocabulary) and weights (array<double>): every row's tf-idf, of length one."""
    python_ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), terms(F.col(text_col)).alias("terms"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {w: i for i, w in enumerate(words)}
        for batch in batches:
            offsets, places, values = _rows_of(batch, index, weights)
            at = pa.array(offsets, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(places.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(values))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["id", "places", "weights"])

    return rows.mapInArrow(run, f"id {kind}, places array<int>, weights array<double>")


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Offsets, places and weights of a few rows at a time, about ``ENTRIES`` entries of (places, weights) columns."""
    places, weights = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
    offsets = np.concatenate([[0], np.cumsum(places.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
    flat, values = places.flatten().to_numpy(zero_copy_only=False), weights.flatten().to_numpy(zero_copy_only=False)
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + ENTRIES, "right")) - 1)
        a, b = offsets[first], offsets[last]
        yield offsets[first : last + 1] - a, flat[a:b], values[a:b]
        first = last


def _times(offsets: np.ndarray, places: np.ndarray, weights: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Sparse rows times a dense matrix."""
    out = np.zeros((len(offsets) - 1, matrix.shape[1]))
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = np.add.reduceat(matrix[places] * weights[:, None], offsets[full])
    return out


def _back(offsets: np.ndarray, places: np.ndarray, weights: np.ndarray, product: np.ndarray, out: np.ndarray) -> None:
    """Adds the transposed sparse rows times a dense matrix to ``out``."""
    if not len(places):
        return
    order = np.argsort(places, kind="stable")
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[order]
    first = np.concatenate([[0], np.flatnonzero(np.diff(places[order])) + 1])
    out[places[order][first]] += np.add.reduceat(product[owner] * weights[order][:, None], first)


def _summed(rows: DataFrame, matrix: np.ndarray, small: bool) -> np.ndarray:
    """``A' A V``, or with ``small`` ``(A V)' (A V)``, for the sparse rows A and a matrix V; parts are summed in Spark."""
    width = matrix.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((width if small else len(matrix), width))
        for batch in batches:
            for offsets, places, weights in _parts(batch):
                product = _times(offsets, places, weights, matrix)
                if small:
                    out += product.T @ product
                else:
                    _back(offsets, places, weights, product, out)
        used = np.flatnonzero(out.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(out[used, j]) for j in range(width))], ["row", *(f"c{j}" for j in range(width))])

    columns = [f"c{j}" for j in range(width)]
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = rows.select("places", "weights").coalesce(cores).mapInArrow(run, "row int, " + ", ".join(f"{c} double" for c in columns))
    found = parts.groupBy("row").agg(*[F.sum(c).alias(c) for c in columns]).toArrow()
    out = np.zeros((width if small else len(matrix), width))
    out[found.column("row").to_numpy()] = np.stack([found.column(c).to_numpy() for c in columns], axis=1) if found.num_rows else 0
    return out


def fit(
    docs: DataFrame, id_col: str, text_col: str = "text", rank: int = 64, oversample: int = 10, power_iterations: int = 2, features: int = 65_536, least: int = 2, seed: int = 0
) -> Encoder:
    """An encoder of ``rank`` dimensions from all rows of ``docs``."""
    encoder, rows = _fitted(docs, id_col, text_col, rank, oversample, power_iterations, features, least, seed)
    if rows is not None:
        release(rows)
    return encoder


def fit_and_encode(docs: DataFrame, id_col: str, text_col: str = "text", rank: int = 64, oversample: int = 10, power_iterations: int = 2, features: int = 65_536, least: int = 2, seed: int = 0) -> DataFrame:
    """:func:`encode` of the rows that the encoder is fitted to, from the sparse rows staged for it: texts are not read into terms again."""
    encoder, rows = _fitted(docs, id_col, text_col, rank, oversample, power_iterations, features, least, seed)
    return encode(docs, encoder, id_col, text_col) if rows is None else _vectors(rows, encoder)


def _fitted(docs: DataFrame, id_col: str, text_col: str, rank: int, oversample: int, power_iterations: int, features: int, least: int, seed: int) -> tuple[Encoder, DataFrame | None]:
    """The encoder and the staged sparse rows that it comes from (None without terms)."""
    python_ready(docs.sparkSession)
    kept = vocabulary(docs, id_col, text_col, features, least).toArrow()
    words, weights = kept.column("term").to_pylist(), kept.column("idf").to_numpy()
    width = min(rank + oversample, len(words))
    if not width:
        return Encoder([], np.zeros(0), np.zeros((0, rank)), np.zeros(rank)), None
    rows = staged(tfidf(docs, words, weights, id_col, text_col))
    basis = np.random.default_rng(seed).normal(size=(len(words), width))
    for _ in range(1 + power_iterations):
        basis, _ = np.linalg.qr(_summed(rows, basis, False))
    squares, turn = np.linalg.eigh(_summed(rows, basis, True))
    order = np.argsort(-squares)[:rank]
    values = np.sqrt(np.maximum(squares[order], 0))
    vectors = basis @ turn[:, order]
    # A vector's sign is free: its largest entry is positive.
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)
    vectors[:, values <= 1e-9 * values[0]] = 0
    pad = rank - len(order)
    return Encoder(words, weights, np.pad(vectors, ((0, 0), (0, pad))), np.pad(values, (0, pad))), rows


def encode(docs: DataFrame, encoder: Encoder, id_col: str, text_col: str = "text") -> DataFrame:
    """id and vector (array<double>) of every row: question and passage alike."""
    return _vectors(tfidf(docs, encoder.vocabulary, encoder.idf, id_col, text_col), encoder)


def _vectors(sparse: DataFrame, encoder: Encoder) -> DataFrame:
    """id and vector of sparse rows (id, places, weights)."""
    kind = sparse.schema["id"].dataType.simpleString()
    right, rank = encoder.vectors, encoder.vectors.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_times(*part, right) for part in _parts(batch)]
            flat = np.concatenate(parts).ravel() if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(flat), rank).cast(pa.list_(pa.float64()))], ["id", "vector"])

    return sparse.mapInArrow(run, f"id {kind}, vector array<double>")
