"""Approximate vector search: an inverted file of quantised residuals, with exact scores for the best candidates.

An index is a Parquet table partitioned by list (the nearest centroid), whose rows hold the id, a code of one byte per
part and the vector, beside a small table of the quantiser. Centroids and the codewords of the residuals' parts are fitted
by mini-batch k-means: every round reads a sample of rows chosen by a hash of the id, sums them up by nearest codeword in
the tasks, and moves each codeword by the share that the round has in all rows it has seen. The sample that starts the
codewords and the rows of a round are bounded by parameters; every row is indexed.

A search reads the probed lists only (partition pruning) and of them first ids and codes: a query's distance table holds
its product with every codeword, so the score of a row is one sum of looked-up numbers. The best candidates of each query
then get exact scores from their vectors, again from the probed lists. How many lists a search needs depends on how far
the vectors lie in clusters, so it is measured when the index is built: a bounded sample of the vectors is searched
exactly, and the index remembers the least number of lists that holds the wished share of these neighbours. Where the
nearest lists hold fewer than ``k`` rows a query probes further ones, so that it gets ``k`` rows whenever there are any.

Cases: vectors that are null or of another length than the index are left out; zero vectors have cosine 0; repeated ids
are rows of their own; an empty table gives an index without rows. The exact search (``vectors.top_k``) stays beside it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.operators.vectors import DECIMALS, best, matrix, normalised, top_k
from plumbline.session import cut, python_ready, shared_folder

#: Queries whose distance tables one reading of the codes holds; more queries take more readings.
QUERY_BLOCK = 2048
#: Candidates (query, list, id) that are broadcast to the vectors; more are joined by a shuffle.
BROADCAST_CANDIDATES = 500_000


@dataclass(frozen=True)
class Quantizer:
    """Centroids (lists x width) and codewords of residuals (parts x codes x width of a part)."""

    centroids: np.ndarray
    codewords: np.ndarray
    cosine: bool
    width: int  #: of the vectors; centroids are padded to a multiple of the parts

    def prepared(self, rows: np.ndarray) -> np.ndarray:
        rows = normalised(rows) if self.cosine else rows
        return np.pad(rows, ((0, 0), (0, self.centroids.shape[1] - rows.shape[1])))

    def lists_of(self, rows: np.ndarray) -> np.ndarray:
        return nearest(rows, self.centroids)

    def residual_parts(self, rows: np.ndarray, lists: np.ndarray) -> np.ndarray:
        return (rows - self.centroids[lists]).reshape(len(rows), len(self.codewords), -1)


@dataclass(frozen=True)
class Index:
    """Where an index lies, its quantiser, and the number of rows in each list."""

    spark: SparkSession = field(repr=False)
    path: str
    quantizer: Quantizer = field(repr=False)
    sizes: np.ndarray = field(repr=False)
    nprobe: int
    id_kind: str

    def rows(self) -> DataFrame:
        """id, code, vector and list."""
        return _indexed(self.spark, self.path, self.id_kind)


def _indexed(spark: SparkSession, path: str, id_kind: str) -> DataFrame:
    return spark.read.schema(f"id {id_kind}, code binary, vector array<double>, list int").parquet(f"{path}/lists")


def nearest(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Number of the nearest center of every row, the first of equals."""
    return np.argmin((centers**2).sum(axis=1) - 2 * (rows @ centers.T), axis=1)


def spread_out(rows: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """``k`` of the rows, each drawn with the square of its distance from those before; rows repeat if there are too few."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(rows)))]
    distance = ((rows - rows[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k:
        total = distance.sum()
        at = int(np.searchsorted(np.cumsum(distance), rng.random() * total)) if total > 0 else int(rng.integers(len(rows)))
        chosen.append(min(at, len(rows) - 1))
        distance = np.minimum(distance, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
    return rows[chosen]


def _batch_sums(quantizer: Quantizer, residuals: bool):
    """Sums and numbers of a task's rows by part and nearest codeword, one row per dimension (-1 for the number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = quantizer.codewords if residuals else quantizer.centroids[None]
        sums, numbers = np.zeros(words.shape), np.zeros(words.shape[:2])
        for batch in batches:
            rows = quantizer.prepared(matrix(batch.column(0), None, quantizer.width))
            parts = quantizer.residual_parts(rows, quantizer.lists_of(rows)) if residuals else rows[:, None]
            for p in range(len(words)):
                own = nearest(parts[:, p], words[p])
                np.add.at(sums[p], own, parts[:, p])
                numbers[p] += np.bincount(own, minlength=words.shape[1])
        part, word = np.nonzero(numbers)
        values = np.concatenate([numbers[part, word][:, None], sums[part, word]], axis=1)
        count, width = values.shape
        columns = [np.repeat(part, width), np.repeat(word, width), np.tile(np.arange(-1, width - 1), count)]
        yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in columns), pa.array(values.ravel())], ["part", "word", "dim", "value"])

    return run


def _fitted(rows: DataFrame, total: int, quantizer: Quantizer, residuals: bool, rounds: int, batch_rows: int) -> np.ndarray:
    """Codewords after ``rounds`` of mini-batches; each round's rows are those whose hash falls to it."""
    words = quantizer.codewords.copy() if residuals else quantizer.centroids[None].copy()
    seen = np.zeros(words.shape[:2])
    shares = max(1, total // batch_rows)
    for k in range(rounds):
        batch = rows.where(F.pmod(F.xxhash64("id", F.lit(k // shares)), F.lit(shares)) == k % shares)
        now = Quantizer(quantizer.centroids if residuals else words[0], words if residuals else quantizer.codewords, quantizer.cosine, quantizer.width)
        counted = batch.select("vector").mapInArrow(_batch_sums(now, residuals), "part int, word int, dim int, value double")
        found = counted.groupBy("part", "word", "dim").agg(F.sum("value").alias("value")).toArrow()
        part, word, dim, value = (found.column(i).to_numpy() for i in range(4))
        sums, numbers = np.zeros(words.shape), np.zeros(words.shape[:2])
        whole = dim < 0
        numbers[part[whole], word[whole]] = value[whole]
        sums[part[~whole], word[~whole], dim[~whole]] = value[~whole]
        seen += numbers
        moved = numbers > 0
        mean = sums[moved] / numbers[moved][:, None]
        words[moved] += (mean - words[moved]) * (numbers[moved] / seen[moved])[:, None]
    return words


def _coded(quantizer: Quantizer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = quantizer.prepared(matrix(batch.column(1), None, quantizer.width))
            lists = quantizer.lists_of(rows)
            parts = quantizer.residual_parts(rows, lists)
            codes = np.stack([nearest(parts[:, p], quantizer.codewords[p]) for p in range(parts.shape[1])], axis=1).astype(np.uint8)
            columns = [pa.array(lists.astype(np.int32)), batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(1)]
            yield pa.RecordBatch.from_arrays(columns, ["list", "id", "code", "vector"])

    return run


def build(
    vectors: DataFrame,
    path: str | None = None,
    lists: int | None = None,
    parts: int = 16,
    codes: int = 256,
    metric: str = "cosine",
    rounds: int = 8,
    batch_rows: int = 100_000,
    sample: int = 8_192,
    recall: float = 0.97,
    judges: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> Index:
    """Fits a quantiser and writes every vector to its list; ``path`` defaults to a folder that goes with the session.

    ``lists`` defaults to the square root of the number of vectors; ``sample`` rows (twice the lists at least) start the
    codewords, ``batch_rows`` of them at most move them in each of the ``rounds``. ``judges`` vectors tell how many lists
    hold the share ``recall`` of their ten nearest. Files of a list are as large as Spark
    makes partitions, so a list that draws many vectors gets many files.
    """
    spark = vectors.sparkSession
    python_ready(spark, 4096)
    path = path or shared_folder(spark, "index")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL")
    width, _ = rows.agg(F.max(F.size("vector")), F.count(F.lit(1))).first()
    width = max(1, width or 1)
    rows = rows.where(F.size("vector") == width)
    total = rows.count()
    lists = lists or max(1, min(65_536, round(total**0.5)))
    parts = min(parts, width)
    padded = -(-width // parts) * parts
    first = matrix(rows.orderBy(F.xxhash64("id", F.lit(0)), "id").limit(max(sample, 2 * lists)).select("vector").toArrow().column(0).combine_chunks(), None, width)
    empty = Quantizer(np.zeros((1, padded)), np.zeros((parts, 1, padded // parts)), metric == "cosine", width)
    quantizer = empty
    if total:
        first = empty.prepared(first)
        quantizer = Quantizer(spread_out(first, min(lists, total)), empty.codewords, empty.cosine, width)
        quantizer = Quantizer(_fitted(rows, total, quantizer, False, rounds, batch_rows)[0], empty.codewords, empty.cosine, width)
        residuals = quantizer.residual_parts(first, quantizer.lists_of(first))
        words = np.stack([spread_out(residuals[:, p], min(codes, total), p) for p in range(parts)])
        quantizer = Quantizer(quantizer.centroids, words, empty.cosine, width)
        quantizer = Quantizer(quantizer.centroids, _fitted(rows, total, quantizer, True, rounds, batch_rows), empty.cosine, width)
    kind = rows.schema["id"].dataType.simpleString()
    coded = rows.mapInArrow(_coded(quantizer), f"list int, id {kind}, code binary, vector array<double>")
    coded.hint("rebalance", F.col("list")).sortWithinPartitions("list", "id").write.partitionBy("list").parquet(f"{path}/lists")
    nprobe = _needed_lists(rows, _indexed(spark, path, kind), quantizer, recall, judges) if total else 1
    _save(spark, quantizer, path, nprobe, kind)
    return load(spark, path)


def _needed_lists(rows: DataFrame, indexed: DataFrame, quantizer: Quantizer, share: float, judges: int, k: int = 10) -> int:
    """The least number of lists that holds ``share`` of the neighbours of a sample of vectors, found by the exact search."""
    asked = rows.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(judges).select(F.col("id").alias("query_id"), "vector")
    asked = cut(asked)
    exact = top_k(rows, asked, k + 1, "id", "vector", "cosine" if quantizer.cosine else "dot").where("id <> query_id").select("query_id", "id")
    placed = indexed.select("id", "list").join(F.broadcast(exact), "id").select("query_id", "list").join(asked, "query_id").toArrow()  # judges * k rows
    if not placed.num_rows:
        return 1
    rows_of = quantizer.prepared(matrix(placed.column("vector").combine_chunks(), None, quantizer.width))
    scores = rows_of @ quantizer.centroids.T
    own = scores[np.arange(len(scores)), placed.column("list").to_numpy()]
    ahead = np.sort((scores > own[:, None]).sum(axis=1))
    return 1 + int(ahead[min(len(ahead) - 1, int(np.ceil(share * len(ahead))))])


def _save(spark: SparkSession, quantizer: Quantizer, path: str, nprobe: int, id_kind: str) -> None:
    words = [("codeword", p, c, w.tolist()) for p, own in enumerate(quantizer.codewords) for c, w in enumerate(own)]
    rows = [("cosine" if quantizer.cosine else "dot", quantizer.width, nprobe, []), (f"id {id_kind}", 0, 0, [])] + [("centroid", 0, i, c.tolist()) for i, c in enumerate(quantizer.centroids)] + words
    spark.createDataFrame(rows, "kind string, part int, number int, vector array<double>").coalesce(1).write.parquet(f"{path}/quantizer")


def load(spark: SparkSession, path: str) -> Index:
    """An index that :func:`build` has written."""
    rows = spark.read.parquet(f"{path}/quantizer").orderBy("kind", "part", "number").collect()
    centroids = np.array([r["vector"] for r in rows if r["kind"] == "centroid"])
    words = [r for r in rows if r["kind"] == "codeword"]
    parts = 1 + max(r["part"] for r in words)
    codewords = np.array([r["vector"] for r in words]).reshape(parts, len(words) // parts, -1)
    head = next(r for r in rows if r["kind"] in ("cosine", "dot"))
    quantizer = Quantizer(centroids, codewords, head["kind"] == "cosine", head["part"])
    id_kind = next(r["kind"][3:] for r in rows if r["kind"].startswith("id "))
    sizes = np.zeros(len(centroids), np.int64)
    for r in _indexed(spark, path, id_kind).groupBy("list").count().collect():  # a row per list at most
        sizes[r["list"]] = r["count"]
    return Index(spark, path, quantizer, sizes, head["number"], id_kind)


def _probes(quantizer: Quantizer, sizes: np.ndarray, nprobe: int, k: int):
    """For every query the lists with the best centroids: ``nprobe``, or more until they hold ``k`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = quantizer.prepared(matrix(batch.column(1), None, quantizer.width))
            order = np.argsort(-(rows @ quantizer.centroids.T), axis=1, kind="stable")
            enough = (np.cumsum(sizes[order], axis=1) < k).sum(axis=1) + 1
            lists = [o[: max(nprobe, n)].tolist() for o, n in zip(order, enough)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.list_(pa.int32()))], ["query_id", "vector", "lists"])

    return run


class _Kept:
    """The best candidates (score, id, list) of each query so far; they are cut down when they have grown fourfold."""

    def __init__(self, n: int, k: int):
        self.k, self.rows = k, [None] * n

    def add(self, query: int, *found: np.ndarray) -> None:
        known = self.rows[query]
        self.rows[query] = found if known is None else tuple(map(np.concatenate, zip(known, found)))
        if len(self.rows[query][0]) > 4 * self.k:
            self.cut(query)

    def cut(self, query: int) -> None:
        known = self.rows[query]
        if known is not None:
            at = best(known[0], known[1], self.k)
            self.rows[query] = tuple(x[at] for x in known)


def _scan(quantizer: Quantizer, queries: np.ndarray, probed: dict[int, np.ndarray], keep: int, names: list):
    """(query_id, list, id, score) of each query's best ``keep`` rows of the task by looked-up scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, codes, size = quantizer.codewords.shape
        tables = np.einsum("qps,pcs->qpc", queries.reshape(len(queries), parts, size), quantizer.codewords)
        kept = _Kept(len(queries), keep)
        for batch in batches:
            lists, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            words = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(lists), parts)
            for number in np.unique(lists).tolist():
                asking = probed.get(number)
                if asking is None:
                    continue
                at = np.flatnonzero(lists == number)
                scores = np.repeat((queries[asking] @ quantizer.centroids[number])[:, None], len(at), axis=1)
                for p in range(parts):
                    scores += tables[asking, p][:, words[at, p]]
                for q, own in zip(asking.tolist(), scores):
                    top = best(own, ids[at], keep)
                    kept.add(q, own[top], ids[at[top]], np.full(len(top), number, np.int32))
        for q, name in enumerate(names):
            kept.cut(q)
            if kept.rows[q] is not None:
                scores, own, lists = kept.rows[q]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(own)), pa.array(lists), pa.array(own), pa.array(scores)], ["query_id", "list", "id", "score"])

    return run


def search(index: Index, queries: DataFrame, k: int = 10, nprobe: int | None = None, refine: int = 10) -> DataFrame:
    """query_id, id, score and rank (from 1) of about the ``k`` best vectors for every row of ``queries`` (query_id, vector).

    ``nprobe`` lists (by default what the index has measured) are read for each query, and ``refine * k`` candidates get
    exact scores; both trade time for recall. Ties go to the smaller id.
    """
    spark, quantizer = index.spark, index.quantizer
    nprobe = nprobe or index.nprobe
    python_ready(spark, 4096)
    kinds = queries.schema["query_id"].dataType.simpleString(), index.id_kind
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector")).where(F.size("vector") == quantizer.width).where("query_id IS NOT NULL")
    probed = cut(asked.mapInArrow(_probes(quantizer, index.sizes, nprobe, k), f"query_id {kinds[0]}, vector array<double>, lists array<int>"))
    readings = -(-probed.count() // QUERY_BLOCK)
    found = spark.createDataFrame([], f"query_id {kinds[0]}, list int, id {kinds[1]}, score double")
    for reading in range(readings):
        own = probed.where(F.pmod(F.xxhash64("query_id"), F.lit(readings)) == reading).toArrow()
        if not own.num_rows:
            continue
        rows = quantizer.prepared(matrix(own.column("vector").combine_chunks(), None, quantizer.width))
        asking: dict[int, list[int]] = {}
        for q, lists in enumerate(own.column("lists").to_pylist()):
            for number in lists:
                asking.setdefault(number, []).append(q)
        scanned = index.rows().where(F.col("list").isin(sorted(asking))).select("list", "id", "code")
        scan = _scan(quantizer, rows, {n: np.array(q) for n, q in asking.items()}, refine * k, own.column("query_id").to_pylist())
        found = found.unionByName(scanned.mapInArrow(scan, found.schema))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    candidates = cut(found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= refine * k).select("query_id", "list", "id"))
    return _exact(index, candidates, probed, k)


def _exact(index: Index, candidates: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """Exact scores of the candidates, whose vectors are read from their lists only."""
    named = candidates.distinct()
    lists = [r[0] for r in candidates.select("list").distinct().collect()]  # a row per list at most
    rows = index.rows().where(F.col("list").isin(sorted(lists))).select("list", "id", F.col("vector").alias("_vector"))
    if candidates.count() <= BROADCAST_CANDIDATES:
        named = F.broadcast(named)
    both = rows.join(named, ["list", "id"]).join(asked.select("query_id", F.col("vector").alias("_asked")), "query_id")
    dot = F.aggregate(F.zip_with("_vector", "_asked", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    size = norm("_vector") * norm("_asked")
    score = F.when(size > 0, dot / size).otherwise(F.lit(0.0)) if index.quantizer.cosine else dot
    scored = both.select("query_id", "id", F.round(score, DECIMALS).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame, k: int) -> DataFrame:
    """query_id and recall: the share of each query's first ``k`` exact rows that were found."""
    wanted = exact.where(F.col("rank") <= k).select("query_id", "id")
    hits = found.where(F.col("rank") <= k).select("query_id", "id").distinct().withColumn("_hit", F.lit(1.0))
    return wanted.join(hits, ["query_id", "id"], "left").groupBy("query_id").agg(F.avg(F.coalesce("_hit", F.lit(0.0))).alias("recall"))
