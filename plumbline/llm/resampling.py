"""Importance resampling towards a target: documents are drawn whose hashed word runs look like those of another table.

Words are runs of ASCII letters (A-Z in lower case), digits and all characters beyond ASCII. Features are the runs of 1 to
``n`` words; a feature's bucket is its CRC-32 modulo the number of buckets. How much more common a bucket is in the
target than in the documents is its gain; a document's weight is the mean gain of its features, and a Gumbel number made
from its id turns weights into scores of which the highest are a draw without replacement.

Texts longer than ``CHUNK`` bytes are parted at word boundaries into overlapping chunks: a chunk owns the features that
start in its words, and carries the ``n - 1`` words that follow, so that every feature is counted once. Chunks are dealt
out over all tasks; their counts and weights are summed by document. Shorter texts are single chunks that stay where
they are read. The CRC of a run is put together from those of its words, since appending ``k`` bytes to a string maps
its CRC linearly; so a task hashes every distinct word once.

The numbers per bucket (at most ``buckets`` rows) come to the driver and go out with the second reading. Ranks are found
without one ordered queue of all documents: rows per score are counted first (there are under 100,000 scores, integers
whose range is that of the gains and of the Gumbel numbers), and rows of one score are ordered by id.

Cases: a null text has no words; without words the weight is 0; a null id counts as the empty string in the Gumbel number
and comes last among equal scores; repeated rows are documents of their own; empty tables have no rows and count nothing.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import by_key, python_ready, staged

#: Bytes from which a text is parted, and of a chunk before it is extended to the end of a word.
CHUNK = 1 << 18
#: Words that a worker keeps with their checksums; beyond that it starts anew.
REMEMBERED = 120_000
#: Lengths of appended strings that have tables; longer words are appended one by one.
TABLES = 64

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")


class Checksums(dict):
    """CRC-32 and length of a word as one number, computed once while it is remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        packed = self[word] = zlib.crc32(word) | len(word) << 32
        return packed


def _append_tables() -> np.ndarray:
    """tables[k, j, b]: what byte ``j`` of a CRC, with value ``b``, becomes when ``k`` bytes are appended."""
    zero = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)  # the linear part of one more byte
    tables = np.empty((TABLES, 4, 256), np.uint32)
    tables[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for k in range(1, TABLES):
        tables[k] = zero[tables[k - 1] & 255] ^ (tables[k - 1] >> 8)
    return tables


class Hasher:
    """Buckets of the features of a list of words."""

    def __init__(self, n: int, buckets: int):
        self.n, self.buckets = n, np.uint32(buckets)
        self.known, self.tables = Checksums(), _append_tables()

    def appended(self, left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
        """CRC of each string of CRC ``left`` followed by one of CRC ``right`` and ``size`` bytes (below ``TABLES``)."""
        out = right.copy()
        for j in range(4):
            out ^= self.tables[size, j, (left >> np.uint32(8 * j)) & np.uint32(255)]
        return out

    def features(self, words: list[bytes], own: int) -> np.ndarray:
        """Buckets of all features that start in the first ``own`` words."""
        packed = np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        crc, size = packed.astype(np.uint32), (packed >> np.uint64(32)).astype(np.int64)
        long = np.flatnonzero(size >= TABLES - 1)
        blank = np.full(len(words), zlib.crc32(b" "), np.uint32)
        short = np.minimum(size, TABLES - 2)
        spaced = self.appended(blank, crc, short)  # of a blank and the word
        for i in long.tolist():
            spaced[i] = zlib.crc32(words[i], zlib.crc32(b" "))
        out, run = [crc[:own]], crc
        for k in range(1, self.n):
            left, at = run[: len(words) - k], slice(k, None)
            run = self.appended(left, spaced[at], short[at] + 1)
            for i in long[long >= k].tolist():
                run[i - k] = zlib.crc32(b" " + words[i], int(left[i - k]))
            out.append(run[:own])
        return np.concatenate(out) % self.buckets


def overlap_chunks(data: bytes, size: int, n: int) -> Iterator[tuple[bytes, bytes]]:
    """Own bytes and carried words (joined by blanks) of the chunks of a text; cuts lie at the end of words."""
    at = 0
    while at < len(data):
        gap = _GAP.search(data, min(at + size, len(data)))
        end = gap.start() if gap else len(data)
        carried: list[bytes] = []
        since = end
        while len(carried) < n - 1 and since < len(data):
            # Words that follow, looked for in steps, so that a far one costs no copy of the whole rest.
            lowered = data[since : since + 4096].lower()
            found = _WORD.search(lowered)
            if not found:
                since += len(lowered)
                continue
            start = since + found.start()
            gap = _GAP.search(data, start)
            since = gap.start() if gap else len(data)
            carried.append(data[start:since])
        yield data[at:end], b" ".join(carried)
        at = end


def _parted(size: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(2).to_pylist()):
                for k, (own, carry) in enumerate(overlap_chunks(text, size, n)):
                    columns = [batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([k], pa.int64()), pa.array([own], pa.binary()), pa.array([carry], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "mark", "chunk", "own", "carry"])

    return run


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 2, size: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Short texts and the chunks of long ones, both as (id, mark, chunk, own, carry).

    ``mark`` tells long texts with one id apart; rows that agree in both are copies of one another. Chunks are dealt out
    over all tasks, short texts stay where they are read.
    """
    python_ready(docs.sparkSession, 2048)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    long = F.octet_length("text") > size
    short = rows.where(~long).select("id", F.lit(None).cast("string").alias("mark"), F.lit(0).cast("long").alias("chunk"), F.col("text").cast("binary").alias("own"), F.lit(b"").alias("carry"))
    marked = rows.where(long).select("id", F.sha2("text", 256).alias("mark"), F.col("text").cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    parted = marked.mapInArrow(_parted(size, n), f"id {kind}, mark string, chunk long, own binary, carry binary")
    return short, by_key(parted, "id", "mark", "chunk")


def _each(pieces: pa.RecordBatch, hasher: Hasher) -> Iterator[tuple[int, np.ndarray]]:
    """Number of own words and buckets of the own features of every chunk."""
    for own, carry in zip(pieces.column(3).to_pylist(), pieces.column(4).to_pylist(), strict=True):
        words = _WORD.findall(own.lower())
        yield len(words), hasher.features(words + carry.lower().split() if words else [], len(words))


def bucket_counts(docs: DataFrame, n: int = 2, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK) -> DataFrame:
    """bucket and n: features of all texts, counted in every task before anything is shuffled."""
    short, long = chunks(docs, id_col, text_col, n, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total = Hasher(n, buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, found in _each(batch, hasher):
                total += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["bucket", "n"])

    counted = short.unionByName(long).mapInArrow(run, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, n: int = 2, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", size: int = CHUNK) -> DataFrame:
    """bucket, s, t and gain of every bucket: thousandths of the log of how much more common it is in ``target``."""
    own = bucket_counts(docs, n, buckets, id_col, text_col, size)
    theirs = bucket_counts(target.select(F.lit(0).alias("id"), F.col(target_text).alias("text")), n, buckets, "id", "text", size)
    every = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    both = every.join(own.withColumnRenamed("n", "s"), "bucket", "left").join(theirs.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0, ["s", "t"])
    sums = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    number = lambda c, add: F.col(c).cast("double") + F.lit(float(add))
    ratio = number("t", 1) * number("all_s", buckets) / (number("s", 1) * number("all_t", buckets))
    return both.join(F.broadcast(sums)).select("bucket", "s", "t", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def weighed(docs: DataFrame, by_bucket: np.ndarray, n: int = 2, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK) -> DataFrame:
    """id, n_words, n_features and gains (their sum) of every row."""
    short, long = chunks(docs, id_col, text_col, n, size)
    kind = short.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(n, len(by_bucket))
        for batch in batches:
            found = [(words, len(buckets), int(by_bucket[buckets].sum())) for words, buckets in _each(batch, hasher)]
            columns = [pa.array(c, pa.int64()) for c in zip(*found)] if found else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *columns], ["id", "mark", "chunk", "n_words", "n_features", "gains"])

    schema = f"id {kind}, mark string, chunk long, n_words long, n_features long, gains long"
    sums = ("n_words", "n_features", "gains")
    whole = short.mapInArrow(run, schema).select("id", *sums)
    parts = long.mapInArrow(run, schema).groupBy("id", "mark").agg(F.count_if(F.col("chunk") == 0).alias("copies"), *[F.sum(c).alias(c) for c in sums])
    # Copies of a long text share their sums evenly; each gets a row of its own.
    split = parts.select("id", *[F.expr(f"{c} div copies").alias(c) for c in sums], F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("col")
    return whole.unionByName(split)


def resample(
    docs: DataFrame,
    target: DataFrame,
    n: int = 2,
    buckets: int = 10_000,
    least_words: int = 20,
    percent: int = 25,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text: str = "text",
    size: int = CHUNK,
) -> DataFrame:
    """Per row of ``docs``: id, n_features, weight, score and rank (from 1; null if it is not drawn).

    Of the N rows with at least ``least_words`` words, ``percent`` hundredths of N (rounded down) are drawn.
    """
    table = gains(docs, target, n, buckets, id_col, text_col, target_text, size).select("bucket", "gain").collect()
    by_bucket = np.zeros(buckets, np.int64)
    by_bucket[[r["bucket"] for r in table]] = [r["gain"] for r in table]
    own = weighed(docs, by_bucket, n, id_col, text_col, size)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long").cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    weight = F.coalesce(F.expr("(gains - pmod(gains, n_features)) div nullif(n_features, 0)"), F.lit(0))
    scored = staged(own.withColumn("weight", weight.cast("long")).select("id", "n_features", "weight", (F.col("weight") + gumbel).alias("score"), (F.col("n_words") >= least_words).alias("able")))
    able = scored.where("able").groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    higher = F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1))
    quota = scored.where("able").agg((F.count(F.lit(1)) * percent)).first()[0] // 100
    starts = able.select("score", F.coalesce(higher, F.lit(0)).alias("higher")).where(F.col("higher") < quota)
    s, e = scored.alias("s"), F.broadcast(starts).alias("e")
    placed = s.join(e, (F.col("s.score") == F.col("e.score")) & F.col("s.able"), "left").select("s.id", "s.n_features", "s.weight", "s.score", "e.higher")
    inside = Window.partitionBy("score").orderBy(F.col("id").asc_nulls_last(), "n_features", "weight")
    rank = F.col("higher") + F.row_number().over(inside)
    drawn = placed.where("higher IS NOT NULL").withColumn("rank", rank.cast("long")).withColumn("rank", F.when(F.col("rank") <= quota, F.col("rank")))
    rest = placed.where("higher IS NULL").withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def drawn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` whose id is drawn, all columns kept."""
    ids = resample(docs, target, id_col=id_col, **options).where("rank IS NOT NULL").select(F.col(id_col).alias("_drawn")).distinct()
    return docs.join(ids, docs[id_col].eqNullSafe(F.col("_drawn")), "left_semi")
