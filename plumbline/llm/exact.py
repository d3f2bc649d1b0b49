"""Exact dedup by composable polynomial fingerprints.

A text is normalised (every run of ASCII white space becomes one space) and cut into chunks. A chunk's fingerprint is
``sum(byte[i] * base**i) mod prime`` for two (base, prime) pairs; fingerprints of neighbours combine by length-shifted
arithmetic, ``h(ab) = h(a) + base**len(a) * h(b)``, so a huge document is hashed chunk by chunk. Rows with equal
fingerprints and lengths then undergo a chunkwise comparison: the least and the greatest chunk at each offset of a
group must agree, which Spark aggregates before the shuffle, so a group with a third of all rows costs each task one
row. Groups that fail it are regrouped by the text itself; the result is exact whatever the fingerprints do.

Cases: a null text counts as empty, empty texts are equal to each other; rows with the same id and text are separate
rows of which one stays; a null id sorts before all others; an empty table gives an empty result. Other columns are
ignored by ``duplicate_groups`` and carried by ``without_copies``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.lookup import rows_with_ids
from plumbline.llm.words import SPACE, SPACES
from plumbline.session import cut, python_ready, staged

#: Two primes below 2**31 and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1566083941)
#: Bytes of a chunk that numpy hashes at once: 255 * 2**31 * 4096 stays below 2**63.
CHUNK = 4096
#: Bytes of a chunk of the comparison.
COMPARED = 65536


def powers(base: int, prime: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    x = 1
    for i in range(n):
        out[i] = x
        x = x * base % prime
    return out


def combine(left: int, n_left: int, right: int, base: int, prime: int) -> int:
    """Fingerprint of two neighbours from theirs and the length of the left one."""
    return (left + pow(base, n_left, prime) * right) % prime


def fingerprints(texts: list[bytes], primes=PRIMES, bases=BASES) -> list[np.ndarray]:
    """For each (base, prime): the fingerprints of all texts, chunk by chunk."""
    pieces, owner = [], []
    for k, text in enumerate(texts):
        for at in range(0, len(text), CHUNK):
            pieces.append(text[at : at + CHUNK])
            owner.append(k)
    out = []
    tables = [powers(b, p, CHUNK) for b, p in zip(bases, primes, strict=True)]
    sums = [np.zeros(len(pieces), np.uint64) for _ in primes]
    step = 512  # pieces at once: 2 MB of bytes
    for lo in range(0, len(pieces), step):
        part = pieces[lo : lo + step]
        sizes = np.fromiter(map(len, part), np.int64, len(part))
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(part), np.uint8).astype(np.uint64)
        place = np.arange(len(data)) - np.repeat(starts, sizes)
        for total, weights, prime in zip(sums, tables, primes, strict=True):
            total[lo : lo + len(part)] = np.add.reduceat(data * weights[place], starts) % np.uint64(prime)
    for total, base, prime in zip(sums, bases, primes, strict=True):
        whole = [0] * len(texts)
        length = [0] * len(texts)
        for piece, k, h in zip(pieces, owner, total.tolist(), strict=True):
            whole[k] = combine(whole[k], length[k], h, base, prime) if length[k] else h
            length[k] += len(piece)
        out.append(np.array(whole, np.int64))
    return out


def normalised(text: str | bytes | None) -> bytes:
    """Every run of ASCII white space as one space; null as empty."""
    data = text.encode() if isinstance(text, str) else text or b""
    if not data:
        return b""
    core = b" ".join(data.split())
    if not core:
        return b" "
    edge = SPACES.encode()
    return (b" " if data[0] in edge else b"") + core + (b" " if data[-1] in edge else b"")


def _hashed(primes, bases, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            texts = [normalised(t) for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            first, second = fingerprints(texts, primes, bases)
            added = {
                "_fp_a": pa.array(first, pa.int64()),
                "_fp_b": pa.array(second, pa.int64()),
                "_fp_bytes": pa.array([len(t) for t in texts], pa.int64()),
                "_fp_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
            }
            kept = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names)]
            yield pa.RecordBatch.from_arrays([c for _, c in kept] + list(added.values()), [n for n, _ in kept] + list(added))

    return run


def with_fingerprints(docs: DataFrame, text_col: str = "text", primes=PRIMES, bases=BASES) -> DataFrame:
    """``docs`` and the columns _fp_a, _fp_b, _fp_bytes and _fp_sha256 of the normalised text."""
    python_ready(docs.sparkSession)
    added = "_fp_a long, _fp_b long, _fp_bytes long, _fp_sha256 string"
    schema = T.StructType(docs.schema.fields + T.StructType.fromDDL(added).fields)
    return docs.mapInArrow(_hashed(primes, bases, text_col), schema)


def _chunks(text):
    """Chunks of a normalised text in order, cut in one pass; an empty one has a single empty chunk."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), SPACE + "+", " ")
    parts = F.regexp_extract_all(clean, F.lit(f"(?s).{{1,{COMPARED}}}"), F.lit(0))
    return F.when(F.coalesce(F.length(text), F.lit(0)) > 0, parts).otherwise(F.array(F.lit("")))


def duplicate_groups(rows: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of two or more equal texts: _fp_a, _fp_b, _fp_bytes, _fp_sha256 (null for a verified group), keep (id, row), n.

    ``rows``: staged fingerprints with the columns ``id_col``, row, fp_*; ``docs``: the texts, read again for candidates.
    """
    key = ["_fp_a", "_fp_b", "_fp_bytes"]
    first = F.min(F.struct(F.col(id_col).alias("id"), F.col("_row").alias("row")))
    several = cut(rows.groupBy(key).agg(first.alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    ids = cut(rows.join(several.select(key), key, "left_semi").select(id_col).distinct())
    members = rows_with_ids(docs.select(id_col, text_col), ids, id_col, id_col)
    parts = with_fingerprints(members, text_col).select(*key, F.posexplode(_chunks(F.col(text_col))).alias("at", "chunk"))
    unlike = (
        parts.groupBy(*key, "at")
        .agg(F.min("chunk").alias("least"), F.max("chunk").alias("most"))
        .where(F.col("least") != F.col("most"))
        .select(key)
        .distinct()
    )
    unlike = cut(unlike)
    verified = several.join(unlike, key, "left_anti").withColumn("_fp_sha256", F.lit(None).cast("string"))
    if unlike.isEmpty():
        return verified
    again = rows.join(unlike, key, "left_semi").groupBy(*key, "_fp_sha256").agg(first.alias("keep"), F.count(F.lit(1)).alias("n"))
    return verified.unionByName(again)


def _decided(rows: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list]:
    """Staged rows r joined with their groups g, and the columns found."""
    groups = cut(duplicate_groups(rows, docs, id_col, text_col))
    key = ["_fp_a", "_fp_b", "_fp_bytes"]
    r, g = rows.select(id_col, "_row", *key, "_fp_sha256").alias("r"), groups.alias("g")
    same = F.col("g._fp_sha256").isNull() | (F.col("g._fp_sha256") == F.col("r._fp_sha256"))
    for k in key:
        same = same & (F.col(f"r.{k}") == F.col(f"g.{k}"))
    found = [
        F.when(F.col("g.n").isNull(), F.col(f"r.{id_col}")).otherwise(F.col("g.keep.id")).alias("keep_id"),
        F.coalesce("g.n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("g.n").isNull() | (F.col("g.keep.row") == F.col("r._row"))).alias("kept"),
        F.col("r._fp_sha256").alias("text_sha256"),
    ]
    return r.join(g, same, "left"), found


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256 (of the normalised text, lower-case hex)."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = staged(with_fingerprints(own).drop("text").withColumn("_row", F.monotonically_increasing_id()))
    joined, found = _decided(rows, own, "id", "text")
    return joined.select(F.col("r.id").alias(id_col), *found)


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, the one with the smallest id.

    All columns are staged with the fingerprints, so that a row is known by its number; then only the numbers of the
    rows that go are joined back. The columns have names of their own meanwhile, so any name may be among them.
    """
    at = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    own = docs.toDF(*at.values())
    rows = staged(with_fingerprints(own, at[text_col]).withColumn("_row", F.monotonically_increasing_id()))
    joined, found = _decided(rows, own, at[id_col], at[text_col])
    gone = staged(joined.where(~found[2]).select("r._row"))
    return rows_with_ids(rows, gone, "_row", "_row", without=True).select(*at.values()).toDF(*docs.columns)
