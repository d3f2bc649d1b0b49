"""Alignment of two tokenizers' tokens over the same bytes, and how often ids are linked in the whole corpus.

Over the bytes of a text stand two arrays of owners: ``np.repeat`` of the tokens' numbers by their sizes, once for each
tokenizer. Where the pair of owners is another one than at the byte before, a new overlap begins; where both owners
change at once, tokens of both end together: a cut. Cuts part the tokens into groups, and the two tokens that end at a
cut are linked. A long text is treated in windows of bytes, each with the first byte of the next one.

The texts are encoded once. What a document links, as distinct pairs of ids with their numbers, is staged with its
digests; links of all documents are counted from there by a shuffle of these pairs, which a pair meets once per document
at most, and joined back: the table of all pairs is broadcast only if it is counted and small, otherwise both sides are
shuffled, and a pair of many documents is one key with one short row for each of them.

Cases: null and empty texts have no tokens, nor has a text whose tokens do not add up to a blank and itself (the sign
for a blank within a text reads as a blank); such documents have zeros and the empty string as digest. Repeated rows are
documents of their own; null ids stay; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import bpe, pieces
from plumbline.session import cut, python_ready, staged

#: Bytes of a window of owners, and tokens whose signs are gathered at once.
WINDOW, GATHERED = 1 << 20, 1 << 16
#: Matches of A's pattern that a worker keeps with their ids; beyond that it starts anew.
REMEMBERED = 300_000
#: Distinct pairs of ids (24 bytes each) that may be broadcast; more are joined by a shuffle.
BROADCAST_PAIRS = 1_000_000


def byte_signs() -> dict[str, int]:
    """The printable sign that a byte-level vocabulary writes for each byte: itself, or the next one from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(others)}


def vocabulary_ranks(path: str) -> dict[bytes, int]:
    """Bytes and ids of a byte-level vocabulary file; ids must rise with the order of merges, so they serve as ranks."""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    signs, vocabulary = byte_signs(), content["model"]["vocab"]
    special = {t["content"] for t in content.get("added_tokens", ())}
    merges = [m.split(" ") if isinstance(m, str) else m for m in content["model"]["merges"]]
    made = [vocabulary[left + right] for left, right in merges]
    if any(a >= b for a, b in zip(made, made[1:])):
        raise ValueError("ids do not follow the order of the merges")
    return {bytes(signs[c] for c in token): number for token, number in vocabulary.items() if token not in special}


class Pair:
    """The two tokenizers of a worker with the bytes of their tokens."""

    def __init__(self, byte_path: str, piece_path: str, pattern: str):
        key = (byte_path, pattern)
        if key not in bpe._ENCODERS:
            bpe._ENCODERS[key] = bpe.Encoder(vocabulary_ranks(byte_path), pattern)
        self.a, self.b = bpe._ENCODERS[key], pieces.model(piece_path)
        self.a_bytes = self.a.bytes_of
        self.b_bytes = [self.b.byte_of.get(i) or p.replace(pieces.BLANK, " ").encode() for i, p in enumerate(self.b.pieces)]
        self.a_sizes, self.b_sizes = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.b_count = len(self.b_bytes)
        self.known: dict[str, bytes] = {}  # packed ids of A's matches
        # Each id with the sign that follows it (within its side of a group, and at the side's end): bytes, and which of them count.
        texts = [f"{i}{sign}".encode() for count, signs in ((len(self.a_bytes), ",|"), (self.b_count, ",;")) for i in range(count) for sign in signs]
        width = max(map(len, texts))
        self.text_bytes = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8).reshape(len(texts), width)

    def _a_ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of A: matches of the pattern that are new are encoded together, then all are joined."""
        split = [self.a.find(t) for t in texts]
        met = {p for found in split for p in found}
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(met - self.known.keys())
        for piece, ids in zip(new, self.a.encode_pieces([p.encode() for p in new]), strict=True):
            self.known[piece] = struct.pack(f"<{len(ids)}I", *ids)
        for found in split:
            yield np.frombuffer(b"".join(map(self.known.__getitem__, found)), "<u4").astype(np.int64)

    def encode(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of both sides of every text; none where they do not add up to a blank and the text.

        A's tokens are the matches of the pattern, so they add up if no byte is missing. The same holds for B if the
        model maps nothing: then only signs for blanks (three bytes, read as one) can be another text.
        """
        none = np.zeros(0, np.int64)
        for text, a in zip(texts, self._a_ids([" " + t if t else "" for t in texts]), strict=True):
            if not text:
                yield none, none
                continue
            data = b" " + text.encode()
            b = self.b.plain_ids(text)
            mapped = b is None
            b = (self.b.encode(text)[0] if mapped else b).astype(np.int64)
            whole = self.a_sizes[a].sum() == len(data) == self.b_sizes[b].sum()
            if whole and mapped:
                whole = b"".join(map(self.b_bytes.__getitem__, b.tolist())) == data
            yield (a, b) if whole else (none, none)


def owners(ends: np.ndarray, low: int, high: int) -> np.ndarray:
    """The number of the token that owns each byte of ``[low, high)``."""
    first, last = np.searchsorted(ends, [low, high - 1], "right")
    inside = np.minimum(ends[first : last + 1], high) - np.maximum(np.concatenate([[0], ends])[first : last + 1], low)
    return np.repeat(np.arange(first, last + 1, dtype=np.int32), inside)


def aligned(a_sizes: np.ndarray, b_sizes: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping tokens of A and B, and the tokens of A and B that end together (at the cuts), all in order."""
    a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
    total = int(a_ends[-1]) if len(a_ends) else 0
    found: list[list[np.ndarray]] = [[], [], [], []]
    for low in range(0, total, window):
        high = min(low + window + 1, total)
        a, b = owners(a_ends, low, high), owners(b_ends, low, high)
        new_a, new_b = a[1:] != a[:-1], b[1:] != b[:-1]
        overlap, both = np.flatnonzero(new_a | new_b), np.flatnonzero(new_a & new_b)
        for out, part in zip(found, (a[overlap], b[overlap], a[both], b[both]), strict=True):
            out.append(part)
    if total:  # after the last byte all end
        for out, size in zip(found, (a_sizes, b_sizes, a_sizes, b_sizes), strict=True):
            out.append(np.array([len(size) - 1]))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)


def group_text(text_bytes: np.ndarray, a_ids: np.ndarray, b_ids: np.ndarray, a_last: np.ndarray, b_last: np.ndarray, a_count: int) -> bytes:
    """Groups as ``a1,a2|b1;a3|b2,b3``: tokens of both sides are put in their places, then the bytes of their signs follow one another."""
    a_end, b_end = np.zeros(len(a_ids), bool), np.zeros(len(b_ids), bool)
    a_end[a_last], b_end[b_last] = True, True
    a_group, b_group = np.cumsum(a_end) - a_end, np.cumsum(b_end) - b_end
    out = np.empty(len(a_ids) + len(b_ids), np.int64)
    # Before a token stand those before it on its side, and the other side's tokens of the groups before (A) or up to its own (B).
    out[np.arange(len(a_ids)) + np.concatenate([[0], b_last + 1])[a_group]] = 2 * a_ids + a_end
    out[np.arange(len(b_ids)) + (a_last + 1)[b_group]] = 2 * (a_count + b_ids) + b_end
    parts = []
    for at in range(0, len(out), GATHERED):
        signs = text_bytes[out[at : at + GATHERED]].ravel()
        parts.append(signs[signs != 0].tobytes())
    return b"".join(parts)[:-1]


_PAIRS: dict[tuple[str, str, str], Pair] = {}


def pair(byte_path: str, piece_path: str, pattern: str) -> Pair:
    """One per Python worker; the vocabularies are part of the installation on every machine."""
    key = (byte_path, piece_path, pattern)
    if key not in _PAIRS:
        _PAIRS[key] = Pair(*key)
    return _PAIRS[key]


def token_overlaps(docs: DataFrame, byte_path: str, piece_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, a_ids and b_ids, overlap_a and overlap_b (numbers of overlapping tokens), cut_a and cut_b (of tokens that end together); all arrays."""
    python_ready(docs.sparkSession)
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    names = ("a_ids", "b_ids", "overlap_a", "overlap_b", "cut_a", "cut_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = pair(byte_path, piece_path, pattern)
        for batch in batches:
            found = [(a, b, *aligned(tool.a_sizes[a], tool.b_sizes[b])) for a, b in tool.encode(batch.column(1).to_pylist())]
            columns = [pa.array([row[k].tolist() for row in found], pa.list_(pa.int32())) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, *names])

    schema = rows.drop(text_col).schema
    for name in names:
        schema = schema.add(name, T.ArrayType(T.IntegerType()))
    return rows.mapInArrow(run, schema)


_COUNTED = "n_a long, n_b long, n_groups long, n_links long, n_overlaps long, groups_sha256 string, pairs array<long>, times array<long>"


def _digested(byte_path: str, piece_path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = pair(byte_path, piece_path, pattern)
        a_count = len(tool.a_bytes)
        for batch in batches:
            numbers, digests, pairs, times = [], [], [], []
            for a, b in tool.encode(batch.column(1).to_pylist()):
                over, _, a_last, b_last = aligned(tool.a_sizes[a], tool.b_sizes[b])
                numbers.append((len(a), len(b), len(a_last), len(a_last), len(over)))
                digests.append(hashlib.sha256(group_text(tool.text_bytes, a, b, a_last, b_last, a_count)).hexdigest() if len(a) else "")
                own, n = np.unique(a[a_last] * tool.b_count + b[b_last], return_counts=True)
                pairs.append(own)
                times.append(n)
            offsets = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int64), *x]))) for x in (pairs, times)]
            counted = [pa.array(c, pa.int64()) for c in zip(*numbers)] if numbers else [pa.array([], pa.int64())] * 5
            names = [f.split()[0] for f in _COUNTED.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counted, pa.array(digests, pa.string()), *lists], ["id", *names])

    return run


def linked_pairs(counted: DataFrame, b_count: int) -> DataFrame:
    """pair (a * b_count + b), times (links in all documents), best (1 if no other pair of its b has more, else 0)."""
    each = counted.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("p.pairs", "p.times")
    totals = each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("times"))
    highest = F.max("times").over(Window.partitionBy(F.pmod("pair", F.lit(b_count))))  # at most one row for each id of A
    return totals.withColumn("best", (F.col("times") == highest).cast("long"))


def alignment_digests(
    docs: DataFrame, byte_path: str, piece_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", bound: int = BROADCAST_PAIRS
) -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and n_overlaps.

    ``n_best`` counts links whose pair has the highest number of links of its B id; ``count_sum`` adds up the numbers of
    links that every link's pair has in all documents.
    """
    python_ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    digested = rows.mapInArrow(_digested(byte_path, piece_path, pattern), f"id {kind}, {_COUNTED}")
    counted = staged(digested.withColumn("_row", F.monotonically_increasing_id()))
    b_count = len(pieces.model(piece_path).pieces)
    table = cut(linked_pairs(counted, b_count))
    if table.count() <= bound:
        table = F.broadcast(table)
    each = counted.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("_row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("own"))
    sums = each.join(table, "pair").groupBy("_row").agg(F.sum(F.col("own") * F.col("best")).alias("n_best"), F.sum(F.col("own") * F.col("times")).alias("count_sum"))
    whole = counted.drop("pairs", "times").join(sums, "_row", "left")
    none = F.lit(0).cast("long")
    return whole.select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256", "n_overlaps"
    )
