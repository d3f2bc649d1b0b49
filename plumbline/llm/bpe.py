"""Byte-level BPE encoding and decoding by the ranks of a public vocabulary file.

A text is split by the tokenizer's pattern and every piece is encoded separately. Over the byte positions of a piece
stands a segment tree whose leaf ``i`` holds the rank of the pair that starts at token ``i`` (or ``NONE``) and whose
inner nodes hold the least rank below; walking down from the root to the left child whenever it has the least rank
finds the leftmost minimum. A merge removes the right token of the pair from the linked list of live tokens and makes
three point updates (the pair before, the merged one, the removed one), each along one path to the root.

Pieces that a worker has not met yet are encoded together: trees of equal width are rows of one numpy array and are
searched, merged and updated in step; a finished piece leaves the array. A bounded memory of pieces keeps their ids.

Cases: a null text is the empty text, which has no tokens; a piece that is in the vocabulary is its own token; equal
ranks cannot meet at different pairs except as copies, of which the leftmost goes first; repeated rows are encoded
each; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import python_ready

NONE = np.int32(2**31 - 1)
#: Pieces that a worker keeps with their ids; beyond that it starts anew.
REMEMBERED = 100_000


class Encoder:
    """Ranks, the table of all mergeable pairs, and the pieces met so far."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            self.bytes_of[rank] = piece
        self.text_of = [str(i) for i in range(len(self.bytes_of))]
        self.number = list(range(len(self.bytes_of)))  # one object for each id in all pieces that are remembered
        self.find = regex.compile(pattern).findall
        self.byte_ids = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        # Every way to cut a token into two tokens is a pair whose rank is the token's.
        pairs = [
            (left * len(self.bytes_of) + right, rank)
            for piece, rank in ranks.items()
            for at in range(1, len(piece))
            if (left := ranks.get(piece[:at])) is not None and (right := ranks.get(piece[at:])) is not None
        ]
        # An open-addressed table, a quarter full at most, finds a pair in one or two steps.
        bits = (4 * len(pairs)).bit_length()
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        keys = np.array([k for k, _ in pairs], np.int64)
        values = np.array([v for _, v in pairs], np.int32)
        slots = self._slots(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slots] == -1)
            self.keys[slots[free]] = keys[free]
            self.values[slots[free]] = values[free]
            left = self.keys[slots] != keys
            self.values[slots[~left]] = values[~left]
            keys, values, slots = keys[left], values[left], (slots[left] + 1) & self.mask
        self.known: dict[str, tuple[int, ...]] = {}

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens; NONE where a token is missing (-1) or the pair makes none."""
        keys = np.where((left < 0) | (right < 0), np.int64(-2), left.astype(np.int64) * len(self.bytes_of) + right)
        slots = self._slots(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.values[slots], NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & self.mask
            found = self.keys[slots[open_]]
            out[open_] = np.where(found == keys[open_], self.values[slots[open_]], NONE)
            open_ = open_[(found != keys[open_]) & (found != -1)]
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each piece; pieces of about one length share an array of trees."""
        out: list[tuple[int, ...]] = [()] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[k] = (rank,)
            elif piece:
                by_width.setdefault(max(2, 1 << (len(piece) - 1).bit_length()), []).append(k)
        for width, members in by_width.items():
            step = max(1, (1 << 20) // width)
            for at in range(0, len(members), step):
                part = members[at : at + step]
                for k, ids in zip(part, self._forest([pieces[k] for k in part], width), strict=True):
                    out[k] = ids
        return out

    def _forest(self, pieces: list[bytes], width: int) -> list[tuple[int, ...]]:
        n = len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, n)
        # Tokens with a spare place at each end; previous and next live token; the trees.
        tokens = np.full((n, width + 2), -1, np.int32)
        data = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        tokens[:, 1:-1][np.arange(width) < sizes[:, None]] = data
        places = np.arange(width + 2, dtype=np.int32)
        before, after = np.tile(places - 1, (n, 1)), np.tile(places + 1, (n, 1))
        before[:, 0], after[:, -1] = 0, width + 1
        tree = np.full((n, 2 * width), NONE, np.int32)
        tree[:, width:] = self.pair_ranks(tokens[:, 1:-1].ravel(), tokens[:, 2:].ravel()).reshape(n, width)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
            live = np.arange(n)  # rows of the arrays that still have a pair
        while len(live := live[tree[live, 1] != NONE]):
            best = tree[live, 1]
            node = np.ones(len(live), np.int64)
            while node[0] < width:  # all leaves lie at one depth
                node = 2 * node
                node += tree[live, node] != best
            at = node - width + 1
            right = after[live, at]
            beyond, ahead = after[live, right], before[live, at]
            tokens[live, at] = best
            tokens[live, right] = -1
            after[live, at] = beyond
            before[live, beyond] = at
            changed = np.concatenate([at, ahead, right])
            rows = np.concatenate([live, live, live])
            ranks = np.full(len(changed), NONE, np.int32)
            k = len(live)
            ranks[: 2 * k] = self.pair_ranks(tokens[rows[: 2 * k], changed[: 2 * k]], tokens[rows[: 2 * k], np.concatenate([beyond, at])])
            inside = changed > 0  # the spare place at the start has no leaf
            rows, node = rows[inside], changed[inside] + width - 1
            tree[rows, node] = ranks[inside]
            while node[0] > 1:
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
        kept = tokens >= 0
        flat = [self.number[i] for i in tokens[kept].tolist()]
        ends = np.cumsum(kept.sum(axis=1)).tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def encode(self, texts: list[str | None]) -> Iterator[list[int]]:
        """Ids of each text."""
        split = [self.find(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        new = list({p for pieces in split for p in pieces if p not in self.known})
        self.known.update(zip(new, self.encode_pieces([p.encode() for p in new]), strict=True))
        known = self.known
        for pieces in split:
            ids: list[int] = []
            for p in pieces:
                ids += known[p]
            yield ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def parse_ranks(lines: Iterator[bytes]) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def encoder(ranks_path: str, pattern: str) -> Encoder:
    """One encoder per Python worker; the vocabulary is part of the installation on every machine."""
    key = (ranks_path, pattern)
    if key not in _ENCODERS:
        with open(ranks_path, "rb") as lines:
            _ENCODERS[key] = Encoder(parse_ranks(lines), pattern)
    return _ENCODERS[key]


def _ids(ranks_path: str, pattern: str, text_col: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(ranks_path, pattern)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            keys = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != text_col]
            names = [n for n in batch.schema.names if n != text_col]
            found = tool.encode(texts)
            if not digest:
                values = list(found)
                yield pa.RecordBatch.from_arrays([*keys, pa.array(values, pa.list_(pa.int32()))], [*names, "ids"])
                continue
            sizes, hashes, decoded = [], [], []
            for ids in found:
                sizes.append(len(ids))
                hashes.append(hashlib.sha256(",".join(map(tool.text_of.__getitem__, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(tool.decode(ids)).hexdigest())
            columns = [pa.array(sizes, pa.int64()), pa.array(hashes), pa.array(decoded)]
            yield pa.RecordBatch.from_arrays([*keys, *columns], [*names, "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def token_ids(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids (array<int>) of every row."""
    python_ready(docs.sparkSession)
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return rows.mapInArrow(_ids(ranks_path, pattern, text_col, False), rows.drop(text_col).schema.add("ids", T.ArrayType(T.IntegerType())))


def token_digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256: ids are encoded, decoded again and both hashed within the task."""
    python_ready(docs.sparkSession)
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    schema = rows.drop(text_col).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return rows.mapInArrow(_ids(ranks_path, pattern, text_col, True), schema)


def decoded_texts(ids: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """Other columns and text (bytes that are no UTF-8 become the replacement character); the inverse of ``token_ids``."""
    names = [c for c in ids.columns if c != ids_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(ranks_path, pattern)
        for batch in batches:
            texts = [tool.decode(x or []).decode("utf-8", "replace") for x in batch.column(batch.schema.get_field_index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in names] + [pa.array(texts, pa.string())], [*names, "text"])

    return ids.mapInArrow(run, ids.drop(ids_col).schema.add("text", "string"))
