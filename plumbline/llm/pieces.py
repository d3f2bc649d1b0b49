"""SentencePiece encoding and decoding with the place of every piece in the original bytes.

A model file holds pieces with scores and a compiled character map, a double array whose keys are byte strings. A text
is normalised by longest prefix: at each place the longest key of the map gives way to its replacement, and without a
key one character stays. Beside the normalised bytes runs an array ``source``: for each of them the original byte that
it comes from (all bytes of a replacement come from the key's first byte). The sizes of the pieces then tell their
ends in normalised bytes, and ``source`` at these ends tells each piece's span of original bytes.

Pieces are found by merging neighbours, best score first and leftmost of equals. No merge crosses two characters that
stand side by side in no piece, so a text is cut there and parts are encoded once and remembered; the usual cut, before
a run of blanks, is one pattern. A character that is no piece becomes the pieces of its bytes, or the unknown piece
(several in a row make one).

Cases: a null text is the empty text, which has no pieces but the begin and end ids that are asked for; text that
reads like a control piece is plain text; repeated rows are encoded each; other columns are ignored. Models of another
kind than byte-pair, and with user-defined or unused pieces, are refused.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import python_ready

#: Fixed values of the format: kinds of pieces, the sign of a blank, and the character for bytes that are no text.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BLANK, BROKEN = "▁", "�"
NO_PIECE = float("-inf")
#: Parts that a worker keeps with their pieces (beyond that it starts anew), and characters from which a part is cut further.
REMEMBERED, LONG = 300_000, 24


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol buffer message: integers, or the bytes of everything else."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, data[at : at + size]
        at += size


class CharacterMap:
    """The compiled map: a double array of units over bytes, and the replacements one after the other, each ended by a zero."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.replacements = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Size and replacement of the longest key that ``data`` continues with at a place."""
        units, found = self.units, None
        if not units:
            return None
        node = _child_base(units[0])
        for end in range(at, len(data)):
            node ^= data[end]
            unit = units[node]
            if unit & 0x800000FF != data[end]:  # another byte's unit, or a value
                break
            node ^= _child_base(unit)
            if unit & 0x100:  # a key ends here; its value stands at the place of the zero byte
                found = end + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.replacements[found[1] : self.replacements.index(b"\0", found[1])]


def _child_base(unit: int) -> int:
    return (unit >> 10) << ((unit & 0x200) >> 6)


class _Known(dict):
    """Packed ids of the parts met so far; a worker that remembers too many starts anew."""

    def __init__(self, ids_of):
        super().__init__()
        self.ids_of = ids_of

    def __missing__(self, part: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self[part] = self.ids_of(part)
        return ids


class Model:
    """Pieces, scores and normalisation of a model file, and the parts met so far."""

    def __init__(self, blob: bytes):
        self.pieces: list[str] = []
        scores: list[float] = []
        self.kinds: list[int] = []
        trainer: dict = {}
        rules: dict = {}
        for number, value in fields(blob):
            if number == 1:
                own = dict(fields(value))
                self.pieces.append(own[1].decode())
                scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                self.kinds.append(own.get(3, NORMAL))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                rules = dict(fields(value))
        if trainer.get(3, 1) != 2 or trainer.get(24, 0) or not rules.get(5, 1) or set(self.kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only byte-pair models with blanks in front and without user-defined or unused pieces are read")
        self.map = CharacterMap(rules.get(2, b""))
        self.blank_in_front, self.fewer_blanks = bool(rules.get(3, 1)), bool(rules.get(4, 1))
        self.unknown = self.kinds.index(UNKNOWN)
        self.unknown_text = trainer[44].decode() if 44 in trainer else " ⁇ "
        self.begin, self.end = (self.pieces.index(trainer[n].decode() if n in trainer else default) for n, default in ((46, "<s>"), (47, "</s>")))
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        self.scores = {p: scores[i] for p, i in self.ids.items()}
        own_byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        self.byte_ids = [own_byte[b] for b in range(256)] if own_byte else None
        self.byte_of = {i: bytes([b]) for b, i in own_byte.items()}
        self.surface = ["" if k == CONTROL else self.unknown_text if k == UNKNOWN else p.replace(BLANK, " ") for p, k in zip(self.pieces, self.kinds, strict=True)]
        #: Bytes of each piece in a text; a control piece parts runs of bytes, so it breaks them.
        self.decoded = [self.byte_of.get(i, b"\xff" if k == CONTROL else s.encode()) for i, (s, k) in enumerate(zip(self.surface, self.kinds, strict=True))]
        #: Bytes of each piece in a normalised text, where a blank is the sign's three bytes.
        self.sizes = np.array([1 if k == BYTE else len(p.encode()) for p, k in zip(self.pieces, self.kinds, strict=True)], np.int32)
        self.neighbours = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.find = re.compile(self._safe_parts()).findall
        self.known = _Known(self._ids_of)

    def _safe_parts(self) -> str:
        """A pattern of parts that no merge crosses.

        Cuts lie around characters that have no neighbour in any piece, before a run of blanks, and between an ASCII
        letter and a character that follows none in any piece (with the usual models: every sign and digit).
        """
        if any(pair[1] == BLANK != pair[0] for pair in self.neighbours):
            return "(?s).+"
        joined = {c for pair in self.neighbours for c in pair}
        letters = "".join(c for c in map(chr, range(128)) if c.isalpha() and c in joined)
        after = {pair[1] for pair in self.neighbours if pair[0] in letters}
        alone = "".join(re.escape(c) for c in map(chr, range(128)) if c not in joined)
        signs = "".join(re.escape(c) for c in map(chr, range(128)) if c in joined and c not in after)
        other = f"[^{BLANK}{alone}{letters}]"
        run = f"(?:{other}*[{letters}]+(?![{signs}]))*{other}*[{letters}]*" if letters and signs else f"[^{BLANK}{alone}]*"
        return (f"[{alone}]|" if alone else "") + f"{BLANK}*{run}"

    def normalised(self, text: str) -> tuple[str, np.ndarray]:
        """The text with signs for blanks, and for each of its bytes (and its end) the original byte."""
        if not text:
            return "", np.zeros(1, np.int32)
        if not self.map.units and not self.fewer_blanks:
            return self._unmapped(text)
        data = text.encode()
        out: list[bytes] = []
        source: list[int] = []
        sign = BLANK.encode()
        at, after_blank = 0, self.fewer_blanks
        started = False
        while at < len(data):
            found = self.map.longest(data, at)
            if found is None:  # one character stays
                size = 1 + (data[at] >= 0xC0) + (data[at] >= 0xE0) + (data[at] >= 0xF0)
                new = data[at : at + size]
            else:
                size, new = found
            if after_blank:
                new = new.lstrip(b" ")
            if new and not started and self.blank_in_front:
                out.append(sign)
                source += [at] * len(sign)
            started = started or bool(new)
            if found is None and new != b" ":
                out.append(new)
                source += range(at, at + len(new))
            else:
                signs = new.replace(b" ", sign)
                out.append(signs)
                source += [at] * len(signs)
            if new:
                after_blank = self.fewer_blanks and new.endswith(b" ")
            at += size
        normal = b"".join(out)
        if self.fewer_blanks:
            while normal.endswith(sign):
                normal = normal[: -len(sign)]
                at = source[len(normal)]
        return normal.decode(), np.array([*source[: len(normal)], at if started else 0], np.int32)

    def _unmapped(self, text: str) -> tuple[str, np.ndarray]:
        """Without a map every character is its own longest prefix: the same, in arrays."""
        code = np.frombuffer(text.encode("utf-32-le"), "<u4")
        width = 1 + (code >= 0x80).astype(np.int32) + (code >= 0x800) + (code >= 0x10000)
        starts = np.cumsum(width, dtype=np.int64) - width
        blank = code == 0x20
        inside = np.where(blank, 3, width)
        first = np.cumsum(inside, dtype=np.int64) - inside
        # A byte comes from its own place in its character; all three bytes of a sign come from the blank.
        offset = np.arange(int(inside.sum())) - np.repeat(first, inside)
        offset[np.repeat(blank, inside)] = 0
        source = np.empty(3 * self.blank_in_front + len(offset) + 1, np.int32)
        source[: 3 * self.blank_in_front] = 0
        source[3 * self.blank_in_front : -1] = np.repeat(starts, inside) + offset
        source[-1] = starts[-1] + width[-1]
        return (BLANK if self.blank_in_front else "") + text.replace(" ", BLANK), source

    def _parts(self, text: str) -> list[str]:
        """Parts of a normalised text that no merge crosses."""
        parts = self.find(text)
        if max(map(len, parts), default=0) <= LONG:
            return parts
        out = []
        for part in parts:
            if len(part) <= LONG:
                out.append(part)
                continue
            cuts = [0, *(i for i in range(1, len(part)) if part[i - 1 : i + 1] not in self.neighbours), len(part)]
            out += [part[a:b] for a, b in zip(cuts, cuts[1:])]
        return out

    def merged(self, part: str) -> list[str]:
        """Characters of a part, neighbours merged: the best score first, of equal ones the leftmost."""
        symbols = list(part)
        if len(symbols) <= LONG:
            return self._merged_in_place(symbols)
        n = len(symbols)
        scores = self.scores
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(-scores[p], i, p) for i in range(n - 1) if (p := symbols[i] + symbols[i + 1]) in scores]
        heapify(queue)
        while queue:
            _, left, piece = heappop(queue)
            right = after[left]
            # Symbols only grow, so the pair is still there if its two symbols make up the piece.
            if not symbols[left] or right >= n or len(symbols[left]) + len(symbols[right]) != len(piece):
                continue
            symbols[left], symbols[right] = piece, ""
            after[left] = right = after[right]
            if right < n:
                before[right] = left
                if (p := piece + symbols[right]) in scores:
                    heappush(queue, (-scores[p], left, p))
            ahead = before[left]
            if ahead >= 0 and (p := symbols[ahead] + piece) in scores:
                heappush(queue, (-scores[p], ahead, p))
        return [s for s in symbols if s]

    def _merged_in_place(self, symbols: list[str]) -> list[str]:
        """The same for a few symbols, whose pairs are looked through faster than queued."""
        score = self.scores.get
        pairs = [score(a + b, NO_PIECE) for a, b in zip(symbols, symbols[1:])]
        while pairs and (best := max(pairs)) != NO_PIECE:
            at = pairs.index(best)
            piece = symbols[at] = symbols[at] + symbols[at + 1]
            del symbols[at + 1], pairs[at]
            if at:
                pairs[at - 1] = score(symbols[at - 1] + piece, NO_PIECE)
            if at < len(pairs):
                pairs[at] = score(piece + symbols[at + 1], NO_PIECE)
        return symbols

    def _ids_of(self, part: str) -> bytes:
        ids: list[int] = []
        for piece in self.merged(part):
            own = self.ids.get(piece)
            if own is not None:
                ids.append(own)
            elif self.byte_ids:
                ids += [self.byte_ids[b] for b in piece.encode()]
            else:
                ids.append(self.unknown)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and the spans of original bytes as (begin, end) rows, without begin and end ids."""
        normal, source = self.normalised(text or "")
        parts = self._parts(normal)
        ids = np.frombuffer(b"".join(map(self.known.__getitem__, parts)), "<u4")
        if self.byte_ids is None:
            return self._with_unknown(ids, parts, source)
        ends = np.cumsum(self.sizes[ids], dtype=np.int64)
        return ids, np.stack([source[np.concatenate([[0], ends[:-1]])] if len(ids) else ends, source[ends] if len(ids) else ends], axis=1)

    def plain_ids(self, text: str) -> np.ndarray | None:
        """Ids alone; None where only :meth:`encode` can tell them (with a map, or where unknown pieces are joined)."""
        if self.map.units or self.fewer_blanks or self.byte_ids is None:
            return None
        normal = (BLANK if self.blank_in_front and text else "") + text.replace(" ", BLANK)
        return np.frombuffer(b"".join(map(self.known.__getitem__, self._parts(normal))), "<u4")

    def _with_unknown(self, ids: np.ndarray, parts: list[str], source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spans where unknown symbols have sizes of their own; unknown neighbours become one."""
        out: list[int] = []
        spans: list[list[int]] = []
        at = 0
        for piece in (piece for part in parts for piece in self.merged(part)):
            begin, at = at, at + len(piece.encode())
            own = self.ids.get(piece, self.unknown)
            if own == self.unknown and out and out[-1] == own:
                spans[-1][1] = int(source[at])
                continue
            out.append(own)
            spans.append([int(source[begin]), int(source[at])])
        return np.array(out, "<u4"), np.array(spans, np.int64).reshape(-1, 2)

    def decode(self, ids) -> str:
        """Text of ids: control pieces are nothing, runs of byte pieces are read as UTF-8, the blank in front goes.

        All bytes together are the text, unless a run is broken, a control piece stands inside or blanks were taken away; then it is read run by run.
        """
        if not self.fewer_blanks:
            begin, end = 0, len(ids)
            while begin < end and self.kinds[ids[begin]] == CONTROL:
                begin += 1
            while begin < end and self.kinds[ids[end - 1]] == CONTROL:
                end -= 1
            try:
                text = b"".join(map(self.decoded.__getitem__, ids[begin:end])).decode()
                return text[self.blank_in_front and begin < end and self.kinds[ids[begin]] == NORMAL and text[0] == " " :]
            except UnicodeDecodeError:
                pass
        out: list[str] = []
        run: list[bytes] = []
        at_start = True  # nothing yet, and no blank in front seen
        surface, byte_of, kinds = self.surface, self.byte_of, self.kinds
        strips = self.blank_in_front or self.fewer_blanks
        for i in ids:
            if i in byte_of:
                run.append(byte_of[i])
                continue
            if run:
                out.append(_read(b"".join(run)))
                run.clear()
                at_start = False
            text = surface[i]
            if at_start and text and kinds[i] != UNKNOWN:
                if strips and text[0] == " ":
                    text = text[1:]
                    at_start = self.fewer_blanks and not text
                else:
                    at_start = False
            elif text:
                at_start = False
            out.append(text)
        if run:
            out.append(_read(b"".join(run)))
        return "".join(out)


def _read(data: bytes) -> str:
    """UTF-8, each byte that belongs to no character as the replacement character."""
    out = []
    while data:
        try:
            out.append(data.decode())
            break
        except UnicodeDecodeError as e:
            out += [data[: e.start].decode(), BROKEN]
            data = data[e.start + 1 :]
    return "".join(out)


_MODELS: dict[str, Model] = {}


def model(path: str) -> Model:
    """One model per Python worker; the vocabulary is part of the installation on every machine."""
    if path not in _MODELS:
        with open(path, "rb") as file:
            _MODELS[path] = Model(file.read())
    return _MODELS[path]


def _encoded(tool: Model, text: str | None, begin: bool, end: bool) -> tuple[np.ndarray, np.ndarray]:
    """Ids and spans; begin and end ids span nothing at the text's ends."""
    ids, spans = tool.encode(text)
    size = int(spans[-1, 1]) if len(spans) else 0
    head, tail = [tool.begin] * begin, [tool.end] * end
    ids = np.concatenate([np.array(head, "<u4"), ids, np.array(tail, "<u4")])
    return ids, np.concatenate([np.zeros((len(head), 2), spans.dtype), spans, np.full((len(tail), 2), size, spans.dtype)])


def piece_spans(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", begin: bool = True, end: bool = True) -> DataFrame:
    """id, ids (array<int>), begins and ends (array<int>): each piece's span of original UTF-8 bytes."""
    python_ready(docs.sparkSession)
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = model(model_path)
        for batch in batches:
            found = [_encoded(tool, text, begin, end) for text in batch.column(1).to_pylist()]
            offsets = pa.array(np.cumsum([0, *(len(ids) for ids, _ in found)]), pa.int32())
            flat = [np.concatenate([x for x in column] or [np.zeros(0)]).astype(np.int32) for column in zip(*[(ids, spans[:, 0], spans[:, 1]) for ids, spans in found])]
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in flat]
            if found:
                yield pa.RecordBatch.from_arrays([batch.column(0), *lists], [id_col, "ids", "begins", "ends"])

    schema = rows.drop(text_col).schema
    for name in ("ids", "begins", "ends"):
        schema = schema.add(name, T.ArrayType(T.IntegerType()))
    return rows.mapInArrow(run, schema)


def piece_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256 and covered_bytes (original bytes that some piece spans), with begin and end ids."""
    python_ready(docs.sparkSession)
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = model(model_path)
        for batch in batches:
            sizes, hashes, decoded, covered = [], [], [], []
            for text in batch.column(1).to_pylist():
                ids, spans = _encoded(tool, text, True, True)
                sizes.append(len(ids))
                hashes.append(hashlib.sha256(ids.tobytes()).hexdigest())
                decoded.append(hashlib.sha256(tool.decode(ids.tolist()).encode()).hexdigest())
                covered.append(int((spans[:, 1] - spans[:, 0]).sum()))  # spans follow one another and share no byte
            columns = [pa.array(sizes, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string()), pa.array(covered, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, "n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes"])

    schema = rows.drop(text_col).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string").add("covered_bytes", "long")
    return rows.mapInArrow(run, schema)


def decoded_pieces(ids: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """Other columns and text; null ids are the empty text."""
    python_ready(ids.sparkSession)
    names = [c for c in ids.columns if c != ids_col]
    rows = ids.select(*[F.col(f"`{n}`") for n in names], F.col(f"`{ids_col}`").alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = model(model_path)
        for batch in batches:
            texts = [tool.decode(x or []) for x in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(texts, pa.string())], [*names, "text"])

    return rows.mapInArrow(run, rows.drop("_ids").schema.add("text", "string"))
