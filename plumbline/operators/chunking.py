"""Chunks of texts and what they overlap."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import python_ready


def window_chunks(docs: DataFrame, id_col: str, text_col: str = "text", size: int = 128, overlap: int = 32) -> DataFrame:
    """Rows (id, chunk, n_tokens, text): windows of ``size`` words that start every ``size - overlap`` words."""
    words = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    rows = docs.select(F.col(id_col).alias("id"), words.alias("w"))
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.size("w") - overlap) / step).cast("int") - 1)
    # Chunk numbers are generated and empty texts left out after that: Spark would move a filter on the words, or one
    # that it infers from an inner generator, below the split and so split every text once more.
    numbered = rows.select("id", "w", F.explode_outer(F.when(F.size("w") > 0, F.sequence(F.lit(0), last))).alias("chunk")).where("chunk IS NOT NULL")
    spread = numbered.select("id", "chunk", F.slice("w", F.col("chunk") * step + 1, size).alias("words"))
    return spread.select("id", "chunk", F.size("words").cast("long").alias("n_tokens"), F.array_join("words", " ").alias("text"))


#: Separators of the recursive splitter, from coarse to fine; the last one parts single characters.
SEPARATORS = (r"\n\n", r"\n", r"\n[0-9]+\.\s", r"\n\([a-z]\)\s", r"\n\([ivx]+\)\s", r"\. ", " ", "")


#: Numbers of tokens of many pieces at once.
Lengths = Callable[[list[str]], list[int]]


def count_words(pieces: list[str]) -> list[int]:
    return [len(p.split()) for p in pieces]


def count_characters(pieces: list[str]) -> list[int]:
    return [len(p) for p in pieces]


class TokenCounter:
    """Numbers of tokens by a file of byte-level ranks, which every worker reads once from its own installation."""

    _tools: dict[tuple[str, str], object] = {}

    def __init__(self, ranks_path: str, pattern: str):
        self.key = (ranks_path, pattern)

    def __call__(self, pieces: list[str]) -> list[int]:
        tool = self._tools.get(self.key)
        if tool is None:
            import base64

            import tiktoken

            path, pattern = self.key
            with open(path, "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            tool = self._tools[self.key] = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return [len(tool.encode_ordinary(p)) for p in pieces]


def _parts(text: str, low: int, high: int, separators: tuple[str, ...]) -> tuple[list[int], tuple[str, ...]]:
    """Cuts of a span at its coarsest separator that occurs (each starts a part), and the separators finer than that."""
    for at, separator in enumerate(separators):
        if not separator:
            return list(range(low, high + 1)), ()
        starts = [m.start() for m in re.compile(separator).finditer(text, low, high) if m.start() > low]
        if starts or re.compile(separator).match(text, low, high):
            return [low, *starts, high], separators[at + 1 :]
    return [low, high], ()


def joined_runs(sums: list[int], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Runs of neighbours that are at most ``size`` together, from the running sums of their lengths (which begin with 0).

    A run starts with the last parts of the one before, as many as are at most ``overlap`` and leave room for the next.
    """
    first = 0
    for at in range(len(sums) - 1):
        if at > first and sums[at + 1] - sums[first] > size:
            yield first, at
            while sums[at] - sums[first] > overlap or (sums[at + 1] - sums[first] > size and sums[at] > sums[first]):
                first += 1
    if first < len(sums) - 1:
        yield first, len(sums) - 1


def split_spans(text: str, size: int, overlap: int, lengths: Lengths, separators: tuple[str, ...] = SEPARATORS) -> list[tuple[int, int, int]]:
    """(start, end, length) of pieces: a text is parted at the coarsest separator that occurs, and parts of ``size`` or more
    at finer ones; shorter neighbours are joined up to ``size``.

    A separator stays with the part that follows it. Every part is measured once: the length of a joined run is the
    difference of two running sums. White space at the ends of joined pieces goes; blank ones are left out.
    """


    def split(low: int, high: int, separators: tuple[str, ...]) -> Iterator[tuple[int, int, int]]:
        cuts, finer = _parts(text, low, high, separators)
        spans = [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]
        measured = lengths([text[a:b] for a, b in spans])
        at = 0
        while at < len(spans):
            end = at
            while end < len(spans) and measured[end] < size:
                end += 1
            sums = [0, *accumulate(measured[at:end])]
            for first, last in joined_runs(sums, size, overlap):
                a, b = spans[at + first][0], spans[at + last - 1][1]
                piece = text[a:b]
                a, b = b - len(piece.lstrip()), a + len(piece.rstrip())
                if a < b:
                    yield a, b, sums[last] - sums[first]
            if end < len(spans):
                if finer:
                    yield from split(*spans[end], finer)
                else:
                    yield *spans[end], measured[end]
            at = end + 1

    return list(split(0, len(text), separators)) if text else []


def split_text(text: str, size: int, overlap: int, lengths: Lengths, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Texts of the spans of :func:`split_spans`."""
    return [text[a:b] for a, b, _ in split_spans(text, size, overlap, lengths, separators)]


def located(text: str, pieces: list[str]) -> list[tuple[int, int]]:
    """Where each piece stands: looked for after the start of the one before; if it is not found, there."""
    out, since = [], 0
    for piece in pieces:
        at = text.find(piece, since)
        at = since if at < 0 else at
        out.append((at, at + len(piece)))
        since = max(since, at + 1)
    return out


def recursive_chunks(
    docs: DataFrame, id_col: str, text_col: str = "text", size: int = 1024, overlap: int = 128, lengths: Lengths = count_words, separators: tuple[str, ...] = SEPARATORS
) -> DataFrame:
    """Rows (id, chunk_id, chunk, n_tokens, char_start, char_end, text) of the recursive splitter; ``lengths`` measures pieces.

    ``n_tokens`` adds up what the parts of a chunk measure. A null text has no chunks.
    """
    python_ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, chunk, sizes, starts, ends, texts = [], [], [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                spans = split_spans(text or "", size, overlap, lengths, separators)
                pieces = [text[a:b] for a, b, _ in spans]
                for i, (piece, (a, b), (_, _, n)) in enumerate(zip(pieces, located(text or "", pieces), spans)):
                    for column, value in zip((index, chunk, sizes, starts, ends, texts), (k, i, n, a, b, piece)):
                        column.append(value)
            numbers = [pa.array(chunk, pa.int32()), pa.array(sizes, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())]
            columns = [batch.column(0).take(pa.array(index, pa.int64())), *numbers, pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "chunk", "n_tokens", "char_start", "char_end", "text"])

    found = rows.mapInArrow(run, f"id {kind}, chunk int, n_tokens long, char_start int, char_end int, text string")
    return found.select("id", F.format_string("%s_chunk_%04d", F.col("id").cast("string"), "chunk").alias("chunk_id"), "chunk", "n_tokens", "char_start", "char_end", "text")


#: Characters of a cell of the overlap join: about a chunk, so that a cell meets few intervals of either side.
CELL = 1024


def overlap_pairs(left: DataFrame, right: DataFrame, on: str, left_span: tuple[str, str], right_span: tuple[str, str], cell: int = CELL) -> DataFrame:
    """Columns of both sides and ``shared``, for every two rows with one key whose spans [start, end) share a position.

    Spans are cut into cells of a fixed width and joined by key and cell, so a long document is spread over as many keys as
    it has cells; two spans that meet in several cells are one pair in the first of these. Joined rows are about linear in
    the input if spans of one side seldom overlap and ``cell`` is about their length. Null and empty spans meet nothing.
    Columns other than ``on`` must have different names.
    """

    def cells(rows: DataFrame, span: tuple[str, str], first: str) -> DataFrame:
        start, end = F.col(span[0]), F.col(span[1])
        at = lambda c: F.floor(c / cell).cast("long")
        placed = rows.where(end > start).withColumn(first, at(start))
        return placed.withColumn("_cell", F.explode(F.sequence(F.col(first), at(end - 1))))

    both = cells(left, left_span, "_left_first").join(cells(right, right_span, "_right_first"), [on, "_cell"])
    shared = F.least(left_span[1], right_span[1]) - F.greatest(left_span[0], right_span[0])
    met = both.where((shared > 0) & (F.col("_cell") == F.greatest("_left_first", "_right_first")))
    return met.withColumn("shared", shared).drop("_cell", "_left_first", "_right_first")


def tag_sections(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """Chunks (id, chunk, char_start, char_end) with the section that overlaps most; ties go to the first.

    Chunks that overlap nothing are Unknown.
    """
    s = sections.select("id", "pos", F.col("section_type").alias("_type"), "start_char", "end_char")
    met = overlap_pairs(chunks.select("id", "chunk", "char_start", "char_end"), s, "id", ("char_start", "char_end"), ("start_char", "end_char"))
    best = met.groupBy("id", "chunk").agg(F.max_by("_type", F.struct("shared", (-F.col("pos")).alias("p"))).alias("section_type"))
    return chunks.drop("section_type").join(best, ["id", "chunk"], "left").withColumn("section_type", F.coalesce("section_type", F.lit("Unknown")))


def assign_pages(chunks: DataFrame, starts: DataFrame) -> DataFrame:
    """Chunks with the last page that begins at or before them: an as-of join by a window over both.

    Page starts and chunks of a document are one ordered sequence; each chunk takes the last page seen.
    """
    pages = starts.select(F.col("doc").alias("id"), F.col("boundary").alias("at"), F.lit(0).alias("kind"), F.col("page").alias("_page"), F.lit(None).alias("_c"))
    rows = chunks.select("id", F.col("char_start").cast("long").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(pages.schema["_page"].dataType).alias("_page"), F.struct(*chunks.columns).alias("_c"))
    both = pages.withColumn("_c", F.lit(None).cast(rows.schema["_c"].dataType)).withColumn("at", F.col("at").cast("long")).unionByName(rows)
    order = Window.partitionBy("id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("page_number", F.last("_page", ignorenulls=True).over(order)).where("kind = 1")
    return seen.select("_c.*", "page_number")


def with_document_columns(chunks: DataFrame, docs: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Chunks with metadata of their documents; ``columns`` names the expressions over ``docs`` (keyed by id)."""
    return chunks.join(docs.select("id", *[c.alias(n) for n, c in columns.items()]), "id", "left")
