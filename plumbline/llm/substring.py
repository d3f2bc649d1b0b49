"""Substring dedup over a de Bruijn graph of words.

Windows of ``window`` words are the edges of the graph, between nodes of ``window - 1`` words. Edges that follow each
other in a text and share their anchor (the leftmost least hash of ``seed`` words inside the window) form a path; a
path has no branch inside and stands for up to ``window - seed + 1`` edges with one row. Equal windows have equal
anchors at equal places, so repeats only meet under one anchor:

1. Anchors that occur once are dropped; their paths repeat nothing. Up to here hashes only choose candidates.
2. The source coordinates of the other paths lead back to the texts, where the words themselves are compared: by the
   SHA-256 of the path's words, which takes the place of the hash. Paths of the same words compact to one, and those
   that occur twice or more are repeated as a whole.
3. An anchor with several distinct paths branches: one occurrence of each is read again at its source coordinates, edge
   by edge; an edge whose words two distinct paths share is repeated.

Spans found are removed in a last reading of the texts that have any; the others keep the digest of the first reading.

Cases: a null or empty text has no words; a text shorter than a window is left whole; windows are judged on the input;
repeated rows count as other places, so both lose the windows they share; rows with equal ids and different texts are
kept apart; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.hashing import Runs, WordHashes
from plumbline.llm.lookup import rows_with_ids
from plumbline.llm.words import word_list
from plumbline.session import python_ready, release, staged

WINDOW = 35

_WORDS = WordHashes()


def paths(hashes: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window and number of windows of every path of a text."""
    n = len(hashes) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.int32), none.astype(np.int32)
    at = np.arange(len(hashes) - seed + 1)
    seeds = Runs(hashes).of(at, at + seed)
    place = np.arange(n) + np.lib.stride_tricks.sliding_window_view(seeds, window - seed + 1).argmin(axis=1)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    end = np.concatenate([first[1:], [n]])
    return seeds[place[first]].view(np.int64), first.astype(np.int32), (end - first).astype(np.int32)


def compared(words: list[bytes], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Per run of words [start, end): the first 16 bytes of its SHA-256, as two longs."""
    whole = memoryview(b" ".join(words))
    offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
    out = [hashlib.sha256(whole[a:b]).digest()[:16] for a, b in zip(offsets[starts].tolist(), (offsets[ends] - 1).tolist(), strict=True)]
    return np.frombuffer(b"".join(out), np.int64).reshape(-1, 2)


def _lists(values: list[np.ndarray], kind) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values) if values else [], kind))


def _read(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, found = [], [], []
            for text in batch.column(2).to_pylist():
                words = (text or "").encode().split()
                sizes.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                found.append(paths(_WORDS.of(words), window, seed))
            lists = [_lists([f[k] for f in found], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.int32()))]
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), *lists]
            yield pa.RecordBatch.from_arrays(columns, ["id", "mark", "n_words", "sha256", "anchor", "first", "n"])

    return run


def _at_source(window: int, single: bool):
    """Rows id, mark, spans, text to one row for each span, or each single edge of the spans, with the digest of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, anchors, times, starts, sizes, digests = [], [], [], [], [], []
            for k, (own, text) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                words = (text or "").encode().split()
                at, n = np.array([s["first"] for s in own], np.int64), np.array([s["n"] for s in own], np.int64)
                index = np.repeat(np.arange(len(own)), n if single else 1)
                if single:
                    at, n = np.concatenate([np.arange(a, a + m) for a, m in zip(at, n, strict=True)]), np.ones(len(index), np.int64)
                rows.append(np.full(len(index), k))
                anchors.append(np.array([s["anchor"] for s in own], np.int64)[index])
                times.append(np.array([s["times"] for s in own], np.int64)[index])
                starts.append(at.astype(np.int32))
                sizes.append(n.astype(np.int32))
                digests.append(compared(words, at, at + n + window - 1))
            if not rows:
                continue
            index, both = pa.array(np.concatenate(rows)), np.concatenate(digests)
            columns = [batch.column(0).take(index), batch.column(1).take(index)]
            columns += [pa.array(np.concatenate(x)) for x in (anchors, times, starts, sizes)] + [pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "mark", "anchor", "times", "first", "n", "words_a", "words_b"])

    return run


def _kept(window: int):
    """Rows id, mark, spans, text to what is left of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, texts = [], [], []
            for own, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = (text or "").encode().split()
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, [s["first"] for s in own], 1)
                np.add.at(change, [s["first"] + s["n"] + window - 1 for s in own], -1)
                stays = np.cumsum(change[:-1]) == 0
                sizes.append(len(words))
                removed.append(len(words) - int(stays.sum()))
                texts.append(b" ".join([words[i] for i in np.flatnonzero(stays)]).decode())
            columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "mark", "n_words", "n_removed", "kept"])

    return run


def repeated_spans(docs: DataFrame, first_reading: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per (id, mark) with any repeated window: spans, an array of (first window, number of windows)."""
    schema = f"id {docs.schema['id'].dataType.simpleString()}, mark long, anchor long, times long, first int, n int, words_a long, words_b long"
    words = ["anchor", "words_a", "words_b"]
    step = first_reading.select("id", "mark", F.explode(F.arrays_zip("anchor", "first", "n")).alias("p")).select("id", "mark", "p.*")
    anchors = staged(step.groupBy("anchor").agg(F.count(F.lit(1)).alias("times")).where("times > 1"))
    spans = step.join(anchors, "anchor").groupBy("id", "mark").agg(F.collect_set(F.struct("anchor", "times", "first", "n")).alias("spans"))
    spans = staged(spans)
    release(anchors)
    live = staged(_with_texts(docs, spans).mapInArrow(_at_source(window, False), schema).drop("times"))
    release(spans)
    place = F.min(F.struct("id", "mark", "first", "n")).alias("place")
    distinct = staged(live.groupBy(*words).agg(F.count(F.lit(1)).alias("times"), place))
    # Single edges of one occurrence of each distinct path, at their source coordinates.
    branching = distinct.groupBy("anchor").agg(F.count(F.lit(1)).alias("paths")).where("paths > 1").select("anchor")
    spans = distinct.join(branching, "anchor", "left_semi").groupBy(F.col("place.id").alias("id"), F.col("place.mark").alias("mark")).agg(
        F.collect_list(F.struct("anchor", "times", F.col("place.first").alias("first"), F.col("place.n").alias("n"))).alias("spans")
    )
    spans = staged(spans)
    edges = staged(_with_texts(docs, spans).mapInArrow(_at_source(window, True), schema))
    release(spans)
    shared = staged(edges.groupBy(*words).agg(F.count(F.lit(1)).alias("paths")).where("paths > 1").select(*words))
    single = edges.where("times = 1").join(shared, words, "left_semi").select("id", "mark", "first", "n")
    whole = live.join(distinct.where("times > 1").select(*words), words, "left_semi").select("id", "mark", "first", "n")
    out = staged(whole.unionByName(single).groupBy("id", "mark").agg(F.collect_set(F.struct("first", "n")).alias("spans")))
    release(live, distinct, edges, shared)
    return out


def _with_texts(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """id, mark, spans, text of the documents that have spans; repeated rows get a row each."""
    own = rows_with_ids(docs, spans.select("id").distinct(), "id", "id")
    d, s = own.alias("d"), spans.alias("s")
    on = F.col("d.id").eqNullSafe(F.col("s.id")) & (F.col("d.mark") == F.col("s.mark"))
    return d.join(s, on).select("d.id", "d.mark", "s.spans", "d.text")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, texts: bool = True) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256 and, if asked for, kept (the words that stay, joined by one space).

    Without ``texts`` only documents that lose words are read again.
    """
    python_ready(docs.sparkSession)
    seed = max(1, window // 3)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("mark"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType
    lists = [T.StructField(c, T.ArrayType(t, False)) for c, t in (("anchor", T.LongType()), ("first", T.IntegerType()), ("n", T.IntegerType()))]
    schema = T.StructType([T.StructField("id", kind), *T.StructType.fromDDL("mark long, n_words long, sha256 string").fields, *lists])
    read = staged(rows.mapInArrow(_read(window, seed), schema))
    spans = repeated_spans(rows, read, window)
    changed = _with_texts(rows, spans).mapInArrow(_kept(window), f"id {kind.simpleString()}, mark long, n_words long, n_removed long, kept string")
    r, s = (read if not texts else rows).alias("r"), spans.alias("s")
    same = F.col("r.id").eqNullSafe(F.col("s.id")) & (F.col("r.mark") == F.col("s.mark"))
    rest = r.join(s, same, "left_anti")
    if texts:
        rest = rest.select(F.col("id"), F.lit(0).cast("long").alias("n_removed"), F.array_join(word_list(F.col("text")), " ").alias("kept"))
        rest = rest.select("id", F.size(word_list(F.col("kept"))).cast("long").alias("n_words"), "n_removed", "kept")
        found = rest.unionByName(changed.drop("mark")).withColumn("kept_sha256", F.sha2("kept", 256))
        return found.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept_sha256", "kept")
    rest = rest.select("id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha256").alias("kept_sha256"))
    found = rest.unionByName(changed.select("id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")))
    return found.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept_sha256")
