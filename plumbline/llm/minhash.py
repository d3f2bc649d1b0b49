"""MinHash near-dedup: universal hash minima, banding, verification, components.

1. Each text becomes its set of distinct word shingles (64-bit hashes) and ``bands * rows`` minima of random linear
   hashes. Texts with equal sets form a class; one class counts once from here on, however many copies it has.
2. Every band of minima is a bucket. Each bucket has a centre (its class with the least hash of class and bucket), and
   all other members are paired with it: one pair per row, never all pairs. Pairs whose signatures agree far too
   little are dropped; the rest are confirmed on the full sets.
3. The confirmed links give components. A bucket whose members are still in several components may hide more links:
   its members outside its largest component are compared with all of its members on the full sets, in blocks of
   bounded size that are spread over tasks; a block returns one link per text and component.
4. Links of both kinds give the final components by alternating large-star and small-star.

No link is lost in step 3, so a link is missed only if no band agrees: (1 - s**rows)**bands, below 5e-8 at 0.8 with 32
bands of 4.

Cases: a null text or one without words has an empty set and no link; a text with fewer words than a shingle is one
shingle; equal ids are one node; a null id joins the component of equal sets and is kept only if it has no other id;
an empty table gives an empty result; other columns are ignored. ``without_near_copies`` numbers the rows first, so
there every row is a node of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.components import connected_components
from plumbline.llm.hashing import BASE, U, WordHashes, mixed
from plumbline.llm.lookup import rows_with_ids
from plumbline.session import few, python_ready, release, staged

BANDS, ROWS = 32, 4
#: Bytes of sets outside the largest component and of sets at all that one block of step 3 compares, about.
SMALL_BLOCK, FULL_BLOCK = 1 << 19, 1 << 19
#: Rows of one task at least: rows with a signature, and pairs to compare on their sets.
SIGNED, COMPARED = 25_000, 4_000

_WORDS = WordHashes()
_RANDOM = np.random.default_rng(20240229)
_FACTORS = _RANDOM.integers(0, 2**31, 1024, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_OFFSETS = _RANDOM.integers(0, 2**32, 1024, dtype=np.uint32)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text in lower case (A-Z)."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, U)
    h = _WORDS.of(words)
    n = max(1, len(words) - size + 1)
    out = np.full(n, min(size, len(words)), U)
    for k in range(min(size, len(words))):
        out = out * U(BASE) + h[k : k + n]
    return np.unique(mixed(out))


def signature(hashes: np.ndarray, k: int) -> np.ndarray:
    """``k`` minima of the hashes under random linear functions modulo 2**32."""
    low = (hashes >> U(32)).astype(np.uint32)
    best = np.full(k, 2**32 - 1, np.uint32)
    for at in range(0, len(low), 1024):
        part = low[at : at + 1024, None] * _FACTORS[None, :k]
        part += _OFFSETS[None, :k]
        np.minimum(best, part.min(axis=0), out=best)
    return best


def _sketch(size: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                counts, first, second, signatures = [], [], [], []
                for text in batch.column(1).to_pylist():
                    s = shingle_set(text, size)
                    counts.append(len(s))
                    first.append(s.sum(dtype=U))
                    second.append(mixed(s ^ U(BASE)).sum(dtype=U))
                    signatures.append(signature(s, k))
                flat = np.concatenate(signatures).view(np.int32) if signatures else np.zeros(0, np.int32)
                ends = pa.array(np.arange(len(counts) + 1, dtype=np.int32) * k)
                columns = [batch.column(0), pa.array(counts, pa.int64()), *[pa.array(np.array(x, U).view(np.int64)) for x in (first, second)]]
                yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(ends, pa.array(flat))], ["id", "n", "set_a", "set_b", "signature"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                sets = [shingle_set(t, size).tobytes() for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "hashes"])

    return run


def similar(intersection, left, right, percent: int):
    """100 * intersection >= percent * union, in whole numbers."""
    return 100 * intersection >= percent * (left + right - intersection)


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                both = np.concatenate([x, y])
                both.sort()
                keep.append(bool(similar(int((both[1:] == both[:-1]).sum()), len(x), len(y), percent)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _block(percent: int):
    """Links between the texts of a block that are outside their crowd's largest component and all others: one per text and component."""

    def run(rows: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, U) for x in rows.column("hashes").to_pylist()]
        ids, parts, whole = (rows.column(c).to_numpy() for c in ("id", "component", "full"))
        sizes = np.array([len(x) for x in sets])
        # Sets in the order of their sizes: those that may be similar to one are neighbours.
        full = np.flatnonzero(whole)
        full = full[np.argsort(sizes[full], kind="stable")]
        flat = np.concatenate([sets[i] for i in full]) if len(full) else np.zeros(0, U)
        ends = np.cumsum(sizes[full])
        starts = ends - sizes[full]
        out = set()
        for i in np.flatnonzero(~whole) if len(full) else ():
            lo = int(np.searchsorted(100 * sizes[full], percent * sizes[i], "left"))
            hi = int(np.searchsorted(percent * sizes[full], 100 * sizes[i], "right"))
            if lo >= hi:
                continue
            near, part = full[lo:hi], flat[starts[lo] : ends[hi - 1]]
            at = np.minimum(np.searchsorted(sets[i], part), len(sets[i]) - 1)
            shared = np.add.reduceat((sets[i][at] == part).astype(np.int64), starts[lo:hi] - starts[lo])
            linked = similar(shared, sizes[i], sizes[near], percent) & (parts[near] != parts[i])
            _, one = np.unique(parts[near][linked], return_index=True)
            out.update((int(ids[i]), int(x)) for x in ids[near][linked][one])
        found = sorted(out)
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return run


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 2, percent: int = 80, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """Per row: id, n_shingles, component_id (least id reachable) and kept (it is the row's own id)."""
    python_ready(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketches = staged(texts.mapInArrow(_sketch(shingle, bands * rows), "id long, n long, set_a long, set_b long, signature array<int>"))
    total = sketches.count()
    key = ["n", "set_a", "set_b"]
    classes = sketches.where("n > 0").groupBy(key).agg(F.min("id").alias("node"), F.first("signature").alias("signature"))
    classes = staged(few(classes, total, SIGNED))
    nodes = classes.where("node IS NOT NULL")
    links = _links(nodes, texts, total, shingle, percent, bands, rows)
    components = connected_components(links)
    release(links)
    c, m = few(nodes.select("node", *key), total).alias("c"), components.alias("m")
    named = c.join(m, F.col("c.node") == F.col("m.node"), "left").select("c.*", F.coalesce("m.component", "c.node").alias("component"))
    named = staged(few(named, total))
    release(classes, components)
    joined = few(sketches.drop("signature"), total).join(few(named, total), key, "left")
    found = F.coalesce("component", "id")
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), found.alias("component_id"), F.col("id").eqNullSafe(found).alias("kept"))


def _links(nodes: DataFrame, texts: DataFrame, total: int, shingle: int, percent: int, bands: int, rows: int) -> DataFrame:
    """Links a, b between classes; they connect all that are similar. ``total``: rows at most."""
    band = lambda b: F.xxhash64(b, *[F.element_at("signature", b * rows + r + 1) for r in range(rows)])
    buckets = few(nodes, total, SIGNED).select("node", F.col("n").cast("int").alias("n"), F.explode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), band)).alias("bucket"))
    centre = F.min(F.struct(F.xxhash64("node", "bucket").alias("h"), "node")).alias("centre")
    centres = buckets.groupBy("bucket").agg(centre, F.count(F.lit(1)).alias("size")).where("size > 1").select("bucket", F.col("centre.node").alias("centre"), "size")
    centres = staged(few(centres, total * bands))
    shared = staged(few(buckets.join(few(centres, total * bands), "bucket"), total * bands))
    release(centres)
    pairs = few(shared, total * bands).where("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    # Signature verification: an estimate six standard errors below the threshold rules a pair out.
    share = percent / 100
    least = share - 6 * (share * (1 - share) / (bands * rows)) ** 0.5
    signed = few(nodes.select("node", "signature"), total, SIGNED)
    with_a = few(pairs, total * bands).join(signed.withColumnsRenamed({"node": "a", "signature": "sign_a"}), "a")
    with_b = few(with_a, total * bands, SIGNED).join(signed.withColumnsRenamed({"node": "b", "signature": "sign_b"}), "b")
    agree = F.size(F.filter(F.zip_with("sign_a", "sign_b", lambda x, y: x == y), lambda e: e))
    pairs = staged(few(with_b.where(agree >= least * bands * rows).select("a", "b"), total * bands, SIGNED))
    n_pairs = pairs.count()
    near = few(pairs, n_pairs)
    members = few(near.select(F.col("a").alias("node")).union(near.select(F.col("b").alias("node"))), n_pairs).distinct()
    sets = _sets_of(texts, few(members, n_pairs), n_pairs, shingle)
    left = few(near.join(sets.withColumnsRenamed({"id": "a", "hashes": "set_a"}), "a"), n_pairs, COMPARED)
    both = left.join(sets.withColumnsRenamed({"id": "b", "hashes": "set_b"}), "b").select("a", "b", "set_a", "set_b")
    star = staged(few(both, n_pairs, COMPARED).mapInArrow(_confirmed(percent), "a long, b long"))
    release(pairs, sets)
    rest = _rest(shared, few(star, n_pairs), texts, shingle, percent)
    links = staged(few(star.unionByName(rest), n_pairs))
    release(shared, star, rest)
    return few(links, n_pairs)


def _sets_of(texts: DataFrame, members: DataFrame, n_members: int, shingle: int) -> DataFrame:
    """id and the sorted hashes of the whole set, as bytes."""
    members = staged(members)
    own = rows_with_ids(texts, members, "id", "node").select("id", "text")
    sets = staged(few(own.mapInArrow(_sets(shingle), "id long, hashes binary").dropDuplicates(["id"]), n_members, COMPARED))
    release(members)
    return few(sets, n_members, COMPARED)


def _rest(shared: DataFrame, star: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links that the pairs with centres leave out: within buckets of three or more whose members are not yet connected."""
    parts = connected_components(star)
    m, p = few(shared.where("size > 2"), shared.count()).alias("m"), parts.alias("p")
    many = m.join(p, F.col("m.node") == F.col("p.node"), "left").select("m.bucket", "m.node", "m.n", F.coalesce("p.component", "m.node").alias("component"))
    many = staged(many)
    n_many = many.count()
    many = few(many, n_many)
    release(parts)
    open_ = many.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("bucket")
    crowd = staged(many.join(staged(open_), "bucket"))
    release(many)
    n_crowd = crowd.count()
    crowd = few(crowd, n_crowd)
    shares = crowd.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("share"))
    largest = staged(shares.groupBy("bucket").agg(F.max_by("component", F.struct("share", "component")).alias("largest")))
    marked = staged(crowd.join(few(largest, n_crowd), "bucket").withColumn("small", F.col("component") != F.col("largest")))
    release(crowd, largest)
    marked = few(marked, n_crowd)
    # The bands of one crowd have about the same members. Where that moves less, all buckets with one largest
    # component are compared as one group: the pairs of each bucket are among those of the group.
    own = F.col("n").cast("long") * 8
    sums = [F.sum(own).alias("bytes"), F.sum(F.when(F.col("small"), own).otherwise(F.lit(0))).alias("outside")]
    blocks_of = lambda size, block: F.greatest(F.lit(1), F.ceil(size / block)).cast("int")
    n_small, n_full = blocks_of(F.col("outside"), SMALL_BLOCK), blocks_of(F.col("bytes"), FULL_BLOCK)
    moved = F.col("bytes") * n_small + F.col("outside") * n_full
    apart = marked.groupBy("bucket", "largest").agg(*sums).groupBy("largest").agg(F.sum(moved).alias("apart"))
    whole = marked.groupBy("largest", "node", "n").agg(F.bool_or("small").alias("small")).groupBy("largest").agg(*sums).select("largest", moved.alias("together"))
    chosen = staged(apart.join(whole, "largest").select("largest", (F.col("together") < F.col("apart")).alias("merged")))
    key = ["merged", "bucket"]
    grouped = marked.join(few(chosen, n_crowd), "largest").withColumn("bucket", F.when(F.col("merged"), F.col("largest")).otherwise(F.col("bucket")))
    grouped = staged(grouped.groupBy(*key, "node", "n", "component").agg(F.bool_or("small").alias("small")))
    release(marked, chosen)
    grouped = few(grouped, n_crowd)
    sizes = staged(grouped.groupBy(*key).agg(*sums).select(*key, n_small.alias("n_small"), n_full.alias("n_full")))
    rows = grouped.join(few(sizes, n_crowd), key)
    at = lambda seed, n: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    as_full = rows.select(*key, "node", "component", F.lit(True).alias("full"), every("n_small").alias("s"), at(0, "n_full").alias("f"))
    as_small = rows.where("small").select(*key, "node", "component", F.lit(False).alias("full"), at(1, "n_small").alias("s"), every("n_full").alias("f"))
    sets = _sets_of(texts, few(grouped.select("node"), n_crowd).distinct(), n_crowd, shingle)
    ready = few(as_full.unionByName(as_small), n_crowd).join(sets.withColumnRenamed("id", "node"), "node").select(*key, "s", "f", F.col("node").alias("id"), "component", "full", "hashes")
    found = staged(ready.groupBy(*key, "s", "f").applyInArrow(_block(percent), "a long, b long"))
    release(grouped, sizes, sets)
    return found


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 2, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component, the one with the smallest id (null last), of equal ids the first.

    All columns are staged with a row number, which is the node: a row goes for its own text alone, whatever other rows
    have its id, and rows of equal or near texts are copies of each other also under one id or none.
    """
    at = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    rows = staged(docs.toDF(*at.values()).withColumn("row", F.monotonically_increasing_id()))
    found = near_duplicates(rows, "row", at[text_col], shingle, percent).select("row", F.col("component_id").alias("component"))
    found = staged(found)
    total = found.count()
    found = few(found, total)
    several = staged(found.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component"))
    members = staged(found.join(few(several, total), "component"))
    release(found, several)
    ids = rows_with_ids(rows.select("row", F.col(at[id_col]).alias("id")), members.select("row"), "row", "row")
    first = F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("row").alias("row")))["row"]
    named = few(members, total).join(few(ids, total), "row")
    kept = named.groupBy("component").agg(first.alias("row")).select("row")
    gone = staged(few(members.select("row"), total).join(few(kept, total), "row", "left_anti"))
    release(members)
    return rows_with_ids(rows, gone, "row", "row", without=True).drop("row").toDF(*docs.columns)
