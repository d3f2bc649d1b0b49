"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import few, release, staged

#: Edges of one task; a graph with no more of them is worked on without shuffles.
EDGES = 250_000


def _fingerprint(edges: DataFrame) -> tuple:
    """Number and fingerprint of distinct edges; equal for equal sets."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def _least(found: DataFrame, n: int) -> DataFrame:
    """The least neighbours; in a large graph computed before they are joined, so that a hot node's partition can be split."""
    return staged(found) if n > EDGES else found


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Every node links its larger neighbours to the least of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    both = few(both, 2 * n, 2 * EDGES)
    least = _least(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), n)
    moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    if n <= EDGES:
        return moved  # one task; its two readers work it out anew
    out = staged(moved)
    release(least)
    return few(out, n, EDGES)


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Every node links its smaller neighbours and itself to the least of them. Edges run from u to a smaller v."""
    least = _least(edges.groupBy("u").agg(F.min("v").alias("m")), n)
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    out = staged(few(moved.unionByName(least.select("u", F.col("m").alias("v"))), 2 * n, 2 * EDGES).distinct())
    release(least)
    return out


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and component (its least node) of every node that has a link; links are undirected pairs of longs.

    Each round is two joins on the edges that are left and cuts the lineage; rounds go on until the edges are stars,
    which takes about the logarithm of the longest path. Nulls and loops are ignored, repeated links count once.
    """
    stars = staged(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = _fingerprint(stars)
    while before[0]:
        wide = _large_star(few(stars, before[0], EDGES), before[0])
        narrow = _small_star(wide, before[0])
        release(stars, wide)
        stars = narrow
        now = _fingerprint(stars)
        if now == before:
            break
        before = now
    edges = few(stars, before[0], EDGES)
    both = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out = staged(few(both, 2 * before[0], 2 * EDGES))
    release(stars)
    return few(out, 2 * before[0], EDGES)
