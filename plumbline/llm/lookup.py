"""Rows by id without moving the others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ids that may be broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def rows_with_ids(rows: DataFrame, ids: DataFrame, id_col: str, key_col: str, bound: int = BROADCAST_IDS, without: bool = False) -> DataFrame:
    """Rows whose ``id_col`` is (or with ``without`` is not) among ``ids.key_col``, null matching null.

    ``ids`` are distinct and already computed. Up to ``bound`` of them are broadcast, so that rows are filtered where
    they are read; beyond it both sides are shuffled.
    """
    if ids.count() <= bound:
        ids = F.broadcast(ids)
    return rows.alias("_l").join(ids.alias("_i"), F.col(f"_l.`{id_col}`").eqNullSafe(F.col(f"_i.`{key_col}`")), "left_anti" if without else "left_semi")
