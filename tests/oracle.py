"""Runs a query and its SQL on the smallest tables and compares their rows."""

from collections import Counter
from pathlib import Path

SMALL = Path("/root/testdata/sf0.001")


def plain(value):
    """Floats to nine digits; arrays and rows as tuples."""
    if isinstance(value, float):
        return float(f"{value:.9g}")
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


def rows_of(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(plain(r[n]) for n in names) for r in df.collect())


def rows_of_sql(sql: str, folder: Path = SMALL) -> tuple[list[str], Counter]:
    import duckdb

    with duckdb.connect() as db:
        for path in folder.glob("*.parquet"):
            db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
        found = db.execute(sql)
        columns = [d[0] for d in found.description]
        places = [columns.index(n) for n in sorted(columns)]
        return sorted(columns), Counter(tuple(plain(r[i]) for i in places) for r in found.fetchall())
