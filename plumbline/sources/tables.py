"""Sources and sinks: partitioned metadata, JSON and CSV files, indexes, fact sheets and reports."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import path_exists, python_ready, release, staged

RATING_COLUMNS = [
    "case_id", "chunk_id", "explanation_text", "source_chunk_text", "clarity_1_to_5", "legal_accuracy_1_to_5", "usefulness_1_to_5", "annotator_id", "notes",
]


def yearly_metadata(spark: SparkSession, root: str, first: int, last: int) -> DataFrame:
    """Metadata under ``root/year=YYYY``, years inclusive: only their partitions are listed and read.

    Columns of all years are merged; missing and damaged files are skipped.
    """
    reader = spark.read.option("mergeSchema", True).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    return reader.parquet(root).where(F.col("year").between(first, last)).withColumn("_year", F.col("year"))


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The first path that exists on its file system."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return path
    return None


def _column_parts(names: list[str], samples: int):
    """A task's part of a profile: for each column the numbers of rows and values, and its first values with their positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, values, first = 0, [0] * len(names), [[] for _ in names]
        for batch in batches:
            rows += batch.num_rows
            for k in range(len(names)):
                column = batch.column(k)
                values[k] += len(column) - column.null_count
                if values[k] and (len(first[k]) < samples or batch.num_rows):
                    kept = pc.indices_nonzero(column.is_valid())
                    if len(first[k]) == samples:  # only rows before the last one kept matter
                        kept = kept.filter(pc.less(batch.column(len(names)).take(kept), first[k][-1][0]))
                    if len(kept):
                        places = batch.column(len(names)).take(kept)
                        best = pc.select_k_unstable(places, min(samples, len(kept)), [("", "ascending")])
                        at = kept.take(best)
                        first[k] = sorted([*first[k], *zip(batch.column(len(names)).take(at).to_pylist(), column.take(at).to_pylist())])[:samples]
        found = [[{"place": p, "value": v} for p, v in f] for f in first]
        columns = [pa.array(range(len(names)), pa.int32()), pa.array([rows] * len(names), pa.int64()), pa.array(values, pa.int64())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.list_(pa.struct([("place", pa.int64()), ("value", pa.string())])))], ["at", "n", "n_values", "first"])

    return run


def profile(df: DataFrame, samples: int = 3, place: Column | None = None) -> DataFrame:
    """Per column: kind, numbers of nulls and of values, and its first values that are not null (40 characters each).

    One scan: a task keeps counts and the first ``samples`` values of every column, and these parts are merged by column.
    ``place`` tells the order of rows (a long; by default as they are read, so for a file its rows in order).
    """
    python_ready(df.sparkSession, 4096)
    names, width = df.columns, max(len(df.columns), 1)
    at = F.monotonically_increasing_id() if place is None else place.cast("long")
    cells = df.select(*[F.col(f"`{n}`").cast("string").alias(f"c{i}") for i, n in enumerate(names)], at.alias("place"))
    first = "array<struct<place:bigint,value:string>>"
    parts = cells.mapInArrow(_column_parts(names, samples), f"at int, n long, n_values long, first {first}")
    merged = parts.groupBy("at").agg(F.sum("n").alias("n"), F.sum("n_values").alias("n_values"), F.array_sort(F.flatten(F.collect_list("first"))).alias("first"))  # a row of a task for each column
    kinds = df.sparkSession.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)], "at int, column string, kind string").coalesce(1)
    kept = F.transform(F.slice(F.coalesce("first", F.array().cast(first)), 1, samples), lambda x: F.substring(x["value"], 1, 40))
    none = F.lit(0).cast("long")
    n_values = F.coalesce("n_values", none)
    return (
        kinds.join(merged, "at", "left").orderBy("at").coalesce(min(width, 1))
        .select("column", "kind", (F.coalesce("n", none) - n_values).alias("n_null"), n_values.alias("n_values"), kept.alias("samples"))
    )


def profile_json(profiled: DataFrame) -> DataFrame:
    """A profile as JSON, one object a column."""
    return profiled.select("column", F.to_json(F.struct("kind", "n_null", "n_values", "samples")).alias("json"))


def pdf_pages(spark: SparkSession, folder: str, reader=None) -> DataFrame:
    """pdf_path, page_number and text of every page of the PDF files in a folder.

    ``reader`` maps the bytes of a file to its page texts; the default uses the library pdfplumber where it is
    installed. A file that cannot be read gives one row with its error and no text; empty pages are left out.
    """
    python_ready(spark, 16)

    def default(data: bytes) -> list[str]:
        import io

        import pdfplumber

        with pdfplumber.open(io.BytesIO(data)) as pdf:
            return [page.extract_text() or "" for page in pdf.pages]

    read = reader or default

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows = [(path, i, t, None) for i, t in enumerate(read(data), 1) if t.strip()]
                except Exception as error:  # noqa: BLE001 - one damaged file must not end the job
                    rows = [(path, None, None, str(error)[:200])]
                columns = list(zip(*rows)) or [[], [], [], []]
                kinds = (pa.string(), pa.int32(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["pdf_path", "page_number", "text", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", True).load(folder)
    return files.select("path", "content").mapInArrow(run, "pdf_path string, page_number int, text string, error string")


def json_rows(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A JSON file that holds a list of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_map(spark: SparkSession, path: str, key: str = "key", value: str = "value") -> DataFrame:
    """A JSON file that holds one object of strings, as rows of key and value."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias(key, value))


def rating_template(explanations: DataFrame) -> DataFrame:
    """The nine columns of a rating sheet with blank ratings."""
    own = set(explanations.columns)
    return explanations.select(*[F.col(c).cast("string").alias(c) if c in own else F.lit("").alias(c) for c in RATING_COLUMNS])


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """Filled rating sheets; every column is text, numbers are parsed where they are used."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in RATING_COLUMNS])
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def storage_key(case_id):
    """A case id as a key: slashes, backslashes and blanks become underscores."""
    return F.translate(case_id, "/\\ ", "___")


# Indexes are Parquet tables of (chunk_id, embedding, metadata). A flat index needs no further structure.


def sanitised(metadata: DataFrame, columns: list[str]) -> DataFrame:
    """Metadata in flat types: lists joined by a comma and blank, null as the empty text."""
    kinds = dict(metadata.dtypes)
    flat = lambda c: F.coalesce(F.array_join(c, ", "), F.lit("")) if kinds[c].startswith("array") else (F.coalesce(c, F.lit("")) if kinds[c] == "string" else F.col(c))
    return metadata.select(*[flat(c).alias(c) if c in columns else F.col(c) for c in metadata.columns])


def new_rows(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose key is not stored yet, one per key."""
    return new.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def upserted(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``existing`` with the rows of ``new`` in place of those with the same key."""
    return existing.join(new.select(key), key, "left_anti").unionByName(new)


#: The column by which a table that takes upserts on disk is partitioned.
BUCKET = "upsert_bucket"


def latest(rows: DataFrame, key: str, version: str | None = None) -> DataFrame:
    """One row per key: the one with the greatest version (null is the least), ties and no version by all columns."""
    named = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    order = F.struct(F.lit(0) if version is None else F.col(f"`{version}`"), F.to_json(named))
    best = rows.groupBy(F.col(f"`{key}`").alias("_key")).agg(F.max_by(named, order).alias("_row"))
    return best.select("_row.*")


def upsert(spark: SparkSession, path: str, batch: DataFrame, key: str, version: str | None = None, buckets: int = 64) -> None:
    """Puts the rows of a batch in place of those with the same key; only the buckets of its keys are read and written anew.

    Rows lie in ``buckets`` partitions by the hash of their key (the same number at every call). The new contents of the
    touched ones are staged, so that nothing is overwritten while it is read, and then replaced by dynamic partition
    overwrite. A batch that is given again changes nothing, which mends one that was broken off.
    """
    bucket = F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(buckets)).cast("int")
    new = staged(latest(batch, key, version).withColumn(BUCKET, bucket))
    writer = lambda df: df.write.partitionBy(BUCKET).option("partitionOverwriteMode", "dynamic").mode("overwrite")
    if not path_exists(spark, path):
        writer(new.repartition(BUCKET)).parquet(path)
        release(new)
        return
    touched = [r[0] for r in new.select(BUCKET).distinct().collect()]  # one for each bucket at most
    old = spark.read.option("mergeSchema", True).parquet(path).where(F.col(BUCKET).isin(touched)).alias("o")
    kept = old.join(new.select(F.col(f"`{key}`").alias("_key")), F.col(f"o.`{key}`").eqNullSafe(F.col("_key")), "left_anti")
    rows = staged(kept.unionByName(new, allowMissingColumns=True))
    writer(rows.repartition(BUCKET)).parquet(path)
    release(new, rows)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table that takes upserts."""
    return spark.read.option("mergeSchema", True).parquet(path).drop(BUCKET)


def write_index(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def add_to_index(spark: SparkSession, path: str, new: DataFrame, key: str = "chunk_id") -> None:
    """Appends the rows that are not stored yet; a missing index begins with them."""
    if first_existing(spark, [path]) is None:
        write_index(new.dropDuplicates([key]), path)
    else:
        write_index(new_rows(spark.read.parquet(path), new, key), path, "append")


def latex_table(rows: DataFrame, columns: list[str], caption: str, order: str) -> DataFrame:
    """A report as one LaTeX table (column latex), its rows in the order of a column; doubles have four decimals, null is a dash."""
    kinds = dict(rows.dtypes)
    plain = lambda c: F.format_string("%.4f", F.col(c).cast("double")) if kinds[c] in ("double", "float") else F.replace(F.col(c).cast("string"), F.lit("_"), F.lit(r"\_"))
    shown = [F.coalesce(F.when(F.col(c).isNotNull(), plain(c)), F.lit("--")) for c in columns]
    line = F.concat(F.concat_ws(" & ", *shown), F.lit(r" \\"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))), lambda x: x["line"]), "\n")
    head = " & ".join(c.replace("_", r"\_") for c in columns) + r" \\"
    before = [r"\begin{table}[h]", rf"\caption{{{caption}}}", rf"\begin{{tabular}}{{l{'r' * (len(columns) - 1)}}}", r"\hline", head, r"\hline"]
    after = [r"\hline", r"\end{tabular}", r"\end{table}"]
    return rows.agg(F.concat_ws("\n", *[F.lit(x) for x in before], body, *[F.lit(x) for x in after]).alias("latex"))
