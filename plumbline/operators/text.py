"""Text cleaning and page layout as column functions and small frames."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from plumbline.functions import patterns as p


def remove_cause_list(text: Column) -> Column:
    """Removes the first match of each cause-list pattern, then leading line breaks."""
    for pattern in p.CAUSE_LIST:
        text = F.regexp_replace(text, rf"(?s)\A(.*?)(?d)(?-s)(?im:{pattern})", "$1")
    return F.regexp_replace(text, r"\A\n+", "")


@arrow_udf(T.StringType())
def _composed(text: pa.Array) -> pa.Array:
    return pa.array([None if x is None else unicodedata.normalize("NFC", x) for x in text.to_pylist()], pa.string())


def normalise_unicode(text: Column) -> Column:
    """NFC, then plain forms of typographic characters.

    Python gets a null for every text within Latin-1, so only the others are moved. Where ``text`` is an expression,
    make it a column first, since it is read three times.
    """
    composed = F.coalesce(_composed(F.when(text.rlike(r"[^\x00-\xFF]"), text)), text)
    for char, plain in p.PLAIN.items():
        if len(plain) > 1:
            composed = F.replace(composed, F.lit(char), F.lit(plain))
    single = {c: x for c, x in p.PLAIN.items() if len(x) == 1}
    gone = "".join(c for c, x in p.PLAIN.items() if not x)
    return F.translate(composed, "".join(single) + gone, "".join(single.values()))


def collapse_space(text: Column) -> Column:
    """At most one empty line, one blank between words, nothing around the text."""
    text = F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), r"[ \t]{2,}", " ")
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def clean(text: Column) -> Column:
    return collapse_space(normalise_unicode(remove_cause_list(text)))


def with_clean_text(docs: DataFrame, text_col: str = "text", out: str = "clean") -> DataFrame:
    """``docs`` with a column of cleaned text; what the cause-list patterns leave is worked out once, in a column of its own."""
    step = docs.withColumn("_without_list", remove_cause_list(F.col(text_col)))
    return step.withColumn(out, collapse_space(normalise_unicode(F.col("_without_list")))).drop("_without_list")


def without_margins(words: DataFrame, share: float = 0.05) -> DataFrame:
    """Word boxes (top, bottom, page_height) without headers and footers."""
    return words.where((F.col("top") >= share * F.col("page_height")) & (F.col("bottom") <= (1 - share) * F.col("page_height")))


def page_texts(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """Per (doc, page): text in reading order. Word boxes: doc, page, top, x0, text.

    A row of words is anchored at its first word: a word further than ``tolerance`` below it opens the next row. The
    fold over a page's sorted words keeps the anchor, then rows are ordered from left to right.
    """
    box = F.struct("top", "x0", "text")
    pages = words.groupBy("doc", "page").agg(F.array_sort(F.collect_list(box)).alias("boxes"))
    kind = "struct<anchor:double,row:int,out:array<struct<row:int,x0:double,text:string>>>"
    start = F.lit(None).cast(kind)

    def step(s: Column, w: Column) -> Column:
        opens = s["anchor"].isNull() | (F.abs(w["top"] - s["anchor"]) > tolerance)
        row = F.coalesce(s["row"], F.lit(-1)) + F.when(opens, 1).otherwise(0)
        placed = F.array(F.struct(row.alias("row"), w["x0"].cast("double").alias("x0"), w["text"].alias("text")))
        out = F.concat(F.coalesce(s["out"], F.array().cast("array<struct<row:int,x0:double,text:string>>")), placed)
        return F.struct(F.when(opens, w["top"].cast("double")).otherwise(s["anchor"]).alias("anchor"), row.alias("row"), out.alias("out")).cast(kind)

    ordered = F.array_sort(F.aggregate("boxes", start, step, lambda s: s["out"]))
    return pages.select("doc", "page", F.array_join(F.transform(ordered, lambda w: w["text"]), " ").alias("text"))


def document_texts(pages: DataFrame) -> DataFrame:
    """Per doc: its pages in order, parted by an empty line."""
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
    return pages.groupBy("doc").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("text"))


def page_starts(pages: DataFrame) -> DataFrame:
    """doc, page and boundary: where each page begins in the joined text (see :func:`document_texts`)."""
    from pyspark.sql import Window

    before = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    return pages.select("doc", "page", F.coalesce(F.sum(F.length("text") + 2).over(before), F.lit(0)).alias("boundary"))


def snippet(text: Column, n: int = 200) -> Column:
    return F.substring(text, 1, n)


def case_id(stem: Column, year: Column, from_text: Column | None = None) -> Column:
    """Stem and year of a file, unless the text names its case; slashes and blanks become underscores."""
    named = F.concat_ws("_", stem, year.cast("string"))
    return named if from_text is None else F.coalesce(F.translate(from_text, "/ ", "__"), named)
