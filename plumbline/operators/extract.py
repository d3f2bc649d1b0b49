"""Metadata, sections, entities and citations from text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import patterns as p
from plumbline.session import python_ready


def _any_case(pattern: str) -> Column:
    return F.lit(f"(?i){pattern}")


def all_groups(text: Column, pattern: str, group: int) -> Column:
    """A group of every match in order; empty where the group took no part."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), _any_case(pattern), F.lit(group))


def first_group(text: Column, pattern: str, group: int) -> Column:
    """A group of the first match, or null."""
    return F.nullif(F.regexp_extract(text, f"(?i){pattern}", group), F.lit(""))


def stated_case(text: Column) -> Column:
    """Case number in the first 3000 characters, as "kind number/year"."""
    head = F.substring(text, 1, 3000)
    kind, number, year = (first_group(head, p.CASE_NUMBER, g) for g in (1, 2, 3))
    return F.when(number.isNotNull(), F.trim(F.concat(F.trim(kind), F.lit(" "), number, F.lit("/"), year)))


def stated_year(text: Column) -> Column:
    """Year of the date of decision, else the first plausible year, in the first 5000 characters."""
    head = F.substring(text, 1, 5000)
    years = F.transform(all_groups(head, p.ANY_YEAR, 1), lambda y: y.cast("int"))
    plausible = F.filter(years, lambda y: y.between(p.FIRST_YEAR, p.LAST_YEAR))
    return F.coalesce(first_group(head, p.DATED, 1).cast("int"), F.get(plausible, F.lit(0)))


def provisions(text: Column) -> Column:
    """Cited sections and articles, sorted and distinct."""
    n, act, article = (all_groups(text, p.PROVISION, g) for g in (1, 2, 3))
    rows = F.arrays_zip(n.alias("n"), act.alias("act"), article.alias("article"))
    name = lambda r: F.when(r["article"] != "", F.concat(F.lit("Article "), r["article"])).otherwise(
        F.trim(F.concat(F.lit("Section "), r["n"], F.lit(" "), F.regexp_replace(r["act"], r"^\s+|\s+$", "")))
    )
    return F.array_sort(F.array_distinct(F.transform(rows, name)))


def judges(text: Column) -> Column:
    """Names of judges in the first 3000 characters, in order, distinct, longer than two letters."""
    names = F.transform(all_groups(F.substring(text, 1, 3000), p.JUDGE, 1), lambda n: F.regexp_replace(F.regexp_replace(n, r"^[\t\n\f\r ]+|[\t\n\f\r ]+\z", ""), r"\.+\z", ""))
    return F.array_distinct(F.filter(names, lambda n: F.length(n) > 2))


def bench(n_judges: Column) -> Column:
    return F.when(n_judges <= 0, "Unknown").when(n_judges == 1, "Single").when(n_judges == 2, "Division").when(n_judges == 3, "Three-Judge").otherwise("Constitution")


def outcome(text: Column) -> Column:
    """Outcome by the first phrase, in order of precedence, that the last fifth of the text holds."""
    tail = F.lower(F.substring(text, (F.length(text) * 0.8).cast("int") + 1, F.length(text)))
    found = None
    for phrase, label in p.OUTCOMES:
        found = (F if found is None else found).when(tail.contains(phrase), label)
    return found.otherwise("Unknown")


def metadata(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """id, case_id, year, act_sections, judge_names, bench_type, outcome_label."""
    t = F.col(text_col)
    rows = docs.select(
        F.col(id_col), stated_case(t).alias("case_id"), stated_year(t).alias("year"), provisions(t).alias("act_sections"), judges(t).alias("judge_names"), outcome(t).alias("outcome_label")
    )
    return rows.withColumn("bench_type", bench(F.size("judge_names")))


# Offsets need a scan that Spark's functions do not offer: small helpers find matches, Spark orders and combines them.


def _finder(families: tuple[tuple[str, tuple[str, ...]], ...]):
    """Rows (id, text) to rows (id, family, family_pos, pattern_pos, start, end, match)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(name, i, j, re.compile(x, re.IGNORECASE | re.ASCII)) for i, (name, xs) in enumerate(families) for j, x in enumerate(xs)]
        for batch in batches:
            rows: list[tuple] = []
            index: list[int] = []
            for k, text in enumerate(batch.column(1).to_pylist()):
                for name, i, j, regex in compiled:
                    for m in regex.finditer(text or ""):
                        rows.append((name, i, j, m.start(), m.end(), m.group()))
                        index.append(k)
            names = ["family", "family_pos", "pattern_pos", "start", "end", "match"]
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            columns = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(index, pa.int64())), *columns], ["id", *names])

    return run


def matches(docs: DataFrame, families: tuple, id_col: str, text_col: str = "text") -> DataFrame:
    python_ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_finder(families), f"id {kind}, family string, family_pos int, pattern_pos int, start int, end int, match string")


#: The type of a text's entities.
ENTITY = "struct<start:int,end:int,entity_type:string,match:string,position:int>"


def spans_in(text: str, compiled: list[tuple[str, re.Pattern]]) -> list[dict]:
    """Spans of all patterns in order: one that several patterns find goes to the first; position counts from 1."""
    found: dict[tuple[int, int], tuple[int, str, str]] = {}
    for order, (family, pattern) in enumerate(compiled):
        for m in pattern.finditer(text):
            found.setdefault(m.span(), (order, family, m.group()))
    rows = sorted((start, order, end, family, match) for (start, end), (order, family, match) in found.items())
    return [{"start": a, "end": b, "entity_type": family, "match": match, "position": k} for k, (a, _, b, family, match) in enumerate(rows, 1)]


def entity_spans(text: Column, families: tuple = p.ENTITIES) -> Column:
    """An array of a text's entities (start, end, entity_type, match, position); null has none.

    One pass in an Arrow batch gives them deduplicated and in order, so nothing is shuffled.
    """

    @F.arrow_udf(f"array<{ENTITY}>")
    def found(texts: pa.Array) -> pa.Array:
        compiled = [(family, re.compile(x, re.IGNORECASE | re.ASCII)) for family, xs in families for x in xs]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("entity_type", pa.string()), ("match", pa.string()), ("position", pa.int32())]))
        return pa.array([spans_in(t, compiled) if t else [] for t in texts.to_pylist()], kind)

    return found(text)


def entities(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """id, start, end, entity_type, match: spans found by several patterns go to the first; position counts from 1."""
    python_ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.explode(entity_spans(F.col(text_col).cast("string"))).alias("_e"))
    return rows.select("id", "_e.*")


def entity_summary(found: DataFrame, examples: int = 3) -> DataFrame:
    """Per id and entity type: count and the first examples."""
    first = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("position", "match"))), lambda x: x["match"]), 1, examples)
    return found.groupBy("id", "entity_type").agg(F.count(F.lit(1)).alias("n"), first.alias("examples"))


def headings(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """Per id: headings, an array of (start, end, section_type) in order; one that begins inside the last kept goes."""
    families = tuple((name, (p.heading(words),)) for name, words in p.HEADINGS)
    found = matches(docs, families, id_col, text_col)
    span = F.struct("start", "family_pos", "end", F.col("family").alias("section_type"))
    kind = "struct<last:int,out:array<struct<start:int,end:int,section_type:string>>>"
    start = F.struct(F.lit(-1).alias("last"), F.array().cast("array<struct<start:int,end:int,section_type:string>>").alias("out")).cast(kind)

    def keep(s: Column, h: Column) -> Column:
        fits = h["start"] >= s["last"]
        one = F.array(F.struct(h["start"].alias("start"), h["end"].alias("end"), h["section_type"].alias("section_type")))
        return F.when(fits, F.struct(h["end"].alias("last"), F.concat(s["out"], one).alias("out")).cast(kind)).otherwise(s)

    return found.groupBy("id").agg(F.array_sort(F.collect_list(span)).alias("h")).select("id", F.aggregate("h", start, keep, lambda s: s["out"]).alias("headings"))


def sections(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """Rows (id, pos, section_type, start_char, end_char, text), empty ones left out.

    Text starts after a heading, start_char is the heading's own. Without a heading the first fifth is Facts.
    """
    kind = "array<struct<section_type:string,start:int,from:int,end:int>>"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.trim("text") != "")
    h = headings(docs, id_col, text_col)
    joined = rows.join(h, "id", "left").withColumn("n", F.length("text"))
    part = lambda t, a, b, c: F.struct(t.alias("section_type"), a.alias("start"), b.alias("from"), c.alias("end"))
    fifth = (F.col("n") * 0.2).cast("int")
    fallback = F.array(part(F.lit("Facts"), F.lit(0), F.lit(0), fifth), part(F.lit("Unknown"), fifth, fifth, F.col("n")))
    lead = F.array(part(F.lit("Unknown"), F.lit(0), F.lit(0), F.get("headings", F.lit(0))["start"]))
    own = F.transform("headings", lambda x, i: part(x["section_type"], x["start"], x["end"], F.coalesce(F.get("headings", i + 1)["start"], F.col("n"))))
    parts = F.when(F.coalesce(F.size("headings"), F.lit(0)) <= 0, fallback.cast(kind)).otherwise(F.concat(lead.cast(kind), own.cast(kind)))
    spread = joined.select("id", "text", F.col("headings").isNull().alias("whole"), F.posexplode(parts).alias("pos", "s"))
    body = F.substring("text", F.col("s.from") + 1, F.col("s.end") - F.col("s.from"))
    trimmed = F.when(F.col("whole"), body).otherwise(F.regexp_replace(body, r"\A\s+|\s+\z", ""))
    out = spread.select("id", "pos", F.col("s.section_type").alias("section_type"), F.col("s.start").alias("start_char"), F.col("s.end").alias("end_char"), trimmed.alias("text"), "whole")
    return out.where(F.col("whole") | (F.col("text") != "")).drop("whole")


def facts_text(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """Per id: the first Facts section; else the text from a facts heading to the next other one; else the first fifth."""
    own = sections(docs, id_col, text_col).where("section_type = 'Facts'").groupBy("id").agg(F.min_by("text", "pos").alias("found"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.trim("text") != "")
    facts = dict(p.HEADINGS)["Facts"]
    between = F.regexp_extract("text", rf"(?is){p.heading(facts)}(.*?)(?:{p.heading(p.AFTER_FACTS)}|\z)", 1)
    strip = lambda c: F.nullif(F.regexp_replace(c, r"\A\s+|\s+\z", ""), F.lit(""))
    fifth = F.substring("text", F.lit(1), F.greatest(F.lit(1), (F.length("text") * 0.2).cast("int")))
    return rows.join(own, "id", "left").select("id", F.coalesce("found", strip(between), strip(fifth), F.lit("")).alias("facts"))


def citations(text: Column) -> Column:
    """Reporter citations, then case numbers, trimmed, distinct, in order of first sight."""
    both = F.concat(all_groups(text, p.REPORTER, 0), all_groups(text, p.CASE_CITATION, 0))
    return F.array_distinct(F.transform(both, lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")))


def cited_cases(cited: DataFrame, index: DataFrame) -> DataFrame:
    """Rows with a column citation, and cited_case_id: by the index (citation, case_id), else built from the case number."""
    i = index.select("citation", F.col("case_id").alias("_indexed"))
    number, year = (first_group(F.col("citation"), p.CASE_CITATION, g) for g in (1, 2))
    built = F.when(number.isNotNull(), F.concat(F.get(F.split("citation", r"\s+"), F.lit(0)), F.lit(" Appeal "), number, F.lit("/"), year))
    return cited.join(i, "citation", "left").withColumn("cited_case_id", F.coalesce("_indexed", built)).drop("_indexed")


def terms(text: Column) -> Column:
    """Tokens of the term scorer: lower case, at least three characters, no stop words, in order."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([a-z][a-z0-9\-]+)"), F.lit(1))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(p.STOP_WORDS))
