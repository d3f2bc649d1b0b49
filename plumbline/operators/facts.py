"""Fact sheets: rule-based extraction, validation, and the query sentence made of one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import patterns as p
from plumbline.operators.extract import all_groups, first_group
from plumbline.operators.models import AnswerStore, Backend, with_answers

AMOUNTS = "array<struct<value:double,unit:string,context:string>>"
AGES = "array<struct<value:bigint,descriptor:string>>"
EVIDENCE = "array<struct<evidence_type:string,description:string>>"
#: The type of a fact sheet.
SHEET = (
    "struct<case_id:string,parties:struct<petitioner_type:string,respondent_type:string>,"
    f"evidence_items:{EVIDENCE},sections_cited:array<string>,numerical_facts:struct<amounts:{AMOUNTS},ages:{AGES},durations:{AMOUNTS}>,outcome:string>"
)


def valid_party(party: Column) -> Column:
    """A party type outside the vocabulary becomes Unknown; null stays."""
    return F.when(party.isNull() | party.isin(*p.PARTY_TYPES), party).otherwise("Unknown")


def valid_sections(cited: Column) -> Column:
    """Sections in the closed form stay; others are mended (trimmed, blanks to dashes) if that gives it, else kept."""
    mended = lambda s: F.replace(F.trim(s), F.lit(" "), F.lit("-"))
    good = lambda s: s.rlike(p.SECTION_FORM)
    return F.transform(F.coalesce(cited, F.array().cast("array<string>")), lambda s: F.when(good(s), s).when(good(mended(s)), mended(s)).otherwise(s))


def extract_by_rules(text: Column) -> Column:
    """A fact sheet from the facts' text by fixed patterns."""
    found = lambda pattern: F.coalesce(text, F.lit("")).rlike(f"(?i){pattern}")
    cited = F.transform(F.slice(all_groups(text, p.FACT_SECTION, 1), 1, 10), lambda n: F.concat(F.lit("IPC-"), n))
    articles = F.transform(F.slice(all_groups(text, p.FACT_ARTICLE, 1), 1, 5), lambda n: F.concat(F.lit("Constitution-Article-"), n))
    evidence = [F.when(found(x), F.struct(F.lit(kind).alias("evidence_type"), F.lit(what).alias("description"))) for kind, what, x in p.FACT_EVIDENCE]
    outcome = None
    for label, x in p.FACT_OUTCOMES:
        outcome = (F if outcome is None else outcome).when(found(x), label)
    ages = F.transform(all_groups(text, p.FACT_AGE, 1), lambda a: F.struct(a.cast("bigint").alias("value"), F.lit("person").alias("descriptor")))
    raw = F.arrays_zip(all_groups(text, p.FACT_AMOUNT, 1).alias("n"), all_groups(text, p.FACT_AMOUNT, 2).alias("u"))
    raw = F.filter(F.transform(raw, lambda r: F.struct(F.replace(r["n"], F.lit(","), F.lit("")).alias("n"), r["u"].alias("u"))), lambda r: r["n"] != "")
    amounts = F.transform(
        raw, lambda r: F.struct(r["n"].cast("double").alias("value"), F.coalesce(F.nullif(r["u"], F.lit("")), F.lit("rupees")).alias("unit"), F.lit("monetary amount").alias("context"))
    )
    return F.struct(
        F.coalesce(F.nullif(F.regexp_extract(text, f"(?i){p.FACT_CASE}", 0), F.lit("")), F.lit("unknown")).alias("case_id"),
        F.struct(F.lit("Unknown").alias("petitioner_type"), F.lit("Unknown").alias("respondent_type")).alias("parties"),
        F.array_compact(F.array(*evidence)).alias("evidence_items"),
        F.array_distinct(F.concat(cited, articles)).alias("sections_cited"),
        F.struct(amounts.alias("amounts"), ages.alias("ages"), F.array().cast(AMOUNTS).alias("durations")).alias("numerical_facts"),
        outcome.alias("outcome"),
    ).cast(SHEET)


def first_block(text: Column) -> Column:
    """From the first opening brace to the one that closes it, braces counted wherever they stand; null if none does."""
    tail = F.regexp_extract(text, r"(?s)(\{.*)", 1)
    pieces = F.regexp_extract_all(tail, F.lit(r"([{}][^{}]*)"), F.lit(1))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("closed"), F.lit("").alias("block"))

    def step(s: Column, piece: Column) -> Column:
        depth = s["depth"] + F.when(piece.startswith("{"), 1).otherwise(-1)
        more = F.struct(depth.alias("depth"), (depth == 0).alias("closed"), F.concat(s["block"], F.when(depth == 0, F.lit("}")).otherwise(piece)).alias("block"))
        return F.when(s["closed"], s).otherwise(more)

    return F.aggregate(pieces, start, step, lambda s: F.when(s["closed"], s["block"]))


def from_answer(raw: Column, case_id: Column) -> Column:
    """A valid fact sheet from a model's answer: without code fences, all of it or its first balanced block; null if that is no JSON.

    An answer without a case id gets ``case_id``; parties and sections go through their validators.
    """
    bare = F.regexp_replace(raw, r"```(?:json)?\s*", "")
    json = F.when(F.try_parse_json(bare).isNotNull(), bare).otherwise(first_block(bare))
    sheet = F.from_json(json, SHEET)
    own = F.coalesce(F.nullif(sheet["case_id"], F.lit("")), case_id.cast("string"), F.lit("unknown"))
    parties = F.when(
        sheet["parties"].isNotNull(),
        F.struct(valid_party(sheet["parties"]["petitioner_type"]).alias("petitioner_type"), valid_party(sheet["parties"]["respondent_type"]).alias("respondent_type")),
    )
    valid = sheet.withField("case_id", own).withField("parties", parties).withField("sections_cited", valid_sections(sheet["sections_cited"]))
    return F.when(sheet["case_id"].isNotNull() | F.try_parse_json(json).isNotNull(), valid)


def extract_sheets(
    facts: DataFrame, answer: Callable[[Column], Column] | None = None, second: Callable[[Column], Column] | None = None, id_col: str = "case_id"
) -> DataFrame:
    """Rows (``id_col``, facts) with ``sheet``: by ``answer`` (text to JSON, say a pandas UDF around a model), else by rules.

    ``second`` is asked where the first answer gave no sheet, say with an example in its prompt; elsewhere its text is
    null, which a model should pass over.
    """
    if answer is None:
        return facts.withColumn("sheet", extract_by_rules(F.col("facts")))
    text = F.substring("facts", 1, 12000)
    first = facts.withColumn("sheet", from_answer(answer(text), F.col(id_col)))
    if second is None:
        return first
    again = second(F.when(F.col("sheet").isNull(), text))
    return first.withColumn("sheet", F.when(F.col("sheet").isNull(), from_answer(again, F.col(id_col))).otherwise(F.col("sheet")))


def sheets_by_model(
    facts: DataFrame,
    backend: Backend,
    first: Callable[[Column], Column] | None = None,
    second: Callable[[Column], Column] | None = None,
    store: AnswerStore | None = None,
    id_col: str = "case_id",
) -> DataFrame:
    """Like :func:`extract_sheets`, with a model that is asked in batches: ``sheet`` and ``error`` (of the last attempt).

    ``first`` makes the prompt of the facts (default: the facts themselves), ``second`` the one for rows whose first
    answer gave no sheet. Answers come from the store where it has them.
    """
    text = F.substring("facts", 1, 12000)
    asked = with_answers(facts, text if first is None else first(text), backend, store)
    asked = asked.withColumn("sheet", from_answer(F.col("answer"), F.col(id_col))).drop("answer")
    if second is None:
        return asked
    again = with_answers(asked.withColumnRenamed("error", "_first_error"), F.when(F.col("sheet").isNull(), second(text)), backend, store)
    sheet = F.coalesce("sheet", from_answer(F.col("answer"), F.col(id_col)))
    return again.withColumn("sheet", sheet).withColumn("error", F.when(F.col("sheet").isNull(), F.coalesce("error", "_first_error"))).drop("answer", "_first_error")


def not_yet_stored(cases: DataFrame, stored: DataFrame, max_cases: int | None = None) -> DataFrame:
    """Cases without a stored sheet, in the order of their ids, at most ``max_cases``."""
    new = cases.join(stored.select("case_id"), "case_id", "left_anti")
    return new if max_cases is None else new.orderBy("case_id").limit(max_cases)


def extraction_stats(sheets: DataFrame) -> DataFrame:
    found = F.col("sheet").isNotNull()
    return sheets.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(found).alias("n_success"), F.count_if(~found).alias("n_failed"), F.round(F.avg(found.cast("double")), 4).alias("success_rate")
    )


def number_text(x: Column) -> Column:
    """A double as text: whole numbers with ".0", others in plain decimals."""
    return F.when(x == F.floor(x), F.format_string("%d.0", x.cast("bigint"))).otherwise(x.cast("string"))


def query_sentence(sheet: Column) -> Column:
    """A fact sheet as the sentences that are searched for; missing parts vanish."""
    pet, resp = F.coalesce(sheet["parties"]["petitioner_type"], F.lit("petitioner")), F.coalesce(sheet["parties"]["respondent_type"], F.lit("respondent"))
    cited = F.slice(F.coalesce(sheet["sections_cited"], F.array().cast("array<string>")), 1, 8)
    kinds = F.array_sort(F.array_distinct(F.transform(F.slice(F.coalesce(sheet["evidence_items"], F.array().cast(EVIDENCE)), 1, 6), lambda e: e["evidence_type"])))
    n = sheet["numerical_facts"]
    said = lambda items, kind, default: F.transform(
        F.slice(F.coalesce(items, F.array().cast(kind)), 1, 2),
        lambda a: F.concat(number_text(F.coalesce(a["value"], F.lit(0.0))), F.lit(" "), F.coalesce(a["unit"], F.lit(default)), F.lit(" ("), F.coalesce(a["context"], F.lit("")), F.lit(")")),
    )
    ages = F.transform(
        F.slice(F.coalesce(n["ages"], F.array().cast(AGES)), 1, 2),
        lambda a: F.concat(F.lit("age "), F.coalesce(a["value"], F.lit(0)).cast("string"), F.lit(" ("), F.coalesce(a["descriptor"], F.lit("")), F.lit(")")),
    )
    numbers = F.concat(said(n["amounts"], AMOUNTS, "rupees"), ages, said(n["durations"], AMOUNTS, "years"))
    some = lambda items, before: F.when(F.size(items) > 0, F.concat(F.lit(before), F.array_join(items, ", "), F.lit(".")))
    return F.concat_ws(
        " ",
        F.concat(F.lit("This case involves a "), pet, F.lit(" against the "), resp, F.lit(".")),
        some(cited, "The relevant legal provisions are "),
        some(kinds, "Evidence includes "),
        some(numbers, "Key facts include "),
        F.when(F.coalesce(sheet["outcome"], F.lit("")) != "", F.concat(F.lit("The outcome was: "), sheet["outcome"], F.lit("."))),
    )
