"""Queries on texts: cleaning, extraction, chunking, term scores, grounding, ratings and ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import chunking, evaluate, explain, extract, latent, text
from plumbline.session import spread, table

#: A cause list and legal phrases set around every text, since the invented prose of the tables has none.
FRAME = (
    "IN THE SUPREME COURT OF INDIA\n\n\n\nCriminal Appeal No. 12-13 / 2019\nFACTS\nThe accused, aged about 25 years, paid Rs. 1,50,000 under Section 302 of IPC. ",
    " He was held for 3 years, see (2007) 3 SCC 755.\nISSUES\nWhether Article 21 applies.\nHELD\nThe appeal is dismissed.\n",
)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and the text in its frame."""
    return documents(spark, sf_dir).select("doc_id", F.concat(F.lit(FRAME[0]), F.coalesce("text", F.lit("")), F.lit(FRAME[1])).alias("text"))


def txt1_noise(spark, sf_dir):
    return framed(spark, sf_dir).select("doc_id", F.md5(text.remove_cause_list(F.col("text"))).alias("digest"), F.length(text.remove_cause_list(F.col("text"))).cast("long").alias("n_chars"))


def txt2_unicode(spark, sf_dir):
    """The typographic characters, an accent that composes, and the text."""
    d = documents(spark, sf_dir).select("doc_id", F.concat(F.lit("\u201cA\u2014B\u2013C\u201d\u00a0e\u0301\u200b "), F.col("text")).alias("text"))
    return d.select("doc_id", F.md5(text.normalise_unicode(F.col("text"))).alias("digest"))


def txt3_collapse(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.collapse_space(F.regexp_replace("html", "<[^>]*>", "  \n"))).alias("digest"))


def txt4_clean(spark, sf_dir):
    return text.with_clean_text(framed(spark, sf_dir)).select("doc_id", F.md5("clean").alias("digest"))


def txt8_snippets(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", *[text.snippet(F.col("text"), n).alias(f"first_{n}") for n in (120, 800)])


def ext1_metadata(spark, sf_dir):
    got = extract.metadata(framed(spark, sf_dir), "doc_id")
    return got.select("doc_id", "case_id", "year", F.array_join("act_sections", "; ").alias("act_sections"), F.size("judge_names").cast("long").alias("n_judges"), "bench_type", "outcome_label")


def ext1_case_numbers(spark, sf_dir):
    return framed(spark, sf_dir).select("doc_id", extract.stated_case(F.col("text")).alias("case_id"))


def ext2_years(spark, sf_dir):
    """Years stated by a date of decision, or the first plausible one."""
    dated = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" decided on 3/4/1987"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Dated: 12.11.2003 "), "text")).otherwise(F.col("text"))
    return framed(spark, sf_dir).select("doc_id", extract.stated_year(dated).alias("year"))


def ext5_bench(spark, sf_dir):
    names = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n"))
    return names.select("n_regionkey", *[extract.bench(F.col("n") - i).alias(f"less_{i}") for i in range(6)])


def ext6_tail_outcome(spark, sf_dir):
    ends = F.array(*[F.lit(x) for x in ("The petitions are disposed of.", "the appeal is allowed", "PARTLY ALLOWED; disposed of", "nothing", "Writ Petition is dismissed, appeal allowed")])
    said = F.concat("text", F.lit(" "), F.element_at(ends, (F.col("doc_id") % 5 + 1).cast("int")))
    return documents(spark, sf_dir).select("doc_id", extract.outcome(said).alias("outcome"))


def ext3_article_citations(spark, sf_dir):
    """Cited articles, sorted and distinct, in the framed text and a list of more."""
    more = F.concat("text", F.lit(" Article 14, ARTICLE 19A and article 21; Article "), (F.col("doc_id") % 9).cast("string"))
    got = F.filter(extract.provisions(more), lambda x: x.startswith("Article"))
    return framed(spark, sf_dir).select("doc_id", F.array_join(got, "; ").alias("articles"))


def ext3_section_citations(spark, sf_dir):
    """Cited sections with and without their acts, sorted and distinct."""
    more = F.concat(F.lit("Sections 34 and 149; Section 302 of IPC, section 302 of the IPC; Sec. 13B of the Hindu Marriage Act, S. 138 NI Act. "), F.coalesce("text", F.lit("")), F.lit(" Section "), (F.col("doc_id") % 9).cast("string"), F.lit(" of CrPC."))
    got = F.filter(extract.provisions(more), lambda x: x.startswith("Section"))
    return documents(spark, sf_dir).select("doc_id", F.array_join(got, "; ").alias("sections"))


def ext4_judges(spark, sf_dir):
    """Judges named before the text: by the document's number, some twice, one too short."""
    names = F.concat(F.lit("Hon'ble Justice A. K. Sikri, Justice Indu Malhotra and Justice X, J. Nariman "), F.col("doc_id").cast("string"), F.lit(" Justice Indu Malhotra, "), F.coalesce("text", F.lit("")))
    return documents(spark, sf_dir).select("doc_id", F.array_join(extract.judges(names), "|").alias("judges"))


#: Layouts of headings around a text, by the document's number; some words stand in lines that are no headings.
LAYOUTS = (
    "FACTS\n{}\nII. Issues for consideration:\n{}\nHELD\n",
    "brief facts -\n{}\nThe facts are these\n{}\nSUBMISSIONS\n{}\nANALYSIS\n{}\nORDER\n",
    "X. Statement of the case\n{}\nArguments.\n{}\nRatio decidendi\n{}\nConclusion",
    "no heading\n{}\nHeld guilty\n{}\n",
)
_TYPES = ("Facts,Issues,Held", "Facts,Submissions,Analysis,Held", "Facts,Submissions,Ratio,Held", "")


def layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.array(*[F.lit(x) for x in LAYOUTS])
    own = F.element_at(made, (F.col("doc_id") % len(LAYOUTS) + 1).cast("int"))
    return documents(spark, sf_dir).select("doc_id", F.replace(own, F.lit("{}"), F.concat(F.lit("text: "), F.translate(F.coalesce("text", F.lit("")), "\n", " "))).alias("text"))


def ext7_headings(spark, sf_dir):
    """Headings in several layouts around every text."""
    got = extract.headings(layouts(spark, sf_dir), "doc_id")
    return got.select(F.col("id").alias("doc_id"), F.array_join(F.transform("headings", lambda h: h["section_type"]), ",").alias("types"), F.size("headings").cast("long").alias("n"))


def ext8_sections(spark, sf_dir):
    got = extract.sections(framed(spark, sf_dir), "doc_id")
    return got.select(F.col("id").alias("doc_id"), "pos", "section_type", "start_char", "end_char", F.md5("text").alias("digest"))


def ext9_facts(spark, sf_dir):
    return extract.facts_text(framed(spark, sf_dir), "doc_id").select(F.col("id").alias("doc_id"), F.md5("facts").alias("digest"))


def ext10_entities(spark, sf_dir):
    return extract.entities(framed(spark, sf_dir), "doc_id").withColumnRenamed("id", "doc_id")


def ext11_entity_summary(spark, sf_dir):
    got = extract.entity_summary(extract.entities(framed(spark, sf_dir), "doc_id"))
    return got.select(F.col("id").alias("doc_id"), "entity_type", "n", F.array_join("examples", "; ").alias("examples"))


def ext10_family_counts(spark, sf_dir):
    """Money and article spans counted in place, without offsets."""
    t = framed(spark, sf_dir)
    count = lambda pattern: F.regexp_count("text", F.lit(f"(?i){pattern}")).cast("long")
    return t.select("doc_id", count(r"rs\.?[ \t\n]*[0-9,]+").alias("money"), count(r"\barticle[ \t\n]*[0-9]+").alias("articles"))


def ext12_citations(spark, sf_dir):
    return framed(spark, sf_dir).select("doc_id", F.array_join(extract.citations(F.col("text")), "; ").alias("citations"))


def ext13_cited_cases(spark, sf_dir):
    cited = framed(spark, sf_dir).select("doc_id", F.explode(extract.citations(F.concat("text", F.lit(" Civil Petition No. 77 of 2011 ")))).alias("citation"))
    index = spark.createDataFrame([("(2007) 3 SCC 755", "Case A")], "citation string, case_id string")
    return extract.cited_cases(cited, index)


def ext14_sentences(spark, sf_dir):
    s = evaluate.sentences(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", F.size(s).cast("long").alias("n"), F.md5(F.array_join(s, "|")).alias("digest"))


def ext15_tokens(spark, sf_dir):
    t = extract.terms(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, " ")).alias("digest"))


def chk1_recursive_chunks(spark, sf_dir):
    got = chunking.recursive_chunks(documents(spark, sf_dir), "doc_id", size=200, overlap=20)
    return got.select(F.col("id").alias("doc_id"), "chunk_id", "char_start", "char_end", F.md5("text").alias("digest"))


def chk1_token_chunks(spark, sf_dir):
    """The splitter's own sizes, measured in tokens of a public vocabulary."""
    import public_tokenizers

    count = chunking.TokenCounter(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    got = chunking.recursive_chunks(documents(spark, sf_dir), "doc_id", lengths=count)
    return got.select(F.col("id").alias("doc_id"), "chunk_id", "n_tokens", "char_start", "char_end", F.md5("text").alias("digest"))


#: Fixed values of the query below and its SQL: characters of a chunk and of what two chunks share.
LINE_SIZE, LINE_OVERLAP = 400, 100


def chk1_line_chunks(spark, sf_dir):
    """The same splitter, with lines as the only parts and characters as the measure."""
    got = chunking.recursive_chunks(documents(spark, sf_dir), "doc_id", size=LINE_SIZE, overlap=LINE_OVERLAP, lengths=chunking.count_characters, separators=(r"\n",))
    return got.select(F.col("id").alias("doc_id"), F.col("chunk").cast("long").alias("chunk"), "n_tokens", F.md5("text").alias("digest"))


def chk3_window_chunks(spark, sf_dir):
    got = chunking.window_chunks(documents(spark, sf_dir), "doc_id")
    return got.select(F.col("id").alias("doc_id"), F.col("chunk").cast("long").alias("chunk"), "n_tokens", F.md5("text").alias("digest"))


def spans(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Character windows of 600 every 400 as chunks; lines as sections, typed by their place."""
    rows = documents(spark, sf_dir).where(F.length("text") > 0).select(F.col("doc_id").alias("id"), "text", F.length("text").alias("n"))
    chunks = rows.select("id", "n", F.posexplode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(400))).alias("chunk", "char_start"))
    chunks = chunks.select("id", "chunk", "char_start", F.least(F.col("char_start") + 600, F.col("n")).alias("char_end"))
    lines = rows.select("id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("long", F.length("line"))
    from pyspark.sql import Window

    before = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("long") + 1).over(before), F.lit(0)).cast("int")
    typed = F.element_at(F.array(*[F.lit(t) for t in ("Facts", "Issues", "Held")]), F.col("pos") % 3 + 1)
    return chunks, lines.select("id", "pos", start.alias("start_char"), (start + F.col("long")).alias("end_char"), typed.alias("section_type"))


def chk4_overlap_tag(spark, sf_dir):
    return chunking.tag_sections(*spans(spark, sf_dir)).select(F.col("id").alias("doc_id"), "chunk", "char_start", "char_end", "section_type")


def chk4_overlap_pairs(spark, sf_dir):
    """Every chunk with every line that it shares characters with."""
    chunks, lines = spans(spark, sf_dir)
    met = chunking.overlap_pairs(chunks, lines, "id", ("char_start", "char_end"), ("start_char", "end_char"))
    return met.select(F.col("id").alias("doc_id"), "chunk", F.col("pos").cast("long").alias("pos"), F.col("shared").cast("long").alias("shared"))


def chk5_asof_page(spark, sf_dir):
    chunks, lines = spans(spark, sf_dir)
    starts = lines.select(F.col("id").alias("doc"), F.col("pos").alias("page"), F.col("start_char").alias("boundary"))
    return chunking.assign_pages(chunks, starts).select(F.col("id").alias("doc_id"), "chunk", "char_start", "page_number")


def exp1_df(spark, sf_dir):
    return explain.document_frequency(documents(spark, sf_dir), "doc_id")


def exp2_idf(spark, sf_dir):
    n = documents(spark, sf_dir).count()
    return explain.idf(explain.document_frequency(documents(spark, sf_dir), "doc_id"), n).select("term", "df", F.round("idf", 9).alias("idf"))


def vec6_tfidf_weights(spark, sf_dir):
    """The sparse rows that the encoder decomposes, one row for each weight, over the terms of two documents or more."""
    docs = documents(spark, sf_dir)
    kept = latent.vocabulary(docs, "doc_id", least=2).toArrow()
    words = kept.column("term").to_pylist()
    rows = latent.tfidf(docs, words, kept.column("idf").to_numpy(), "doc_id").select("id", F.explode(F.arrays_zip("places", "weights")).alias("e"))
    named = spark.createDataFrame(list(enumerate(words)), "place int, term string")
    return rows.join(F.broadcast(named), F.col("e.places") == F.col("place")).select(F.col("id").alias("doc_id"), "term", F.round("e.weights", 9).alias("weight"))


def vec6_latent_vectors(spark, sf_dir):
    """Latent vectors of all documents."""
    return latent.fit_and_encode(documents(spark, sf_dir), "doc_id").withColumnRenamed("id", "doc_id")


def exp3_top_terms(spark, sf_dir):
    """Each document against the next one."""
    d = documents(spark, sf_dir)
    pairs = d.select("doc_id", F.col("text").alias("text_a")).join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("text_b")), "doc_id")
    n = d.count()
    weights = explain.idf(explain.document_frequency(d, "doc_id"), n)
    return explain.top_shared_terms(pairs, weights, n, ["doc_id"]).select("doc_id", F.array_join("terms", " ").alias("terms"))


def evl10_grounding(spark, sf_dir):
    """Assistant turns against the turns before them."""
    turns = table(spark, sf_dir, "conversations")
    answers = turns.where("role = 'assistant'").select(F.concat_ws("-", "conv_id", "turn").alias("answer"), "conv_id", "turn", "text")
    earlier = turns.select("conv_id", F.col("turn").alias("before"), F.col("text").alias("source_text"))
    sources = answers.drop("text").join(earlier, "conv_id").where("before < turn").select("answer", "source_text")
    return evaluate.faithfulness(answers.select("answer", "text"), sources, "answer")


def evl11_ratings(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(documents(spark, sf_dir).select("doc_id", "source"), "doc_id")
    odd = lambda c: F.when(F.col("doc_id") % 7 == 0, "n/a").when(F.col("doc_id") % 11 == 0, "").otherwise((F.col(c) + 1).cast("string")).alias(c)
    return evaluate.rating_means(rows.select("source", odd("quality"), odd("toxic")), ["quality", "toxic"], "source")


def evl12_citation_truth(spark, sf_dir):
    """Documents cite those of their source whose ids are the lengths of their lines."""
    d = documents(spark, sf_dir)
    cited = d.select(F.col("doc_id").alias("case_id"), F.explode(F.transform(F.split("text", "\n"), lambda x: F.length(x).cast("long"))).alias("cited_case_id"))
    got = evaluate.citation_ground_truth(cited, d.select(F.col("doc_id").alias("case_id")))
    return got.select("query_case_id", F.array_join(F.col("relevant_case_ids").cast("array<string>"), ",").alias("relevant_case_ids"))


def evl13_merge(spark, sf_dir):
    d = documents(spark, sf_dir)
    one = d.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("query_case_id"), F.md5("text").alias("query_text"), F.array("source", "lang").alias("relevant_case_ids"))
    two = d.where("doc_id % 3 <> 1").select(F.col("doc_id").alias("query_case_id"), F.lit("second").alias("query_text"), F.array(F.lit("en"), F.col("source"), F.lit("z")).alias("relevant_case_ids"))
    got = evaluate.merge_test_sets([one, two])
    return got.select("query_case_id", "query_text", F.array_join("relevant_case_ids", ",").alias("relevant_case_ids"))


def evl14_split(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", F.concat(F.lit("Appeal "), (F.col("doc_id") * 7).cast("string"), F.lit("/"), (F.col("doc_id") % 40 + 1995).cast("string")).alias("case_id"))
    return evaluate.split_by_year(d, "case_id")


QUERIES = {
    f.__name__: f
    for f in (
        txt1_noise, txt2_unicode, txt3_collapse, txt4_clean, txt8_snippets, ext1_metadata, ext1_case_numbers, ext2_years, ext3_article_citations, ext3_section_citations, ext4_judges, ext5_bench, ext6_tail_outcome, ext7_headings, ext8_sections, ext9_facts, ext10_entities,
        ext10_family_counts, ext11_entity_summary, ext12_citations, ext13_cited_cases, ext14_sentences, ext15_tokens, chk1_recursive_chunks, chk1_token_chunks, chk1_line_chunks, chk3_window_chunks,
        chk4_overlap_tag, chk4_overlap_pairs, chk5_asof_page, exp1_df, exp2_idf, vec6_tfidf_weights, vec6_latent_vectors, exp3_top_terms, evl10_grounding, evl11_ratings, evl12_citation_truth, evl13_merge, evl14_split,
    )
}

_S = r"[ \t\n\x0B\f\r]"


def _sql_text(x: str) -> str:
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in x.split("\n"))


_FRAMED = f"framed AS (SELECT doc_id, {_sql_text(FRAME[0])} || coalesce(text, '') || {_sql_text(FRAME[1])} AS text FROM documents)"


def _without_noise(x: str) -> str:
    for pattern in (
        r"^\s*Diary\s+No\.[^\n]*?\n", r"^\s*ITEM\s+NO\.[^\n]*?\n", r"^\s*COURT\s+NO\.[^\n]*?\n", r"^\s*(?:Reportable|Non[- ]?Reportable)\s*\n", r"^\s*IN\s+THE\s+SUPREME\s+COURT\s+OF\s+INDIA\s*\n",
    ):
        x = f"regexp_replace({x}, '(?im){pattern}', '')"
    return f"ltrim({x}, chr(10))"


def _collapsed(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g'), '[ \t]{{2,}}', ' ', 'g'), '^\s+|\s+$', '', 'g')"


def _plain(x: str) -> str:
    x = f"replace(nfc_normalize({x}), chr(8212), '--')"
    return f"translate({x}, chr(8216) || chr(8217) || chr(8220) || chr(8221) || chr(8211) || chr(160) || chr(8194) || chr(8195) || chr(8203) || chr(65279), '''''\"\"-   ')"


# The frame's headings are the only ones: sections run from one line break before a heading to the next.
_PLACES = r""",
h AS (SELECT doc_id, text, CAST(strpos(text, chr(10) || 'FACTS' || chr(10)) - 1 AS INTEGER) AS f, CAST(strpos(text, chr(10) || 'ISSUES' || chr(10)) - 1 AS INTEGER) AS i,
  CAST(strpos(text, chr(10) || 'HELD' || chr(10)) - 1 AS INTEGER) AS h, CAST(length(text) AS INTEGER) AS n FROM framed),
r AS (
  SELECT doc_id, 0 AS pos, 'Unknown' AS section_type, 0 AS start_char, f AS end_char, substring(text, 1, f) AS t FROM h
  UNION ALL SELECT doc_id, 1, 'Facts', f, i, substring(text, f + 8, i - f - 7) FROM h
  UNION ALL SELECT doc_id, 2, 'Issues', i, h, substring(text, i + 9, h - i - 8) FROM h
  UNION ALL SELECT doc_id, 3, 'Held', h, n, substring(text, h + 7, n - h - 6) FROM h),
s AS (SELECT doc_id, pos, section_type, start_char, end_char, regexp_replace(t, '^\s+|\s+$', '', 'g') AS t FROM r)"""
_STOPS = ", ".join(f"'{w}'" for w in extract.p.STOP_WORDS)
_TERMS = f"t AS (SELECT doc_id, i, w FROM (SELECT doc_id, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z][a-z0-9\\-]+') AS w FROM documents)) WHERE length(w) > 2 AND w NOT IN ({_STOPS}))"
_DF = f"{_TERMS}, df AS (SELECT w AS term, count(DISTINCT doc_id) AS df FROM t GROUP BY w)"
_SPANS = """
d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) > 0),
c AS (SELECT doc_id, CAST((a / 400) AS INTEGER) AS chunk, CAST(a AS INTEGER) AS char_start, CAST(least(a + 600, n) AS INTEGER) AS char_end FROM (SELECT doc_id, n, unnest(range(0, n, 400)) AS a FROM d)),
l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM d),
l AS (SELECT doc_id, pos, length(line) AS m, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM l0)"""
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')"

#: The end of an act's name is looked ahead at; here it is read, which no other match needs.
_PROVISION = extract.p.PROVISION.replace(r"(?=\s*[,;.\n])", r"\s*[,;.\n]")

ORACLES = {
    "txt1_noise": f"WITH {_FRAMED} SELECT doc_id, md5({_without_noise('text')}) AS digest, CAST(length({_without_noise('text')}) AS BIGINT) AS n_chars FROM framed",
    "txt2_unicode": f"SELECT doc_id, md5({_plain('chr(8220) || ' + chr(39) + 'A' + chr(39) + ' || chr(8212) || ' + chr(39) + 'B' + chr(39) + ' || chr(8211) || ' + chr(39) + 'C' + chr(39) + ' || chr(8221) || chr(160) || ' + chr(39) + 'e' + chr(39) + ' || chr(769) || chr(8203) || ' + chr(39) + ' ' + chr(39) + ' || text')}) AS digest FROM documents",
    "txt3_collapse": f"SELECT page_id, md5({_collapsed(chr(39).join(['regexp_replace(html, ', '<[^>]*>', ', ', '  ', ' || chr(10), ', 'g', ')']))}) AS digest FROM pages",
    "txt4_clean": f"WITH {_FRAMED} SELECT doc_id, md5({_collapsed(_plain(_without_noise('text')))}) AS digest FROM framed",
    "txt8_snippets": "SELECT doc_id, substring(text, 1, 120) AS first_120, substring(text, 1, 800) AS first_800 FROM documents",
    "ext3_section_citations": rf"""
WITH t AS (SELECT doc_id, 'Sections 34 and 149; Section 302 of IPC, section 302 of the IPC; Sec. 13B of the Hindu Marriage Act, S. 138 NI Act. ' || coalesce(text, '') || ' Section ' || CAST(doc_id % 9 AS VARCHAR) || ' of CrPC.' AS t FROM documents),
m AS (SELECT doc_id, unnest(regexp_extract_all(t, '(?i){_PROVISION}')) AS m FROM t),
g AS (SELECT DISTINCT doc_id, trim('Section ' || regexp_extract(m, '(?i){_PROVISION}', 1) || ' ' || regexp_replace(regexp_extract(m, '(?i){_PROVISION}', 2), '^\s+|\s+$', '', 'g')) AS x FROM m WHERE regexp_extract(m, '(?i){_PROVISION}', 3) = '')
SELECT doc_id, string_agg(x, '; ' ORDER BY x) AS sections FROM g GROUP BY doc_id
""",
    "ext4_judges": rf"""
WITH t AS (SELECT doc_id, substring('Hon''ble Justice A. K. Sikri, Justice Indu Malhotra and Justice X, J. Nariman ' || CAST(doc_id AS VARCHAR) || ' Justice Indu Malhotra, ' || coalesce(text, ''), 1, 3000) AS t FROM documents),
-- The end of a name is a look-ahead in the operator; here a mark is set before each end, and names run up to the mark.
m AS (SELECT doc_id, regexp_replace(t, '(?i)(\s*(?:,|and\b|&|\n|J\.|$))', chr(30) || '\1', 'g') AS t FROM t),
n AS (SELECT doc_id, regexp_extract_all(t, '(?i)(?:Hon[''’]?ble|Justice|J\.)\x1e?\s+\x1e?([A-Z][a-zA-Z.\s\-]+?)\x1e', 1) AS n FROM m),
u AS (SELECT doc_id, regexp_replace(regexp_replace(unnest(n), '^\s+|\s+$', '', 'g'), '\.+$', '') AS n, unnest(range(1, len(n) + 1)) AS i FROM n),
f AS (SELECT doc_id, n, min(i) AS i FROM u WHERE length(n) > 2 GROUP BY doc_id, n),
g AS (SELECT doc_id, string_agg(n, '|' ORDER BY i) AS judges FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(g.judges, '') AS judges FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id
""",
    "ext10_family_counts": rf"""
WITH {_FRAMED} SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)rs\.?[ \t\n]*[0-9,]+')) AS BIGINT) AS money, CAST(len(regexp_extract_all(text, '(?i)\barticle[ \t\n]*[0-9]+')) AS BIGINT) AS articles FROM framed
""",
    "ext1_case_numbers": rf"""
WITH {_FRAMED}, m AS (SELECT doc_id, substring(text, 1, 3000) AS t FROM framed), p AS (SELECT '(?i){extract.p.CASE_NUMBER}' AS p)
SELECT doc_id, CASE WHEN regexp_matches(t, p) THEN trim(trim(regexp_extract(t, p, 1)) || ' ' || regexp_extract(t, p, 2) || '/' || regexp_extract(t, p, 3)) END AS case_id FROM m CROSS JOIN p
""",
    "ext2_years": rf"""
WITH {_FRAMED}, m AS (SELECT doc_id, substring(CASE doc_id % 3 WHEN 0 THEN text || ' decided on 3/4/1987' WHEN 1 THEN 'Dated: 12.11.2003 ' || text ELSE text END, 1, 5000) AS t FROM framed),
y AS (SELECT doc_id, regexp_extract(t, '(?i){extract.p.DATED}', 1) AS a, regexp_extract(t, '{extract.p.ANY_YEAR}', 1) AS b FROM m)
SELECT doc_id, coalesce(TRY_CAST(nullif(a, '') AS INTEGER), TRY_CAST(nullif(b, '') AS INTEGER)) AS year FROM y
""",
    "ext3_article_citations": rf"""
WITH {_FRAMED}, a AS (SELECT DISTINCT doc_id, 'Article ' || unnest(regexp_extract_all(text || ' Article 14, ARTICLE 19A and article 21; Article ' || CAST(doc_id % 9 AS VARCHAR), '(?i)article\s+([0-9]+[A-Za-z]?)', 1)) AS x FROM framed)
SELECT doc_id, string_agg(x, '; ' ORDER BY x) AS articles FROM a GROUP BY doc_id
""",
    "ext5_bench": "WITH n AS (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey) SELECT n_regionkey, "
    + ", ".join(
        f"CASE WHEN n - {i} <= 0 THEN 'Unknown' WHEN n - {i} = 1 THEN 'Single' WHEN n - {i} = 2 THEN 'Division' WHEN n - {i} = 3 THEN 'Three-Judge' ELSE 'Constitution' END AS less_{i}" for i in range(6)
    )
    + " FROM n",
    "ext6_tail_outcome": """
WITH s AS (SELECT doc_id, text || ' ' || (['The petitions are disposed of.', 'the appeal is allowed', 'PARTLY ALLOWED; disposed of', 'nothing', 'Writ Petition is dismissed, appeal allowed'])[CAST(doc_id % 5 + 1 AS INTEGER)] AS t FROM documents),
l AS (SELECT doc_id, lower(substring(t, CAST(floor(length(t) * CAST(0.8 AS DOUBLE)) AS BIGINT) + 1)) AS t FROM s)
SELECT doc_id, CASE """
    + " ".join(f"WHEN contains(t, '{k}') THEN '{v}'" for k, v in extract.p.OUTCOMES)
    + " ELSE 'Unknown' END AS outcome FROM l",
    "ext7_headings": f"SELECT doc_id, types, CAST(len(string_split(types, ',')) AS BIGINT) AS n FROM (SELECT doc_id, ({list(_TYPES)})[CAST(doc_id % {len(LAYOUTS)} + 1 AS INTEGER)] AS types FROM documents) WHERE types <> ''",
    "ext8_sections": f"WITH {_FRAMED}{_PLACES} SELECT doc_id, pos, section_type, start_char, end_char, md5(t) AS digest FROM s",
    "ext9_facts": f"WITH {_FRAMED}{_PLACES} SELECT doc_id, md5(t) AS digest FROM s WHERE section_type = 'Facts'",
    "ext12_citations": rf"""
WITH {_FRAMED}, c AS (SELECT doc_id, list_concat(regexp_extract_all(text, '(?i){extract.p.REPORTER}'), regexp_extract_all(text, '(?i){extract.p.CASE_CITATION}')) AS c FROM framed),
u AS (SELECT doc_id, trim(unnest(c)) AS x, unnest(range(1, len(c) + 1)) AS i FROM c),
f AS (SELECT doc_id, x, min(i) AS i FROM u GROUP BY doc_id, x),
g AS (SELECT doc_id, string_agg(x, '; ' ORDER BY i) AS citations FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(citations, '') AS citations FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id
""",
    "ext13_cited_cases": rf"""
WITH {_FRAMED}, t AS (SELECT doc_id, text || ' Civil Petition No. 77 of 2011 ' AS text FROM framed),
c AS (SELECT doc_id, list_concat(regexp_extract_all(text, '(?i){extract.p.REPORTER}'), regexp_extract_all(text, '(?i){extract.p.CASE_CITATION}')) AS c FROM t),
u AS (SELECT DISTINCT doc_id, trim(unnest(c)) AS citation FROM c)
SELECT doc_id, citation, CASE WHEN citation = '(2007) 3 SCC 755' THEN 'Case A' WHEN regexp_matches(citation, '(?i){extract.p.CASE_CITATION}')
  THEN regexp_extract(citation, '^\S+') || ' Appeal ' || regexp_extract(citation, '(?i){extract.p.CASE_CITATION}', 1) || '/' || regexp_extract(citation, '(?i){extract.p.CASE_CITATION}', 2) END AS cited_case_id FROM u
""",
    "ext14_sentences": rf"""
WITH p AS (SELECT doc_id, string_split(regexp_replace(trim(text), '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(30), 'g'), chr(30)) AS s FROM documents),
l AS (SELECT doc_id, unnest(s) AS s, unnest(range(1, len(s) + 1)) AS i FROM p),
g AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, '|' ORDER BY i)) AS digest FROM l WHERE trim(s) <> '' GROUP BY doc_id)
SELECT d.doc_id, coalesce(g.n, 0) AS n, coalesce(g.digest, md5('')) AS digest FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id
""",
    "ext15_tokens": f"""
WITH {_TERMS}, g AS (SELECT doc_id, count(*) AS n, md5(string_agg(w, ' ' ORDER BY i)) AS digest FROM t GROUP BY doc_id)
SELECT d.doc_id, coalesce(g.n, 0) AS n, coalesce(g.digest, md5('')) AS digest FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id
""",
    "chk3_window_chunks": f"""
WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
c AS (SELECT doc_id, w, unnest(range(0, greatest(CAST(ceil((len(w) - 32) / 96) AS BIGINT), 1))) AS chunk FROM w WHERE len(w) > 0)
SELECT doc_id, chunk, CAST(len(w[chunk * 96 + 1 : chunk * 96 + 128]) AS BIGINT) AS n_tokens, md5(array_to_string(w[chunk * 96 + 1 : chunk * 96 + 128], ' ')) AS digest FROM c
""",
    "chk1_line_chunks": rf"""
WITH RECURSIVE p AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '\n[^\n]*|[^\n]+') AS p FROM documents),
s AS (  -- s[i] is the length of all parts before the i-th
  SELECT doc_id, p, list_transform(range(0, len(p) + 1), lambda i: CAST(coalesce(list_sum(list_transform(p[1 : i], lambda x: length(x))), 0) AS BIGINT)) AS s FROM p),
step(doc_id, here, head, joined, n, whole) AS (  -- the run that ends before part here, and part here if it is too long
  SELECT doc_id, 1::BIGINT, 1::BIGINT, NULL::VARCHAR, 0::BIGINT, NULL::VARCHAR FROM s WHERE len(p) > 0
  UNION ALL
  SELECT doc_id, here + 1,
    CASE WHEN is_long THEN here + 1 WHEN is_full THEN list_filter(range(head, here + 1), lambda i: s[here] - s[i] <= {LINE_OVERLAP} AND NOT (s[here + 1] - s[i] > {LINE_SIZE} AND s[here] > s[i]))[1] ELSE head END,
    CASE WHEN (is_long OR is_full OR here > len(p)) AND here > head THEN array_to_string(p[head : here - 1], '') END, s[here] - s[head], CASE WHEN is_long THEN p[here] END
  FROM (SELECT s.*, here, head, here <= len(p) AND s[here + 1] - s[here] >= {LINE_SIZE} AS is_long, here <= len(p) AND s[here + 1] - s[head] > {LINE_SIZE} AND here > head AS is_full
    FROM step JOIN s ON s.doc_id = step.doc_id WHERE here <= len(p) + 1)),
out AS (
  SELECT doc_id, here, 0 AS k, n, regexp_replace(joined, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS t FROM step WHERE joined IS NOT NULL
  UNION ALL SELECT doc_id, here, 1, length(whole), whole FROM step WHERE whole IS NOT NULL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY here, k) - 1 AS chunk, n AS n_tokens, md5(t) AS digest FROM out WHERE t <> ''
""",
    "chk4_overlap_pairs": f"""
WITH {_SPANS} SELECT c.doc_id, c.chunk, CAST(l.pos AS BIGINT) AS pos, CAST(least(char_end, a + m) - greatest(char_start, a) AS BIGINT) AS shared
FROM c JOIN l ON l.doc_id = c.doc_id AND least(char_end, a + m) > greatest(char_start, a)
""",
    "chk4_overlap_tag": f"""
WITH {_SPANS}, o AS (
  SELECT c.doc_id, chunk, pos, least(char_end, a + m) - greatest(char_start, a) AS n FROM c JOIN l ON l.doc_id = c.doc_id AND least(char_end, a + m) > greatest(char_start, a)),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk ORDER BY n DESC, pos) AS k FROM o)
SELECT c.doc_id, c.chunk, char_start, char_end, coalesce(CASE b.pos % 3 WHEN 0 THEN 'Facts' WHEN 1 THEN 'Issues' WHEN 2 THEN 'Held' END, 'Unknown') AS section_type
FROM c LEFT JOIN b ON b.doc_id = c.doc_id AND b.chunk = c.chunk AND b.k = 1
""",
    "chk5_asof_page": f"""
WITH {_SPANS} SELECT c.doc_id, chunk, char_start, CAST(max(l.pos) AS INTEGER) AS page_number FROM c JOIN l ON l.doc_id = c.doc_id AND l.a <= char_start GROUP BY c.doc_id, chunk, char_start
""",
    "exp1_df": f"WITH {_DF} SELECT term, df FROM df",
    "exp2_idf": f"WITH {_DF} SELECT term, df, round(ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) + 1, 9) AS idf FROM df",
    "vec6_tfidf_weights": f"""
WITH {_DF}, kept AS (  -- the most frequent terms, as many as the encoder keeps
  SELECT term, df, ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) + 1 AS idf FROM df WHERE df >= 2 ORDER BY df DESC, term LIMIT 65536),
x AS (SELECT doc_id, w AS term, count(*) * max(idf) AS v FROM t JOIN kept ON kept.term = t.w GROUP BY doc_id, w)
SELECT doc_id, term, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 9) AS weight FROM x
""",
    "exp3_top_terms": f"""
WITH {_DF}, u AS (SELECT DISTINCT doc_id, w FROM t),
s AS (SELECT a.doc_id, a.w, row_number() OVER (PARTITION BY a.doc_id ORDER BY round(ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) + 1, 9) DESC, a.w) AS k
  FROM u a JOIN u b ON b.doc_id = a.doc_id + 1 AND b.w = a.w JOIN df ON df.term = a.w)
SELECT doc_id, string_agg(w, ' ' ORDER BY k) AS terms FROM s WHERE k <= 3 GROUP BY doc_id
""",
    "evl10_grounding": rf"""
WITH a AS (SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS answer, conv_id, turn, text FROM conversations WHERE role = 'assistant'),
p AS (SELECT answer, conv_id, turn, unnest(s) AS s, unnest(range(0, len(s))) AS pos FROM (
  SELECT *, string_split(regexp_replace(trim(text), '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(30), 'g'), chr(30)) AS s FROM a)),
s AS (SELECT * FROM p WHERE trim(s) <> ''),
w AS (SELECT DISTINCT answer, conv_id, turn, pos, unnest(regexp_extract_all(lower(s), '[a-z][a-z0-9]+')) AS w FROM s),
v AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z][a-z0-9]+')) AS w FROM conversations),
k AS (SELECT answer, pos, v.turn, count(*) AS k FROM w JOIN v ON v.conv_id = w.conv_id AND v.turn < w.turn AND v.w = w.w GROUP BY answer, pos, v.turn),
b AS (SELECT answer, pos, max(k) AS k FROM k GROUP BY answer, pos),
n AS (SELECT answer, pos, count(*) AS n FROM w GROUP BY answer, pos),
g AS (SELECT s.answer, count(*) AS n_sentences, sum(CASE WHEN n.n IS NULL OR coalesce(b.k, 0) >= 0.4 * n.n THEN 1 ELSE 0 END) AS n_grounded
  FROM s LEFT JOIN n ON n.answer = s.answer AND n.pos = s.pos LEFT JOIN b ON b.answer = s.answer AND b.pos = s.pos GROUP BY s.answer)
SELECT a.answer, coalesce(n_sentences, 0) AS n_sentences, CAST(coalesce(n_grounded, 0) AS BIGINT) AS n_grounded, round(coalesce(CAST(n_grounded AS DOUBLE) / n_sentences, 1.0), 9) AS faithfulness FROM a LEFT JOIN g ON g.answer = a.answer
""",
    "evl11_ratings": """
WITH r AS (SELECT source, doc_id, quality + 1 AS quality, toxic + 1 AS toxic FROM labels JOIN documents USING (doc_id) WHERE doc_id % 7 <> 0 AND doc_id % 11 <> 0),
l AS (SELECT source, 'quality' AS dimension, CAST(quality AS DOUBLE) AS v FROM r UNION ALL SELECT source, 'toxic', CAST(toxic AS DOUBLE) FROM r)
SELECT dimension, 'all' AS scope, CAST(NULL AS VARCHAR) AS annotator, count(*) AS n, round(avg(v), 2) AS mean FROM l GROUP BY dimension
UNION ALL SELECT dimension, 'annotator', source, count(*), round(avg(v), 2) FROM l GROUP BY dimension, source
""",
    "evl12_citation_truth": """
WITH c AS (SELECT DISTINCT doc_id AS a, CAST(length(x) AS BIGINT) AS b FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents)),
k AS (SELECT a, b FROM c WHERE a <> b AND b IN (SELECT doc_id FROM documents))
SELECT a AS query_case_id, string_agg(CAST(b AS VARCHAR), ',' ORDER BY b) AS relevant_case_ids FROM k GROUP BY a HAVING count(*) >= 2
""",
    "evl13_merge": """
WITH r AS (
  SELECT doc_id, source AS x FROM documents WHERE doc_id % 3 <> 0 UNION SELECT doc_id, lang FROM documents WHERE doc_id % 3 <> 0
  UNION SELECT doc_id, 'en' FROM documents WHERE doc_id % 3 <> 1 UNION SELECT doc_id, source FROM documents WHERE doc_id % 3 <> 1 UNION SELECT doc_id, 'z' FROM documents WHERE doc_id % 3 <> 1),
g AS (SELECT doc_id, string_agg(x, ',' ORDER BY x) AS relevant_case_ids FROM r GROUP BY doc_id)
SELECT g.doc_id AS query_case_id, CASE WHEN g.doc_id % 3 <> 0 THEN md5(d.text) ELSE 'second' END AS query_text, relevant_case_ids FROM g JOIN documents d ON d.doc_id = g.doc_id
""",
    "evl14_split": """
WITH c AS (SELECT doc_id, 'Appeal ' || CAST(doc_id * 7 AS VARCHAR) || '/' || CAST(doc_id % 40 + 1995 AS VARCHAR) AS case_id FROM documents)
SELECT doc_id, case_id, CASE WHEN coalesce(TRY_CAST(regexp_extract(case_id, '([0-9]{4})', 1) AS INTEGER), 0) >= 2020 THEN 'test' ELSE 'train' END AS split FROM c
""",
}
