import json
import re
import time

import pytest
from oracle import rows_of, rows_of_sql
from pyspark.sql import functions as F

from plumbline.operators import chunking, explain, extract, facts, text
from plumbline.plans import corpus

CASE = """IN THE SUPREME COURT OF INDIA
Criminal Appeal No. 12-13 / 2019
FACTS
The accused, aged about 25 years, paid Rs. 1,50,000 under Section 302 of IPC. He was held for 3 years. See (2007) 3 SCC 755.
ISSUES
Whether Article 21 applies.
HELD
The appeal is dismissed.
"""


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "text string").select(column).first()[0]


def test_cause_list_noise(spark):
    noisy = "Diary No. 5\nITEM NO.3\nReportable\nIN THE SUPREME COURT OF INDIA\n\nBody\nReportable\nITEM NO. 9\n"
    assert one(spark, noisy, text.remove_cause_list(F.col("text"))) == "Body\nReportable\nITEM NO. 9\n"
    assert one(spark, "plain", text.remove_cause_list(F.col("text"))) == "plain"
    assert one(spark, None, text.clean(F.col("text"))) is None


def test_unicode_and_space(spark):
    assert one(spark, "“a”—b–c é​", text.normalise_unicode(F.col("text"))) == "\"a\"--b-c \xe9"
    assert one(spark, "\n a  \t b\n\n\n\nc \n", text.collapse_space(F.col("text"))) == "a b\n\nc"


def test_reading_order_is_anchored_at_a_row(spark):
    words = [("d", 1, t, b, x, w, 100.0) for t, b, x, w in ((10.0, 12.0, 5.0, "two"), (10.0, 12.0, 1.0, "one"), (12.5, 14.0, 9.0, "three"), (14.9, 16.0, 1.0, "four"), (2.0, 3.0, 0.0, "head"), (97.0, 98.0, 0.0, "foot"))]
    df = spark.createDataFrame(words, "doc string, page int, top double, bottom double, x0 double, text string, page_height double")
    got = text.page_texts(text.without_margins(df)).first()["text"]
    assert got == "one two three four"


def test_documents_and_page_starts(spark):
    pages = spark.createDataFrame([("d", 2, "bb"), ("d", 1, "a"), ("d", 3, "c")], "doc string, page int, text string")
    assert text.document_texts(pages).first()["text"] == "a\n\nbb\n\nc"
    assert {r["page"]: r["boundary"] for r in text.page_starts(pages).collect()} == {1: 0, 2: 3, 3: 7}
    df = spark.createDataFrame([("f", 2019, "Civil Appeal 1/2"), ("g", 2020, None)], "stem string, year int, named string")
    assert [r[0] for r in df.select(text.case_id(F.col("stem"), F.col("year"), F.col("named"))).collect()] == ["Civil_Appeal_1_2", "g_2020"]


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_metadata(spark):
    judged = "Hon'ble Justice A. Sharma, and Justice B. Rao\n" + CASE
    got = extract.metadata(docs(spark, CASE, judged, "", "dated: 3.4.1999 in 2005", "no 1949 but 1950"), "doc_id").orderBy("doc_id").collect()
    assert got[0]["case_id"] == "Criminal Appeal No. 12-13/2019" and got[0]["year"] == 2019 and got[0]["outcome_label"] == "Dismissed"
    assert got[0]["act_sections"] == ["Article 21", "Section 1", "Section 302 IPC"] and got[0]["bench_type"] == "Unknown"
    assert got[1]["bench_type"] in ("Division", "Three-Judge") and got[1]["judge_names"]
    assert got[2]["case_id"] is None and got[2]["year"] is None and got[2]["act_sections"] == []
    assert got[3]["year"] == 1999 and got[4]["year"] == 1950


def test_sections(spark):
    got = extract.sections(docs(spark, CASE, "no heading at all", " "), "doc_id").orderBy("id", "pos").collect()
    assert [(r["id"], r["section_type"]) for r in got] == [(0, "Unknown"), (0, "Facts"), (0, "Issues"), (0, "Held"), (1, "Facts"), (1, "Unknown")]
    for r in got[:4]:
        assert r["text"] in CASE[r["start_char"] : r["end_char"]]
    assert got[4]["end_char"] == got[5]["start_char"] == 3
    assert [a["end_char"] for a in got[:3]] == [b["start_char"] for b in got[1:4]]


def test_facts_text(spark):
    got = {r["id"]: r["facts"] for r in extract.facts_text(docs(spark, CASE, "abcdefghij" * 2), "doc_id").collect()}
    assert got[0].startswith("The accused") and got[0].endswith("SCC 755.")
    assert got[1] == "abcd"


def test_entities_first_family_wins(spark):
    got = extract.entities(docs(spark, CASE, "minors, the major part, a period of 3 years and 2 months", None), "doc_id").orderBy("id", "position").collect()
    first = [(r["entity_type"], r["match"]) for r in got if r["id"] == 0]
    assert ("MONETARY_AMOUNT", "Rs. 1,50,000") in first and ("LEGAL_SECTION", "Section 302 of IPC") in first and ("AGE", "aged about 25 years") in first
    assert len({(r["id"], r["start"], r["end"]) for r in got}) == len(got)
    assert [r["start"] for r in got if r["id"] == 0] == sorted(r["start"] for r in got if r["id"] == 0)
    second = [(r["entity_type"], r["match"]) for r in got if r["id"] == 1]
    assert ("MONETARY_AMOUNT", "rs,") in second and ("AGE", "major") not in second and ("DURATION", "3 years and 2 months") in second
    summary = {(r["id"], r["entity_type"]): r for r in extract.entity_summary(extract.entities(docs(spark, CASE), "doc_id")).collect()}
    assert summary[(0, "MONETARY_AMOUNT")]["examples"] == ["rs,", "Rs. 1,50,000"]


def test_citations(spark):
    t = "See (2007) 3 SCC 755, Civil Appeal No. 9 of 2011, (2007) 3 SCC 755."
    assert one(spark, t, extract.citations(F.col("text"))) == ["(2007) 3 SCC 755", "Civil Appeal No. 9 of 2011"]
    cited = spark.createDataFrame([("(2007) 3 SCC 755",), ("Civil Petition No. 9 of 2011",), ("junk",)], "citation string")
    index = spark.createDataFrame([("(2007) 3 SCC 755", "A")], "citation string, case_id string")
    assert {r["citation"]: r["cited_case_id"] for r in extract.cited_cases(cited, index).collect()} == {"(2007) 3 SCC 755": "A", "Civil Petition No. 9 of 2011": "Civil Appeal 9/2011", "junk": None}


def test_recursive_pieces_cover_the_text():
    words = " ".join(f"w{i}" for i in range(300))
    body = words + "\n\n" + words + "\nshort line. And another sentence here."
    pieces = chunking.split_text(body, 50, 10, chunking.count_words)
    assert all(chunking.count_words([p])[0] <= 50 for p in pieces)
    assert {w for p in pieces for w in p.split()} == set(body.split())
    spans = chunking.located(body, pieces)
    assert all(body[a:b] == p for p, (a, b) in zip(pieces, spans)) and [a for a, _ in spans] == sorted(a for a, _ in spans)
    assert chunking.split_text("abc", 2, 0, chunking.count_characters) == ["ab", "c"]


def plain_pieces(body, size, overlap, length, separators):
    """The splitter's rules with lists that are joined and measured part by part."""
    at = next((i for i, s in enumerate(separators) if not s or re.search(s, body)), None)
    separator, finer = ("", ()) if at is None else (separators[at], separators[at + 1 :] if separators[at] else ())
    if at is None:
        parts = [body]
    elif not separator:
        parts = list(body)
    else:
        found = re.split(f"({separator})", body)
        parts = [p for p in [found[0], *(found[i] + found[i + 1] for i in range(1, len(found), 2))] if p]
    out, good = [], []

    def flush():
        held, total = [], 0
        for part in good:
            n = length(part)
            if held and total + n > size:
                out.append("".join(held).strip())
                while total > overlap or (total + n > size and total > 0):
                    total -= length(held.pop(0))
            held.append(part)
            total += n
        if held:
            out.append("".join(held).strip())
        good.clear()

    for part in parts:
        if length(part) < size:
            good.append(part)
            continue
        flush()
        out += plain_pieces(part, size, overlap, length, finer) if finer else [part]
    flush()
    return [p for p in out if p]


@pytest.mark.parametrize("measure", ["words", "characters", "tokens"])
def test_splitter_against_its_rules(measure):
    import random

    counters = {"words": chunking.count_words, "characters": chunking.count_characters}
    if measure == "tokens":
        tokenizers = pytest.importorskip("public_tokenizers")
        counters["tokens"] = chunking.TokenCounter(tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)
    count = counters[measure]
    rnd = random.Random(3)
    signs = ["word", " ", " ", "\n", "\n\n", ". ", "\n1. ", "\n(a) ", "\n(iv) ", "longerword", "é日本", "\t", "x"]
    for size, overlap in ((5, 2), (12, 0), (40, 39), (1, 0)):
        for _ in range(120):
            body = "".join(rnd.choice(signs) for _ in range(rnd.randrange(90)))
            for separators in (chunking.SEPARATORS, (r"\n",), (r"\. ", " ")):
                assert chunking.split_text(body, size, overlap, count, separators) == plain_pieces(body, size, overlap, lambda p: count([p])[0], separators)


def test_each_part_of_a_long_text_is_measured_once_a_level():
    measured = []

    def count(pieces):
        measured.extend(map(len, pieces))
        return [len(p.split()) for p in pieces]

    body = "some words here. " * 40_000
    assert len(chunking.split_spans(body, 1000, 100, count)) > 100
    assert sum(measured) <= 2 * len(body)


def test_token_chunks_of_a_table(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    count = chunking.TokenCounter(tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN)
    got = chunking.recursive_chunks(docs(spark, "one two three four five. " * 30, None, ""), "doc_id", size=40, overlap=8, lengths=count).collect()
    assert len(got) > 3 and all(0 < r["n_tokens"] <= 40 for r in got) and {r["id"] for r in got} == {0}


def test_overlap_pairs_in_cells(spark):
    import random

    rnd = random.Random(8)
    spans = lambda n, most: [(rnd.randrange(3), i, a := rnd.randrange(200), a + rnd.randrange(most)) for i in range(n)]
    left, right = spans(80, 60), spans(70, 150)
    ours = spark.createDataFrame(left + [(0, 900, None, 5), (None, 901, 0, 9)], "id int, l int, a int, b int")
    theirs = spark.createDataFrame(right + [(0, 900, 5, 5)], "id int, r int, c int, d int")
    want = sorted((k, i, j, min(b, d) - max(a, c)) for k, i, a, b in left for m, j, c, d in right if k == m and min(b, d) > max(a, c))
    for cell in (1, 7, 64, 4096):
        got = chunking.overlap_pairs(ours, theirs, "id", ("a", "b"), ("c", "d"), cell)
        assert sorted((r["id"], r["l"], r["r"], r["shared"]) for r in got.collect()) == want


def test_a_document_of_many_chunks_and_sections(spark):
    """100,000 of each in one document: joined rows stay linear, so this ends soon."""
    n = 100_000
    chunks = spark.range(n).selectExpr("1L AS id", "CAST(id AS INT) AS chunk", "CAST(id * 100 AS INT) AS char_start", "CAST(id * 100 + 130 AS INT) AS char_end")
    sections = spark.range(n).selectExpr("1L AS id", "CAST(id AS INT) AS pos", "concat('S', id) AS section_type", "CAST(id * 100 - 20 AS INT) AS start_char", "CAST(id * 100 + 80 AS INT) AS end_char")
    began = time.perf_counter()
    got = chunking.tag_sections(chunks, sections)
    assert got.where("section_type = concat('S', chunk)").count() == n
    assert time.perf_counter() - began < 60


def test_section_tags(spark):
    chunks = spark.createDataFrame([(1, 0, 5, 15), (1, 1, 30, 40), (1, 2, 12, 22)], "id long, chunk int, char_start int, char_end int")
    sections = spark.createDataFrame([(1, 0, "Facts", 0, 10), (1, 1, "Issues", 10, 20)], "id long, pos int, section_type string, start_char int, end_char int")
    assert {r["chunk"]: r["section_type"] for r in chunking.tag_sections(chunks, sections).collect()} == {0: "Facts", 1: "Unknown", 2: "Issues"}


def test_pages_of_chunks(spark):
    chunks = spark.createDataFrame([("d", 0, 0, 4), ("d", 1, 9, 20), ("d", 2, 10, 20)], "id string, chunk int, char_start int, char_end int")
    starts = spark.createDataFrame([("d", 1, 0), ("d", 2, 10)], "doc string, page int, boundary int")
    assert {r["chunk"]: r["page_number"] for r in chunking.assign_pages(chunks, starts).collect()} == {0: 1, 1: 1, 2: 2}


def test_window_chunks(spark):
    got = chunking.window_chunks(docs(spark, " ".join(str(i) for i in range(10)), ""), "doc_id", size=4, overlap=1).orderBy("chunk").collect()
    assert [r["text"] for r in got] == ["0 1 2 3", "3 4 5 6", "6 7 8 9"]


def test_result_explanations(spark):
    rows = [
        (1, ["IPC-302"], ["IPC-302", "IPC-34"], "Tenant", None, "the tenant left", ["rent"]),
        (2, [], None, "Unknownish", "", "nothing", ["rent", "roof"]),
        (3, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "id int, query_sections array<string>, act_sections array<string>, petitioner string, respondent string, text string, terms array<string>")
    got = {r["id"]: r["explanation"] for r in explain.explain_results(df).collect()}
    assert got[1] == "This case involves IPC-302, which is also cited in your case. This case also involves a Tenant as the petitioner."
    assert got[2] == "This case shares similar factual patterns involving rent, roof."
    assert got[3] == explain.FALLBACK


def test_tree_output(spark):
    nodes = spark.createDataFrame([(1, 0, None, 0, "root"), (1, 1, 0, 1, "x")], "tree_id int, node_id int, parent_id int, depth int, description string")
    diffs = spark.createDataFrame([(1, 1, ["a"], ["b"], ["c"], 1.5)], "tree_id int, node_id int, dropped array<string>, new array<string>, stable array<string>, mean_displacement double")
    scores = spark.createDataFrame([(1, "Section", 1.5), (1, "Evidence", 0.0)], "tree_id int, fact_type string, sensitivity double")
    data = json.loads(explain.tree_json(nodes, diffs, scores).first()["json"])
    assert data["nodes"][1]["diff"]["newly_appeared_cases"] == ["b"] and data["sensitivity"] == {"Evidence": 0.0, "Section": 1.5}
    summaries = spark.createDataFrame([(1, 1, "When x, y.")], "tree_id int, node_id int, summary string")
    sheets = facts.extract_sheets(spark.createDataFrame([(1, "A witness saw him, aged 20."), (2, None)], "tree_id int, facts string"))
    found = spark.createDataFrame([(1, 1, "c", "Facts", 0.5, "near")], "tree_id int, rank int, case_id string, section_type string, score double, explanation string")
    page, other = (r["markdown"] for r in explain.report(sheets, found, summaries, scores, nodes).orderBy("tree_id").collect())
    assert page.startswith("# Counterfactual report: tree 1") and "| Section | 1.5000 |" in page and "\n\n- When x, y.\n\n" in page and "- Age: 20 (person)" in page
    assert "| 1 | c | Facts | 0.5000 | near |" in page and "**Section** with a sensitivity score of **1.50**." in page and page.endswith("Nodes of the tree: 2.")
    assert "No precedents were retrieved." in other and "not available" in other and other.endswith("Nodes of the tree: 0.")


ANSWERS = {
    '{"case_id": "a"}': "a", '```json\n{"case_id": "b"}\n```': "b", 'Here: {"case_id": "c", "parties": {"petitioner_type": "State"}} and {more} later }': "c",
    'x } {"case_id": "d"} {"case_id": "e"}': "d", '{"case_id": ': None, "no braces": None, "{a} {\"case_id\": \"f\"}": None, None: None, '{"outcome": null}': "own",
}


def test_first_balanced_block_of_an_answer(spark):
    df = spark.createDataFrame([(i, a) for i, a in enumerate(ANSWERS)], "i int, raw string")
    got = df.select("i", facts.from_answer(F.col("raw"), F.lit("own"))["case_id"].alias("id")).orderBy("i").collect()
    assert [r["id"] for r in got] == list(ANSWERS.values())


@pytest.mark.parametrize("fact", ["Section", "PartyType", "Evidence", "Numerical"])
def test_edge_summaries(spark, fact):
    rows = [("it changed", fact, "old", "new", list("abcdef"), ["z"], True, False), ("it changed", fact, "old", "new", [], [], False, False), ("it changed", fact, "", None, [], ["z"], False, False)]
    df = spark.createDataFrame(
        rows, "description string, fact_type string, original_value string, perturbed_value string, dropped array<string>, new array<string>, dropped_cite_original boolean, new_cite_perturbed boolean"
    )
    one, same, added = (r["summary"] for r in explain.explain_edges(df).collect())
    assert one.startswith("When it changed, 6 precedents dropped out of the top results, including a, b, c, d, e (and 1 more). These cases ")
    assert "1 new precedent became applicable, including z." in one and ("(new)" in one) == (fact == "Numerical")
    assert "did not significantly alter" in same
    assert added == "When it changed, no precedents dropped out of the top results. 1 new precedent became applicable, including z."


def test_entities_in_one_pass_are_those_of_a_join(spark):
    """The spans, families and positions that grouping every match of every pattern gives."""
    import random

    from pyspark.sql import Window

    from plumbline.functions import patterns

    rnd = random.Random(7)
    words = "Rs. 1,500 lakh aged about 25 years old minor major general age of 3 months and 2 days Section 302 of IPC Article 21 Order VII Rule 11 accused tenant FIR first information report 12".split()
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(60))) for _ in range(80)] + [None, "", CASE]
    df = docs(spark, *texts)
    found = extract.matches(df, patterns.ENTITIES, "doc_id").groupBy("id", "start", "end").agg(F.min(F.struct("family_pos", "pattern_pos", "family", "match")).alias("m"))
    order = Window.partitionBy("id").orderBy("start", "m.family_pos", "m.pattern_pos", "end")
    want = found.select("id", "start", "end", "m.family", "m.match", F.row_number().over(order).alias("position"))
    got = extract.entities(df, "doc_id")
    assert got.columns == ["id", "start", "end", "entity_type", "match", "position"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 500
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_nested_trees_of_any_depth(spark):
    """As a recursive build gives them, and back again."""
    import random

    rnd = random.Random(5)
    rows, trees = [], {}
    for tree_id in (1, 2, 3):
        depth, made = {0: 0}, [(0, None)]
        for node in range(1, 40 if tree_id < 3 else 14):
            parent = node - 1 if tree_id == 3 else rnd.randrange(node)  # the third is one chain
            depth[node] = depth[parent] + 1
            made.append((node, parent))
        rows += [(tree_id, n, q, depth[n], f'say "{n}"' if n % 3 else None) for n, q in made]

        def build(n):
            own = {"node_id": n} | ({"what": f'say "{n}"'} if n % 3 else {})
            return own | {"children": [build(c) for c, q in made if q == n]}

        trees[tree_id] = build(0)
    schema = "tree_id int, node_id long, parent_id long, depth int, what string"
    nodes = spark.createDataFrame(rows, schema).repartition(3)
    got = explain.nested_json(nodes, ["node_id", "what"])
    assert {r["tree_id"]: json.loads(r["json"]) for r in got.collect()} == trees
    back = explain.nodes_of_json(got, "node_id long, what string")
    assert sorted((r["tree_id"], r["node_id"], r["parent_id"], r["depth"], r["what"]) for r in back.collect()) == sorted(rows)
    assert explain.nested_json(nodes.limit(0), ["node_id"]).count() == 0


def test_nested_trees_in_parts(spark):
    """Parts of a few objects: together the same documents, and read back part by part; also with doubled and missing ids."""
    import hashlib
    import random

    rnd = random.Random(6)
    rows = []
    for tree_id in (1, 2, 3):
        depth = {0: 0}
        rows.append((tree_id, 0, None, 0, "root"))
        for node in range(1, 60):
            parent = node - 1 if tree_id == 3 and node < 15 else rnd.randrange(node)
            depth[node] = depth[parent] + 1
            rows.append((tree_id, node, parent, depth[node], rnd.choice(['a "b" \\', "]},{", '{"children":[', "\u00e9\n", None, ""])))
    rows += [(1, 59, 0, 1, "twice"), (1, 59, 0, 1, "twice"), (2, None, 0, 1, "no id"), (2, 900, 899, 1, "no parent"), (4, 0, None, 0, "alone")]
    nodes = spark.createDataFrame(rows, "tree_id int, node_id long, parent_id long, depth int, what string").repartition(3)
    whole = {r["tree_id"]: r["json"] for r in explain.nested_json(nodes, ["node_id", "what"]).collect()}
    want = sorted(map(str, explain.nodes_of_json(explain.nested_json(nodes, ["node_id", "what"]), "node_id long, what string").collect()))
    for limit in (1, 100, 1 << 18):
        parts = explain.nested_parts(nodes, ["node_id", "what"], limit=limit)
        texts = {}
        for r in parts.orderBy("part").collect():
            texts.setdefault(r["tree_id"], []).append(r["json"])
            assert len(r["json"]) < limit + 200
        joined = {t: "".join(x) for t, x in texts.items()}
        assert {t: len(x) for t, x in joined.items()} == {t: len(x) for t, x in whole.items()}
        assert joined[3] == whole[3] and joined[4] == whole[4]
        assert sorted(map(str, explain.nodes_of_parts(parts, "node_id long, what string").collect())) == want
        digests = {r["tree_id"]: (r["n_chars"], r["digest"]) for r in explain.parts_digest(parts).collect()}
        assert digests == {t: (len(x), hashlib.md5(x.encode()).hexdigest()) for t, x in joined.items()}
    assert explain.nodes_of_parts(explain.nested_parts(nodes.limit(0), ["node_id"]), "node_id long").count() == 0


def test_the_nested_round_trip_puts_no_tree_in_one_row(spark):
    from plumbline.plans import records

    seen = []

    def nested(*args, whole=explain.nested_parts):
        seen.append(whole(*args, limit=2000))
        return seen[-1]

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(explain, "nested_parts", nested)
        n = records.snk5_nested_round_trip(spark, "/root/testdata/sf0.001").count()
    assert n == records.places(spark, "/root/testdata/sf0.001").count()
    assert seen[0].count() > 50 and seen[0].agg(F.max(F.length("json"))).first()[0] < 2200


def test_judges_end_where_the_sql_ends_them(spark, tmp_path):
    texts = ["Justice A\nFoo bar, Justice Rao\x0b, ", "Justice Ann andé, J. Lee ", "Juſtice Rao and x", "J. Kim, x", "a b justice and", "Justice A and B, J. Lee"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "written"))
    next((tmp_path / "written").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    assert rows_of(corpus.ext4_judges(spark, str(tmp_path))) == rows_of_sql(corpus.ORACLES["ext4_judges"], tmp_path)
