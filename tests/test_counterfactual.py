import pytest
from pyspark.sql import functions as F

from plumbline.operators import facts, perturb, tree

ADJACENT = [("IPC-302", i, n) for i, n in enumerate(("IPC-300", "IPC-304", "IPC-304A", "IPC-307"))] + [("IPC-34", 0, "IPC-149"), ("Constitution-Article-21", 0, "Constitution-Article-14")]


def sheet(amounts=((500000.0, "rupees", "paid"),), ages=((25, "accused"),), durations=((3.0, "years", "held"),), cited=("IPC-302", "IPC-34"), parties=("Individual", "State"), evidence=("FIR", "MedicalReport", "Witness"), outcome="Convicted"):
    return {
        "case_id": "c",
        "parties": {"petitioner_type": parties[0], "respondent_type": parties[1]},
        "evidence_items": [{"evidence_type": e, "description": f"a {e}"} for e in evidence],
        "sections_cited": list(cited),
        "numerical_facts": {
            "amounts": [dict(zip(("value", "unit", "context"), a)) for a in amounts],
            "ages": [dict(zip(("value", "descriptor"), a)) for a in ages],
            "durations": [dict(zip(("value", "unit", "context"), a)) for a in durations],
        },
        "outcome": outcome,
    }


def nodes(spark, *sheets):
    return spark.createDataFrame([(i, 0, s) for i, s in enumerate(sheets)], f"tree_id long, node_id long, sheet {facts.SHEET}")


@pytest.fixture(scope="module")
def adjacency(spark):
    return spark.createDataFrame(ADJACENT, "section string, pos int, neighbour string")


def targets(spark, f, value, kind):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


def test_targets_golden_values(spark):
    assert targets(spark, perturb.amount_targets, 500000.0, "double") == [24999, 99999, 250000, 499999, 1000000, 1000001, 10000001, 100000001]
    assert targets(spark, perturb.amount_targets, 1.0, "double")[0] == 2.0
    for age, want in ((25, [6, 11, 17, 20, 60]), (20, [6, 11, 17, 21, 60]), (17, [6, 11, 18, 21, 60])):
        assert targets(spark, perturb.age_targets, age, "long") == want
    assert targets(spark, perturb.duration_targets, 3.0, "double") == [0.5, 1.5, 2.5, 6.0, 6.5, 12.5]


def test_numbers_of_spans(spark):
    spans = {"Rs. 1,500.50": 150050.0, "5 lakh": 5.0, "rs,": None, "aged about 25 years": 25.0, "INR 7": 7.0}
    df = spark.createDataFrame([(s,) for s in spans], "s string").select("s", perturb.number_in(F.col("s")).alias("n"))
    assert {r["s"]: r["n"] for r in df.collect()} == spans


def test_query_sentence(spark):
    got = nodes(spark, sheet(), sheet((), (), (), (), (None, None), (), None)).select("tree_id", facts.query_sentence(F.col("sheet")).alias("q")).orderBy("tree_id").collect()
    assert got[0]["q"] == (
        "This case involves a Individual against the State. The relevant legal provisions are IPC-302, IPC-34. Evidence includes FIR, MedicalReport, Witness. "
        "Key facts include 500000.0 rupees (paid), age 25 (accused), 3.0 years (held). The outcome was: Convicted."
    )
    assert got[1]["q"] == "This case involves a petitioner against the respondent."


def candidates(spark, adjacency, *sheets):
    return perturb.candidates(nodes(spark, *sheets), adjacency).orderBy("tree_id", "cand_pos").collect()


def test_candidates_in_order(spark, adjacency):
    got = candidates(spark, adjacency, sheet(ages=((25, "years old"),)))
    kinds = [r["edge"]["fact_type"] for r in got]
    assert kinds == sorted(kinds, key=["Numerical", "Section", "PartyType", "Evidence"].index)
    assert [r["cand_pos"] for r in got] == list(range(1, len(got) + 1))
    what = [r["edge"]["description"] for r in got]
    assert "Section changed from IPC-302 to IPC-300" in what and what.count("Section changed from IPC-302 to IPC-300") == 1
    assert "Petitioner type changed from Individual to Minor" in what and "Petitioner type changed from Individual to Corporation" in what
    assert "Respondent type changed from State to UnionOfIndia" in what
    assert "Evidence removed: FIR (a FIR)" in what and "Evidence added: DyingDeclaration" in what and "Evidence added: MedicalReport" not in what


def test_one_change_at_a_time(spark, adjacency):
    base = sheet()
    for r in candidates(spark, adjacency, base):
        new = r["sheet"].asDict(recursive=True)
        changed = [k for k in base if new[k] != base[k]]
        assert len(changed) == 1, r["edge"]
        if r["edge"]["fact_type"] == "Section":
            assert len(new["sections_cited"]) == 2 and r["edge"]["perturbed_value"] in new["sections_cited"]


def test_missing_values_are_appended_and_nulls_pass(spark, adjacency):
    got = candidates(spark, adjacency, sheet((), ((40, "x"),), (), (), ("Unknown", None), (), None))
    assert {r["edge"]["fact_type"] for r in got} == {"Evidence"} | ({"Numerical"} if any(r["edge"]["fact_type"] == "Numerical" for r in got) else set())
    df = spark.createDataFrame([([],)], f"a {facts.AGES}")
    item = F.struct(F.lit(3).cast("long").alias("value"), F.lit("perturbed").alias("descriptor"))
    out = df.select(perturb.replaced(F.col("a"), facts.AGES, lambda v: v == 9, F.lit(3).cast("long"), item).alias("a")).first()["a"]
    assert [(x["value"], x["descriptor"]) for x in out] == [(3, "perturbed")]


def test_neighbours(spark, adjacency):
    s = spark.createDataFrame([("IPC-302",), ("ipc 302",), ("constitution-article-21",), ("none",)], "section string")
    got = perturb.adjacent(s, adjacency).groupBy("section").count().collect()
    assert {r["section"]: r["count"] for r in got} == {"IPC-302": 4, "ipc 302": 4, "constitution-article-21": 1}
    upper = perturb.neighbours(s, adjacency).select("section").distinct().collect()
    assert {r["section"] for r in upper} == {"IPC-302", "ipc 302"}


def test_judging_distinct_changes_once(spark, adjacency):
    found = perturb.candidates(nodes(spark, sheet(), sheet()), adjacency)
    judge = lambda what: F.when(F.contains(what, F.lit("Evidence")), '```json\n{"plausible": false}\n```').otherwise("no json")
    judged = perturb.validated(found, judge)
    assert {(r["edge"]["fact_type"] != "Evidence") == r["accepted"] for r in judged.collect()} == {True}
    stats = perturb.validation_stats(judged).first()
    assert stats["rejected"] == 5 and stats["cached"] == stats["accepted"] + stats["rejected"]
    reasons = {r["verdict"]["reasoning"] for r in perturb.validated(found).collect()}
    assert "Section substitution to adjacent provision." in reasons and "Evidence toggle affects evidentiary basis." in reasons


def lists(k):
    """A search whose lists move with the number of cited sections or stand still."""

    def search(frontier):
        shift = F.when(F.lit(k) > 0, F.pmod(F.xxhash64(facts.query_sentence(F.col("sheet"))), F.lit(k))).otherwise(0)
        return frontier.select("tree_id", "node_id", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("rank"), shift.alias("s")).select(
            "tree_id", "node_id", "rank", (F.col("rank") + F.col("s") * 20).cast("string").alias("case_id")
        )

    return search


def test_tree_levels_and_pruning(spark, adjacency):
    start = nodes(spark, sheet(), sheet(cited=())).select("tree_id", "sheet")
    moving, results = tree.expand(start, adjacency, lists(1000), max_depth=2, max_children=3)
    counts = {(r["tree_id"], r["depth"]): r["n"] for r in tree.depth_counts(moving).collect()}
    assert counts == {(t, d): 3**d for t in (0, 1) for d in (0, 1, 2)}
    assert results.select("tree_id", "node_id").distinct().count() == moving.count() == 26
    ids = [r["node_id"] for r in moving.where("tree_id = 0").orderBy("node_id").collect()]
    assert ids == list(range(13))
    still, _ = tree.expand(start, adjacency, lists(0), max_depth=3, max_children=2)
    assert still.count() == 6
    unsearched, none = tree.expand(start, adjacency, None, max_depth=0, max_children=1)
    assert unsearched.count() == 4 and none is None


def test_tree_tools(spark, adjacency):
    start = nodes(spark, sheet()).select("tree_id", "sheet")
    grown, _ = tree.expand(start, adjacency, None, max_depth=1, max_children=2)
    manual = grown.where("node_id = 2").select("tree_id", "node_id", "sheet", F.lit("by hand").alias("description"))
    more = tree.add_manual(grown, manual)
    last = more.where("node_id = 3").first()
    assert (last["parent_id"], last["depth"], last["edge"]["fact_type"], last["edge"]["original_value"]) == (2, 2, "Numerical", "(manual)")
    lines = tree.outline(more).first()["outline"].split("\n")
    assert lines[0] == "0: root" and lines[-1] == "    3: by hand" and len(lines) == 4
    assert {r["node_id"]: r["depth"] for r in tree.depths(more).collect()} == {0: 0, 1: 1, 2: 1, 3: 2}
    assert tree.edges(more).count() == 3
    edited = more.limit(1).select(tree.edited_sheet(F.col("sheet"), F.lit(" IPC-1, ,IPC-2 "), F.lit('[{"evidence_type":"FIR","description":"x"}]'), F.lit("  ")).alias("s")).first()["s"]
    assert edited["sections_cited"] == ["IPC-1", "IPC-2"] and edited["outcome"] is None and edited["evidence_items"][0]["evidence_type"] == "FIR"


def test_rule_sheets_and_answers(spark):
    t = "Criminal Appeal No. 12 Section 302 of IPC, Section 302 of IPC and Article 21, aged about 25, paid Rs. 1,50,000 and Rs. 5 lakhs; a confession; appeal is allowed"
    df = spark.createDataFrame([("a", t), ("b", "nothing"), ("c", None)], "case_id string, facts string")
    got = {r["case_id"]: r["sheet"] for r in facts.extract_sheets(df).collect()}
    a = got["a"]
    assert a["case_id"] == "Criminal Appeal No. 12" and "IPC-302" in a["sections_cited"] and "Constitution-Article-21" in a["sections_cited"]
    assert a["sections_cited"].count("IPC-302") == 1
    assert [(x["value"], x["unit"]) for x in a["numerical_facts"]["amounts"]] == [(150000.0, "rupees"), (5.0, "lakh")]
    assert a["outcome"] == "Allowed" and [e["evidence_type"] for e in a["evidence_items"]] == ["Confession"]
    assert got["b"]["case_id"] == "unknown" and got["c"]["sections_cited"] == []
    answered = facts.extract_sheets(df, lambda c: F.when(c == "nothing", F.lit('Sure: ```json\n{"case_id": "x", "sections_cited": ["IPC-1"]}\n```')).otherwise("no"))
    answers = {r["case_id"]: r["sheet"] for r in answered.collect()}
    assert answers["b"]["case_id"] == "x" and answers["a"] is None
    assert facts.extraction_stats(answered).first()["n_failed"] == 2


def test_answers_are_completed_validated_and_asked_twice(spark):
    df = spark.createDataFrame([("a", "none"), ("b", "empty"), ("c", "bad"), ("d", "twice"), (None, "none")], "case_id string, facts string")

    def answer(c):
        whole = F.lit('{"parties": {"petitioner_type": "Alien", "respondent_type": "Tenant"}, "sections_cited": [" IPC 5 "]}')
        return F.when(c == "none", whole).when(c == "empty", F.lit('{"case_id": "", "outcome": "x"}')).when(c == "bad", F.lit('{"outcome": '))

    second = lambda c: F.when(c == "twice", F.lit('{"case_id": "late"}')).when(c == "bad", F.lit("no {at all}")).when(c.isNotNull(), F.lit('{"case_id": "wrong"}'))
    once = {r["case_id"]: r["sheet"] for r in facts.extract_sheets(df, answer).collect()}
    assert once["a"]["case_id"] == "a" and once["b"]["case_id"] == "b" and once[None]["case_id"] == "unknown"
    assert tuple(once["a"]["parties"]) == ("Unknown", "Tenant") and once["a"]["sections_cited"] == ["IPC-5"]
    assert once["c"] is None and once["d"] is None
    twice = {r["case_id"]: r["sheet"] for r in facts.extract_sheets(df, answer, second).collect()}
    assert twice["d"]["case_id"] == "late" and twice["c"] is None and twice["a"] == once["a"] and twice["b"] == once["b"]


def test_validators(spark):
    df = spark.createDataFrame([("Tenant", ["IPC-302", " IPC 5 ", "odd"]), ("Alien", None), (None, [])], "p string, s array<string>")
    got = [tuple(r) for r in df.select(facts.valid_party(F.col("p")), facts.valid_sections(F.col("s"))).collect()]
    assert got == [("Tenant", ["IPC-302", "IPC-5", "odd"]), ("Unknown", []), (None, [])]


def test_every_sheet_has_a_tree_of_full_depth_and_width(spark, tmp_path):
    from plumbline.plans import counterfactual

    spark.range(1, 13).selectExpr("id AS c_custkey", "CAST(id * 1000.5 AS DOUBLE) AS c_acctbal", "'x' AS c_mktsegment", "id % 25 AS c_nationkey").write.parquet(str(tmp_path / "customer.parquet"))
    nodes = counterfactual.tre3_expanded(spark, str(tmp_path)).collect()
    assert {r["tree_id"] for r in nodes} == set(range(1, 13)) and max(r["depth"] for r in nodes) == 3
    children = {}
    for r in nodes:
        if r["parent_id"] is not None:
            key = (r["tree_id"], r["parent_id"])
            children[key] = children.get(key, 0) + 1
    assert max(children.values()) == 5 and all(children[(t, 0)] == 5 for t in range(1, 13))


def test_variants_are_ordered_in_a_row_without_a_shuffle(spark, adjacency):
    found = perturb.candidates(spark.range(8).repartition(4).select(F.col("id").alias("tree_id"), F.lit(0).alias("node_id"), F.lit(None).cast(facts.SHEET).alias("sheet")), adjacency)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan


def test_partitions_of_trees_grow_with_their_rows(spark):
    from plumbline.session import by_key

    assert by_key(spark.range(1000), "id", rows=1000, per_task=20).rdd.getNumPartitions() == 50


def test_levels_are_numbered_in_tasks_of_bounded_rows(spark, adjacency):
    import re

    dealt = [tree.by_tree(spark.range(8).withColumnRenamed("id", "tree_id"), n).rdd.getNumPartitions() for n in (8, 120_000, 10_000_000, 100_000_000)]
    assert dealt == [4, 6, 200, 400]
    grown, _ = tree.expand(nodes(spark, sheet(), sheet(cited=())).select("tree_id", "sheet"), adjacency, None, max_depth=2, max_children=2)
    plan = grown._jdf.queryExecution().executedPlan().toString()
    shuffles = re.findall(r"Exchange hashpartitioning\(tree_id#\d+L, \d+\), (\w+)", plan)
    assert "Window" in plan and set(shuffles) == {"REPARTITION_BY_NUM"}
    assert sorted(r["node_id"] for r in grown.where("tree_id = 1").collect()) == list(range(7))


def test_staged_levels_and_lists_are_never_broadcast(spark, adjacency):
    """Their files are far smaller than their rows; only the one row of adjacent provisions goes to all tasks."""
    from plumbline.plans.counterfactual import lists_by_hash

    grown, _ = tree.expand(nodes(spark, sheet(), sheet(cited=())).select("tree_id", "sheet"), adjacency, lists_by_hash, max_depth=2, max_children=2)
    plan = grown._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan and "ShuffledHashJoin" not in plan
    assert plan.count("BroadcastExchange") == 1


def test_the_search_of_the_query_reads_a_sheet_once(spark):
    """Not once for each of its twelve cases."""
    from plumbline.plans.counterfactual import lists_by_hash

    found = lists_by_hash(tree.roots(nodes(spark, sheet()).select("tree_id", "sheet")))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("xxhash64")
    assert [(r["rank"], int(r["case_id"]) - r["rank"]) for r in found.orderBy("rank").collect()] == [(i, int(found.first()["case_id"]) - 1) for i in range(1, 13)]


def test_first_changes_are_those_of_all(spark, adjacency):
    rows = nodes(spark, sheet())
    every = [r["edge"] for r in perturb.candidates(rows, adjacency).orderBy("cand_pos").collect()]
    for n in (1, 3, len(every) - 1, len(every) + 5):
        some = perturb.made_of(perturb.first_candidates(rows, adjacency, n), F.col("_changes")).orderBy("cand_pos").collect()
        assert [r["edge"] for r in some] == every[:n]
    judged = perturb.made_of(perturb.first_candidates(rows, adjacency, 2, lambda c: F.when(c.startswith("Evidence"), "{}").otherwise('{"plausible": false}')), F.col("_changes")).orderBy("cand_pos").collect()
    assert [r["edge"] for r in judged] == [e for e in every if e["fact_type"] == "Evidence"][:2]
