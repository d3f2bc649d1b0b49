import math

import numpy as np
import pyarrow as pa
import pytest
from oracle import SMALL, rows_of, rows_of_sql
from pyspark.sql import functions as F

from plumbline.operators import diff, evaluate, ranking, vectors
from plumbline.plans import retrieval


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_top_k_ties_zeros_and_filters(spark):
    data = [(i, [1.0, 0.0], i % 2) for i in range(6)] + [(6, [0.0, 1.0], 0), (7, [0.0, 0.0], 1), (8, None, 0)]
    v = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").repartition(3)
    q = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0])], "query_id long, vector array<float>")
    got = rows(vectors.top_k(v, q, 3).orderBy("query_id", "rank"))
    assert [(r["query_id"], r["id"], r["score"]) for r in got] == [(1, 0, 1.0), (1, 1, 1.0), (1, 2, 1.0), (2, 0, 0.0), (2, 1, 0.0), (2, 2, 0.0)]
    odd = rows(vectors.top_k(v, q.where("query_id = 1"), 10, where=ranking.metadata_filter({"label": {"$in": [1]}})).orderBy("rank"))
    assert [r["id"] for r in odd] == [1, 3, 5, 7]
    assert vectors.top_k(v, q.where("query_id > 5"), 3).count() == 0


def test_blocks_of_queries_agree(spark, monkeypatch):
    rnd = np.random.default_rng(1)
    v = spark.createDataFrame([(i, rnd.normal(size=8).tolist()) for i in range(300)], "vec_id long, embedding array<double>")
    q = v.where("vec_id % 7 = 0").selectExpr("vec_id AS query_id", "embedding AS vector")
    whole = sorted(map(tuple, vectors.top_k(v, q, 5).collect()))
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 5)
    monkeypatch.setattr(vectors, "BLOCKS", 2)
    assert sorted(map(tuple, vectors.top_k(v, q, 5).collect())) == whole


def ranked(spark, lists):
    data = [(1, pos, x, r) for pos, xs in enumerate(lists) for r, x in enumerate(xs, 1)]
    return spark.createDataFrame(data, "query_id int, ranker_pos int, id string, rank int")


def test_a_vector_of_another_length_hides_no_neighbour(spark):
    rows = [(1, [1.0, 0.0, 0.0, 1.0]), (2, [0.0, 1.0, 1.0, 0.0]), (3, [1.0, 0.0, 0.0, 1.0, 5.0]), (4, None), (5, [1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 1.0])], "query_id long, vector array<double>")
    for dims in (None, (2, 4)):
        got = {r["id"]: round(r["score"], 6) for r in vectors.top_k(v, q, 9, dims=dims).collect()}
        assert got == {1: 1.0, 2: 0.0}
    away = spark.createDataFrame([(1, [-1.0, 0.0, 0.0, -1.0]), (2, None), (3, [1.0])], "query_id long, vector array<double>")
    assert [(r["query_id"], r["id"], round(r["score"], 6)) for r in vectors.top_k(v, away, 1).collect()] == [(1, 2, 0.0)]  # no null comes before a negative cosine


def test_fusion_golden_values(spark):
    got = rows(ranking.fuse(ranked(spark, ["abcd", "cbea"])).orderBy("rank"))
    want = {"c": 0.0910973085, "b": 0.0909090909, "a": 0.0892857143, "e": 0.0434782609, "d": 0.0416666667}
    assert [r["id"] for r in got] == list(want)
    assert all(abs(r["rrf_score"] - want[r["id"]]) < 1e-9 for r in got)


def plain_mmr(relevance, unit, k, balance):
    picked = []
    while len(picked) < min(k, len(relevance)):
        best, at = None, None
        for i in range(len(relevance)):
            if i in picked:
                continue
            near = max((float(unit[i] @ unit[j]) for j in picked), default=0.0)
            value = round(balance * relevance[i] - (1 - balance) * near, 12)
            if best is None or value > best:
                best, at = value, i
        picked.append(at)
    return picked


def test_mmr_against_the_plain_greedy(spark):
    rnd = np.random.default_rng(3)
    for n in (1, 2, 17, 60):
        vecs = rnd.normal(size=(n, 5))
        vecs[n // 2] = 0
        relevance = np.sort(rnd.random(n))[::-1]
        norms = np.linalg.norm(vecs, axis=1, keepdims=True)
        unit = np.divide(vecs, norms, out=np.zeros_like(vecs), where=norms > 0)
        assert ranking.select_diverse(relevance, vecs, 10, 0.6)[0] == plain_mmr(relevance, unit, 10, 0.6)


def test_mmr_skips_what_has_no_vector(spark):
    fused = spark.createDataFrame([(1, 10, 0.3, 1), (1, 11, 0.2, 2), (1, 12, 0.1, 3)], "query_id int, id long, rrf_score double, rank int")
    v = spark.createDataFrame([(10, [1.0, 0.0]), (12, [0.0, 1.0]), (11, None)], "vec_id long, embedding array<double>")
    got = rows(ranking.diversify(fused, v, 5).orderBy("rank"))
    assert [(r["id"], r["rank"]) for r in got] == [(10, 1), (12, 2)]


LISTS = {0: "ABCDE", 1: "AFCGE", 2: "BACDE", 3: "ABCDE"}


def lists(spark):
    data = [(1, n, r, c) for n, xs in LISTS.items() for r, c in enumerate(xs, 1)]
    results = spark.createDataFrame(data, "tree_id int, node_id int, rank int, case_id string")
    edges = spark.createDataFrame([(1, n, 0, "Numerical") for n in (1, 2, 3)], "tree_id int, node_id int, parent_id int, fact_type string")
    return edges, results


def test_rank_diff_golden_values(spark):
    edges, results = lists(spark)
    got = {r["node_id"]: r for r in rows(diff.rank_diff(edges, results, 5))}
    assert (got[1]["dropped"], got[1]["new"], got[1]["stable"]) == (["B", "D"], ["F", "G"], ["A", "C", "E"])
    assert got[1]["rank_displacements"] == {"A": 0, "B": 4, "C": 0, "D": 2, "E": 0, "F": 4, "G": 2}
    assert [got[n]["mean_displacement"] for n in (1, 2, 3)] == [pytest.approx(12 / 7), pytest.approx(0.4), 0.0]
    sens = {r["fact_type"]: r["sensitivity"] for r in rows(diff.sensitivity(edges, results, 5))}
    assert sens == {"Numerical": pytest.approx(0.704762, abs=1e-6), "Section": 0.0, "PartyType": 0.0, "Evidence": 0.0}
    assert rows(diff.most_operative(diff.sensitivity(edges, results, 5)))[0]["fact_type"] == "Numerical"
    shown = rows(diff.diff_table(edges, results, 5).where("node_id = 1").orderBy("position"))
    assert [(r["case_id"], r["parent_rank"], r["child_rank"]) for r in shown][-2:] == [("F", "-", "2"), ("G", "-", "4")]


def test_cases_count_once_and_empty_ones_do_not(spark):
    data = [(1, 0, 1, "A"), (1, 0, 2, "A"), (1, 0, 3, ""), (1, 0, 4, None), (1, 0, 5, "B")]
    results = spark.createDataFrame(data, "tree_id int, node_id int, rank int, case_id string")
    got = rows(diff.case_ranks(results, ["tree_id", "node_id"], 10).orderBy("rank"))
    assert [(r["case_id"], r["rank"]) for r in got] == [("A", 1), ("B", 2)]


def metrics(spark, found, relevant, k=10):
    r = spark.createDataFrame([("q", "m", c, i) for i, c in enumerate(found, 1)], "query_id string, mode string, case_id string, rank int")
    rel = spark.createDataFrame([("q", c) for c in relevant] or [("other", "x")], "query_id string, case_id string")
    return rows(evaluate.ranking_metrics(r, rel, k=k))[0]


def test_metric_golden_values(spark):
    assert metrics(spark, "vwxyaz", "abc")["ndcg_10"] == pytest.approx(0.18154179253735267, abs=1e-8)
    assert metrics(spark, "vwxyaz", "ab")["ndcg_10"] == pytest.approx(0.23719771276929622, abs=1e-8)
    five = metrics(spark, "xaybz", "abq", 5)
    assert five["ndcg_5"] == pytest.approx(0.4981892575, abs=1e-8) and five["mrr_5"] == 0.5 and five["recall_5"] == pytest.approx(2 / 3)
    assert metrics(spark, "abc", "")["ndcg_10"] == 0


def test_spearman_breaks_ties_by_name(spark):
    facts = {"Section": 1, "Evidence": 2, "PartyType": 3, "Numerical": 4}
    expert = spark.createDataFrame([("c", f, r) for f, r in facts.items()], "case_id string, fact string, expert_rank int")
    score = lambda s: spark.createDataFrame([("c", f, s.get(f, 0.0)) for f in facts], "case_id string, fact string, score double")
    assert rows(evaluate.spearman(expert, score({"Section": 2.0, "Evidence": 1.0, "PartyType": 1.5})))[0]["rho"] == pytest.approx(0.8)
    assert rows(evaluate.spearman(expert, score({})))[0]["rho"] == pytest.approx(-0.4)
    assert rows(evaluate.spearman(expert.limit(2), score({})))[0]["rho"] is None


def test_student_p_values():
    for t, df, want in ((2.228138852, 10, 0.05), (2.776445105, 4, 0.05), (1.0, 1, 0.5), (0.0, 7, 1.0), (12.7062047, 1, 0.05)):
        assert evaluate.student_p(t, df) == pytest.approx(want, abs=1e-6)
    assert math.isnan(evaluate.student_p(1.0, 0))


def test_paired_tests(spark):
    data = [(f"q{i}", m, x + i / 10) for i in range(5) for m, x in (("full", 0.3 + (i % 2) / 10), ("other", 0.1))]
    m = spark.createDataFrame(data, "query_id string, mode string, mrr_10 double")
    fewer = spark.createDataFrame([("q1", "fewer", 0.5)], m.schema)
    got = [r.asDict() for r in evaluate.paired_differences(m.unionByName(fewer), "full", ["mrr_10"]).collect()]
    assert len(got) == 1  # a mode with another number of queries is left out
    assert got[0]["n"] == 5 and got[0]["t_statistic"] == pytest.approx(9.7980, abs=1e-3) and got[0]["p_value"] == pytest.approx(0.000609, abs=1e-5)


def test_dispositive_facts(spark):
    expected = spark.createDataFrame([("c", "Section", True), ("c", "Evidence", True), ("c", "Numerical", False)], "case_id string, fact string, dispositive boolean")
    scores = spark.createDataFrame([("c", "Section", 1.6), ("c", "Evidence", 1.5)], "case_id string, fact string, score double")
    got = rows(evaluate.dispositive_accuracy(scores, expected))[0]
    assert (got["dispositive_accuracy"], got["other_accuracy"]) == (0.5, 1.0)


def test_faithfulness(spark):
    answers = spark.createDataFrame([(1, "The cat sat. Dogs bark loudly! 42."), (2, ""), (3, None)], "k int, text string")
    sources = spark.createDataFrame([(1, "a cat sat here"), (1, "nothing"), (1, None)], "k int, source_text string")
    got = {r["k"]: (r["n_sentences"], r["n_grounded"], r["faithfulness"]) for r in rows(evaluate.faithfulness(answers, sources, "k"))}
    assert got == {1: (3, 2, pytest.approx(2 / 3)), 2: (0, 0, 1.0), 3: (0, 0, 1.0)}
    assert [r["sentence"] for r in rows(evaluate.ungrounded_sentences(answers, sources, "k"))] == ["Dogs bark loudly!"]


def test_ratings_skip_what_is_no_number(spark):
    data = [("4", "a"), ("4.5", "a"), ("n/a", "b"), ("", None), ("2", None)]
    r = spark.createDataFrame(data, "clarity string, annotator_id string")
    got = {(x["scope"], x["annotator"]): (x["n"], x["mean"]) for x in rows(evaluate.rating_means(r, ["clarity"]))}
    assert got == {("all", None): (3, 3.5), ("annotator", "a"): (2, 4.25), ("annotator", "unknown"): (1, 2.0)}


def test_test_sets(spark):
    one = spark.createDataFrame([("a", "t1", ["x", "y"])], "query_case_id string, query_text string, relevant_case_ids array<string>")
    two = spark.createDataFrame([("a", "t2", ["y", "b"]), ("Appeal 1031/2024", "t", ["z"])], one.schema)
    merged = {r["query_case_id"]: r for r in rows(evaluate.merge_test_sets([one, two]))}
    assert merged["a"]["query_text"] == "t1" and merged["a"]["relevant_case_ids"] == ["b", "x", "y"]
    split = {r["query_case_id"]: r["split"] for r in rows(evaluate.split_by_year(two, "query_case_id"))}
    assert split == {"a": "train", "Appeal 1031/2024": "train"}


def test_full_pipeline_orders_what_mmr_picked(spark):
    rnd = np.random.default_rng(5)
    v = spark.createDataFrame([(i, rnd.normal(size=6).tolist()) for i in range(80)], "vec_id long, embedding array<double>")
    q = v.where("vec_id < 4").selectExpr("vec_id AS query_id", "embedding AS vector")
    first, second = vectors.top_k(v, q, 20), vectors.half_cosine(vectors.top_k(v, q, 20, dims=(3, 6)))
    for mode in ("full", "first_only", "second_only", "hybrid_no_mmr", "hybrid_no_reranker"):
        got = rows(ranking.retrieve(first, second, v, mode=mode))
        assert len(got) == 40 and {r["rank"] for r in got} == set(range(1, 11))
    scored = rows(ranking.rerank(first, score=-1.0 * vectors.F.col("score"), top_k=3).orderBy("query_id", "final_rank"))
    assert [r["rank"] for r in scored[:3]] == [20, 19, 18]


def searched(spark, n=600, width=6):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=width).tolist(), i % 100) for i in range(n)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, kind int").cache()
    return df, df.where("vec_id % 60 = 0").selectExpr("vec_id AS query_id", "embedding AS vector")


@pytest.mark.parametrize("condition", ["kind = 7", "kind >= 10", "kind >= 0", "kind < 0", "embedding[0] > -1.0"])
def test_staged_search_gives_the_rows_of_the_exact_filter(spark, condition):
    df, asked = searched(spark)
    exact = vectors.top_k(df, asked, 20, where=F.expr(condition))
    for sample in (10_000, 100):
        got = vectors.staged_search(df, asked, F.expr(condition), 20, sample=sample)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, exact.collect()))


def test_queries_short_of_rows_search_again(spark, monkeypatch):
    """Rows near one query fail the filter, so its first search leaves too few."""
    rng = np.random.default_rng(5)
    near = [(i, [1.0, 0.01 * i, 0.0], 0) for i in range(60)]
    rows = near + [(100 + i, [float(x) for x in rng.normal(size=3)], 1) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, kind int")
    asked = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [-1.0, 0.0, 0.0])], "query_id long, vector array<double>")
    sizes = []
    plain = vectors.top_k
    monkeypatch.setattr(vectors, "top_k", lambda *a, **k: sizes.append((a[1].count(), a[2])) or plain(*a, **k))
    got = vectors.staged_search(df, asked, F.col("kind") == 1, 10).collect()
    assert sizes[0][0] == 2 and len(sizes) > 1 and all(n == 1 for n, _ in sizes[1:]) and sizes[1][1] == 2 * sizes[0][1]
    monkeypatch.undo()
    assert sorted(map(tuple, got)) == sorted(map(tuple, vectors.top_k(df, asked, 10, where=F.col("kind") == 1).collect()))


def test_share_of_a_filter_is_within_its_bounds(spark):
    df = spark.range(50_000).withColumnRenamed("id", "vec_id")
    low, high = vectors.filter_share(df, F.col("vec_id") % 10 < 3, "vec_id", sample=2000)
    assert low < 0.3 < high and high - low < 0.15
    assert vectors.filter_share(df, F.col("vec_id") < 0, "vec_id", sample=100_000) == (0.0, 0.0)
    assert vectors.filter_share(df.limit(0), F.col("vec_id") < 0, "vec_id") == (0.0, 1.0)


def test_late_interaction(spark):
    rng = np.random.default_rng(6)
    asked = {q: rng.normal(size=(3, 4)).tolist() for q in (1, 2)} | {3: [], 4: None}
    held = {c: rng.normal(size=(c, 4)).tolist() for c in (1, 2, 5)} | {6: []}
    ranked = spark.createDataFrame([(q, c, r) for q in (1, 2, 3, 4, 5) for r, c in enumerate((1, 2, 5, 6, 7), 1)], "query_id int, id int, rank int")
    tokens = "tokens array<array<double>>"
    got = ranking.late_interaction(ranked, spark.createDataFrame(list(asked.items()), f"query_id int, {tokens}"), spark.createDataFrame(list(held.items()), f"id int, {tokens}"))
    for r in got.collect():
        a, h = asked.get(r["query_id"]), held.get(r["id"])
        want = sum(max(sum(x * y for x, y in zip(p, t)) for t in h) for p in a) if a and h else 0.0
        assert abs(r["interaction"] - want) < 1e-9
    assert got.count() == 25 and ranking.rerank(got, F.col("interaction"), 2).count() == 10


def test_modes_share_their_lists(spark):
    df, asked = searched(spark, 200)
    first, second = vectors.top_k(df, asked, 30), vectors.half_cosine(vectors.top_k(df, asked, 30, dims=(0, 3)))
    got = ranking.retrieve_modes(first, second, df)
    assert {r["mode"] for r in got.select("mode").distinct().collect()} == set(ranking.MODES)
    for mode in ranking.MODES:
        own = ranking.retrieve(first, second, df, mode=mode)
        assert own.columns == ["query_id", "id", "score", "rank"]
        assert sorted(map(tuple, own.collect())) == sorted(map(tuple, got.where(F.col("mode") == mode).drop("mode").collect()))


@pytest.mark.skipif(not SMALL.exists(), reason="the driver's tables are not here")
def test_metrics_by_labels_make_no_pairs(spark, monkeypatch):
    """Every query with every case of its label would be the square of a label's vectors."""
    want = rows_of_sql(retrieval.ORACLES["evl4_query_metrics"])

    def refuse(*_):
        raise AssertionError("pairs of queries and relevant cases")

    monkeypatch.setattr(evaluate, "relevance_of", refuse)
    assert rows_of(retrieval.evl4_query_metrics(spark, str(SMALL))) == want


def test_a_task_lets_only_its_best_rows_go(monkeypatch):
    rng = np.random.default_rng(3)
    rows, asked = np.round(rng.normal(size=(3000, 4)), 1), rng.normal(size=(7, 4))
    batches = [pa.RecordBatch.from_arrays([pa.array(range(a, a + 100)), pa.array(list(rows[a : a + 100]))], ["id", "vector"]) for a in range(0, 3000, 100)]
    blocks = [(list(range(4)), asked[:4]), ([4, 5, 6], asked[4:])]
    scores = np.round(asked @ rows.T, vectors.DECIMALS)
    want = {(q, int(i)) for q in range(7) for i in np.lexsort((np.arange(3000), -scores[q]))[:5]}
    found = [x for out in vectors._search(blocks, 5, False, None, 4)(iter(batches)) for x in out.to_pylist()]
    assert len(found) == 35 and {(x["query_id"], x["id"]) for x in found} == want
    monkeypatch.setattr(vectors, "HELD", 20)  # lets go early, and still all of the best
    monkeypatch.setattr(vectors, "SLICE", 64)
    assert want <= {(x["query_id"], x["id"]) for out in vectors._search(blocks, 5, False, None, 4)(iter(batches)) for x in out.to_pylist()}


def test_accuracies_of_facts_need_one_shuffle(spark):
    from plumbline.plans import records

    plan = records.evl8_dispositive(spark, str(SMALL))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan
