"""Evaluation of ranked lists and of explanations, and the statistics around it."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def relevance_of(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """Ranked rows (keys, case_id, rank) with ``hit``: whether (query_id, case_id) is among ``relevant``."""
    marks = relevant.select("query_id", "case_id").distinct().withColumn("hit", F.lit(True))
    return ranked.join(marks, ["query_id", "case_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def ideal(n: Column, k: int) -> Column:
    """Ideal discounted gain of ``n`` relevant cases within ``k`` ranks."""
    gains = F.transform(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(k)), F.lit(1)).cast("int")), lambda i: 1.0 / F.log2(i + 1.0))
    return F.aggregate(gains, F.lit(0.0), lambda s, g: s + g)


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, keys: tuple[str, ...] = ("query_id", "mode"), k: int = 10, recalls: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Per list: mrr_k, ndcg_k (binary) and recall at several depths; a query without relevant cases scores 0.

    ``ranked`` has one row per case and list (see ``ranking.distinct_first``) with the rank in ``rank``.
    """
    totals = relevant.groupBy("query_id").agg(F.countDistinct("case_id").alias("n_relevant"))
    return metrics_of_hits(relevance_of(ranked, relevant), totals, keys, k, recalls)


def metrics_of_hits(marked: DataFrame, totals: DataFrame, keys: tuple[str, ...] = ("query_id", "mode"), k: int = 10, recalls: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """The same of ranked rows that know their ``hit`` (boolean), and ``totals`` (query_id, n_relevant).

    For relevance that follows from columns of both sides, so that pairs of queries and relevant cases need not be written out.
    """
    hit = F.col("hit")
    sums = marked.groupBy(*keys).agg(
        F.coalesce(1.0 / F.min(F.when(hit & (F.col("rank") <= k), F.col("rank"))), F.lit(0.0)).alias(f"mrr_{k}"),
        F.coalesce(F.sum(F.when(hit & (F.col("rank") <= k), 1.0 / F.log2(F.col("rank") + 1.0))), F.lit(0.0)).alias("_gain"),
        *[F.sum((hit & (F.col("rank") <= r)).cast("int")).alias(f"_found_{r}") for r in recalls],
    )
    joined = sums.join(totals, "query_id", "left").withColumn("n_relevant", F.coalesce("n_relevant", F.lit(0)))
    some = F.col("n_relevant") > 0
    return joined.select(
        *keys,
        F.round(f"mrr_{k}", 9).alias(f"mrr_{k}"),
        F.round(F.when(some, F.col("_gain") / ideal(F.col("n_relevant"), k)).otherwise(F.lit(0.0)), 9).alias(f"ndcg_{k}"),
        *[F.round(F.when(some, F.col(f"_found_{r}") / F.col("n_relevant")).otherwise(F.lit(0.0)), 9).alias(f"recall_{r}") for r in recalls],
    )


def mode_means(metrics: DataFrame, names: list[str]) -> DataFrame:
    """Means per mode to four decimals, with an overall row (mode null)."""
    return metrics.rollup("mode").agg(F.count(F.lit(1)).alias("n_queries"), *[F.round(F.avg(n), 4).alias(n) for n in names])


def paired_differences(metrics: DataFrame, base: str, names: list[str]) -> DataFrame:
    """Per other mode and metric: n, mean difference, paired t of ``base`` against it and its two-sided p.

    t and p are null without spread. A mode with another number of queries than ``base`` is left out.
    """
    counts = metrics.groupBy("mode").agg(F.count(F.lit(1)).alias("_rows"))
    same = counts.join(counts.where(F.col("mode") == base).select("_rows"), "_rows", "left_semi").select("mode")
    metrics = metrics.join(same, "mode", "left_semi")
    long = metrics.unpivot(["query_id", "mode"], names, "metric", "value")
    full = long.where(F.col("mode") == base).select("query_id", "metric", F.col("value").alias("x"))
    other = long.where(F.col("mode") != base)
    d = full.join(other, ["query_id", "metric"]).withColumn("d", F.col("x") - F.col("value"))
    stats = d.groupBy("mode", "metric").agg(F.count("d").alias("n"), F.avg("d").alias("m"), F.stddev_samp("d").alias("s"))
    t = F.when(F.col("s") > 1e-12, F.col("m") / (F.col("s") / F.sqrt(F.col("n").cast("double"))))
    found = stats.select("mode", "metric", "n", F.round("m", 6).alias("mean_difference"), t.alias("t"))
    return found.select("mode", "metric", "n", "mean_difference", F.round("t", 4).alias("t_statistic"), F.round(_p_values("t", F.col("n") - 1), 6).alias("p_value"))


@F.arrow_udf(T.DoubleType())
def _p_values(t: pa.Array, df: pa.Array) -> pa.Array:
    """For the one row of each mode and metric."""
    return pa.array([None if x is None else student_p(x, n) for x, n in zip(t.to_pylist(), df.to_pylist())], pa.float64())


def student_p(t: float, df: int) -> float:
    """Two-sided p value of Student's t by the continued fraction of the incomplete beta function."""
    if df <= 0 or math.isnan(t):
        return math.nan
    x, a, b = df / (df + t * t), df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(max(x, 1e-300)) + b * math.log(max(1 - x, 1e-300)))

    def fraction(x: float, a: float, b: float) -> float:
        tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        out = d
        for m in range(1, 300):
            for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (v if abs(v := 1 + step * d) > tiny else tiny)
                c = v if abs(v := 1 + step / c) > tiny else tiny
                out *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return out

    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b


def spearman(expert: DataFrame, scores: DataFrame) -> DataFrame:
    """Per case: n and rho of expert ranks against descending scores; ties by name; null below three facts.

    ``expert``: case_id, fact, expert_rank; ``scores``: case_id, fact, score.
    """
    both = expert.join(scores, ["case_id", "fact"])
    own = both.withColumn("score_rank", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("score"), "fact")))
    given = own.withColumn("given_rank", F.row_number().over(Window.partitionBy("case_id").orderBy("expert_rank", "fact")))
    d = F.col("given_rank") - F.col("score_rank")
    sums = given.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.sum(d * d).alias("d2"))
    n = F.col("n").cast("double")
    return sums.select("case_id", "n", F.when(F.col("n") >= 3, F.round(1 - 6 * F.col("d2") / (n * (n * n - 1)), 9)).alias("rho"))


def dispositive_accuracy(scores: DataFrame, expected: DataFrame, threshold: float = 1.5) -> DataFrame:
    """Per case: how many expected facts are on their side of the threshold, and the accuracies.

    ``expected``: case_id, fact, dispositive (boolean); ``scores``: case_id, fact, score (missing counts as 0).
    """
    return accuracy_of_scored(expected.join(scores, ["case_id", "fact"], "left"), threshold)


def accuracy_of_scored(both: DataFrame, threshold: float = 1.5) -> DataFrame:
    """The same of rows (case_id, dispositive, score) that have both already; a score that is null counts as 0."""
    high = F.coalesce("score", F.lit(0.0)) > threshold
    sums = both.groupBy("case_id").agg(
        F.count_if("dispositive").alias("n_dispositive"),
        F.count_if(F.col("dispositive") & high).alias("dispositive_correct"),
        F.count_if(~F.col("dispositive")).alias("n_other"),
        F.count_if(~F.col("dispositive") & ~high).alias("other_correct"),
    )
    rate = lambda a, b: F.round(F.col(a) / F.greatest(F.col(b), F.lit(1)), 9)
    return sums.select("*", rate("dispositive_correct", "n_dispositive").alias("dispositive_accuracy"), rate("other_correct", "n_other").alias("other_accuracy"))


TOKEN = r"[a-z][a-z0-9]+"


def grounding_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1)))


def sentences(text: Column) -> Column:
    """Sentences: split after an end mark and white space; empty ones go."""
    return F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"(?<=[.!?])[ \t\n\x0B\f\r]+"), lambda s: F.trim(s) != "")


def faithfulness(answers: DataFrame, sources: DataFrame, key: str, threshold: float = 0.4) -> DataFrame:
    """Per answer: n_sentences, n_grounded and faithfulness.

    ``answers``: key, text; ``sources``: key, source_text. A sentence is grounded if its tokens' share in any source of
    its answer reaches the threshold, or if it has none; an answer without sentences has 1. Tokens are joined with the
    sources' tokens by key, so an answer with many or long sources is spread by its tokens.
    """
    parts = answers.select(key, F.posexplode(sentences(F.col("text"))).alias("pos", "sentence")).withColumn("tokens", grounding_tokens(F.col("sentence")))
    words = parts.select(key, "pos", F.explode("tokens").alias("token"))
    own = sources.select(key, "source_text").withColumn("source", F.monotonically_increasing_id())
    own = own.select(key, "source", F.explode(grounding_tokens(F.col("source_text"))).alias("token"))
    shared = words.join(own, [key, "token"]).groupBy(key, "pos", "source").agg(F.count(F.lit(1)).alias("n"))
    most = shared.groupBy(key, "pos").agg(F.max("n").alias("shared"))
    size = F.size("tokens")
    judged = parts.join(most, [key, "pos"], "left").select(key, ((size == 0) | (F.coalesce("shared", F.lit(0)) >= threshold * size)).alias("grounded"))
    sums = judged.groupBy(key).agg(F.count(F.lit(1)).alias("n_sentences"), F.count_if("grounded").alias("n_grounded"))
    rate = F.when(F.coalesce("n_sentences", F.lit(0)) == 0, F.lit(1.0)).otherwise(F.col("n_grounded") / F.col("n_sentences"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return answers.select(key).join(sums, key, "left").select(key, zero("n_sentences"), zero("n_grounded"), F.round(rate, 9).alias("faithfulness"))


def ungrounded_sentences(answers: DataFrame, sources: DataFrame, key: str, threshold: float = 0.4) -> DataFrame:
    """The sentences that no source grounds: key, pos, sentence."""
    parts = answers.select(key, F.posexplode(sentences(F.col("text"))).alias("pos", "sentence")).withColumn("tokens", grounding_tokens(F.col("sentence")))
    words = parts.select(key, "pos", F.explode("tokens").alias("token"))
    own = sources.select(key, "source_text").withColumn("source", F.monotonically_increasing_id())
    own = own.select(key, "source", F.explode(grounding_tokens(F.col("source_text"))).alias("token"))
    most = words.join(own, [key, "token"]).groupBy(key, "pos", "source").count().groupBy(key, "pos").agg(F.max("count").alias("shared"))
    size = F.size("tokens")
    failed = (size > 0) & (F.coalesce("shared", F.lit(0)) < threshold * size)
    return parts.join(most, [key, "pos"], "left").where(failed).select(key, "pos", "sentence")


def rating_means(ratings: DataFrame, dimensions: list[str], annotator: str = "annotator_id") -> DataFrame:
    """Means of ratings given as text, per dimension and per annotator and dimension; what is no number is skipped."""
    long = ratings.select(annotator, *dimensions).unpivot([annotator], dimensions, "dimension", "value")
    parsed = long.withColumn("value", F.expr("try_cast(trim(value) AS double)")).where(F.col("value").isNotNull())
    both = parsed.withColumn("scope", F.explode(F.array(F.lit("all"), F.lit("annotator"))))
    who = F.when(F.col("scope") == "annotator", F.coalesce(annotator, F.lit("unknown")))
    return both.groupBy("dimension", "scope", who.alias("annotator")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 2).alias("mean"))


def citation_ground_truth(cited: DataFrame, corpus: DataFrame, min_relevant: int = 2, max_cases: int | None = None) -> DataFrame:
    """query_case_id and relevant_case_ids from (case_id, cited_case_id): cases in the corpus, not the case itself."""
    known = corpus.select(F.col("case_id").alias("cited_case_id")).distinct()
    kept = cited.where(F.col("case_id") != F.col("cited_case_id")).select("case_id", "cited_case_id").distinct().join(known, "cited_case_id", "left_semi")
    grouped = kept.groupBy("case_id").agg(F.array_sort(F.collect_list("cited_case_id")).alias("relevant_case_ids"))
    found = grouped.where(F.size("relevant_case_ids") >= min_relevant).withColumnRenamed("case_id", "query_case_id")
    return found if max_cases is None else found.orderBy("query_case_id").limit(max_cases)


def merge_test_sets(sets: list[DataFrame]) -> DataFrame:
    """Test sets merged by case: the first set's text, the union of relevant cases in order."""
    tagged = [s.select("query_case_id", "query_text", "relevant_case_ids", F.lit(i).alias("place")) for i, s in enumerate(sets)]
    rows = tagged[0]
    for t in tagged[1:]:
        rows = rows.unionByName(t)
    return rows.groupBy("query_case_id").agg(
        F.min_by("query_text", "place").alias("query_text"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("relevant_case_ids")))).alias("relevant_case_ids"),
    )


def split_by_year(rows: DataFrame, id_col: str, cutoff: int = 2020) -> DataFrame:
    """``split``: test where the first run of four digits in the id reaches the cutoff, else train."""
    year = F.expr(f"try_cast(regexp_extract({id_col}, '([0-9]{{4}})', 1) AS int)")
    return rows.withColumn("split", F.when(F.coalesce(year, F.lit(0)) >= cutoff, "test").otherwise("train"))


def batch_summary(cases: DataFrame) -> DataFrame:
    """Means over cases of dispositive_accuracy, other_accuracy and rho (nulls left out), and the accept rate of their judges.

    The rate is accepted over all decisions (columns accepted and rejected), 0 without any.
    """
    decided = F.sum("accepted") + F.sum("rejected")
    return cases.agg(
        F.count(F.lit(1)).alias("n_cases"),
        F.round(F.sum("dispositive_accuracy") / F.greatest(F.count(F.lit(1)), F.lit(1)), 4).alias("dispositive_accuracy"),
        F.round(F.sum("other_accuracy") / F.greatest(F.count(F.lit(1)), F.lit(1)), 4).alias("other_accuracy"),
        F.round(F.avg("rho"), 4).alias("mean_rho"),
        F.round(F.coalesce(F.sum("accepted") / F.nullif(decided, F.lit(0)), F.lit(0.0)), 4).alias("accept_rate"),
    )


def merged_reports(reports: dict[str, DataFrame | None]) -> DataFrame | None:
    """Small reports under one schema with the name of each; missing ones (None) are left out."""
    out = None
    for name, report in reports.items():
        if report is not None:
            part = report.withColumn("report", F.lit(name))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
