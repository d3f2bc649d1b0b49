"""Host-level quality rules.

Every document gets its rule figures from built-in functions; rule failures are summed per host (here: the source
column) before the shuffle, a beta prior is fitted to all host rates by moments, each host's rate is shrunk towards it,
and the host verdicts are joined back to the documents.

Cases: a null text has no words and fails the base rule; a null host is a host of its own; repeated rows each count and
each return a row; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.words import SPACES, word_count, word_list
from plumbline.session import cut, staged

SYMBOLS = "#*$%&|<>"


#: The base rule, and what else counts as a failure in a host's rate.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINE_PERCENT = 30


def window_hashes(words: Column) -> Column:
    """64-bit hashes of all windows of three words."""
    n = F.greatest(F.size(words) - 2, F.lit(0))
    windows = F.arrays_zip(F.slice(words, 1, n), F.slice(words, 2, n), F.slice(words, 3, n))
    return F.transform(windows, lambda t: F.xxhash64(t["0"], t["1"], t["2"]))


def repeated_places(hashes: Column) -> Column:
    """Places of the windows whose hash occurs twice or more, in order: sorted, each is compared with its neighbours."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    n = F.size(hashes)
    before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(placed, 1, n - 1))
    after = F.slice(placed, 2, n)
    repeated = F.filter(F.arrays_zip(placed, before, after), lambda x: x["0"]["h"].eqNullSafe(x["1"]["h"]) | x["0"]["h"].eqNullSafe(x["2"]["h"]))
    return F.sort_array(F.transform(repeated, lambda x: x["0"]["i"]))


def covered(places: Column) -> Column:
    """Words that windows of three at these places cover: three each, less what the next one covers as well."""
    pairs = F.arrays_zip(places.alias("p"), F.slice(places, 2, F.greatest(F.size(places), F.lit(1))).alias("q"))
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda s, x: s + F.least(F.lit(3), F.coalesce(x["q"] - x["p"], F.lit(3))))


def document_figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per row: id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    words = split.select(
        "id",
        "host",
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0).alias("lines"),
        word_list(F.col("text")).alias("words"),
    )
    hashed = words.select(
        "id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        window_hashes(F.col("words")).alias("hashes"),
    )
    places = hashed.withColumn(
        "places",
        F.when(F.size("hashes") == F.size(F.array_distinct("hashes")), F.array().cast("array<int>")).otherwise(repeated_places(F.col("hashes"))),
    )
    return places.select("id", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", covered(F.col("places")).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def rule_failures() -> Column:
    """How many of the three rules (base, symbols, repeated lines) a document fails."""
    symbols = 100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("word_chars")
    lines = 100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("n_lines")
    return base_failed().cast("int") + symbols.cast("int") + lines.cast("int")


def host_verdicts(figures: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per host: n_host, n_failed, host_rate (shrunk), host_ok.

    The prior beta(a, b) has the mean of all documents and the strength that the spread of the host rates gives by
    moments (between 1 and 1e6); the shrunk rate is (failed + a) / (n + a + b). A host is bad above ``threshold``.
    """
    failed = (F.col("failures") > 0).cast("long")
    hosts = figures.withColumn("failures", rule_failures()).groupBy("host").agg(F.count(F.lit(1)).alias("n_host"), F.sum(failed).alias("n_failed"))
    rate = F.col("n_failed") / F.col("n_host")
    hosts = cut(hosts)
    # The prior is one row, whatever the number of hosts.
    found = hosts.agg((F.sum("n_failed") / F.sum("n_host")).alias("mean"), F.round(F.coalesce(F.var_pop(rate), F.lit(0.0)), 12).alias("spread")).first()
    mean, spread = found["mean"] or 0.0, found["spread"] or 0.0
    strength = 1e6 if spread <= 0 else max(1.0, min(1e6, mean * (1 - mean) / spread - 1))
    shrunk = (F.col("n_failed") + F.lit(mean * strength)) / (F.col("n_host") + F.lit(strength))
    rated = hosts.select("host", "n_host", "n_failed", F.round(shrunk, 9).alias("host_rate"))
    return rated.withColumn("host_ok", F.col("host_rate") <= threshold)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", threshold: float = 0.5) -> DataFrame:
    """Per row: id, the figures, base_failed, host_rate and kept (the base rule passed and the host is not bad)."""
    figures = staged(document_figures(docs, id_col, text_col, host_col).withColumn("base_failed", base_failed()))
    verdicts = host_verdicts(figures, threshold)
    f, v = figures.alias("f"), verdicts.alias("v")
    joined = f.join(v, F.col("f.host").eqNullSafe(F.col("v.host")), "left")
    return joined.select(
        F.col("f.id").alias(id_col),
        *[f"f.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")],
        "v.host_rate",
        (~F.col("f.base_failed") & F.col("v.host_ok")).alias("kept"),
    )
