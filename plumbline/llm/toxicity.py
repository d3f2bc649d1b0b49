"""Toxicity by a weighted finite-state pattern grammar.

A text is a sequence of words and clause ends. The tagger maps each to a symbol: insult, threat, target, negation,
reported speech, clause end or other; insults carry a weight from a learned lexicon of words and word beginnings. Three
transducers, each a table of arcs (state, symbol) to (state, symbol), rewrite the symbols: the negation transducer counts
down its reach after a negation and marks insults and threats as negated, the report transducer does so for reported
speech, and the target transducer remembers a target up to the clause end and marks that end. They are composed into one
machine, which a text is read by once. Its output is weighted by context: what an insult weighs goes to plain, targeted,
negated or reported, and a threat counts once its clause has a target. A clause's match is what was written in it, and
documents are scored on matched clauses: sums by context, the best clause and the density, in a logistic model.

Learning (from labelled rows whose crc32(id) mod 5 is not 0, at most ``bound`` of them by the hash of their id, equal
texts once): words and beginnings are counted per text on both sides in Spark, and those whose log odds are above log 3
by two standard errors become the lexicon, however many there are. The model's weights are fitted by iterated least
squares on the sample's features, drawn towards fixed prior weights. Without labels of both kinds the fixed seed words
and the prior weights are used.

Cases: a null or empty text has no clause and gets the score of the bias alone; a null id is scored like any other (its
remainder is that of the empty string); repeated rows are scored each; labels of unknown documents are ignored;
contradicting labels of one document count as toxic; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.lookup import rows_with_ids
from plumbline.session import cut, python_ready, release, staged

#: Seed words of the transducers, by symbol.
INSULTS = "idiot idiots moron morons stupid scum trash loser losers pathetic worthless disgusting clown imbecile filth vermin dumb"
THREATS = "kill hurt destroy murder beat stab shoot burn attack töten umbringen tuer frapper matar golpear"
TARGETS = "you your yours u they them their he him his she her du dich dir dein ihr euch vous tu toi ton votre usted tú te ellos él"
NEGATIONS = "not no never none nobody isn't aren't don't nicht kein keine nie pas jamais ne nunca jamás"
REPORTS = "said says say told quote quoted reported claims claimed allegedly wrote sagte sagt dit disait dijo dice"

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END, NEGATED_INSULT, NEGATED_THREAT, REPORTED_INSULT, TARGETED_END = range(11)
NOTHING = (OTHER, 0.0)
#: Words that a worker keeps with their symbols, and patterns that it counts before it hands them on.
REMEMBERED, COUNTED = 150_000, 200_000
#: A negation or report reaches this many words.
REACH = 6

TOKENS = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[.!?;:\n]")
PREFIXES = range(3, 9)
#: Features: sums of weights by context, threats, best clause, density, matched clauses.
FEATURES = ("plain", "targeted", "negated", "reported", "threats", "best", "density", "clauses")
PRIOR = np.array([-4.0, 1.0, 1.2, 0.2, 0.3, 1.5, 0.8, 1.0, 0.3])


def forms(word: str) -> Iterator[str]:
    """Patterns that match a word: itself and its beginnings (marked)."""
    yield word
    for k in PREFIXES:
        if k >= len(word):
            break
        yield word[:k] + "*"


#: A transducer: for every state a row of (next state, output) by symbol. State 0 is the initial one.
Transducer = list[list[tuple[int, int]]]


def within_reach(trigger: int, marked: dict[int, int], reach: int = REACH) -> Transducer:
    """Marks symbols up to ``reach`` places after a trigger, not beyond the clause end; the state is what is left of the reach."""

    def arc(left: int, symbol: int) -> tuple[int, int]:
        after = reach if symbol == trigger else 0 if symbol in (END, TARGETED_END) else max(0, left - 1)
        return after, marked.get(symbol, symbol) if left else symbol

    return [[arc(left, symbol) for symbol in range(TARGETED_END + 1)] for left in range(reach + 1)]


def remembered(trigger: int) -> Transducer:
    """Marks the clause end if the trigger came before it."""
    return [[(0, (END, TARGETED_END)[seen]) if symbol == END else (int(seen or symbol == trigger), symbol) for symbol in range(TARGETED_END + 1)] for seen in range(2)]


def composed(first: Transducer, second: Transducer) -> Transducer:
    """One machine that does what the second does to the output of the first; its states are the pairs that can be reached."""
    number, pairs, out = {(0, 0): 0}, [(0, 0)], []
    for a, b in pairs:  # grows meanwhile
        row = []
        for symbol in range(TARGETED_END + 1):
            after_a, between = first[a][symbol]
            after_b, written = second[b][between]
            pair = (after_a, after_b)
            if pair not in number:
                number[pair] = len(pairs)
                pairs.append(pair)
            row.append((number[pair], written))
        out.append(row)
    return out


NEGATED = within_reach(NEGATION, {INSULT: NEGATED_INSULT, THREAT: NEGATED_THREAT})
REPORTED = within_reach(REPORT, {INSULT: REPORTED_INSULT, NEGATED_INSULT: REPORTED_INSULT})
TARGETED = remembered(TARGET)
MACHINE = composed(composed(NEGATED, REPORTED), TARGETED)
#: Where the machine's output is written: plain, targeted, negated, reported, threats.
PLACES = {INSULT: 0, NEGATED_INSULT: 2, REPORTED_INSULT: 3, THREAT: 4}


class Tagger(dict):
    """The tagger: word to (symbol, weight), worked out once while it is remembered. Apostrophes may be curly."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon
        self.fixed = {w: (s, 1.0) for s, ws in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in ws.split()}
        self.ends = {c: (END, 0.0) for c in ".!?;:\n"}

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self.ends.get(word) or self.fixed.get(word.replace("’", "'"))
        if not found:
            weight = max((self.lexicon.get(f, 0.0) for f in forms(word)), default=0.0)
            found = (INSULT, weight) if weight > 0 else NOTHING
        self[word] = found
        return found


def clause_matches(symbols: list[tuple[int, float]], machine: Transducer = MACHINE) -> list[list[float]]:
    """Per matched clause: weights written to plain, targeted, negated, reported, and its threats."""
    out: list[list[float]] = []
    state, written = 0, None
    for symbol, weight in (*symbols, (END, 0.0)):
        state, said = machine[state][symbol]
        if said in PLACES:
            written = written or [0.0] * 5
            written[PLACES[said]] += weight
        elif written and said in (END, TARGETED_END):
            if said == TARGETED_END:
                written[0], written[1] = 0.0, written[0]
            else:
                written[4] = 0.0
            if any(written):
                out.append(written)
            written = None
    return out


def features(text: str | None, tagger: Tagger) -> list[float]:
    """The features of a text, logarithms of one plus the figures."""
    words = TOKENS.findall((text or "").lower())
    symbols = [tagger[w] for w in words]
    if not any(s in (INSULT, THREAT) for s, _ in symbols):
        return [0.0] * len(FEATURES)
    clauses = clause_matches(symbols)
    if not clauses:
        return [0.0] * len(FEATURES)
    sums = [sum(c[k] for c in clauses) for k in range(5)]
    best = max(c[0] + c[1] + 0.3 * (c[2] + c[3]) for c in clauses)
    density = 1000 * sum(sums[:4]) / (len(words) + 100)
    return [math.log1p(x) for x in (*sums, best, density, len(clauses))]


def score(x: list[float], weights: np.ndarray) -> float:
    z = float(weights[0]) + float(np.dot(weights[1:], x))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(x: np.ndarray, y: np.ndarray, strength: float = 0.5) -> np.ndarray:
    """Logistic weights by iterated least squares, drawn towards the prior weights; the bias is almost free."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = PRIOR.copy()
    pull = np.full(len(w), strength)
    pull[0] = 0.01
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (y - p) - pull * (w - PRIOR)
        hessian = (a * (p * (1 - p))[:, None]).T @ a + np.diag(pull)
        step = np.linalg.solve(hessian, gradient)
        w = w + step * min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-6:
            break
    return w


def held_out(id_column: Column) -> Column:
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))) % 5 == 0


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts per pattern, summed over the task's rows."""
    seen: Counter[str] = Counter()

    def batch_of(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["pattern", "texts"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            words = set(TOKENS.findall((text or "").lower()))
            seen.update({f for w in words for f in forms(w)})
            if len(seen) > COUNTED:  # a large task hands on what it has
                yield batch_of(seen)
                seen.clear()
    if seen:
        yield batch_of(seen)


def _featured(lexicon: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(lexicon)
        for batch in batches:
            rows = [features(t, tagger) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["toxic", "x"])

    return run


def _scored(lexicon: dict[str, float], weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(lexicon)
        for batch in batches:
            values = [score(features(t, tagger), weights) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], ["id", "score"])

    return run


def telling(counts: DataFrame, n_toxic: int, n_clean: int, z: float = 2.0) -> DataFrame:
    """Patterns (pattern, toxic, clean: texts that have it) with log odds above log 3 by ``z`` standard errors, and the log odds (6 at most)."""
    t, c = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(t / (n_toxic + 1)) - F.log(c / (n_clean + 1))
    return counts.where(odds - z * F.sqrt(1 / t + 1 / c) > math.log(3)).withColumn("weight", F.least(F.lit(6.0), odds))


def without_narrow(found: DataFrame, toxic: DataFrame) -> DataFrame:
    """``found`` without beginnings that one word, or one longer beginning, accounts for almost alone."""
    begins = F.col("pattern").endswith("*")
    stems = toxic.select(F.rtrim("pattern", F.lit("*")).alias("stem"), begins.alias("begins"), F.col("toxic").alias("n"))
    sizes = F.sequence(F.lit(PREFIXES.start), F.least(F.length("stem") - F.col("begins").cast("int"), F.lit(PREFIXES.stop - 1)))
    spread = stems.where(F.length("stem") - F.col("begins").cast("int") >= PREFIXES.start).select("begins", "n", F.col("stem"), F.explode(sizes).alias("k"))
    within = spread.groupBy(F.concat(F.substring("stem", F.lit(1), F.col("k")), F.lit("*")).alias("beginning"))
    most = within.agg(F.max(F.when(~F.col("begins"), F.col("n"))).alias("word"), F.max(F.when(F.col("begins"), F.col("n"))).alias("longer"))
    joined = found.join(most, F.col("pattern") == F.col("beginning"), "left")
    wide = (F.col("toxic") > 1.5 * F.coalesce("word", F.lit(0))) & (F.col("toxic") > 1.05 * F.coalesce("longer", F.lit(0)))
    return joined.where(~begins | wide).select(found.columns)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = 30_000) -> tuple[dict[str, float], np.ndarray]:
    """The lexicon and the model's weights from at most ``bound`` labelled rows that are not held out."""
    python_ready(docs.sparkSession)
    lexicon = {w: 2.0 for w in INSULTS.split()}
    own = labels.select(F.col(id_col).alias("_id"), F.col("toxic").cast("int").alias("_toxic")).where(F.col("_id").isNotNull() & F.col("_toxic").isNotNull())
    own = own.where(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_toxic").alias("_toxic"))
    total = own.count()
    if total > bound:  # about ``bound`` rows by the hash of the id, then exactly
        own = own.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < math.ceil(1.1 * bound / total * 1_000_000)).orderBy(F.xxhash64("_id")).limit(bound)
    own = cut(own)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    sample = rows_with_ids(texts, own.select("_id"), "_id", "_id").join(own, "_id")
    # Equal texts once: copies would make all their words telling.
    sample = cut(sample.select("_toxic", F.coalesce("_text", F.lit("")).alias("_text")).dropDuplicates(["_toxic", "_text"]))
    n = {r["_toxic"]: r["count"] for r in sample.groupBy("_toxic").count().collect()}
    if not n.get(1) or not n.get(0):
        return lexicon, PRIOR

    def counted(toxic: int, name: str) -> DataFrame:
        rows = sample.where(F.col("_toxic") == toxic).select("_text").mapInArrow(_counted, "pattern string, texts long")
        return rows.groupBy("pattern").agg(F.sum("texts").alias(name))

    # A pattern in fewer than three toxic texts cannot pass whatever the clean ones hold.
    toxic = staged(counted(1, "toxic").where("toxic >= 3"))
    clean = staged(counted(0, "clean").where("clean > 0"))
    counts = staged(toxic.join(clean, "pattern", "left").select("pattern", "toxic", F.coalesce("clean", F.lit(0)).alias("clean")))
    lexicon |= {r["pattern"]: r["weight"] for r in without_narrow(telling(counts, n[1], n[0]), toxic).select("pattern", "weight").collect()}
    # Seeds that the labels speak against go.
    seeds = clean.where(F.col("pattern").isin(INSULTS.split()) & (F.col("clean") > 20)).join(toxic, "pattern", "left")
    seeds = seeds.select("pattern", F.coalesce("toxic", F.lit(0)).alias("toxic"), "clean")
    for r in seeds.join(telling(seeds, n[1], n[0], 0.0).select("pattern"), "pattern", "left_anti").collect():
        lexicon.pop(r["pattern"], None)
    release(toxic, clean, counts)
    rows = sample.mapInArrow(_featured(lexicon), "toxic int, x array<double>").toPandas()
    x = np.array(rows["x"].tolist(), float)
    return lexicon, fit(x, rows["toxic"].to_numpy(float))


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Per row: id, held_out, score and predicted."""
    lexicon, weights = learn(docs, labels, id_col, text_col, **how)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(_scored(lexicon, weights), f"id {rows.schema['id'].dataType.simpleString()}, score double")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", **how) -> DataFrame:
    """``docs`` without the rows that are predicted toxic; every row passes through with all its columns."""
    lexicon, weights = learn(docs, labels, id_col, text_col, **how)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(lexicon)
        for batch in batches:
            yield batch.filter(pa.array([score(features(t, tagger), weights) < 0.5 for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
