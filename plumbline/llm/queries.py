"""The operators as queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import alignment, bpe, chat, exact, html, minhash, mixing, pieces, pii, quality, resampling, substring, toxicity
from plumbline.session import table

#: The vocabulary file; another one may be given to ``op3_bpe``.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: The model file of pieces; another one may be given to ``op11_sentencepiece``.
PIECES = public_tokenizers.path("piece_bpe_32k.model")
#: The byte-level vocabulary that is aligned with the pieces.
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: The key of the pseudonyms; whoever runs this for real gives their own.
PSEUDONYM_KEY = "an example key, not a secret"
#: Text of the extra conversation -7, full of control strings.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_bpe(spark: SparkSession, sf_dir: str, ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), ranks, pattern)


def op4_pii(spark: SparkSession, sf_dir: str, key: str = PSEUDONYM_KEY) -> DataFrame:
    return pii.pseudonymised(table(spark, sf_dir, "documents"), key)


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"), texts=False)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    back = chat.read_back(chat.format_conversations(turns.unionByName(extra)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("conv").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.mark_copies(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str, model: str = PIECES) -> DataFrame:
    return pieces.piece_digests(table(spark, sf_dir, "documents"), model)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_alignment(spark: SparkSession, sf_dir: str, vocabulary: str = BYTE_VOCABULARY, model: str = PIECES, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    return alignment.alignment_digests(table(spark, sf_dir, "documents"), vocabulary, model, pattern)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_toxicity": op2_toxicity,
    "op3_bpe": op3_bpe,
    "op4_pii": op4_pii,
    "op5_substring": op5_substring,
    "op6_mixing": op6_mixing,
    "op7_chat": op7_chat,
    "op8_html": op8_html,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_quality": op10_quality,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_resampling": op12_resampling,
    "op13_alignment": op13_alignment,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_RUNS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op1_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w WHERE len(w) >= 2)
  UNION ALL SELECT doc_id, w[1] FROM w WHERE len(w) = 1),
n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (
  SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)),
edge AS (
  SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM reach r JOIN edge e ON r.y = e.x),
comp AS (
  SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN comp ON comp.x = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
""",
    "op5_substring": rf"""
WITH d AS (
  SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (
  SELECT doc_id, i, sha256(array_to_string(w[i : i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM win) WHERE n > 1),
word AS (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS t FROM d),
marked AS (
  SELECT word.doc_id, word.i, word.t, max(rep.i) OVER (PARTITION BY word.doc_id ORDER BY word.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM word LEFT JOIN rep ON rep.doc_id = word.doc_id AND rep.i = word.i),
per AS (
  SELECT doc_id, CAST(count(*) AS BIGINT) AS n_words, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_removed,
    sha256(coalesce(string_agg(CASE WHEN NOT gone THEN t END, ' ' ORDER BY i), '')) AS kept_sha256 FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM d LEFT JOIN per ON per.doc_id = d.doc_id
""",
    "op6_mixing": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, coalesce(md5(CAST(doc_id AS VARCHAR)), '') AS shuffle FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rk FROM d GROUP BY source),
weighed AS (
  SELECT *, CAST(CASE (rk - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS w FROM per),
filled AS (
  SELECT *, CAST(sum(source_size) OVER () AS BIGINT) * CAST(1.5 AS DOUBLE) AS budget,
    CAST(coalesce(sum(source_size * 2) OVER (ORDER BY source_size / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS capped,
    sum(w) OVER (ORDER BY source_size / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left,
    row_number() OVER (ORDER BY source_size / w, rk) AS pos
  FROM weighed),
leveled AS (
  SELECT *, (budget - capped) / w_left AS lvl, source_size * 2 <= (budget - capped) / w_left * w AS is_capped FROM filled),
stop AS (
  SELECT min(pos) AS pos FROM leveled WHERE NOT is_capped),
target AS (
  SELECT l.source, l.rk, l.source_size, l.budget,
    CASE WHEN s.pos IS NULL OR l.pos < s.pos THEN CAST(l.source_size * 2 AS DOUBLE) ELSE (SELECT x.lvl FROM leveled x, stop y WHERE x.pos = y.pos) * l.w END AS target
  FROM leveled l CROSS JOIN stop s),
served AS (
  SELECT d.doc_id, d.size, d.shuffle, t.rk, t.source_size, t.target, t.budget,
    CAST(sum(d.size) OVER (PARTITION BY t.rk ORDER BY d.shuffle, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS served
  FROM d JOIN target t ON d.source IS NOT DISTINCT FROM t.source),
event AS (
  SELECT s.*, turn, (turn * source_size + served) / target AS finish FROM served s CROSS JOIN (VALUES (0), (1)) v(turn) WHERE size > 0 AND target > 0),
ahead AS (
  SELECT *, coalesce(sum(size) OVER (ORDER BY finish, rk, turn, shuffle, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM event),
won AS (
  SELECT doc_id, shuffle, CAST(sum(size) AS BIGINT) AS taken FROM ahead WHERE ahead < budget GROUP BY doc_id, shuffle)
SELECT s.doc_id, s.size, s.source_size, s.target, coalesce(w.taken, 0) AS taken FROM served s LEFT JOIN won w ON w.doc_id = s.doc_id
""",
    "op7_chat": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT CAST(-7 AS BIGINT), CAST(0 AS BIGINT), 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT CAST(-7 AS BIGINT), CAST(1 AS BIGINT), 'assistant', '\### Assistant: </turn> ok'),
conv AS (
  SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
    CAST(sum(6 + length(role) + 1 + length(text) + 8 + length(role || text) - length(replace(replace(role || text, '\', ''), '<', '')) + length(role) - length(replace(role, chr(10), ''))) AS BIGINT) AS formatted_chars
  FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM conv
""",
    "op9_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (
  SELECT t, min(doc_id) AS keep_id, CAST(count(*) AS BIGINT) AS group_size, sha256(t) AS text_sha256 FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, g.text_sha256 FROM n JOIN g ON n.t = g.t
""",
    "op10_quality": rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
win AS (
  SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
dup AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM dup CROSS JOIN (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
f AS (
  SELECT d.doc_id, d.source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN lines l ON l.doc_id = d.doc_id LEFT JOIN covered c ON c.doc_id = d.doc_id),
b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
h AS (
  SELECT source, count(*) AS n, sum(CASE WHEN base_failed OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines THEN 1 ELSE 0 END) AS bad FROM b GROUP BY source),
p AS (
  SELECT sum(bad) / sum(n) AS m, round(coalesce(var_pop(bad / n), 0.0), 12) AS v FROM h),
s AS (
  SELECT m, CASE WHEN v <= 0 THEN 1e6 ELSE greatest(1.0, least(1e6, m * (1 - m) / v - 1)) END AS k FROM p),
r AS (
  SELECT source, round((bad + m * k) / (n + k), 9) AS host_rate FROM h CROSS JOIN s)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rate, NOT base_failed AND host_rate <= 0.5 AS kept
FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.source
""",
    "op12_resampling": rf"""
WITH crc(t) AS (  -- the remainders of one hexadecimal digit
  SELECT list_transform(range(0, 16), lambda i: list_reduce([i, 0, 0, 0, 0], lambda c, k: xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END)))),
d AS (
  SELECT row_number() OVER () AS row, 1 AS own, doc_id, {_RUNS} AS w FROM documents UNION ALL SELECT row_number() OVER (), 0, NULL, {_RUNS} FROM benchmark),
f AS (
  SELECT row, own, unnest(w) AS g FROM d
  UNION ALL SELECT row, own, w[i] || ' ' || w[i + 1] FROM (SELECT row, own, w, unnest(range(1, len(w))) AS i FROM d WHERE len(w) > 1)),
hexed AS (
  SELECT g, hex(encode(g)) AS x FROM (SELECT DISTINCT g FROM f)),
hashed AS (
  SELECT g, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(x)), lambda i: strpos('0123456789ABCDEF', substr(x, i + 2 * (1 - i % 2), 1)) - 1)),
    lambda c, v: xor(c >> 4, t[(xor(c, v) & 15) + 1])), 4294967295) % 10000 AS bucket FROM hexed CROSS JOIN crc),
b AS (
  SELECT row, own, bucket FROM f JOIN hashed USING (g)),
n AS (
  SELECT bucket, count(*) FILTER (WHERE own = 1) AS s, count(*) FILTER (WHERE own = 0) AS t FROM b GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE))) AS gain FROM n),
per AS (
  SELECT row, count(*) AS n_features, sum(gain) AS gains FROM b JOIN gain USING (bucket) WHERE own = 1 GROUP BY row),
scored AS (
  SELECT d.row, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, CAST(coalesce(floor(gains / n_features), 0) AS BIGINT) AS weight,
    CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM d LEFT JOIN per ON per.row = d.row WHERE own = 1),
final AS (
  SELECT *, CAST(weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM scored),
ranked AS (
  SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id, n_features, weight) END AS place FROM final)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score,
  CAST(CASE WHEN place <= 25 * (SELECT count(*) FROM scored WHERE n_words >= 20) // 100 THEN place END AS BIGINT) AS rank FROM ranked
""",
}
