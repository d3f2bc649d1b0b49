import hashlib
import random

from plumbline.llm import exact


def by_id(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(exact.normalised(t), []).append(i)
    out = []
    for t, ids in groups.items():
        least = min(ids, key=lambda i: (i is not None, i or 0))
        first = True
        for i in sorted(ids, key=lambda i: (i is not None, i or 0)):
            out.append((i, least, len(ids), i == least and first, hashlib.sha256(t).hexdigest()))
            first = False
    return sorted(out, key=str)


def normalised_groups(rows):
    """Ids that stay: the least of each group of equal texts."""
    least = {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        least.setdefault(exact.normalised(t), i)
    return set(least.values())


ROWS = [
    (5, "a  b"), (2, "a b"), (9, "a\t\nb"), (3, " a b"), (4, "a b "), (1, None), (7, ""), (8, " "), (10, "\n\t"),
    (11, "x" * 70000 + " tail"), (12, "x" * 70000 + "  tail"), (13, "x" * 70000 + " tail!"), (2, "a b"), (None, "z"), (14, "z"), (15, "été "), (16, "été "),
]


def test_against_brute_force(documents):
    assert by_id(exact.mark_copies(documents(ROWS, "kept keep_id _row _fp_a"))) == brute(ROWS)


def test_empty_table(documents):
    assert exact.mark_copies(documents([])).count() == 0
    assert exact.without_copies(documents([])).count() == 0


def test_colliding_fingerprints_are_told_apart(spark, documents, monkeypatch):
    import pyspark.sql.functions as F

    docs = documents(ROWS)
    rows = docs.select("doc_id", "text").withColumn("_row", F.monotonically_increasing_id())
    # One weak fingerprint for all texts of one length.
    weak = lambda df, text_col="text", *a, **k: real(df, text_col).withColumn("_fp_a", F.lit(0).cast("long")).withColumn("_fp_b", F.lit(0).cast("long"))
    real = exact.with_fingerprints
    monkeypatch.setattr(exact, "with_fingerprints", weak)
    del rows
    assert by_id(exact.mark_copies(docs)) == brute(ROWS)


def test_fingerprints_combine():
    rnd = random.Random(3)
    text = rnd.randbytes(20_000)
    whole = [int(x[0]) for x in exact.fingerprints([text])]
    for at in (1, 4096, 7777):
        left, right = exact.fingerprints([text[:at]]), exact.fingerprints([text[at:]])
        joined = [exact.combine(int(a[0]), at, int(b[0]), base, p) for a, b, base, p in zip(left, right, exact.BASES, exact.PRIMES)]
        assert joined == whole
    direct = [sum(c * pow(b, i, p) for i, c in enumerate(text)) % p for b, p in zip(exact.BASES, exact.PRIMES)]
    assert direct == whole


def test_one_row_of_each_group_stays(documents):
    docs = documents(ROWS, "kept _row _fp_a _fp_b _fp_bytes _fp_sha256 c0 n")
    kept = exact.without_copies(docs)
    assert kept.columns == docs.columns
    assert {(r["_row"], r["_fp_a"], r["_fp_sha256"], r["c0"]) for r in kept.collect()} == {("x", "x", "x", "x")}
    assert kept.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and "kept" in kept.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert ids == sorted([i for i, _, _, k, _ in brute(ROWS) if k], key=str)


def test_two_equal_texts_of_sixteen_megabytes(spark):
    """Each text is cut into chunks once, so the comparison is linear in its size."""
    import time

    docs = spark.range(3).selectExpr("id AS doc_id", "concat(repeat('some words of it  ', 1000000), IF(id = 2, 'x', 'y')) AS text")
    began = time.perf_counter()
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact.mark_copies(docs).collect()}
    assert got == {0: (0, 2), 1: (0, 2), 2: (2, 1)} and time.perf_counter() - began < 60
