"""The randomised decomposition against numpy's, and neighbours against the exact tf-idf cosine."""

import random

import numpy as np
import pytest

from plumbline.operators import latent


@pytest.fixture(scope="module")
def docs(spark):
    """300 texts of eight topics, with texts that have no terms."""
    rnd = random.Random(2)
    shared = [f"word{i}" for i in range(60)]
    topics = [[f"topic{t}x{i}" for i in range(25)] for t in range(8)]
    rows = [(i, " ".join(rnd.choice(topics[i % 8] if rnd.random() < 0.6 else shared) for _ in range(rnd.randrange(5, 60)))) for i in range(300)]
    return spark.createDataFrame(rows + [(900, None), (901, ""), (902, "of the")], "doc_id long, text string").repartition(5).cache()


def dense(docs, encoder):
    rows = latent.tfidf(docs, encoder.vocabulary, encoder.idf, "doc_id").orderBy("id").collect()
    out = np.zeros((len(rows), len(encoder.vocabulary)))
    for k, r in enumerate(rows):
        out[k, r["places"]] = r["weights"]
    return [r["id"] for r in rows], out


def test_as_numpys_decomposition(docs):
    encoder = latent.fit(docs, "doc_id", rank=12, power_iterations=6)
    _, a = dense(docs, encoder)
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(encoder.values[:8], s[:8], rtol=1e-3)
    assert np.allclose(encoder.values, s[:12], rtol=0.03)
    assert np.allclose(encoder.vectors.T @ encoder.vectors, np.eye(12), atol=1e-8)
    best = a - (a @ vt[:12].T) @ vt[:12]
    ours = a - (a @ encoder.vectors) @ encoder.vectors.T
    assert np.linalg.norm(ours) <= 1.01 * np.linalg.norm(best)


def test_two_power_iterations_are_nearly_as_good(docs):
    encoder = latent.fit(docs, "doc_id", rank=12)
    _, a = dense(docs, encoder)
    s = np.linalg.svd(a, compute_uv=False)
    assert np.linalg.norm(a - (a @ encoder.vectors) @ encoder.vectors.T) <= 1.05 * np.sqrt((s[12:] ** 2).sum())


def test_weights_and_encoded_rows(docs):
    encoder = latent.fit(docs, "doc_id", rank=12)
    ids, a = dense(docs, encoder)
    df = (a > 0).sum(axis=0)
    assert np.allclose(encoder.idf, np.log((303 + 1) / (df + 1)) + 1) and list(df) == sorted(df, reverse=True) and df.min() >= 2
    assert np.allclose(np.linalg.norm(a, axis=1), [0.0 if i >= 900 else 1.0 for i in ids])
    got = {r["id"]: r["vector"] for r in latent.encode(docs, encoder, "doc_id").collect()}
    assert np.allclose([got[i] for i in ids], a @ encoder.vectors)


def test_neighbours_overlap_with_the_exact_cosine(docs):
    """At full rank the neighbours are those of tf-idf; at rank 12 of about 240 terms they are mostly of the same topic."""
    encoder = latent.fit(docs, "doc_id", rank=12)
    ids, a = dense(docs, encoder)
    v = a @ encoder.vectors
    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    exact, ours = a @ a.T, v @ v.T
    np.fill_diagonal(exact, -1)
    np.fill_diagonal(ours, -1)
    shared = [len(set(np.argsort(-exact[i])[:10]) & set(np.argsort(-ours[i])[:10])) / 10 for i in range(300)]
    topic = [np.mean([ids[j] % 8 == ids[i] % 8 for j in np.argsort(-ours[i])[:10]]) for i in range(300)]
    assert np.mean(shared) > 0.35 and np.mean(topic) > 0.9


def test_parts_of_rows_change_nothing(docs, monkeypatch):
    whole = latent.fit(docs, "doc_id", rank=6)
    monkeypatch.setattr(latent, "ENTRIES", 7)
    _, a = dense(docs, whole)
    got = {r["id"]: r["vector"] for r in latent.encode(docs, whole, "doc_id").collect()}
    assert np.allclose(sorted(got[i][0] for i in got), sorted((a @ whole.vectors)[:, 0]))


def test_few_terms_and_empty_tables(spark):
    schema = "doc_id long, text string"
    none = latent.fit(spark.createDataFrame([], schema), "doc_id", rank=4)
    one = spark.createDataFrame([(1, "apple pear"), (2, "apple pear"), (3, None)], schema)
    assert none.vocabulary == [] and all(r["vector"] == [0.0] * 4 for r in latent.encode(one, none, "doc_id").collect())
    low = latent.fit(one, "doc_id", rank=4)
    assert low.vocabulary == ["apple", "pear"] and low.vectors.shape == (2, 4) and np.allclose(low.values, [np.sqrt(2), 0, 0, 0], atol=1e-6)
    got = {r["id"]: r["vector"] for r in latent.encode(one, low, "doc_id").collect()}
    assert np.allclose(np.abs(got[1]), [1, 0, 0, 0]) and got[1] == got[2] and got[3] == [0.0] * 4
    assert latent.encode(spark.createDataFrame([], schema), low, "doc_id").count() == 0


def test_fitted_rows_are_not_read_into_terms_again(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"alpha w{i % 3}x beta w{i % 5}y gamma") for i in range(30)], "doc_id long, text string")
    want = sorted(map(tuple, latent.encode(docs, latent.fit(docs, "doc_id", rank=4), "doc_id").collect()))
    calls, own = [], latent.tfidf
    monkeypatch.setattr(latent, "tfidf", lambda *a, **b: calls.append(1) or own(*a, **b))
    got = sorted(map(tuple, latent.fit_and_encode(docs, "doc_id", rank=4).collect()))
    assert len(calls) == 1 and [x[0] for x in got] == [x[0] for x in want]
    assert all(abs(a - b) < 1e-9 for x, y in zip(got, want) for a, b in zip(x[1], y[1]))
