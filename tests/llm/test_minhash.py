import random
import re

import pytest

from plumbline.llm import minhash
from plumbline.llm.components import connected_components


def brute(rows, size, percent):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    least = {i: i for i in sets}
    ids = sorted(sets)

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                least[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), root(i), i == root(i)) for i in ids)


def near_copies(seed, n=160, words=120, edits=12):
    rnd = random.Random(seed)
    base = [f"w{rnd.randrange(4000)}" for _ in range(words)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rnd.randrange(edits)):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(9999)}"
        rows.append(" ".join(w))
    return rows


@pytest.mark.parametrize(("size", "percent"), [(2, 80), (5, 80)])
def test_against_brute_force(documents, size, percent):
    rnd = random.Random(1)
    texts = [*near_copies(1), *near_copies(2, 20, 30, 4), *(" ".join(f"r{rnd.randrange(50)}" for _ in range(rnd.randrange(40))) for _ in range(60))]
    texts += [None, "", "  \n", "One", "one", "ONE two", "one TWO", "É", "é", "x y " * 3000]
    texts += texts[:30]
    rows = [(i * 3 % 1009, t) for i, t in enumerate(texts)]
    got = minhash.near_duplicates(documents(rows, "kept component_id n_shingles node"), shingle=size, percent=percent)
    assert sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id", "kept").collect()) == brute(rows, size, percent)


def test_small_blocks_change_nothing(documents, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL_BLOCK", 600)
    monkeypatch.setattr(minhash, "FULL_BLOCK", 1500)
    rows = [(i, t) for i, t in enumerate(near_copies(5, 120, 90, 16))]
    got = minhash.near_duplicates(documents(rows))
    assert sorted(tuple(r) for r in got.select("doc_id", "n_shingles", "component_id", "kept").collect()) == brute(rows, 2, 80)


def test_repeated_rows_nulls_and_no_rows(documents):
    rows = [(4, "a b c"), (4, "a b c"), (None, "a b c"), (None, "q r s"), (7, None)]
    got = sorted((tuple(r) for r in minhash.near_duplicates(documents(rows)).select("doc_id", "component_id", "kept").collect()), key=str)
    assert got == sorted([(4, 4, True), (4, 4, True), (None, 4, False), (None, None, True), (7, 7, True)], key=str)
    assert minhash.near_duplicates(documents([])).count() == 0


def test_pipeline_stage_keeps_one(documents):
    rows = [(i, t) for i, t in enumerate(near_copies(9, 30, 200, 2))] + [(100, "clean text of its own")]
    kept = minhash.without_near_copies(documents(rows, "kept _gone"))
    assert kept.columns == documents(rows, "kept _gone").columns
    want = [i for i, _, _, k in brute(rows, 2, 80) if k]
    assert sorted(r["doc_id"] for r in kept.collect()) == want


def test_pipeline_stage_goes_by_rows(documents):
    def kept(rows):
        return sorted(((r["doc_id"], r["text"]) for r in minhash.without_near_copies(documents(rows)).collect()), key=str)

    own = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcd"]
    near = own[0] + " tail"
    # Null ids: copies of a named text go, unrelated texts stay, and of equal ones one stays.
    assert kept([(4, own[0]), (None, own[0]), (None, near), (None, own[1]), (None, own[2]), (None, own[2])]) == sorted([(4, own[0]), (None, own[1]), (None, own[2])], key=str)
    # One id with two texts, of which one is a near copy of another document.
    assert kept([(1, own[0]), (2, near), (2, own[1]), (3, own[1] + " tail"), (0, own[3])]) == sorted([(0, own[3]), (1, own[0]), (2, own[1])], key=str)
    # Repeated rows and near copies under one id, and the smallest id not in the first row.
    assert kept([(7, own[1]), (5, own[1]), (5, own[1]), (6, own[2]), (6, own[2]), (8, None), (8, None)]) == sorted([(5, own[1]), (6, own[2]), (8, None), (8, None)], key=str)
    assert len(kept([(9, own[3]), (9, own[3] + " tail")])) == 1
    assert kept([]) == []


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(100, 200)] + [(5, x) for x in range(6, 40)] + [(7, 7), (1, 2), (2, 1), (2, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 201)}, **{i: 5 for i in range(5, 40)}, 1: 1, 2: 1, 3: 1}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
