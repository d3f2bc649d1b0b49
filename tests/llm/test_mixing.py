import hashlib
from collections import Counter

import pytest

from plumbline.llm import mixing


def rows_of(n=300):
    out = []
    for i in range(n):
        source = ["a", "b", "c", "d", None][i % 7 % 5]
        out.append((i, "w " * (i * 37 % 23), source))
    return out


def targets_by_hand(sizes, share=1.5):
    """Water filling step by step: whoever would pass twice its size stops there."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, open_, target = share * sum(sizes.values()), set(sizes), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * sizes[s] <= level * weight[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = 2 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def taken_by_hand(rows, share=1.5):
    """How often each id is taken: queues served twice in the order of the MD5 of the id, cut at the budget."""
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    target = targets_by_hand(sizes, share)
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    events = []
    for s in order:
        served = 0
        for turn in (0, 1):
            for h, i, n in sorted((hashlib.md5(str(i).encode()).hexdigest(), i, len((t or "").split())) for i, t, x in rows if x == s):
                served += n
                if n:
                    events.append((served / target[s], order.index(s), turn, h, i, n))
    taken, spent = Counter(), 0
    for *_, i, n in sorted(events):
        if spent >= share * sum(sizes.values()):
            break
        taken[i] += 1
        spent += n
    return taken


def check(rows, got):
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = targets_by_hand(sizes)
    source = {i: s for i, _, s in rows}
    taken, longest = Counter(), Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s]
        assert r["target"] == pytest.approx(want[s])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
        longest[s] = max(longest[s], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * longest[s] + 1


def test_targets_and_shares(documents):
    rows = rows_of()
    docs = documents(rows, "size target taken id slice")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    check(rows, got)
    assert {r["doc_id"]: r["taken"] // r["size"] for r in got if r["taken"]} == dict(taken_by_hand(rows))
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))


def test_one_hot_source(documents):
    rows = [(i, "w " * (1 + i % 9), "hot" if i % 3 else f"s{i % 50}") for i in range(400)]
    check(rows, mixing.mix(documents(rows)).collect())


def test_nulls_empty_texts_repeats_and_no_rows(documents):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n", None), (None, "x y", "b"), (4, "x y z", "b"), (4, "x y z", "b")]
    got = mixing.mix(documents(rows)).collect()
    assert len(got) == 6 and sum(r["taken"] for r in got) >= 8
    assert all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert mixing.mix(documents([])).count() == 0
    assert mixing.mix(documents([(1, None, None)])).collect()[0]["taken"] == 0


def test_rows_as_taken(documents):
    rows = rows_of(100) + [(5, "w " * (5 * 37 % 23), "a")]
    docs = documents(rows, "_doc taken size")
    plan = Counter()
    for r in mixing.mix(docs).collect():
        if r["size"]:
            plan[r["doc_id"]] += r["taken"] // r["size"]
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == +plan
