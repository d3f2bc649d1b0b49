import hashlib
import random

from plumbline.llm import substring


def brute(rows, window):
    places = {}
    words = [(t or "").encode().split() for _, t in rows]
    for k, w in enumerate(words):
        for i in range(len(w) - window + 1):
            places.setdefault(tuple(w[i : i + window]), []).append((k, i))
    gone = [set() for _ in rows]
    for at in places.values():
        if len(at) > 1:
            for k, i in at:
                gone[k].update(range(i, i + window))
    out = []
    for (i, _), w, g in zip(rows, words, gone):
        kept = b" ".join(x for k, x in enumerate(w) if k not in g)
        out.append((i, len(w), len(g), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=str)


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(300)}"
    passages = [[word() for _ in range(n)] for n in (6, 12, 35, 36, 60, 90)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(rnd.randrange(1, 6)):
            w += [word() for _ in range(rnd.randrange(0, 40))]
            p = rnd.choice(passages)
            a = rnd.randrange(len(p))
            w += p[a:] if rnd.random() < 0.5 else p[: a + 1]
        rows.append((i, rnd.choice([" ", "\n", "  "]).join(w)))
    rows += [(200, None), (201, ""), (202, "a " * 300), (203, "x y " * 60), (204, " "), (205, rows[3][1]), (206, "é日 " * 50), (3, rows[3][1]), (None, rows[5][1]), (None, "q " * 40)]
    return rows


def check(documents, rows, window):
    want = brute(rows, window)
    docs = documents(rows, "n_words kept id mark")
    got = substring.remove_repeats(docs, window=window)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256", "kept").collect()), key=str) == want
    got = substring.remove_repeats(docs, window=window, texts=False)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str) == [w[:4] for w in want]


def test_against_brute_force_long_windows(documents):
    check(documents, corpus(1), 35)


def test_against_brute_force_short_windows(documents):
    check(documents, corpus(2), 4)


def test_beyond_the_bound_of_a_broadcast(documents, monkeypatch):
    from plumbline.llm import lookup

    monkeypatch.setattr(lookup.rows_with_ids, "__defaults__", (0, False))
    check(documents, corpus(3), 35)


def test_very_long_texts(documents):
    rnd = random.Random(9)
    passage = " ".join(f"p{rnd.randrange(999)}" for _ in range(50))
    long = " ".join(f"w{rnd.randrange(9999)}" for _ in range(40_000))
    check(documents, [(1, f"{long} {passage} end"), (2, f"start {passage} {long[:3000]}"), (3, "same " * 30_000)], 35)


def test_no_rows(documents):
    assert substring.remove_repeats(documents([])).count() == 0
