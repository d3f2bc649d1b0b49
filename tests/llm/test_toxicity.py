import math
import random
import zlib

from plumbline.llm import toxicity as t


def corpus(n=600):
    """Invented words; toxic texts hold one of three words or words with one of two beginnings."""
    rnd = random.Random(4)
    syllables = ["ka", "lo", "mi", "ter", "sun", "pra", "ed", "vo"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randrange(1, 4)))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rnd.randrange(20, 120))]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(4):
                w[rnd.randrange(len(w))] = rnd.choice(["grumpf", "blarg", "snozz"]) if i % 16 else rnd.choice(["zzot", "qwil"]) + rnd.choice(syllables)
        docs.append((i, " ".join(w[:10]) + ". " + " ".join(w[10:])))
        if i % 3 != 2:
            labels.append((i, 1, int(toxic)))
    return docs, labels


def label_table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark, documents):
    docs, labels = corpus()
    got = {r["doc_id"]: r for r in t.score_documents(documents(docs, "score toxic _text"), label_table(spark, labels)).collect()}
    assert len(got) == len(docs)
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    unseen = [i for i, r in got.items() if r["held_out"]]
    right = sum(got[i]["predicted"] == int(i % 8 == 0) for i in unseen)
    assert right >= 0.95 * len(unseen)
    assert sum(got[i]["predicted"] for i in unseen if i % 8 == 0) >= 0.7 * sum(i % 8 == 0 for i in unseen)


def test_held_out_labels_are_not_read(spark, documents):
    docs, labels = corpus(300)
    flipped = [(i, q, 1 - x if zlib.crc32(str(i).encode()) % 5 == 0 else x) for i, q, x in labels]
    table = documents(docs)
    scores = [sorted((r["doc_id"], round(r["score"], 9)) for r in t.score_documents(table, label_table(spark, x)).collect()) for x in (labels, flipped)]
    assert scores[0] == scores[1]


def test_contexts_of_a_clause():
    tagger = t.Tagger({"blarg": 2.0, "gru*": 1.0})
    tag = lambda text: t.clause_matches([tagger[w] for w in t.TOKENS.findall(text)])
    assert tag("what a blarg") == [[2.0, 0, 0, 0, 0]]
    assert tag("you are a blarg") == [[0, 2.0, 0, 0, 0]]
    assert tag("you are not a blarg") == [[0, 0, 2.0, 0, 0]]
    assert tag("she said blarg") == [[0, 0, 0, 2.0, 0]]
    assert tag("i will kill you") == [[0, 0, 0, 0, 1.0]]
    assert tag("i will kill time") == []
    assert tag("not now. blarg, grump") == [[3.0, 0, 0, 0, 0]]
    plain, negated = (t.score(t.features(x, tagger), t.PRIOR) for x in ("you are a blarg", "you are not a blarg"))
    assert plain > negated


def applied(machine, symbols):
    state, out = 0, []
    for s in symbols:
        state, said = machine[state][s]
        out.append(said)
    return out


def test_composed_machine_does_what_its_parts_do():
    rnd = random.Random(7)
    for _ in range(500):
        symbols = [rnd.choice([t.OTHER, t.OTHER, *range(t.END + 1)]) for _ in range(rnd.randrange(60))]
        one_by_one = applied(t.TARGETED, applied(t.REPORTED, applied(t.NEGATED, symbols)))
        assert applied(t.MACHINE, symbols) == one_by_one
    assert len(t.MACHINE) <= len(t.NEGATED) * len(t.REPORTED) * len(t.TARGETED)


def test_curly_apostrophes_negate_and_long_texts_end():
    tagger = t.Tagger({"blarg": 2.0})
    assert t.features("he isn’t a blarg", tagger) == t.features("he isn't a blarg", tagger) != t.features("he is a blarg", tagger)
    assert t.features("word " * 200_000 + "blarg", tagger)[0] > 0


def test_lexicon_against_plain_counts(spark):
    rnd = random.Random(2)
    toxic = {f"w{i}": rnd.randrange(3, 60) for i in range(300)} | {"grump*": 40, "gru*": 41, "grum*": 40, "grumpy": 20, "grumps": 19, "sol*": 30, "solo": 29}
    clean = {k: rnd.randrange(0, 60) for k in list(toxic)[:250]}
    counts = spark.createDataFrame([(k, v, clean.get(k, 0)) for k, v in toxic.items()], "pattern string, toxic long, clean long")
    got = {r["pattern"]: r["weight"] for r in t.without_narrow(t.telling(counts, 300, 2000), counts).collect()}
    want = {}
    for k, v in toxic.items():
        c = clean.get(k, 0)
        odds = math.log((v + 0.5) / 301) - math.log((c + 0.5) / 2001)
        if odds - 2 * math.sqrt(1 / (v + 0.5) + 1 / (c + 0.5)) <= math.log(3):
            continue
        if k.endswith("*"):
            inside = [(x, n) for x, n in toxic.items() if x != k and x.rstrip("*").startswith(k[:-1])]
            if any(v <= (1.05 if x.endswith("*") else 1.5) * n for x, n in inside):
                continue
        want[k] = min(6.0, odds)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want) and "grump*" in want and "sol*" not in want


def test_without_labels_the_seeds_decide(spark, documents):
    rows = [(1, "you idiot, you worthless scum"), (2, "a fine day"), (3, None), (4, ""), (None, "x"), (2, "a fine day")]
    got = sorted((r["doc_id"] or -1, r["predicted"]) for r in t.score_documents(documents(rows), label_table(spark, [])).collect())
    assert got == [(-1, 0), (1, 1), (2, 0), (2, 0), (3, 0), (4, 0)]
    assert t.score_documents(documents([]), label_table(spark, [])).count() == 0


def test_bound_and_stage(spark, documents):
    docs, labels = corpus()
    table = documents(docs, "score")
    kept = t.without_toxic(table, label_table(spark, labels), bound=200)
    assert kept.columns == table.columns
    left = {r["doc_id"] for r in kept.collect()}
    clean = {i for i, _ in docs if i % 8}
    assert len(left & clean) >= 0.99 * len(clean) and len(left - clean) <= 0.4 * (len(docs) - len(clean))
