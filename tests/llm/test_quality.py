import random
import re

from plumbline.llm import quality


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    places = {i + k for x in at.values() if len(x) > 1 for i in x for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(places)


def texts():
    rnd = random.Random(2)
    out = [None, "", " \n\t", "a", "a a", "a a a", "a a a a", "x y z x y z", "a\n\na\n a\na", "é# 🙂|<>&", "same line\n" * 200, "b " * 5000, " lead and trail \x0b"]
    for _ in range(150):
        out.append("".join(rnd.choice(["a", "b", "c", " ", " ", "\n", "#"]) for _ in range(rnd.randrange(200))))
    return out


def test_figures_against_brute_force(documents):
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(texts())] + [(1, "", None), (None, "a b", "s1")]
    docs = documents(rows, "n_words kept host id hashes")
    got = quality.quality_rules(docs)
    want = sorted(((i, *brute(t)) for i, t, _ in rows), key=str)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()), key=str) == want
    for r in got.collect():
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])


def test_hosts(documents):
    rnd = random.Random(1)
    good = lambda: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(60))
    rows = [(i, good() if i % 20 else "short", "good") for i in range(60)]
    rows += [(100 + i, good() if i == 0 else "short", "bad") for i in range(60)]
    rows += [(200, "short", "tiny"), (201, good(), None)]
    got = {r["doc_id"]: r for r in quality.quality_rules(documents(rows)).collect()}
    assert got[1]["kept"] and not got[0]["kept"] and not got[100]["kept"] and got[201]["kept"]
    assert got[0]["host_rate"] < got[200]["host_rate"] < got[100]["host_rate"] < 1
    assert quality.quality_rules(documents([])).count() == 0
