"""Resampling against a plain count of every feature."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from plumbline.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def features(text, n):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, n=2, buckets=10_000, least=20, percent=25, seed=7):
    def counts(texts):
        out = [0] * buckets
        for t in texts:
            for f in features(t, n):
                out[zlib.crc32(f.encode()) % buckets] += 1
        return out

    s, t = counts(text for _, text in docs), counts(target)
    all_s, all_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        own = features(text, n)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text)) >= least])
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = able[: percent * len(able) // 100]
    return sorted([tuple(r[:4]) + (next((k + 1 for k, d in enumerate(drawn) if d is r), None),) for r in rows], key=str)


def some_docs(seed, count, longest):
    rnd = random.Random(seed)
    vocabulary = ["the", "Of", "x1", "é", "naïve", "日本", "b" * 70, "c" * 63, "d" * 62, "A", "straße", "9"]
    gaps = [" ", "  ", "\n", ", ", "-", "_", " ... " * 30]
    return [(k, "".join(rnd.choice(vocabulary) + rnd.choice(gaps) for _ in range(rnd.randrange(longest)))) for k in range(count)]


@pytest.mark.parametrize("n,size", [(1, 40), (2, 40), (2, 1 << 18), (3, 64)])
def test_as_the_plain_count(documents, n, size):
    rows = some_docs(5, 60, 90) + [(7, None), (8, ""), (9, "  ,, "), (None, "the x1 " * 30), (3, "the x1 " * 40), (3, "the x1 " * 40), (3, "other text " * 12), (61, "x" * 5000 + " end " * 30)]
    target = ["the x1 of é", None, "", "日本 9 " * 20]
    got = resampling.resample(documents(rows, "id mark n_words rank own"), documents(list(enumerate(target))), n, 997, size=size)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, target, n, 997)


def test_chunks_own_every_start_once():
    for _, text in some_docs(3, 40, 60):
        data = text.encode()
        for n in (1, 2, 4):
            for size in (1, 7, 50):
                parts = list(resampling.overlap_chunks(data, size, n))
                assert b"".join(own for own, _ in parts) == data
                found = []
                for own, carry in parts:
                    mine = words(own.decode())
                    every = mine + words(carry.decode())
                    assert len(every) - len(mine) <= n - 1
                    found += [" ".join(every[i : i + k]) for k in range(1, n + 1) for i in range(len(mine)) if i + k <= len(every)]
                assert sorted(found) == sorted(features(text, n)), (text, n, size)


def test_checksums_of_runs_and_forgetting(monkeypatch):
    hasher = resampling.Hasher(3, 2**32 - 1)
    w = [x.encode() for x in words(" ".join(t for _, t in some_docs(9, 10, 60)))]
    want = [zlib.crc32(b" ".join(w[i : i + k])) % (2**32 - 1) for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    assert hasher.features(w, len(w)).tolist() == want
    monkeypatch.setattr(resampling, "REMEMBERED", 2)
    assert resampling.Hasher(3, 2**32 - 1).features(w, len(w)).tolist() == want


def test_one_text_holds_most_words_and_is_dealt_out(spark, documents):
    long = " ".join(f"w{i % 977} and" for i in range(60_000))
    rows = [(1, long), (2, "a few words " * 9), (3, long)]
    short, parted = resampling.chunks(documents(rows), size=1 << 14)
    assert short.count() == 1
    per_task = parted.groupBy().agg({"chunk": "count"}).first()[0], parted.rdd.getNumPartitions()
    assert per_task[0] == 2 * -(-len(long) // (1 << 14)) and per_task[1] > 1
    got = resampling.resample(documents(rows), documents([(1, "w1 and w2")]), size=1 << 14)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, ["w1 and w2"])


def test_empty_tables_and_drawn_rows(documents):
    none = documents([])
    assert resampling.resample(none, none).count() == 0
    rows = some_docs(6, 40, 80)
    got = resampling.resample(documents(rows), none)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, [])
    kept = resampling.drawn(documents(rows, "id rank"), none)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in got.collect() if r["rank"]) and "rank" in kept.columns
    assert np.array_equal(sorted(r["rank"] for r in got.collect() if r["rank"]), np.arange(1, kept.count() + 1))
