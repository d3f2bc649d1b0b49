"""Alignment against a plain walk over bytes, with ids of the libraries."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from plumbline.llm import alignment
from plumbline.llm.queries import BYTE_VOCABULARY, PIECES

TOOLS = (BYTE_VOCABULARY, PIECES, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(BYTE_VOCABULARY)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def texts():
    rnd = random.Random(4)
    out = [None, "", " ", "a", "  two  blanks ", "a ▁ sign", "<|endoftext|> </s> <0x41>", "don't we'll", "x" * 900, "日本語" * 60, "🙂🙃" * 30, "\x00\n\n  x\t", "tab\tand\r\nline", "é̀" * 40, " " * 300, "١٢٣ ½ Ⅷ"]
    for size in (8, 60, 300):
        for _ in range(60):
            out.append("".join(rnd.choice("ab c  \nthe1é日!🙂'sS") for _ in range(rnd.randrange(1, size))))
    words = ["the", "of", "international", "Straße", "niño", "l'été", "x=3;", "foo_bar", "1234567", "tokenization"]
    return out + [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 120))) for _ in range(40)]


def encoded(libraries, text):
    """Ids and bytes of each token by the libraries, or None if they do not add up."""
    if not text:
        return None
    signs = alignment.byte_signs()
    a = libraries[0].encode(" " + text, add_special_tokens=False)
    b = libraries[1].encode(text)
    a_bytes = [bytes(signs[c] for c in t) for t in a.tokens]
    names = [libraries[1].id_to_piece(i) for i in b]
    b_bytes = [bytes([int(p[3:5], 16)]) if libraries[1].is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, names)]
    whole = b" " + text.encode()
    return (a.ids, a_bytes, b, b_bytes) if b"".join(a_bytes) == whole == b"".join(b_bytes) else None


def plain(a_ids, a_bytes, b_ids, b_bytes):
    """Groups as lists of ids, and the number of overlapping pairs, by walking over the bytes."""
    a_at = [i for i, x in enumerate(a_bytes) for _ in x]
    b_at = [i for i, x in enumerate(b_bytes) for _ in x]
    groups, pairs = [([], [])], sorted(set(zip(a_at, b_at)))
    for k in range(len(a_at)):
        a_ends, b_ends = (k + 1 == len(x) or x[k + 1] != x[k] for x in (a_at, b_at))
        if a_ends:
            groups[-1][0].append(a_ids[a_at[k]])
        if b_ends:
            groups[-1][1].append(b_ids[b_at[k]])
        if a_ends and b_ends:
            groups.append(([], []))
    return groups[:-1], len(pairs)


def brute(libraries, rows):
    found = [(i, plain(*e) if (e := encoded(libraries, t)) else ([], 0)) for i, t in rows]
    counts = Counter((a[-1], b[-1]) for _, (groups, _) in found for a, b in groups)
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(n, highest.get(b, 0))
    out = []
    for i, (groups, overlaps) in found:
        links = [(a[-1], b[-1]) for a, b in groups]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        n = (sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links))
        best, total = sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links)
        out.append((i, *n, best, total, hashlib.sha256(text.encode()).hexdigest() if text else "", overlaps))
    return sorted(out, key=str)


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_as_a_plain_walk(documents, libraries, bound):
    rows = list(enumerate(texts())) + [(3, "the the the"), (3, "the the the"), (3, "of 12"), (None, "x y"), (None, None)]
    got = alignment.alignment_digests(documents(rows, "id pairs _row n_a"), *TOOLS, bound=bound)
    assert sorted(map(tuple, got.collect()), key=str) == brute(libraries, rows)


def test_windows_change_nothing():
    rnd = np.random.default_rng(1)
    for _ in range(200):
        a = rnd.integers(1, 6, 40)
        b, left = [], int(a.sum())
        while left:
            b.append(min(left, int(rnd.integers(1, 8))))
            left -= b[-1]
        whole = alignment.aligned(a, np.array(b))
        for window in (1, 3, 17):
            assert all(np.array_equal(x, y) for x, y in zip(whole, alignment.aligned(a, np.array(b), window), strict=True))


def test_overlaps_and_cuts_as_arrays(documents, libraries):
    rows = [(i, t) for i, t in enumerate(texts())]
    for r in alignment.token_overlaps(documents(rows), *TOOLS).collect():
        e = encoded(libraries, rows[r["doc_id"]][1])
        if e is None:
            assert not any(r[n] for n in ("a_ids", "b_ids", "overlap_a", "overlap_b", "cut_a", "cut_b"))
            continue
        groups, overlaps = plain(*e)
        assert (r["a_ids"], r["b_ids"]) == (e[0], e[2]) and len(set(zip(r["overlap_a"], r["overlap_b"]))) == len(r["overlap_a"]) == overlaps
        assert [(a[-1], b[-1]) for a, b in groups] == [(e[0][x], e[2][y]) for x, y in zip(r["cut_a"], r["cut_b"])]


def test_ids_of_the_vocabulary_are_its_ranks():
    ranks = alignment.vocabulary_ranks(BYTE_VOCABULARY)
    assert len(ranks) == 50_256 and sorted(ranks.values()) == list(range(50_256)) and ranks[b" the"] == 262


def test_a_very_long_text_and_an_empty_table(documents, libraries):
    rows = [(1, "so long a text, " * 90_000), (2, "so")]
    assert sorted(map(tuple, alignment.alignment_digests(documents(rows), *TOOLS).collect()), key=str) == brute(libraries, rows)
    assert alignment.alignment_digests(documents([]), *TOOLS).count() == 0
    assert alignment.alignment_digests(documents([(1, None), (2, "▁")]), *TOOLS).collect()[0][1:] == (0, 0, 0, 0, 0, 0, "", 0)
