import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from plumbline.llm import bpe
from plumbline.llm.queries import RANKS


@pytest.fixture(scope="module")
def tools():
    own = bpe.encoder(RANKS, public_tokenizers.PATTERN)
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    return own, theirs


def texts():
    rnd = random.Random(7)
    out = ["", None, " ", "a" * 5000, "ab" * 900, "aab" * 700, "!?" * 300, "日本語" * 200, "🙂🙃" * 40, "\x00\n\n  x", "<|endoftext|>", " " * 1000 + "x", "é̀" * 99]
    for _ in range(300):
        out.append("".join(rnd.choice("ab c\n1é日!") for _ in range(rnd.randrange(1, 60))))
    return out


def test_encodes_as_the_library(tools):
    own, theirs = tools
    for t, ids in zip(texts(), own.encode(texts())):
        assert ids == theirs.encode_ordinary(t or "")
        assert own.decode(ids) == (t or "").encode()


def test_forgetting_changes_nothing(tools, monkeypatch):
    own, _ = tools
    before = list(own.encode(texts()))
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    assert list(own.encode(texts())) == before


def test_digests_and_round_trip(documents, tools):
    _, theirs = tools
    docs = documents([(i, t) for i, t in enumerate(texts())] + [(3, "a" * 5000), (None, "x")], "ids n_tokens")
    want = sorted(
        (r["doc_id"], len(ids := theirs.encode_ordinary(r["text"] or "")), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
        for r in docs.collect() if r["doc_id"] is not None
    )
    got = [tuple(r) for r in bpe.token_digests(docs, RANKS, public_tokenizers.PATTERN).collect()]
    assert sorted(r for r in got if r[0] is not None) == want
    back = bpe.decoded_texts(bpe.token_ids(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert sorted(((r["doc_id"], r["text"]) for r in back.collect()), key=str) == sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=str)


def test_empty_table(documents):
    assert bpe.token_digests(documents([]), RANKS, public_tokenizers.PATTERN).count() == 0
