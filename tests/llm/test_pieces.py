"""The piece encoder against the library, on the public model and on rules that the library compiles."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from plumbline.llm import pieces
from plumbline.llm.queries import PIECES


@pytest.fixture(scope="module")
def tools():
    return pieces.model(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)


def texts():
    rnd = random.Random(11)
    out = ["", None, " ", "   ", "a", "  two  blanks ", "▁", "▁ ▁x", "a" * 4000, "ab" * 900, " " * 700 + "x", "日本語" * 200, "🙂🙃" * 40, "\x00\n\n  x\t", "<s>", "</s> <unk> <0x41>", "é" * 99, "ﷺ﷽", "�", "a b　c"]
    for size in (12, 60, 400):
        for _ in range(150):
            out.append("".join(rnd.choice("ab c  \nthe1é日!▁🙂́ſﬁ") for _ in range(rnd.randrange(1, size))))
    words = ["the", "of", "international", "Straße", "niño", "l'été", "x=3;", "foo_bar", "1234567", "…"]
    out += [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 200))) for _ in range(60)]
    return out


def test_encodes_and_decodes_as_the_library(tools):
    own, theirs = tools
    for t in texts():
        ids, spans = own.encode(t)
        want = theirs.encode(t or "")
        assert ids.tolist() == want
        assert own.decode(want) == theirs.decode(want)
        assert own.decode([1, *want, 2]) == theirs.decode([1, *want, 2])
        assert len(spans) == len(want)


def test_decodes_any_ids_as_the_library(tools):
    own, theirs = tools
    rnd = random.Random(3)
    for _ in range(1500):
        ids = [rnd.choice((rnd.randrange(0, 3), rnd.randrange(3, 259), rnd.randrange(3, 32000), 29871)) for _ in range(rnd.randrange(0, 9))]
        assert own.decode(ids) == theirs.decode(ids), ids


def test_spans_cover_the_original_bytes(tools):
    own, _ = tools
    for t in texts():
        ids, spans = own.encode(t)
        data = (t or "").encode()
        assert b"".join(data[a:b] for a, b in spans) == data
        for i, (a, b) in zip(ids.tolist(), spans):
            if i in own.byte_of:
                assert data[a:b] == own.byte_of[i]
            else:
                assert data[a:b].decode().replace("▁", " ") in (own.surface[i], own.surface[i][1:])


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf", "identity"])
@pytest.mark.parametrize("front", [True, False])
@pytest.mark.parametrize("fewer", [True, False])
def test_normalises_by_longest_prefix_as_the_library(rule, front, fewer):
    theirs = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=front, remove_extra_whitespaces=fewer)
    rules = dict(pieces.fields(next(v for n, v in pieces.fields(theirs.serialized_model_proto()) if n == 3)))
    own = object.__new__(pieces.Model)
    own.map, own.blank_in_front, own.fewer_blanks = pieces.CharacterMap(rules.get(2, b"")), front, fewer
    assert bool(own.map.units) == (rule != "identity")
    for t in filter(None, texts()):
        normal, source = own.normalised(t)
        want, at = theirs.normalize(t, with_offsets=True)
        assert normal.replace("▁", " ") == want.replace("▁", " "), t
        # The library counts characters: where each normalised character comes from.
        firsts = np.cumsum([0, *(len(c.encode()) for c in normal)])
        chars = [len(t.encode()[: source[b]].decode()) for b in firsts]
        assert chars == list(at), t


def test_forgetting_changes_nothing(tools, monkeypatch):
    own, _ = tools
    before = [own.encode(t)[0].tolist() for t in texts()]
    monkeypatch.setattr(pieces, "REMEMBERED", 10)
    assert [own.encode(t)[0].tolist() for t in texts()] == before


def _varint(n):
    return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + _varint(n >> 7)


def _message(*fields):
    out = b""
    for number, value in fields:
        out += _varint(number << 3) + _varint(value) if isinstance(value, int) else _varint(number << 3 | 2) + _varint(len(value)) + value
    return out


def small_model(units=(), kind=2):
    """A model without byte pieces, so that unknown characters show."""
    import struct

    def piece(text, score, kind):
        return (1, _message((1, text.encode()), (3, kind)) + _varint(2 << 3 | 5) + struct.pack("<f", score))

    known = [piece("<unk>", 0, 2), piece("<s>", 0, 3), piece("</s>", 0, 3)] + [piece(p, -i, 1) for i, p in enumerate(["ab", "▁ab", "▁", "a", "b", *units])]
    return _message(*known, (2, _message((3, kind))), (3, _message((3, 1), (4, 0))))


def test_unknown_neighbours_are_one_piece():
    blob = small_model()
    own, theirs = pieces.Model(blob), sentencepiece.SentencePieceProcessor(model_proto=blob)
    for t in ["ab", "xyz", "abxyab", "x ab é日 b", "aab", " "]:
        ids, spans = own.encode(t)
        assert ids.tolist() == theirs.encode(t), t
        assert own.decode(ids.tolist()) == theirs.decode(ids.tolist())
        assert b"".join(t.encode()[a:b] for a, b in spans) == t.encode()


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        pieces.Model(small_model(kind=1))


def test_digests_spans_and_round_trip(documents, tools):
    _, theirs = tools
    docs = documents([(i, t) for i, t in enumerate(texts())] + [(3, "a" * 5000), (None, "x"), (3, "a" * 5000)], "ids n_tokens")
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    want = []
    for i, t in rows:
        ids = theirs.encode(t, add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(theirs.decode(ids).encode()).hexdigest(), len(t.encode())))
    assert sorted(map(tuple, pieces.piece_digests(docs, PIECES).collect()), key=str) == sorted(want, key=str)
    spans = pieces.piece_spans(docs, PIECES)
    assert all(len(r["ids"]) == len(r["begins"]) == len(r["ends"]) and r["ids"][0] == 1 and r["ids"][-1] == 2 for r in spans.collect())
    back = pieces.decoded_pieces(spans.select("doc_id", "ids"), PIECES)
    assert sorted(((r[0], r[1]) for r in back.collect()), key=str) == sorted(((i, t.replace("▁", " ")) for i, t in rows), key=str)


def test_a_very_long_text_and_an_empty_table(documents, tools):
    _, theirs = tools
    long = "so long a text " * 60_000 + "日" * 20_000
    (row,) = pieces.piece_digests(documents([(1, long)]), PIECES).collect()
    assert row["n_tokens"] == len(theirs.encode(long)) + 2 and row["covered_bytes"] == len(long.encode())
    assert pieces.piece_digests(documents([]), PIECES).count() == 0
    assert pieces.piece_spans(documents([]), PIECES).count() == 0
