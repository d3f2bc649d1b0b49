import hashlib
import random
from collections import Counter

import public_tokenizers
import tiktoken

import corpus_pipeline
from plumbline.llm.bpe import encoder
from test_exact import normalised_groups
from test_minhash import brute as components
from test_mixing import taken_by_hand
from plumbline.llm.queries import ORACLES, QUERIES, RANKS
from plumbline.session import staged


def test_stages_over_a_small_corpus(spark, documents, tmp_path):
    rnd = random.Random(8)
    text = lambda n=80: " ".join(f"w{rnd.randrange(3000)}" for _ in range(n))
    rows = [(i, text(), f"s{i % 4}") for i in range(60)]
    rows += [(100, rows[0][1], "s0"), (101, rows[1][1].replace("w", "w", 1) + " tail", "s1"), (102, "you idiot. you moron. you worthless scum. " + text(), "s2"), (103, None, "s3"), (104, "", None)]
    documents(rows, "kept").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i == 102)) for i in range(60)] + [(102, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, counts = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, str(tmp_path)))
        counts.append((name, docs.count()))
        if name != "byte-level BPE":
            assert docs.columns == columns
        if name == "MinHash near-dedup":
            ids = {r["doc_id"] for r in docs.collect()}
            assert ids == set(range(60)) | {103}  # the empty text of 104 equals the null of 103
    assert counts[0] == ("toxicity", 64) and counts[1] == ("exact dedup", 62) and counts[2] == ("MinHash near-dedup", 61)
    # The same by brute force, from the documents that the grammar kept.
    left = [r for r in rows if r[0] != 102]
    left = [r for r in left if r[0] in normalised_groups(left)]
    left = [r for r in left if (r[0], True) in {(i, k) for i, _, _, k in components([(r[0], r[1]) for r in left], 5, 80)}]
    ranks = encoder(RANKS, public_tokenizers.PATTERN).ranks
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, copies in taken_by_hand(left).items():
        text = next(r[1] for r in left if r[0] == i) or ""
        ids = theirs.encode_ordinary(text)
        want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())] += copies
    assert Counter(map(tuple, docs.collect())) == want
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)


def test_names_and_oracles():
    assert set(ORACLES) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity" and len(corpus_pipeline.STAGES) == 5
