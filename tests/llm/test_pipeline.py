"""The pipeline's stages against brute force, each on what the stage before it kept."""

import hashlib
from collections import defaultdict

import corpus_pipeline
import public_tokenizers
import pytest

from quillspark.llm import mixing

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """The rows that leave each stage, in order; the documents first."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs.collect()]
    for _, function in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(function(spark, docs, SMALL).collect(), function(spark, docs, SMALL).schema)
        out.append(docs.collect())
    return out


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "exact dedup", "MinHash near-dedup", "mixing sources to target weights", "SentencePiece encoding and decoding"]


def test_language_keeps_clean_documents(kept):
    assert len(kept[1]) >= 0.98 * len(kept[0])
    assert {r["doc_id"] for r in kept[1]} <= {r["doc_id"] for r in kept[0]}


def test_exact_keeps_the_largest_id(kept):
    want = {}
    for r in kept[1]:
        want[r["text"]] = max(want.get(r["text"], -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in kept[2]) == sorted(want.values())


def test_near_keeps_one_of_each_group(kept):
    def shingles(text):
        w = text.encode().lower().split()
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = {r["doc_id"]: shingles(r["text"]) for r in kept[2]}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if common and 10 * common >= 8 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert sorted(r["doc_id"] for r in kept[3]) == sorted({find(d) for d in ids})


def test_mixing_takes_whole_copies(spark, kept):
    copies = defaultdict(int)
    for r in kept[4]:
        copies[r["doc_id"]] += 1
    frame = spark.createDataFrame(kept[3])
    want = {r["id"]: r["copies"] for r in mixing.mix(frame).collect() if r["copies"]}
    assert copies == want and max(copies.values()) <= 2
    assert set(kept[4][0].asDict()) == set(kept[0][0].asDict())


def test_encoding_covers_every_row(kept):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r["doc_id"]: r["text"] for r in kept[4]}
    assert len(kept[5]) == len(kept[4])
    for r in kept[5]:
        ids = [*library.encode(texts[r["doc_id"]]), 2]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
