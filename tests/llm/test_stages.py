"""Each stage of the pipeline on null, empty, long, repeated and clashing rows."""

import hashlib
from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillspark.llm import mixing

#: Columns whose names the stages use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, id string, sid int, row string, digest string, target double, s string"
MORE = ("x", None, 3, "r", "d", 0.5, "z")
COPY = " ".join(f"word{i}" for i in range(60))
LONG = " ".join(f"lang{i % 977} wort{i % 1013}" for i in range(30_000))
ROWS = [(*r, len(r[1] or ""), *MORE) for r in [
    (1, COPY, "en", "a"), (1, COPY, "en", "a"), (2, COPY, "en", "b"), (3, COPY + " and a little more", "en", None), (4, None, None, None), (5, None, "de", "b"), (6, "", "en", "b"),
    (None, "ein wort und noch ein anderes wort", "de", None), (None, "ein wort und noch ein anderes wort", "de", None), (7, " \t\n 123 ...", "de", "b"), (8, LONG, "en", "c"),
    (9, "längere wörter \u2581meta <s> </s> \u00bd 日本語", "es", "b"), (1, "another text with the id of the first", "en", "a"), (10, "short text", "en", "c"), (11, "Short text", "fr", "c"),
]]
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def _run(spark, name, docs):
    return STAGES[name](spark, docs, "/nowhere")


def _rows(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name", STAGES)
def test_an_empty_table_gives_none(spark, name):
    assert _run(spark, name, spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_columns_and_values_stay(spark, odd, name):
    out = _run(spark, name, odd)
    assert out.columns == odd.columns and dict(out.dtypes) == dict(odd.dtypes)
    assert set(_rows(out)) <= set(_rows(odd))


def test_language_drops_what_has_no_letter(spark, odd):
    assert _rows(_run(spark, "language ID", odd)) == Counter(r for r in ROWS if any(c.isalpha() for c in r[1] or ""))
    assert _run(spark, "language ID", odd.withColumn("lang", F.lit(None).cast("string"))).count() == 0


def test_exact_keeps_one_of_each_text(spark, odd):
    out = _run(spark, "exact dedup", odd).collect()
    assert Counter(r["text"] or "" for r in out) == Counter({r[1] or "" for r in ROWS})
    assert {r["doc_id"] for r in out if r["text"] == COPY} == {2} and {r["doc_id"] for r in out if not r["text"]} == {6}


def test_near_keeps_one_of_each_component(spark, odd):
    out = _run(spark, "MinHash near-dedup", odd).collect()
    # The copies and what is near them leave the smallest id; "Short text" is "short text"; without words all stay.
    assert [r["doc_id"] for r in out if r["text"] and r["text"].startswith("word0")] == [1]
    assert sorted(str(r["doc_id"]) for r in out) == sorted(["1", "1", "4", "5", "6", "7", "8", "9", "10", "None"])


def test_mixing_takes_whole_copies(spark, odd):
    out = _rows(_run(spark, "mixing sources to target weights", odd))
    want = Counter()
    for r in mixing.mix(odd).collect():
        want[r["id"]] = max(want[r["id"]], r["copies"])
    assert all(n <= 2 * ROWS.count(row) for row, n in out.items())
    assert all(want[row[0]] >= 1 for row in out if row[1])


def test_encoding_covers_every_row(spark, odd):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    digest = lambda t: hashlib.sha256(" ".join(map(str, [*library.encode(t or ""), 2])).encode()).hexdigest()
    got = Counter((r["doc_id"], r["ids_sha256"]) for r in _run(spark, "SentencePiece encoding and decoding", odd).collect())
    assert got == Counter((r[0], digest(r[1])) for r in ROWS)


def test_a_word_is_one_segment_whatever_mark_follows():
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    from quillspark.llm import sstable

    data = b"word, word. word) don't a.b 1.2 ,x"
    starts = sstable.segment_starts(np.frombuffer(data, np.uint8), np.empty(0, np.int64))
    parts = [data[a:z] for a, z in zip(starts, [*starts[1:], len(data)], strict=True)]
    assert parts == [b"word", b",", b" word", b".", b" word", b")", b" don't", b" a", b".b", b" 1.2", b" ,x"]
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["don't, we'll;they've!?)a.b,c d.e ,f", "x..,y 's,'t re.'ll", "é,a.é b’,c’. d", "a.\n\n b,\tc)\n", "foo.)'s", "1,2.3 a1,b2."]
    ids, sizes = sstable.encoder(path)(texts)
    assert [p.tolist() for p in np.split(ids, np.cumsum(sizes)[:-1])] == [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


def test_attention_is_fitted_on_every_training_id():
    import numpy as np

    from quillspark.llm import attention

    sizes, rng = np.array([1, 23, 24, 25, 5000, 7]), np.random.default_rng(1)
    ids = np.arange(sizes.sum()) % attention.VOCABULARY
    rows = np.arange(attention.VOCABULARY)
    for places in (np.zeros(6), rng.random(6), np.full(6, 0.999)):
        x, y, real = attention.windows_of(ids, sizes, places, rows, rows)
        assert sorted(y[real]) == ids.tolist()  # before, 1 in each 2,048 ids gave a window
        assert x.shape == (len(y), attention.WINDOW) and y.shape[1] == attention.STRIDE


def test_attention_steps_stay_in_one_precision_and_words_leave_white_space():
    import numpy as np

    from quillspark.llm import attention, nearset

    rng = np.random.default_rng(1)
    sizes, rows = np.full(20, 60), np.arange(attention.VOCABULARY) % attention.CLASSES
    bias = np.zeros((attention.ROWS, attention.CLASSES), np.float32)
    state = attention.Fitting(attention.first_weights(), bias)
    for _ in range(3):
        state.step(*attention.windows_of(rng.integers(0, 99, 1200), sizes, rng.random(20), rows, rows))
    # before, parts of the steps ran in float64, each array of weights by itself
    assert {x.dtype for x in (state.flat, state.first, state.second, *state.p.values())} == {np.dtype(np.float32)}
    assert all(np.shares_memory(x, state.flat) for x in state.p.values()) and state.losses[-1] < state.losses[0]
    numbers, words, upto = nearset.words_of(["Be  be", "", " \n", "so\tbe "])
    assert ([words[i] for i in numbers.tolist()], upto.tolist()) == ([b"be", b"be", b"so", b"be"], [0, 2, 2, 2, 4])
    assert sorted(words) == [b"be", b"so"]  # before, white space was looked up like words
