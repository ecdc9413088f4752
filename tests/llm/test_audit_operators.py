"""Source divergence, periodic runs and toxicity against SQL, brute force and held-out labels."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import divergence, periodic, toxicity

SMALL = "/root/testdata/sf0.001"
#: Columns whose names the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, term string, n string, label string, runs string, chunk int, score string"
MORE = (0, "x", "y", None, "z", "w", 3, "v")
ODD = [(*r, *MORE) for r in [
    (1, "alpha beta Gamma delta " * 30, "en", "a"),
    (1, "alpha beta Gamma delta " * 30, "en", "a"),
    (2, None, None, None),
    (3, "", "en", "b"),
    (None, "ein wort und noch ein wort " * 5, "de", None),
    (5, " \t\n\x0b\x0c\r ", "de", "b"),
    (6, "längere wörter — “quoted” ½ ñandú 日本語 👍 İSTANBUL x1y2 don't", "es", "b"),
    (7, "x" * 50_000, "en", "b"),
    (8, "Alpha beta gamma " * 2_000, "en", "c"),
    *[(20 + i, "alpha beta common words here " + "zeta " * (i % 4), "en", f"s{i % 6}") for i in range(40)],
]]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---------------------------------------------------------------- source divergence


def _sql(path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
    return sorted(con.execute(divergence.ORACLE).fetchall())


def _rows(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in df.collect())


@pytest.mark.parametrize(("block", "chunk", "span"), [(16, 4096, 16), (2, 3, 1), (1, 2, 2)])
def test_divergence_equals_sql_on_odd_rows(odd, tmp_path, block, chunk, span):
    odd.coalesce(1).write.parquet(str(tmp_path / "d"))
    got = _rows(divergence.audit(odd, block=block, chunk=chunk, span=span))
    assert got == _sql(f"{tmp_path}/d/*.parquet")
    # Ten sources of English, of which two have no kept term or none at all; Spanish has one source and no row.
    assert {r[0] for r in got} == {"en", "de"} and {r[4] for r in got if r[0] == "de"} == {0}


def test_divergence_equals_sql_on_the_table(spark):
    assert _rows(divergence.query(spark, SMALL)) == _sql(f"{SMALL}/documents.parquet")


def test_divergence_of_nothing(empty):
    assert divergence.audit(empty).count() == 0


def test_shares_are_exact(spark):
    rng = random.Random(4)
    pairs = [(c + 2, d) for d in (3, 7, 10**9 + 7, 8 * 10**15) for c in [0, 1, d - 3, *(rng.randrange(d - 2) for _ in range(50))] if 0 <= c <= d - 2]
    want = [1 + 10**9 * n // d for n, d in pairs]
    n, d = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
    assert divergence.shares(n[:, None], d)[:, 0].tolist() == want
    rows = spark.createDataFrame(pairs, "n long, d long").select(divergence.share(F.col("n"), F.col("d")).alias("p")).collect()
    assert [r.p for r in rows] == want


def test_task_hands_counts_on_when_it_holds_many(odd, monkeypatch):
    whole = sorted(map(tuple, divergence.term_counts(odd).collect()))
    monkeypatch.setattr(divergence, "HELD", 3)
    assert sorted(map(tuple, divergence.term_counts(odd).collect())) == whole


# ---------------------------------------------------------------- periodic runs


def _brute_runs(words, least=24, copies=3):
    n, out = len(words), []
    for q in range(1, n // copies + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, copies * q):
                seg = words[i : i + length]
                if q == next(p for p in range(1, q + 1) if seg[p:] == seg[:-p]):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def _text(rng, n):
    words = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 5, 60])) for _ in range(n)]
    for _ in range(rng.randrange(4)):
        if n > 3:
            a = rng.randrange(n)
            p = 1 + rng.randrange(1 + (n - a) // rng.randrange(1, 9))
            for i in range(a, rng.randrange(a, n + 1)):
                words[i] = words[a + (i - a) % p]
    return words


def test_runs_equal_brute_force():
    rng = random.Random(9)
    for _ in range(700):
        words = _text(rng, rng.randrange(0, 170))
        least = rng.choice([24, 24, 6, 1])
        assert periodic.runs(words, least) == _brute_runs(words, least)


def test_runs_of_plain_cases():
    assert periodic.runs([b"a"] * 23) == []
    assert periodic.runs([b"a"] * 24) == [(0, 24, 1)]
    assert periodic.runs([b"x", *[b"a", b"b"] * 12, b"a", b"y"]) == [(1, 25, 2)]
    assert periodic.runs([b"%d" % (i % 10) for i in range(29)]) == []
    assert periodic.runs([b"%d" % (i % 10) for i in range(30)]) == [(0, 30, 10)]
    assert periodic.long_stretches(0b1110111100, 4) == 0b100
    assert periodic.collapsed([b"x", *[b"a", b"b"] * 12, b"a", b"y"], [(1, 25, 2)]) == [b"x", b"a", b"b", b"y"]


def _brute_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) & 0xFFFFFFFF
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = _brute_runs(words)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2])) if found else (None,) * 3
    hexed = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, hexed("".join(f"{s},{n},{q}\n" for s, n, q in found)), hexed(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_of_runs_equals_brute_force(spark, odd, empty, tmp_path):
    names = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    short = spark.read.parquet(f"{SMALL}/documents.parquet").where("n_chars < 12000")
    for n, docs in enumerate((odd, empty, short)):
        docs.write.parquet(str(tmp_path / f"{n}/documents.parquet"))
        want = sorted((_brute_row(r.doc_id, r.text) for r in docs.collect()), key=repr)
        assert sorted((tuple(r[c] for c in names) for r in periodic.query(spark, str(tmp_path / str(n))).collect()), key=repr) == want
        assert n != 2 or sum(w[1] > 0 for w in want) > 5


# ---------------------------------------------------------------- toxicity


def _brute_grams(text, size=toxicity.GRAM):
    out = set()
    for word in re.findall(r"[^\W\d_]+", text.lower()):
        word = f" {word} "
        out |= {word[i : i + size] for i in range(max(1, len(word) - size + 1))}
    return out


def test_grams_equal_brute_force():
    texts = ["", "a", "ab abc abcd abcde", "Hello  wide\nworld!!", "...", "idiots and idiots İx", "x" * 100, "ñandú 日本語 don't"]
    held = toxicity.of_each(*toxicity.grams(texts))
    want = [_brute_grams(t) for t in texts]
    assert [len(x) for x in held] == [len(x) for x in want]
    alike = [[len(np.intersect1d(a, b)) for a in held] for b in held]
    assert alike == [[len(a & b) for a in want] for b in want]
    assert all(len(x) == 0 for x in toxicity.Present(np.empty(0, np.uint64))(texts))


def test_counts_and_ratios_equal_brute_force(spark):
    rows = [("you fool you", 1), ("fool", 1), ("kind words", 0), ("kind fool", 0), (None, 0)]
    got = toxicity.gram_counts(spark.createDataFrame(rows, "text string, label int"))
    want = {}
    for text, y in rows:
        for g in _brute_grams(text or ""):
            n = want.setdefault(g, [0, 0])
            n[1 - y] += 1
    assert sorted((r.n1, r.n0) for r in got.collect()) == sorted(map(tuple, want.values()))
    keys, r = toxicity.select(got, 2, 3, least=0.0)
    assert sorted(np.round(r, 9)) == sorted(round(float(np.log((a + 1) / 4) - np.log((b + 1) / 5)), 9) for a, b in want.values())
    assert len(toxicity.select(got, 2, 3, features=2, least=0.0)[0]) == 2 and (np.diff(keys.astype(object)) > 0).all()


def test_fit_ends_where_the_gradient_is_zero():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 12, rng.integers(0, 6))) for _ in range(300)]
    y = np.array([int(3 in x) ^ int(rng.random() < 0.1) for x in rows])
    r = rng.normal(size=12)
    w, b = toxicity.fit(rows, y, r)
    x = np.array([[r[j] * (j in row) for j in range(12)] for row in rows])
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(x.T @ (p - y) + toxicity.PENALTY * w).max() < 1e-3 and abs((p - y).sum()) < 1e-3


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(8, 1), (8, 1), (1, 0), (20, 0), (21, 0), (8, 0), (22, None), (None, 1), (23, 7)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    out = {r.doc_id: r.value for r in toxicity.score(odd, model, keep=["doc_id"]).withColumnRenamed("score", "value").collect()}
    assert len(out) == len({r[0] for r in ODD}) and all(0 <= v <= 1 for v in out.values())
    assert out[2] == out[3] == out[5]  # no letters: the intercept alone
    assert toxicity.score(odd, model, keep=["doc_id"]).count() == len(ODD)
    assert toxicity.score(empty, model, keep=["doc_id"]).count() == 0
    for other in (empty, odd):  # nothing labelled: the share of one of each class
        none = toxicity.train(other, labels.where("false"))
        assert {r.score for r in toxicity.score(odd, none, keep=["doc_id"]).collect()} == {0.5}


def test_toxicity_finds_held_out_documents(spark):
    out = toxicity.query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").toPandas()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out.doc_id]).all()
    assert (out.predicted == (out.score >= 0.5)).all()
    own = out[out.held_out]
    assert ((own.predicted == 1) & (own.toxic == 0)).sum() <= 1
    assert (own[own.toxic == 1].predicted == 1).mean() >= 0.6  # some labels are noise
