"""The text operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import math
import random
import struct
import uuid
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillspark.llm import attention, chat, exact, htmltext, langid, mixing, nearset, pieces, quality, sstable

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, id string, rate double"
ODD = [
    (1, "alpha beta gamma delta " * 30, "en", "a", 1, "x", "y", 0.5),
    (1, "alpha beta gamma delta " * 30, "en", "a", 1, "x", "y", 0.5),
    (2, None, None, None, None, None, None, None),
    (3, "", "en", "b", 0, "x", None, 0.1),
    (None, "ein wort und noch ein wort " * 5, "de", None, 3, None, "z", None),
    (5, " \t\n\x0b\x0c\r ", "de", "b", 3, None, "z", None),
    (6, "längere wörter — “quoted” ½ ñandú 日本語 👍 ▁meta <|endoftext|> </s> a b", "es", "b", 3, None, "z", None),
    (7, "x" * 50_000, "en", "b", 3, None, "z", None),
    (8, "Alpha beta gamma delta " * 30, "en", "c", 1, "x", "y", 0.5),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


# ---------------------------------------------------------------- mixing


def test_mix_meets_targets(docs):
    rows = mixing.mix(docs).collect()
    size, taken = Counter(), Counter()
    for r in rows:
        assert 0 <= r["copies"] <= 2
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
    share, weights = 1.5 * sum(size.values()), dict(zip(sorted(size), [5, 2, 1] * 99, strict=False))
    target, left, open_ = {}, share, set(size)
    while True:  # as the contract words it
        total = sum(weights[s] for s in open_)
        full = [s for s in open_ if left * weights[s] / total > 2 * size[s]]
        if not full:
            break
        for s in full:
            target[s] = 2 * size[s]
            open_.remove(s)
        left = share - sum(target.values())
    for s in open_:
        target[s] = left * weights[s] / total
    for r in rows:
        assert math.isclose(r["target"], target[r["source"]], rel_tol=1e-9)
        assert r["source_size"] == size[r["source"]]
    for s in size:
        assert abs(taken[s] - target[s]) <= 0.05 * target[s]
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))


def test_dual_is_solved(spark):
    sizes = spark.createDataFrame([(i, "s", 1 + i % 50) for i in range(500)], "id long, source string, size long")
    targets = mixing.source_targets(sizes, (1.0,), 1.3, 2.0)
    lam, scale, target = mixing.solve_dual(sizes, targets).select("lam", "scale", "target").first()
    x = np.array([1 + i % 50 for i in range(500)])
    assert math.isclose((np.minimum(2, np.exp(lam * x / scale)) * x).sum(), target, rel_tol=1e-6)


def test_mix_odd_rows(odd, empty):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD) and all(r["copies"] is not None for r in rows)
    assert {r["size"] for r in rows if r["id"] in (2, 3, 5)} == {0}
    assert mixing.mix(empty).collect() == []


# ---------------------------------------------------------------- sorted string tables


def test_sstable_against_library(spark, odd, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = [r[1] for r in ODD] + [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rng = random.Random(1)
    texts += ["".join(rng.choice("ab 'st\n\téß9.,!_’中²×") for _ in range(80)) for _ in range(300)]
    df = spark.createDataFrame([(i * 3, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = f"file://{tmp_path}/sst"
    manifest = sstable.write_shards(df, out, path, shards=3)
    rows = sorted(sstable.read_shards(spark, out, manifest).collect())
    start = 0
    for r, t in zip(rows, texts, strict=True):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    assert sstable.lookup(out, manifest, 30) == [[*tokenizer.encode(texts[10] or "", add_special_tokens=False).ids, 2]]
    assert sstable.lookup(out, manifest, 31) == []


def test_sstable_odd_rows(spark, odd, empty, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    manifest = sstable.write_shards(odd, f"file://{tmp_path}/a", path, shards=2)
    rows = sstable.read_shards(spark, f"file://{tmp_path}/a", manifest).collect()
    assert len(rows) == len(ODD) and sum(r["doc_id"] is None for r in rows) == 1
    assert len(sstable.lookup(f"file://{tmp_path}/a", manifest, 1)) == 2
    assert sstable.read_shards(spark, f"file://{tmp_path}/b", sstable.write_shards(empty, f"file://{tmp_path}/b", path, shards=2)).collect() == []


def test_keys_sort_as_numbers():
    ids = [None, -(2**63), -5, 0, 7, 2**63 - 1]
    keys = [sstable.key_of(i) for i in ids]
    assert keys == sorted(keys) and [sstable.id_of(k) for k in keys] == ids


# ---------------------------------------------------------------- exact dedup


def _index(spark, name, **more):
    return exact.DigestIndex(spark, f"{name}_{uuid.uuid4().hex}", 2, **more)


def test_exact_odd_rows(spark, odd, empty):
    rows = exact.deduplicate(odd, _index(spark, "ix_odd")).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r["digest"]].append(r)
    assert len(rows) == len(ODD)
    for g in groups.values():
        assert sum(r["kept"] for r in g) == 1
        best = max((r["id"] for r in g if r["id"] is not None), default=None)
        assert all(r["keep_id"] == best and r["group_size"] == len(g) for r in g)
    assert exact.deduplicate(empty, _index(spark, "ix_empty")).collect() == []


def test_index_outlasts_batches(spark, tmp_path):
    batch = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    path = f"{tmp_path}/index"
    exact.deduplicate(batch([(1, "a"), (2, "b")]), _index(spark, "ix_one", path=path)).collect()
    again = _index(spark, "ix_two", path=path)  # as another session would open it
    rows = {r["id"]: (r["kept"], r["keep_id"]) for r in exact.deduplicate(batch([(3, "a"), (4, "c"), (9, "c")]), again).collect()}
    assert rows == {3: (False, 1), 4: (False, 9), 9: (True, 9)}
    assert _index(spark, "ix_three", path=path).read().count() == 3


# ---------------------------------------------------------------- SentencePiece


def test_pieces_against_library(spark, odd, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in pieces.encode(odd, path, keep=["doc_id", "text"]).collect():
        text = r["text"] or ""
        ids = [*library.encode(text), 2]
        assert r["ids"] == ids and r["decoded"] == library.decode(ids)
        proto = library.encode(text, return_type="proto")
        raw = text.encode()  # the library counts bytes, too
        for p, a, z in zip(proto.pieces, r["byte_starts"], r["byte_ends"], strict=False):
            if p.begin != p.end and not p.piece.startswith("<0x"):
                assert (a, z) == (p.begin, p.end)
        assert all(a == z for a, z in zip(r["byte_ends"][:-1], r["byte_starts"][1:], strict=True)) and r["byte_ends"][-1] == len(raw)
    assert pieces.encode(empty, path, keep=["doc_id"], digests=True).collect() == []


def _trie(pairs):
    """A double array for the keys, built the plain way, in the compiled map's format."""
    targets, places = b"", {}
    for k, v in pairs.items():
        places[k] = len(targets)
        targets += v + b"\0"
    units, taken = [0] * 4096, {0}

    def place(node, prefix):
        kids = sorted({k[len(prefix)] if len(k) > len(prefix) else 0 for k in pairs if k.startswith(prefix)})
        offset = next(o for o in range(1, 2000) if all((node ^ o ^ c) not in taken for c in kids))
        base = node ^ offset
        for c in kids:
            taken.add(base ^ c)
        units[node] |= offset << 10 | (1 << 8 if 0 in kids else 0)
        for c in kids:
            if c == 0:
                units[base] = places[prefix] | 1 << 31
            else:
                units[base ^ c] |= c
                place(base ^ c, prefix + bytes([c]))

    place(0, b"")
    blob = struct.pack("<4096I", *units)
    return struct.pack("<I", len(blob)) + blob + targets


def test_longest_prefix_normalisation():
    chars = _trie({b"ab": b"X", b"abc": b"YY", "é".encode(): b"e", b"\t": b" "})
    spec = b"\x12" + pieces_varint(len(chars)) + chars + b"\x18\x01\x20\x01\x28\x01"
    normal = pieces.Normaliser(spec)
    text, at = normal("abcab é\t b ")
    assert text == "▁YYX▁e▁b"
    assert at.tolist() == [0, 0, 0, 0, 0, 3, 5, 5, 5, 6, 8, 8, 8, 10, 12]


def pieces_varint(n):
    return sstable.varint(n)


# ---------------------------------------------------------------- HTML

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body class="home">
<header><a href="/">Home</a></header><nav><ul><li>Menu</ul></nav><div class="cookie-notice">We use cookies</div>
<div id="main-text">{body}</div><div>Same line everywhere</div><aside>Side</aside>
<form><input name=q><button>Go</button></form><div class="comments"><p>First!</p></div><footer>&copy; x</footer>
<script>var a="</p><p>no</p>";</script></body></html>"""


def test_html_with_article(spark):
    html = "<nav>menu</nav><div class=ad>buy</div><article><h1>A &amp; B</h1><p>one\n two<br>three<p>four <b>bold<p>five</p><aside>x</aside></article><div class='comments'><p>c</p></div><footer>f</footer>"
    rows = spark.createDataFrame([(1, "http://h/1", html), (2, None, None), (None, "odd", ""), (4, "http://h/1", "plain text < 3 &lt; 4")], "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in htmltext.extract(rows).collect()}
    text = "A & B\n\none two three\n\nfour bold\n\nfive"
    assert got == {1: (text, len(text)), 2: ("", 0), None: ("", 0), 4: ("plain text < 3 < 4", 18)}
    assert htmltext.extract(rows.limit(0)).collect() == []


def test_style_tree_removes_what_a_site_repeats(spark):
    pages = [(i, f"https://site.example/{i}", PAGE.format(body=f"<p>Unique text number {i}</p><p>And {i * 7} more</p>")) for i in range(40)]
    rows = htmltext.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert all(r["text"] == f"Unique text number {r['page_id']}\n\nAnd {r['page_id'] * 7} more" for r in rows)


def test_style_tree_decides_inside_and_outside_articles(spark):
    page = "<body><article><h1>Title {i}</h1><p>Body {i}</p><p>Twice on few pages {k}</p><div class=x7>Read our new terms</div></article><div class=story>Story {i}</div><div class=y9>Everywhere</div></body>"
    pages = [(i, f"https://site.example/{i}", page.format(i=i, k=i // 2)) for i in range(40)]
    rows = htmltext.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert all(r["text"] == "Title {0}\n\nBody {0}\n\nTwice on few pages {1}\n\nStory {0}".format(r["page_id"], r["page_id"] // 2) for r in rows)


def test_style_tree_alone_finds_what_pages_repeat(spark):
    """Without any name of an element: most boilerplate goes, and no block of an article."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    gone = kept = 0
    for r in htmltext.extract(pages, names=False).join(pages.select("page_id", "html"), "page_id").collect():
        left = Counter(r["text"].split("\n\n"))
        for _, away, _, text in sorted(htmltext.Page(r["html"]).blocks(), key=lambda x: x[1]):  # a menu may name the article
            here = left[text] > 0
            left[text] -= here
            assert here or away
            gone, kept = gone + (away and not here), kept + (away and here)
    assert gone >= 0.75 * (gone + kept)


def test_importance_equals_brute_force(spark):
    rng = random.Random(12)
    pages = [(i, f"https://h{i % 3}.example/{i}", "<body>" + "".join(f"<div class=c{'abcd'[rng.randrange(4)]}><p>{rng.choice(['x', 'y', str(rng.randrange(40))])}</p></div>" for _ in range(6)) + f"<article><p>t{rng.randrange(9)}</p></article><nav>n{i}</nav></body>") for i in range(30)]
    tree, styles, roles, own = defaultdict(Counter), defaultdict(Counter), {}, Counter()
    for _, url, source in pages:
        h, page = url.split("/")[2], htmltext.Page(source)
        own[h] += 1
        for path, away, inside, text in set(page.blocks()):
            tree[h, path][text] += 1
            roles[h, path] = 0.1 if away else 2.0 if inside else 1.0
        for (path, style), n in page.styles.items():
            styles[h, path][style] += n
    share = lambda c: math.exp(-sum(n * math.log(n) for n in c.values()) / (sum(c.values()) + 10)) if c else 1.0
    want = defaultdict(set)
    for (h, path), contents in tree.items():
        if roles[h, path] * (0.9 * share(contents) + 0.1 * share(styles[h, path])) < 0.7:
            want[h].add(htmltext.digest(path))
        want[h] |= {htmltext.digest(path, t) for t, n in contents.items() if roles[h, path] != 0.1 and roles[h, path] * (1 - math.log(n) / math.log(own[h] + 10)) < 0.2}
    rows = htmltext.unimportant(htmltext.style_tree(spark.createDataFrame(pages, "page_id long, url string, html string"))).collect()
    assert {r["host"]: set(r["nodes"]) for r in rows} == want and all(len(v) > 1 for v in want.values())


# ---------------------------------------------------------------- segments

THUE = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
ALIKE = [THUE, THUE.translate(str.maketrans("ab", "ba"))]  # equal under polynomial hashes modulo 2^64


def test_words_alike_stay_apart(spark, tmp_path):
    import sentencepiece
    from tokenizers import Tokenizer

    df = spark.createDataFrame(list(enumerate(ALIKE)), "doc_id long, text string").coalesce(1)
    bytes_path, pieces_path = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    library, model = Tokenizer.from_file(bytes_path), sentencepiece.SentencePieceProcessor(model_file=pieces_path)
    manifest = sstable.write_shards(df, f"file://{tmp_path}/s", bytes_path)
    for i, t in enumerate(ALIKE):
        assert sstable.lookup(f"file://{tmp_path}/s", manifest, i) == [[*library.encode(t, add_special_tokens=False).ids, 2]]
    got = {r["doc_id"]: list(r["ids"]) for r in pieces.encode(df, pieces_path, keep=["doc_id"]).collect()}
    assert got == {i: [*model.encode(t), 2] for i, t in enumerate(ALIKE)}
    assert {r["component_id"] for r in nearset.near_duplicates(df, 4).collect()} == {0, 1}
    scores = attention.lm_scores(df.withColumn("held_out", F.lit(False)), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    assert {r["n_known"] for r in scores} == {2} and {round(r["base_score"], 9) for r in scores} == {round(math.log10(2 / 8) + math.log10(3 / 8), 9)}


# ---------------------------------------------------------------- quality


def _counts(text):
    words = (text or "").encode().split()
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    hit = {i + k for i, w in enumerate(windows) if w in twice for k in range(8)}
    chars = sum(len(w.decode()) for w in words)
    return len(words), chars, sum((text or "").count(c) for c in "#*$%&|<>"), len(lines), len(lines) - len(set(lines)), len(hit)


def test_counts_against_brute_force(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()] + [r[1] for r in ODD] + ["a b c d e f g h a b c d e f g h", "a " * 9]
    for t in texts:
        assert quality.text_counts(t) == _counts(t)


def test_quality_keeps_clean_documents(spark, docs, odd, empty):
    rows = quality.judge(docs).withColumnRenamed("id", "doc_id").join(spark.read.parquet(f"{SMALL}/labels.parquet"), "doc_id").collect()
    clean = [r for r in rows if r["quality"] == 1 and not r["base_failed"]]
    junk = [r for r in rows if r["quality"] == 0]
    assert sum(r["kept"] for r in clean) >= 0.98 * len(clean) and sum(r["kept"] for r in junk) <= 0.3 * len(junk)
    assert len(quality.judge(odd).collect()) == len(ODD) and quality.judge(empty).collect() == []


def test_fences_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r["id"]: r for r in quality.judge(docs).collect()}
    metrics = {m: {} for m in (*quality.UPPER, *quality.SIZES)}
    group = {}
    for r in docs.collect():
        n, chars, symbols, lines, dup, repeat = _counts(r["text"])
        if n:
            group[r["doc_id"]] = (r["lang"], r["source"])
            for m, v in zip(metrics, (symbols / n, dup / max(lines, 1), repeat / n, chars / n, n, lines), strict=True):
                metrics[m][r["doc_id"]] = v

    def drawn(m, q, own):
        def at(ids):
            v = sorted(metrics[m][i] for i in ids)
            return v[max(0, math.ceil(len(v) * q) - 1)]

        levels = [[i for i in group if group[i] == own], [i for i in group if group[i][0] == own[0]], list(group)]
        a, b = (len(x) / (len(x) + quality.PRIOR_DOCS) for x in levels[:2])
        return a * at(levels[0]) + (1 - a) * (b * at(levels[1]) + (1 - b) * at(levels[2]))

    fences = {g: {m: drawn(m, 0.75, g) + k * max(drawn(m, 0.75, g) - drawn(m, 0.25, g), items / max(1, drawn(size, 0.5, g))) for m, (k, items, size) in quality.UPPER.items()} for g in set(group.values())}
    adaptive = 0
    for d, g in group.items():
        near = any(abs(metrics[m][d] - f) <= 0.04 * f for m, f in fences[g].items())  # within the error of the sketch
        over = any(metrics[m][d] > f for m, f in fences[g].items())
        adaptive += over and not rows[d]["base_failed"]
        assert near or rows[d]["kept"] == (not rows[d]["base_failed"] and not over)
    assert adaptive > 20  # without fences these would stay


def test_sketches_merge(spark):
    rows = [(None, str(i % 7), 1 + i % 90, 100 + i, i % 40, 5, 0, 0) for i in range(2000)]
    counts = spark.createDataFrame(rows, "by0 string, by1 string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long")
    merged = {r["metric"]: r for r in quality.quantiles(quality.sketch(counts), []).collect()}
    values = np.sort([(100 + i) / (1 + i % 90) for i in range(2000)])
    for q, name in ((0.25, "q0"), (0.75, "q1")):
        assert math.isclose(merged["mean_chars"][name], values[int(q * 2000) - 1], rel_tol=0.02)


# ---------------------------------------------------------------- near duplicates


def _brute(rows, width, percent):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def _near_copies(n, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    base = [word() for _ in range(200)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6])):
            own[rng.randrange(len(own))] = word()
        out.append(" ".join(own))
    passage = [word() for _ in range(60)]
    return out + [" ".join([*passage, *(word() for _ in range(150))]) for _ in range(n)] + ["too few", "Too few", "x y z"] * 2


def test_near_against_brute_force(spark):
    rows = list(enumerate(_near_copies(150)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in nearset.near_duplicates(df, 4, 80).collect()}
    assert got == _brute(rows, 4, 80)


def test_nodes_too_large_for_a_task(spark, monkeypatch):
    monkeypatch.setattr(nearset, "BLOCK", 40)
    rows = list(enumerate(_near_copies(120, 5)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in nearset.near_duplicates(df, 4, 80).collect()}
    assert got == _brute(rows, 4, 80)


def test_links_of_what_leaves_a_tight_node(spark, monkeypatch):
    monkeypatch.setattr(nearset, "BLOCK", 16)  # several levels of nodes too large for a task
    rng = random.Random(8)
    base = [f"w{i}" for i in range(200)]
    texts = []
    for i in range(400):
        copy = list(base)
        copy[2 + rng.randrange(40) * 4] = f"x{i}"
        texts.append(copy)
    for i in range(40):  # at 0.8 or more to one of the copies alone
        edited = list(texts[i])
        for k in range(5):
            edited[4 + 39 * k] = f"y{i}_{k}"
        texts.append(edited)
    rows = list(enumerate(" ".join(t) for t in texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in nearset.near_duplicates(df, 4, 80).collect()}
    assert got == _brute(rows, 4, 80) and len({c for _, c in got.values()}) == 1


def test_near_small_table(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in nearset.near_duplicates(docs, 4, 80).collect()}
    assert got == _brute(rows, 4, 80)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r["nid"]: r["root"] for r in nearset.components(links).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100}


def test_near_odd_rows(odd, empty):
    rows = nearset.near_duplicates(odd, 4, 80).collect()
    assert len(rows) == len(ODD)
    by = {r["id"]: r for r in rows}
    assert by[8]["component_id"] == 1 and not by[8]["kept"] and by[2]["n_shingles"] == 0 and by[2]["kept"] and by[5]["component_id"] == 5
    assert nearset.near_duplicates(empty).collect() == []


# ---------------------------------------------------------------- language


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", langid.held_out("doc_id"))
    langs, table = langid.train(docs.where("not held_out"))
    rows = langid.predict(docs, langs, table).where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_mixture_finds_both_languages(docs):
    langs, table = langid.train(docs)
    text = {lang: " ".join(r["text"] for r in docs.where(F.col("lang") == lang).limit(3).collect()) for lang in ("en", "de")}
    both = " ".join(text["en"].split()[:150] + text["de"].split()[:150])
    pi, mix, size = langid.infer([both, text["en"], "123 !?", ""], table)
    assert {langs[i] for i in np.argsort(-mix[0])[: size[0]]} >= {"en", "de"} and abs(mix[0][langs.index("en")] - 0.5) < 0.1
    assert langs[mix[1].argmax()] == "en" and size[2] == size[3] == 0


def test_language_odd_rows(odd, empty):
    langs, table = langid.train(odd)
    rows = {r["doc_id"]: r for r in langid.predict(odd, langs, table).collect()}
    assert rows[2]["lang_pred"] == rows[5]["lang_pred"] == "und" and rows[2]["score"] == 0
    none, nothing = langid.train(empty)
    assert none == [] and {r["lang_pred"] for r in langid.predict(odd, none, nothing).collect()} == {"und"}


# ---------------------------------------------------------------- language model


def _lm(df):
    return attention.lm_scores(df.withColumn("held_out", attention.held_out("doc_id")), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_base_scores_against_brute_force(docs):
    rows = {r["id"]: r for r in _lm(docs).collect()}
    texts = {r["doc_id"]: (r["text"] or "").encode().lower().split() + [b"\n"] for r in docs.collect()}
    n = Counter(w for d, ws in texts.items() if zlib.crc32(str(d).encode()) % 7 != 2 for w in ws)
    total, distinct = sum(n.values()), len(n)
    for d, ws in texts.items():
        r = rows[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(str(d).encode()) % 7 == 2, len(ws), sum(n[w] > 0 for w in ws), total)
        assert math.isclose(r["base_score"], sum(math.log10((n[w] + 1) / (total + distinct + 1)) for w in ws), rel_tol=1e-9)
        assert r["score"] < 0 and math.isfinite(r["score"])


def _small_model():
    rng = np.random.default_rng(0)
    sample = rng.integers(0, 300, (200, 64)) * 7
    n = np.bincount(sample.ravel(), minlength=attention.VOCABULARY)
    table = np.zeros((attention.VOCABULARY, 2 * (attention.NEAR_IDS + 1)))
    np.add.at(table, (sample[:, 1:], sample[:, :-1] % attention.NEAR_IDS), 1)
    class_of, input_of = attention.classes_of(n, table)
    ids, sizes = sample.ravel(), np.full(200, 64)
    counts = attention.Counts.of(np.bincount(attention.Counts.cells(ids, sizes, class_of, input_of), minlength=sum(attention.Counts.SIZES)).astype(float))
    state = attention.Fitting(attention.first_weights(), attention.bias_of(counts))
    for _ in range(5):
        state.step(*attention.windows_of(ids, sizes, rng.random(200), class_of, input_of))
    return attention.model_of(state.p, class_of, input_of, counts), rng.integers(0, 300, 100) * 7


def _class_shares(model, x, place):
    w = np.exp(model.key[x] @ model.query[x[-1]] + place)
    seen = (w[:, None] * model.value[x]).sum(0)
    return attention.soft(seen[:-1] / seen[-1] @ model.out + model.bias[x[-1]])


def test_windows_equal_one_by_one_scoring():
    model, ids = _small_model()
    got = attention.score(model, np.concatenate([ids, ids[:30]]), np.array([100, 30]))
    want = 0.0
    for t in range(len(ids)):
        lo = max(0, t - t % attention.STRIDE - (attention.WINDOW - attention.STRIDE))
        x = np.array([attention.START_ROW if j == 0 else model.input_of[ids[j - 1]] for j in range(lo, t + 1)])
        j = t % attention.STRIDE + attention.WINDOW - attention.STRIDE
        shares = _class_shares(model, x, model.place[j, j - len(x) + 1 : j + 1])
        before = np.array([model.class_of[ids[t - 1]] if t else attention.CLASSES - 1])
        want += math.log10(float(shares[model.class_of[ids[t]]] * model.within(ids[t : t + 1], before)[0]))
    assert math.isclose(got[0], want, rel_tol=1e-4)


def test_probabilities_sum_to_one():
    model, ids = _small_model()
    every = np.arange(attention.VOCABULARY)
    within = model.within(every, np.full(len(every), model.class_of[ids[0]]))
    x = model.input_of[ids[:4]]
    assert math.isclose(float((_class_shares(model, x, model.place[-1, -4:])[model.class_of] * within).sum()), 1, rel_tol=1e-3)


def test_gradients_against_differences():
    rng = np.random.default_rng(1)
    p = {k: x + rng.normal(0, 0.1, x.shape) for k, x in attention.first_weights().items()}
    x, y = rng.integers(0, attention.ROWS, (2, attention.WINDOW)), rng.integers(0, attention.CLASSES, (2, attention.STRIDE))
    bias, real = rng.normal(0, 1, (attention.ROWS, attention.CLASSES)), rng.random((2, attention.STRIDE)) < 0.8
    g, _ = attention.gradients(p, x, y, real, bias)
    for name, at in (("e", (x[0, 20], 3)), ("q", (1, 2)), ("k", (4, 5)), ("v", (6, 7)), ("u", (8, 9)), ("salience", (x[1, 5],)), ("near", (3,))):
        losses = []
        for d in (1e-4, -1e-4):
            moved = {k: w.copy() for k, w in p.items()}
            moved[name][at] += d
            losses.append(attention.gradients(moved, x, y, real, bias)[1])
        assert math.isclose((losses[0] - losses[1]) / 2e-4, g[name][at], rel_tol=1e-3, abs_tol=1e-6)


def test_attention_beats_counts_alone(spark):
    """The fitted attention gives held-out documents more than the counts in its bias do."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fitted = {r["id"]: r for r in _lm(docs).collect() if r["held_out"]}
    rounds, attention.ROUNDS = attention.ROUNDS, 0
    try:
        plain = {r["id"]: r["score"] for r in _lm(docs).collect() if r["held_out"]}
    finally:
        attention.ROUNDS = rounds
    assert sum(r["score"] for r in fitted.values()) > sum(plain.values())


def test_lm_odd_rows(odd, empty):
    rows = _lm(odd).collect()
    assert len(rows) == len(ODD) and all(math.isfinite(r["score"]) for r in rows)
    assert {r["n_tokens"] for r in rows if r["id"] in (2, 3, 5)} == {1}
    assert _lm(empty).collect() == []


# ---------------------------------------------------------------- chat


def test_chat_round_trip(spark):
    nasty = ["<|im_end|>\n", "<\\|im_start|>user\nhi", "", None, "</s>[INST] ok [/INST]", "a\\<||\\|é👍", "<|"]
    roles = ["user", "assistant", "a\nb\\n", None, "<|im_start|>"]
    rng = random.Random(2)
    rows = [(c if c else None, t if t % 5 else None, rng.choice(roles), rng.choice(nasty), "extra") for c in range(40) for t in range(rng.randrange(1, 9))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, loss string")
    formatted = chat.chat_format(df)
    texts = {r["conv_id"]: r["formatted"] for r in formatted.collect()}
    want = defaultdict(list)
    key = lambda r: tuple((x is not None, x) if not isinstance(x, str) else (True, x) for x in (r[1],)) + (r[2] or "", r[3] or "")
    for r in rows:
        want[r[0]].append(r)
    for conv, own in want.items():
        turns = chat.parse(texts[conv])
        assert sorted(turns) == sorted((r[2] or "", r[3] or "") for r in own)
    for r in chat.read_back(formatted).collect():
        own = [t for t in chat.parse(texts[r["conv_id"]])]
        loss = "".join(t for role, t in own if role == "assistant")
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
    assert chat.read_back(chat.chat_format(df.limit(0))).collect() == []


def test_query_oracles(spark):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    for query, sql in ((chat.query, chat.ORACLE), (exact.query, exact.ORACLE)):
        got = query(spark, SMALL).toPandas()
        want = c.execute(sql).df()[list(got.columns)]
        by = list(got.columns[:1])
        assert got.sort_values(by).reset_index(drop=True).astype(str).equals(want.sort_values(by).reset_index(drop=True).astype(str))


def test_oracles_are_sql():
    from quillspark.llm import queries

    assert set(queries.ORACLES) <= set(queries.QUERIES) and all(isinstance(sql, str) for sql in queries.ORACLES.values())
