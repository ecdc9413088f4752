"""Rules on literal rows."""

from pyspark.sql import functions as F

from quillspark.functions import rules

#: title, description, whether they stay: each rule on both sides of its border.
JUDGED = [
    ("Deep sea vents", "", True), ("", "words", False), ("  ", "words", False), (None, None, False),
    ("1234567", "", False), ("12 34 56", "", False), ("1234567 tides", "", True),
    ("l" + "o" * 8 + "ng coast", "", True), ("l" + "o" * 9 + "ng coast", "", False), ("lo oooo oooo ong coast", "", False),
    ("id 123456789", "", True), ("id 1234567890", "", False), ("id 12345 67890", "", False),
    ("a" * 4 + "bcdefghijklmnopqrstuvwxyzabcdefghijkl", "", False), ("abcdefghijklmnopqrstuvwxyzabcdefghijklmn", "", True),
    ("bcdfghjklmnp", "", True), ("bcdfghjklmnpq", "", False), ("Bcdfghjklmnpqy E", "", True),
    ("planplan of work", "", True), ("planplanplan of work", "", False), ("tidtidtid of work", "", True),
    ("Terms of Use apply", "", False), ("Tides", "see the cookie policy", False),
    ("Tides", "same " * 29, True), ("Tides", "same " * 30, False), ("Tides", " ".join(f"w{i}" for i in range(40)), True),
    ("call me", "", False), ("recall me", "", True), ("Tides", "we add salt", False), ("Tides", "we added salt", True),
    ("ab cd ef 12", "", False), ("Tides", "ab cd ef 12", True), ("ag cd eh", "", True),
]


def test_meaningful_on_literal_rows(spark):
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(JUDGED)], "i int, t string, d string, stays boolean").select("i", "t", "d", "stays", rules.meaningful(F.col("t"), F.col("d")).alias("m")).collect()
    assert [r for r in got if r["m"] != r["stays"]] == []


def _value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_titles_from_sentences(spark):
    title = lambda s, q: _value(spark, rules.title_from_sentence(F.lit(s), F.lit(q)))
    assert title("Rising oceans threaten coastal cities, says a report.", "ocean") == "Rising Oceans Threaten Coastal Cities"
    assert title("Rising, and more", "ocean") == "" and title("", "x") == ""


def test_key_concepts_skip_sentence_starts(spark):
    got = _value(spark, rules.key_concepts(F.lit("Water flows. Rivers reach Lisbon through estuaries and wetlands management.")))
    assert set(got) == {"Water", "Lisbon", "estuaries", "management"}


def test_similarity_rules(spark):
    s = lambda a, b: _value(spark, rules.text_similarity(F.lit(a), F.lit(b)))
    long = "rivers carry sand down to the sea"
    assert s("A & B", "a and b") == 1.0 and s(long, "the " + long + " again") == 0.96 and s("", "x") == 0.0
    assert s("warm sand", "cold sand") == 1 / 3


def test_tags_and_maps(spark):
    tags = F.array(F.lit(" too  Vague "), F.lit("too vague"), F.lit(""), F.lit(None), F.lit("x" * 60))
    assert _value(spark, rules.custom_tags(tags)) == ["too Vague", "x" * 48]
    impact = {k: _value(spark, v) for k, v in rules.tag_impact(F.lit("vague title")).items()}
    assert {k: v for k, v in impact.items() if v} == {"relevance": 12, "coverage": 4, "titleSpecificity": 22}
    merged = rules.map_merge(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3)))
    assert _value(spark, merged) == {"a": 1, "b": 3}


def test_layers(spark):
    targets = [_value(spark, rules.depth_target(F.lit(i), F.lit(5))) for i in range(5)]
    assert targets == ["seed", "seed", "related", "tangential", "tangential"]
    bonus = lambda a, t: _value(spark, rules.layer_bonus(F.lit(a), F.lit(t)))
    assert (bonus("seed", "seed"), bonus("related", "seed"), bonus("seed", "related"), bonus("seed", "tangential")) == (0.24, 0.12, 0.08, 0.0)


def test_word_edges_see_ascii_only_as_sql_does(spark):
    """A defining verb or a listicle word beside an accented letter counts as in DuckDB."""
    import duckdb

    from quillspark.operators import frontier
    from quillspark.plans import oracles

    texts = ["Lluíis queda", "tipsé now", "raíare.\nñis is", "plain is here", "ñaB1234567890x", "basic", "meansß and éare"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, 'a')", list(enumerate(texts)))
    docs = frontier.sources(spark.createDataFrame([(i, t, "a") for i, t in enumerate(texts)], "doc_id long, text string, source string"))
    got = docs.select("doc_id", frontier.definitional_density(F.col("title"), F.col("content")).alias("d"), frontier.spam_risk(F.col("title"), F.col("content")).alias("s")).orderBy("doc_id").collect()
    want = con.execute(f"WITH {oracles.SOURCES}, s AS ({oracles.SPAM}) SELECT doc_id, {oracles.DEFINITIONAL}, spam_risk FROM src JOIN s USING (doc_id) ORDER BY 1").fetchall()
    assert [tuple(r) for r in got] == want


def test_chapter_split_keeps_digits_of_its_parts(spark, tmp_path):
    """The part at place n ends or begins with the digit n: it stays."""
    import duckdb

    from quillspark.plans import catalogue

    texts = ["0 zero. One 1. 2 two. Three 3", "A b. C d. E f. G h. I j.  5 kl 5. 6", None, " lead .  x1 ! 2"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = catalogue.QUERIES["chapter_split"](spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == con.execute(f"SELECT * FROM ({catalogue.ORACLES['chapter_split']}) ORDER BY doc_id").fetchall()
