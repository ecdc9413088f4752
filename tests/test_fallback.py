"""Second queries, focus misses, merged lists and synthetic sources on literal rows."""

from pyspark.sql import functions as F

from quillspark.operators import fallback, merge

ROW = "query_id long, rank int, title string, content string"


def test_second_queries(spark):
    asked = {
        1: ("How should cities plan solar storage, best battery value?", "storage battery cities plan solar", None), 2: ("Ada Lovelace", "Ada Lovelace biography career legacy", None), 3: ("", "", ""),
        4: ("the of", "the of", "the of overview background analysis"), 5: ("solar tariffs", "tariffs solar", None), 6: ("solar roof", "solar roof", "solar roof overview background analysis"),
        7: ("iran war", "iran war regional security oil sanctions geopolitics middle", None), 8: (None, "", "")}
    got = {r["query_id"]: (r["simpler"], r["deeper"]) for r in fallback.second_queries(spark.createDataFrame([(i, q) for i, (q, _, _) in asked.items()], "query_id long, query string")).collect()}
    assert got == {i: (s, s if d is None else d) for i, (_, s, d) in asked.items()}


def test_focus_misses(spark):
    queries = spark.createDataFrame([(1, "solar panel storage cost outlook"), (2, "solar"), (3, ""), (4, "thomas cup badminton"), (5, "solar panel storage")], "query_id long, query string")
    good, half = "solar panel storage cost", "cost of living and a panel"
    rows = [(1, 1, good, ""), (1, 2, good, None), (1, 3, half, "outlook"), (1, 4, "cooking", ""), (1, 11, good, ""), (2, 1, "Solar", ""), (4, 1, "thomas cup", "badminton cup"), (4, 2, "thomas cup", "football fifa cup cricket")]
    got = {r["query_id"]: (r["n_fitting"], r["misses"]) for r in fallback.missed(queries, spark.createDataFrame(rows, ROW)).collect()}
    # The third row holds focus words and one of the longest; the tenth place is the last that counts.
    assert got == {1: (3, False), 2: (1, False), 3: (0, False), 4: (1, True), 5: (0, False)}


SET = "query_id long, pos long, url string, title string, content string, provider string"


def test_merged_lists(spark):
    first = spark.createDataFrame([(1, 1, "https://a.org/x", "A", "a", "p"), (1, 2, "", "B", "b", "p"), (1, 3, None, "b ", "B", "p")], SET)
    more = spark.createDataFrame([(1, 1, "a.org/x", "A again", "a", "q"), (1, 2, "https://c.org", "C", "c", "q"), (2, 1, "https://a.org/x", "A", "a", "q")], SET)
    got = [(r["query_id"], r["place"], r["title"], r["provider"]) for r in fallback.merge_sets(first, more, 3).orderBy("query_id", "place").collect()]
    assert got == [(1, 1, "A", "p"), (1, 2, "B", "p"), (1, 3, "C", "q"), (2, 1, "A", "q")]
    assert fallback.merge_sets(first, more, 2).where("query_id = 1").count() == 2


def test_synthetic_sources(spark):
    queries = spark.createDataFrame([(1, "solar storage"), (2, ""), (3, "wind")], "query_id long, query string")
    rows = spark.createDataFrame([(1, 2, "Battery costs in Europe", None), (1, 1, "grid", None), (1, 3, "Grid", None)], ROW)
    wanted = spark.createDataFrame([(1, 3), (2, 1), (3, 0)], "query_id long, desired_count long")
    got = fallback.synthetic(queries, rows, wanted).orderBy("query_id", "place").collect()
    assert [(r["query_id"], r["title"]) for r in got] == [(1, "Foundations: Solar Storage"), (1, "Drivers: Solar Storage"), (1, "Systems: Solar Storage"), (2, "Foundations")]
    # Terms: Solar Storage, grid, Battery costs in Europe, solar, storage; the topic itself is never evidence for itself.
    assert "factors such as Grid and Battery costs in Europe." in got[0]["content"] and "Examining Solar alongside" in got[0]["content"]
    assert "factors such as Grid and Battery costs in Europe." in got[1]["content"] and "factors such as Battery costs in Europe and Solar." in got[2]["content"]
    assert all(r["weight"] == 0.58 and r["provider"] == "local-synthesis" for r in got)


def test_fold_merges_scores_definitions_and_subtopics(spark):
    rows = [
        (1, 0, "u1", "T1", "short", "a", 0.2, 0.9, [("Sun", "x")], [("Roofs", "s")]), (1, 1, "u2", "t1", "much longer", "b", 0.5, 0.1, [("sun", "y"), ("Wind", "z")], []),
        (1, 2, "u9", "T9", "z", "a", 0.1, 0.1, [(f"d{i}", "") for i in range(9)], [(f"s{i}", "") for i in range(9)])]
    table = spark.createDataFrame(rows, "query_id long, pos long, url string, title string, content string, provider string, informative_score double, authority_score double, definitions array<struct<term:string,description:string>>, subtopics array<struct<title:string,summary:string>>")
    got = merge.ordered_fold(table).orderBy("pos").collect()
    assert [(r["n_merged"], r["informative_score"], r["authority_score"], [d["term"] for d in r["definitions"]], len(r["subtopics"])) for r in got] == [(2, 0.5, 0.9, ["Sun", "Wind"], 1), (1, 0.1, 0.1, [f"d{i}" for i in range(6)], 4)]
    merged = merge.merge_by_key(table.withColumn("key", F.lower("title")), "key").orderBy("key").collect()
    assert [([d["term"] for d in r["definitions"]], r["content"], r["authority_score"]) for r in merged] == [(["Sun", "Wind"], "much longer", 0.9), ([f"d{i}" for i in range(9)], "z", 0.1)]


def test_near_fold_compares_url_title_and_content(spark):
    long = "rivers carry fine sand down to the wide sea"
    rows = [(1, 1, "u1", "First title here", "alpha beta gamma", "a"), (1, 2, "u1", "Other", "delta", "a"), (1, 3, "u3", "first TITLE, here", "epsilon", "a"), (1, 4, "", "No link", "zeta", "a"),
            (1, 5, "u5", "Fifth", long, "a"), (1, 6, "u6", "Sixth", f"and so {long} again", "a"), (1, 7, "u7", "Seventh", "alpha beta gamma delta", "a")]
    got = merge.near_fold(spark.createDataFrame(rows, SET)).collect()
    assert sorted(r["pos"] for r in got) == [1, 5, 7]


def test_numbers_and_interleaving_over_many_ranges(spark):
    rows = [(i, f"p{i % 3}" if i % 7 else None, f"l{i % 2}" if i % 5 else None) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, provider string, bucket string").repartition(9)
    got = {r["doc_id"]: (r["round"], r["place"]) for r in merge.interleave(table, "provider", ["doc_id"], ["bucket"]).collect()}
    want = {}
    for b in {r[2] for r in rows}:
        queue = {}
        for i, p, _ in sorted(r for r in rows if r[2] == b):
            queue.setdefault(p, []).append(i)
        ordered = sorted((k, p is not None, p or "", i) for p, ids in queue.items() for k, i in enumerate(ids, 1))
        want |= {i: (k, place) for place, (k, _, _, i) in enumerate(ordered, 1)}
    assert got == want
