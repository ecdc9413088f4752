"""What is costly in a text is computed once, however many rules look at it."""

from pyspark.sql import functions as F

from quillspark.functions import rules, structure, text
from quillspark.operators import clusters, concepts, titles


def times(column, what):
    return str(column).count(what)


def test_rules_share_their_texts(spark):
    assert times(rules.meaningful(F.col("a"), F.col("b")), "translate(") == 2
    assert times(rules.title_without(F.col("a"), F.col("b")), "{2,}") - times(rules.meaningful(F.col("a"), F.col("b")), "{2,}") == 1


def test_definitions_and_titles_share_their_texts(spark):
    assert times(structure.definitions(F.col("a"), F.col("b")), text.SCAFFOLD) == 1
    assert times(titles.compact(F.col("a")), "how should|how can") == 1


def test_lexicon_words_are_not_cut_for_each_text(spark):
    table = concepts.aliases(spark)
    assert table.where(F.array_distinct(F.regexp_extract_all("alias", F.lit(text.TOKEN), F.lit(0))) != F.col("alias_words")).count() == 0


def test_few_rows_are_dealt_over_all_tasks(spark):
    rows = spark.range(64).withColumn("query_id", F.col("id"))
    assert clusters.dealt(rows, "query_id").rdd.getNumPartitions() == 4
