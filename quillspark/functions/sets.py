"""Set and number functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import char_grams


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def overlap(tokens: Column, focus: Column) -> Column:
    """Share of the focus words among the tokens; 0 if either side is empty."""
    return F.when((F.size(tokens) > 0) & (F.size(focus) > 0), F.size(F.array_intersect(tokens, focus)) / F.size(focus)).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 if either is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), common / (F.size(a) + F.size(b) - common)).otherwise(0.0)


def lexical_sets(text: Column) -> Column:
    """The distinct tokens and character 4-grams of a lower-cased text."""
    return F.struct(F.array_distinct(F.regexp_extract_all(text, F.lit("[a-z0-9']{2,}"), F.lit(0))).alias("tokens"), char_grams(text).alias("grams"))


def sets_similarity(a: Column, b: Column, x: Column, y: Column) -> Column:
    """lexical_similarity of texts a and b whose lexical_sets are x and y."""
    mixed = F.when((F.size(x["tokens"]) > 0) & (F.size(y["tokens"]) > 0), clamp(jaccard(x["tokens"], y["tokens"]) * 0.55 + jaccard(x["grams"], y["grams"]) * 0.45)).otherwise(0.0)
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(mixed)


def lexical_similarity(a: Column, b: Column) -> Column:
    """Of two lower-cased texts: .55 token Jaccard + .45 character 4-gram Jaccard; 1 if equal."""
    return sets_similarity(a, b, lexical_sets(a), lexical_sets(b))


def soft_member(term: Column, tokens: Column) -> Column:
    """term is a token or, from six letters, shares its first five with one."""
    near = F.exists(tokens, lambda t: (F.length(t) >= 5) & (F.substring(t, 1, 5) == F.substring(term, 1, 5)))
    return F.array_contains(tokens, term) | ((F.length(term) >= 6) & near)
