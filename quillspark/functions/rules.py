"""Rules about texts, tags and scores of candidate rows, as Spark columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sets import clamp
from .text import STOP_WORDS, focus_words, let, normalize_space, plain_edges, sentence_count, signature, tokenize

# Fixed values that results depend on.
POISON = (
    "copyright|rights reserved|terms of service|privacy policy|unauthorized access|cybersecurity|protected by|cookie policy|scrapping|bot detection"
    "|access denied|legal notice|disclaimer|all rights|terms of use|security warning|intellectual property|proprietary information|confidentiality")
MNEMONIC = r"(?i)\b(mov|push|pop|jmp|call|ret|int|add|sub|xor|nop|lea|cmp)\b"
HEX_ROW = r"(?i)[0-9a-f]{2,}\s[0-9a-f]{2,}\s[0-9a-f]{2,}"
COMPARE_STOP = "about after also amid among and around been between from into over that their them they this through under with".split()
FILLER = "best can considering could decade decades how most next one probable response should what year years".split()
#: Patterns of free tags, and what each adds to the reward weights in hundredths.
TAG_RULES = [
    ("generic|vague|broad|surface|shallow", {"relevance": 8, "coverage": 4, "titleSpecificity": 8}),
    ("repeat|repetitive|redundan|duplicate|loop|same", {"diversity": 12, "antiRedundancy": 12}),
    ("evidence|source|citation|reference|unsupported|hallucin|accuracy|factual", {"authority": 10, "evidenceDensity": 12}),
    ("title|heading|headline|naming|name", {"titleSpecificity": 14, "relevance": 4}),
    ("structure|flow|order|sequence|logic|organization|organisation|outline", {"structure": 12, "coherence": 8}),
    ("synthesis|insight|connection|compare|comparison|causal|context|analysis", {"coherence": 8, "diversity": 5}),
    ("detail|depth|specific|granular|nuance", {"coverage": 5, "evidenceDensity": 7}),
]
AUTHORITY = [(r"wikipedia\.org", 0.92), (r"\.gov$", 0.88), (r"\.edu$", 0.84), (r"\.org$", 0.78), (r"\.com$", 0.68)]
LAYER_BONUS = {("seed", "related"): 0.12, ("related", "seed"): 0.08, ("related", "tangential"): 0.08, ("tangential", "related"): 0.12}


def rejections(text: Column, description: Column) -> dict[str, Column]:
    """Why a text is no meaningful term or title: a boolean for each rule."""
    text, description = normalize_space(text), normalize_space(description)
    return _rejections(text, description, F.regexp_replace(text, r"\s+", ""), F.regexp_extract_all(F.lower(F.concat(text, F.lit(" "), description)), F.lit(r"\S+"), F.lit(0)))


def _rejections(text: Column, description: Column, clean: Column, words: Column) -> dict[str, Column]:
    """The same of normalised texts, the first one without white space, and the words of both."""
    return {
        "empty": text == "", "digits": clean.rlike(r"^[0-9]+$"), "run": clean.rlike(r"(.)\1{8,}"), "number": clean.rlike(r"[0-9]{10,}"),
        "unbroken": (F.length(text) > 40) & ~text.contains(" "), "voiceless": (F.length(clean) > 12) & ~clean.rlike("(?i)[aeiou]"),
        "chunks": clean.rlike(r"(.{4,})\1{2,}"), "poison": F.lower(text).rlike(POISON) | F.lower(description).rlike(POISON),
        "monotonous": (F.size(words) > 30) & (F.size(F.array_distinct(words)) / F.size(words) < 0.35),
        "mnemonic": text.rlike(plain_edges(MNEMONIC)) | description.rlike(plain_edges(MNEMONIC)), "hex": text.rlike(HEX_ROW)}


def meaningful(text: Column, description: Column | None = None) -> Column:
    """Without any of the rejections. Texts and what rules share are computed once, not for each rule."""
    def none(text: Column, description: Column) -> Column:
        words = F.regexp_extract_all(F.lower(F.concat(text, F.lit(" "), description)), F.lit(r"\S+"), F.lit(0))
        return let(F.regexp_replace(text, r"\s+", ""), lambda clean: let(words, lambda w: reduce(lambda a, b: a & ~b, _rejections(text, description, clean, w).values(), F.lit(True))))

    told = F.lit("") if description is None else description
    return let(normalize_space(text), lambda t: let(normalize_space(told), lambda d: none(t, d)))


def collapse(text: Column) -> Column:
    """No-break spaces to blanks, white space runs to one blank, trimmed."""
    return F.trim(F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit(" "), F.lit(" ")), r"\s+", " "))


def comparable(text: Column) -> Column:
    """Lower-case words of a-z and 0-9 only; & is a word of its own, `and`."""
    return collapse(F.regexp_replace(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("&"), F.lit(" and ")), r"[^a-z0-9\s]", " "))


def comparable_tokens(text: Column) -> Column:
    """The distinct comparable words of three letters or more that are no stop words."""
    words = F.filter(F.split(comparable(text), " "), lambda w: F.length(w) >= 3)
    return F.array_except(words, F.array(*[F.lit(w) for w in COMPARE_STOP]))


def share_common(a: Column, b: Column) -> Column:
    """Jaccard of two arrays without repeats; 0 if either is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), common / (F.size(a) + F.size(b) - common)).otherwise(0.0)


def text_similarity(a: Column, b: Column) -> Column:
    """1 for equal texts, .96 where one of 28 characters or more is in the other, else the share of common words."""
    x, y = comparable(a), comparable(b)
    first = F.length(x) <= F.length(y)
    short, long = F.when(first, x).otherwise(y), F.when(first, y).otherwise(x)
    return (F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when((F.length(short) >= 28) & F.contains(long, short), 0.96)
            .otherwise(share_common(comparable_tokens(a), comparable_tokens(b))))


def raw_words(text: Column) -> Column:
    """Words of two letters or more as they are written."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[A-Za-z][A-Za-z'.-]{1,}"), F.lit(0))


def proper_words(text: Column) -> Column:
    """Capitalised words that do not begin a sentence."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(plain_edges(r"(?<![.!?]\s)\b[A-Z][a-z]{2,}\b")), F.lit(0))


def key_concepts(text: Column) -> Column:
    """Capitalised words that do not begin a sentence, and tokens of nine letters or more."""
    proper = proper_words(text)
    long = F.filter(F.array_except(tokenize(text), F.array(*[F.lit(w) for w in STOP_WORDS])), lambda w: F.length(w) > 8)
    return F.array_union(proper, long)


def settled(x: Column, digits: int = 4) -> Column:
    """x rounded half up; noise of the last binary digits does not move a half."""
    return F.round(F.round(x, 12), digits)


def informative(content: Column, query: Column, n_definitions: Column | int = 0, n_subtopics: Column | int = 0) -> Column:
    """How much a content tells about a query: length, focus words, concepts, sentences, structure."""
    words, focus, wanted = tokenize(content), focus_words(signature(query)), key_concepts(query)
    overlap = F.size(F.array_intersect(words, focus)) / F.greatest(F.size(focus), F.lit(1))
    concepts = F.when(F.size(wanted) > 0, F.size(F.array_intersect(key_concepts(content), wanted)) / F.size(wanted)).otherwise(0.0)
    structure = F.least(F.lit(n_definitions) * 0.14 + F.lit(n_subtopics) * 0.16, F.lit(1.0))
    least = lambda n, full: F.least(n / full, F.lit(1.0))
    return settled(clamp(least(F.size(words), 260) * 0.25 + overlap * 0.25 + concepts * 0.20 + least(sentence_count(content), 6) * 0.15 + structure * 0.15, 0.35, 0.98), 4)


def fallback_informative(content: Column, query: Column) -> Column:
    tokens = F.filter(F.split(F.lower(query), "[^a-z0-9]+"), lambda t: F.length(t) >= 3)
    low = F.lower(content)
    found = F.when(F.size(tokens) > 0, F.size(F.filter(tokens, lambda t: F.contains(low, t))) / F.size(tokens)).otherwise(0.0)
    return settled(clamp(found * 0.55 + F.least(F.length(content) / 540, F.lit(1.0)) * 0.45, 0.48, 0.92), 4)


def fallback_authority(domain: Column) -> Column:
    out = F.when(F.lower(domain).rlike(AUTHORITY[0][0]), AUTHORITY[0][1])
    for pattern, value in AUTHORITY[1:]:
        out = out.when(F.lower(domain).rlike(pattern), value)
    return out.otherwise(0.63)


def readable_title(host: Column) -> Column:
    """The first label of a host, with blanks for - and _."""
    host = F.regexp_replace(host, r"^www\.", "")
    label = F.translate(F.element_at(F.split(host, r"\."), 1), "-_", "  ")
    return F.when(label != "", label).otherwise(host)


def custom_tag(tag: Column) -> Column:
    """A free tag: trimmed, white space collapsed, 48 characters at most."""
    return F.substring(F.regexp_replace(F.trim(tag), r"\s+", " "), 1, 48)


def custom_tags(tags: Column, most: int = 12) -> Column:
    """The tags of an array, normalised; the first of those that differ by case alone; at most `most`."""
    rows = F.filter(F.transform(tags, custom_tag), lambda t: t.isNotNull() & (t != ""))
    keys = F.transform(rows, F.lower)
    return F.slice(F.filter(rows, lambda t, i: F.array_position(keys, F.lower(t)) == i + 1), 1, most)


def tag_impact(tag: Column) -> dict[str, Column]:
    """What a free tag adds to each reward weight, in hundredths."""
    low, out = F.lower(custom_tag(tag)), {}
    for pattern, deltas in TAG_RULES:
        for weight, n in deltas.items():
            out[weight] = out.get(weight, F.lit(0)) + F.when(low.rlike(pattern), n).otherwise(0)
    return out


def anchors(words: Column, most: int = 3) -> Column:
    """The longest query words that are no filler, alphabetical among equals."""
    kept = F.array_except(words, F.array(*[F.lit(w) for w in FILLER]))
    return F.slice(F.transform(F.sort_array(F.transform(kept, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: x["w"]), 1, most)


def depth_target(index: Column, count: Column) -> Column:
    """The semantic layer of a chapter by its place in the book."""
    place = index / F.greatest(count - 1, F.lit(1))
    return F.when((count <= 1) | (place <= 0.25), "seed").when(place <= 0.7, "related").otherwise("tangential")


def layer_bonus(layer: Column, target: Column) -> Column:
    out = F.when(layer == target, 0.24)
    for (wanted, own), bonus in LAYER_BONUS.items():
        out = out.when((target == wanted) & (layer == own), bonus)
    return out.otherwise(0.0)


def title_without(sentence: Column, words: Column) -> Column:
    """Up to five content words of the first clause that are not among words, capitalised; empty if
    fewer than two are left or the title is not meaningful."""
    clause = normalize_space(F.element_at(F.split(sentence, "[:;,-]"), 1))
    known = F.array_union(F.array(*[F.lit(w) for w in STOP_WORDS]), words)
    kept = let(known, lambda k: F.filter(F.regexp_extract_all(clause, F.lit(r"[A-Za-z][A-Za-z'-]{2,}"), F.lit(0)), lambda w: ~F.array_contains(k, F.lower(w))))
    capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1000)))
    title = lambda k: F.array_join(F.transform(F.slice(k, 1, 5), capital), " ")
    return let(kept, lambda k: let(title(k), lambda t: F.when((F.size(k) >= 2) & meaningful(t, sentence), t).otherwise("")))


def title_from_sentence(sentence: Column, query: Column) -> Column:
    return title_without(sentence, signature(query))


def rotated(items: Column, by: Column) -> Column:
    return F.concat(F.slice(items, by + 1, F.size(items)), F.slice(items, F.lit(1), by))


def map_merge(old: Column, new: Column) -> Column:
    """Entries of both maps; new ones win."""
    return F.map_from_entries(F.concat(F.map_entries(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))), F.map_entries(new)))
