"""URL and HTML functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sets import clamp
from .text import normalize_space, tokenize, usable_sentences

# Fixed values that results depend on.
SEARCH_HOSTS = ["duckduckgo.com", "www.google.com", "google.com", "bing.com", "www.bing.com"]
FILE_SUFFIXES = "pdf doc docx ppt pptx xls xlsx zip jpg jpeg png gif webp svg mp4 mp3".split()
HOST_BONUS = [("wikipedia.org", 0.38), (".gov", 0.28), (".edu", 0.24), (".org", 0.16), (".com", 0.10)]
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def normalize_url(url: Column) -> Column:
    """http(s) URL with a host, https by default; "" if it is none."""
    u = F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(url, F.lit("")), r"\s+", " ")), r"^[.,;)]+|[.,;)]+$", "")
    u = F.when(u == "", "").when(u.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*://"), u).otherwise(F.concat(F.lit("https://"), u))
    good = u.rlike(r"^https?://[^/?#()<>\"']+([/?#]|$)") & ~u.rlike(r"^https?://[^/?#]*:[^/?#]*[^0-9/?#]") & ~u.rlike(r"^https?://(:|/|\?|#|$)")
    return F.when(good, u).otherwise("")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def domain(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def key_url(url: Column) -> Column:
    """Without fragment and closing slashes."""
    return F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "/+$", "")


def search_internal(url: Column) -> Column:
    h = host(url)
    out = h.isin(SEARCH_HOSTS)
    for s in SEARCH_HOSTS:
        out = out | h.endswith("." + s)
    return out


def fetchable(url: Column) -> Column:
    return url.rlike("^https?://[^/?#]") & ~search_internal(url) & ~F.lower(path(url)).rlike(r"\.(" + "|".join(FILE_SUFFIXES) + ")$")


def title_from_url(url: Column) -> Column:
    """The last part of the path as words, or the host."""
    parts = F.filter(F.split(path(url), "/"), lambda p: p != "")
    slug = F.regexp_replace(F.regexp_replace(F.try_element_at(parts, F.lit(-1)), "[-_]", " "), r"\.[A-Za-z0-9]+$", "")
    slug = F.trim(F.regexp_replace(slug, r"\s+", " "))
    return F.initcap(F.when((F.size(parts) > 0) & (slug != ""), slug).otherwise(F.replace(host(url), F.lit("www."), F.lit(""))))


def authority(url: Column, content: Column, title: Column) -> Column:
    h = host(url)
    bonus = F.lit(0.0)
    for name, b in reversed(HOST_BONUS):
        bonus = F.when(h.contains(name) if name == "wikipedia.org" else h.endswith(name), b).otherwise(bonus)
    return plain_authority(F.size(usable_sentences(content)), F.size(tokenize(title)), bonus)


def plain_authority(usable: Column, n_title: Column, bonus: Column | float = 0.0) -> Column:
    """The same from the numbers of usable sentences and title words, and what the host adds."""
    long_text = F.when(usable >= 4, 0.05).otherwise(0.0)
    return F.round(clamp(0.48 + F.lit(bonus) + long_text + F.when(n_title >= 2, 0.03).otherwise(0.0), 0.40, 0.99), 4)


def unescape(text: Column) -> Column:
    for entity, plain in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def html_title(html: Column) -> Column:
    return normalize_space(F.regexp_replace(unescape(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), "<[^>]*>", ""))


def readable_text(html: Column) -> Column:
    """Text of the page without scripts, styles and comments."""
    clean = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|noscript|svg)\b[^>]*>.*?</\1>", " ")
    clean = F.regexp_replace(clean, r"(?s)<!--.*?-->", " ")
    return normalize_space(unescape(unescape(F.regexp_replace(clean, "<[^>]*>", ""))))
