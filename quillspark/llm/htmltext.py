"""Main text of web pages by a site style tree.

Pages of one host are merged into a style tree: a node is a path of elements (tag with its class
and id words, those with digits left out), with counts of the presentations (sequences of child tags) and contents
(digests of text) that its pages show there. The tree is never built in one task; its nodes are the rows of an
aggregate over (host, path, content), summed before the shuffle, so a host with a third of all
pages costs no more than its distinct nodes. Both kinds of a node have an effective share of different
values, exp(entropy) / n for its n showings: 1 if all differ, 1 / n if all are one. With UNSEEN further
showings that all differ, which only matter to a node that few pages show, the importance of a node is

  prior(role) * (0.9 * share of its contents + 0.1 * share of its presentations)

Text at nodes below the threshold goes, whoever they are: no block goes without its node's importance. Roles
only set the prior. Elements that name themselves menu, header, footer, sidebar, notice, advert, form or comments have
a low one, as reader comments differ on every page; article and main elements have a high one. Without
any name, nodes go for what they repeat. A content goes on its own, wherever it is, if it fills
so many pages of its host that prior * (1 - log(pages with it) / log(pages + UNSEEN)) is below the content threshold.

The nodes of a host that go are bounded by its templates, and travel to the
pages in a join on the host, whose page side adaptive execution can split.

Defined results: null html gives the empty text; a null or odd url is the host ""; a page without
content outside unimportant branches gives the empty text; rows that repeat are treated alike.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, stage

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script style noscript template svg iframe object textarea select title canvas math audio video"
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: A start tag ends an open element of these, up to a container.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS |= {t: {"p"} for t in BLOCK if t not in ENDS and t not in ("html", "body")}
HOLDERS = frozenset("html body div article section main table ul ol dl blockquote td th nav aside header footer form figure fieldset".split())
MAIN = frozenset(("article", "main"))
#: Elements and words of class, id and role that name what is not content.
AWAY_TAGS = frozenset("nav footer aside form dialog button menu head".split())
AWAY_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside complementary footer contentinfo comment comments disqus reply replies cookie cookies consent gdpr notice popup modal newsletter subscribe share sharing social related login signup search pagination pager skip toolbar dialog alert".split())
HEAD_WORDS = frozenset("header masthead".split())

THRESHOLD, CONTENT_THRESHOLD, AWAY_PRIOR, MAIN_PRIOR, UNSEEN = 0.7, 0.2, 0.1, 2.0, 10.0

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(RAW.split()) + r")\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|[^<]+|<", re.S | re.I)
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORDS = re.compile(r"[a-z0-9]+")


class Page:
    """Walks a page and yields its blocks: path, away (by role), whether inside main, text."""

    def __init__(self, source: str, names: bool = True):
        self.source, self.names = source, names
        self.styles: Counter = Counter()

    def blocks(self) -> Iterator[tuple[str, bool, bool, str]]:
        stack: list[tuple[str, str, bool, bool]] = [("", "", False, False)]  # tag, path, away, in main
        kids: list[list[str]] = [[]]
        text: list[str] = []

        def flush():
            got = " ".join("".join(text).split())
            text.clear()
            return got

        def close(to: int):
            while len(stack) > to:
                path = stack.pop()[1]
                self.styles[(path, ",".join(dict.fromkeys(kids[-1])))] += 1
                kids.pop()

        for m in TOKEN.finditer(self.source):
            name = m[3]
            if name is None:
                token = m[0]
                if token[0] != "<" or token == "<":
                    text.append(htmllib.unescape(token) if "&" in token else token)
                continue
            tag = name.lower()
            if tag == "br":
                text.append(" ")
                continue
            is_block = tag in BLOCK
            # What text came before belongs to the element that is open now.
            top = stack[-1]
            if m[2]:
                at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
                if is_block or (at and top[2] and not stack[at - 1][2]):
                    if got := flush():
                        yield top[1], top[2], top[3], got
                if at and (is_block or not any(stack[i][0] in HOLDERS for i in range(at + 1, len(stack)))):
                    close(at)
                continue
            words: set[str] = set()
            if m[4] and m[4].strip():
                for n in NAMES.finditer(m[4]):
                    words.update(WORDS.findall((n[1] or n[2] or n[3] or "").lower()))
            away = tag in AWAY_TAGS or not words.isdisjoint(AWAY_WORDS) or (not top[3] and (tag == "header" or not words.isdisjoint(HEAD_WORDS)))
            if not self.names or tag in MAIN or tag == "body":
                away = False
            if is_block or away:
                if got := flush():
                    yield top[1], top[2], top[3], got
            if tag in ENDS:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][0] in ENDS[tag]:
                        close(i)
                        break
                    if stack[i][0] in HOLDERS:
                        break
            top = stack[-1]
            kids[-1].append(tag)
            if tag in VOID or m[0].endswith("/>") and not is_block:
                continue
            if tag == "article" or tag == "main":
                # An article is content even after an element that was never closed, unless that is comments or the like of it.
                inside = True
            else:
                inside = top[3]
            path = f"{top[1]}/{tag}" + "".join(f".{w}" for w in sorted(words) if w.isalpha()) if not (is_block is False and not away) else top[1]
            stack.append((tag, path, top[2] or away, inside))
            kids.append([])
        if got := flush():
            top = stack[-1]
            yield top[1], top[2], top[3], got
        close(1)


def digest(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\0".join(parts)) - (1 << 63)


def host(url: Column) -> Column:
    found = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return found


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html", names: bool = True) -> DataFrame:
    """host, path, content (or style), value, away, inside, n: what the pages of a host show at a
    node, a content once for each page; and a row with null path for the pages themselves."""
    rows = pages.select(host(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for h, source in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                page = Page(source, names)
                seen.update({(h, digest(path), away, inside, True, digest(path, text)) for path, away, inside, text in page.blocks()})
                for (path, style), n in page.styles.items():
                    seen[(h, digest(path), False, False, False, digest(style))] += n
                seen[(h, None, False, False, True, 0)] += 1
            if seen:
                cols = list(zip(*seen, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2]), pa.array(cols[3]), pa.array(cols[4]), pa.array(cols[5], pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["host", "path", "away", "inside", "content", "value", "n"])

    return rows.mapInArrow(run, "host string, path long, away boolean, inside boolean, content boolean, value long, n long").groupBy("host", "path", "content", "value").agg(F.max("away").alias("away"), F.max("inside").alias("inside"), F.sum("n").alias("n"))


def unimportant(tree: DataFrame, threshold: float = THRESHOLD, content_threshold: float = CONTENT_THRESHOLD) -> DataFrame:
    """host, nodes: digests of the paths, and of the contents at paths, whose importance is too low."""
    hosts = tree.where("path is null").select("host", F.col("n").alias("pages"))
    tree = tree.where("path is not null")
    nodes = tree.groupBy("host", "path").agg(
        *[F.sum(F.when(F.col("content") == c, x)).alias(f"{k}_{a}") for c, k in ((True, "content"), (False, "style")) for a, x in (("n", F.col("n")), ("nlogn", F.col("n") * F.log("n")))],
        F.max("away").alias("away"), F.max("inside").alias("inside"))
    different = lambda kind: F.coalesce(F.exp(-F.col(f"{kind}_nlogn") / (F.col(f"{kind}_n") + UNSEEN)), F.lit(1.0))
    prior = F.when(F.col("away"), F.lit(AWAY_PRIOR)).when(F.col("inside"), F.lit(MAIN_PRIOR)).otherwise(F.lit(1.0))
    importance = prior * (0.9 * different("content") + 0.1 * different("style"))
    branches = nodes.where(F.col("content_n").isNotNull() & (importance < threshold)).select("host", F.col("path").alias("node"))
    filled = prior * (1 - F.log("n") / F.log(F.col("pages") + UNSEEN))
    leaves = tree.where(F.col("content") & ~F.col("away")).join(hosts, "host").where(filled < content_threshold).select("host", F.col("value").alias("node"))
    return branches.unionByName(leaves).groupBy("host").agg(F.collect_set("node").alias("nodes"))


def page_text(source: str, nodes: frozenset[int], names: bool = True) -> str:
    return "\n\n".join(text for path, _, _, text in Page(source, names).blocks() if digest(path) not in nodes and digest(path, text) not in nodes)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", names: bool = True) -> DataFrame:
    """page_id, url, text, n_chars for each page. names: whether what elements call themselves is a prior."""
    rules = stage(unimportant(stage(style_tree(pages, url_col, html_col, names), "style-tree")), "style-rules").withColumnRenamed("host", "_host")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), host(F.col(url_col)).alias("host"))
    rows = rows.join(rules, F.col("host") == F.col("_host"), "left").select("page_id", "url", "html", "nodes")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [page_text(h, frozenset(n or ()), names) for h, n in zip(b.column("html").to_pylist(), b.column("nodes").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    types = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {types['page_id']}, url string, text string, n_chars long")


def query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
