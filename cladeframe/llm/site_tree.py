"""Main text of web pages by a site style tree.

The DOMs of a host's pages are merged: nodes with the same path of tags and classes are one element node, which holds
the presentations (sequences of child tags) and the contents (digests of the text below) it has on the host's pages.
Its importance is the entropy of these over its pages, presentation weighing more the higher the node. A node that
looks and reads alike on page after page has little importance and is noise. It is held against the importance of the
article around the node, or of the body, so that pages that repeat as a whole stay. It is also weighed by what the
node's own tag and classes say (menus, notices, adverts, forms ... are low), and the branches below THRESHOLD are left
out of each page. Within an article this goes for blocks: a word in bold is no branch.

The merged tree is only ever a table of counts, keyed by host and path, so a host with a third of all pages is
counted like any other.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table, written

#: Fewest pages of a host that show a node before its importance is taken from them.
LEAST_PAGES = 8
THRESHOLD = 0.2
#: How fast the weight of presentation falls against that of content, by levels of the tree below a node.
GAMMA = 0.9
#: Importance is multiplied by this for nodes whose tag or classes name noise.
NOISE_PRIOR = 0.1
#: Low branches that are broadcast at most; with more of them each page gets its own by a join.
BROADCAST_ROWS = 200_000

#: HTML element names by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot"}
SAME_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
UNSEEN = frozenset("head script style template noscript svg math canvas object embed iframe audio video noembed noframes datalist".split())
NOISE_TAGS = frozenset("nav header footer aside form menu button select textarea input dialog fieldset label".split())
NOISE_WORDS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer header masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted related replies respond share sharing sidebar skip social sponsor sponsored subscribe subscription toolbar widget".split())
#: Words of readers' comments, which name a branch wherever they stand in a class (comment-list), but with words that tell of a state (comments-open).
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies reply respond".split())
STATE_WORDS = frozenset("open closed off enabled disabled allowed count counts".split())
#: Words of classes that say what a page or its layout has, not what the node is.
LAYOUT_WORDS = frozenset("has no with without layout".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
MAIN_TAGS = frozenset(["article", "main"])

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
_WORD = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")


def _noise_name(token: str) -> bool:
    """Whether a class or id is a noise word, ends in one (site-footer) or tells of comments, without telling of a page's layout (has-sidebar) or state."""
    words = _WORD.findall(token)
    return bool(words) and not LAYOUT_WORDS & set(words) and (words[-1] in NOISE_WORDS or _of_comments(token))


def _of_comments(token: str) -> bool:
    words = set(_WORD.findall(token))
    return bool(COMMENT_WORDS & words) and not (LAYOUT_WORDS | STATE_WORDS) & words


def _named(tag: str, attributes: str) -> tuple[str, float, bool]:
    """The node's step in its path, its prior, and whether it is the article."""
    return (_known if len(attributes) < 256 else _known.__wrapped__)(tag, attributes)


@lru_cache(maxsize=65_536)
def _known(tag: str, attributes: str) -> tuple[str, float, bool]:
    found = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)} if attributes else {}
    names = f"{found.get('class', '')} {found.get('id', '')}".split()
    # An article may be called by what its page has, but a comment is none.
    main = (tag in MAIN_TAGS or found.get("role") == "main") and not any(map(_of_comments, names))
    named = not main and tag not in ("html", "body") and any(map(_noise_name, names))
    noise = tag in UNSEEN or tag in NOISE_TAGS or named or found.get("role") in NOISE_ROLES or "hidden" in attributes.lower().split()
    step = ".".join([tag, *sorted(_DIGITS.sub("0", found.get("class", "")).split())])
    return step, NOISE_PRIOR if noise else 1.0, main and not noise


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


class Node:
    __slots__ = ("tag", "key", "kept", "main", "barred", "reference", "children", "texts")

    def __init__(self, tag: str, key: int) -> None:
        self.tag, self.key = tag, key
        self.kept, self.main, self.barred, self.reference = True, False, False, 1.0
        self.children: list[str] = []
        self.texts: list = []


@lru_cache(maxsize=65_536)
def child_key(parent: int, step: str) -> int:
    """The key of a path: a hash of its last step and of the key of the path before."""
    return _digest(f"{parent}/{step}")


def walked(source: str, on_open, on_close, on_text) -> None:
    """Runs through a page: on_open(tag, attributes, parent) gives a node, on_close(node), on_text(node, text, start of a block)."""
    stack = [on_open("", "", None)]
    at, lowered = 0, None
    opened: dict[str, int] = {}  # how many of each tag, so that no end tag without its start looks through the stack

    def close(to: int) -> None:
        while len(stack) > to:
            node = stack.pop()
            if node.tag in opened:
                opened[node.tag] -= 1
            on_close(node, stack[-1] if stack else None)

    for found in _TOKEN.finditer(source):
        if found.start() < at:
            continue
        if found.start() > at:
            on_text(stack[-1], source[at : found.start()])
        at = found.end()
        tag = found[2]
        if not tag:
            continue
        tag = tag.lower()
        if found[1]:
            for k in range(len(stack) - 1, 0, -1) if opened.get(tag) else ():
                if stack[k].tag == tag:
                    close(k)
                    break
            continue
        if tag in CLOSES_P and opened.get("p") or any(map(opened.get, SAME_CLOSES.get(tag, ()))):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p" and tag in CLOSES_P or stack[k].tag in SAME_CLOSES.get(tag, ()):
                    close(k)
                    break
                if stack[k].tag in BLOCK and stack[k].tag not in ("td", "th"):
                    break
        node = on_open(tag, found[3], stack[-1])
        if tag in VOID:
            on_close(node, stack[-1])
            continue
        stack.append(node)
        opened[tag] = opened.get(tag, 0) + 1
        if tag in RAW:
            lowered = lowered or source.lower()
            end = lowered.find(f"</{tag}", at) if len(lowered) == len(source) else -1
            if end < 0:
                end = m.start() if (m := re.compile(f"</{tag}", re.I).search(source, at)) else len(source)
            at = end
    if at < len(source):
        on_text(stack[-1], source[at:])
    close(0)


# ------------------------------------------------------------------------------------------------ style tree


def page_nodes(source: str) -> list[tuple[int, int, int, int, bool]]:
    """(key, digest of child tags, digest of the text below, levels below, whether an article or the body) of each path of a page."""
    merged: dict[int, list] = {}

    def on_open(tag, attributes, parent):
        if not parent:
            return Node(tag, 0)
        step, _, main = _named(tag, attributes)
        parent.children.append(step)
        node = Node(tag, child_key(parent.key, step))
        node.main = main or tag == "body"
        return node

    def on_text(node, text):
        node.texts.append(text)

    def on_close(node, parent):
        content = _digest("\0".join(map(str, node.texts)))
        depth = 1 + max((x[1] for x in node.texts if isinstance(x, tuple)), default=-1)
        if parent and node.tag not in UNSEEN and node.tag not in VOID:
            own = merged.setdefault(node.key, [[], [], 0, False])
            own[0].append(str(_digest(",".join(node.children))))
            own[1].append(str(content))
            own[2], own[3] = max(own[2], depth), own[3] or node.main
        if parent:
            parent.texts.append((content, depth))

    walked(source, on_open, on_close, on_text)
    return [(key, _digest("|".join(a)), _digest(",".join(b)), depth, main) for key, (a, b, depth, main) in merged.items()]


def host_of(column: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(column).cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def style_tree(pages: DataFrame) -> DataFrame:
    """host, key, n_pages, importance (0 to 1) and main (an article or the body) of each element node that LEAST_PAGES pages of its host show."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(host, *x) for host, source in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()) for x in page_nodes(source or "")]
            columns = list(zip(*rows)) or [[]] * 6
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["host", "key", "style", "content", "depth", "main"])

    rows = pages.select(host_of().alias("host"), F.col("html").cast("string").alias("html")).mapInArrow(task, "host string, key long, style long, content long, depth int, main boolean")
    rows = rows.select("host", "key", "depth", "main", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("style").alias("value")), F.struct(F.lit(1).alias("kind"), F.col("content").alias("value")))).alias("x"))
    counted = rows.groupBy("host", "key", "x.kind", "x.value").agg(F.count("*").alias("n"), F.max("depth").alias("depth"), F.max("main").alias("main"))
    # Entropy to the base of the number of pages: 1 if each page differs, 0 if all are alike.
    n_log = F.sum(F.col("n") * F.log("n"))
    spread = counted.groupBy("host", "key", "kind").agg(F.sum("n").alias("pages"), n_log.alias("n_log"), F.max("depth").alias("depth"), F.max("main").alias("main"))
    spread = spread.filter(F.col("pages") >= LEAST_PAGES).withColumn("entropy", (F.log("pages") - F.col("n_log") / F.col("pages")) / F.log("pages"))
    share = 1 - F.pow(F.lit(GAMMA), F.max("depth"))  # of presentation: none for a leaf
    both = spread.groupBy("host", "key").agg(F.max("pages").alias("n_pages"), F.max("main").alias("main"), (share * F.max(F.when(F.col("kind") == 0, F.col("entropy"))) + (1 - share) * F.max(F.when(F.col("kind") == 1, F.col("entropy")))).alias("importance"))
    return both.withColumn("importance", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "importance")))


def main_text(source: str, importance: dict[int, float]) -> str:
    """The blocks of a page's important branches. Nodes that `importance` lacks have the importance 1 of the unknown."""
    blocks: list[tuple[bool, list[str]]] = [(False, [])]
    seen: list[str] = []

    def on_open(tag, attributes, parent):
        if not parent:
            return Node(tag, 0)
        step, prior, main = _named(tag, attributes)
        node = Node(tag, child_key(parent.key, step))
        node.main, node.barred = main or parent.main, parent.barred or tag in UNSEEN or tag in NOISE_TAGS
        own = importance.get(node.key, 1.0)
        node.reference = own if main or tag == "body" else parent.reference
        held = own / node.reference if node.reference > 0 and (tag in BLOCK or not node.main) else 1.0
        # The page's first article stands for itself, whatever its ancestors are called; not so within a menu, an aside or a template.
        first = main and not seen and not node.barred
        if main:
            seen.append(tag)
        node.kept = (first or parent.kept) and held * prior >= THRESHOLD and tag not in UNSEEN
        if tag in BLOCK:
            blocks.append((node.main, []))
        elif tag == "br" and node.kept:
            blocks[-1][1].append(" ")
        return node

    def on_close(node, parent):
        if node.tag in BLOCK:
            blocks.append((bool(parent and parent.main), []))

    def on_text(node, text):
        if node.kept:
            blocks[-1][1].append(text)

    walked(source, on_open, on_close, on_text)
    found = [(inside, " ".join(html.unescape("".join(parts)).split())) for inside, parts in blocks if parts]
    # A page that has an article is that article.
    if any(inside and text for inside, text in found):
        found = [x for x in found if x[0]]
    return "\n\n".join(text for _, text in found if text)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row.

    A null html has an empty text, a null or odd url belongs to the host without name. Rows that repeat a page are
    rows of their own; other columns are not read; an empty table gives no rows.
    """
    spark = pages.sparkSession
    # Articles and bodies are what others are held against, so that theirs are needed in any case.
    low = written(style_tree(pages).filter((F.col("importance") < THRESHOLD) | (F.col("main") & (F.col("importance") < 1))).select("host", "key", "importance"), "style-tree")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host_of().alias("host"))
    names, schema = ["page_id", "url", "text", "n_chars"], f"page_id long, url {pages.schema['url'].dataType.simpleString()}, text string, n_chars long"
    if low.count() <= BROADCAST_ROWS:
        by_host: dict[str, dict[int, float]] = {}
        for x in low.collect():
            by_host.setdefault(x.host, {})[x.key] = x.importance
        shared = spark.sparkContext.broadcast(by_host)
    else:
        shared = None

        def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = [[x[0] for x in page_nodes(source)] for source in batch.column("html").to_pylist()]
                at = pa.array([k for k, own in enumerate(keys) for _ in own], pa.int64())
                columns = [batch.column("host").take(at), batch.column("page").take(at), pa.array([x for own in keys for x in own], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["host", "page", "key"])

        # A list a page, of its own nodes alone, however many a host has.
        rows = rows.withColumn("page", F.xxhash64("html"))
        asked = rows.mapInArrow(asking, "host string, page long, key long").distinct()
        per_page = asked.join(low, ["host", "key"]).groupBy("host", "page").agg(F.collect_list(F.struct("key", "importance")).alias("low"))
        rows = rows.join(per_page, ["host", "page"], "left")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if shared:
                tables = [shared.value.get(h, {}) for h in batch.column("host").to_pylist()]
            else:
                tables = [{x["key"]: x["importance"] for x in found or []} for found in batch.column("low").to_pylist()]
            texts = [main_text(source, own) for source, own in zip(batch.column("html").to_pylist(), tables)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=names)

    return rows.mapInArrow(task, schema)


def op7_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op7_site_style_tree": op7_site_style_tree}
SQL: dict[str, str] = {}
