"""Main text of web pages by a site style tree.

The element trees of a host's pages are merged, articles included: one node for each path of tags and classes, to DEPTH levels.
A node's importance is the entropy of its presentations (sequences of children) over the pages that hold it; a text's is 1
less the logarithm of the pages that hold it there, to the base of the pages with its node. Both are combined along
the path, and blocks whose branch comes out low are removed from each page, wherever they stand. What elements mean comes
on top: navigation, footers, asides and forms are never text, an article adds to the importance of what it holds. Of what is
left the page's main text is what stands in articles, or what stands outside them where that is longer.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.storage import materialize

#: Importance below which a branch is removed; pages a node needs and pages with one text; weight of a node's own presentation at
#: each level; what an article adds; levels of the tree (deeper nodes would weigh less than a thousandth).
THRESHOLD, LEAST_PAGES, LEAST_REPEATS, DECAY, ARTICLE, DEPTH = 0.3, 4, 3, 0.9, 0.1, 64

#: Elements by role.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg annotation annotation-xml select option button object canvas audio video xmp noframes noembed".split())
OUT = frozenset("nav footer aside form menu head dialog".split())
CLOSES_P = BLOCKS - frozenset("head html body".split())
PEERS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
#: Words that a class, id or role is made of where it marks what isn't the article, and words that may stand beside them.
MARKS = frozenset("nav navbar navigation menu header masthead footer sidebar aside ad ads advert adverts advertisement advertising sponsor sponsored promo banner notice cookie cookies consent alert popup modal newsletter subscribe subscription signup login comment comments feedback disqus reply replies respond share sharing social related recommended breadcrumb breadcrumbs pagination pager widget toolbar copyright search contentinfo complementary skip hidden".split())
BESIDE = frozenset("area bar block body bottom box button buttons container content form group icons inner item items left link links list main outer page post right section site thread top wrap wrapper".split())
#: Headings of readers' comments, in the languages of the corpora, and elements that such comments come in.
COMMENTS = re.compile(r"(?:\d+ )?(?:reader |user )?(?:comments?|replies|responses|kommentare?|commentaires?|comentarios?)(?: \(?\d+\)?)?:?|leave a (?:reply|comment)|post a comment", re.I)
TALK = frozenset("article form textarea time cite".split())
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*))", re.S)


def marked(names: str) -> bool:
    """Whether a class, id or role marks what isn't the article: each part of one name is such a word or may stand beside one."""
    for name in names.lower().split():
        parts = [x for x in re.split(r"[-_0-9]+", name) if x]
        if any(x in MARKS for x in parts) and all(x in MARKS or x in BESIDE for x in parts):
            return True
    return False


class Block:
    """One block of text: its node in the tree, the nodes above (DEPTH at most), whether an article holds it and whether a role rules it out."""

    __slots__ = ("text", "node", "above", "inside", "out")

    def __init__(self, text: str, node: int, above: list[int], inside: bool, out: bool):
        self.text, self.node, self.above, self.inside, self.out = text, node, above, inside, out


def _hash(*parts: str | int) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(map(str, parts))) - (1 << 63)


ROOT = _hash("")


def parse(page: str | None) -> tuple[list[Block], dict[int, list[str]]]:
    """Blocks in page order, and the children of each node. Tag soup is read as far as it goes; nothing raises.

    Time is linear in the page and, at most, DEPTH times its blocks.
    """
    blocks: list[Block] = []
    children: dict[int, list[str]] = {}
    stack: list[tuple[str, int, bool, bool]] = []  # tag, node, inside an article, ruled out
    nodes: list[int] = []  # of the first DEPTH of them
    opened: Counter = Counter()
    endless: set[str] = set()
    buffer: list[str] = []
    talk: list[tuple[int, int]] = []  # blocks of readers' comments
    headed: list[list] = []  # headings of comments: place of the parent in the stack, number of the heading's block, whether comments were met
    page = page or ""

    def flush() -> None:
        text = " ".join(html.unescape("".join(buffer)).split())
        buffer.clear()
        if not text:
            return
        tag, node, inside, out = stack[-1] if stack else ("", ROOT, False, False)
        if len(stack) > 1 and len(tag) == 2 and tag[0] == "h" and tag[1] in "23456" and COMMENTS.fullmatch(text):
            if not headed or headed[-1][0] < len(stack) - 2:
                headed.append([len(stack) - 2, len(blocks), len(text.rstrip(":").split()) > 1])
        blocks.append(Block(text, node, nodes[:], inside, out))

    def cut(i: int) -> None:
        # A heading of comments rules out what follows it in its parent if it says more than one word, or if elements follow that comments come in.
        while headed and headed[-1][0] >= i:
            _, first, met = headed.pop()
            if met:
                talk.append((first, len(blocks)))
                if headed:
                    headed[-1][2] = True
        opened.subtract(x[0] for x in stack[i:])
        del stack[i:], nodes[i:]

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            buffer.append(page[at:])
            break
        buffer.append(page[at:lt])
        m = TOKEN.match(page, lt)
        if not m:
            # A bare "<" is text; a tag that never ends is dropped with what follows.
            if lt + 1 < n and (page[lt + 1].isalpha() or page[lt + 1] == "/"):
                break
            buffer.append("<")
            at = lt + 1
            continue
        at = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                buffer.append(html.escape(m[0][9:].removesuffix("]]>"), quote=False))
            continue
        tag = m[2].lower()
        if m[1]:
            if not opened[tag]:
                if tag == "p":
                    flush()
                continue
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if any(x[0] in BLOCKS for x in stack[i:]):
                        flush()
                    cut(i)
                    break
                if stack[i][0] in BLOCKS and tag not in BLOCKS:
                    break
            continue
        if tag == "br":
            buffer.append(" ")
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at) if tag not in endless and (not m[3].endswith("/") or tag != "svg") else None
            if end:
                at = end.end()
            elif tag in ("script", "style", "textarea", "title"):
                at = n
            else:
                endless.add(tag)
            continue
        if tag in BLOCKS:
            flush()
            if tag in CLOSES_P and opened["p"]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        cut(i)
                        break
                    if stack[i][0] in BLOCKS:
                        break
            if tag in PEERS and any(opened[x] for x in PEERS[tag]):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in ("ul", "ol", "dl", "table", "menu", *(("tr",) if tag in ("td", "th") else ())):
                        break
                    if stack[i][0] in PEERS[tag]:
                        cut(i)
                        break
        if tag in TALK and headed:
            headed[-1][2] = True
        names = {a[0].lower(): html.unescape(a[1] or a[2] or a[3] or "") for a in ATTRIBUTE.findall(m[3])} if "=" in m[3] else {}
        label = tag + ("." + names["class"].strip() if names.get("class") else "")
        _, above, inside, out = stack[-1] if stack else ("", ROOT, False, False)
        if tag in BLOCKS and len(stack) <= DEPTH:
            children.setdefault(above, []).append(label)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCKS:
            continue
        role = " ".join(names.get(k, "") for k in ("class", "id", "role"))
        out = out or tag in OUT or tag == "header" and not inside or bool(role.strip() and tag not in ("html", "body", "main") and marked(role))
        # An attribute without a value is looked for in what is left without those that have one.
        unseen = "hidden" in m[3].lower() and ("hidden" in names or bool(re.search(r"(?:^|\s)hidden(?=[\s/]|$)", ATTRIBUTE.sub(" ", m[3]), re.I)))
        out = out or tag in BLOCKS and unseen or "display:none" in names.get("style", "").replace(" ", "")
        inside = inside or tag in ("article", "main") and not out
        node = _hash(above, label) if len(stack) < DEPTH else above
        stack.append((tag, node, inside, out))
        opened[tag] += 1
        if len(nodes) < DEPTH:
            nodes.append(node)
    flush()
    cut(0)
    at = 0
    for first, end in sorted(talk):
        for b in blocks[max(first, at) : end]:
            b.out = True
        at = max(at, end)
    return blocks, children


def chosen(blocks: list[Block], low: set[int]) -> str:
    """The main text: of the blocks that neither a role nor a low branch rules out those in articles, or the others if they have more letters."""
    left = [b for i, b in enumerate(blocks) if not b.out and i not in low]
    within = sum(len(b.text) for b in left if b.inside)
    inside = within >= sum(len(b.text) for b in left if not b.inside)
    return "\n".join(b.text for b in left if b.inside == inside)


HOST = re.compile(r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the pages' nodes: a presentation (kind 0) of each node on the way to an open block, and each open block's text (kind 1)."""
    for batch in batches:
        out: list[tuple] = []
        for key, url, page in zip(batch.column("key").to_pylist(), batch.column("url"), batch.column("html")):
            m = HOST.match(url.as_py() or "")
            host = _hash(m[1].lower() if m else "")
            blocks, children = parse(page.as_py())
            within = [b.text for b in blocks if b.inside and not b.out]
            # Copies of a page with small changes keep its two longest blocks; without an article the page itself has to be the same.
            body = _hash(*sorted(within, key=len)[-2:]) if within else _hash(*(b.text for b in blocks))
            open_ = [(i, b) for i, b in enumerate(blocks) if not b.out]
            for p in {p for _, b in open_ for p in b.above}:
                out.append((key, host, p, 0, _hash(*children.get(p, [])), body, -1, [], 0, False))
            for i, b in open_:
                out.append((key, host, b.node, 1, _hash(b.text), body, i, b.above, len(b.above), b.inside))
        columns = list(zip(*out)) if out else [()] * 10
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.bool_())
        names = ["key", "host", "path", "kind", "value", "body", "block", "above", "depth", "inside"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def low_branches(pages: DataFrame) -> DataFrame:
    """key -> low: the blocks of a page whose branch has a low importance in the tree of its host.

    Pages of a host with the same body count once, so an article isn't low because copies of its page exist.
    """
    schema = "key long, host long, path long, kind int, value long, body long, block int, above array<long>, depth int, inside boolean"
    seen = materialize(pages.select("key", "url", "html").mapInArrow(_observe, schema), "tree")
    once = seen.groupBy("host", "path", "kind", "value", "body").agg(F.lit(1).alias("one"))
    values = materialize(once.groupBy("host", "path", "kind", "value").agg(F.count("*").alias("n")), "values")
    # Presentations: entropy over the values of a path, to the base of its pages; one page alone counts as important.
    shown = values.filter("kind = 0").groupBy("host", "path").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    node = shown.select("host", F.col("path").alias("p"), "m", F.when(F.col("m") <= 1, 1.0).otherwise((F.log("m") - F.col("nlogn") / F.col("m")) / F.log("m")).alias("imp"))
    node = materialize(node.filter(F.col("m") >= LEAST_PAGES), "nodes")
    texts = values.filter((F.col("kind") == 1) & (F.col("n") >= LEAST_REPEATS)).select(F.col("host").alias("h"), F.col("path").alias("p1"), F.col("value").alias("v"), "n")
    open_ = seen.filter("kind = 1")
    leaf = open_.join(materialize(texts, "texts"), (F.col("host") == F.col("h")) & (F.col("path") == F.col("p1")) & (F.col("value") == F.col("v")))
    leaf = leaf.select("key", "host", "block", "n", "depth", "inside", F.posexplode("above").alias("level", "p"))
    branch = leaf.join(node, ["host", "p"]).groupBy("key", "block", "n", "depth", "inside").agg(
        F.max_by("m", "level").alias("m"),
        F.max("level").alias("deepest"),
        F.sum((1 - DECAY) * F.pow(F.lit(DECAY), F.col("level")) * F.col("imp")).alias("shape"),
    )
    content = F.greatest(F.lit(0.0), 1 - F.log("n") / F.log("m"))
    importance = F.col("shape") + F.pow(F.lit(DECAY), F.col("depth")) * content + F.when(F.col("inside"), ARTICLE).otherwise(0.0)
    low = branch.filter((F.col("deepest") == F.col("depth") - 1) & (importance < THRESHOLD))
    return low.groupBy("key").agg(F.collect_set("block").alias("low"))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [chosen(parse(page.as_py())[0], set(low.as_py() or ())) for page, low in zip(batch.column("html"), batch.column("low"))]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> page_id, url, text, n_chars; one row for each row.

    A null or empty page has the text ''. Null urls and those without a host are one host. Repeated rows get equal results.
    Where inside and outside have equally many letters the articles are taken. Pages of hosts with fewer than LEAST_PAGES
    different pages are judged by elements and names alone.
    """
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.xxhash64("page_id", "url", "html").alias("key"))
    low = materialize(low_branches(keyed), "low")
    out = keyed.join(low, "key", "left").select("page_id", "url", "html", "low").mapInArrow(_extract, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op1(pages: DataFrame) -> DataFrame:
    return extract(pages)
