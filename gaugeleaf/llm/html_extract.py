"""Main text of web pages by equivalence classes of template tokens.

Pages of one host come from one template.  A template token is an opening tag
with its path of containers, or a whole block of text.  Tokens that occur equally
often on every page of the host share an occurrence vector and form a class.  The
classes whose tokens occur once on each of their pages are skeletons, one for
each type of page (an error page or a second layout only lacks the others'), if
they have ``least_pages`` pages, and a third of the host's if they are of a
single element.  Texts of a skeleton's vector are furniture as its elements are.
Skeletons nest by the paths of their elements.  A page's
text is what lies in its smallest skeleton element (or main or article) that
holds every block with unlinked words, and never one inside an article: so
only blocks of links can lie outside.  Hosts with fewer than ``least_pages``
pages have no skeleton, as nothing tells template from content there.
Furniture is left out: scripts, styles, forms, navigation, page
headers and footers, asides, hidden elements, and elements of any kind that are named
as adverts, notices, sidebars, menus or comments.  A name counts as a whole: one of its
class names, its id or its role must consist of such words and of words for parts of
a page only (``cookie-notice``, ``left-sidebar``, but not ``related-work``).
Blocks that the whole host repeats word for word go as well,
unless they lie in main or article.  Pages with the same blocks of text are one
page there, and where such blocks are most of a page's text, they are taken for
copies of one text and stay.

Scale: an occurrence vector is never built; a token's vector is the sum of its
count times a hash of the whole page, so that equal sums mean equal vectors and the
sums are partial aggregates.  A host with a third of all pages is aggregated
before the shuffle.  Templates are broadcast if they measure up to
``broadcast_bytes``; else pages meet their host's template on a salted key.

Edge cases: a null or empty page gives an empty text; a null or broken url is
the host ''; a page without skeleton elements has its own body,
main and article; unclosed tags end with their container; text outside any
block is a block; a page of any length and depth is read whole; repeated pages give equal
texts, and are counted once; blocks of equal text are one token; an empty table gives no row;
extra columns are kept, and a column text is replaced.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import materialize

# Element names of HTML by their part in a page.
RAW = ("script", "style", "noscript", "template", "iframe", "svg", "canvas", "textarea", "title", "select", "datalist", "audio", "video", "annotation", "annotation-xml")
FURNITURE = {"head", "nav", "footer", "aside", "form", "button", "dialog", "menu", "fieldset", "label"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
CONTAINERS = {"html", "body", "main", "article", "section", "div", "header", "center", "table", "tbody", "thead", "tfoot", "tr", "td", "th", "ul", "ol", "dl", "figure", "details", "blockquote", *FURNITURE}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
BLOCKS = CONTAINERS | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "pre", "address", "figcaption", "hgroup", "summary", "caption", "hr", "legend", "option"}
# Words in class, id or role that name furniture, and words for the part or place of it that may stand beside them.
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification",
    "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "sidebar", "complementary", "menu", "menubar", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "contentinfo",
    "masthead", "comment", "comments", "commentlist", "disqus", "respond", "reply", "replies", "share", "sharing", "social", "related", "recommended", "recommendations", "widget", "toolbar", "copyright",
    "login", "search", "pagination", "pager", "skip",
}
PARTS = {
    "area", "article", "articles", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "col", "column", "container", "content", "div", "form", "global", "group", "header", "inner", "item", "items", "js", "left", "link", "links",
    "list", "main", "media", "mobile", "more", "outer", "page", "panel", "placeholder", "post", "posts", "primary", "right", "row", "secondary", "section", "side", "site", "slot", "sticky", "text", "thread", "title", "to", "top", "unit", "user", "view", "wrap", "wrapper", "zone",
}
HEADERS = {"header", "topbar", "siteheader"}
#: Elements that are furniture by their own name; these are never left out by a name.
KEPT = ("html", "body", "main", "article")

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<([!?])[^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)", re.S)
NAMED = re.compile(r"\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WHITE = re.compile(r"\s+")
WORD = re.compile(r"[^\W_]")
HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


class Node:
    """An open container: its token (a digest of its path), its parent, and whether it is left out or inside main or article."""

    __slots__ = ("name", "token", "parent", "depth", "left_out", "inside")

    def __init__(self, name: str, label: str, parent: Node | None, left_out: bool):
        self.name, self.parent, self.left_out = name, parent, left_out
        self.depth = parent.depth + 1 if parent else 0
        self.token = digest(f"{parent.token if parent else ''}/{name}.{label}")
        self.inside = name in ("article", "main") or parent is not None and parent.inside


class Block:
    """One block of text: its words, the container around it, whether it has words outside links or is a heading, and whether it is left out."""

    __slots__ = ("text", "node", "plain", "left_out")

    def __init__(self, text: str, node: Node | None, plain: bool, left_out: bool):
        self.text, self.node, self.plain, self.left_out = text, node, plain, left_out


def named_parts(attributes: str) -> tuple[str, list[list[str]], bool]:
    """A short name from class or id, the words of each class name, id and role, and whether the element is hidden."""
    label, names, hidden = "", [], False
    for key, a, b, c in NAMED.findall(attributes):
        value, key = a or b or c, key.lower()
        if key in ("hidden", "aria-hidden"):
            hidden = hidden or key == "hidden"
        else:
            if key != "role" and not label:
                label = WHITE.sub(".", value.strip())
            names += [re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", one).lower()) for one in value.split()]
    return label, [n for n in names if n], hidden


def is_furniture(names: list[list[str]]) -> bool:
    """Whether one of the names consists of words for furniture and for its parts."""
    return any(any(w in NAMES for w in words) and all(w in NAMES or w in PARTS for w in words) for words in names)


def parse(page: str) -> tuple[list[Block], list[int]]:
    """Blocks in page order, and the tokens of opened containers."""
    blocks: list[Block] = []
    tokens: list[int] = []
    stack: list[Node] = []
    pieces: list[str] = []
    plain = heading = dropped = False  # of the block that is being read
    muted: list[str] = []  # open inline elements from the first that is left out
    links = 0
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal plain, heading, dropped
        if pieces:
            text = WHITE.sub(" ", html.unescape("".join(pieces))).strip()
            if text:
                node = stack[-1] if stack else None
                blocks.append(Block(text, node, plain or heading, dropped or node is not None and node.left_out))
            pieces.clear()
        plain = heading = dropped = False
        muted.clear()

    while at < end:
        found = TOKEN.search(page, at)
        stop = found.start() if found else end
        if stop > at and not muted:
            pieces.append(page[at:stop])
            plain = plain or not links and WORD.search(html.unescape(pieces[-1])) is not None
        if not found:
            break
        at = found.end()
        name = (found[3] or "").lower()
        if not name:
            continue
        if found[2]:  # closing
            if name == "a":
                links = max(0, links - 1)
            if name == "br":
                pieces.append(" ")
            elif name in BLOCKS:
                flush()
                depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].name == name), None)
                if depth is not None:
                    del stack[depth:]
                    links = 0
            elif name in muted:
                del muted[len(muted) - 1 - muted[::-1].index(name) :]
            continue
        if name in RAW:
            if found[4].rstrip().endswith("/"):
                continue
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        attributes = found[4].strip()
        label, names, hidden = named_parts(attributes) if attributes else ("", [], False)
        closed = attributes.endswith("/") or name in VOID
        if name == "br":
            pieces.append(" ")
        elif name in BLOCKS:
            flush()
            heading = name in HEADINGS
            parent = stack[-1] if stack else None
            out = hidden or name in FURNITURE or name not in KEPT and is_furniture(names)
            if name in CONTAINERS:
                if name == "body":
                    stack = [s for s in stack if s.name == "html"]
                    parent = stack[-1] if stack else None
                inside = parent is not None and parent.inside
                out = out or not inside and name not in KEPT and (name == "header" or any(w in HEADERS for n in names for w in n if all(x in HEADERS or x in PARTS for x in n)))
                node = Node(name, label, parent, out or parent is not None and parent.left_out)
                tokens.append(node.token)
                if not closed:
                    stack.append(node)
            else:
                dropped = out
        else:
            if name == "a":
                links += 1
            if name not in VOID and not attributes.endswith((" /", '"/', "'/")) and (muted or hidden or is_furniture(names)):
                muted.append(name)
    flush()
    return blocks, tokens


def digest(text: str) -> int:
    """Token of a path or a block of text: long texts never leave their task."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def occurrences(pages: DataFrame) -> DataFrame:
    """host, kind ('tag' or 'text'), token, vector (low, high), times and pages, for every token of every host.

    Pages of a host with the same blocks of text are counted once, pages without tokens are not.
    """
    schema = "host string, content long, tokens array<long>, times array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents, found, times = [], [], []
            for page in batch.column(batch.schema.get_field_index("html")).to_pylist():
                blocks, tokens = parse(page or "")
                own = [b.text for b in blocks if not b.left_out]
                counts: dict[int, int] = {0: 1}
                for t in tokens:
                    counts[t] = counts.get(t, 0) + 1
                contents.append(digest("\n".join(own)))
                texts = sorted({digest(t) for t in own})
                found.append([*counts, *texts])
                times.append([*counts.values(), *[0] * len(texts)])  # 0 marks a text
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("host")), pa.array(contents, pa.int64()), *(pa.array(c, pa.list_(pa.int64())) for c in (found, times))], names=["host", "content", "tokens", "times"])

    distinct = pages.select("host", "html").mapInArrow(run, schema).where("size(tokens) > 1").groupBy("host", "content").agg(F.min(F.struct("tokens", "times")).alias("own"))
    rows = distinct.select("host", "content", F.inline(F.arrays_zip("own.tokens", "own.times"))).toDF("host", "content", "token", "times")
    rows = rows.withColumns({"kind": F.when(F.col("times") == 0, "text").otherwise("tag"), "n": F.greatest("times", F.lit(1))})
    # halves of the hashes are summed, so that sums stay far from overflow
    halves = rows.withColumns({"low": F.col("content").bitwiseAND(0xFFFFFFFF) * F.col("n"), "high": F.shiftrightunsigned("content", 32) * F.col("n")})
    return halves.groupBy("host", "kind", "token").agg(F.sum("low").alias("low"), F.sum("high").alias("high"), F.sum("n").alias("times"), F.count("*").alias("pages"))


def templates(pages: DataFrame, least_pages: int = 4, least_share: float = 0.9) -> DataFrame:
    """host, skeleton (digests of the paths of its elements), repeated (digests of blocks that the host or a type of page repeats)."""
    found = materialize(occurrences(pages).where(f"pages >= {least_pages}"), "occurrences")
    whole = found.where("kind = 'tag' and token = 0").select("host", F.col("pages").alias("host_pages"))
    single = found.where("kind = 'tag' and token <> 0 and times = pages")
    classes = single.groupBy("host", "low", "high").agg(F.collect_list("token").alias("skeleton"), F.max("pages").alias("pages"))
    classes = classes.join(whole, "host").where("size(skeleton) > 1 or 3 * pages >= host_pages")
    texts = found.where("kind = 'text'").join(whole, "host").join(classes.select("host", "low", "high", F.lit(True).alias("classed")), ["host", "low", "high"], "left")
    texts = texts.where(f"classed or pages >= {least_share} * host_pages").select("host", F.col("token").alias("repeated"))
    kept = classes.select("host", "skeleton").unionByName(texts, allowMissingColumns=True)
    return kept.groupBy("host").agg(F.flatten(F.collect_list("skeleton")).alias("skeleton"), F.collect_list("repeated").alias("repeated"))


def common_node(nodes: list[Node | None]) -> Node | None:
    """The innermost container around all of the nodes."""
    common = nodes[0]
    for other in nodes[1:]:
        while common is not other:
            if common is None or other is None:
                return None
            if common.depth >= other.depth:
                common = common.parent
            else:
                other = other.parent
    return common


def within(node: Node | None, container: Node) -> bool:
    while node is not None and node.depth > container.depth:
        node = node.parent
    return node is container


def main_text(page: str, skeleton: set[int], repeated: set[int]) -> str:
    blocks, _ = parse(page)
    blocks = [b for b in blocks if not b.left_out]
    chosen = [b for b in blocks if digest(b.text) not in repeated or b.node is not None and b.node.inside] if repeated else blocks
    if 2 * sum(len(b.text) for b in chosen if b.plain) < sum(len(b.text) for b in blocks if b.plain):
        kept = set(map(id, chosen))
        chosen = [b for b in blocks if b.plain or id(b) in kept]  # copies of one text
    plain = [b.node for b in chosen if b.plain]
    if plain:
        around, node = [], common_node(plain)
        while node is not None:
            around.append(node)
            node = node.parent
        slot = None
        for node in reversed(around):  # from the outside
            if node.name in ("article", "main") or node.token in skeleton:
                slot = node
            if node.name == "article":
                break
        chosen = [b for b in chosen if within(b.node, slot)] if slot else chosen
    return "\n".join(b.text for b in chosen).encode("utf-8", "replace").decode()


def extract(pages: DataFrame, salts: int = 16, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """pages with text (main text, '' if none); needs page_id, url and html.  A column text is replaced."""
    pages = pages.drop("text")
    names = {n: f"in_{i}" for i, n in enumerate(pages.columns)}  # whatever they are called, they clash with none of the columns below
    plain = pages.toDF(*names.values())
    hosted = plain.withColumn("host", F.lower(F.coalesce(F.regexp_extract(names["url"], HOST, 1), F.lit(""))))
    found = materialize(templates(hosted.select(F.col(names["page_id"]).alias("page_id"), "host", F.col(names["html"]).alias("html"))), "templates")
    size = found.agg(F.sum(F.length("host") + 8 * F.size("skeleton") + 8 * F.size("repeated") + 100)).first()[0] or 0
    if size <= broadcast_bytes:  # measured; larger sets of templates meet their pages in a shuffle
        joined = hosted.join(F.broadcast(found), "host", "left")
    else:
        salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        hosted = hosted.withColumn("salt", F.pmod(F.xxhash64(names["page_id"], names["url"]), F.lit(salts)).cast("int"))
        joined = hosted.join(salted, ["host", "salt"], "left")
    joined = joined.select(*names.values(), "skeleton", "repeated")
    schema = T.StructType([*pages.schema.fields, T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, skeletons, repeated = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (names["html"], "skeleton", "repeated"))
            texts = [main_text(b or "", set(s or ()), set(r or ())) for b, s, r in zip(bodies, skeletons, repeated, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names.values()), pa.array(texts, pa.string())], names=schema.fieldNames())

    return joined.mapInArrow(run, schema)
