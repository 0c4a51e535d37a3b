"""HTML extraction with site template removal.

1. Each page becomes a tree, and its article is found. Outside the article every block-level subtree is
   hashed by its skeleton: tags, classes and ids, where children that follow each other and are alike count
   once, so that a menu is one template however many entries it has. Inside the article, and on pages that
   have none, a subtree is hashed with its text, so that only what stands there word for word recurs;
   paragraphs and headings of an article are never hashed.
2. Spark counts, for each host and each section of it (the first segment of the path), the pages that
   have a subtree. One that stands on MIN_PAGES pages and MIN_SHARE of the pages at least, of the host
   or of the section, or on MANY pages whatever their share, belongs to the template of these pages.
3. Templates are deleted from each page; what is left is the text. Nothing but these counts takes menus,
   headers, footers and the like off a page. Inside an article, an element goes besides that is no part of
   one by its tag or role, or is named exactly as an advert, share box or reader comments: these differ
   from page to page.
4. Only where counts can say nothing, on hosts of fewer than FEW pages and on pages without an article, the
   names of tags, roles and classes decide what is furniture.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import freeing, small, staged, table
from .op2_bpe import _slices

MIN_PAGES, MIN_SHARE, MANY = 5, 0.5, 1000
#: Pages from which on a host's own counts decide what is furniture.
FEW = 5
#: Every page with an article has this as a subtree: it is a template where its host has FEW pages.
PAGE = 0
#: Pages from which on a template is joined by broadcast; there are few of these, and each is on very many rows.
HOT = 50_000
#: Such templates are broadcast up to so many; a corpus has fewer than its subtrees by HOT.
FREQUENT = 1_000_000
#: Elements that show nothing, or ask instead of tell.
MUTE = set("script style noscript template head iframe svg canvas object embed audio video map form button select textarea dialog".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
NOT_P = BLOCK - {"p"}
#: What a start tag closes first, up to one of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "option": ({"option"}, {"select"}),
}
FURNITURE_TAGS = set("nav footer aside form script style noscript iframe button select textarea template svg canvas head dialog menu object embed audio video map".split())
FURNITURE_ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
FURNITURE_NAMES = re.compile(
    r"(?:^|[-_\s])(?:ads?|adverts?|advertisements?|adsense|banners?|sponsor(?:ed|s)?|promos?|promotions?|cookies?|consent|gdpr|notices?|alerts?|sidebars?|menus?|nav|navbar|navigation|breadcrumbs?"
    r"|comments?|commentlist|disqus|replies|reply|respond|footer|masthead|share|sharing|social|related|recommended|newsletter|subscribe|subscription|popup|modal|overlay|widgets?|toolbar|pagination|pager|login|signup|search)(?:$|[-_\s])"
)
#: Classes and ids that are no part of an article even inside one.
FOREIGN = set("ad ads advert adverts advertisement advertisements adsense sponsored share sharing share-buttons social social-share comments comment-list commentlist disqus disqus_thread cookie-notice newsletter newsletter-signup".split())
PROSE = set("p h1 h2 h3 h4 h5 h6 pre blockquote".split())


class Node:
    __slots__ = ("attrs", "children", "tag", "up")

    def __init__(self, tag: str, attrs: str, up: Node | None):
        self.tag, self.attrs, self.up, self.children = tag, attrs, up, []

    def named(self) -> dict[str, str]:
        return {k.lower(): entities.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(self.attrs)} if self.attrs.strip() else {}


def parse(page: str) -> Node:
    """A tree of the page, in the manner of browsers for what they forgive: open tags are closed where
    the next one asks for it, stray end tags are passed over."""
    root = here = Node("#root", "", None)
    open_: dict[str, int] = {}  # how many elements of a name are open: what is not open is not looked for

    def leave(target: Node) -> Node:
        node = here
        while node is not target:
            open_[node.tag] -= 1
            node = node.up
        return target

    at = 0
    while True:
        m = TOKEN.search(page, at)
        stop = m.start() if m else len(page)
        if stop > at:
            here.children.append(page[at:stop])
        if m is None:
            return root
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if open_.get(tag):
                node = here
                while node.tag != tag:
                    node = node.up
                here = leave(node.up)
            elif tag == "p":
                here.children.append(Node("p", "", here))
            continue
        for tags, fence in ([({"p"}, NOT_P)] if tag in BLOCK else []) + ([CLOSES[tag]] if tag in CLOSES else []):
            here = leave(_closed(here, tags, fence, sum(open_.get(t, 0) for t in tags)))
        node = Node(tag, m[3] or "", here)
        here.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not (m[3] or "").endswith("/"):
            here = node
            open_[tag] = open_.get(tag, 0) + 1


def _closed(here: Node, tags: set[str], fence: set[str], n: int) -> Node:
    """Where a start tag goes that closes the tags open up to the fence; n: how many of them are open at all."""
    node, top = here, here
    while n and node.up is not None and node.tag not in fence:
        if node.tag in tags:
            top, n = node.up, n - 1
        node = node.up
    return top


def elements(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack += [c for c in reversed(node.children) if isinstance(c, Node)]


def furniture(node: Node, inside: bool) -> bool:
    """True for menus, adverts, notices and the like. inside: below the article, where a name says less."""
    if node.tag in FURNITURE_TAGS or node.tag == "header" and not inside:
        return True
    if not node.attrs.strip() or node.tag in ("html", "body", "article", "main"):
        return False
    a = node.named()
    if _hidden(node):
        return True
    if a.get("role", "").lower() in FURNITURE_ROLES:
        return True
    names = f"{a.get('class', '')} {a.get('id', '')}".lower()
    if inside:
        return node.tag not in PROSE and not FOREIGN.isdisjoint(names.split())
    return bool(FURNITURE_NAMES.search(names))


def _length(node: Node) -> int:
    return sum(len(c) for n in elements(node) for c in n.children if isinstance(c, str))


def article(root: Node) -> Node | None:
    """The page's article: of articles outside furniture the one with the most text, else main."""
    found: dict[str, list[Node]] = {"article": [], "main": []}
    stack = [root]
    while stack:
        node = stack.pop()
        if node is not root and furniture(node, False):
            continue
        kind = node.tag if node.tag in found else "main" if node.attrs and node.named().get("role") == "main" else None
        if kind:
            found[kind].append(node)
        if kind != "article":  # an article inside an article is its part, or a comment
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]
    best = found["article"] or found["main"]
    return max(best, key=_length, default=None)


def hashed_subtrees(root: Node, region: Node | None) -> Iterator[tuple[int, Node]]:
    """(hash, node) of every block-level subtree that can be part of a template."""
    inside = {id(n) for n in elements(region)} if region is not None else set()
    above, up = set(), region
    while up is not None:
        above.add(id(up))
        up = up.up
    digests: dict[int, bytes] = {}
    for node in reversed(list(elements(root))):
        h = hashlib.blake2b(digest_size=8)
        names = ATTRIBUTE.findall(node.attrs) if "class" in node.attrs or "id" in node.attrs else ()
        h.update((node.tag + "".join(f" {k}={v}" for k, v in names if k.lower() in ("class", "id"))).encode("utf-8", "surrogatepass"))
        outside = region is not None and id(node) not in inside
        before = None
        for c in node.children:
            if not outside:
                h.update(b"<" + digests[id(c)] if isinstance(c, Node) else b">" + " ".join(c.split()).encode("utf-8", "surrogatepass"))
            elif isinstance(c, Node) and digests[id(c)] != before:
                before = digests[id(c)]
                h.update(b"<" + before)
        digests[id(node)] = h.digest()
        if node.tag in BLOCK and node.tag not in ("html", "body", "article", "main") and id(node) not in above and not (id(node) in inside and node.tag in PROSE):
            yield int.from_bytes(h.digest(), "big", signed=True), node


def extract(page: str, templates: set[int]) -> str:
    """The page's main text: blocks joined by two line ends, white space inside a block one space.

    templates: hashes of what to delete, and PAGE if the page's host has counts to go by.
    """
    root = parse(page)
    region = article(root)
    counted = region is not None and PAGE in templates
    inside = {id(n) for n in elements(region)} if counted else set()
    gone = {id(n) for h, n in hashed_subtrees(root, region) if h in templates} if templates else set()
    blocks: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(held)).split())
        if text:
            blocks.append(text)
        held.clear()

    def dropped(node: Node) -> bool:
        if id(node) in gone or node.tag in RAW:
            return True
        if counted and id(node) not in inside:
            return node.tag in MUTE or _hidden(node)
        return furniture(node, region is not None)

    stack: list[tuple[Node | str | None, bool]] = [(root if counted else region or root, False)]
    while stack:
        node, closing = stack.pop()
        if isinstance(node, str):
            held.append(node)
        elif closing:
            flush()
        elif node is region or node is root or not dropped(node):
            if node.tag in BLOCK or node.tag == "#root":
                flush()
                stack.append((node, True))
            elif node.tag == "br":
                held.append(" ")
            stack += [(c, False) for c in reversed(node.children)]
    flush()
    return "\n\n".join(blocks)


def _hidden(node: Node) -> bool:
    if not node.attrs.strip():
        return False
    a = node.named()
    return "hidden" in a or a.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", a.get("style", "")))


def page_subtrees(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, section and the distinct hashes of each page; PAGE is one of them if the page has an article."""
    own = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), _host(F.col(url_col).cast("string")).alias("host"), _section(F.col(url_col).cast("string")).alias("section"))
    kind = own.schema["page_id"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, 2_000_000):
                lists = []
                for page in batch.column(1).to_pylist():
                    root = parse(page)
                    region = article(root)
                    lists.append([*{h for h, _ in hashed_subtrees(root, region)}, *([PAGE] if region is not None else [])])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(lists, pa.list_(pa.int64()))], ["page_id", "host", "section", "hashes"])

    return own.mapInArrow(freeing(hashed), f"page_id {kind}, host string, section string, hashes array<bigint>")


def templates_of(subtrees: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, many: int = MANY, few: int = FEW) -> DataFrame:
    """host, section, hash of the templates, and n: the pages of the section that have one."""
    parts = subtrees.groupBy("host", "section").agg(F.count(F.lit(1)).alias("pages"))
    sizes = parts.groupBy("host").agg(F.sum("pages").alias("pages"))
    counted = subtrees.select("host", "section", F.explode("hashes").alias("hash")).groupBy("host", "section", "hash").agg(F.count(F.lit(1)).alias("n"))
    common = (F.col("hash") != PAGE) & (F.col("of") >= min_pages) & (F.col("of") >= F.least(F.col("pages") * min_share, F.lit(many)))
    wide = counted.groupBy("host", "hash").agg(F.sum("n").alias("of")).join(sizes, "host")
    wide = wide.where(common | ((F.col("hash") == PAGE) & (F.col("pages") >= few))).select("host", "hash")
    wide = counted.join(wide, ["host", "hash"], "left_semi")
    local = counted.withColumn("of", F.col("n")).join(parts, ["host", "section"]).where(common).select(*counted.columns)
    return wide.unionByName(local).distinct()


def extract_pages(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, many: int = MANY, few: int = FEW, hot: int = HOT
) -> DataFrame:
    """Per row: page_id, url, text and n_chars.

    Null and empty html give an empty text; pages without a host share the empty one. Rows with one
    page_id, host and section share the subtrees to delete, which all stand in a template of theirs anyway.
    Ids may be null. Other columns are ignored, whatever their names; an empty table gives no rows. A template
    on at least hot pages of a section meets its pages by broadcast, so that no task gets them all.
    """
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    own = own.withColumns({"host": _host(F.col("url")), "section": _section(F.col("url"))})
    kind = own.schema["page_id"].dataType.simpleString()
    seen = staged(page_subtrees(own, "page_id", "url", "html"), "subtrees")
    templates = staged(templates_of(seen, min_pages, min_share, many, few), "templates")
    each, key = seen.select("page_id", "host", "section", F.explode("hashes").alias("hash")), ["host", "section", "hash"]
    frequent = small(templates.where(F.col("n") >= hot).select(*key), FREQUENT)
    met = each.join(frequent, key).unionByName(each.join(frequent, key, "left_anti").join(templates.where(F.col("n") < hot).select(*key), key))
    lists = met.groupBy("page_id", "host", "section").agg(F.collect_set("hash").alias("_gone"))
    lists = lists.select(F.col("page_id").alias("_id"), F.col("host").alias("_host"), F.col("section").alias("_section"), "_gone")
    rows = own.join(lists, own["page_id"].eqNullSafe(lists["_id"]) & (own["host"] == lists["_host"]) & (own["section"] == lists["_section"]), "left").select("page_id", "html", "url", "_gone")

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, 2_000_000):
                texts = [extract(page, set(gone or ())) for page, gone in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(freeing(extracted), f"page_id {kind}, url string, text string, n_chars long")


def _host(url):
    """The host as split_url has it, in Spark."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.substring(url, F.instr(url, "://") + 3, F.length(url)), "/", 1)).otherwise("")
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def _section(url):
    """The first segment of the path, if another one follows it; else the empty one."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*/([^/?#]+)/", 1), F.lit(""))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
