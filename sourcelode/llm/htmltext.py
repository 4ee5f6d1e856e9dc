"""Main text of web pages by paths that a host's pages agree on."""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sourcelode.llm.words import emptied

_TAG = re.compile(r"<(?:!--(?P<comment>.*?)(?:-->|\Z)|!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z))", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WHITE = re.compile(r"\s+")

#: Elements without content, and elements whose content is no markup (fixed values of HTML).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
#: Elements that begin and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that end an open one of the listed kinds by beginning.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"},
}
#: Kinds of containers in which an open ``li``, ``tr`` or cell is not looked for.
SCOPES = frozenset("ul ol dl table body html article section div main".split())
#: Elements that never hold an article's text.
SKIPPED = frozenset("script style noscript template iframe object svg canvas button select textarea input nav footer aside menu dialog head title noembed noframes".split())
_NOISE_WORDS = (
    r"ad|ads|advert\w*|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side|footer|foot|masthead|"
    r"comments?|commentlist|disqus|replies|reply|cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|"
    r"related|recommend\w*|widget|toolbar|pager|pagination|search|skip|hidden|copyright|complementary|contentinfo"
)
#: Words that name the place or shape of such a part next to what it is.
_PLACE_WORDS = (
    r"\d+|site|page|main|top|bottom|left|right|inner|outer|header|head|title|body|content|bar|box|block|lists?|items?|area|zone|slot|unit|container|wrapper|wrap|"
    r"section|panel|row|column|col|form|field|input|buttons?|icons?|links?|posts?|articles?|stories|entries|thread|mobile|desktop|sticky|toggle|google|gpt|"
    r"js|primary|secondary|global|local|small|large|big|fixed|floating|inline|module|component|group|text|message|alert|policy|law|"
    r"images?|img|media|video|user|author|email|mail|news|blog|my|the|wp"
)
#: Whole names (ids, single classes, roles) of what is no article: menus, adverts, notices, comments. Names are also made
#: of a heading's or a layout's words (``related-work``, ``no-sidebar``), so every word has to be one.
_NOISE = re.compile(rf"(?:(?:{_PLACE_WORDS})[-_])*(?:{_NOISE_WORDS})(?:[-_](?:{_NOISE_WORDS}|{_PLACE_WORDS}))*", re.IGNORECASE)
#: Whole names of article elements that are comments.
_COMMENT = re.compile(rf"(?:(?:{_PLACE_WORDS})[-_])*(?:comments?|commentlist|disqus|replies|reply)(?:[-_](?:comments?|replies|reply|{_PLACE_WORDS}))*", re.IGNORECASE)
#: Blocks that hold an article's running text; their ids, as those of inline elements, say nothing of their kind.
_PROSE = frozenset("h1 h2 h3 h4 h5 h6 hgroup p pre blockquote li dt dd figure figcaption caption tr td th details summary hr address".split())
#: What says that the article is inside: the element itself or a heading.
_RANKS = {"article": 3, "main": 3, "h1": 2, "h2": 1}
#: Marks of an article's container.
_ARTICLE = re.compile(r"(?:^|[-_ ])(?:article|post|entry|content|story|body|main|text)(?:$|[-_ ])", re.IGNORECASE)


#: Whether an element is noise by its name: never, unless it holds the article, and always.
CLEAN, MARKED, COMMENTS = range(3)


@dataclass(slots=True)
class Node:
    """An element: its generalised step, its children and texts in order.

    ``size`` is the text below it that is neither noise nor in links, ``rank`` the best sign of an article
    below it, ``headed`` whether a heading or paragraph is there.
    """

    name: str
    step: str
    noise: bool
    marked: int = CLEAN
    content: list = field(default_factory=list)
    size: int = 0
    rank: int = 0
    headed: bool = False


def _generalised(value: str) -> str:
    """Class names without digits, sorted, so that numbered classes of one template agree."""
    return ".".join(sorted({c for c in (re.sub(r"\d+", "#", x) for x in value.lower().split()) if c}))


def _marked(name: str, known: dict[str, str]) -> int:
    """Whether class, id and role of an element say that it is no article."""
    if name in ("html", "body", "main") or not known:
        return MARKED if name == "form" else CLEAN
    own = known.get("id", "").strip()
    names = known.get("class", "").split()
    if any(_COMMENT.fullmatch(x) for x in names) or own and (name == "article" or name in BLOCKS and name not in _PROSE) and _COMMENT.fullmatch(own):
        return COMMENTS
    if name == "article":
        return CLEAN
    names += known.get("role", "").split()
    if own and name in BLOCKS and name not in _PROSE:
        names.append(own)
    return MARKED if name == "form" or any(_NOISE.fullmatch(x) for x in names) else CLEAN


def _node(name: str, attributes: str) -> Node:
    known: dict[str, str] = {}
    if attributes.strip(" /"):
        for key, *values in _ATTRIBUTE.findall(attributes):
            known.setdefault(key.lower(), html.unescape(next((v for v in values if v), "")))
    hidden = "hidden" in known or known.get("aria-hidden") == "true" or "display:none" in known.get("style", "").replace(" ", "").lower()
    step = name + ("." + _generalised(known["class"]) if known.get("class") else "")
    return Node(name, step, name in SKIPPED or hidden, _marked(name, known))


class _Open:
    """The open elements, with the places of each name and of the blocks, so that finding one takes no
    longer on a deep page."""

    def __init__(self, root: Node):
        self.stack, self.places, self.blocks = [root], {}, [0]

    def push(self, node: Node) -> None:
        self.places.setdefault(node.name, []).append(len(self.stack))
        if node.name in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def last(self, name: str) -> int:
        """Place of the innermost open element of a name, or 0."""
        found = self.places.get(name)
        return found[-1] if found else 0

    def close(self, at: int) -> None:
        """End the element at a place and all in it."""
        while len(self.stack) > at:
            self.places[self.stack.pop().name].pop()
            if self.blocks[-1] == len(self.stack):
                self.blocks.pop()

    def begins(self, name: str) -> None:
        """End what a beginning block ends: an open paragraph, with the inline elements in it, or an
        item or cell of the same list or table."""
        if self.stack[self.blocks[-1]].name == "p":
            self.close(self.blocks[-1])
        item = max(map(self.last, ENDS.get(name, ())), default=0)
        if item and item > max(map(self.last, SCOPES)):
            self.close(item)


def parse(page: str) -> Node:
    """Elements of a page; what is left open ends with its parent, unknown ends are passed over."""
    root = Node("", "", False)
    open_, at = _Open(root), 0
    while at < len(page):
        tag = _TAG.search(page, at)
        if tag is None:
            open_.stack[-1].content.append(page[at:])
            break
        if tag.start() > at:
            open_.stack[-1].content.append(page[at : tag.start()])
        at = tag.end()
        if tag["cdata"]:
            open_.stack[-1].content.append(tag["cdata"].replace("&", "&amp;"))
        if tag["name"] is None:
            continue
        name = tag["name"].lower()
        if tag["close"]:
            place = open_.last(name)
            # The end of an inline element does not end a block around it.
            if place and (name in BLOCKS or open_.blocks[-1] <= place):
                open_.close(place)
            continue
        if name in BLOCKS:
            open_.begins(name)
        node = _node(name, tag["attributes"])
        open_.stack[-1].content.append(node)
        if name in VOID or tag["attributes"].endswith("/") and name not in BLOCKS:
            continue
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}(?=[\\s/>])[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        open_.push(node)
    _settle(root)
    return root


def _length(text: str) -> int:
    """Length of a text with white space as it is shown."""
    return 0 if text.isspace() else len(" ".join(text.split()))


def _settle(root: Node) -> None:
    """Decide which marked elements are noise.

    Classes also name layouts, so an element that holds most of the page's plain text is no noise by its
    name if the best sign of an article is in it (and it is no list of comments). A form is noise
    unless it is such an element.
    """
    order, links = [root], {id(root): False}
    for node in order:  # grows while it is read: parents before children
        inside = links.pop(id(node)) or node.name == "a"
        for part in node.content:
            if isinstance(part, str):
                node.size += 0 if inside else _length(part)
            else:
                order.append(part)
                links[id(part)] = inside
        if node.noise:
            node.size = 0
    for node in reversed(order):
        own = _RANKS.get(node.name, 0)
        for part in node.content:
            if isinstance(part, str):
                continue
            node.headed = node.headed or part.headed or part.name in ("h1", "h2", "h3", "p", "hgroup")
            if not part.noise:
                node.size += part.size if not node.noise else 0
                node.rank = max(node.rank, part.rank)
        node.rank = max(node.rank, own if node.size else 0)
    outside = {id(root): 0}
    for node in order:
        beyond = outside.pop(id(node))
        children = [p for p in node.content if not isinstance(p, str)]
        ranks = sorted((p.rank for p in children if not p.noise and p.marked == CLEAN), reverse=True)[:2] + [0, 0]
        for part in children:
            clean = not part.noise and part.marked == CLEAN
            other = max(beyond, ranks[1] if clean and part.rank == ranks[0] else ranks[0])
            outside[id(part)] = other
            if part.marked and not part.noise:
                part.noise = part.marked == COMMENTS or 2 * part.size <= root.size or part.rank < other


def blocks(node: Node, out: list[str] | None = None) -> list[str]:
    """Texts of the blocks below a node, without what is marked as no article."""
    held: list[str] = []
    out = [] if out is None else out

    def flush():
        text = _WHITE.sub(" ", html.unescape("".join(held))).strip()
        held.clear()
        if text:
            out.append(text)

    work: list = [iter(node.content)]
    ends: list[bool] = []
    while work:
        part = next(work[-1], None)
        if part is None:
            work.pop()
            if ends and ends.pop():
                flush()
            continue
        if isinstance(part, str):
            held.append(part)
        elif part.noise or part.name == "header" and not part.headed:
            flush()
        elif part.name == "br":
            held.append(" ")
        else:
            block = part.name in BLOCKS
            if block:
                flush()
            work.append(iter(part.content))
            ends.append(block)
    flush()
    return out


def _path(above: bytes, step: str) -> bytes:
    """A path is known by a digest of the path above and its last step, so a deep one costs no more."""
    return hashlib.blake2b(above + step.encode("utf-8", "surrogatepass"), digest_size=12).digest()


def containers(root: Node) -> tuple[list[tuple[bytes, float, Node]], dict[int, tuple[Node, bytes]]]:
    """Containers with their generalised paths and scores, in page order; and of every element that
    is no noise, by its ``id()``, the element around it with that one's path.

    The score is the text of the blocks that a container holds by itself or in its blocks,
    less what links hold, with half of a nested container's passed on to the one around it.
    """
    found: list[tuple[bytes, float, Node]] = []
    around: dict[int, tuple[Node, bytes]] = {}

    def visit(start: Node) -> None:
        # (node, path, text length, link length, passed on by children) without recursion
        stack: list[list] = [[start, b"", iter(start.content), 0.0]]
        links = 0
        while stack:
            node, path, rest, score = stack[-1]
            part = next(rest, None)
            if part is None:
                stack.pop()
                if node.name == "a":
                    links -= 1
                if not stack:
                    break
                if node.name in CONTAINERS:
                    bonus = (1.5 if node.name in ("article", "main") else 1.0) * (1.2 if _ARTICLE.search(node.step.replace(".", " ")) else 1.0)
                    found.append((path, score * bonus, node))
                    stack[-1][3] += 0.5 * score
                else:
                    stack[-1][3] += score
                continue
            if isinstance(part, str):
                size = _length(part)
                stack[-1][3] += -size if links else size
            elif not part.noise:
                links += part.name == "a"
                around[id(part)] = (node, path)
                stack.append([part, _path(path, part.step), iter(part.content), 0.0])

    visit(root)
    return found, around


#: Pages of a host meet its paths in this many groups, so that a host with a third of the pages is no single one.
SALTS = 64
#: Elements that can hold an article.
CONTAINERS = frozenset("article main section div td body center".split())


def _added(node: Node, inner: Node) -> tuple[int, int, bool]:
    """What a node has besides one of its children: lengths of plain and of link text, and whether a
    heading is there; without noise."""
    size, linked, heading, links = 0, 0, False, 0
    stack = [(node, iter(node.content))]
    while stack:
        of, rest = stack[-1]
        part = next(rest, None)
        if part is None:
            stack.pop()
            links -= of.name == "a" and bool(stack)
        elif isinstance(part, str):
            length = _length(part)
            size, linked = (size, linked + length) if links else (size + length, linked)
        elif part is not inner and not part.noise and not (part.name == "header" and not part.headed):
            heading = heading or part.name in ("h1", "h2")
            links += part.name == "a"
            stack.append((part, iter(part.content)))
    return size, linked, heading


def whole(path: bytes, node: Node, around: dict[int, tuple[Node, bytes]]) -> tuple[bytes, Node]:
    """The container of the whole article around a page's best container.

    It is the outermost ``article`` around it, else the innermost ``main``. Without these it is the
    lowest ancestor that adds text which is not mostly links, and a higher one while no headline
    (h1, h2) is in it; ``body`` only for a headline that nothing else has.
    """
    chain = [(path, node)]
    while (up := around.get(id(chain[-1][1]))) is not None and up[0].name:
        chain.append((up[1], up[0]))
    articles = [x for x in chain if x[1].name == "article"]
    if articles:
        return articles[-1]
    if mains := [x for x in chain if x[1].name == "main"]:
        return mains[0]
    reached, heading = chain[0], _added(node, node)[2]
    for (_, inner), (path, outer) in zip(chain, chain[1:]):
        if outer.name in ("body", "html") and heading:
            break
        size, linked, more = _added(outer, inner)
        if size <= linked:
            if linked:
                break
            continue
        heading = heading or more
        if outer.name in CONTAINERS and (outer.name != "body" or heading):
            reached = (path, outer)
            if heading:
                break
    return reached


def best_path(page: str) -> tuple[str, float]:
    """Path (hex digits) of the whole article around the page's best container, and that one's score; the
    empty path without one."""
    found, around = containers(parse(page))
    path, score, node = max(found, key=lambda x: x[1], default=(b"", 0.0, None))
    return (whole(path, node, around)[0].hex(), score) if score > 0 else ("", 0.0)


def extract(page: str, paths: list[str]) -> str:
    """Blocks below the first of ``paths`` that the page has with text, else below the article around
    its own best container, else of the whole page."""
    root = parse(page)
    by_path: dict[str, list[Node]] = {}
    found, around = containers(root)
    for path, _, node in found:
        by_path.setdefault(path.hex(), []).append(node)
    path, score, node = max(found, key=lambda x: x[1], default=(b"", 0.0, root))
    own = whole(path, node, around)[1] if score > 0 else root
    for path in paths:
        out = [b for node in by_path.get(path, ()) for b in blocks(node)]
        if out:
            return "\n".join(out)
    return "\n".join(blocks(own))


def host_of(url):
    """Host of a URL column, lower-cased, without user, port and ``www``; empty if there is none."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(host, r"^www\.", "")


def host_paths(pages: DataFrame, keep: int = 3) -> DataFrame:
    """host, paths: the ``keep`` paths with the most votes of each host's pages, best first.

    Every page votes for the path of the article around its best container. Votes are summed inside tasks before they
    meet, so a host with most of the pages costs no more than another.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [best_path(page.as_py() or "")[0] for page in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["host", "path"])

    votes = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, path string")
    votes = votes.where("path <> ''").groupBy("host", "path").agg(F.count("*").alias("votes"))
    order = Window.partitionBy("host").orderBy(F.desc("votes"), "path")
    ranked = votes.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= keep)
    return ranked.groupBy("host").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "path"))), lambda x: x["path"]).alias("paths"))


def extract_pages(pages: DataFrame, keep: int = 3) -> DataFrame:
    """``pages`` (page_id, url, html) as page_id, url and ``text``, the article of each whole page.

    A page gives the blocks below the path its host agrees on. If it has no such container it
    falls back to the host's next paths and then to its own best container. NULL or empty html,
    and a page without text, give the empty text; a NULL url votes with all others that have no
    host. Repeated rows are rows of their own, other columns are not read.
    """
    salt = lambda: F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    paths = host_paths(pages, keep).withColumn("salt", salt())
    marked = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"), F.pmod(F.xxhash64("page_id", "url", "html"), F.lit(SALTS)).cast("int").alias("salt"))
    joined = marked.join(paths, ["host", "salt"], "left").select("page_id", "url", "html", "paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with emptied():
            for batch in batches:
                for start in range(0, len(batch), 256):
                    part = batch.slice(start, 256)
                    texts = [extract(page.as_py() or "", paths.as_py() or []) for page, paths in zip(part.column(2), part.column(3), strict=True)]
                    yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return joined.mapInArrow(run, pages.select("page_id", "url").schema.add("text", "string"))
