"""Main text of web pages by composite text density.

Every page is parsed on its own, so the operator is one narrow ``mapInArrow``
over the pages: no shuffle, nothing kept between pages. Parsing and measuring are
loops without recursion, in time proportional to the page.

1. What is not the page's text is left out: elements whose tag or role says so
   (``nav``, ``footer``, ``aside``, ``form``, a page's ``header``, hidden ones, ...), and
   those with a name for it as ``class`` or ``id`` (``ad``, ``comments``, ``cookie-banner``,
   ``related-posts``; not ``has-sidebar`` or ``related-work``, see :func:`noise_name`).
2. For each element left: characters, tags, link characters and link tags of its
   subtree give the link-adjusted characters per tag (composite text density). Its
   density sum adds up its children's densities; text that stands directly in a
   container counts as a child. Paragraphs, headings and marks inside them are no containers.
3. The container with the largest sum in ``body`` marks the page's text, and the smallest
   density on its path up to ``body`` is the threshold. The element grows to its parent
   while the parent's other children reach the threshold, or hold little text (``REST``)
   and no lists of links. Elements elsewhere that reach the threshold, and ``h1``, are
   parts of the text as well. Within what is chosen nothing else is dropped.

If what names alone leave out has by far the larger sum (``OUTWEIGHS``), and it is not
readers' comments, the names are taken for those of wrappers and it stays.

Defined results: null, empty or text-free html gives an empty text; unclosed,
stray or wrongly nested tags are mended as browsers do for paragraphs, lists and
tables; repeated rows are treated alike; other columns, whatever their names, are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as _html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .runtime import named, tidy

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
TAG_PUNCTUATION = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not markup; all of it is left out.
RAW = frozenset("script style title textarea iframe noembed noframes xmp template noscript".split())
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>", re.I) for name in RAW}
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES_P = BLOCK - frozenset("body html td th tr tbody thead tfoot caption".split())
#: An open paragraph outside of these is not closed by a block inside.
P_SCOPE = frozenset("button table td th".split())
#: start tag -> (tags it closes, tags beyond which it closes nothing)
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "thead": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "option": (("option",), ("select", "datalist")),
}
#: Text directly in these counts as a child of theirs.
CONTAINER = frozenset("#root html body main article section div center details fieldset figure blockquote td".split())
NOISE_TAGS = frozenset("head nav footer aside form button select datalist menu dialog svg canvas object audio video".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
COMMENT_NAMES = frozenset("comment comments disqus reply replies respond".split())
NOISE_NAMES = COMMENT_NAMES | frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead share sharing social login search toolbar pagination pager copyright widget banner".split()
)
#: Such a word beside a noise word keeps its meaning: ``ad-box``, ``top-menu``.
BESIDE = frozenset(
    "area bar block blocks body bottom box btn button buttons card cell column content container divider embed form frame global group header holder icon inline inner item items layer left links list main mobile module msg message outer panel "
    "page primary right row section secondary site slot space sticky text thread title top unit user widget wrap wrapper zone 1 2 3 4 5".split()
)
PAGE_LINKS = frozenset("posts articles stories news links content products items reading".split())
WORDS_IN_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: Share of an element's characters that other children may hold below the threshold.
REST = 0.2
OUTWEIGHS = 8


class Node:
    __slots__ = ("tag", "parent", "kids", "depth", "own", "noise", "named", "comments", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None) -> None:
        self.tag, self.parent, self.kids = tag, parent, []
        self.depth = parent.depth + 1 if parent else 0
        self.own = bool(parent) and (parent.own or parent.tag in ("article", "main"))
        self.noise = self.named = self.comments = False
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def noise_name(name: str) -> str | None:
    """The noise word in one class or id, if it names the element itself: the word alone, or beside words of layout."""
    words = [w.lower() for w in WORDS_IN_NAME.findall(name)]
    found = [w for w in words if w in NOISE_NAMES]
    if found and all(w in NOISE_NAMES or w in BESIDE for w in words):
        return found[0]
    if len(words) == 2 and words[0] in ("related", "recommended", "popular", "latest", "more") and words[1] in PAGE_LINKS:
        return words[0]
    return None


def _mark(node: Node, attributes: str) -> None:
    """Set ``noise``, and ``named`` where only a name says so."""
    tag = node.tag
    if tag in NOISE_TAGS or (tag == "header" and not node.own):
        node.noise = True
        return
    if not attributes or tag in ("html", "body", "main", "article"):
        return
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            for name in value.split():
                word = noise_name(name)
                if word and not (node.own and word == "banner"):
                    node.named = True
                    node.comments |= word in COMMENT_NAMES
        elif (key == "role" and value.strip().lower() in NOISE_ROLES) or key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "").lower()):
            node.noise = True
    node.named &= not node.noise
    node.noise |= node.named


def _tag_end(page: str, at: int, unclosed: set[str]) -> int:
    """The place of a start tag's ``>``, quoted values passed over; -1 where it has none. ``unclosed``: quotes known not to come again."""
    while m := TAG_PUNCTUATION.search(page, at):
        quote, at = m[0], m.end()
        if quote == ">":
            return m.start()
        if quote not in unclosed and page[max(0, m.start() - 64) : m.start()].rstrip().endswith("="):
            close = page.find(quote, at)
            if close < 0:
                unclosed.add(quote)
            else:
                at = close + 1
    return -1


def parse(page: str) -> Node:
    """The tree below a root node; text is kept as strings among ``kids``."""
    root = node = Node("#root", None)
    open_nodes: dict[str, list[Node]] = {}
    scopes: list[Node | None] = [None]  # for each P_SCOPE element around: its open paragraph
    unclosed: set[str] = set()
    at, end = 0, len(page)

    def close(to: Node) -> None:
        nonlocal node
        while node is not to:
            open_nodes[node.tag].pop()
            if node.tag in P_SCOPE:
                scopes.pop()
            elif node is scopes[-1]:
                scopes[-1] = None
            node = node.parent

    def depth_of(tags: tuple[str, ...]) -> int:
        return max((own[-1].depth for t in tags if (own := open_nodes.get(t))), default=0)

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            node.kids.append(page[at:])
            break
        mark = page[lt + 1 : lt + 2]
        closing = mark == "/"
        m = NAME.match(page, lt + 1 + closing)
        if m is None and mark not in ("!", "?", "/"):
            node.kids.append(page[at : lt + 1])  # a plain <
            at = lt + 1
            continue
        if lt > at:
            node.kids.append(page[at:lt])
        if m is None:
            comment = page.startswith("<!--", lt)
            over = page.find("-->", lt + 4) if comment else page.find(">", lt)
            if over < 0:
                break
            at = over + (3 if comment else 1)
            continue
        name = m[0].lower()
        over = page.find(">", m.end()) if closing else _tag_end(page, m.end(), unclosed)
        if over < 0:
            break  # a tag that never ends
        at = over + 1
        if closing:
            if own := open_nodes.get(name):
                close(own[-1].parent)
            continue
        attributes = page[m.end() : over]
        if name in RAW:
            if not attributes.endswith("/"):
                found = RAW_END[name].search(page, at)
                at = found.end() if found else end
            continue
        if name in CLOSES_P and scopes[-1] is not None:
            close(scopes[-1].parent)
        if name in IMPLIED:
            closed, beyond = IMPLIED[name]
            least = depth_of(beyond)
            outer = [n for t in closed for n in _above(open_nodes.get(t), least)]
            if outer:
                close(min(outer, key=lambda n: n.depth).parent)
        kid = Node(name, node)
        _mark(kid, attributes)
        node.kids.append(kid)
        if name not in VOID:
            node = kid
            open_nodes.setdefault(name, []).append(kid)
            if name in P_SCOPE:
                scopes.append(None)
            elif name == "p":
                scopes[-1] = kid
    return root


def _above(nodes: list[Node] | None, least: int) -> Iterator[Node]:
    for n in reversed(nodes or ()):
        if n.depth <= least:
            return
        yield n


def _walk(root: Node) -> list[Node]:
    """The nodes that are not noise, each before its own descendants."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(k for k in reversed(node.kids) if not isinstance(k, str) and not k.noise)
    return order


def _visible(text: str) -> int:
    return len(" ".join(text.split()))


def density(chars: int, tags: int, link_chars: int, link_tags: int, body_share: float) -> float:
    """Characters per tag, times a logarithm that falls as links take up more of them.

    The logarithm's base is e at least: with few links the composite formula's base comes
    near 1, where it has no bound.
    """
    if chars == 0:
        return 0.0
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + body_share * chars + math.e)
    inside = (chars / max(link_chars, 1)) * (max(tags, 1) / max(link_tags, 1))
    return chars / max(tags, 1) * max(math.log(max(inside, 1.0)), 0.0) / max(math.log(base), 1.0)


def measure(order: list[Node]) -> None:
    """Counts, densities and density sums, from the leaves up."""
    direct: dict[int, int] = {}
    for node in reversed(order):
        chars = sum(_visible(k) for k in node.kids if isinstance(k, str))
        direct[id(node)] = node.chars = chars
        node.tags = node.link_chars = node.link_tags = 0
        for kid in node.kids:
            if not isinstance(kid, str) and not kid.noise:
                node.chars += kid.chars
                node.tags += kid.tags + 1
                node.link_chars += kid.link_chars
                node.link_tags += kid.link_tags + (kid.tag == "a")
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags
    top = next((n for n in order if n.tag == "body"), order[0])
    share = top.link_chars / max(top.chars, 1)
    for node in order:
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, share)
    for node in order:
        if node.tag in CONTAINER:
            node.total = density(direct[id(node)], 1, 0, 0, share) + sum(k.density for k in node.kids if not isinstance(k, str) and not k.noise)


def _largest(order: list[Node]) -> tuple[Node, Node]:
    """(body, the container in it with the largest density sum; of equal ones the innermost)."""
    body = next((n for n in order if n.tag == "body"), order[0])
    return body, max((n for n in reversed(_walk(body)) if n.tag in CONTAINER and n.chars), key=lambda n: n.total, default=body)


def _links(node: Node) -> bool:
    return node.link_tags >= 3 and 2 * node.link_chars > node.chars


def chosen(root: Node) -> list[Node]:
    """The parts of the page's text, in its order."""
    order = _walk(root)
    measure(order)
    body, best = _largest(order)
    path = [best]
    while path[-1] is not body:
        path.append(path[-1].parent)
    threshold = min(n.density for n in path)
    top = best
    while top is not body:
        others = [k for k in top.parent.kids if not isinstance(k, str) and not k.noise and k is not top and k.chars]
        low = [k for k in others if k.density < threshold]
        if any(map(_links, low)) or sum(k.chars for k in low) > REST * top.parent.chars:
            break
        top = top.parent
    above, out, todo = set(map(id, path)), [], [body]
    while todo:
        node = todo.pop()
        if node is top or (id(node) not in above and node.chars and (node.density >= threshold or node.tag == "h1")):
            out.append(node)
        elif id(node) in above:
            todo.extend(k for k in reversed(node.kids) if not isinstance(k, str) and not k.noise)
    return out


def _reclaim(root: Node) -> None:
    """Elements that only their names mark as noise, but that outweigh all else, are noise no more."""
    names, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.named:
            names.append(node)
        todo.extend(k for k in node.kids if not isinstance(k, str) and (k.named or not k.noise))
    if not names:
        return
    order = _walk(root)
    measure(order)
    without = _largest(order)[1].total
    for node in names:
        node.noise = node.comments
    order = _walk(root)
    measure(order)
    body, best = _largest(order)
    keep: set[int] = set()
    if best.total > OUTWEIGHS * without:
        while best is not None:
            keep.add(id(best))
            best = best.parent
    for node in names:
        node.noise = id(node) not in keep


def _blocks(roots: list[Node]) -> list[str]:
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        if text:
            out.append(text)
        line.clear()

    todo: list[Node | str | None] = list(reversed(roots))
    while todo:
        item = todo.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            line.append(_html.unescape(item) if "&" in item else item)
        elif item.tag in VOID:
            line.append(" ") if item.tag != "hr" else flush()
        elif not item.noise:
            if item.tag in BLOCK:
                flush()
                todo.append(None)
            todo.extend(reversed(item.kids))
    flush()
    return out


def extract(page: str | None) -> str:
    """The page's main text, blocks joined by an empty line."""
    if not page:
        return ""
    root = parse(page)
    _reclaim(root)
    return "\n\n".join(_blocks(chosen(root)))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``."""
    slim = pages.select(named(id_col).alias("page_id"), named(url).alias("url"), named(html).alias("html"))
    schema = "page_id bigint, url string, text string, n_chars bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [extract(x) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id").cast(pa.int64()), part.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    ["page_id", "url", "text", "n_chars"],
                )

    return slim.mapInArrow(tidy(run), schema)
