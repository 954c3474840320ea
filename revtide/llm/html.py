"""Main text of web pages by tree scoring.

The page becomes a tree of elements (forgiving: unclosed and stray tags are repaired the usual way).
Elements that never hold the article (menus, footers, forms, hidden ones, ...) are cut. Those whose class
or id says so (sidebar, comments, notice, advert, ...) are cut whatever their share of the text, unless they
enclose the article: a `main` or top heading in them, or, where the name is one of layout, an `article`. Page
builders call everything a widget, so a widget goes only if it holds no paragraph or is mostly links. Where
nothing readable would be left, the outermost cuts that hide readable text are undone.

Every paragraph then passes points for its length and commas to its ancestors: all to the nearest container,
half to the next, a third of the distance's share to the three beyond. A container's points are discounted by
its share of text inside links. Where the best container lies inside an `article` or `main`, that whole element
is kept, with all other articles of the page; otherwise the best container and, level by level up to the root,
those siblings that read like text. Menus among them (mostly links) go.

Every step is one pass over the elements in page order or back, so time is linear in the page, however deep.

Text keeps page order, a line per block; character references are decoded, white space inside a block
becomes one space, empty blocks go. NULL and empty pages, and pages of markup only, give ''. A page
without tags is one block of text. Repeated rows stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from revtide.llm import words as W
from revtide.llm.tasks import map_arrow

# Element names by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas audio video textarea select".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
CUT = frozenset("nav aside footer form button menu dialog head fieldset input option".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main "
    "menu nav ol p pre section table ul".split()
)
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
WALLS = frozenset("html body article aside blockquote div dl footer form header main nav ol section table td th ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p pre blockquote td li dd dt figcaption".split())
LISTS = frozenset("ul ol dl div section table".split())
# Words of class and id names that tell an element beside the article.
ASIDE_WORDS = "ad ads advert adverts advertisement advertising banner comment comments consent cookie cookies disqus modal newsletter " \
    "notice notices popup promo promoted remarks replies reader-comments shoutbox sponsor sponsored subscribe alert"
LAYOUT_WORDS = "breadcrumb breadcrumbs footer masthead menu nav navbar navigation pagination related share sharing sidebar social " \
    "toolbar skip topbar bottombar"
COMMENT_WORDS = frozenset("comment comments remarks replies reader-comments".split())
ASIDE, LAYOUT, WIDGET = 3, 2, 1
KINDS = {**dict.fromkeys(LAYOUT_WORDS.split(), LAYOUT), **dict.fromkeys(ASIDE_WORDS.split(), ASIDE), "widget": WIDGET}
UNLIKELY = re.compile(rf"(?<![^\s_-])(?:{'|'.join(sorted(KINDS, key=len, reverse=True))})(?![^\s_-])", re.I | re.A)
# Names that tell a state of the page, not what an element is.
STATE = re.compile(r"(?<!\S)(?:(?:has|no|not|with|without)[_-]\S*|\S*[_-](?:open|opened|closed|enabled|disabled))(?!\S)", re.I)
MOST_LINKS = 0.5  # beyond this share of its text in links an element is a menu
READABLE, LONG = 25, 80  # characters from which text outside paragraphs counts as some, as a passage
REACH = 5  # ancestors that a paragraph passes points to
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())

OPENING = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*+))")
COMMENT_END = re.compile(r"--!?>")
# A quote is read in one way only, so a scan never turns back.
ATTRIBUTES = re.compile(r"""(?>[^>"']++|"[^"]*+"|'[^']*+'|["'])*+>""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
BLANKS = re.compile(r"[\s]+")


RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in (*RAW, "title")}


class Node:
    __slots__ = ("tag", "parent", "children", "cut", "link", "story", "block", "doubt", "size", "links", "paragraphs", "marks", "level", "points", "kept")

    def __init__(self, tag: str, parent: "Node | None"):
        self.tag, self.parent = tag, parent
        self.children: list[Node | str] = []
        self.cut = parent is not None and parent.cut
        self.link = tag == "a" or (parent is not None and parent.link)
        self.story = (0 if parent is None else parent.story) | (2 if tag == "article" else 1 if tag == "main" else 0)
        self.block: Node = self if parent is None or tag not in INLINE else parent.block
        self.doubt = self.size = self.links = self.paragraphs = self.marks = self.level = 0
        self.points = 0.0
        self.kept = False


def _describe(node: Node, attributes: str) -> None:
    """Cut what never holds the article; note what its class or id makes doubtful."""
    tag, parent = node.tag, node.parent
    if node.cut:
        return
    if tag in CUT or (tag == "header" and not parent.story):
        node.cut = True
        return
    if not attributes or tag in ("body", "html", "main"):
        return
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id"):
            words = [word.lower() for word in UNLIKELY.findall(STATE.sub(" ", value))]
            kinds = [KINDS[word] for word in words if tag != "article" or word in COMMENT_WORDS]
            node.doubt = max([node.doubt, *kinds])
        elif tag == "article":
            continue
        elif name == "role" and value.lower() in ROLES:
            node.cut = True
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
            node.cut = True


class _Open:
    """The open elements. Each wall starts a new count of tags, so a look for one costs nothing."""

    def __init__(self, root: Node):
        self.nodes: list[Node] = [root]
        self.rooms: list[dict[str, int]] = [{}]
        self.walls: dict[str, int] = {}

    def push(self, node: Node) -> None:
        self.nodes.append(node)
        if node.tag in WALLS:
            self.walls[node.tag] = self.walls.get(node.tag, 0) + 1
            self.rooms.append({})
        self.rooms[-1][node.tag] = self.rooms[-1].get(node.tag, 0) + 1

    def pop(self) -> str:
        tag = self.nodes.pop().tag
        if tag in WALLS:
            self.walls[tag] -= 1
            self.rooms.pop()
        else:
            self.rooms[-1][tag] -= 1
        return tag

    def close(self, tags: tuple[str, ...]) -> None:
        """End the innermost element of these tags, if no wall stands before it, with all inside."""
        if any(self.rooms[-1].get(tag) for tag in tags):
            while self.pop() not in tags:
                pass

    def close_wall(self, tag: str) -> None:
        if self.walls.get(tag):
            while self.pop() != tag:
                pass


def parse(page: str) -> list[Node]:
    """The elements of a page in page order, the root first. Text stays as it is, character references included."""
    root = Node("html", None)
    nodes, open_ = [root], _Open(root)
    place, quoted, endless = 0, True, set()

    def text(until: int) -> None:
        if until > place:
            open_.nodes[-1].children.append(page[place:until])

    while match := OPENING.search(page, place):
        tag, begin = match[2], match.end()
        if match[0] == "<!--":
            text(match.start())
            close = COMMENT_END.search(page, begin)
            place = close.end() if close else len(page)
            continue
        ending = ATTRIBUTES.match(page, begin) if tag and quoted else None
        # Once quotes hide every later '>', they are no longer minded: each page has one such scan at most.
        quoted = quoted and (tag is None or ending is not None)
        end = ending.end() if ending else page.find(">", begin) + 1
        if not end:  # no tag ends any more: the rest is text, up to a comment that stays open
            comment = page.find("<!--", begin)
            if comment >= 0:
                text(comment)
                place = len(page)
            break
        text(match.start())
        place = end
        if tag is None:
            continue
        tag, attributes = tag.lower(), page[begin : end - 1]
        if match[1]:
            if tag in WALLS:
                open_.close_wall(tag)
            else:
                open_.close((tag,))
            continue
        if tag in RAW_END:
            if attributes.endswith("/"):
                continue
            close = None if tag in endless else RAW_END[tag].search(page, place)
            if close is None:
                endless.add(tag)
                place = len(page) if tag in ("script", "style", "title", "textarea") else place
            else:
                place = page.find(">", close.end()) + 1 or len(page)
            continue
        if tag in ("html", "body"):
            continue
        open_.close(("p", *HEADINGS) if tag in HEADINGS else ("p",) if tag in CLOSES_P else SAME.get(tag, ()))
        if open_.nodes[-1].tag == "head" and tag not in ("meta", "link", "base"):
            open_.pop()
        node = Node(tag, open_.nodes[-1])
        _describe(node, attributes)
        open_.nodes[-1].children.append(node)
        nodes.append(node)
        if tag not in VOID and not attributes.endswith("/"):
            open_.push(node)
    text(len(page))
    return nodes


def blocks(root: Node, level: int = 0) -> list[tuple[Node, str, int]]:
    """(innermost block element, text, characters inside links) of the part that is not cut, in order."""
    out: list[tuple[Node, str, int]] = []
    piece: list[str] = []
    linked = 0
    owner = root

    def close() -> None:
        nonlocal piece, linked
        line = BLANKS.sub(" ", unescape("".join(piece))).strip()
        if line:
            out.append((owner, line, min(linked, len(line))))
        piece, linked = [], 0

    stack: list[tuple[Node, int]] = [(root, 0)]
    while stack:
        here, i = stack.pop()
        if i == 0 and here.tag not in INLINE:
            close()
            owner = here
        moved = False
        for j in range(i, len(here.children)):
            child = here.children[j]
            if isinstance(child, str):
                piece.append(child)
                if here.link:
                    linked += len(child.strip())
            elif child.cut or child.level > level:
                continue
            elif child.tag == "br":
                piece.append(" ")
            elif child.children:
                stack.append((here, j + 1))
                stack.append((child, 0))
                moved = True
                break
            elif child.tag not in INLINE:
                close()
        if not moved and here.tag not in INLINE:
            close()
            owner = here.parent.block if here.parent is not None else root
    close()
    return out


def _enclosed(nodes: list[Node]) -> int:
    """Set how many doubtful elements hide each element; the number that may be undone to read anything."""
    texts = [0 if node.cut else sum(len(child.strip()) for child in node.children if isinstance(child, str)) for node in nodes]
    for node, own in zip(nodes, texts):
        node.size, node.links = own, own if node.link else 0
        node.paragraphs = int(node.tag in PARAGRAPHS)
    hides: list[bool] = []
    for node in reversed(nodes):
        hidden = False
        if node.doubt and not node.cut:
            if node.doubt == WIDGET:
                hidden = node.links > MOST_LINKS * node.size or not node.paragraphs
            else:
                hidden = not node.marks & (1 if node.doubt == ASIDE else 3)
        hides.append(hidden)
        if node.parent is not None and not node.cut:
            above = node.parent
            above.size, above.links, above.paragraphs = above.size + node.size, above.links + node.links, above.paragraphs + node.paragraphs
            if not hidden:
                above.marks |= node.marks | (1 if node.tag in ("h1", "main") else 2 if node.tag == "article" else 0)
    read: list[int] = []
    some: list[int] = []
    for node, own, hidden in zip(nodes, texts, reversed(hides)):
        if node.parent is not None:
            node.level = node.parent.level + hidden
        if own:
            some.append(node.level)
            if not node.link and (own >= READABLE or node.block.tag in PARAGRAPHS):
                read.append(node.level)
    return min(read or some or [0])


def score(nodes: list[Node], found: list[tuple[Node, str, int]]) -> None:
    """Points, text, text in links and number of passages of every element."""
    for node in nodes:
        node.size = node.links = node.paragraphs = 0
        node.points = 0.0
    for owner, line, linked in found:
        owner.size += len(line)
        owner.links += linked
        owner.paragraphs += owner.tag in PARAGRAPHS and (owner.tag != "li" or len(line) >= READABLE)
        if owner.tag in HEADINGS:
            continue
        points = (1 + line.count(",") + min(len(line) / 100, 3)) * (1 - linked / len(line))
        above = owner.parent.block if owner.parent is not None and owner.tag in PARAGRAPHS else owner
        for distance in range(REACH):
            above.points += points if distance == 0 else points / 2 if distance == 1 else points / (3 * distance)
            if above.parent is None:
                break
            above = above.parent.block
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.size += node.size
            node.parent.links += node.links
            node.parent.paragraphs += node.paragraphs


def _value(node: Node) -> float:
    return node.points * (1 - node.links / node.size) * (1.5 if node.tag in ("article", "main") else 1) if node.size else 0.0


def _menu(node: Node) -> bool:
    return node.links > MOST_LINKS * node.size


def _reads(node: Node) -> bool:
    return node.size > 0 and not _menu(node) and (node.paragraphs > 0 or node.size >= LONG or node.tag in HEADINGS)


def main_text(page: str | None) -> str:
    """The article of a page."""
    if not page:
        return ""
    nodes = parse(page)
    level = _enclosed(nodes)
    found = blocks(nodes[0], level)
    score(nodes, found)
    best = max(nodes, key=_value)
    if not best.points:
        return "\n".join(line for _, line, _ in found)
    home, above = None, best
    while above is not None:
        if above.tag in ("article", "main"):
            home = above
        above = above.parent
    beside = None  # whose own lines stay, but not all it holds
    if home is not None:
        home.kept = True
        for node in nodes:
            if node.tag == "article" and not node.parent.story and node.size and not _menu(node):
                node.kept = True
        for node in home.parent.children:
            if isinstance(node, Node) and node.tag == "h1":
                node.kept = True
    else:
        best.kept = True
        beside, here = None if best.parent is None else best.parent.block, best
        while here.parent is not None:
            for node in here.parent.children:
                if isinstance(node, Node) and node is not here and _reads(node):
                    node.kept = True
            here = here.parent
    for node in nodes[1:]:
        if node.parent.kept:
            node.kept = not (node.story == 1 and node.tag in LISTS and _menu(node))
    return "\n".join(line for owner, line, linked in found if owner.kept or (owner is beside and 2 * linked <= len(line)))


def _extract(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "_html"):
                texts = [main_text(page) for page in part.column(part.schema.get_field_index("_html")).to_pylist()]
                sizes = pa.array([len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], pa.array(texts, pa.string()), sizes], [*columns, "text", "n_chars"])

    return run


def extract_text(pages: DataFrame, *, keep: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """The kept columns, `text` and `n_chars` for every page; each page is read whole, in the scan stage."""
    rows = pages.select(*keep, pages[html].alias("_html"))
    kinds = dict(rows.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "text string", "n_chars long"])
    return map_arrow(rows, _extract(list(keep)), schema)


def op10_html_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of all `pages`."""
    return extract_text(spark.read.parquet(f"{folder}/pages.parquet"))
