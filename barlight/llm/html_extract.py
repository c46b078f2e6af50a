"""Main text of web pages by wrapper induction.

Pages of a host are parsed to trees of elements and each is aligned by simple tree matching with a base page: the largest set of pairs
of nodes, in order and with equal names, below equal parents. Blocks of text that a share of all pages of the host has in the matching
place are its template; the rest is content. The lowest element of the base that holds nearly all varying text is the wrapper's
content region, and the element of a page that is matched with it holds the page's content. Elements that by their name or role never
are main text (menus, forms, scripts ...) are left out on any page.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from hashlib import blake2b
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlight.session import staged

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*?)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.DOTALL)
ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?(?=\s|/|$)""", re.IGNORECASE)
SPACE = re.compile(r"\s+")
# Fixed values of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCKS = set("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCKS - {"br", "body", "html", "option", "legend", "td", "th", "tr", "tbody", "thead", "tfoot"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}}
SCOPE = set("table ul ol dl html body article section div".split())
# Elements and role words that are never main text.
LEFT_OUT = RAW | set("head nav footer aside form button select template svg canvas object audio video dialog menu label".split())
ROLES = re.compile(r"(?:^|[-_\s])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|complementary|contentinfo|cookies?|disqus|footer|masthead|menu|modal|nav(?:bar|igation)?|newsletter|notice|pagination|popup|promo\w*|recommended|related|search|share|sharing|sidebar|site-header|page-header|social|sponsor\w*|subscribe|toolbar|widget)(?=$|[-_\s])", re.IGNORECASE)
REGION = {"article", "main"}
HEADS = {"h1", "h2"}
CONTAINERS = set("article body div main section td".split())
SHARE = 0.6  # of a host's pages have a template's block; three pages at least
GROUP_PAGES = 48  # pages aligned with one base
NEARLY = 0.9  # of the varying text is in the content region
DEEPEST = 200
MOST_KNOWN = 1_000_000  # sizes of matchings, and characters of skeletons, that are kept
MOST_SHAPES = 100_000
MOST_CELLS = 1_000_000  # of a table of sizes that is kept


@dataclass
class Node:
    tag: str
    attributes: str = ""
    children: list[Node | str] = field(default_factory=list)
    shape: int = -1  # its number in Shapes


def parsed(page: str) -> Node:
    """The tree of a page. Unclosed and wrongly closed elements are mended as browsers do in the common cases."""
    root = Node("#root")
    path = [root]
    at, size = 0, len(page)
    while at < size:
        found = TAG.search(page, at)
        if found is None:
            path[-1].children.append(html.unescape(page[at:]))
            break
        if found.start() > at:
            path[-1].children.append(html.unescape(page[at : found.start()]))
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            tags = [n.tag for n in path]
            if tag in tags[1:]:
                cut = len(tags) - 1 - tags[::-1].index(tag)
                # An inline end tag doesn't close a block that is still open.
                if tag in BLOCKS or not any(t in BLOCKS for t in tags[cut + 1 :]):
                    del path[cut:]
            continue
        if not page[found.start() : at].endswith(">"):
            break  # cut off inside a tag
        if tag in ENDS_P:
            tags = [n.tag for n in path]
            if "p" in tags:
                cut = len(tags) - 1 - tags[::-1].index("p")
                if not any(t in ("table", "button", "object") for t in tags[cut:]):
                    del path[cut:]
        for _ in range(len(path)):
            closing = CLOSED_BY.get(tag, ())
            near = next((i for i in range(len(path) - 1, 0, -1) if path[i].tag in closing or path[i].tag in SCOPE), 0)
            if near and path[near].tag in closing:
                del path[near:]
            else:
                break
        node = Node(tag, found[3] or "")
        path[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            stop = end.start() if end else size
            if tag in ("textarea", "title"):
                node.children.append(html.unescape(page[at:stop]))
            at = end.end() if end else size
        elif tag not in VOID and not found[3].endswith("/") and len(path) < DEEPEST:  # deeper elements become siblings
            path.append(node)
    return root


def left_out(node: Node, inside_region: bool) -> bool:
    if node.tag in LEFT_OUT or (node.tag == "header" and not inside_region):
        return True
    if not node.attributes.strip() or node.tag in ("html", "body", "article", "main"):
        return False
    for found in ATTRIBUTE.finditer(node.attributes):
        key, value = found[1].lower(), (found[2] or "").strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True
        if key in ("class", "id", "role") and ROLES.search(value):
            return True
    return False


def blocks_of(root: Node) -> list[tuple[tuple[Node, ...], str]]:
    """Texts of blocks in page order with the elements around them; left-out elements give none."""
    out: list[tuple[tuple[Node, ...], str]] = []
    pieces: list[str] = []
    owner: list[tuple[Node, ...]] = []

    def close() -> None:
        text = SPACE.sub(" ", "".join(pieces)).strip()
        if text:
            out.append((owner[0], text))
        pieces.clear()
        owner.clear()

    def walk(node: Node, around: tuple[Node, ...], inside: bool) -> None:
        for child in node.children:
            if isinstance(child, str):
                if not owner or not "".join(pieces).strip():
                    owner[:] = [around]
                pieces.append(child)
            elif not left_out(child, inside):
                block = child.tag in BLOCKS
                if block:
                    close()
                walk(child, (*around, child), inside or child.tag in REGION)
                if block:
                    close()
            elif child.tag in BLOCKS or child.tag in LEFT_OUT - {"label", "button", "svg"}:
                close()

    walk(root, (root,), False)
    close()
    return out


class Shapes:
    """Sizes of largest matchings. What a matching counts depends on the elements' names alone, so equal trees share a number."""

    def __init__(self):
        self.numbers: dict[tuple, int] = {}
        self.tags: list[str] = []
        self.below: list[tuple[int, ...]] = []
        self.nodes: list[int] = []
        self.known: dict[tuple[int, int], int] = {}

    def number(self, node: Node) -> int:
        below = tuple(self.number(c) for c in elements(node))
        node.shape = self.numbers.setdefault((node.tag, below), len(self.tags))
        if node.shape == len(self.tags):
            self.tags.append(node.tag)
            self.below.append(below)
            self.nodes.append(1 + sum(self.nodes[c] for c in below))
        return node.shape

    def size(self, x: int, y: int) -> int:
        """Nodes in the largest matching of two trees."""
        if self.tags[x] != self.tags[y]:
            return 0
        if x == y:
            return self.nodes[x]
        if not self.below[x] or not self.below[y]:
            return 1
        found = self.known.get((x, y))
        if found is None:
            left, right, start, end = trimmed(self.below[x], self.below[y])
            found = 1 + sum(self.nodes[c] for c in self.below[x][:start] + self.below[x][len(self.below[x]) - end :])
            if left and right:
                found += int(self.row(left, right)[-1])
            if len(self.known) > MOST_KNOWN:
                self.known.clear()
            self.known[x, y] = found
        return found

    def rows(self, left: tuple[int, ...], right: tuple[int, ...]) -> Iterator[np.ndarray | list[int]]:
        """The rows of the table of sizes: for each beginning of left, with each beginning of right."""
        if len(left) * len(right) <= 1000:
            before = [0] * (len(right) + 1)
            yield before
            for x in left:
                following, most = [0], 0
                for j, y in enumerate(right):
                    most = max(most, before[j + 1], before[j] + self.size(x, y) if self.tags[x] == self.tags[y] else 0)
                    following.append(most)
                before = following
                yield before
            return
        distinct, place = np.unique(np.array(right, np.int64), return_inverse=True)
        distinct = distinct.tolist()
        gains: dict[int, np.ndarray] = {}
        row = np.zeros(len(right) + 1, np.int64)
        yield row
        for x in left:
            gain = gains.get(x)
            if gain is None:
                gain = np.array([self.size(x, y) for y in distinct], np.int64)
                if len(gains) * len(distinct) < MOST_KNOWN:
                    gains[x] = gain
            following = row.copy()
            np.maximum(row[1:], row[:-1] + gain[place], out=following[1:])
            row = np.maximum.accumulate(following)
            yield row

    def row(self, left: tuple[int, ...], right: tuple[int, ...]) -> np.ndarray | list[int]:
        """The last of the rows."""
        last = None
        for last in self.rows(left, right):
            pass
        return last

    def partners(self, left: tuple[int, ...], right: tuple[int, ...], at: int = 0, to: int = 0) -> list[tuple[int, int]]:
        """Places of the matched trees of two lists. A large table isn't kept but cut in the middle of left, where the best place of right follows from both halves."""
        if not left or not right:
            return []
        if len(left) > 1 and len(left) * len(right) > MOST_CELLS:
            half = len(left) // 2
            cut = int(np.argmax(np.asarray(self.row(left[:half], right)) + np.asarray(self.row(left[half:][::-1], right[::-1]))[::-1]))
            return self.partners(left[:half], right[:cut], at, to) + self.partners(left[half:], right[cut:], at + half, to + cut)
        best = list(self.rows(left, right))
        out = []
        i, j = len(left), len(right)
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((at + i, to + j))
        return out[::-1]


def elements(node: Node) -> list[Node]:
    return [c for c in node.children if isinstance(c, Node)]


def trimmed(left: tuple[int, ...], right: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[int, ...], int, int]:
    """What lies between the equal trees at both ends, and how many those are: they match each other in a largest matching."""
    least = min(len(left), len(right))
    start = next((i for i in range(least) if left[i] != right[i]), least)
    end = next((i for i in range(least - start) if left[-1 - i] != right[-1 - i]), least - start)
    return left[start : len(left) - end], right[start : len(right) - end], start, end


def matching(a: Node, b: Node, pairs: dict[int, Node], shapes: Shapes | None = None) -> int:
    """Simple tree matching: size of the largest matching of two trees; pairs gets the partner of each matched node of a.

    Sizes come first, from rows of tables; partners are looked up on the way down, for matched nodes only, so memory stays in proportion
    to the pages. Trees with unlike roots don't match. Pass the shapes if b has been numbered with them.
    """
    if shapes is None:
        shapes = Shapes()
        shapes.number(b)
    shapes.number(a)
    if a.tag != b.tag:
        return 0
    todo = [(a, b)]
    while todo:
        x, y = todo.pop()
        pairs[id(x)] = y
        todo += matched_children(x, y, shapes)
    return shapes.size(a.shape, b.shape)


def matched_children(x: Node, y: Node, shapes: Shapes) -> list[tuple[Node, Node]]:
    left, right = elements(x), elements(y)
    if x.shape == y.shape:
        return list(zip(left, right, strict=True))
    of_left, of_right, start, end = trimmed(shapes.below[x.shape], shapes.below[y.shape])
    out = list(zip(left[:start], right[:start], strict=True))
    out += zip(left[len(left) - end :], right[len(right) - end :], strict=True)
    return out + [(left[start + i], right[start + j]) for i, j in shapes.partners(of_left, of_right)]


def partner(root: Node, path: list[Node], shapes: Shapes) -> Node | None:
    """The node of a page that is matched with the last of a path of the base's nodes; only that path is followed."""
    shapes.number(root)
    here = root if root.tag == path[0].tag else None
    for above, below in zip(path, path[1:], strict=False):
        here = here and next((x for x, y in matched_children(here, above, shapes) if y is below), None)
    return here


def signature(around: tuple[Node, ...]) -> tuple[str, ...]:
    return tuple(n.tag for n in around)


def in_order(root: Node) -> Iterator[tuple[int, Node]]:
    """All elements with their depth, parents first."""
    todo = [(0, root)]
    while todo:
        depth, node = todo.pop()
        yield depth, node
        todo += [(depth + 1, c) for c in reversed(elements(node))]


def skeleton(root: Node) -> str:
    """The names of a tree's elements, each after its depth."""
    return " ".join(f"{depth}{node.tag}" for depth, node in in_order(root))


def from_skeleton(text: str) -> Node:
    path: list[Node] = []
    for word in text.split(" "):
        depth = re.match("[0-9]+", word)[0]
        node = Node(word[len(depth) :])
        del path[int(depth) :]
        if path:
            path[-1].children.append(node)
        path.append(node)
    return path[0]


@dataclass
class Wrapper:
    """What the pages of a host share: constant blocks (hashes); the base page's elements from its root to the one that holds the content."""

    constant: frozenset[int] = frozenset()
    region: tuple[Node, ...] = ()
    shapes: Shapes | None = None

    def with_base(self, names: str, region: int, shapes: Shapes) -> Wrapper:
        """With the base of a skeleton, numbered in shapes, and its element number `region`."""
        base = from_skeleton(names)
        shapes.number(base)
        path: list[Node] = []
        for i, (depth, node) in enumerate(in_order(base)):
            path[depth:] = [node]
            if i == region:
                break
        return Wrapper(self.constant, tuple(path), shapes)


def tagged(node: Node) -> bool:
    return node.tag in REGION or "articleBody" in node.attributes


def content_region(base: Node, varying: list[tuple[list[Node], int]]) -> Node | None:
    """The lowest element of the base that holds nearly all varying text, and nearly all headings; none if that is the body.

    varying: the base's elements around each varying block, and the block's length. An element whose name says that it is the article
    has a vote for that: half of the text is enough there, and nothing below it is tried.
    """
    mass: Counter = Counter()
    heads: Counter = Counter()
    total = 0
    for around, size in varying:
        total += size
        head = any(n.tag in HEADS for n in around)
        for n in around:
            mass[id(n)] += size
            if head:
                heads[id(n)] += size
    found, here, depth = None, base, 0
    while total:
        below = max(elements(here), key=lambda n: (mass[id(n)], tagged(n)), default=None)
        if below is None:
            break
        sure = mass[id(below)] >= NEARLY * total and heads[id(below)] >= NEARLY * heads[id(base)]
        named = tagged(below) and 2 * mass[id(below)] >= total
        if not named and (not sure or tagged(here)):
            break
        here, depth = below, depth + 1
        if depth > 2 and here.tag in CONTAINERS:
            found = here
    return found


def main_text(root: Node, wrapper: Wrapper) -> str:
    """Blocks of the content region without the template's constant ones.

    Where no region was induced, or the page has nothing in it, the page's own article or main element stands for it, else the whole page.
    """
    blocks = blocks_of(root)
    inside = []
    if wrapper.region:
        region = partner(root, wrapper.region, wrapper.shapes)
        inside = [(a, t) for a, t in blocks if any(n is region for n in a)]
    inside = inside or [(a, t) for a, t in blocks if any(tagged(n) for n in a)] or blocks
    return " ".join(t for a, t in inside if not wrapper.constant or block_key(signature(a), t) not in wrapper.constant)


def block_key(place: tuple[str, ...], text: str) -> int:
    return int.from_bytes(blake2b("\0".join((*place, text)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


FOUND = pa.schema([("host", pa.string()), ("grp", pa.int64()), ("block", pa.int64()), ("page", pa.int64()), ("matched", pa.bool_()), ("base", pa.string()), ("region", pa.int64())])


def found_blocks(group: pa.Table) -> pa.Table:
    """The blocks of every page of a group, and whether they stand in an element that is matched with one of the base; one row for base and region.

    The base is the page with most blocks that other pages have too. `page` is the hash of the longest block of a page's own, so that
    copies of an article count once.
    """
    group = group.sort_by([("order", "ascending"), ("page_id", "ascending")])
    trees = [parsed(p) for p in dict.fromkeys(p for p in group.column("html").to_pylist() if p)]
    read = [[(a, t, signature(a)) for a, t in blocks_of(tree)] for tree in trees]
    keep = [i for i, blocks in enumerate(read) if blocks]
    if not keep:
        return FOUND.empty_table()
    count = Counter(b for i in keep for b in {(s, t) for _, t, s in read[i]})
    base = max(keep, key=lambda i: sum(count[b] - 1 for b in {(s, t) for _, t, s in read[i]}))
    shapes = Shapes()
    shapes.number(trees[base])
    rows: dict[tuple[int, int], tuple] = {}
    host, grp = group.column("host")[0].as_py(), group.column("grp")[0].as_py()
    varying: dict[int, list[tuple[list[Node], int]]] = {}
    for i in keep:
        pairs: dict[int, Node] = {}
        matching(trees[i], trees[base], pairs, shapes)
        own = [(a, t) for a, t, s in read[i] if len(keep) == 1 or count[s, t] < SHARE * len(keep)]
        page = block_key((), max((t for _, t in own), key=len, default=""))
        if own and page not in varying:
            varying[page] = [([pairs[id(n)] for n in a if id(n) in pairs], len(t)) for a, t in own]
        for around, text, place in read[i]:
            key, matched = block_key(place, text), id(around[-1]) in pairs
            if matched or (key, page) not in rows:
                rows[key, page] = (host, grp, key, page, matched, None, None)
    found = list(rows.values())
    region = content_region(trees[base], [v for own in varying.values() for v in own]) if len(varying) >= 3 else None
    if region is not None:
        found.append((host, grp, None, None, None, skeleton(trees[base]), next(i for i, (_, n) in enumerate(in_order(trees[base])) if n is region)))
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), FOUND, strict=True)], schema=FOUND)


def wrappers(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """By host with three pages at least: aligned (its distinct pages) and constant (hashes of template blocks). By group of a host: base and region."""
    kinds = "host string, grp bigint, block bigint, page bigint, matched boolean, base string, region bigint"
    found = staged(rows.filter("host <> ''").groupBy("host", "grp").applyInArrow(found_blocks, kinds))
    blocks = found.filter("block is not null")
    pages = staged(blocks.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("aligned")).filter("aligned >= 3"))
    # Copies in several groups count once. Sums are made before anything moves.
    once = blocks.groupBy("host", "block", "page").agg(F.max("matched").alias("matched"))
    shared = once.groupBy("host", "block").agg(F.count_if("matched").alias("pages")).filter("pages >= 3").join(pages, "host")
    constant = shared.filter(F.col("pages") >= SHARE * F.col("aligned")).groupBy("host").agg(F.collect_list("block").alias("constant"))
    hosts = staged(pages.join(constant, "host", "left").select("host", F.col("aligned").cast("int").alias("aligned"), "constant"))
    return hosts, staged(found.filter("base is not null").select("host", "grp", "base", "region"))


EXTRACTED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("aligned", pa.int32())])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page, and how many pages its host's wrapper was induced from.

    Hosts are dealt out in groups of about GROUP_PAGES pages; a group aligns all its pages with its base and finds the content region there;
    constant blocks are counted over the whole host. A page is aligned with its group's base again when it is read. Pages whose url is null or names no host have no
    wrapper. Null html is empty, and an empty page has an empty text. Rows that repeat are read each; other columns are ignored.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"))
    ordered = given.withColumn("order", F.xxhash64("page_id", "url"))
    # One row for each host, written first: the planner broadcasts it only if it is small, else shuffles both sides.
    sizes = staged(ordered.groupBy("host").agg(F.ceil(F.count("*") / GROUP_PAGES).alias("groups")))
    rows = ordered.join(sizes, "host").withColumn("grp", F.pmod("order", F.col("groups"))).drop("groups")
    hosts, bases = wrappers(rows.select("host", "grp", "order", "page_id", "html"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_host: dict[str, Wrapper] = {}
        by_group: dict[tuple[str, int], Wrapper] = {}
        shapes, held = Shapes(), 0  # held: characters of skeletons

        def known(host: str, grp: int, constant: pa.Scalar, base: pa.Scalar, region: pa.Scalar) -> Wrapper:
            nonlocal shapes, held
            if host not in by_host:
                if len(by_host) > 1000:
                    by_host.clear()
                by_host[host] = Wrapper(frozenset(constant.as_py() or ()))
            if not base.is_valid:
                return by_host[host]
            if (host, grp) not in by_group:
                held += len(base.as_py())
                if held > MOST_KNOWN or len(shapes.tags) > MOST_SHAPES:
                    by_group.clear()
                    shapes, held = Shapes(), len(base.as_py())
                by_group[host, grp] = by_host[host].with_base(base.as_py(), region.as_py(), shapes)
            return by_group[host, grp]

        for batch in batches:
            of = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
            texts = []
            for i in range(batch.num_rows):
                wrapper = known(of["host"][i].as_py(), of["grp"][i].as_py(), of["constant"][i], of["base"][i], of["region"][i])
                texts.append(main_text(parsed(of["html"][i].as_py() or ""), wrapper))
            yield pa.RecordBatch.from_arrays([of["page_id"], of["url"], pa.array(texts, pa.string()), of["aligned"].fill_null(0)], schema=EXTRACTED)

    read_with = rows.join(hosts, "host", "left").join(bases, ["host", "grp"], "left")
    return read_with.select("page_id", "url", "html", "host", "grp", "aligned", "constant", "base", "region").mapInArrow(read, "page_id bigint, url string, text string, aligned int")
