"""HTML main-text extraction by wrapper induction.

Pages of one host come from one template. Each page becomes a DOM tree, and that a folded tree: a block
without blocks inside is a leaf, so is what stands between blocks, and neighbours of one label (element and
classes) that are leaves or built alike are one repeated node.

1. A host's wrapper tree is the folded tree that most of its different pages have (ties: the least in order).
2. All different pages of the host are aligned with it by simple tree matching: nodes match if their labels and
   their parents do, without crossings, so that as many as possible match. Siblings of one label may be up to
   `BAND` places apart.
   An alignment depends on shapes only, so it is made once for each different shape of a host, and a page is read twice
   in all: for its shape and the hashes of its texts, and for its text.
3. A text at a node that `CONSTANT_SHARE` of the pages have, each counted once however often it has it, is template;
   the others are slots. (Texts at nodes that match nothing are counted by their path of labels and places.) Where slots hold text outside
   links is where content is: the wrapper's region is the smallest element with `REGION_SHARE` of it, each page counting alike.
4. A page's text is that of the slots in its element that matches the region, and of its h1 headings.

Names come second. Elements that are never article text by element or by class, id or role (menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles, reader comments) don't count when the region is looked for and are left out inside it,
but for classes, ids and roles only if they hold less than half of the page's text. An article or main element, where
the page marks one, bounds what counts, and is the region where the wrapper's is inside of it. Without a wrapper (fewer than `LEAST_PAGES` different pages) or a match of its region, the
names alone decide. `names=False` turns them off.

Only hashes and folded trees are sent, counted by partial aggregation, so a host with a third of all pages is no
large task. Wrappers are joined by broadcast if all of them together are under `BROADCAST_BYTES`, which is checked; else those of
hosts with more than a 1024th of the pages are, and the rest by host.

Cases: null and empty pages give empty text; a null url is the host ``; unclosed elements end with their parent; a tag that never
ends is text; elements nested over `DEPTH` deep become siblings, as in browsers; markup of any length is read whole in
time that grows with its length; repeated pages give equal rows and count once (by 64 bits of hash); extra columns are ignored; empty tables give
empty results.
"""

from __future__ import annotations

import functools
import html
import json
import re
from bisect import bisect_left

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import common

LEAST_PAGES = 3
CONSTANT_SHARE, REGION_SHARE = 0.75, 0.75
BAND, DEPTH = 8, 512
BROADCAST_BYTES = 16 << 20

#: Fixed: HTML's element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"br", "body", "html"}
NEVER = frozenset("head script style noscript template iframe object svg math canvas nav header footer aside form button select textarea input label dialog menu".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
#: Fixed: what ends an open element of the same kind.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_BOUNDS = frozenset("ul ol dl table article section div body main".split())
#: Fixed: words of classes, ids and roles of what is not article text.
MARKS = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notices?|alert|nav\w*|menu|breadcrumbs?|sidebar|side|header|masthead|footer|comments?|replies|disqus|share|social|related|newsletter|subscribe|popup|modal|widget|search|login|complementary|contentinfo|navigation)(?=$|[\s_-])", re.I)
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+)>""")
_NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Blocks that are inner nodes even without a block inside, and leaves that can be a region.
_ALWAYS_INNER, _GENERIC = frozenset(("article", "main", "section", "body")), frozenset(("div", "td", "pre"))
_DIGITS = re.compile(r"\d+")


class Node:
    """An element or, with the name "", a text. inner: a block is inside; size: characters of text outside links."""

    __slots__ = ("children", "inner", "label", "marked", "name", "never", "size", "text")

    def __init__(self, name: str, label: str = "", marked: bool = False, text: str | None = None):
        self.name, self.label, self.marked, self.text = name, label, marked, text
        self.never, self.inner, self.size, self.children = False, False, 0, []


def parse(page: str, names: bool = True) -> Node:
    """A DOM tree; texts have their references decoded."""
    root = Node("#", "#")
    stack, open_, last, at, final = [root], {}, 0, page.find("<"), page.rfind(">")

    def text(s: str) -> None:
        if s:
            stack[-1].children.append(Node("", text=html.unescape(s) if "&" in s else s))

    def close(i: int) -> None:
        for x in stack[i:]:
            open_[x.name] -= 1
        del stack[i:]

    while 0 <= at < final:
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4) + 3
            end = len(page) if end < 3 else end
            text(page[last:at])
            last, at = end, page.find("<", end)
            continue
        m, after = _TAG.match(page, at), page[at + 1]
        if m is None:
            if not (after in "!?" or after.isalpha() or (after == "/" and page[at + 2 : at + 3].isalpha())):
                at = page.find("<", at + 1)
                continue
            end = page.find(">", at) + 1
            name = "" if after in "!?" else re.match(r"/?([^\s/>]*)", page[at + 1 : end])[1].lower()
            shut, attributes = after == "/", ""
        else:
            end, name, shut, attributes = m.end(), m[2].lower(), bool(m[1]), m[3]
        text(page[last:at])
        last, at = end, page.find("<", end)
        if shut:
            if open_.get(name):
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name))
            continue
        if not name:
            continue
        if name in RAW:  # never article text
            found = _raw_end(name).search(page, end)
            last = found.end() if found else len(page)
            at = page.find("<", last)
            continue
        ends = _ENDS.get(name) or (("p",) if name in CLOSES_P else ())
        if any(open_.get(x) for x in ends):
            for i in range(len(stack) - 1, max(0, len(stack) - 1 - DEPTH), -1):
                if stack[i].name in ends:
                    close(i)
                    break
                if stack[i].name in _BOUNDS:
                    break
        said = ["".join(a) for a in _NAMED.findall(attributes)] if attributes else []
        label = ".".join([name, *(_DIGITS.sub("0", x) for x in said)])
        node = Node(name, label, names and name not in ("html", "body", "article", "main") and any(map(MARKS.search, said)))
        stack[min(len(stack), DEPTH) - 1].children.append(node)
        if name not in VOID and not attributes.endswith("/"):
            stack.append(node)
            open_[name] = open_.get(name, 0) + 1
    text(page[last:])
    _measure(root, False)
    _leave_out(root, False, root.size / 2, names)
    return root


@functools.cache
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\s*>", re.I)


def _measure(node: Node, link: bool) -> None:
    size, inner = 0, False
    for c in node.children:
        if c.text is not None:
            if not link:
                c.size = len(c.text.strip())
        else:
            if c.children:
                _measure(c, link or c.name == "a")
            if c.inner or c.name in BLOCK:
                inner = True
        size += c.size
    node.size, node.inner = size, inner


def _leave_out(node: Node, never: bool, half: float, names: bool) -> None:
    for c in node.children:
        if c.text is not None:
            c.never = never
            continue
        c.never = out = never or c.name == "head" or (names and (c.name in NEVER or (c.marked and c.size <= half)))
        if c.children:
            _leave_out(c, out, half, names)


class Folded:
    """A node of a folded tree. A leaf has its instances' DOM nodes, an inner node its instances'."""

    __slots__ = ("children", "key", "label", "leaf", "nodes", "number")

    def __init__(self, label: str, leaf: bool, nodes: list):
        self.label, self.leaf, self.nodes, self.children, self.number = label, leaf, nodes, [], -1
        self.key = f".{label}" if leaf else ""

    def take(self, other: Folded) -> None:
        """Become one repeated node with a neighbour that is built alike."""
        self.nodes += other.nodes
        for x, y in zip(self.children, other.children, strict=True):
            x.take(y)


def fold(node: Node) -> Folded:
    out, between = Folded(node.label, False, [node]), []

    def add(x: Folded) -> None:
        if out.children and out.children[-1].key == x.key:
            out.children[-1].take(x)
        else:
            out.children.append(x)

    def end() -> None:
        if any(n.text is None or n.text.strip() for n in between if n.name != "br"):
            add(Folded("", True, [between.copy()]))
        between.clear()

    for c in node.children:
        if c.inner or c.name in _ALWAYS_INNER:
            end()
            add(fold(c))
        elif c.name in BLOCK and c.name != "br":
            end()
            add(Folded(c.label, True, [[c]]))
        else:
            between.append(c)
    end()
    out.key = xxhash.xxh64_hexdigest("\0".join([out.label, *(c.key for c in out.children)]))
    return out


def written(tree: Folded) -> str:
    """A folded tree's labels: (depth, label, leaf) from the root on, parents first."""
    rows, stack = [], [(tree, 0)]
    while stack:
        x, depth = stack.pop()
        rows.append((depth, x.label, int(x.leaf)))
        stack.extend((c, depth + 1) for c in reversed(x.children))
    return json.dumps(rows)


@functools.lru_cache(256)
def read(shape: str) -> list[Folded]:
    """The nodes of a written tree; a node's number is its place."""
    nodes, path = [], []
    for k, (depth, label, leaf) in enumerate(json.loads(shape)):
        x = Folded(label, bool(leaf), [])
        x.number = k
        del path[depth:]
        if path:
            path[-1].children.append(x)
        path.append(x)
        nodes.append(x)
    return nodes


def _weigh(a: Folded, b: Folded, memo: dict) -> tuple[int, list]:
    """How many nodes of two trees whose roots match do, and the matched children."""
    known = memo.get((id(a), id(b)))
    if known is not None:
        return known
    places: dict[str, list[int]] = {}
    for j, y in enumerate(b.children):
        places.setdefault(y.label, []).append(j)
    seen: dict[str, int] = {}
    # Non-crossing matches by the last child of b: those ends where a longer reach pays.
    ends, weights, links = [], [], []
    for x in a.children:
        k = seen[x.label] = seen.get(x.label, -1) + 1
        for j in reversed(places.get(x.label, ())[max(0, k - BAND) : k + BAND + 1]):
            y = b.children[j]
            at = bisect_left(ends, j)
            w = _weigh(x, y, memo)[0] + (weights[at - 1] if at else 0)
            if (at < len(ends) and ends[at] == j and weights[at] >= w) or (at and weights[at - 1] >= w):
                continue
            link = (x, y, links[at - 1] if at else None)
            upto = at
            while upto < len(ends) and weights[upto] <= w:
                upto += 1
            ends[at:upto], weights[at:upto], links[at:upto] = [j], [w], [link]
    pairs, link = [], links[-1] if links else None
    while link:
        pairs.append(link[:2])
        link = link[2]
    found = memo[id(a), id(b)] = 1 + (weights[-1] if weights else 0), pairs
    return found


def align(page: Folded, wrapper: list[Folded]) -> None:
    """Simple tree matching: matched nodes of the page get the wrapper's numbers."""
    memo: dict = {}
    _weigh(page, wrapper[0], memo)
    todo = [(page, wrapper[0])]
    while todo:
        a, b = todo.pop()
        a.number = b.number
        todo += memo[id(a), id(b)][1]


def _words(nodes: list[Node]) -> str:
    """Text with white space as in extract."""
    out, stack = [], list(reversed(nodes))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.text is not None:
            out.append(x.text)
        else:
            if x.name in BLOCK:
                out.append("\n")
                stack.append("\n")
            stack.extend(reversed(x.children))
    return " ".join("".join(out).split())


def _hash(words: str) -> int:
    h = xxhash.xxh64_intdigest(words)
    return h - (h >> 63 << 64)


def _places(tree: Folded):
    """(node, slot, number of the nearest matched node) of an aligned tree, parents first. A slot is a number, or below zero a hash of labels and places."""
    stack = [(tree, "", -1)]
    while stack:
        x, path, over = stack.pop()
        if x.number >= 0:
            path, over, slot = str(x.number), x.number, x.number
        else:
            slot = _hash(path) | -1 << 63
        yield x, slot, over
        if x.children:
            seen: dict[str, int] = {}
            down = []
            for c in x.children:
                k = seen[c.label] = seen.get(c.label, -1) + 1
                down.append((c, f"{path}/{c.label}#{k}" if c.number < 0 else "", over))
            stack.extend(reversed(down))


def _marked(root: Node) -> set[int]:
    """ids of the outermost article elements, or else main elements, that are not themselves left out."""
    for name in ("article", "main"):
        found, stack = set(), [root]
        while stack:
            node = stack.pop()
            if node.name == name and not node.never:
                found.add(id(node))
            else:
                stack.extend(node.children)
        if found:
            return found
    return set()


def _inside(root: Node, bounds: set[int]) -> set[int]:
    """ids of all nodes at and under those of bounds."""
    found, stack = set(), [(root, False)]
    while stack:
        node, own = stack.pop()
        own = own or id(node) in bounds
        if own:
            found.add(id(node))
        stack.extend((c, own) for c in node.children)
    return found


def read_page(page: str, names: bool = True) -> tuple[str, list[tuple[int, int, int]]]:
    """The page's shape, and (number in it, hash of the text, share of the page's text in millionths) of every text at a place once."""
    root = parse(page, names)
    tree = fold(root)
    own = _inside(root, _marked(root)) if names else set()
    found: dict[tuple[int, int], int] = {}
    stack, number = [tree], 0
    while stack:
        x = stack.pop()
        for nodes in x.nodes if x.leaf else ():
            if words := _words(nodes):
                key = number, _hash(words)
                found[key] = found.get(key, 0) + sum(n.size for n in nodes if not n.never and (not own or id(n) in own))
        number += 1
        stack.extend(reversed(x.children))
    total = sum(found.values()) or 1
    return written(tree), [(k, t, 1_000_000 * mass // total) for (k, t), mass in found.items()]


def matched(shape: str, wrapper: str) -> tuple[list[int], list[int]]:
    """For every number of a shape its slot by the wrapper, and the wrapper's nearest matched number."""
    nodes = read.__wrapped__(shape)
    for x in nodes:
        x.number = -1
    align(nodes[0], read(wrapper))
    found = list(_places(nodes[0]))
    return [slot for _, slot, _ in found], [over for _, _, over in found]


def region_of(shape: str, masses: dict[int, int]) -> int:
    """The smallest element of the wrapper with REGION_SHARE of the masses of its nodes; -1 for none."""
    nodes = read(shape)
    total = sum(masses.values())
    if not total:
        return -1
    whole = [masses.get(k, 0) for k in range(len(nodes))]
    for x in reversed(nodes):
        whole[x.number] += sum(whole[c.number] for c in x.children)
    at = [x.number for x in nodes if whole[x.number] >= REGION_SHARE * total and (not x.leaf or x.label.split(".")[0] in _GENERIC)]
    return at[-1] if at else -1  # each such element is inside the one before: no two apart can have so much


def extract(page: str | None, shape: str | None = None, region: int = -1, template: frozenset[tuple[int, int]] = frozenset(), names: bool = True) -> str:
    """The page's article text, by its host's wrapper if there is one."""
    if not page:
        return ""
    root = parse(page, names)
    marked = _marked(root) if names else set()
    roots, gone = set(), set()
    if shape is not None:
        tree = fold(root)
        align(tree, read(shape))
        slots = {slot for slot, _ in template}
        for x, slot, _ in _places(tree) if slots else ():
            if x.leaf and slot in slots:
                for nodes in x.nodes:
                    if (slot, _hash(_words(nodes))) in template:
                        gone.update(map(id, nodes))
        stack = [tree] if region >= 0 else []
        while stack:
            x = stack.pop()
            if x.number == region:
                roots.update(id(n) for nodes in x.nodes for n in (nodes if x.leaf else [nodes]))
            else:
                stack.extend(x.children)
    own = _inside(root, marked) if marked and roots else set()
    if not roots:
        roots = marked or {id(root)}
    elif marked and not roots & own == roots:
        roots = (roots & own) or marked  # the region is outside or around what the page marks
    elif marked:
        roots = marked  # the region is inside of it
    first_heading = not marked
    out: list[str] = []
    stack = [(root, False, False)]
    while stack:
        node, inside, done = stack.pop()
        if done or node.name in BLOCK:
            out.append("\n")
        if done or node.never or id(node) in gone:
            continue
        inside = inside or id(node) in roots or (first_heading and node.name == "h1")
        if node.text is not None:
            if inside:
                out.append(node.text)
            continue
        if node.name in BLOCK:
            stack.append((node, inside, True))
        stack.extend((c, inside, False) for c in reversed(node.children))
    return " ".join("".join(out).split())


def with_host(pages: DataFrame) -> DataFrame:
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    return pages.select("page_id", "url", "html", host.alias("host"), F.xxhash64("html").alias("hh"))


def _with(rows: DataFrame, table: DataFrame, on: list[str], broadcast_bytes: int) -> DataFrame:
    """rows with those of the checkpointed table, which has n rows of each key, if there are any."""
    size = table.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0
    return rows.join(F.broadcast(table.drop("n")), on, "left") if size <= broadcast_bytes else common.split_join(rows, table, on, "left")


def read_pages(pages: DataFrame, names: bool = True) -> DataFrame:
    """(host, shape, slots, copies): the different pages that are not empty, by read_page."""

    def run(it):
        for b in it:
            found = [read_page(p, names) for p in b.column("html").to_pylist()]
            slots = pa.array([[{"k": k, "text": t, "mass": m} for k, t, m in x] for _, x in found], pa.list_(pa.struct([("k", pa.int32()), ("text", pa.int64()), ("mass", pa.int32())])))
            yield pa.RecordBatch.from_arrays([b.column("host"), b.column("hh"), pa.array([x for x, _ in found], pa.string()), slots], ["host", "hh", "shape", "slots"])

    full = with_host(pages).where("html <> ''").select("host", "hh", "html").mapInArrow(run, "host string, hh long, shape string, slots array<struct<k:int,text:bigint,mass:int>>")
    one = full.groupBy("host", "hh").agg(F.first(F.struct("shape", "slots")).alias("x"), F.count("*").alias("copies"))
    return common.checkpoint(one.select("host", "x.shape", "x.slots", "copies"))


def wrappers(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, names: bool = True) -> DataFrame:
    """(host, n, shape, region, template) of the hosts that have a wrapper; n rows in all."""
    one = read_pages(pages, names)
    kinds = one.groupBy("host", "shape").agg(F.count("*").alias("m"), F.sum("copies").alias("copies"))
    hosts = kinds.groupBy("host").agg(F.sum("copies").alias("rows"), F.sum("m").alias("pages"), F.min(F.struct((-F.col("m")).alias("m"), "shape")).alias("x"))
    hosts = common.checkpoint(hosts.where(F.col("pages") >= LEAST_PAGES).select("host", "rows", "pages", F.col("x.shape").alias("wrapper"), F.col("pages").alias("n")))

    def run(it):
        for b in it:
            found = [matched(*x) for x in zip(b.column("shape").to_pylist(), b.column("wrapper").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("host"), b.column("sh"), b.column("n"), b.column("pages"), pa.array([x for x, _ in found], pa.list_(pa.int64())), pa.array([x for _, x in found], pa.list_(pa.int32()))], ["host", "sh", "n", "pages", "slot", "over"])

    known = _with(kinds, hosts.drop("rows"), ["host"], broadcast_bytes).where("wrapper IS NOT NULL")
    known = known.select("host", F.xxhash64("shape").alias("sh"), F.col("m").alias("n"), "pages", "shape", "wrapper")
    known = common.checkpoint(known.mapInArrow(run, "host string, sh long, n long, pages long, slot array<bigint>, over array<int>"))
    texts = one.select("host", F.xxhash64("shape").alias("sh"), F.explode("slots").alias("x")).groupBy("host", "sh", "x.k", "x.text").agg(F.count("*").alias("m"), F.sum("x.mass").alias("mass"))
    texts = _with(texts, known, ["host", "sh"], broadcast_bytes).where("slot IS NOT NULL")
    texts = texts.groupBy("host", F.get("slot", F.col("k")).alias("slot"), F.get("over", F.col("k")).alias("over"), "text").agg(F.sum("m").alias("m"), F.sum("mass").alias("mass"), F.first("pages").alias("pages"))
    texts = texts.withColumn("constant", (F.col("m") > 1) & (F.col("m") - 1 >= CONSTANT_SHARE * (F.col("pages") - 1)))
    texts = texts.groupBy("host", "over").agg(F.sum(F.when(F.col("constant"), 0).otherwise(F.col("mass"))).alias("mass"), F.collect_list(F.when(F.col("constant"), F.struct("slot", "text"))).alias("keys"))
    texts = texts.groupBy("host").agg(F.collect_list(F.struct("over", "mass")).alias("masses"), F.flatten(F.collect_list("keys")).alias("template"))

    def choose(it):
        for b in it:
            region = [region_of(s, {x["over"]: x["mass"] for x in m or () if x["over"] >= 0}) for s, m in zip(b.column("wrapper").to_pylist(), b.column("masses").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("host"), b.column("rows"), b.column("wrapper"), pa.array(region, pa.int32()), b.column("template")], ["host", "n", "shape", "region", "template"])

    every = hosts.join(texts, "host", "left").select("host", "rows", "wrapper", "masses", F.coalesce("template", F.array().cast("array<struct<slot:bigint,text:bigint>>")).alias("template"))
    return common.checkpoint(every.mapInArrow(choose, "host string, n long, shape string, region int, template array<struct<slot:bigint,text:bigint>>"))


def main_text(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, names: bool = True, wrapped: bool = True) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; names and wrapped turn one of the two sources off."""
    columns = ["page_id", "url", "text", "n_chars"]
    types = dict(pages.dtypes)
    full = with_host(pages)
    if wrapped:
        full = _with(full, wrappers(pages, broadcast_bytes, names), ["host"], broadcast_bytes)
    else:
        full = full.withColumn("shape", F.lit(None).cast("string")).withColumn("region", F.lit(-1)).withColumn("template", F.lit(None).cast("array<struct<slot:bigint,text:bigint>>"))

    def run(it):
        for b in it:
            text = []
            for p, s, r, t in zip(*(b.column(c).to_pylist() for c in ("html", "shape", "region", "template")), strict=True):
                text.append(extract(p, s, -1 if r is None else r, frozenset((x["slot"], x["text"]) for x in t or ()), names))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], columns)

    schema = f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long"
    return full.select("page_id", "url", "html", "shape", "region", "template").mapInArrow(run, schema)


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(common.table(spark, sf_dir, "pages"))


QUERIES = {"op7_html_extract": op7_html_extract}
#: Trees are not SQL; tests compare with hand-made pages and with the tables' markup.
ORACLE_SQL: dict[str, str] = {}
