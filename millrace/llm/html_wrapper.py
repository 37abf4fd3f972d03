"""Main text of web pages by wrapper induction over the pages of a host.

Every page becomes a tree of labelled block nodes; neighbouring siblings of one shape are one repeated node. Pages of a host
that have the same frame of containers form a layout. A layout's trees are aligned with its most common tree by
simple tree matching. A text that is found at the same node on most of the layout's distinct pages belongs to the template; the other
nodes are slots. The content slot is the smallest container that holds nearly all of the varying text that is no link.

A page is extracted by aligning it with its layout's template: what lies in the content slot stays, less the template's texts.
Tag and class rules are a supplement: they take forms, adverts, comments and the like out of the slot, and they alone decide
on pages whose layout has too few pages to learn from.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import rows_of
from millrace.scratch import settle

MIN_PAGES, CONSTANT_SHARE, SLOT_SHARE = 3, 0.8, 0.8
#: Templates are broadcast up to this many bytes; beyond, templates and pages are shuffled by layout, in SALT parts each.
MOST_BYTES, SALT = 32_000_000, 16
#: Sibling lists of more pairs than this are aligned at their equal ends and then place by place.
MOST_PAIRS = 40_000

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/><]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>", re.S)
_ATTRIBUTE = re.compile(r"(?<![^\s/\"'])([^\s=/\"'>]++)\s*+=\s*+(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed"}
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^<>]*>?", re.I) for t in _RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that make up a layout's frame, and those that the content slot may be.
_FRAME = {"body", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form"}
_SLOT = {"#root", "html", "body", "div", "section", "article", "main", "table", "tbody", "tr", "td", "center"}
_OUT = {"nav", "footer", "aside", "form", "head", "button", "select", "svg", "dialog", "menu", "object", "canvas", "audio", "video"} | _RAW
_OUT_NAMES = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent", "cookie", "cookies", "disqus", "dropdown", "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "pagination", "popup", "promo", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
_OUT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu"}
_SPACE, _DIGITS = re.compile(r"\s+"), re.compile(r"\d+")


class Node:
    """out: the tag and class rules take it out. link: inside an a element. home: the block node that its text belongs to. place: of a block node in the page's shape."""

    __slots__ = ("tag", "label", "parent", "children", "out", "article", "link", "block", "home", "place")

    def __init__(self, tag: str, attributes: str, parent: Node | None) -> None:
        self.tag, self.parent, self.children, self.home, self.place = tag, parent, [], self, 0
        names, role, self.label = set(), "", tag
        if attributes.strip():
            found = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
            self.label = f"{tag}.{_DIGITS.sub('0', found['class'])}" if "class" in found else tag
            names = set(re.split(r"[^a-z0-9]+", f"{found.get('class', '')} {found.get('id', '')}".lower()))
            role = found.get("role", "").lower()
            if "hidden" in found or found.get("aria-hidden") == "true":
                role = "dialog"
        within = parent is not None and parent.article
        free = tag in ("html", "body", "article", "main") and not names & {"comment", "comments", "reply", "replies"}
        self.out = parent is not None and parent.out or tag in _OUT or tag == "header" and not within or not free and bool(names & _OUT_NAMES or role in _OUT_ROLES)
        self.article = not self.out and (within or tag in ("article", "main") or role in ("main", "article"))
        self.link = tag == "a" or parent is not None and parent.link
        self.block = parent is None or tag in _BLOCK or self.label is not tag and tag not in _VOID and tag not in _RAW


def parse(page: str) -> tuple[Node, list[tuple[Node, str | None]]]:
    """The root and, in page order, (node, piece of its text); None marks the edge of a block."""
    root = node = Node("#root", "", None)
    pieces: list[tuple[Node, str | None]] = []
    open_: Counter = Counter()
    at, n = 0, len(page)

    def leave(upto: Node) -> Node:
        """Closes what is open below and with ``upto``."""
        inner = node
        while inner is not upto.parent:
            open_[inner.tag] -= 1
            inner = inner.parent
        return inner

    while at < n:
        m = _TAG.search(page, at)
        end = m.start() if m else n
        if end > at:
            pieces.append((node, page[at:end]))
        if not m:
            break
        at = m.end()
        name = m.group(2)
        if not name:
            continue
        tag = name.lower()
        if m.group(1):
            if open_[tag] > 0:
                up = node
                while up.tag != tag:
                    up = up.parent
                node = leave(up)
            if tag in _BLOCK:
                pieces.append((node, None))
            continue
        if tag in _BLOCK and open_["p"] > 0:
            up = node
            while up.tag not in ("#root", "div", "article", "section", "main", "body", "td", "li", "blockquote", "form"):
                if up.tag == "p":
                    node = leave(up)
                    break
                up = up.parent
        if tag in _CLOSES and any(open_[t] > 0 for t in _CLOSES[tag]):
            up, outer = node, None
            while up.tag not in ("#root", "ul", "ol", "dl", "table", "menu"):
                outer = up if up.tag in _CLOSES[tag] else outer
                up = up.parent
            node = leave(outer) if outer else node
        child = Node(tag, m.group(3), node)
        node.children.append(child)
        if tag in _BLOCK:
            pieces.append((child, None))
        elif tag == "br":
            pieces.append((node, " "))
        if tag in _RAW:
            close = _RAW_END[tag].search(page, at)
            at = close.end() if close else n
        elif tag not in _VOID and not m.group(3).rstrip().endswith("/"):
            node = child
            open_[tag] += 1
        elif tag == "hr":
            pieces.append((node, None))
    return root, pieces


def _blocks(root: Node) -> list[Node]:
    """Block nodes in page order, their ``children`` cut down to the block nodes nearest below."""
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        near, below = [], x.children[::-1]
        while below:
            c = below.pop()
            if c.block:
                near.append(c)
            else:
                c.home = x
                below += c.children[::-1]
        x.children = near
        todo += near[::-1]
    return order


def shape(root: Node) -> list[tuple[int, str]]:
    """(parent, label) of the page's shape, parents first; block nodes get their ``place`` in it.

    Neighbouring siblings whose subtrees have one shape share their places.
    """
    order = _blocks(root)
    known: dict[tuple, int] = {}
    kind: dict[Node, int] = {}
    for x in reversed(order):
        below: list[int] = []
        for c in x.children:
            if not below or below[-1] != kind[c]:
                below.append(kind[c])
        kind[x] = known.setdefault((x.label, tuple(below)), len(known))
    out: list[tuple[int, str]] = [(-1, root.label)]
    first: dict[int, int] = {}
    for x in order:
        if x.place not in first:
            first[x.place] = len(out)
            last = None
            for c in x.children:
                if kind[c] != last:
                    out.append((x.place, c.label))
                    last = kind[c]
        at, last = first[x.place] - 1, None
        for c in x.children:
            at += kind[c] != last
            last = kind[c]
            c.place = at
    return out


def texts(pieces: list[tuple[Node, str | None]]) -> dict[Node, list]:
    """[text, characters of links in it] of each block node that has text of its own; after ``shape``."""
    out: dict[Node, list] = {}
    for node, text in pieces:
        if text is not None:
            held = out.setdefault(node.home, [[], 0])
            held[0].append(text)
            held[1] += len(text) * node.link
    return {x: ["".join(t), n] for x, (t, n) in out.items() if not "".join(t).isspace()}


def text_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(" ".join(text.split())) - (1 << 63)


def frame(nodes: list[tuple[int, str]]) -> int:
    """Hash of the containers of the shape and of where they stand, to a depth of four below the root."""
    path, depth, found = {0: ""}, {0: 0}, set()
    for i, (up, label) in enumerate(nodes[1:], 1):
        if up in path and depth[up] < 5:
            path[i], depth[i] = f"{path[up]}/{label}", depth[up] + 1
            if label.partition(".")[0] in _FRAME:
                found.add(path[i])
    return xxhash.xxh64_intdigest("\n".join(sorted(found))) - (1 << 63)


def match(a: list, b: list) -> list[tuple[int, int]]:
    """Simple tree matching: pairs of places of a largest order-keeping, top-down mapping of equal labels.

    Trees are (parent, label) lists, parents first. Siblings that are equal at the ends of both lists are matched at once, which loses
    nothing; lists that are left with more than MOST_PAIRS pairs are matched place by place.
    """
    known: dict[tuple, int] = {}
    sides = []
    for tree in (a, b):
        below: list[list[int]] = [[] for _ in tree]
        for i, (up, _) in enumerate(tree[1:], 1):
            below[up].append(i)
        kind, size = [0] * len(tree), [1] * len(tree)
        for i in range(len(tree) - 1, -1, -1):
            kind[i] = known.setdefault((tree[i][1], tuple(kind[c] for c in below[i])), len(known))
            size[i] += sum(size[c] for c in below[i])
        sides.append((below, kind, size))
    (xs_of, xkind, xsize), (ys_of, ykind, _) = sides
    done: dict[tuple[int, int], tuple[int, list]] = {}
    todo = [(0, 0)]
    while todo:
        x, y = todo[-1]
        if (x, y) in done:
            todo.pop()
            continue
        if a[x][1] != b[y][1]:
            done[x, y] = 0, []
            continue
        xs, ys = xs_of[x], ys_of[y]
        if xkind[x] == ykind[y]:
            done[x, y] = xsize[x], list(zip(xs, ys, strict=True))
            continue
        k, most = 0, min(len(xs), len(ys))
        while k < most and xkind[xs[k]] == ykind[ys[k]]:
            k += 1
        e = 0
        while e < most - k and xkind[xs[-1 - e]] == ykind[ys[-1 - e]]:
            e += 1
        ends = list(zip(xs[:k], ys[:k], strict=True)) + list(zip(xs[len(xs) - e :], ys[len(ys) - e :], strict=True))
        xs, ys = xs[k : len(xs) - e], ys[k : len(ys) - e]
        many = len(xs) * len(ys) > MOST_PAIRS
        wanted = [p for p in (zip(xs, ys) if many else ((c, d) for c in xs for d in ys)) if a[p[0]][1] == b[p[1]][1]]
        open_ = [p for p in wanted + ends if p not in done]
        if open_:
            todo += open_
            continue
        own = 1 + sum(done[p][0] for p in ends)
        if many:
            done[x, y] = own + sum(done[p][0] for p in wanted), ends + wanted
            continue
        w = [[0] * (len(ys) + 1)]
        for c in xs:
            row, above = [0], w[-1]
            for j, d in enumerate(ys):
                v = above[j] + done[c, d][0] if (c, d) in done else 0
                row.append(max(v, above[j + 1], row[j]))
            w.append(row)
        i, j = len(xs), len(ys)
        while i and j:
            if w[i][j] == w[i - 1][j]:
                i -= 1
            elif w[i][j] == w[i][j - 1]:
                j -= 1
            else:
                ends.append((xs[i - 1], ys[j - 1]))
                i, j = i - 1, j - 1
        done[x, y] = own + w[-1][-1], ends
    out, todo = [], [(0, 0)]
    while todo:
        x, y = todo.pop()
        if a[x][1] == b[y][1]:
            out.append((x, y))
            if (x, y) in done:
                todo += done[x, y][1]
            else:  # inside subtrees of one shape
                todo += zip(xs_of[x], ys_of[y], strict=True)
    return out


def _join(pieces: list[tuple[Node, str | None]], stays) -> str:
    blocks: list[list[str]] = [[]]
    for node, text in pieces:
        if text is None:
            blocks.append([])
        elif stays(node):
            blocks[-1].append(text)
    joined = (_SPACE.sub(" ", entities.unescape("".join(b))).strip() for b in blocks if b)
    return "\n\n".join(b for b in joined if b)


class Template:
    """A layout's tree, the place of its content slot, and the (place, text hash) that belong to the template."""

    def __init__(self, tree: str, slot: int, constant: list[tuple[int, int]]) -> None:
        self.tree, self.slot, self.constant, self.matched = json.loads(tree), slot, set(constant), {}

    def align(self, own: list[tuple[int, str]]) -> dict[int, int]:
        """Places of the page's shape to places of the template."""
        key = tuple(own)
        if key not in self.matched:
            if len(self.matched) > 2_000:
                self.matched.clear()
            self.matched[key] = {j: i for i, j in match(self.tree, own)}
        return self.matched[key]


def main_text(page: str | None, find=None, rules: bool = True) -> str:
    """Text of the page's content blocks. find: gives the Template of a frame, or None. rules: use the tag and class rules too."""
    if not page:
        return ""
    root, pieces = parse(page)
    has_article = rules and any(node.article for node, _ in pieces)
    own = shape(root) if find else None
    template = find(frame(own)) if find else None
    plain = lambda node: not (rules and node.out) and (node.article or not has_article)
    if template is None:
        return _join(pieces, plain)
    to = template.align(own)
    inside = [False] * len(own)
    for j, (up, _) in enumerate(own):
        inside[j] = to.get(j) == template.slot or up >= 0 and inside[up]
    if not any(inside) or has_article and not any(node.article and inside[node.home.place] for node, _ in pieces):
        return _join(pieces, plain)
    drop = {x for x, (text, _) in texts(pieces).items() if (to.get(x.place), text_hash(text)) in template.constant} if template.constant else ()
    return _join(pieces, lambda node: inside[node.home.place] and node.home not in drop and plain(node))


def _host(url_col: str) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(F.col(url_col)), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))


_TREES = "host string, frame long, digest long, tree string, at array<int>, hashes array<long>, chars array<int>"


def page_trees(pages: DataFrame, url_col: str = "url", html_col: str = "html", rules: bool = True) -> DataFrame:
    """(host, frame, digest, tree, at, hashes, chars) of each page with a host: its shape and, for each text block, place, hash and characters that may be content.

    digest: of the longest blocks that make up half of the page's text, so that copies of an article share it, whatever stands around them.
    """

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (hosts, htmls) in rows_of(batches):
            out = []
            for page in htmls:
                root, pieces = parse(page or "")
                own = shape(root)
                found = [(x.place, text_hash(t), 0 if rules and x.out else len(t) - linked) for x, (t, linked) in texts(pieces).items()]
                most, total, upto = [], sum(f[2] for f in found), 0
                for _, h, n in sorted(found, key=lambda f: (-f[2], f[1])):
                    if 2 * upto > total:
                        break
                    most.append(h)
                    upto += n
                digest = xxhash.xxh64_intdigest(repr(most)) - (1 << 63)
                out.append((frame(own), digest, json.dumps(own, ensure_ascii=False), [f[0] for f in found], [f[1] for f in found], [f[2] for f in found]))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
            rest = [pa.array(list(c), t) for c, t in zip(zip(*out), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), *rest], names=["host", "frame", "digest", "tree", "at", "hashes", "chars"])

    return pages.select(_host(url_col).alias("host"), F.col(html_col).alias("html")).where("host <> ''").mapInArrow(trees, _TREES)


def content_slot(tree: list, mass: dict[int, int], share: float = SLOT_SHARE) -> int | None:
    """The deepest container that holds ``share`` of the varying characters; an article or main element is not entered."""
    total = [mass.get(i, 0) for i in range(len(tree))]
    below: list[list[int]] = [[] for _ in tree]
    for i in range(len(tree) - 1, 0, -1):
        total[tree[i][0]] += total[i]
        below[tree[i][0]].append(i)
    if not total[0]:
        return None
    at = 0
    while tree[at][1].partition(".")[0] not in ("article", "main"):
        inner = [c for c in below[at] if total[c] >= share * total[0] and tree[c][1].partition(".")[0] in _SLOT]
        if not inner:
            break
        at = max(inner, key=lambda c: total[c])
    return at


def induce(pages: DataFrame, url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, share: float = CONSTANT_SHARE, rules: bool = True) -> DataFrame:
    """(host, frame, tree, slot, constant array<struct<at, hash>>) of the layouts that have at least min_pages distinct pages."""
    layout = ["host", "frame"]
    rows = settle(page_trees(pages, url_col, html_col, rules), "html-trees")
    one = rows.groupBy(*layout, "digest").agg(F.min(F.struct("tree", "at", "hashes", "chars")).alias("r"))
    one = settle(one.select(*layout, "digest", "r.*"), "html-distinct")
    common = one.groupBy(*layout, "tree").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("digest", "at", "hashes")).alias("r"))
    refs = common.groupBy(*layout).agg(F.sum("n").alias("pages"), F.max_by(F.struct("tree", "r.*"), F.struct("n", "tree")).alias("r")).where(F.col("pages") >= min_pages)
    refs = settle(refs.select(*layout, "pages", F.col("r.tree").alias("ref"), F.col("r.digest").alias("ref_digest"), F.col("r.at").alias("ref_at"), F.col("r.hashes").alias("ref_hashes")), "html-refs")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of equal texts (host, frame, at, hash, pages) and, with a null hash, of varying characters."""
        found: Counter = Counter()
        known: dict = {}

        def flush() -> pa.RecordBatch:
            keys = list(found)
            cols = [pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int32(), pa.int64()))]
            return pa.RecordBatch.from_arrays([*cols, pa.array([found[k] for k in keys], pa.int64())], names=["host", "frame", "at", "hash", "n"])

        for _, cols in rows_of(batches):
            for host, fr, tree, at, hashes, chars, ref, ref_at, ref_hashes, is_ref in zip(*cols, strict=True):
                if (ref, tree) not in known:
                    if len(known) > 2_000:
                        known.clear()
                    known[ref, tree] = {j: i for i, j in match(json.loads(ref), json.loads(tree))}
                to, want = known[ref, tree], set(zip(ref_at, ref_hashes, strict=True))
                same = set()
                for j, h, n in zip(at, hashes, chars, strict=True):
                    i = to.get(j)
                    if i is not None and (i, h) in want:
                        same.add((i, h))
                    if i is not None and (is_ref or (i, h) not in want):
                        found[host, fr, i, None] += n
                found.update((host, fr, i, h) for i, h in same)
            if len(found) > 100_000:
                yield flush()
                found.clear()
        yield flush()

    few = _bytes(refs, F.length("ref") + 12 * F.size("ref_at")) <= MOST_BYTES
    wanted = ["tree", "at", "hashes", "chars", "ref", "ref_at", "ref_hashes", (F.col("digest") == F.col("ref_digest")).alias("is_ref")]
    if few:
        paired = one.join(F.broadcast(refs), layout)
    else:
        salt = F.pmod(F.xxhash64("digest"), F.lit(SALT)).alias("salt")
        paired = one.select("*", salt).join(refs.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))).alias("salt")), [*layout, "salt"])
    counts = paired.select(*layout, *wanted).mapInArrow(align, "host string, frame long, at int, hash long, n long").groupBy(*layout, "at", "hash").agg(F.sum("n").alias("n"))
    counts = counts.join(F.broadcast(refs.select(*layout, "pages")) if few else refs.select(*layout, "pages"), layout)
    marks = counts.where(F.col("hash").isNull() | (F.col("n") >= share * F.col("pages"))).groupBy(*layout).agg(F.collect_list(F.struct("at", "hash", "n")).alias("marks"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (_, _, trees, marks) in rows_of(batches):
            slots = [content_slot(json.loads(t), {m["at"]: m["n"] for m in ms if m["hash"] is None}) for t, ms in zip(trees, marks, strict=True)]
            constant = [[{"at": m["at"], "hash": m["hash"]} for m in ms if m["hash"] is not None] for ms in marks]
            kinds = pa.list_(pa.struct([("at", pa.int32()), ("hash", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(slots, pa.int32()), pa.array(constant, kinds)], names=["host", "frame", "tree", "slot", "constant"])

    ready = refs.join(marks, layout).select(*layout, "ref", "marks").mapInArrow(choose, "host string, frame long, tree string, slot int, constant array<struct<at: int, hash: long>>")
    return settle(ready.where("slot is not null"), "html-templates")


def _bytes(side: DataFrame, each: Column) -> int:
    return side.agg(F.sum(each.cast("long"))).first()[0] or 0


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, share: float = CONSTANT_SHARE, rules: bool = True, templates: DataFrame | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``; other columns are not read.

    Blocks are joined in page order by an empty line, white space inside a block is one space, character references are
    decoded. Null and empty html give an empty text; pages with a null or host-less url, and layouts of few distinct pages, are
    extracted by the tag and class rules alone, and so are pages on which the content slot is missing; repeated rows are all returned
    and count once for a template, as do copies of one article; null ids are fine; an empty table gives no rows. Pages of any length
    and depth are read whole. templates: those of ``induce`` from other pages, where they were learnt before.
    """
    templates = induce(pages, url_col, html_col, min_pages, share, rules) if templates is None else templates
    kind = pages.schema[id_col].dataType.simpleString()
    result = f"page_id {kind}, url string, text string, n_chars long"
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), _host(url_col).alias("host"), F.col(html_col).alias("html"))

    def batch_of(part: pa.RecordBatch, out: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    if _bytes(templates, F.length("tree") + 12 * F.size("constant") + 64) <= MOST_BYTES:
        held = {(r.host, r.frame): (r.tree, r.slot, [(c.at, c.hash) for c in r.constant]) for r in templates.toLocalIterator()}
        sent = pages.sparkSession.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known: dict = {}

            def find(host: str, fr: int) -> Template | None:
                if (host, fr) not in known:
                    known[host, fr] = Template(*sent.value[host, fr]) if (host, fr) in sent.value else None
                return known[host, fr]

            for part, (_, _, hosts, htmls) in rows_of(batches):
                yield batch_of(part, [main_text(h, lambda fr, host=host: find(host, fr), rules) for host, h in zip(hosts, htmls, strict=True)])

        return rows.mapInArrow(run, result)

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (_, _, _, htmls) in rows_of(batches):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array([frame(shape(parse(h or "")[0])) for h in htmls], pa.int64())], names=["page_id", "url", "host", "html", "frame"])

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (_, _, htmls, trees, slots, constants) in rows_of(batches):
            out, last, template = [], None, None
            for h, t, s, c in zip(htmls, trees, slots, constants, strict=True):
                if t is not None and (t, s, c) != last:
                    last, template = (t, s, c), Template(t, s, [(x["at"], x["hash"]) for x in c])
                out.append(main_text(h, (lambda fr, found=template: found) if t is not None else None, rules))
            yield batch_of(part, out)

    dealt = rows.mapInArrow(framed, f"page_id {kind}, url string, host string, html string, frame long").withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALT)))
    parts = templates.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))).alias("salt"))
    return dealt.join(parts, ["host", "frame", "salt"], "left").select("page_id", "url", "html", "tree", "slot", "constant").mapInArrow(apart, result)
