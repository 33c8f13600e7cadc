"""HTML extraction by wrapper induction.

Every page becomes a small tree in which runs of alike children are one node.
A host's different trees are merged into its wrapper by simple tree matching:
what matches is one node, what doesn't is added where it stands. Every
different page is then aligned with the wrapper. A node whose text is the same
on nearly all pages that have it is template; slots whose text varies are content.
Elements that HTML itself marks as navigation, advert, form, script and the
like never are content, and what an article element holds always is.
"""

from __future__ import annotations

import hashlib
import html as htmllib
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, small_batches, written

#: A node's text is template where it stands on CONSTANT of the different pages that have the node, if these are
#: MIN_PAGES or more and SHARE or more of the host's different pages. Copies of a page count once.
CONSTANT, SHARE, MIN_PAGES = 0.8, 0.5, 3
#: Trees that one task merges at a time, about; larger hosts take several rounds.
MERGED = 64
#: Cells of one alignment table; larger ones are halved first.
CELLS = 1 << 20
#: Wrappers of up to so many bytes in all are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 16 << 20

# Names from the HTML standard.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
    "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
CLOSES_P = {
    "address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul",
}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NEVER = {
    "head", "nav", "footer", "aside", "form", "script", "style", "noscript", "template", "title", "button", "select", "input", "textarea", "iframe",
    "object", "embed", "canvas", "svg", "menu", "dialog", "audio", "video", "noembed", "noframes", "xmp", "datalist", "math", "applet", "map",
}
ARTICLE = {"article", "main"}
_WALLS, _WEAK = {"article", "main", "body", "td", "th"}, INLINE | {"p", "li"}
#: Words of class, id and role that mark what is no part of an article.
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|promo\w*|sponsor\w*|nav\w*|menu\w*|breadcrumbs?|sidebar|side|aside|footer|foot|cookie\w*|consent|gdpr|notice|alert|"
    r"site-header|page-header|popup|modal|newsletter|subscribe|signup|login|search|share|sharing|social|related|recommend\w*|comments?|disqus|replies|reply|pagination|pager|toolbar|masthead|"
    r"complementary|contentinfo|skip|widget)(?:$|[\s_-])"
)
#: Attributes as the HTML standard reads them: only a value's first character may open quotes, and quotes that
#: nothing closes are characters of a name. Nothing is tried twice, so broken tags cost no more than sound ones.
_ATTRIBUTES = r"""(?>[\s/]++|[^\s/>=]++(?>\s*+=\s*+(?>"[^"]*+"|'[^']*+'|[^\s"'>][^\s>]*+)?+)?+|=[^\s/>=]*+)*+"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})>", re.S)
_ENDS_IN_VALUE = re.compile(r"""=\s*[^\s"'>][^\s>]*\Z""")
_MARKS = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


@dataclass
class Node:
    tag: str
    children: list = field(default_factory=list)  # nodes and strings in page order
    barred: str = ""  # by its "tag" or by its "words", or not
    article_in: bool = False


def _barred(tag: str, attributes: str, inside_article: bool) -> str:
    if tag in NEVER or tag == "header" and not inside_article:
        return "tag"
    if tag in ARTICLE or tag in ("html", "body"):
        return ""
    for m in _MARKS.finditer(attributes) if attributes else ():
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return "tag"
        if MARKED.search(value):
            return "words"
    return ""


def parse(source: str) -> Node:
    """The element tree; end tags without a start are ignored, what stays open ends with its parent."""
    root = Node("#root")
    stack, at, n = [root], 0, len(source)
    opened: Counter = Counter()

    def close(i: int) -> None:
        for x in stack[i:]:
            opened[x.tag] -= 1
        del stack[i:]

    def close_first(tags: set[str], through: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                return close(i)
            if stack[i].tag not in through:
                return None

    while at < n:
        m = _TOKEN.search(source, at)
        if not m:
            stack[-1].children.append(source[at:])
            break
        if m.start() > at:
            stack[-1].children.append(source[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1) if opened[tag] > 0 else ():
                if stack[i].tag == tag:
                    close(i)
                    break
                if stack[i].tag in _WALLS and tag in _WEAK:
                    break
            continue
        if tag in CLOSES_P and opened["p"] > 0:
            close_first({"p"}, INLINE)
        if tag in SAME:
            close_first(SAME[tag], INLINE | {"p"})
        node = Node(tag, barred=_barred(tag, m[3], opened["article"] + opened["main"] > 0))
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
            node.children.append(source[at : end.start() if end else n])
            at = end.end() if end else n
        elif tag not in VOID and not (m[3].rstrip().endswith("/") and not _ENDS_IN_VALUE.search(m[3])):
            if tag in ARTICLE:
                outermost = opened["article"] + opened["main"] == 0
                for x in stack:
                    x.article_in = True
                    if outermost and x.barred == "words":  # class words of what holds the article say nothing of the article
                        x.barred = ""
            opened[tag] += 1
            stack.append(node)
    return root


def blocks(node: Node) -> list[str]:
    """The texts of the blocks under a node, in order, white space folded, references decoded, empty ones left out."""
    out: list[str] = []
    held: list[str] = []

    def end() -> None:
        if text := " ".join(htmllib.unescape("".join(held)).split()):
            out.append(text)
        held.clear()

    todo: list = [node]
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            held.append(x)
        elif not x.barred:
            inner = x.tag in INLINE
            if not inner:
                end()
                todo.append(None)
            todo += reversed(x.children)
    end()
    return out


@dataclass
class Slot:
    """A node of the small tree: a tag (run-length folded), its own blocks' texts, and its children."""

    tag: str
    texts: list[str]
    children: list = field(default_factory=list)
    content: bool = False


def shape(root: Node) -> Slot:
    """The small tree of a page's possible content: articles and leaves are slots; neighbours of one tag and depth are one."""

    def soft(x: Node | str) -> bool:
        return isinstance(x, str) or (x.tag in INLINE or x.tag in VOID) and not x.article_in

    def flush(out: Slot, run: list) -> None:
        if run and (texts := blocks(Node("#run", run[:]))):
            out.children.append(Slot("#text", texts))
        run.clear()

    def add(out: Slot, slot: Slot) -> None:
        last = out.children[-1] if out.children else None
        if last and last.tag == slot.tag and not last.children and not slot.children and not slot.content:
            last.texts += slot.texts
        elif slot.texts or slot.children:
            out.children.append(slot)

    if all(map(soft, root.children)):
        return Slot(root.tag, blocks(root))
    top = Slot(root.tag, [])
    stack = [(top, [], iter(root.children))]
    while stack:
        out, run, rest = stack[-1]
        for c in rest:
            if soft(c):
                run.append(c)
                continue
            flush(out, run)
            if c.barred:
                continue
            if c.tag in ARTICLE or all(map(soft, c.children)):
                add(out, Slot(c.tag, blocks(c), content=c.tag in ARTICLE))
                continue
            stack.append((Slot(c.tag, []), [], iter(c.children)))
            break
        else:
            flush(out, run)
            stack.pop()
            if stack:
                add(stack[-1][0], out)
    return top


def _preorder(tree: Slot) -> list[Slot]:
    out, todo = [], [tree]
    while todo:
        x = todo.pop()
        out.append(x)
        todo += reversed(x.children)
    return out


class Matching:
    """Simple tree matching: the most nodes that two trees share, order and parents kept.

    Subtrees of one shape are one kind, and two kinds are compared once. Children
    of the same kind at both ends of two lists match each other, which no other
    alignment betters; the rest takes a table, halved while it is over CELLS.
    """

    def __init__(self) -> None:
        self.book: dict[tuple, int] = {}
        self.tag: list[str] = []
        self.below: list[tuple[int, ...]] = []
        self.size: list[int] = []
        self.memo: dict[tuple[int, int], int] = {}

    def kinds(self, tree: Slot) -> dict[int, int]:
        """Each node's kind, by identity."""
        out: dict[int, int] = {}
        for x in reversed(_preorder(tree)):
            below = tuple(out[id(c)] for c in x.children)
            kind = self.book.setdefault((x.tag, below), len(self.tag))
            if kind == len(self.tag):
                self.tag.append(x.tag)
                self.below.append(below)
                self.size.append(1 + sum(self.size[c] for c in below))
            out[id(x)] = kind
        return out

    def _known(self, a: int, b: int) -> int | None:
        return self.size[a] if a == b else 0 if self.tag[a] != self.tag[b] else self.memo.get((a, b))

    @staticmethod
    def _ends(xs, ys) -> tuple[int, int]:
        """How many at the start, and then at the end, are the same."""
        n = min(len(xs), len(ys))
        head = next((i for i in range(n) if xs[i] != ys[i]), n)
        return head, next((i for i in range(n - head) if xs[-1 - i] != ys[-1 - i]), n - head)

    def _rows(self, xs, ys) -> Iterator[np.ndarray]:
        """The alignment table's rows: the most nodes of each start of xs and each of ys."""
        row, held = np.zeros(len(ys) + 1, np.int64), {}
        yield row
        for x in xs:
            if x not in held:
                each = {y: self._known(x, y) for y in set(ys)}
                held[x] = np.array([each[y] for y in ys], np.int64)
            row = row.copy()
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + held[x]))
            yield row

    def weight(self, a: int, b: int) -> int:
        """The number of nodes that trees of two kinds share."""
        todo = [(a, b)]
        while todo:
            x, y = todo[-1]
            if self._known(x, y) is not None:
                todo.pop()
                continue
            xs, ys = self.below[x], self.below[y]
            head, tail = self._ends(xs, ys)
            same = sum(self.size[c] for c in xs[:head] + xs[len(xs) - tail :])
            xs, ys = xs[head : len(xs) - tail], ys[head : len(ys) - tail]
            missing = [(c, d) for c in set(xs) for d in set(ys) if self._known(c, d) is None]
            if missing:
                todo += missing
                continue
            for row in self._rows(xs, ys):
                best = int(row[-1])
            self.memo[x, y] = 1 + same + best
            todo.pop()
        return self._known(a, b)

    def _aligned(self, xs: list[int], ys: list[int]) -> list[tuple[int, int]]:
        """Places of the children that match, in order. The kinds' weights are known."""
        out, todo = [], [(0, len(xs), 0, len(ys))]
        while todo:
            a, b, c, d = todo.pop()
            head, tail = self._ends(xs[a:b], ys[c:d])
            out += [(a + i, c + i) for i in range(head)] + [(b - 1 - i, d - 1 - i) for i in range(tail)]
            a, b, c, d = a + head, b - tail, c + head, d - tail
            if a == b or c == d:
                continue
            if b - a > 1 and (b - a) * (d - c) > CELLS:
                half = (a + b) // 2
                for front in self._rows(xs[a:half], ys[c:d]):
                    pass
                for back in self._rows(xs[half:b][::-1], ys[c:d][::-1]):
                    pass
                at = c + int(np.argmax(front + back[::-1]))
                todo += [(a, half, c, at), (half, b, at, d)]
                continue
            best, i, j = np.stack(list(self._rows(xs[a:b], ys[c:d]))), b - a, d - c
            while i and j:
                if best[i, j] == best[i - 1, j]:
                    i -= 1
                elif best[i, j] == best[i, j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((a + i, c + j))
        return sorted(out)

    def pairs(self, a: Slot, b: Slot) -> Iterator[tuple[Slot, Slot, list[tuple[int, int]]]]:
        """The matched nodes of two trees, each with the places of its children that match."""
        mine, theirs = self.kinds(a), self.kinds(b)
        if not self.weight(mine[id(a)], theirs[id(b)]):
            return
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            xs, ys = [mine[id(c)] for c in x.children], [theirs[id(c)] for c in y.children]
            for c in set(xs):
                for d in set(ys):
                    self.weight(c, d)
            places = self._aligned(xs, ys)
            todo += [(x.children[i], y.children[j]) for i, j in reversed(places)]
            yield x, y, places


def match(a: Slot, b: Slot) -> int:
    """The most nodes that two trees share, order and parents kept."""
    m = Matching()
    return m.weight(m.kinds(a)[id(a)], m.kinds(b)[id(b)])


def merge(wrapper: Slot, page: Slot) -> None:
    """Adds to the wrapper what page has and it has not, where page has it."""
    for x, y, places in list(Matching().pairs(wrapper, page)):
        both, i, j = [], 0, 0
        for a, b in [*places, (len(x.children), len(y.children))]:
            both += x.children[i:a] + y.children[j:b] + x.children[a : a + 1]
            i, j = a + 1, b + 1
        x.children = both


def _number(tree: Slot) -> dict[int, int]:
    """Slots' numbers in page order, by identity."""
    return {id(x): n for n, x in enumerate(_preorder(tree))}


def _digest(texts: list[str]) -> bytes:
    return hashlib.blake2b("\n".join(texts).encode("utf-8", "surrogatepass"), digest_size=8).digest()


def _bare(tree: Slot) -> bytes:
    """The tree without texts, as lists in page order: what a wrapper keeps."""
    flat = _preorder(tree)
    return pickle.dumps([(x.tag, len(x.children), x.content) for x in flat])


def _slots(bare: bytes) -> Slot:
    top = Slot("", [])
    open_ = [(top, 1)]
    for tag, n, content in pickle.loads(bare):
        slot = Slot(tag, [], content=content)
        parent, left = open_.pop()
        parent.children.append(slot)
        if left > 1:
            open_.append((parent, left - 1))
        if n:
            open_.append((slot, n))
    return top.children[0]


def host_of(url: Column) -> Column:
    """The host of an address; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def _merged(table: pa.Table) -> pa.Table:
    """host, n and one tree: all the group's trees in one, the largest first."""
    trees = sorted(table["tree"].to_pylist(), key=lambda t: (-len(t), t))
    wrapper = _slots(trees[0])
    for t in trees[1:]:
        merge(wrapper, _slots(t))
    return pa.table({"host": table["host"].slice(0, 1), "n": table["n"].slice(0, 1), "tree": pa.array([_bare(wrapper)], pa.binary())})


def wrappers(pages: DataFrame) -> DataFrame:
    """host and wrapper: a tree, and constant, {slot number: digest of its constant text}. pages: host, html."""
    spark = pages.sparkSession

    def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bare, seen = [], []
            for source in batch.column(1).to_pylist():
                tree = shape(parse(source or ""))
                bare.append(_bare(tree))
                seen.append(pickle.dumps([_digest(x.texts) if x.texts else b"" for x in _preorder(tree)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bare, pa.binary()), pa.array(seen, pa.binary())], names=["host", "tree", "seen"])

    # Copies of a page align alike and say nothing of what the host repeats: each different page counts once.
    different = written(pages.select("host", "html").mapInArrow(shapes, "host string, tree binary, seen binary").distinct(), "page-shapes")
    hosts = different.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= MIN_PAGES)

    # Trees meet in groups of about MERGED, so that a large host's don't all meet in one task.
    trees = different.join(hosts.select("host"), "host", "left_semi").select("host", "tree").distinct()
    trees = written(trees, "page-trees")
    most = trees.groupBy("host").count().agg(F.max("count")).first()[0] or 0
    wrapper = trees.join(trees.groupBy("host").agg(F.count("*").alias("n")), "host").select("host", "n", "tree")
    while most > 0:
        fewer = F.ceil(F.col("n") / MERGED)
        groups = wrapper.select("host", fewer.alias("n"), "tree", F.pmod(F.xxhash64("tree"), fewer).alias("part")).groupBy("host", "part")
        wrapper = groups.applyInArrow(_merged, "host string, n long, tree binary")
        most = -(-most // MERGED) if most > MERGED else 0
    wrapper = written(wrapper.select("host", F.col("tree").alias("wrapper")), "page-wrappers")
    dropped(trees)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            host, slot, digest = [], [], []
            for h, tree, seen, w in zip(*(batch.column(c).to_pylist() for c in ("host", "tree", "seen", "wrapper")), strict=True):
                own, other, flat = _slots(tree), _slots(w), pickle.loads(seen)
                mine, theirs = _number(own), _number(other)
                for a, b, _ in Matching().pairs(own, other):
                    if (d := flat[mine[id(a)]]) and not b.content:
                        host.append(h), slot.append(theirs[id(b)]), digest.append(d)
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(slot, pa.int32()), pa.array(digest, pa.binary())], names=["host", "slot", "digest"])

    spread = different.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "host", "tree", "seen")
    votes = spread.join(_small(wrapper, F.octet_length("wrapper")), "host").mapInArrow(align, "host string, slot int, digest binary")
    counted = votes.groupBy("host", "slot", "digest").agg(F.count("*").alias("n"))
    slots = counted.groupBy("host", "slot").agg(F.sum("n").alias("held"), F.max(F.struct("n", "digest")).alias("top"))
    enough = (F.col("held") >= MIN_PAGES) & (F.col("held") >= SHARE * F.col("pages")) & (F.col("top.n") >= CONSTANT * F.col("held"))
    constant = slots.join(hosts, "host").where(enough).groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("slot", "top.digest"))).alias("constant"))
    out = written(wrapper.join(constant, "host").select("host", "wrapper", "constant"), "wrappers")
    dropped(different, wrapper)
    return out


def _small(df: DataFrame, size: Column) -> DataFrame:
    """df, to be broadcast where its rows come to BROADCAST_BYTES or less."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else df


def extract_page(source: str | None, wrapper: bytes | None, constant: dict[int, bytes]) -> str:
    tree = shape(parse(source or ""))
    articles: list[Slot] = []
    todo = [tree]
    while todo:
        x = todo.pop()
        if x.content:
            articles.append(x)
        todo += reversed(x.children)
    if articles:
        return " ".join(t for x in articles for t in x.texts)
    gone = set()
    if wrapper is not None:
        other = _slots(wrapper)
        theirs = _number(other)
        for a, b, _ in Matching().pairs(tree, other):
            if a.texts and constant.get(theirs[id(b)]) == _digest(a.texts):
                gone.add(id(a))
    out, todo = [], [tree]
    while todo:
        x = todo.pop()
        if id(x) not in gone:
            out += x.texts
        todo += reversed(x.children)
    return " ".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """A row a page: page_id, url, text and n_chars.

    Null or empty html gives an empty text. A page with article or main
    elements gives their blocks; any other the blocks outside barred elements
    that its host's wrapper doesn't find constant. Hosts of under MIN_PAGES
    different pages, and pages without a host, which count as one host, are read by the
    same rule, with no wrapper where too few pages make one. Repeated rows give
    a row each; a page_id or url may be null. An empty table gives no rows.
    """
    small_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    found = _small(wrappers(rows.select("host", "html")), F.octet_length("wrapper") + 32 * F.size("constant"))
    joined = rows.join(found, "host", "left").select("page_id", "url", "html", "wrapper", "constant")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for source, wrapper, constant in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                texts.append(extract_page(source, wrapper, dict(constant or ())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    kinds = dict(rows.dtypes)
    text = joined.mapInArrow(read, f"page_id {kinds['page_id']}, url string, text string")
    return text.withColumn("n_chars", F.char_length("text").cast("long"))


def op9_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
