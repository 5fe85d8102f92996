"""Main text of web pages by site style trees.

The DOMs of all pages of a host are merged: elements with the same path of
presentations (tag and class words from the root down) become one node of the
site style tree. For every node the tree counts the pages that have it, the
styles (sequences of child presentations) it takes and the contents of its branch. A
node is important if its styles vary over the pages (entropy of its styles) or
its contents do (one minus the entropy of its contents over the pages); template nodes
look and read alike everywhere. Seen on few pages a node proves little, so its
importance is drawn towards one as by one more page. Branches whose nodes are all of low
importance are removed from each page.

What a page itself tells weighs the importance: nodes in an article or main element
count twice, those below a class or id that has a boilerplate name as a part
(site-footer) half, and menus, forms, comments and the like by tag, role or whole name
not at all. No name or form takes weight from a branch that holds the page's articles
or most of its text. Copies of a page count once in the tree of their host, and a page
the tree would leave without text keeps it.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_checkpoint
from .common import slices
from .urlfilter import host_of

#: Weighted importance below which a branch goes, and attenuation.
THRESHOLD, GAMMA = 0.25, 0.9

#: What the importance of nodes in an article or main element is multiplied by.
MAIN_WEIGHT = 2.0

#: The same for nodes below a name that only hints at boilerplate.
HINT_WEIGHT = 0.5

#: Values of low nodes (path and importance) that are broadcast at most, and salts of a host's pages beyond.
BROADCAST_PATHS, SALTS = 200_000, 64

#: The name of a tag, what precedes its next quote or end, an attribute with its value.
TAG_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
PLAIN = re.compile(r"[^>\"']*")
COMMENT_END = re.compile(r"--!?>")
ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
NAME_WORDS = re.compile(r"[a-z]+")

RAW = frozenset("script style xmp iframe noembed noframes noscript textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: An opening tag first closes an open element of its row, unless one of the second set lies between.
CLOSES = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select", "datalist"})),
    "thead": (frozenset({"thead", "tbody", "tfoot"}), frozenset({"table"})),
    "tbody": (frozenset({"thead", "tbody", "tfoot"}), frozenset({"table"})),
    "tfoot": (frozenset({"thead", "tbody", "tfoot"}), frozenset({"table"})),
}
HEAD, HEAD_TAGS = frozenset({"head"}), frozenset("head title meta link style script base noscript template".split())
#: Presentation prior: tags, whole class or id tokens and roles without importance. Parts of tokens, and the words of the last row outside articles, hint.
NO_TAGS = frozenset("head nav footer aside form button select datalist input dialog menu template object embed svg canvas audio video applet map".split()) | RAW
NO_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer gdpr login menu modal nav navbar navigation newsletter notice pager pagination popup promo recommended related replies respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
NO_ROLES = frozenset("alert banner complementary contentinfo dialog form menu navigation search".split())
OUTSIDE_TAGS, OUTSIDE_WORDS = frozenset({"header"}), frozenset({"header", "masthead", "topbar", "alert", "search", "hero"})
MAIN = frozenset({"article", "main"})
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Tags:
    """(text before it, tag, closing, attributes) of every tag of a page, in one walk over it.

    Quoted values may hold ``>``. Comments, declarations and what an unfinished last
    tag has are skipped. If the quotes of some tag never pair off, quotes aren't
    heeded from there on, so no part of a page is read more than twice.
    """

    def __init__(self, source: str):
        self.source, self.quotes = source, True
        self.last_cdata = source.rfind("]]>")

    def end_of(self, at: int) -> int:
        """Where the tag that is open at ``at`` ends (its ``>``), or -1."""
        start = at
        while self.quotes:
            at = PLAIN.match(self.source, at).end()
            if at < len(self.source) and self.source[at] == ">":
                return at
            close = self.source.find(self.source[at], at + 1) if at < len(self.source) else -1
            if close < 0:
                self.quotes = False
            at = close + 1
        return self.source.find(">", start)

    def skip(self, at: int) -> int:
        """The end of the comment, section or declaration at ``at``."""
        if self.source.startswith("<!--", at):
            if self.source.startswith((">", "->"), at + 4):
                return self.source.index(">", at) + 1
            m = COMMENT_END.search(self.source, at + 4)
            return m.end() if m else len(self.source)
        if self.source.startswith("<![CDATA[", at) and self.last_cdata > at:
            return self.source.index("]]>", at) + 3
        return self.source.find(">", at) + 1 or len(self.source)

    def walk(self) -> Iterator[tuple[str, str, bool, str]]:
        source, at, text_at = self.source, 0, 0
        while (at := source.find("<", at)) >= 0:
            m = TAG_NAME.match(source, at + 1)
            if m:
                end = self.end_of(m.end())
                if end < 0:  # unfinished: no tag follows
                    yield source[text_at:at], "", False, ""
                    return
                tag = m[1].lower()
                closing = source[at + 1] == "/"
                yield source[text_at:at], tag, closing, source[m.end() : end]
                at = text_at = end + 1
                if not closing and tag in RAW:
                    at = text_at = self._raw_end(tag, at)
            elif source.startswith(("<!", "<?"), at):
                yield source[text_at:at], "", False, ""
                at = text_at = self.skip(at)
            else:  # a lone angle is text
                at += 1
        yield source[text_at:], "", False, ""

    def _raw_end(self, tag: str, at: int) -> int:
        m = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(self.source, at)
        return (self.source.find(">", m.end()) + 1 if m else 0) or len(self.source)


class Stack:
    """Open elements; where each tag was opened last is known without a walk."""

    def __init__(self):
        self.nodes, self.tags = [0], ["#root"]
        self.at: dict[str, list[int]] = {}
        self.blocks = [0]  # places of elements that are no formatting

    def push(self, node: int, tag: str) -> None:
        self.at.setdefault(tag, []).append(len(self.nodes))
        if tag not in INLINE:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)
        self.tags.append(tag)

    def last(self, tags) -> int:
        """The place of the innermost open element of these tags, or 0."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def cut(self, place: int) -> None:
        """Close the element at ``place`` and all within."""
        while len(self.nodes) > place:
            self.nodes.pop()
            self.at[self.tags.pop()].pop()
        while self.blocks[-1] >= place:
            self.blocks.pop()

    def close(self, tags: frozenset, walls: frozenset) -> None:
        """Close the innermost of ``tags`` unless a wall lies within."""
        place = self.last(tags)
        if place and place > self.last(walls):
            self.cut(place)

    def end(self, tag: str) -> None:
        """An end tag; a stray one of formatting closes no block."""
        place = self.last((tag,))
        if place and not (tag in INLINE and self.blocks[-1] > place):
            self.cut(place)


P, P_WALLS, BODY = frozenset({"p"}), frozenset({"button", "table", "td", "th", "caption", "object"}), frozenset({"body"})


class Page:
    """A DOM as parallel lists: tag, presentation, prior, weight, parent, path and children (numbers or text).

    Every step is linear in the length of the page.
    """

    def __init__(self, source: str):
        self.tags, self.names, self.barred, self.parent, self.paths = ["#root"], ["#root"], [False], [-1], [0]
        self.children: list[list] = [[]]
        self.soft, self.hinted, self.weights = [False], [False], [1.0]
        self._parse(source)
        self.own_text = [any(isinstance(c, str) and not c.isspace() for c in children) for children in self.children]
        self._forgive()

    def _open(self, tag: str, attributes: str, up: int) -> int:
        words: list[str] = []
        barred, named, role, hinted = tag in NO_TAGS, False, False, False
        inside = self.weights[up] == MAIN_WEIGHT
        for name, value in ATTRIBUTE.findall(attributes) if attributes else ():
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "class" or name == "id":
                found = NAME_WORDS.findall(value)
                words += found if name == "class" else ()
                whole = name == "class" or tag not in MAIN
                named |= whole and any(token.strip("-_0123456789") in NO_WORDS for token in value.split())
                hinted |= not NO_WORDS.isdisjoint(found) or not inside and not OUTSIDE_WORDS.isdisjoint(found)
            elif name == "role":
                role |= value in NO_ROLES
            elif name == "style":
                barred |= bool(HIDDEN.search(value))
            elif name == "hidden":
                barred = True
            elif name == "aria-hidden":
                barred |= value == "true"
        if tag in MAIN or tag in ("html", "body"):
            barred = role = False
            named = named and tag in MAIN
        soft = tag == "form" or not barred
        barred |= named or role or tag in OUTSIDE_TAGS and not inside
        name = ".".join([tag, *words])
        self.tags.append(tag)
        self.names.append(name)
        self.barred.append(barred)
        self.soft.append(barred and soft)
        self.hinted.append(hinted and tag not in ("html", "body"))
        self.weights.append(MAIN_WEIGHT if inside or tag in MAIN else 1.0)
        self.parent.append(up)
        self.paths.append(xxhash.xxh64_intdigest(name, self.paths[up]))
        self.children.append([])
        self.children[up].append(len(self.tags) - 1)
        return len(self.tags) - 1

    def _parse(self, source: str) -> None:
        stack = Stack()
        for text, tag, closing, attributes in Tags(source).walk():
            if text:
                self.children[stack.nodes[-1]].append(entities.unescape(text) if "&" in text else text)
            if not tag:
                continue
            if tag == "br":
                self.children[stack.nodes[-1]].append(" ")
            elif closing:
                stack.end(tag)
            else:
                if tag in CLOSES_P:
                    stack.close(P, P_WALLS)
                if tag not in HEAD_TAGS:
                    stack.close(HEAD, BODY)  # a head left open ends here
                if tag in CLOSES:
                    stack.close(*CLOSES[tag])
                node = self._open(tag, attributes, stack.nodes[-1])
                if tag not in RAW and tag not in VOID and not (attributes.endswith("/") and tag in ("svg", "path")):
                    stack.push(node, tag)

    def contents(self) -> list[int]:
        """A hash of the text of each branch, its order and its places; 0 without text, and of barred branches."""
        barred, out = self._branches(self.barred), [0] * len(self.tags)
        for k in range(len(self.tags) - 1, 0, -1):
            if not barred[k]:
                parts = [str(out[c]) if isinstance(c, int) else " ".join(c.split()) for c in self.children[k]]
                parts = [p for p in parts if p and p != "0"]
                out[k] = xxhash.xxh64_intdigest("\x00".join(parts)) if parts else 0
        return out

    def features(self) -> set[tuple[int, int, int]]:
        """(path, kind, value): 0 the node is there, 1 a style it takes, 2 a content of its branch."""
        out, barred, contents = set(), self._branches(self.barred), self.contents()
        for k in range(1, len(self.tags)):
            if barred[k]:
                continue
            path = self.paths[k]
            out.add((path, 0, 0))
            style = " ".join(self.names[c] if isinstance(c, int) else "#" for c in self.children[k] if isinstance(c, int) or c.strip())
            out.add((path, 1, xxhash.xxh64_intdigest(style)))
            if contents[k]:
                out.add((path, 2, contents[k]))
        return out

    def _below(self, flags: list[bool]) -> list[bool]:
        """Nodes that have a flagged one somewhere below them."""
        out = [False] * len(flags)
        for k in range(len(flags) - 1, 0, -1):
            if flags[k] or out[k]:
                out[self.parent[k]] = True
        return out

    def _forgive(self) -> None:
        """Unbars forms around articles, and names, roles and forms around the page's only articles or else most of its text.

        Hints that don't hold these lower the weights of their branches. A hidden
        element, a menu or the like stays barred with all that it holds.
        """
        n = len(self.tags)
        hard = self._branches([b and not s for b, s in zip(self.barred, self.soft)])
        main = [t in MAIN and not b and not h for t, b, h in zip(self.tags, self.barred, hard)]
        other = self._branches([b and t != "form" for b, t in zip(self.barred, self.tags)])  # barred by more than forms
        around = self._below([m and not o for m, o in zip(main, other)])
        self._unbar(k for k in range(n) if around[k] and self.barred[k] and not other[k])
        size, gone = self._lengths(hard), self._branches(self.barred)
        seen = self._lengths(gone)
        main = [m and size[k] > 0 for k, m in enumerate(main)]
        holds = self._below(main)
        if any(main) and not any(m and seen[k] and not gone[k] for k, m in enumerate(main)):
            self._unbar(k for k in range(n) if holds[k] and self.barred[k])
            seen = self._lengths(self._branches(self.barred))
        if not any(m and seen[k] for k, m in enumerate(main)) and 2 * seen[0] < size[0]:
            self._unbar(k for k in range(n) if self.soft[k] and not hard[k] and 2 * size[k] > size[0])
            if not self._lengths(self._branches(self.barred))[0]:
                self._unbar(k for k in range(n) if self.soft[k] and not hard[k])
        hints = self._branches([h and not holds[k] and 2 * size[k] <= size[0] for k, h in enumerate(self.hinted)])
        self.weights = [w * HINT_WEIGHT if h else w for w, h in zip(self.weights, hints)]

    def _unbar(self, nodes) -> None:
        for k in nodes:
            self.barred[k] = False

    def _branches(self, flags: list[bool]) -> list[bool]:
        """The flagged nodes and all below them."""
        out = list(flags)
        for k in range(1, len(out)):
            out[k] = out[k] or out[self.parent[k]]
        return out

    def _lengths(self, without: list[bool]) -> list[int]:
        """Characters of text in each branch, leaving nodes out."""
        out = [0 if w else sum(len(c.strip()) for c in self.children[k] if isinstance(c, str)) for k, w in enumerate(without)]
        for k in range(len(out) - 1, 0, -1):
            out[self.parent[k]] += out[k]
        return out

    def noise(self, low: dict[int, float], threshold: float) -> list[bool]:
        """The branches all of whose nodes with text are of low weighted importance."""
        out = [False] * len(self.tags)
        if low:
            kept = [False] * len(self.tags)  # a branch below stays
            bare = [True] * len(self.tags)  # no text in the branch
            for k in range(len(self.tags) - 1, 0, -1):
                if self.own_text[k]:
                    bare[k] = False
                whole = self.tags[k] in ("html", "body")
                out[k] = not whole and not kept[k] and low.get(self.paths[k], 1.0) * self.weights[k] < threshold
                if not self.barred[k] and not bare[k]:
                    bare[self.parent[k]] = False
                    kept[self.parent[k]] |= not out[k]
        return out

    def text(self, low: dict[int, float] | None = None, threshold: float = THRESHOLD) -> str:
        """Blocks of what is left, one a line, once barred branches and noise are gone.

        ``low`` has the importance of paths that the tree finds low. Inline elements
        amid the text of a block are part of that block and go with it alone. If noise
        is all the page has, it stays.
        """
        noise = self.noise(low or {}, threshold)
        return self._blocks(noise) or self._blocks([False] * len(noise)) if any(noise) else self._blocks(noise)

    def _blocks(self, noise: list[bool]) -> str:
        blocks: list[str] = []
        run: list[str] = []

        def flush() -> None:
            words = "".join(run).split()
            if words:
                blocks.append(" ".join(words))
            run.clear()

        todo: list = [0]
        while todo:
            item = todo.pop()
            if item is None:
                flush()
            elif isinstance(item, str):
                run.append(item)
            else:
                block = self.tags[item] not in INLINE
                if self.barred[item] or noise[item] and (block or not self.own_text[self.parent[item]]):
                    if block:
                        flush()
                    continue
                if block:
                    flush()
                    todo.append(None)
                todo += reversed(self.children[item])
        flush()
        return "\n".join(blocks)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def style_tree(pages: DataFrame) -> DataFrame:
    """The merged trees: host, path, pages, styles, importance of every node.

    ``pages`` has host and html. Each page content of a host gives every fact
    once, however many copies there are: pages become one narrow row of facts, of
    which one for each (host, digest of the page) is left. Facts are then counted by
    (host, path, kind, value), so a hot host spreads over its values and template
    facts are combined before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            digests, facts = [], []
            for source in batch.column(1).to_pylist():
                digests.append(_signed(xxhash.xxh64_intdigest(source or "")))
                facts.append([{"path": _signed(p), "kind": k, "value": _signed(v)} for p, k, v in sorted(Page(source or "").features())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.int64()), pa.array(facts, FACTS)], ["host", "digest", "facts"])

    found = pages.select("host", "html").mapInArrow(run, "host string, digest long, facts array<struct<path:long,kind:int,value:long>>")
    facts = found.dropDuplicates(["host", "digest"]).select("host", F.explode("facts").alias("f")).select("host", "f.*")
    counted = facts.groupBy("host", "path", "kind", "value").agg(F.count("*").alias("k"))
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x))
    k = F.col("k").cast("double")
    nodes = counted.groupBy("host", "path").agg(
        of(0, k).alias("pages"),
        of(1, F.lit(1.0)).alias("styles"),
        of(1, k).alias("uses"),
        of(1, k * F.log(k)).alias("style_sum"),
        F.coalesce(of(2, F.lit(1.0)), F.lit(0.0)).alias("contents"),
        F.coalesce(of(2, F.log(k)), F.lit(0.0)).alias("content_sum"),
    )
    scale = F.log("pages")
    presentation = F.when(F.col("pages") < 2, 1.0).otherwise(F.least(F.lit(1.0), (F.log("uses") - F.col("style_sum") / F.col("uses")) / scale))
    content = F.when((F.col("pages") < 2) | (F.col("contents") == 0), 1.0).otherwise(1.0 - F.col("content_sum") / F.col("contents") / scale)
    fade = F.pow(F.lit(GAMMA), F.col("styles"))
    seen = (1 - fade) * presentation + fade * content
    return nodes.select("host", "path", "pages", "styles", (1 - (1 - seen) * (1 - 1 / F.col("pages"))).alias("importance"))


FACTS = pa.list_(pa.struct([("path", pa.int64()), ("kind", pa.int32()), ("value", pa.int64())]))


def extract(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Null and empty pages have an empty text. Pages of a null URL, or one without
    ``://``, count as one host with an empty name. Repeated rows give repeated
    results; copies of a page count once in the tree of their host. ``threshold`` 0
    leaves the tree out. Other columns are not carried.
    """
    sites = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    judged = style_tree(sites).where(F.col("importance") < threshold / HINT_WEIGHT).select("host", F.struct("path", "importance").alias("node"))
    low = shared_checkpoint(judged.groupBy("host").agg(F.collect_list("node").alias("low")))
    held = low.agg(F.coalesce(F.sum(2 * F.size("low") + 4), F.lit(0)).alias("n")).first()["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            trees: dict[str, dict[int, float]] = {}
            texts = []
            for source, host, row in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)):
                if host not in trees:
                    paths, values = row.values.flatten() if row.is_valid else ([], [])
                    trees[host] = dict(zip(np.asarray(paths, dtype=np.int64).view(np.uint64).tolist(), np.asarray(values).tolist()))
                texts.append(Page(source or "").text(trees[host], threshold))
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    if held <= BROADCAST_PATHS:
        joined = sites.join(F.broadcast(low), "host", "left")  # its size has just been counted
    else:  # a host may have a third of the pages: its pages are dealt to salts, its row is copied to each
        salted = sites.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        joined = salted.join(low.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "_salt"], "left")
    return (
        joined.select(F.col("page_id").cast("long"), "url", "html", "host", "low")
        .mapInArrow(run, "page_id long, url string, text string, n_chars long")
    )
