"""Main text of web pages, with a style tree for each site.

The pages of a host are merged: elements with the same path of tags, classes and places are one node of the site's
tree. The importance of a node is the entropy of its content, and of the layout of its children, over the different
pages of the host: what stays the same from page to page (menus, slogans, notices) has little and is removed,
inside articles as well. Two things are known of elements before any page is compared, and cut their importance
below every limit: a declared purpose other than the page's text (``nav``, ``footer``, ``class=comments``), and
lying outside the part that the page declares to be its text (``main``, else ``article``). A name of which only a part
is telling (``red-alert``) cuts it less, and removes nothing by itself.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from autobi.llm import common

TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
NUMBER = re.compile(r"\d+")
SPACE = re.compile(r"\s+")

# Elements of HTML by what they are to a reader.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
HEAD = frozenset("title style script meta link base noscript template head html".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("html head body caption tbody td tfoot th thead tr option optgroup legend".split())
OUT = frozenset("nav footer aside form script style noscript template iframe svg math canvas object audio video button select textarea dialog menu search head title xmp noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
# A chosen list: parts of class names that tell what is not the page's text.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle alert banner breadcrumb breadcrumbs comment comments consent cookie cookiebar cookies disclaimer disqus feedback footer gdpr masthead"
    " menu modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promotion recommended related replies reply respond"
    " share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
# Chosen lists: parts of a class name that say nothing of its own, first parts that speak of something elsewhere, parts
# that in a name with a side may speak of what lies beside, and elements of running text.
PLAIN = frozenset(
    "area article articles bar block bottom box button buttons container content form inner item items left link links list main outer page panel post posts primary right row section secondary site slot stories text thread top"
    " unit wrap wrapper".split()
)
ABOUT = frozenset("has is no with without".split())
LAYOUT = frozenset("menu nav sidebar".split())
SIDES = frozenset("bottom content left right top".split())
RUNNING = frozenset("a abbr b big blockquote caption cite code dd dt em figcaption font h1 h2 h3 h4 h5 h6 i li mark p pre q s small span strong sub sup td th tr u".split())
#: Elements told apart from their like by their place; those of running text (p, li, td, ...) are one node.
PLACED = frozenset("div section ul ol dl table menu details fieldset figure article aside header".split())
#: An element that starts while one of these is open closes it, unless the second kind lies between.
SIBLINGS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])), "dd": (frozenset(["dd", "dt"]), frozenset(["dl"])), "dt": (frozenset(["dd", "dt"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}


#: How a name speaks of an element: not at all, against it, of something beside it, or as one part of a longer name.
NO, SURE, BESIDE, WEAK = range(4)


def declared_name(name: str, tag: str, inside: int) -> int:
    """What a class name or id declares of an element; its last telling part says what a thing is.

    ``sidebar-left`` may as well stand on what has a sidebar to its left; ``red-alert`` may be anything, so that it
    only weighs, and not at all on running text.
    """
    whole = [part for part in re.split("[-_]+", name) if part]
    parts = [part for part in whole if part not in PLAIN]
    known = lambda part: part in NAMES or (part == "header" and not inside)
    if not parts or not known(parts[-1]) or parts[0] in ABOUT:
        return NO
    if not all(map(known, parts)):
        return NO if tag in RUNNING else WEAK
    return BESIDE if len(parts) == 1 and parts[0] in LAYOUT and not SIDES.isdisjoint(whole) else SURE


def declared_out(tag: str, names: list[str], role: str, inside: int) -> int:
    """Whether, and how, an element is declared to be something other than the page's text."""
    if tag in OUT or role in ROLES or (tag == "header" and not inside):
        return SURE
    if tag in ("html", "body"):
        return NO
    said = {declared_name(name, tag, inside) for name in names}
    return next((kind for kind in (SURE, BESIDE, WEAK) if kind in said), NO)


MASK, FACTOR = (1 << 64) - 1, 0x9FB21C651E98DF25


def fold(value: int, more: int) -> int:
    return (value * FACTOR + more + 1) & MASK


class Open:
    """The open elements, and of each tag where it was opened, so that closing one never searches the stack."""

    def __init__(self):
        self.tags: list[str] = [""]
        self.nodes: list[int] = [0]
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, tag: str, node: int) -> None:
        self.at.setdefault(tag, []).append(len(self.tags))
        if tag in BLOCK:
            self.blocks.append(len(self.tags))
        self.tags.append(tag)
        self.nodes.append(node)

    def cut(self, size: int) -> None:
        while len(self.tags) > size:
            tag = self.tags.pop()
            self.nodes.pop()
            self.at[tag].pop()
            if tag in BLOCK:
                self.blocks.pop()

    def last(self, tags) -> int:
        return max((own[-1] for tag in tags if (own := self.at.get(tag))), default=0)

    def close(self, tags, barrier: int = 0) -> None:
        """Close the innermost of ``tags`` and all in it, unless it lies outside the element at ``barrier``."""
        place = self.last(tags)
        if place > barrier:
            self.cut(place)


class Page:
    """Elements and blocks of text of one page; element 0 is the page itself, and parents come before children.

    Parts declared to be something else are left out. ``inside`` has 1 for what lies in ``main`` and 2 for what
    lies in an ``article``. Takes time in proportion to the page, whatever its nesting.
    """

    def __init__(self, page: str | None):
        self.path, self.parent, self.layout, self.inside, self.whole, self.said = [0], [-1], [0], [0], [True], [NO]
        self.blocks: list[tuple[str, int]] = []
        self._parse(page or "")
        if BESIDE in self.said:
            self._leave_out_beside()
        kinds = [self.inside[node] for _, node in self.blocks]
        self.region = next((bit for bit in (1, 2) if any(k & bit for k in kinds)), 0)

    def _leave_out_beside(self) -> None:
        """Leave out what lies to a side, unless it holds ``main`` or half of the page's text: then something lies beside it."""
        held, main = [0] * len(self.path), [False] * len(self.path)
        for text, node in self.blocks:
            held[node] += len(text)
            main[node] = main[node] or self.inside[node] & 1 > 0
        for node in range(len(self.path) - 1, 0, -1):
            held[self.parent[node]] += held[node]
            main[self.parent[node]] = main[self.parent[node]] or main[node]
        gone = [False] * len(self.path)
        for node in range(1, len(self.path)):
            around = 2 * held[node] >= held[0] or (main[node] and not self.inside[node] & 1)
            gone[node] = gone[self.parent[node]] or (self.said[node] == BESIDE and not around)
        self.blocks = [b for b in self.blocks if not gone[b[1]]]

    def _parse(self, page: str) -> None:
        stack, counts, at, size = Open(), {}, 0, len(page)
        buffer: list[str] = []
        holder, blank, skip = 0, True, 0  # skip: how deep the stack was when a part to leave out began

        def flush() -> None:
            nonlocal blank
            text = "" if blank else SPACE.sub(" ", markup.unescape("".join(buffer))).strip()
            if text:
                self.blocks.append((text, holder))
            buffer.clear()
            blank = True

        def text(part: str) -> None:
            nonlocal holder, blank
            if part and not skip:
                if blank and not part.isspace():
                    holder, blank = stack.nodes[-1], False
                buffer.append(part)

        def closed() -> None:
            nonlocal skip
            if skip and len(stack.tags) < skip:
                skip = 0

        quoted = True  # whether quotes may still hide a ">"
        while (start := page.find("<", at)) >= 0:
            if page.startswith("<!--", start):
                text(page[at:start])
                end = page.find("-->", start + 4)
                at = size if end < 0 else end + 3
                continue
            first = page[start + 1 : start + 3]
            if not first or not (first[0] in "!?" or first.lstrip("/")[:1].isalpha()):
                text(page[at : start + 1])
                at = start + 1
                continue
            hit = TAG.match(page, start + 1) if quoted and first[0] not in "!?" else None
            if hit is None:
                end = page.find(">", start)
                if end < 0:  # no tag can follow
                    break
                text(page[at:start])
                at = end + 1
                if first[0] in "!?":
                    continue
                quoted = False  # a quote is never closed: from here on it hides nothing
                hit = re.match(r"(/?)([a-zA-Z][^\s/>]*)([^>]*)>", page[start + 1 : at])
                if hit is None:
                    continue
            else:
                text(page[at:start])
                at = hit.end()
            tag = hit[2].lower()
            if hit[1]:
                if tag in BLOCK:
                    flush()
                    stack.close((tag,))
                elif tag not in VOID:
                    stack.close((tag,), stack.blocks[-1] if stack.blocks else 0)
                closed()
                continue
            if tag == "br":
                text(" ")
                continue
            if tag in BLOCK:
                flush()
            if tag in VOID:
                continue
            if stack.tags[-1] == "head" and tag not in HEAD:
                stack.cut(len(stack.tags) - 1)
            if tag in CLOSES_P:
                stack.close(("p",), stack.last(("button", "table", "td", "th", "caption", "object")))
            if tag in SIBLINGS:
                tags, barrier = SIBLINGS[tag]
                stack.close(tags, stack.last(barrier))
            closed()
            names, role = [], ""
            for name, *values in ATTRIBUTE.findall(hit[3]):
                value = "".join(values).lower()
                if name.lower() == "role":
                    role = value
                else:
                    names += value.split()
            above = stack.nodes[-1]
            inside = self.inside[above] | (2 if tag == "article" else 1 if tag == "main" or role == "main" else 0)
            said = NO if skip else declared_out(tag, names, role, self.inside[above])
            if said == SURE:
                skip = len(stack.tags) + 1
            if skip:
                stack.push(tag, above)
            else:
                key = ".".join([tag, *(NUMBER.sub("0", name) for name in names[:2])])
                if tag in PLACED:
                    place = counts[above, key] = counts.get((above, key), 0) + 1
                    key = f"{key}[{place}]"
                own = xxhash.xxh3_64_intdigest(key)
                self.layout[above] = fold(self.layout[above], own)
                self.path.append(fold(self.path[above], own))
                self.parent.append(above)
                self.layout.append(0)
                self.inside.append(inside)
                self.whole.append(tag in ("html", "body"))
                self.said.append(said)
                stack.push(tag, len(self.path) - 1)
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
                at = end.start() if end else size
        text(page[at:])
        flush()

    def text_blocks(self) -> list[tuple[str, int]]:
        """The blocks in what the page declares to be its text; all if it declares nothing."""
        return [b for b in self.blocks if self.inside[b[1]] & self.region] if self.region else self.blocks

    def nodes(self) -> tuple[int, dict[int, tuple[int, int, bool]]]:
        """A hash of the page's text, and for each path that holds some of it hashes of its content and its layout, and
        whether it lies in what the page declares to be its text and no name speaks against it."""
        content = [0] * len(self.path)
        whole = 0
        for text, node in self.text_blocks():
            own = xxhash.xxh3_64_intdigest(text)
            content[node] = fold(content[node], own)
            whole = fold(fold(whole, self.path[node]), own)
        found: dict[int, tuple[int, int, bool]] = {}
        for node in range(len(self.path) - 1, 0, -1):
            if content[node]:
                above, path = self.parent[node], self.path[node]
                content[above] = fold(content[above], content[node])
                before = found.get(path, (0, 0, self.region > 0))
                found[path] = fold(before[0], content[node]), fold(before[1], self.layout[node]), before[2] and self.said[node] != WEAK
        return whole, found

    def text(self, low: frozenset | set = frozenset()) -> str:
        """The text without the branches ``low`` (paths); of these html, body and those that hold all of it stay."""
        blocks = self.text_blocks()
        if low and blocks:
            held = [0] * len(self.path)
            for _, node in blocks:
                held[node] += 1
            by_path: dict[int, int] = {}
            for node in range(len(self.path) - 1, 0, -1):
                held[self.parent[node]] += held[node]
                if self.path[node] in low:
                    by_path[self.path[node]] = by_path.get(self.path[node], 0) + held[node]
            gone = [False] * len(self.path)
            for node in range(1, len(self.path)):
                path = self.path[node]
                gone[node] = gone[self.parent[node]] or (not self.whole[node] and by_path.get(path, len(blocks)) < len(blocks))
            blocks = [b for b in blocks if not gone[b[1]]]
        return "\n".join(text for text, _ in blocks)


def host(url: str | None) -> str:
    from autobi.llm.url_filter import split_url

    return split_url(url)[0]


def main_text(page: str | None, low: frozenset | set = frozenset()) -> str:
    """The page's blocks joined by line ends, less its site's branches of low importance."""
    return Page(page).text(low)


def style_trees(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, place, host, page, path, content, layout, declared)``: each page's nodes, with hashes of its id and url, of what they hold,
    of all the page's text, and whether the page declares a part to be its text and no name speaks against the node.

    Null and empty pages, and an empty table, give no row; rows without an id give theirs. Other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        names = ["page_id", "place", "host", "page", "path", "content", "layout", "declared"]
        for batch in batches:
            rows = []
            for name, url, html, place in zip(*(c.to_pylist() for c in batch.columns)):
                page = Page(html)
                whole, found = page.nodes()
                rows += [(name, place, host(url), signed(whole), signed(path), signed(content), signed(layout), declared) for path, (content, layout, declared) in found.items()]
                if len(rows) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows = []
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 8, kinds)], names)

    return _plain(pages, id_col, url_col, html_col).mapInArrow(run, "page_id long, place long, host string, page long, path long, content long, layout long, declared boolean")


def importance(nodes: DataFrame, share: float = 0.9) -> DataFrame:
    """``(host, path, pages, importance)``: entropy of a node's content (``share``) and layout over its pages,
    from 0 (always the same) to 1 (never the same, or one page only)."""
    kinds = F.explode(F.array(F.struct(F.lit("content").alias("kind"), F.col("content").alias("hash")), F.struct(F.lit("layout").alias("kind"), F.col("layout").alias("hash"))))
    counted = nodes.select("host", "path", kinds.alias("x")).groupBy("host", "path", "x.kind", "x.hash").agg(F.count("*").alias("n"))
    n = F.sum("n")
    entropy = F.when(n > 1, (F.log(n) - F.sum(F.col("n") * F.log("n")) / n) / F.log(n)).otherwise(1.0)
    each = counted.groupBy("host", "path", "kind").agg(n.alias("pages"), entropy.alias("entropy"))
    weight = F.when(F.col("kind") == "content", share).otherwise(1 - share)
    return each.groupBy("host", "path").agg(F.max("pages").alias("pages"), F.sum(F.col("entropy") * weight).alias("importance"))


def _plain(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    page, url = F.col(id_col).cast("long"), F.col(url_col).cast("string")
    return pages.select(page.alias("page_id"), url.alias("url"), F.col(html_col).cast("string").alias("html"), F.xxhash64(page, url).alias("place"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: float = 0.3, least_open: float = 0.8, min_pages: int = 3) -> DataFrame:
    """``(page_id, url, text)`` of each page.

    Text of a block has its character references decoded, runs of white space made one space and its ends
    trimmed; blocks are joined by one line end. A line break element counts as a space. Branches that at least
    ``min_pages`` different texts of the host have are removed if their importance is below ``least``, or below
    ``least_open`` on pages that declare no part to be their text, or if a name speaks weakly against it; html, body and branches that hold all of the
    page's text stay. Null and empty pages give an empty text, and pages without any text but declared other
    parts do. A null id is kept. Rows that repeat an id (or its lack) and a url each give a row and lose the
    branches that are low for one of them; copies of a text count once in their site. Other columns are not
    read; an empty table gives none. A tag that is never closed counts as text.
    """
    nodes = common.materialize(style_trees(pages, id_col, url_col, html_col))
    once = nodes.dropDuplicates(["host", "page", "path"])
    low = common.materialize(importance(once).where((F.col("importance") < max(least, least_open)) & (F.col("pages") >= min_pages)))
    counted = common.materialize(nodes.groupBy("host", "path").agg(F.count("*").alias("n")).join(low, ["host", "path"]))
    rows = nodes.select("page_id", "place", "host", "path", "declared")
    found = common.join_groups(rows, counted, ["host", "path"], "n", nodes.count()).where(F.col("importance") < F.when(F.col("declared"), least).otherwise(least_open))
    found = common.materialize(found.groupBy(F.col("page_id").alias("low_id"), F.col("place").alias("low_place")).agg(F.collect_set("path").alias("low")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, {x & MASK for x in low or ()}) for page, low in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    rows = _plain(pages, id_col, url_col, html_col).join(found, (F.col("place") == F.col("low_place")) & F.col("page_id").eqNullSafe(F.col("low_id")), "left")
    return rows.select("page_id", "url", "html", "low").mapInArrow(run, "page_id long, url string, text string")


def op9_site_tree(spark, sf_dir: str) -> DataFrame:
    return extract(common.read(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
