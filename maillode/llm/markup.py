"""Main text of web pages: what their sites repeat on page after page is taken out.

Every page is read into a tree of elements, and the trees' subtrees are hashed. Spark counts for
each host in how many pages of different content a subtree stands; those that come back on many
pages of the host are its template and are deleted with all they hold. What can't be told by
counting, as on hosts with few pages or for adverts and comments that change with the page, goes
by the elements' names. What is left of the article is the text.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import no_collections, stored

#: A subtree is part of a template if it stands in so many pages of different content of its
#: host at least, and in such a share of them. The first share is for containers outside of
#: articles, the second for plain paragraphs and what an article holds. They bound what a host's
#: template holds: the mean number of subtrees of its pages, divided by the share.
LEAST_PAGES = 4
LEAST_SHARE = 0.02
LEAST_SHARE_OF_TEXT = 0.25

# Fixed words of HTML: elements by what they do to the text around them.
_VOID = frozenset(
    "area base basefont bgsound br col embed frame hr img input keygen link meta param source "
    "track wbr".split()
)
_RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li "
    "main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr "
    "ul".split()
)
_CELLS = frozenset(["td", "th"])
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_HEAD_ONLY = frozenset("base basefont bgsound link meta noscript script style template title".split())
#: A start tag of these ends an open paragraph.
_ENDS_P = _BLOCKS - frozenset(
    "body caption dd dt html legend li optgroup option tbody tfoot thead tr".split()
) | frozenset(["dd", "dt", "li"])
#: Start tags that end an open element of the second kind, looked for up to one of the third.
_LISTS = frozenset("ul ol menu dir dl".split())
_TABLE = frozenset(["table"])
_ENDS = {
    "li": (frozenset(["li"]), _LISTS),
    "dd": (frozenset(["dd", "dt"]), _LISTS),
    "dt": (frozenset(["dd", "dt"]), _LISTS),
    "tr": (frozenset(["tr"]), _TABLE),
    "td": (_CELLS, _TABLE | {"tr"}),
    "th": (_CELLS, _TABLE | {"tr"}),
    "tbody": (frozenset("thead tbody tfoot".split()), _TABLE),
    "tfoot": (frozenset("thead tbody tfoot".split()), _TABLE),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
#: Nothing looks for an open element beyond these.
_WALLS = frozenset("html table td th caption template button object".split())

_KEPT_OPEN = frozenset(["body", "html"])
_P = frozenset(["p"])

#: Elements without main text, whatever their site.
_DROPPED_TAGS = frozenset(
    "aside button canvas dialog footer form head menu nav noscript object search select svg "
    "template".split()
)
_WHOLE = frozenset("body html main".split())
_LOOSE = frozenset("aside footer nav".split())
_NEVER_HOLD = _LOOSE | frozenset("head noscript svg template".split())
#: Words in an element's class, id or role that say the same.
_DROPPED_NAMES = frozenset(
    # menus
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager share sharing "
    "social related recommended contentinfo "
    # headers, footers, sidebars
    "header masthead topbar banner footer sidebar sidebars aside widget widgets complementary "
    # notices
    "notice notices cookie cookies consent gdpr alert popup modal overlay toast dialog "
    # adverts
    "ad ads advert adverts advertisement advertisements advertising adsbygoogle sponsor "
    "sponsored sponsors promo promos promotion promotions "
    # forms
    "form search searchbox newsletter subscribe subscription signup login "
    # reader comments
    "comment comments commentlist disqus respond reply replies".split()
)
#: Of these, what may hold an article's title inside of it.
_TITLES = frozenset(["header", "masthead", "banner"])
#: A class that begins so says what its element has around or in it.
_NOT_ITSELF = frozenset("has no with without not hide".split())
#: Inside an article these alone may be part of a template: its plain paragraphs, headings and
#: quotations are text, even when many pages share them.
_CONTAINERS = frozenset(
    "aside div dl fieldset footer form header menu nav ol section table ul".split()
)
_PLAIN = _BLOCKS - _CONTAINERS - frozenset(
    "html body main article tbody thead tfoot tr".split()
)

_TAG_END = r"((?>=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>])*+)(?:>|\Z)"
#: A comment; an element whose content is no markup, whole; a tag; what else begins like one.
_TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))"
    rf"|<({'|'.join(sorted(_RAW))})(?=[\s/>]){_TAG_END}.*?(?:</\1(?=[\s/>])[^>]*>|\Z)"
    rf"|<(/?)([a-z][^\s/>]*+){_TAG_END}"
    rf"|<[!?/][^>]*+(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(
    r"(?i)(?<![^\s\"'/])(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
)
_NONE: frozenset[str] = frozenset()
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@functools.cache
def _ended_by(tag: str) -> tuple[frozenset[str], frozenset[str]]:
    """Which open elements an end tag may end, and which ones it does not reach beyond."""
    if tag in _HEADINGS:
        return _HEADINGS, _WALLS
    if tag in _BLOCKS or tag in _CELLS or tag in _DROPPED_TAGS:
        return frozenset([tag]), _WALLS - {tag} | (_LISTS if tag == "li" else frozenset())
    return frozenset([tag]), (_BLOCKS | _CELLS) - {tag}


class Page:
    """The elements of one page. Element 0 is the page itself.

    ``items`` is the page in order: texts, and elements as ``n`` where the ``n``-th begins and
    ``-n`` where it ends, so that a subtree is a slice. ``0`` stands for a break.
    """

    def __init__(self, source: str):
        self.items: list[str | int] = []
        self.tags = [""]
        self.names = [""]
        self.parents = [0]
        self.begins = [0]
        self.ends = [0]
        self._read(source)
        self.ends[0] = len(self.items)

    def _read(self, source: str) -> None:
        items, tags, names, parents, begins, ends = (
            self.items, self.tags, self.names, self.parents, self.begins, self.ends
        )
        open_ = [0]
        n_open: Counter[str] = Counter()

        def close(depth: int) -> None:
            while len(open_) > depth:
                node = open_.pop()
                n_open[tags[node]] -= 1
                ends[node] = len(items)
                items.append(-node)

        def find(wanted: frozenset[str], walls: frozenset[str]) -> int:
            if not any(n_open[tag] for tag in wanted):
                return 0
            for depth in range(len(open_) - 1, 0, -1):
                tag = tags[open_[depth]]
                if tag in wanted:
                    return depth
                if tag in walls:
                    break
            return 0

        def text(piece: str) -> None:
            if tags[open_[-1]] == "head" and not piece.isspace():
                close(len(open_) - 1)
            items.append(entities.unescape(piece) if "&" in piece else piece)

        at = 0
        for match in _TOKEN.finditer(source):
            if at < match.start():
                text(source[at : match.start()])
            at = match.end()
            _, _, ending, tag, attributes = match.groups()
            if tag is None:
                continue
            tag = tag.lower()
            if ending:
                if tag in _KEPT_OPEN:
                    continue
                depth = len(open_) - 1 if tags[open_[-1]] == tag else find(*_ended_by(tag))
                if depth:
                    close(depth)
                elif tag == "p":
                    items.append(0)
                continue
            if tag in _VOID:
                if tag == "br":
                    items.append(" ")
                elif tag == "hr":
                    if depth := find(_P, _WALLS):
                        close(depth)
                    items.append(0)
                continue
            if tag in _KEPT_OPEN and n_open[tag]:
                continue
            if tags[open_[-1]] == "head" and tag not in _HEAD_ONLY:
                close(len(open_) - 1)
            if tag in _ENDS_P and (depth := find(_P, _WALLS)):
                close(depth)
            if tag in _HEADINGS and tags[open_[-1]] in _HEADINGS:
                close(len(open_) - 1)
            if tag in _ENDS and (depth := find(*_ENDS[tag])):
                close(depth)
            node = len(tags)
            tags.append(tag)
            names.append(attributes)
            parents.append(open_[-1])
            begins.append(len(items))
            ends.append(0)
            items.append(node)
            open_.append(node)
            n_open[tag] += 1
            if attributes.endswith("/") and (n_open["svg"] or n_open["math"]):
                close(len(open_) - 1)
        if at < len(source):
            text(source[at:])
        close(1)

    def judge(self) -> None:
        """Sets ``dropped``, ``inside`` (elements of an article) and ``regions``."""
        n = len(self.tags)
        tags = self.tags
        words = [self._words(node) if "=" in self.names[node] else _NONE for node in range(n)]
        named = [
            tags[node] not in _WHOLE and not words[node].isdisjoint(_DROPPED_NAMES)
            for node in range(n)
        ]
        # Articles in a menu, sidebar or footer, or in what is named like one or like comments,
        # are no article; the last only if there is another one.
        regions, inside = self._articles(named)
        if not regions:
            regions, inside = self._articles(
                [named[node] and tags[node] == "article" for node in range(n)]
            )
        if not regions:
            marked = {n for n in range(1, n) if tags[n] == "main" or "role=main" in words[n]} or {
                n for n in range(1, n) if "itemprop=articlebody" in words[n]
            }
            regions = [n for n in sorted(marked) if marked.isdisjoint(self._above(n))]
        # What an article lies in is no part of a menu or form, whatever its name. Without one,
        # that holds for what the first heading lies in.
        held = set(regions) or {node for node in range(1, n) if tags[node] == "h1"}
        holders: set[int] = set()
        for node in held:
            while node and node not in holders:
                holders.add(node)
                node = self.parents[node]
        self.inside = inside
        self.regions = regions or [0]
        self.dropped = [
            node > 0
            and (regions == [] or node not in held)
            and self._unwanted(node, words[node], inside[node], node in holders, bool(regions))
            for node in range(n)
        ]

    def _articles(self, not_theirs: list[bool]) -> tuple[list[int], list[bool]]:
        """Elements that are articles, and which elements lie in one."""
        regions = []
        loose, inside = [False], [False]
        for node in range(1, len(self.tags)):
            up, tag = self.parents[node], self.tags[node]
            loose.append(loose[up] or tag in _LOOSE or not_theirs[node])
            inside.append(inside[up] or (tag == "article" and not loose[node]))
            if tag == "article" and not loose[node] and not inside[up]:
                regions.append(node)
        return regions, inside

    def _above(self, node: int) -> Iterator[int]:
        while node := self.parents[node]:
            yield node

    def _words(self, node: int) -> set[str]:
        out: set[str] = set()
        for name, *values in _ATTRIBUTE.findall(self.names[node]):
            for value in "".join(values).split():
                parts = [part.lower() for part in _WORDS.findall(value)]
                if name.lower() in ("role", "itemprop"):
                    out.add(f"{name.lower()}={value.lower()}")
                if parts and parts[0] not in _NOT_ITSELF:
                    out.update(parts)
        return out

    def _unwanted(
        self, node: int, words: set[str], inside: bool, holds_main: bool, by_tag: bool
    ) -> bool:
        tag = self.tags[node]
        if tag in _NEVER_HOLD:
            return not (holds_main and by_tag)
        if holds_main or tag in ("html", "body", "main") or tag in _HEADINGS:
            return False
        if tag in _DROPPED_TAGS or (tag == "header" and not inside):
            return True
        named = words & _DROPPED_NAMES
        return bool(named - _TITLES if inside else named)

    def subtrees(self) -> tuple[dict[int, int], int]:
        """Hashes of the subtrees that may be part of a template, by element, and the regions'.

        A subtree's hash is made of its elements and texts, whatever their attributes. Its last
        bit tells text from containers outside of articles.
        """
        tags, inside, digest_of = self.tags, self.inside, xxhash.xxh3_64_digest
        out: dict[int, int] = {}
        regions = dict.fromkeys(self.regions, b"")
        parts: list[list[bytes]] = [[]]
        for item in self.items:
            if isinstance(item, str):
                if words := item.split():
                    parts[-1].append(" ".join(words).encode("utf-8", "surrogatepass"))
            elif item > 0:
                parts.append([])
            elif item < 0:
                own = parts.pop()
                if not own:
                    continue  # no text
                node = -item
                tag = tags[node]
                digest = digest_of(b"\0".join([tag.encode("utf-8", "replace"), *own]))
                parts[-1].append(digest)
                if node in regions:
                    regions[node] = digest
                if tag in _CONTAINERS or (tag in _PLAIN and not inside[node]):
                    of_text = inside[node] or tag in _PLAIN
                    number = int.from_bytes(digest, "little", signed=True)
                    out[node] = number | 1 if of_text else number & -2
        if 0 in regions:
            regions[0] = b"\0".join(parts[0])
        content = digest_of(b"\0".join(regions.values()))
        return out, int.from_bytes(content, "little", signed=True)

    def text(self, deleted: frozenset[int] | set[int] = frozenset()) -> str:
        """The blocks of the regions without the dropped and the deleted elements."""
        blocks: list[str] = []
        buffer: list[str] = []

        def flush() -> None:
            if block := " ".join("".join(buffer).split()):
                blocks.append(block)
            buffer.clear()

        for region in self.regions:
            at, end = self.begins[region], self.ends[region]
            while at < end:
                item = self.items[at]
                at += 1
                if isinstance(item, str):
                    buffer.append(item)
                    continue
                node = abs(item)
                tag = self.tags[node]
                if item == 0 or tag in _BLOCKS:
                    flush()
                elif tag in _CELLS:
                    buffer.append(" ")
                if item > 0 and (self.dropped[item] or item in deleted):
                    at = self.ends[item] + 1
            flush()
        return "\n\n".join(blocks)


def read_page(source: str | None) -> Page:
    page = Page(source or "")
    page.judge()
    return page


def page_text(source: str | None, template: frozenset[int]) -> tuple[str, int]:
    """A page's main text, and how many subtrees went as part of the template.

    A page that would be empty without its template isn't made of it alone: it keeps its text.
    """
    page = read_page(source)
    deleted = set()
    if template:
        deleted = {node for node, own in page.subtrees()[0].items() if own in template}
    text = page.text(deleted)
    if deleted and not text:
        return page.text(), 0
    return text, len(deleted)


def host_of(url: str) -> F.Column:
    """The host of an address, in small letters; null where there is none."""
    host = F.regexp_extract(
        F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1
    )
    return F.when(host != "", host)


def site_templates(
    pages: DataFrame,
    url: str = "url",
    html: str = "html",
    least_pages: int = LEAST_PAGES,
    least_share: float = LEAST_SHARE,
    least_share_of_text: float = LEAST_SHARE_OF_TEXT,
) -> DataFrame:
    """``host`` and its ``template``, the sorted hashes of the subtrees its pages repeat.

    Pages of one host with the same article count as one, so that copies of a page don't make
    its text a template. Pages without a host have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents, subtrees = [], []
            with no_collections():
                for source in batch.column(1).to_pylist():
                    hashes, content = read_page(source).subtrees()
                    contents.append(content)
                    subtrees.append(list(set(hashes.values())))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(contents, pa.int64()),
                    pa.array(subtrees, pa.list_(pa.int64())),
                ],
                ["host", "content", "subtrees"],
            )

    known = pages.select(host_of(url).alias("host"), html).filter("host IS NOT NULL")
    hashed = stored(
        known.mapInArrow(run, "host string, content long, subtrees array<bigint>"), "subtrees"
    )
    each = hashed.select("host", "content", F.explode("subtrees").alias("subtree")).distinct()
    counts = each.groupBy("host", "subtree").agg(F.count("*").alias("n"))
    sizes = hashed.select("host", "content").distinct().groupBy("host").agg(
        F.count("*").alias("n_pages")
    )
    of_text = F.col("subtree").bitwiseAND(F.lit(1)) == 1
    share = F.when(of_text, least_share_of_text).otherwise(least_share)
    return (
        counts.filter(F.col("n") >= least_pages)
        .join(sizes, "host")
        .filter(F.col("n") >= share * F.col("n_pages"))
        .groupBy("host")
        .agg(F.sort_array(F.collect_list("subtree")).alias("template"))
    )


def main_text(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """One row per row of ``pages``: its id and address, ``text`` and ``n_deleted``.

    ``text`` has the article's blocks, two line feeds between them, white space inside a block
    turned into one space; it is empty for a null or empty page. ``n_deleted`` are the subtrees
    that went as part of the host's template. Where an address is null, or its host has few
    pages, the elements' names alone decide. Further columns are not passed on;
    repeated rows and null ids are rows like any other.
    """
    kinds = [pages.schema[name].dataType.simpleString() for name in (page_id, url)]
    templates = stored(site_templates(pages, url, html), "templates")
    with_template = (
        pages.select(page_id, url, html, host_of(url).alias("host"))
        .join(templates, "host", "left")
        .select(page_id, url, html, "template")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, ...], frozenset[int]] = {}
        for batch in batches:
            texts, deleted = [], []
            with no_collections():
                for row in range(batch.num_rows):
                    own = tuple(batch.column(3)[row].as_py() or ())
                    if len(known) > 1000:
                        known.clear()
                    template = known.setdefault(own, frozenset(own))
                    text, gone = page_text(batch.column(2)[row].as_py(), template)
                    texts.append(text.encode("utf-8", "replace"))
                    deleted.append(gone)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1),
                    pa.array(texts, pa.binary()).cast(pa.string()), pa.array(deleted, pa.int64()),
                ],
                [page_id, url, "text", "n_deleted"],
            )

    return with_template.mapInArrow(
        run, f"`{page_id}` {kinds[0]}, `{url}` {kinds[1]}, text string, n_deleted long"
    )
