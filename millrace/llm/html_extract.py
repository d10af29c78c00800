"""Main text of a web page by scores on its element tree.

The page is read into elements and *blocks* (runs of text between block-level
tags).  Elements that cannot belong to an article (menus, forms, adverts and
the like, by tag, role, class or id) are put aside with all they hold.  Every
other block passes points for its length and its commas to the elements around
it, less the further away; an element's points are discounted by the share of
its text that is link text.  The best container, raised to the article around
it if there is one, and those of its siblings that look like parts of the same
text are kept.

Siblings are looked at beside an article as well, so that a text that is
spread over several articles, or begins in front of one, comes whole.  Parsing
and scoring do not recurse and go over the page a bounded number of times, so
broken and very deep pages are read like any others: an end tag that was once
searched for in vain is not searched for again, and after one odd quote tags
end at the first ``>``.
"""

from __future__ import annotations

import functools
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import renamed, small_batches, with_fields

#: Elements that begin and end a block of text.
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements without content.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
_RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math object".split())
#: Elements that never hold an article's text.
_ASIDE = frozenset("nav aside footer form button select menu dialog head".split())
#: What a start tag closes, if open, as HTML allows the end tag to be left out.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Words in class, id or role that speak against an article.
_AGAINST = re.compile(
    r"(?i)(?:^|[\s_-])(ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|popup|modal|overlay"
    r"|sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|pagination|pager|toolbar|masthead|site-header|page-header|header"
    r"|footer|comments?|commentlist|disqus\w*|replies|respond|share|sharing|social|related|recommend\w*|newsletter|subscribe\w*"
    r"|signup|login|search|widget|complementary|contentinfo|dialog)(?=$|[\s_-])"
)
#: Of these words those that name parts of a layout; a wrapper around the whole page may carry them too.
_LAYOUT = re.compile(
    r"(?i)^(?:banner|notice|alert|overlay|modal|sidebar|side-bar|menu|nav|navbar|navigation|toolbar|masthead|site-header|page-header"
    r"|header|footer|search|widget|share|sharing|social)$"
)
#: Beginnings of class names that say what a layout has or lacks.
_MODIFIES = re.compile(r"(?i)^(?:no|has|with|without|hide|show|is|not)[-_]")
#: Words in class or id that speak for an article.
_FOR = re.compile(r"(?i)(?:^|[\s_-])(?:article\w*|body|content|entry|main|page|post|text|blog|story|column)(?:$|[\s_-])")
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>",
    re.S,
)
#: A tag in a page with an odd quote somewhere: quotes are not looked at.
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_NAMED = re.compile(r"""(?i)(?:^|\s)(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_COMMAS = re.compile("[,،﹐︐⹁、，]")

#: Blocks of fewer characters pass no points.
_LEAST = 25
#: Characters that a part of the layout needs to be taken for a wrapper.
_WRAPPER = 200
#: Levels of ancestors that points reach.
_LEVELS = 5


def _against(value: str) -> list[str]:
    """The words of a class, id or role that speak against an article, but those that say what a layout has or lacks."""
    return [m[1] for name in value.split() if not _MODIFIES.match(name) for m in _AGAINST.finditer(name)]


@functools.cache
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"(?i)</{re.escape(tag)}\b[^>]*+>")


class _Page:
    """Elements in page order (``tag, parent, aside, bonus``) and blocks ``(element, text, characters in links)``."""

    def __init__(self, source: str):
        self.tag, self.parent, self.bonus = ["#root"], [-1], [0.0]
        #: Why an element itself is no part of an article: not at all (0), as a part of the layout by its class (1), else (2).
        self.why = [0]
        self.blocks: list[tuple[int, str, int]] = []
        self._read(source)
        self.aside = self._put_aside()

    def _open(self, tag: str, parent: int, attributes: str, in_article: bool) -> int:
        why, bonus = 2 * (tag in _ASIDE), 0.0
        inside = tag in ("article", "main", "body", "html")
        if tag == "header" and not in_article:
            why = 2
        if attributes:
            for m in _NAMED.finditer(attributes):
                name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if name == "hidden" or name == "aria-hidden" and value == "true":
                    why = 2
                elif name == "style":
                    why = 2 if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) else why
                elif (against := _against(value)) and (not inside or re.search(r"(?i)comment|repl|ad(?:$|[\s_-])|promo|sponsor", value) and tag == "article"):
                    why = max(why, 1 if name != "role" and all(map(_LAYOUT.match, against)) else 2)
                elif name != "role" and _FOR.search(value):
                    bonus = 25.0
                elif name == "role" and value in ("main", "article"):
                    bonus = 25.0
        self.tag.append(tag)
        self.parent.append(parent)
        self.why.append(why)
        self.bonus.append(bonus + {"article": 30.0, "main": 20.0, "div": 5.0, "section": 5.0}.get(tag, 0.0))
        return len(self.tag) - 1

    def _put_aside(self) -> list[bool]:
        """Which elements are aside; a part of the layout that holds nearly all there is wraps the page instead."""
        n = len(self.tag)

        def below(least: int, why: list[int]) -> list[bool]:
            out = [False] * n
            for k in range(1, n):
                out[k] = out[self.parent[k]] or why[k] >= least
            return out

        aside = below(1, self.why)
        if 1 not in self.why:
            return aside
        never = below(2, self.why)
        kept = sum(len(text) for node, text, _ in self.blocks if not aside[node])
        held = [0] * n
        for node, text, _ in self.blocks:
            held[node] += 0 if never[node] else len(text)
        for k in range(n - 1, 0, -1):
            held[self.parent[k]] += held[k]
        return below(1, [0 if w == 1 and held[k] > max(5 * kept, _WRAPPER) else w for k, w in enumerate(self.why)])

    def _read(self, source: str) -> None:
        stack, open_tags = [0], {"#root": 1}
        parts: list[str] = []
        linked: list[int] = [0]
        block = 0  # the innermost block-level element
        blocks = [0]
        links = 0

        def end_block() -> None:
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    self.blocks.append((block, text, min(linked[0], len(text))))
                parts.clear()
            linked[0] = 0

        def pop() -> str:
            nonlocal block, links
            tag = self.tag[stack.pop()]
            open_tags[tag] -= 1
            if tag in _BLOCK:
                end_block()
                blocks.pop()
                block = blocks[-1]
            elif tag == "a":
                links -= 1
            return tag

        def take(text: str) -> None:
            if text:
                text = html.unescape(text) if "&" in text else text
                parts.append(text)
                if links:
                    linked[0] += len(text.strip())

        at, n, odd = 0, len(source), False
        begun = 0  # where the text that is not yet taken begins
        unclosed: set[str] = set()  # raw elements that no end tag follows any more
        while at < n:
            at = source.find("<", at)
            if at < 0:
                break
            name = source[at + 2 : at + 3] if source[at + 1 : at + 2] == "/" else source[at + 1 : at + 2]
            named = name.isascii() and name.isalpha()
            m = None if odd and named else _TAG.match(source, at)
            if not m and named:
                # An odd quote, or a tag without an end: what follows is read without regard to quotes.
                odd = True
                m = _LOOSE.match(source, at)
                if not m:
                    take(source[begun:at])
                    begun = n
                    break
            if not m:
                at += 1
                continue
            take(source[begun:at])
            at = begun = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag == "br":
                    parts.append(" ")
                elif open_tags.get(tag, 0) > 0 and (tag in _BLOCK or tag not in ("html", "body")):
                    # An inline end tag does not close blocks that were opened since.
                    if tag not in _BLOCK:
                        k = len(stack) - 1
                        while self.tag[stack[k]] != tag and self.tag[stack[k]] not in _BLOCK:
                            k -= 1
                        if self.tag[stack[k]] != tag:
                            continue
                    while pop() != tag:
                        pass
                elif tag in ("p",):
                    end_block()
                continue
            if tag in _RAW:
                if m[3].endswith("/") or tag in unclosed:
                    continue
                close = _end_of(tag).search(source, at)
                if close:
                    at = begun = close.end()
                else:
                    unclosed.add(tag)
                    at = begun = n if tag in ("script", "style", "title", "textarea") else at
                continue
            if tag == "br":
                parts.append(" ")
                continue
            if tag in _BLOCK:
                if open_tags.get("p", 0) > 0:
                    k = len(stack) - 1
                    while self.tag[stack[k]] not in ("p", "td", "th", "li", "div", "article", "section", "body", "#root"):
                        k -= 1
                    if self.tag[stack[k]] == "p":
                        while pop() != "p":
                            pass
                end_block()
            if tag in _CLOSES:
                closed, until = _CLOSES[tag]
                k = len(stack) - 1
                while k and self.tag[stack[k]] not in closed and self.tag[stack[k]] not in until:
                    k -= 1
                if self.tag[stack[k]] in closed:
                    while len(stack) > k:
                        pop()
            if tag in _VOID:
                if tag == "img" or tag == "wbr":
                    continue
                if tag == "hr":
                    end_block()
                continue
            node = self._open(tag, stack[-1], m[3], open_tags.get("article", 0) > 0)
            stack.append(node)
            open_tags[tag] = open_tags.get(tag, 0) + 1
            if tag in _BLOCK:
                blocks.append(node)
                block = node
            elif tag == "a":
                links += 1
        take(source[begun:])
        end_block()


def extract(source: str) -> str:
    """The main text: blocks in page order, one a line; empty if there is none."""
    page = _Page(source)
    blocks = [b for b in page.blocks if not page.aside[b[0]]]
    if not blocks:
        return ""
    n = len(page.tag)
    score, length, linked = [0.0] * n, [0] * n, [0] * n
    for node, text, link in blocks:
        length[node] += len(text)
        linked[node] += link
        if len(text) < _LEAST:
            continue
        points = 1 + len(_COMMAS.findall(text)) + min(len(text) / 100, 3)
        up = node if page.tag[node] in ("div", "section", "article", "main", "body", "#root") else page.parent[node]
        for level in range(_LEVELS):
            if up < 0:
                break
            score[up] += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            up = page.parent[up]
    for node in range(n - 1, 0, -1):  # children come after parents
        length[page.parent[node]] += length[node]
        linked[page.parent[node]] += linked[node]

    def value(node: int) -> float:
        density = linked[node] / length[node] if length[node] else 0.0
        return (score[node] + (page.bonus[node] if length[node] else 0.0)) * (1 - density)

    holders = [k for k in range(n) if length[k] and not page.aside[k] and (score[k] or page.bonus[k])]
    best = max(holders, key=lambda k: (value(k), -k), default=0)
    up = best
    while up >= 0:
        if page.tag[up] in ("article", "main"):
            best = up
            break
        up = page.parent[up]
    kept, loose = {best}, True
    if page.tag[best] not in ("body", "html", "#root"):
        level = max(10.0, 0.2 * value(best))
        # What stands beside an article in the body itself is part of the page rather than of the text.
        loose = page.tag[best] not in ("article", "main") or page.tag[page.parent[best]] not in ("body", "html", "#root")
        for k in range(1, n):
            if page.parent[k] != page.parent[best] or page.aside[k] or not length[k]:
                continue
            density = linked[k] / length[k]
            if value(k) >= level or loose and page.tag[k] in ("p", "pre", "blockquote", "h1", "h2", "h3", "ul", "ol") and density < 0.25:
                kept.add(k)
    inside = [False] * n
    for k in range(n):
        inside[k] = k in kept or k > 0 and inside[page.parent[k]]
    # Text that stands free beside kept siblings, directly in their parent.
    free = page.parent[best] if len(kept) > 1 and loose else -1
    return "\n".join(text for node, text, link in blocks if inside[node] or node == free and 4 * link < len(text))


def main_text(df: DataFrame, *, source: str = "html", into: str = "text") -> DataFrame:
    """Add ``into``, the main text of the HTML in ``source``, to every row of ``df``; other columns are kept.

    Edge cases: null or empty pages give empty text; pages of text without
    tags give that text; unclosed or crossed tags are closed as HTML allows;
    a last tag that never ends is no text; any Unicode white space counts;
    whole pages are read, of any length; repeated rows give equal texts; a
    column ``into`` of ``df`` is replaced; no rows give no rows.
    """
    small_batches(df.sparkSession)
    keep = [c for c in df.columns if c != into]
    schema = with_fields(df, keep, **{into: "string"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x.as_py() or "") for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*keep, into])

    return df.select(*renamed(keep), F.col(source).cast("string").alias("html")).mapInArrow(run, schema)


def op6(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
