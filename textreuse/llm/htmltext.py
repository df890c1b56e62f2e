"""Main text of web pages by the line-block distribution.

Markup is stripped to lines, one per block of the page. Lines of menus, headers, footers, sidebars, notices, adverts,
forms and reader comments (told by element, role, class or id) and lines that are mostly links count as length zero.
The lengths are summed over sliding windows of `window` lines; text begins where a window surges over `surge` signs (over
half the largest window, on pages of short lines) and ends where the windows dive to zero. Where a page marks its article and the mark holds most of the largest window, the lines
outside it have length zero and those inside weigh more; a mark elsewhere (a card, a teaser) decides nothing.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import tidy

WINDOW = 3
SURGE = 80
#: Weight of a line of the marked article, as titles and short first lines are text there.
MARKED = 4

TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)>|<[!?/][^>]*+>",
    re.S,
)
END = re.compile(r"</([a-z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label map mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup and never text of the page.
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math object audio video canvas".split())
BOILERPLATE = frozenset("head nav footer aside form button select option dialog menu fieldset datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Words of class and id names; `name*` stands for every word that begins so.
WORDS = frozenset(
    "ad ads adv banner banners breadcrumb breadcrumbs byline consent cookie cookies disclaimer disqus footer footnav gdpr header hidden "
    "login masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pagination pager paywall "
    "popup promo promos promoted promotion recommended related reply replies respond share sharing sidebar sidebars signup skip social "
    "sponsor sponsored sponsors subscribe subscription tagcloud teaser toc toolbar topbar widget widgets warning feedback".split()
)
STEMS = ("advert", "comment", "sidebar", "cookie", "navbar", "sponsor")
#: lower() of other letters can change the length.
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
MAIN = frozenset(("article", "main"))
#: A start tag of the second kind ends an open element of the first.
ENDS = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}


def boilerplate(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element holds no main text; a header within an article is the article's own."""
    if name in BOILERPLATE or (name == "header" and not inside):
        return True
    if not attributes or attributes.isspace():
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id"):
            for w in re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", m[2] or m[3] or m[4] or "").lower()):
                if (w in WORDS and not (inside and w in ("header", "byline", "teaser", "warning"))) or w.startswith(STEMS):
                    return name not in ("html", "body")
        elif (key == "role" and value in ROLES) or key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def lines(page: str) -> list[tuple[str, int, bool, bool]]:
    """(text, signs within links, boilerplate, within the article) of each block that has text."""
    out: list[tuple[str, int, bool, bool]] = []
    stack: list[tuple[str, bool, bool]] = [("", False, False)]
    low = page.lower()
    if len(low) != len(page):  # offsets in it are used in the page
        low = page.translate(LOWER)
    last = {m[1]: m.start() for m in END.finditer(low)}  # where each name is closed for the last time
    held: Counter[str] = Counter()  # open elements by name
    parts: list[str] = []
    links, depth, at, once = 0, 0, 0, False

    def flush() -> None:
        nonlocal links, once
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((text, links, stack[-1][1] or once, stack[-1][2]))
            parts.clear()
        links, once = 0, False

    def enter(name: str, drop: bool, inside: bool) -> None:
        stack.append((name, drop, inside))
        held[name] += 1

    def leave() -> str:
        name = stack.pop()[0]
        held[name] -= 1
        return name

    def say(text: str) -> None:
        nonlocal links
        if text:
            parts.append(text)
            if depth:
                links += len(text)

    while at < len(page):
        m = TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                say(m[0][9:-3])
            continue
        rest = m["rest"] if m["name"] else m["rest2"]
        if m["end"] or m["end2"]:
            if name == "a":
                depth = 0
            if held[name]:
                flush()
                while leave() != name:
                    pass
            elif name not in INLINE:
                flush()
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>?").search(low, at) if last.get(name, -1) >= at else None
            if not rest.rstrip().endswith("/"):
                at = end.end() if end else (len(page) if name in ("script", "style") else at)
            if name not in INLINE and name != "script":
                flush()
            continue
        if name == "br":
            say(" ")
            continue
        if name == "a":
            depth = 1
        inline, inside = name in INLINE, stack[-1][2]
        if inline:
            if rest and not stack[-1][1] and name not in VOID and boilerplate(name, rest, inside) and last.get(name, -1) >= at:
                flush()
                enter(name, True, inside)
            continue
        flush()
        while len(stack) > 1 and stack[-1][0] in ENDS and (ENDS[stack[-1][0]] is None or name in ENDS[stack[-1][0]]):
            leave()
        inside = stack[-1][2]
        if name in VOID or rest.endswith("/"):
            continue
        drop = boilerplate(name, rest, inside)
        if drop and name not in ENDS and last.get(name, -1) < at:
            once = True  # never closed: only what follows at once belongs to it
            continue
        main = name in MAIN or (name not in ("html", "body") and 'role="main"' in rest) or 'itemprop="articleBody"' in rest
        enter(name, stack[-1][1] or drop, inside or (main and not drop))
    flush()
    return out


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The text between surges and dives, blocks joined by one space; empty for a null or empty page."""
    rows = lines(page) if page else []
    sizes = [0 if drop or (2 * linked > len(t)) else len(t) for t, linked, drop, _ in rows]
    sums = [sum(sizes[i : i + window]) for i in range(len(rows))]
    if any(sizes):
        within = [n if inside else 0 for n, (_, _, _, inside) in zip(sizes, rows, strict=True)]
        best = max(range(len(rows)), key=lambda k: sums[k])
        if 2 * sum(within[best : best + window]) > sums[best]:
            sizes, sums = within, [MARKED * sum(within[i : i + window]) for i in range(len(rows))]
    least = min(surge, max(sums, default=0) / 2)
    kept, i = [], 0
    while i < len(rows):
        if sizes[i] and sums[i] > least:
            while i < len(rows) and sums[i]:
                if sizes[i]:
                    kept.append(rows[i][0])
                i += 1
        else:
            i += 1
    return " ".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row per page. Null and empty html give an empty text; repeated rows and null
    ids or urls are carried along; an empty table gives an empty table. A page of any length is read whole, in time that
    grows with its length."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [main_text(x.as_py()) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
