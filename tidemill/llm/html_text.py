"""Main text of web pages by line-block distribution."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemill.llm.common import each_run

#: Elements whose content is never text to read.
DROP = frozenset("nav header footer aside form menu dialog button select datalist fieldset template noscript svg canvas object audio video map".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr img picture source".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Containers that set parts of a page apart; between them the line distribution drops to zero.
APART = frozenset("html body main article section div ul ol dl table form nav header footer aside".split())
#: Words in class, id or role that mark page furniture where a name ends with them, words of place or shape that may follow, and
#: words before them that say the opposite or speak of something else.
FURNITURE_WORDS = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu|breadcrumbs?|sidebar|footer|masthead|cookies?|consent|"
    r"notice|alert|gdpr|newsletter|subscribe|subscription|share|sharing|social|related|recommend\w*|comments?|commentary|respond|responses?|discussions?|disqus|replies|popup|modal|overlay|toolbar|pagination|pager|"
    r"login|signup|search|widget|contentinfo|navigation|complementary|skip",
    re.I,
)
PLACE_WORDS = re.compile(
    r"area|articles|aside|bar|block|body|bottom|box|btns?|buttons?|card|cell|column|container|content|desktop|form|global|group|header|holder|icons?|inner|items?|law|left|link|links|list|"
    r"main|media|mobile|outer|page|panel|policy|posts|primary|results|right|row|secondary|section|side|site|slot|small|stories|thread|top|unit|widgets?|wrap|wrapper|zone|\d+",
    re.I,
)
OPPOSITE_WORDS = frozenset("no not non has have with without hide hidden show is in on under after before above below over beside near".split())
#: Words before ``header`` that make it the page's and not an article's.
PAGE_WORDS = frozenset("site page global main top masthead".split())
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(?P<close2>/?)(?P<name2>[A-Za-z][^\s/>]*)(?P<rest2>[^>]*)>",
    re.S,
)
_END_TAG = re.compile(r"</([A-Za-z][^\s/>]*)")
_MARK = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
K, SURGE = 3, 30


class _Part:
    """An open or closed container. ``named`` says that its name is furniture's; ``home`` is the outermost article or main
    around it, or else the innermost div."""

    __slots__ = ("name", "up", "named", "home", "away")

    def __init__(self, name: str, up: _Part | None, named: bool) -> None:
        self.name, self.up, self.named = name, up, named
        whole = up is not None and up.home.name in ("article", "main")
        self.home: _Part = up.home if whole or up is not None and name not in ("article", "main", "div") else self
        free = name in ("article", "main") and not named
        self.away: bool = not free and (up is not None and up.away or named and name not in ("article", "main"))


class _Lines:
    """Lines of a page: (text, weight, part) with weight the characters outside links; '' rows are gaps."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, int, _Part]] = []
        self.parts: list[str] = []
        self.linked = 0
        self.part = _Part("body", None, False)
        self.open = [Counter(body=1)]  # names of open containers, anew within each article or main

    def end(self) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                self.rows.append((text, max(0, len(text) - self.linked), self.part))
            self.parts, self.linked = [], 0

    def gap(self, k: int) -> None:
        """Leaves the place of furniture empty."""
        self.end()
        if self.rows and self.rows[-1][0]:
            self.rows += [("", 0, self.part)] * k

    def enter(self, name: str, named: bool) -> None:
        self.part = _Part(name, self.part, named)
        if name in ("article", "main"):
            self.open.append(Counter())
        self.open[-1][name] += 1

    def leave(self, name: str) -> None:
        """Closes the innermost container of that name; other ends do not reach out of an article."""
        if not (any(c[name] for c in self.open[1:]) if name in ("article", "main") else self.open[-1][name]):
            return
        while self.part.up is not None:
            own, self.part = self.part.name, self.part.up
            self.open[-1][own] -= 1
            if own in ("article", "main"):
                self.open.pop()
            if own == name:
                return

    def read(self, k: int) -> list[tuple[str, int, _Part]]:
        """The rows, gaps in place of what furniture holds; an article or main in it is not furniture unless it is named so."""
        self.end()
        kept: list[tuple[str, int, _Part]] = []
        for row in self.rows:
            if not row[2].away:
                kept.append(row)
            elif kept and kept[-1][0]:
                kept += [("", 0, row[2])] * k
        return kept


def _names_furniture(name: str) -> bool:
    """Whether a name (``user-comments``, ``adBox``) ends with a word of furniture, words of place aside."""
    words = [w for w in re.split(r"[^A-Za-z0-9]+", _CAMEL.sub("-", name).lower()) if w]
    if OPPOSITE_WORDS.intersection(words):
        return False
    if words[-1:] == ["header"] and PAGE_WORDS.intersection(words[:-1]):
        return True
    while words and not FURNITURE_WORDS.fullmatch(words[-1]):
        if not PLACE_WORDS.fullmatch(words.pop()):
            return False
    return bool(words)


def _furniture(rest: str) -> bool:
    """Whether class, id or role of a tag name furniture."""
    return bool(rest) and any(_names_furniture(name) for x, y, z in _MARK.findall(rest) for name in (x or y or z).split())


class _Ends:
    """Where a page's end tags are, by name, found in one pass."""

    def __init__(self, page: str) -> None:
        self.page, self.known = page, None

    def after(self, at: int, *names: str) -> int:
        """The next end of any of the names, or the page's."""
        if self.known is None:
            self.known = {}
            for m in _END_TAG.finditer(self.page):
                self.known.setdefault(m[1].lower(), []).append(m.start())
        found = [ends[k] for ends in (self.known.get(name, []) for name in names) if (k := bisect_left(ends, at)) < len(ends)]
        return min(found, default=len(self.page))


def lines(page: str) -> list[tuple[str, int, _Part]]:
    """Strips markup; one line per block element, K empty lines in place of furniture."""
    out, at, n = _Lines(), 0, len(page)
    last = page.rfind(">") + 1  # no tag ends beyond; without this bound each "<" there would be followed to the page's end
    dropped: list[str] = []  # open elements inside dropped content, outermost first
    article = link = 0
    loose, ends = False, _Ends(page)
    while at < n:
        m = _TOKEN.search(page, at, max(at, last))
        text = page[at : m.start()] if m else page[at:].split("<!--")[0]
        if text and not dropped:
            out.parts.append(text)
            if link:
                out.linked += len(" ".join(html.unescape(text).split()))
        if not m or m[0].startswith("<!--") and not m[0].endswith("-->"):
            break
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        closing, rest = (m["close"] or m["close2"]) == "/", m["rest"] or m["rest2"] or ""
        if not closing and name in RAW:
            stop = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = stop.end() if stop else n
            if not dropped and name not in ("title", "script", "style"):
                out.end()
            continue
        if loose and dropped and not closing and name not in INLINE and name not in VOID:
            dropped.clear()  # what has no end of its own, as a paragraph may, ends where another block begins
        if dropped:
            if name in VOID:
                continue
            if not closing and name == dropped[0]:
                dropped.append(name)
            elif closing and name == dropped[0]:
                dropped.pop()
            elif name in ("article", "main", "body") and dropped[0] not in ("div", "section"):
                dropped.clear()  # an element that was never closed can't hold the article
                article += name == "article" and not closing
                if name != "body":
                    out.leave(name) if closing else out.enter(name, _furniture(rest))
            continue
        if name in VOID:
            if name in ("br", "hr"):
                out.end()
            continue
        if not closing:
            named = name not in ("html", "body") and name not in INLINE and _furniture(rest)
            away = name in DROP and not (name == "header" and article) or (rest and bool(_HIDDEN.search(rest)))
            if away or (named and name not in APART):
                if not rest.endswith("/"):
                    dropped.append(name)
                    loose = name == "p" or ends.after(at, name) >= ends.after(at, "article", "main", "body")
                out.gap(K)
                continue
        if name == "a":
            link = 0 if closing else 1
        elif name == "article":
            article = max(0, article + (-1 if closing else 1))
        if name not in INLINE:
            link = 0
            out.end()
            if name in APART and name not in ("html", "body"):
                if closing:
                    out.leave(name)
                elif not rest.endswith("/"):
                    out.enter(name, named)
    return out.read(K)


def spans(weights: list[int], k: int = K, surge: int = SURGE) -> list[tuple[int, int]]:
    """Where text surges and dives: runs [begin, end) of lines whose sliding windows of k lines never sum to zero,
    and in which some window reaches ``surge`` characters."""
    n = len(weights)
    sums, total = [], 0
    for i in range(n + k - 1):
        total += weights[i] if i < n else 0
        total -= weights[i - k] if i >= k else 0
        sums.append(total)  # of lines i-k+1 .. i
    found, i = [], 0
    while i < n:
        if not weights[i]:
            i += 1
            continue
        begin = i
        while i < n and sums[i + k - 1]:
            i += 1
        if max(sums[begin : i + k - 1], default=0) >= surge:
            found.append((begin, i))
    return found


def extract(page: str | None, k: int = K, surge: int = SURGE) -> str:
    """Main text of a page: blocks in page order, joined by one newline; '' for null, empty or text-free pages.

    Text surges and dives as ``spans`` says. The container in which most text surges (outermost article or main; without
    one, innermost div or the body) is the article, and so is every other with at least a quarter of its text. Of these all
    lines are kept between a surge and its dive, with windows taken over their lines alone, so that nothing beside the
    article counts; once in the article, text of any length surges. Lines that are all links don't, but those between two
    stretches of one article are its own, as is one that ends it.
    """
    rows = lines(page or "")
    weights = [w for _, w, _ in rows]
    found = spans(weights, k, surge) or spans(weights, k, 1)
    if not found:
        return ""
    total: dict[_Part, int] = {}
    for a, b in found:
        for i in range(a, b):
            total[rows[i][2].home] = total.get(rows[i][2].home, 0) + weights[i]
    heavy = max(total, key=total.__getitem__)
    homes = {h for h in total if 4 * total[h] >= total[heavy]}

    known: dict[_Part, bool] = {heavy: True}

    def inside(part: _Part) -> bool:
        way = []
        while part not in known and part.up is not None:
            way.append(part)
            part = part.up
        found = known.get(part, False)
        known.update(dict.fromkeys(way, found))
        return found

    held = inside if heavy.up is not None else lambda part: part.home is heavy
    own = [row for row in rows if row[2].home in homes or held(row[2])]
    kept = spans([w for _, w, _ in own], k, 1)
    return "\n".join(own[i][0] for i in _with_links(own, kept, k) if own[i][0])


def _with_links(rows: list[tuple[str, int, _Part]], kept: list[tuple[int, int]], k: int) -> list[int]:
    """Indexes of kept rows and of linked ones that belong to them: all between two stretches of one article, where furniture
    leaves no gap, and fewer than k that follow a stretch in the container in which it ends, as a last paragraph does."""
    out: list[int] = []
    for n, (begin, end) in enumerate(kept):
        out += range(begin, end)
        after = kept[n + 1][0] if n + 1 < len(kept) else len(rows)
        home, part = rows[end - 1][2].home, rows[end - 1][2]
        between = range(end, after)
        if after < len(rows) and rows[after][2].home is home and all(rows[i][2].home is home for i in between if rows[i][0]):
            out += between
            continue
        tail = 0
        while end + tail < after and rows[end + tail][0] and rows[end + tail][2] is part:
            tail += 1
        if tail < k:
            out += range(end, end + tail)
    return out


def extract_pages(pages: DataFrame, key: str = "page_id", column: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """(key, *keep, text, n_chars) of every page. Null html counts as empty; rows stay one to one."""
    names = [f"c{i}" for i in range(1 + len(keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in each_run(batches, "html", 4 << 20):
            texts = [extract(x.as_py()) for x in t.column("html")]
            yield pa.RecordBatch.from_arrays(
                [*(t.column(c).combine_chunks() for c in names), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*names, "text", "n_chars"]
            )

    slim = pages.select(*(pages[c].alias(n) for c, n in zip((key, *keep), names)), pages[column].alias("html"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema[: len(names)])
    return slim.mapInArrow(run, f"{schema}, text string, n_chars long").toDF(key, *keep, "text", "n_chars")
