"""Main text of web pages by line-block distribution.

Markup is cut into lines, one a block element.  A line weighs its characters
outside links; lines of elements that by HTML never hold main text (scripts,
menus, headers, footers, sidebars, forms) weigh nothing.  Names weigh, too: a
block that is called an advert, a sidebar, a notice or reader comments counts
for nothing unless it holds most of the page or its headline, as wrappers do; one that
is only named somewhat like that loses its short and linked lines, and its others
weigh a quarter.  Where the page's articles hold most of the weight, lines outside
them weigh nothing, and those inside never weigh nothing.  Weights are summed over a sliding window: a stretch
of lines is main text where the sums surge; it ends where they dive, and at its
last lines of any weight.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import common

#: Lines summed at each place.
WINDOW = 3
#: A sum that is a surge, in characters.  Where no sum reaches it, the greatest one is.  A sum under the other number is a dive.
SURGE, DIVE = 86, 21
#: A line inside an article of which a class or id holds a weak word weighs one part in so many.
WEAK_PART = 4
#: Html handled at once, in UTF-8 bytes.
STEP_BYTES = 8 << 20

# fixed values of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody td template tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCKS - {"br", "button", "body", "head", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "title", "template"}
#: Elements whose text is never main text.
DROPPED = frozenset(
    "script style noscript template head title nav header footer aside form menu button select textarea option iframe object svg canvas "
    "audio video map dialog search datalist noembed noframes xmp".split()
)
#: Roles that mark such elements, by the ARIA standard.
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar toolbar alert alertdialog dialog status note".split())
#: Words that mark such elements as a part of a class or id.
STRONG_NAMES = frozenset(
    "ads advert adverts advertisement advertising sponsor sponsored nav navbar navigation menu menus masthead footer sidebar breadcrumb breadcrumbs cookie cookies "
    "consent comment comments respond reply replies disqus share sharing social newsletter subscribe subscription pagination pager login signup".split()
)
#: Words that mark such elements as a whole class or id; as a part of one they are weak.
WHOLE_NAMES = STRONG_NAMES | frozenset("ad promo promotion banner header aside notice notices related popup modal widget widgets skip form".split())
_OPEN = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
#: The rest of a tag: attributes, of which quoted values may hold anything.
_REST = re.compile(r"((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)>")
_COMMENT_END = re.compile(r"--!?>")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
_NAMES = re.compile(r"[A-Za-z]+")
#: White space of HTML and of Unicode inside a block becomes one space.
_SPACE = re.compile(r"\s+")


#: Of these any part of a block's name says that readers' comments are in it.
COMMENT_NAMES = frozenset("comment comments respond reply replies disqus".split())
#: Elements that hold a line rather than blocks: part of a name says what they are about, not what they are.
LINE_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th caption figcaption blockquote pre summary legend address q em strong b i u s a span small mark code".split())
#: How an element counts: never main text by HTML; called readers' comments; called another side part; a part of its
#: name is such a word; it is named a little like such; otherwise.
NEVER, COMMENTS, NAMED, PARTLY, WEAK, PLAIN = 5, 4, 3, 2, 1, 0


def _kind(tag: str, attributes: str) -> int:
    """How an element counts, by its name and attributes."""
    if tag in DROPPED:
        return NEVER
    if not attributes or tag in ("html", "body"):
        return PLAIN
    kind = PLAIN
    for m in _ATTRIBUTE.finditer(attributes):
        name = m[1].lower()
        value = (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value.strip() == "true":
            return NEVER
        if name == "role" and value.strip() in DROPPED_ROLES:
            kind = max(kind, NAMED)
        if name in ("class", "id"):
            for token in value.split():
                parts = _NAMES.findall(token)
                comments = token in COMMENT_NAMES or tag not in LINE_TAGS and not COMMENT_NAMES.isdisjoint(parts)
                if comments:
                    kind = max(kind, COMMENTS)
                elif token in WHOLE_NAMES:
                    kind = max(kind, NAMED)
                elif not STRONG_NAMES.isdisjoint(parts) and tag not in LINE_TAGS:
                    kind = max(kind, PARTLY)
                elif not WHOLE_NAMES.isdisjoint(parts):
                    kind = max(kind, WEAK)
    return kind


def _tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """The markup of a page in order: start, end, whether it closes an element, the element's name ("": none) and attributes.

    No part of a page is looked at more than a few times.  When the quotes of a
    tag never end, tags from there on end at their first ">".
    """
    at, last, quotes = 0, page.rfind(">"), True
    while (start := page.find("<", at)) >= 0:
        if page.startswith("<!--", start):
            end = _COMMENT_END.search(page, start + 2)
            at = end.end() if end else len(page)
            yield start, at, False, "", ""
        elif start > last:
            return  # no tag ends any more: the rest is text
        elif page.startswith(("<!", "<?"), start):
            at = page.index(">", start) + 1
            yield start, at, False, "", ""
        elif (head := _OPEN.match(page, start)) is None:
            at = start + 1
        else:
            rest = _REST.match(page, head.end()) if quotes else None
            quotes = rest is not None
            end = rest.end() if rest else page.index(">", head.end()) + 1
            tag = head[2].lower()
            at = yield start, end, bool(head[1]), tag, page[head.end() : end - 1]
            at = at or end


class _Elements:
    """The open elements of a page: name, kind, article and named elements of each, with what is above counted in."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, int, int, tuple]] = [("", PLAIN, 0, ())]
        self.often: Counter[str] = Counter()
        self.blocks: list[int] = []  # where block elements stand

    def push(self, tag: str, kind: int, article: int, named: tuple) -> None:
        if tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.often[tag] += 1
        self.stack.append((tag, kind, article, named))

    def cut(self, depth: int) -> None:
        """Close all elements from ``depth`` on."""
        self.often.subtract(x[0] for x in self.stack[depth:])
        del self.stack[depth:]
        while self.blocks and self.blocks[-1] >= depth:
            self.blocks.pop()

    def close(self, tag: str) -> None:
        """Close the innermost element of a name and all inside it; nothing if none is open."""
        if self.often[tag] > 0:
            self.cut(next(i for i in range(len(self.stack) - 1, 0, -1) if self.stack[i][0] == tag))

    def close_block(self, tags: set[str] | frozenset[str], over_p: bool = False) -> None:
        """Close the innermost block element, if it has one of the names; an open paragraph is looked over with ``over_p``."""
        found = [i for i in self.blocks[-2:] if not (over_p and self.stack[i][0] == "p")]
        if found and self.stack[found[-1]][0] in tags:
            self.cut(found[-1])


def lines(page: str) -> tuple[list[tuple[str, int, int, int, tuple]], set[int]]:
    """The page's lines in order: text, number of the article it is in (0: none), NEVER, WEAK or PLAIN, characters in links,
    and the side parts that it is in by name: (number, COMMENTS, NAMED or PARTLY); and the numbers of those around a headline or the main element."""
    out: list[tuple[str, int, int, int, tuple]] = []
    around: set[int] = set()
    sides = 0
    held: list[str] = []
    open_ = _Elements()
    articles, at, linked, links = 0, 0, 0, 0

    def end_line() -> None:
        nonlocal linked
        if held:
            text = _SPACE.sub(" ", html.unescape("".join(held))).strip()
            held.clear()
            if text:
                _, kind, article, named = open_.stack[-1]
                out.append((text, article, kind, min(linked, len(text)), named))
        linked = 0

    def hold(text: str) -> None:
        nonlocal linked
        held.append(text)
        if open_.often["a"] > 0:
            linked += len(text)

    tags = _tags(page)
    found = next(tags, None)
    while found:
        start, end, closes, tag, attributes = found
        if start > at:
            hold(page[at:start])
        at, skip = end, None
        if tag and closes:
            if tag in BLOCKS or tag in DROPPED:
                end_line()
            open_.close(tag)
        elif tag:
            kind = _kind(tag, attributes)
            if tag in BLOCKS or kind > WEAK:
                end_line()
            if tag in CLOSES_P or tag == "p":
                open_.close_block({"p"})  # a block ends an open paragraph and inline elements inside it
            if tag in ("li", "dd", "dt", "td", "th", "tr", "option"):
                open_.close_block({"dd", "dt"} if tag in ("dd", "dt") else {"td", "th"} if tag in ("td", "th") else {tag}, over_p=True)
            if tag not in VOID and (tag in BLOCKS or tag in DROPPED or not attributes.rstrip().endswith("/")):
                _, above, article, named = open_.stack[-1]
                if tag in ("h1", "main"):
                    around.update(n for n, _ in named)
                if WEAK < kind < NEVER:
                    sides += 1
                    named, kind = (*named, (sides, kind)), PLAIN
                if tag == "article" or tag == "main" and not article:
                    articles += 1
                    article = article or articles
                if tag in RAW:
                    close = _raw_end(tag).search(page, at)
                    skip = close.start() if close else len(page)
                    if max(above, kind) <= WEAK:
                        hold(page[at:skip])
                    at = skip
                open_.push(tag, max(above, kind), article, named)
        try:
            found = tags.send(skip)
        except StopIteration:
            break
    if at < len(page):
        hold(page[at:])
    end_line()
    return out, around


@cache
def _raw_end(tag: str) -> re.Pattern[str]:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I)


def weights(found: list[tuple[str, int, int, int, tuple]], around: set[int]) -> list[int | None]:
    """The weight of each of ``lines``; None for those that are no main text.

    A side part by name that is around a headline or the main element is a wrapper and counts
    like others; so is, but for comments, one that holds more than half of what articles
    hold, in characters outside links, or of all on a page without articles.  Inside an article links and weak names make a line lighter, but not empty.
    """
    plain = [0 if kind == NEVER else len(text) - linked for text, _, kind, linked, _ in found]
    marked = any(w and line[1] for w, line in zip(plain, found))
    counted = [w if line[1] or not marked else 0 for w, line in zip(plain, found)]
    held: Counter[int] = Counter()
    for w, line in zip(counted, found):
        for n, kind in line[4]:
            held[n] += w if kind != COMMENTS else 0
    wrappers = around | {n for n, w in held.items() if 2 * w > sum(counted)}
    out: list[int | None] = []
    for (text, article, kind, linked, named), w in zip(found, plain):
        side = max((k for n, k in named if n not in wrappers), default=PLAIN)
        if kind == NEVER or side >= NAMED or side == PARTLY and w < SURGE:
            out.append(None)
        elif article:
            out.append(max(1, (w + linked // WEAK_PART) // (WEAK_PART if kind == WEAK or side else 1)))
        else:
            out.append(w // WEAK_PART if kind == WEAK or side else w)
    total = sum(w or 0 for w in out)
    inside = sum(w or 0 for w, line in zip(out, found) if line[1])
    if inside and 2 * inside >= total:
        out = [w if line[1] else None for w, line in zip(out, found)]
    return out


def stretches(weight: list[int | None], window: int, surge: int, dive: int = 1) -> list[tuple[int, int]]:
    """Stretches of lines (first, end) in which the window sums surge, each ending where they dive: to less than ``dive``, and nothing at least."""
    n = len(weight)
    values = [w or 0 for w in weight]
    total, sums = sum(values[:window]), []
    for i in range(n):
        sums.append(total)
        total += (values[i + window] if i + window < n else 0) - values[i]
    least = min(surge, max(sums, default=0))
    out, first, high = [], None, 0
    for i, s in enumerate([*sums, 0]):
        if s >= min(dive, least) and s:
            first, high = (i, s) if first is None else (first, max(high, s))
        elif first is not None:
            if high >= least:
                out.append((first, i))
            first = None
    return out


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE, dive: int = DIVE) -> str:
    """Main text of a page: the lines of its surging stretches, but for those that are no main text, joined by one space.

    Empty for null, empty or text-free html.  In an article, whose borders the page
    itself draws, sums dive only to nothing.
    """
    if not page:
        return ""
    found, around = lines(page)
    weight = weights(found, around)
    # a run of side lines inside an article counts as one line
    kept = [i for i, w in enumerate(weight) if w is not None or not i or weight[i - 1] is not None or not found[i][1] == found[i - 1][1] > 0]
    light = [weight[i] for i in kept]
    if any(w and found[i][1] for i, w in zip(kept, light)):
        dive = 1
    out = []
    for a, b in stretches(light, window, surge, dive):
        # a sum counts for all the lines under it; those at the ends must weigh something
        own = [i for i in kept[a : max(b, min(b + window - 1, len(kept)) if dive > 1 else b)]]
        while own and not weight[own[-1]]:
            own.pop()
        while own and not weight[own[0]]:
            own.pop(0)
        out += [i for i in own if weight[i] is not None]
    return " ".join(found[i][0] for i in dict.fromkeys(out))


def extract(pages: DataFrame, keys: list[str], column: str = "html") -> DataFrame:
    """Main text of every page: ``keys``, text, n_chars (code points).

    Null or empty html gives an empty text.  A tag that never ends is text.  Rows are independent (repeated rows
    repeat, an empty table gives none), any length of html is handled whole, and
    other columns are ignored.
    """
    rows = pages.select(*keys, F.col(column).alias("_html"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("_html").schema]

    def extracted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in common.pieces(batches, "_html", STEP_BYTES):
            texts = [main_text(h) for h in batch.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keys)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[*keys, "text", "n_chars"],
            )

    return rows.mapInArrow(extracted, ", ".join([*kinds, "text string", "n_chars long"]))


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every ``pages`` row: page_id, url, text, n_chars."""
    return extract(common.table(spark, sf_dir, "pages"), ["page_id", "url"])
