"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block element; elements that are never
article text by their tag leave an empty line, and so do those with less than half of the
page's weight that a class, id or role names outright.  A line's weight is its
text outside links, less where a word of a class, id or role hints at something else.  Summed over sliding windows of ``width`` lines, the weights surge
where the article begins and dive to nothing where it ends; the lines between the
two are the text, with short lines that touch it; a page can have several such
stretches and all of them stay.  Where ``article`` or ``main`` elements hold text, the
lines inside all of them, nested ones included, are the page, and any weight is a surge
there: what dives are runs of ``width`` or more lines of links or skipped elements.

Character references are decoded, white space inside a block becomes one space,
blocks are joined by one newline in page order; nothing inside the found stretch
is dropped.

Defined cases: null and empty html, and pages without text, give the empty string;
a tag left open ends with its page, a skipped one already where an article begins;
repeated rows are read alike; extra columns are carried only on request, without those
named like results.  Very long pages, also of unclosed tags, quotes and elements,
take time in proportion to their length; a page is read whole by one task.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from briskbi.llm.shared import carried, steps

_OPEN = re.compile(r"<(?:!--|[!?]|/?[a-zA-Z])")
_NAME = re.compile(r"[^\s/>]*+")
_CLOSER = re.compile(r"[>\"']")
_ZEROS = re.compile(r"&#0+(?=\d)")
_HUGE = re.compile(r"&#[1-9]\d{7,};?")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)", re.IGNORECASE)

#: Elements whose content is not markup: it ends at their own end tag only.
RAW = frozenset("script style textarea title xmp noscript noembed iframe".split())
#: Elements that never hold article text.
ASIDE = frozenset("head nav header footer aside form menu dialog template svg canvas object select button audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a line.
BLOCK = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
ZONE = frozenset(("article", "main"))
#: Words in a class, id or role that hint at something else than the article: they lower a line's weight.
_HINTS = (
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion "
    "cookie cookies consent gdpr notice notices alert newsletter subscribe subscription popup modal overlay paywall "
    "sidebar rail widget nav navbar navigation menu menus breadcrumb breadcrumbs toolbar masthead footer "
    "share sharing social related recommended recommendations teaser teasers trending "
    "comment comments commentlist respond responses replies reply disqus discussion "
    "pagination pager login signin signup register search "
    "contentinfo complementary"
).split()
_HINT = re.compile(r"(?:^|[\s_-])(?:" + "|".join(_HINTS) + r")(?:$|[\s_-])", re.IGNORECASE)
#: Whole classes, ids and roles that say it outright: a small part of the page so named is left out.
_NAMED = frozenset((
    "ad ads adv advert adverts advertisement advertising adsense sponsored cookie cookies newsletter popup modal "
    "sidebar navbar navigation menu breadcrumb breadcrumbs toolbar share sharing "
    "comment comments commentlist disqus pagination pager contentinfo complementary"
).split())
#: Words that say it too, alone or in a longer name of a block element that is no heading.
_STRONG = frozenset((
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner "
    "cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup popup modal overlay paywall "
    "sidebar breadcrumb breadcrumbs comment comments commentlist disqus pagination pager"
).split())
#: Names that do so as a whole only: longer ones, such as related-work, may be sections of a text.
_WHOLE = _STRONG | {"related"}
#: Beside one of these, a word describes a page that has such parts, not the part.
_AROUND = frozenset("has no not with without is open closed status enabled disabled layout page wrapper container".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A hint divides the weight of a line by this.
LOWER = 4


def _is_aside(tag: str, attributes: str) -> bool:
    if tag in ASIDE:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    if _HIDDEN.search(attributes) and not re.search(r"[\"'][^\"']*\bhidden\b", attributes):
        return True
    return False


def _mark(tag: str, attributes: str) -> int:
    """2: the element's class, id or role names something else than an article; 1: it hints at it; 0: neither."""
    if not attributes or tag in ("html", "body"):
        return 0
    values = [a or b or c for _, a, b, c in _ATTRIBUTE.findall(attributes)]
    names = [name for v in values for name in v.lower().split()]
    if any(name in _NAMED for name in names):
        return 2
    if tag in BLOCK and tag not in _HEADING:
        for name in names:
            words = set(re.split(r"[_-]+", name))
            if name in _WHOLE or words & _STRONG and not words & _AROUND:
                return 2
    return int(any(_HINT.search(v) for v in values))


def _decoded(text: str) -> str:
    """Character references decoded; numbers beyond all code points are the replacement character."""
    if "&#" in text:
        text = _HUGE.sub("\ufffd", _ZEROS.sub("&#", text))
    return entities.unescape(text)


class _Tags:
    """Finds a page's tags one after the other.

    A tag ends at the first ``>`` outside quotes, or at the first of all if none is.  Places
    from which no such ``>`` follows are remembered, so that a page of open quotes or brackets
    takes time in proportion to its length.
    """

    def __init__(self, page: str):
        self.page, self.last, self.endless = page, page.rfind(">"), set()

    def _end(self, at: int) -> int:
        here, been = at, []
        while here not in self.endless:
            been.append(here)
            m = _CLOSER.search(self.page, here)
            if m is None:
                break
            if m[0] == ">":
                return m.start()
            here = self.page.find(m[0], m.end()) + 1
            if not here:
                break
        self.endless.update(been)
        return self.page.find(">", at)

    def find(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """(begin, end, is it an end tag, name, attributes) of the next tag; comments and declarations have no name."""
        while m := _OPEN.search(self.page, at):
            begin, at = m.span()
            if m[0] == "<!--":
                end = self.page.find("-->", at)
                return begin, len(self.page) if end < 0 else end + 3, False, "", ""
            if at > self.last:
                continue
            if m[0] in ("<!", "<?"):
                return begin, self.page.find(">", at) + 1, False, "", ""
            name = _NAME.match(self.page, at - 1)
            end = self._end(name.end())
            return begin, end + 1, m[0][1] == "/", name[0].lower(), self.page[name.end() : end]
        return None


class _Lines:
    """Lines of a page and the marked elements and zones around them.

    ``found`` holds (text, weight, zone, mark) with the innermost zone and mark, 0 for none;
    ``above`` and ``around`` lead to the next one outwards, ``kinds`` tells a mark's kind,
    ``zone_marks`` a zone's own mark or 0.
    """

    def __init__(self) -> None:
        self.found: list[tuple[str, int, int, int]] = []
        self.kinds, self.above = [0], [0]
        self.zone_marks, self.around = [0], [0]


def lines(page: str) -> _Lines:
    """The lines of a page; empty ones stand for skipped elements."""
    out = _Lines()
    tags = _Tags(page)
    marks: list[list] = []  # [tag, depth, place]
    where: dict[str, list[int]] = {}  # places in ``marks`` by tag
    parts: list[str] = []
    linked = link = 0
    zones: list[int] = []
    skipped, depth = "", 0
    at = 0

    def add(text: str, weight: int) -> None:
        out.found.append((text, weight, zones[-1] if zones else 0, marks[-1][2] if marks else 0))

    def drop(first: int) -> None:
        for tag, _, _ in marks[first:]:
            where[tag].pop()
        del marks[first:]

    def end_line() -> None:
        nonlocal parts, linked
        text = " ".join(_decoded("".join(parts)).split())
        if text:
            add(text, max(0, len(text) - linked))
        parts, linked = [], 0

    while True:
        m = tags.find(at)
        text = page[at : m[0] if m else len(page)]
        if text and not skipped:
            parts.append(text)
            if link:
                linked += len(" ".join(_decoded(text).split()))
        if not m:
            break
        _, at, close, tag, attributes = m
        if not tag:
            continue
        if not close and tag in RAW and not attributes.endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\b", re.IGNORECASE).search(page, at)
            at = end.start() if end else len(page)
            continue
        if skipped:
            if not close and tag in ZONE and skipped not in ZONE and not _is_aside(tag, attributes):
                skipped, depth = "", 0  # it was never closed
            elif skipped in ("p", "li") and tag != skipped and tag in BLOCK:
                skipped, depth = "", 0
            else:
                if tag == skipped:
                    depth += -1 if close else 1
                    if tag in ("p", "li") and not close:
                        depth = 1
                    if depth <= 0:
                        skipped = ""
                if skipped or close:
                    continue
        if tag == "br" or tag == "wbr":
            parts.append(" " if tag == "br" else "")
            continue
        if not close and tag not in VOID and not attributes.rstrip().endswith("/") and _is_aside(tag, attributes):
            end_line()
            add("", 0)
            skipped, depth = tag, 1
            continue
        if marks:
            around = where[tag][-1] if where.get(tag) else None
            if marks[-1][0] in ("p", "li") and tag in BLOCK and not close:
                end_line()
                drop(len(marks) - 1)
            elif around is not None and not attributes.rstrip().endswith("/"):
                marks[around][1] += -1 if close else 1
                if not marks[around][1]:
                    end_line()
                    drop(around)
        mark = 0 if close or tag in VOID or attributes.rstrip().endswith("/") else _mark(tag, attributes)
        if tag in ZONE and not close and not mark and not any(where.get(z) for z in ZONE):
            end_line()
            drop(0)  # a marked element was never closed, or wraps the article
        if mark == 2 or mark and tag in BLOCK:
            end_line()
            out.kinds.append(mark)
            out.above.append(marks[-1][2] if marks else 0)
            where.setdefault(tag, []).append(len(marks))
            marks.append([tag, 1, len(out.kinds) - 1])
        if tag == "a":
            link = 0 if close else 1
        if tag in BLOCK:
            end_line()
            link = 0
            if tag in ZONE:
                if not close:
                    out.zone_marks.append(len(out.kinds) - 1 if mark else 0)
                    out.around.append(zones[-1] if zones else 0)
                    zones.append(len(out.zone_marks) - 1)
                elif zones:
                    zones.pop()
    end_line()
    return out


def _weighed(page: str) -> list[tuple[str, int, bool]]:
    """(text, weight, in a zone) of each line that marks leave, with lowered weights.

    A mark counts on an element with less than half of the page's weight, and only as long as
    all lines it would take, or lower, have less than half together.
    """
    page_lines = lines(page)
    found, kinds, above = page_lines.found, page_lines.kinds, page_lines.above
    total = sum(x[1] for x in found)
    held = [0] * len(kinds)
    for _, w, _, mark in found:
        held[mark] += w
    for k in range(len(kinds) - 1, 0, -1):  # outer marks come first
        held[above[k]] += held[k]
    small = [k if 2 * h < total else 0 for k, h in zip(kinds, held, strict=True)]
    worst = [0] * len(kinds)
    for k in range(1, len(kinds)):
        worst[k] = max(small[k], worst[above[k]])
    within = [False] * len(page_lines.around)
    for z in range(1, len(within)):
        within[z] = not small[page_lines.zone_marks[z]] or within[page_lines.around[z]]
    level = [worst[mark] for _, _, _, mark in found]
    if 2 * sum(x[1] for x, k in zip(found, level, strict=True) if k == 2) >= total:
        level = [min(k, 1) for k in level]
    if 2 * sum(x[1] for x, k in zip(found, level, strict=True) if k == 1) >= total:
        level = [k if k == 2 else 0 for k in level]
    out: list[tuple[str, int, bool]] = []
    for i, ((text, w, zone, _), k) in enumerate(zip(found, level, strict=True)):
        inside = within[zone]
        if k < 2:
            out.append((text, -(-w // LOWER) if k else w, inside))
        elif not i or level[i - 1] < 2:
            out.append(("", 0, inside))
    return out


def _stretches(weights: list[int], width: int, surge: int) -> list[tuple[int, int]]:
    """[begin, end) from each surge of the windowed sums to the dive after it."""
    sums = [sum(weights[i : i + width]) for i in range(len(weights))]
    out, i = [], 0
    while i < len(sums):
        if sums[i] <= surge:
            i += 1
            continue
        begin = i
        while i < len(sums) and sums[i] > 0:
            i += 1
        out.append((begin, i))
    return out


def main_text(page: str | None, width: int = 3, surge: int = 86) -> str:
    found = _weighed(page or "")
    if not any(t for t, _, _ in found):
        return ""
    marked = any(z and t for t, _, z in found)
    if marked:
        found = [x for x in found if x[2]]
    weights = [w for _, w, _ in found]
    stretches = _stretches(weights, width, 0 if marked else surge)
    if not stretches:  # a text too short to surge
        return "\n".join(t for t, _, _ in found if t)
    keep = [False] * len(found)
    for a, b in stretches:
        while weights[a] == 0:  # the first window also reached over lines without weight
            a += 1
        while a > 0 and weights[a - 1] > 0:
            a -= 1
        if marked:  # a few lines without weight do not part a stretch; neither do they at the ends of what the page marks
            a = 0 if a < width else a
            b = len(found) if len(found) - b < width else b
        keep[a:b] = [True] * (b - a)
    return "\n".join(t for (t, _, _), k in zip(found, keep, strict=True) if k and t)


def extract(pages: DataFrame, id_col: str = "page_id", html: str = "html", carry: tuple[str, ...] = ("url",), width: int = 3, surge: int = 86) -> DataFrame:
    """One row per page row: id, carried columns, text, n_chars (code points)."""
    kept, own_columns = carried(pages, id_col, carry, ("text", "n_chars"))
    rows = pages.select(*own_columns, F.col(html).cast("string").alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "_html"):
            texts = [main_text(p, width, surge) for p in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, *kept, "text", "n_chars"])

    kinds = ", ".join(f"`{c}` {f.dataType.simpleString()}" for c, f in zip([id_col, *kept], rows.schema, strict=False))
    return rows.mapInArrow(run, f"{kinds}, text string, n_chars long")
