"""Main text of web pages by two passes of block rules.

A page is cut into blocks at block-level tags. First pass: blocks inside containers that are
never article text (by tag, role or class) are out; of the others, link density, length and stop
word density decide good or bad, and the rest stay undecided: short blocks, or middling ones. On a
page whose long blocks hold few of the listed stop words, so in another language, length and link
density decide alone. An article or main element inside a wrapper with a name of a page's layout is
not out; inside one that names comments, ads and the like an article is, a main is not.
Second pass: an undecided block takes the label of its nearest decided neighbours; where both
sides differ, the nearer one counts, and a heading leans to what follows. Inside a container that
marks the article only neighbours that are not out count, and the container decides between sides
that differ; a run of undecided blocks as long as a long block stays, as verse or talk does. Blocks
with no decided neighbours but such that are out are good if the page has nothing else or the run is long.

Stop words are learned from nothing: the list is fixed, a few of the commonest words of
English, German, French and Spanish.

Null and empty pages, and pages without text, give an empty text. Broken markup is read as far as
it goes: unclosed tags end with their parent. Repeated rows are handled one by one; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Common words of four languages.
STOP_WORDS = frozenset(
    "the a an and or of to in on at by for with from is are was were be been it this that these those as not "
    "der die das und oder von zu im mit für auf ist sind war nicht ein eine einen dem den des sich auch "
    "le la les un une et ou de du des en dans pour par sur est sont que qui ne pas avec au aux "
    "el los las y o del que con por para una es son se no su al lo como".split()
)
# Elements by role in a page.
SKIPPED = frozenset("script style noscript template svg math iframe object canvas head title select option textarea button".split())
OUTSIDE = frozenset("nav header footer aside form menu dialog".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul br".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE_NAMES = re.compile(
    r"(?:^|[-_\s])(?:ad|ads|advert\w*|adbox|sponsor\w*|promo\w*|banner|cookie\w*|consent|notice|alert|popup|modal|newsletter|subscribe|"
    r"sidebar|side-?bar|menu|nav|navbar|navigation|breadcrumb\w*|footer|header|masthead|comment|comments|disqus|reply|replies|respond|"
    r"related|recommend\w*|share|sharing|social|widget|login|signup|search|pagination|pager|toolbar|copyright|legal)(?:$|[-_\s\d])",
    re.I,
)
# Names that say what a page has or lacks, not what the element is.
LAYOUT_NAMES = re.compile(r"(?:^|[-_\s])(?:has|have|no|with|without)[-_]+[a-z]+", re.I)
# Names of containers that hold article elements which are not the page's own.
OTHERS_NAMES = re.compile(
    r"(?:^|[-_\s])(?:ad|ads|advert\w*|adbox|sponsor\w*|promo\w*|comment|comments|disqus|reply|replies|respond|related|recommend\w*|share|sharing|social|widget|newsletter)(?:$|[-_\s\d])",
    re.I,
)
ARTICLE_NAMES = re.compile(r"(?:^|[-_\s])(?:article|post|entry|content|main|story|body-?text)(?:$|[-_\s])", re.I)

LINK_DENSITY = 0.33
STOP_LOW, STOP_HIGH = 0.10, 0.25
SHORT_WORDS, LONG_WORDS = 12, 30

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_MARK = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    """A run of text between block-level tags."""

    text: str
    linked: int
    heading: bool
    outside: bool
    article: bool


class Tags:
    """Where tags end: at the first > that is not inside quotes. Each > and quote is looked at once, from the end of the page."""

    def __init__(self, page: str):
        self.page = page
        self._marks = [m.start() for m in _MARK.finditer(page)]
        self._closes = [i for i in self._marks if page[i] == ">"]
        self._ends = [-1] * (len(self._marks) + 1)
        later = {"\"": -1, "'": -1}
        for k in range(len(self._marks) - 1, -1, -1):
            c = page[self._marks[k]]
            if c == ">":
                self._ends[k] = self._marks[k]
            else:
                self._ends[k] = self._ends[later[c] + 1] if later[c] >= 0 else -1
                later[c] = k

    def at(self, start: int) -> tuple[bool, str, str, int] | None:
        """Whether the tag at a < is an end tag, its name, the rest, and where it ends; None if it is no tag.

        A quote belongs to the name if the tag ends so, else it begins the rest.
        """
        m = _TAG.match(self.page, start)
        if not m:
            return None
        cut = m.end()
        k = bisect_left(self._marks, cut)
        while self._ends[k] < 0:
            k -= 1
            if k < 0 or self._marks[k] <= m.start(2):
                return None
            cut = self._marks[k]
        return bool(m.group(1)), self.page[m.start(2) : cut], self.page[cut : self._ends[k]], self._ends[k] + 1

    def declaration(self, start: int) -> int:
        """Where a comment, or what begins with <! or <?, ends; -1 if it does not, unless a comment does at the end of the page."""
        if self.page.startswith("<!--", start):
            end = self.page.find("-->", start + 4)
            return end + 3 if end >= 0 else len(self.page)
        k = bisect_left(self._closes, start)
        return self._closes[k] + 1 if self.page.startswith(("<!", "<?"), start) and k < len(self._closes) else -1


def blocks_of(page: str) -> list[Block]:
    """Blocks of a page in order, character references decoded and white space as one space."""
    out: list[Block] = []
    open_: list[tuple[str, bool, bool, bool]] = []
    parts: list[str] = []
    linked = links = 0

    def close() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
        if text:
            top = open_[-1] if open_ else ("", False, False, False)
            out.append(Block(text, linked, any(t[0] in _HEADINGS for t in open_[-3:]), top[1], top[2]))
        parts.clear()
        linked = 0

    tags, unclosed = Tags(page), set()
    count: Counter[str] = Counter()

    def leave(first: int) -> None:
        count.subtract(t[0] for t in open_[first:])
        del open_[first:]

    at = 0
    while at < len(page):
        if page[at] == "<":
            skip = tags.declaration(at)
            if skip >= 0:
                at = skip
                continue
            tag = tags.at(at)
        else:
            tag = None
        if tag is None:
            more = page.find("<", at + 1)
            said = page[at] if page[at] == "<" else page[at : more if more >= 0 else len(page)]
            at += len(said)
            parts.append(said)
            if links:
                linked += len(said)
            continue
        end, name, rest, at = tag
        name = name.lower()
        if name in _HEADINGS or name in BLOCKS:
            close()
        if name == "a" and not end:
            links = 1
        elif name == "a":
            links = 0
        if end:
            if count[name]:
                leave(next(i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == name))
            continue
        if name in SKIPPED:
            if name in ("head", "select"):
                continue
            if not rest.rstrip().endswith("/"):
                found = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at) if name not in unclosed else None
                if not found:
                    unclosed.add(name)
                at = found.end() if found else (len(page) if name in ("script", "style") else at)
            continue
        if name in VOID or rest.rstrip().endswith("/"):
            continue
        if name in ("p", "li", "td", "tr", "dt", "dd", "option"):
            # These end an open one of their kind, unless a list or table stands between.
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == name:
                    leave(i)
                    break
                if open_[i][0] in BLOCKS:
                    break
        if name not in BLOCKS and name not in _HEADINGS:
            continue
        # others: out for good below, by tag or by a name in OTHERS_NAMES, but for a main element.
        _, outside, article, others = open_[-1] if open_ else ("", False, False, False)
        said = " ".join(next(g for g in a.groups()[1:] if g is not None) for a in _ATTRIBUTE.finditer(rest)) if "=" in rest else ""
        inner = name in ("article", "main") or bool(said and ARTICLE_NAMES.search(said))
        named = LAYOUT_NAMES.sub(" ", said) if name not in ("html", "body", "article", "main") else ""
        out_here = name in OUTSIDE or bool(named and OUTSIDE_NAMES.search(named))
        if name == "main":
            outside = others = False
        elif name == "article" and not others:
            outside = False
        others = others or name in OUTSIDE or bool(named and OTHERS_NAMES.search(named))
        open_.append((name, outside or out_here, article or inner, others))
        count[name] += 1
    close()
    return out


_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_WORD = re.compile(r"\w+")


def _lists_fit(blocks: list[Block]) -> bool:
    """Whether the page's longer unlinked blocks hold as many stop words as one in a listed language would."""
    said = [_WORD.findall(b.text.lower()) for b in blocks if not b.outside and b.linked <= LINK_DENSITY * len(b.text)]
    words = [w for x in said if len(x) >= SHORT_WORDS for w in x]
    return sum(w in STOP_WORDS for w in words) >= STOP_LOW * len(words)


def _first_pass(b: Block, fit: bool = True) -> bool | None:
    if b.outside:
        return False
    size = max(1, len(b.text))
    if b.linked / size > LINK_DENSITY:
        return False
    words = _WORD.findall(b.text.lower())
    if len(words) < SHORT_WORDS:
        return None
    stops = sum(w in STOP_WORDS for w in words) / len(words)
    if stops >= STOP_HIGH or len(words) >= LONG_WORDS and stops >= STOP_LOW:
        return True
    if len(words) >= LONG_WORDS:
        return None if fit else True
    return None if b.article or stops >= STOP_LOW or not fit else False


def labels_of(blocks: list[Block]) -> list[bool]:
    """Good or not, after both passes."""
    fit = _lists_fit(blocks)
    first = [_first_pass(b, fit) for b in blocks]
    n = len(blocks)
    before: list[int | None] = [None] * n
    after: list[int | None] = [None] * n
    last = None
    for i in range(n):
        before[i] = last
        last = i if first[i] is not None else last
    last = None
    for i in range(n - 1, -1, -1):
        after[i] = last
        last = i if first[i] is not None else last
    words = [len(_WORD.findall(b.text)) for b in blocks]
    # Words of the run of undecided blocks around each, and the nearest decided labels that are not out, on either side.
    run, inner = [0] * n, [(None, None)] * n
    a, left = 0, None
    while a < n:
        z = a
        while z < n and (first[z] is None or blocks[z].outside):
            z += 1
        right = first[z] if z < n else None
        whole = sum(words[i] for i in range(a, z) if first[i] is None)
        for i in range(a, z):
            run[i], inner[i] = whole, (left, right)
        left, a = right, z + 1
    has_good = True in first
    out = []
    for i, b in enumerate(blocks):
        if first[i] is not None:
            out.append(first[i])
            continue
        left = first[before[i]] if before[i] is not None else None
        right = first[after[i]] if after[i] is not None else None
        if b.article:
            sides = inner[i]
            bad = sides == (False, False) or False in sides and None in sides and has_good
            out.append(not bad or run[i] >= LONG_WORDS)
        elif not has_good and inner[i] != (False, False):
            # Nothing on the page is known to be text, and links on one side at most speak against this.
            out.append(True)
        elif False not in inner[i] and (run[i] >= LONG_WORDS or words[i] >= SHORT_WORDS and True in inner[i]):
            # Only text, or what is out, stands beside it, and it is more than a short line.
            out.append(True)
        elif left is None or right is None:
            out.append(bool(left if right is None else right))
        elif left == right:
            out.append(left)
        elif b.heading:
            out.append(right)
        else:
            out.append(left if i - before[i] < after[i] - i else right if i - before[i] > after[i] - i else False)
    return out


def main_text(page: str | None) -> str:
    """Good blocks of a page joined by newlines."""
    found = blocks_of(page or "")
    return "\n".join(b.text for b, good in zip(found, labels_of(found), strict=True) if good)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every row of pages (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(map(main_text, b.column(2).to_pylist()), pa.string())], names=["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, f"page_id {kind}, url string, text string")
