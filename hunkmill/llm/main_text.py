"""Main text of web pages by a maximum-scoring subsequence.

A page is read as one sequence of blocks of words and tags. Words of running text score positive and tags negative; one
linear scan finds the contiguous stretch with the greatest sum. The scores are log-odds learned from labelled pages:
those that mark their article (one `article` or `main` element) show which words and tags lie within. Words are told
apart by their block's element, its length, links, and by their place inside or outside a marked article, tags by their names.
Blocks of the chosen stretch are returned in page order, but for elements that hold menus, headers, footers, sidebars,
notices, adverts, forms or reader comments by their element, role, class or id.

Learning takes at most `sample` labelled pages and `sample_bytes` of html, in the order of a hash of the page. Every page
is read whole. Inside a block white space becomes one space; `<br>` is white space; table cells, list items and captions are
blocks. Character references are decoded once.

Defined cases: null or empty html, and pages without words outside such elements, give an empty text; an unclosed
comment, tag, script or style runs to the end of the page; other unclosed elements end where their parent does; a null page_id or url is
returned as it is; repeated rows each give a row; an empty table gives an empty result; of stretches with equal sums the
first counts; other columns, whatever their names, play no part.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, pieces

_TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<(/?)([A-Za-z][^\s/>]*+)(?:((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|([^>]*+)(?:>|\Z))|<[!?/][^>]*+(?:>|\Z)""", re.DOTALL
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Elements whose content is no markup.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head"
    " header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An element of these ends the open ones of its own kind, up to the element that holds them.
SIBLINGS = {**dict.fromkeys(("li",), ("li",)), **dict.fromkeys(("dt", "dd"), ("dt", "dd")), **dict.fromkeys(("td", "th"), ("td", "th")), "tr": ("tr", "td", "th"), "option": ("option",)}
HOLDERS = frozenset("ul ol menu dl table select".split())

#: What an article does not hold: by element, by role, by a part of a class or id.
FURNITURE = frozenset("head nav aside footer form noscript template select button dialog menu svg math canvas audio video object map search".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
FURNITURE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner billboard sponsor sponsored sponsors promo promoted promotion sidebar widget widgets"
    " nav navbar navigation menu menus breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices alert alerts popup modal overlay"
    " comment comments commentlist disqus replies respond share sharing social related recommended recommendations newsletter subscribe subscription"
    " signup login search pagination pager toolbar copyright disclaimer".split()
)
#: A name with one of these parts is of the page's layout, not of what it names: `has-sidebar`, `comments-open`.
LAYOUT_NAMES = frozenset("has no with without open closed wrapper container layout page".split())

#: Words by the number of words in their block.
LENGTHS = (2, 5, 10, 20)
#: Log-odds before any page is seen: words by length, words of headings, linked words, tags, tags of running text.
PRIOR_WORDS, PRIOR_HEADING, PRIOR_LINKED, PRIOR_TAG, PRIOR_TEXT_TAG = (0.2, 0.4, 0.8, 1.2, 1.6), 1.0, -1.5, -0.5, -0.1
TEXT_TAGS = HEADINGS | {"p", "blockquote", "pre", "br", "inline"}
#: Counts that the log-odds before are worth, and the limit of a weight.
PRIOR_COUNT, MOST = 5.0, 4.0
#: What a marked article adds to the score of its words and takes from that of all others: more than any weight.
PLACE = 6.0
#: A tag scores between these.
TAG_MOST, TAG_COST = -1.0, -0.05


class Item(NamedTuple):
    """A tag, or a block of words."""

    kind: str
    furniture: bool
    text: str = ""
    plain: int = 0
    linked: int = 0


def _tag_kind(name: str) -> str:
    return "<" + name if name.strip("/") in BLOCKS or name in ("a", "/a", "br") else "<inline"


def _attributes(text: str) -> dict[str, str]:
    return {name.lower(): value.strip("\"'") for name, value in _ATTRIBUTE.findall(text)}


def _furniture(name: str, attributes: dict[str, str], marked: bool) -> bool:
    """Is the element one of those that an article does not hold? marked: it lies in a marked article."""
    if name in FURNITURE or attributes.get("role", "").lower() in FURNITURE_ROLES or name == "header" and not marked:
        return True
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True
    if name in ("html", "body", "main"):
        return False
    for whole in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        parts = {p.lower() for p in _NAME_PARTS.findall(whole)}
        known = parts & FURNITURE_NAMES or parts & {"header"} and not marked
        if known and (name != "article" or len(parts) == 1) and not parts & LAYOUT_NAMES:
            return True
    return False


def _marks(name: str, attributes: dict[str, str]) -> str | None:
    if name == "article" or attributes.get("itemprop") == "articleBody":
        return "article"
    return "main" if name == "main" or attributes.get("role") == "main" else None


_KINDS = {name: _tag_kind(name) for block in sorted(BLOCKS | {"a", "b", "br", "em", "i", "img", "span", "strong"}) for name in (block, "/" + block)}


class _Reader:
    """Reads one page into items, and the stretches of items that the page marks as article or main."""

    def __init__(self, html: str):
        self.items: list[Item] = []
        self.marks: list[tuple[str, int, int]] = []
        self.open: list[tuple[str, bool, str | None, int]] = []
        self.parts: list[str] = []
        self.linked = self.links = self.hidden = self.marked = 0
        at = 0
        for token in _TOKEN.finditer(html):
            if token.start() < at:
                continue
            self.words(html[at:token.start()])
            at = token.end()
            name = (token[2] or "").lower()
            if token[1]:
                self.end(name)
            elif name:
                self.start(name, token[3] or token[4] or "")
                if name in RAW:
                    found = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.IGNORECASE).search(html, at)
                    at = found.end() if found else len(html)
        self.words(html[at:])
        self.flush()
        self.pop(0)

    def words(self, text: str) -> None:
        if text:
            text = entities.unescape(text)
            self.parts.append(text)
            if self.links:
                self.linked += len(text.split())

    def flush(self) -> None:
        if not self.parts:
            return
        found = "".join(self.parts).split()
        if found:
            block = next((name for name, *_ in reversed(self.open) if name in BLOCKS), "body")
            linked = min(self.linked, len(found))
            self.items.append(Item(block, self.hidden > 0, " ".join(found), len(found) - linked, linked))
        self.parts, self.linked = [], 0

    def tag(self, name: str) -> None:
        self.items.append(Item(_KINDS.get(name) or _tag_kind(name), self.hidden > 0))

    def pop(self, to: int) -> None:
        """Ends the open elements from number `to` on."""
        ended = self.open[to:]
        if self.parts and any(one[0] in BLOCKS for one in ended):
            self.flush()
        for name, hidden, mark, began in reversed(ended):
            self.links -= name == "a"
            self.hidden -= hidden
            if mark:
                self.marked -= 1
                self.marks.append((mark, began, len(self.items)))
        del self.open[to:]

    def start(self, name: str, text: str) -> None:
        if name in BLOCKS:
            self.flush()
            for i in range(len(self.open) - 1, -1, -1):  # a block ends an open paragraph
                if self.open[i][0] in BLOCKS:
                    if self.open[i][0] == "p":
                        self.pop(i)
                    break
            if name in SIBLINGS:
                for i in range(len(self.open) - 1, -1, -1):
                    if self.open[i][0] in HOLDERS:
                        break
                    if self.open[i][0] in SIBLINGS[name]:
                        self.pop(i)
        elif name == "br":
            self.parts.append(" ")
        if name in VOID or name in RAW:
            self.tag(name)
            return
        if text:
            attributes = _attributes(text)
            hidden = _furniture(name, attributes, self.marked > 0)
            mark = None if hidden else _marks(name, attributes)
        else:
            hidden, mark = name in FURNITURE or name == "header" and not self.marked, name if name in ("article", "main") else None
        if mark and self.hidden:  # an article inside a form or an unclosed menu
            self.pop(next(i for i, one in enumerate(self.open) if one[1]))
        self.open.append((name, hidden, mark, len(self.items)))
        self.links += name == "a"
        self.hidden += hidden
        self.marked += mark is not None
        self.tag(name)

    def end(self, name: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == name:
                self.pop(i)
                self.tag("/" + name)
                return
            if name not in BLOCKS and self.open[i][0] in BLOCKS:
                return


def _marked(reader: _Reader) -> tuple[int, int] | None:
    """The stretch of items that the page marks: its article, the one with most words of several if it holds half of
    theirs, else its main element; None if it marks nothing or several alike."""
    words = lambda m: sum(i.plain + i.linked for i in reader.items[m[1]:m[2]] if not i.furniture)
    articles = [m for m in reader.marks if m[0] == "article"]
    articles = [m for m in articles if not any(o[1] <= m[1] and m[2] <= o[2] and o is not m for o in articles)]
    if len(articles) > 1:
        sizes = [words(m) for m in articles]
        if 2 * max(sizes) >= sum(sizes):
            articles = [articles[sizes.index(max(sizes))]]
    for found in (articles, [m for m in reader.marks if m[0] == "main"]):
        if len(found) == 1:
            return found[0][1], found[0][2]
    return None


def _length(n: int) -> int:
    return sum(n > most for most in LENGTHS)


def _features(item: Item) -> list[tuple[str, int]]:
    """What an item is scored by, with the number of words, or 1 for a tag."""
    kind, _, _, plain, linked = item
    if kind[0] == "<":
        return [(kind, 1)]
    size = _length(plain + linked)
    return [(f"{how} {kind} {size}", n) for how, n in (("plain", plain), ("linked", linked)) if n]


def count_features(html: str) -> Counter | None:
    """(feature, within): number, for a page that marks its article."""
    reader = _Reader(html)
    marked = _marked(reader)
    if marked is None:
        return None
    found = Counter()
    for i, item in enumerate(reader.items):
        within = marked[0] <= i < marked[1]
        if item.furniture and within:
            continue
        for feature, n in _features(item):
            found[feature, within] += n
    return found


def _prior(feature: str) -> float:
    if feature[0] == "<":
        return PRIOR_TEXT_TAG if feature.strip("</") in TEXT_TAGS else PRIOR_TAG
    how, kind, size = feature.split(" ")
    return PRIOR_LINKED if how == "linked" else PRIOR_HEADING if kind in HEADINGS else PRIOR_WORDS[int(size)]


def weights_of(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log-odds of each feature."""
    out = {}
    for feature in {f for f, _ in counts}:
        before = 1 / (1 + math.exp(-_prior(feature)))
        odds = (counts.get((feature, True), 0) + PRIOR_COUNT * before) / (counts.get((feature, False), 0) + PRIOR_COUNT * (1 - before))
        out[feature] = max(-MOST, min(MOST, math.log(odds)))
    return out


def scores_of(items: list[Item], marked: tuple[int, int] | None, weights: dict[str, float]) -> list[float]:
    out = []
    start, end = marked or (0, 0)
    place = PLACE if marked else 0.0
    for i, item in enumerate(items):
        within = start <= i < end
        if item[0][0] == "<":
            out.append(TAG_COST if within else max(TAG_MOST, min(weights.get(item[0]) or _prior(item[0]), TAG_COST)))
        elif item.furniture:
            out.append(0.0 if within else -MOST * (item.plain + item.linked))
        else:
            known = [(n, weights.get(feature, _prior(feature))) for feature, n in _features(item)]
            out.append(sum(n * (weight + (place if within else -place)) for n, weight in known))
    return out


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """Ends of the stretch with the greatest sum, the first of equal ones; empty if no score is positive."""
    best, ends, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, ends = total, (start, i + 1)
    return ends


def main_text(html: str | None, weights: dict[str, float]) -> str:
    reader = _Reader(html or "")
    start, end = best_stretch(scores_of(reader.items, _marked(reader), weights))
    return "\n".join(item.text for item in reader.items[start:end] if item.text and not item.furniture)


@lean
def _count(batches):
    total = Counter()
    for batch in batches:
        for html in batch.column(0):
            total.update(count_features(html.as_py() or "") or {})
    keys = sorted(total)
    yield pa.record_batch({"feature": pa.array([f for f, _ in keys], pa.string()), "within": pa.array([w for _, w in keys], pa.bool_()), "n": pa.array([total[k] for k in keys], pa.int64())})


def learn(pages: DataFrame, sample: int = 2000, sample_bytes: int = 32 << 20) -> dict[str, float]:
    """Weights from the pages that mark their article."""
    marks = F.lower("html").rlike(r"<(article|main)[\s>]")
    mixed = pages.filter(marks).select(F.xxhash64("page_id", "url", F.octet_length("html")).alias("h"), F.octet_length("html").alias("size"))
    chosen, size, last = mixed.orderBy("h", "size").limit(sample).collect(), 0, None
    for row in chosen:
        size += row["size"]
        if size > sample_bytes:
            break
        last = row["h"]
    if last is None:
        return weights_of({})
    some = pages.filter(marks & (F.xxhash64("page_id", "url", F.octet_length("html")) <= last)).select("html")
    counts = some.mapInArrow(_count, "feature string, within boolean, n long").groupBy("feature", "within").agg(F.sum("n").alias("n")).collect()
    return weights_of({(r["feature"], r["within"]): r["n"] for r in counts})


def _extractor(weights: dict[str, float]):
    @lean
    def run(batches):
        for batch in batches:
            for part in pieces(batch, "html"):
                texts = [main_text(html.as_py(), weights) for html in part.column(2)]
                yield pa.record_batch({
                    "page_id": part.column(0), "url": part.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                })

    return run


def extract(pages: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""
    pages = pages.select("page_id", "url", "html")
    weights = learn(pages) if weights is None else weights
    kinds = dict(pages.dtypes)
    return pages.mapInArrow(_extractor(weights), f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
