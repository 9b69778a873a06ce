"""Main text of a web page, by a maximum-scoring subsequence.

A page is a row of items: blocks of words, and the tags between them. A block
scores what each of its words is worth in its place, positive or negative; a
tag costs what it is evidence against content. One linear scan finds the
contiguous run of items with the greatest sum: the region that holds the main
text. Blocks inside it that are most likely no content (an advert amid an
article) are left out.

All weights come from labelled pages. What a word is worth is the log odds, by
a logistic regression over the blocks of those pages, that a block like its own
is content: by the element it stands in, how long it is, how much of it is
links, whether it has sentences, the headings over it, and the names of the
elements around it. An element around nine tenths of a page's words is no
evidence, as it does not tell the page's parts from one another. What a tag
costs is the log odds that it stands outside content; the scale of costs against
words is the one that gets the labelled pages' text best.
"""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fields, table, tidy
from .compression import fit_logistic

TEXTS = fields(("page_id", T.LongType()), ("url", T.StringType()), ("text", T.StringType()), ("n_chars", T.LongType()))

#: Elements with no text of their own; elements that never close; elements that stay inside a block.
RAW = ("script", "style", "noscript", "template", "textarea", "svg", "iframe", "title", "object", "select")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements whose start tag ends an open paragraph.
ENDS_PARAGRAPH = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that mark content where a page labels itself, are around every block, or are a block's own, so that being in them is no feature.
SILENT = INLINE | HEADINGS | frozenset("html body article main div p li ul ol dl dt dd table tbody tr td th blockquote pre figure figcaption center".split())

#: An element around as many of a page's words is no evidence.
AROUND = 0.9
#: Log odds of a block under which it is left out of the region; those at which a word is worth one point or minus one.
LEFT_OUT, SURE = -1.0, 2.0
#: What any tag costs.
LEAST_COST = 0.05
#: Words of a short block and of a heading that may be features; features in so many blocks at least are learned, the most frequent so many of them. A word is one where blocks outside content show it so many times as often.
SAID, SEEN, LEARNED, TELLS = 5, 2, 400, 3
#: Blocks and pages that the labelled pages of either kind are worth together, the pages at least; scales of the costs of tags that are tried, of which the largest counts that is worse than the best by no more than SAME.
SAME, SHORT = 0.002, 5
WORTH, LEAST_PAGES, SCALES = 300.0, 300, (0.005, 0.01, 0.02, 0.04, 0.08, 0.16, 0.32)
#: A comment or CDATA section, the start of a tag, a declaration, or text.
_PART = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)|<[!?][^>]*(?:>|\Z)|([^<]+|<)", re.DOTALL)
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_ATTRIBUTES = re.compile(r"(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+")
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in RAW}
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_SPLIT = re.compile(r"[^a-z]+")
_SPACE = re.compile(r"\s+")
_SENTENCE = re.compile(r"[.!?\u3002\uff01\uff1f][\"')\]]*(?:\s|$)")
BEGIN, END = "\x02", "\x03"

#: Labelled pages: content stands between the two marks; a page may have several such runs, and what is between two of them is no content. They show what the corpus may lack.
LABELLED = (
    '<html><head><title>t</title></head><body><header class="site-header"><a href="/">Site</a><p>A paper for all</p></header><nav class="menu"><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="cookie-notice banner">We use cookies on this site.<button>OK</button></div><main>\x02<h1>Rain returns</h1><p>The rain came back on Monday after ten dry weeks and filled the old river.</p><p>Farmers were glad of it.</p>\x03</main><aside class="sidebar"><h3>Most read</h3><ul><li><a href="/c">Ten ways</a></li></ul></aside><section id="comments" class="comments"><h2>Comments</h2><div class="comment"><p>First! I like rain very much indeed.</p></div></section><footer class="site-footer"><p>All rights reserved.</p></footer></body></html>',
    '<body><div id="header" class="top"><span>Shop</span><form class="search"><input name="q"><label>Search the shop</label><button>Go</button></form></div><div class="breadcrumb nav"><a href="/">Home</a></div><div class="content post entry article">\x02<h2>A chair</h2><p>It is made of oak and will last, <em>we think</em>, for a hundred years.</p><blockquote><p>The best seat in the house.</p></blockquote><ul><li>oak</li><li>steel</li></ul><table><tr><th>High</th><td>90 cm</td></tr></table>\x03</div><div class="ad advert sponsored promo">Buy two chairs and pay for one today.</div><div class="related share social newsletter subscribe"><p>Follow us and sign up for the weekly letter.</p></div><div id="footer">Contact. Terms.</div></body>',
    '<body><nav><a href="/1">One</a><a href="/2">Two</a></nav><div class="alert notice">The site will be down on Sunday night for repairs.</div><article>\x02<h1>On bread</h1><p>Flour, water, salt and time make bread.</p><h3>How</h3><h4>By hand</h4><p>Knead it <small>slowly</small>.</p><pre>flour 500 g</pre><figure><figcaption>A loaf.</figcaption></figure><p>Let it rest.</p>\x03</article><div class="reviews disqus_thread replies"><p>My loaf burned, what did I do wrong here?</p></div><form><p>Leave a reply</p><textarea></textarea></form><aside><p>About the author: a baker.</p></aside><footer><small>Copyright</small></footer></body>',
    '<body><div class="page"><div><ul><li><a href="/w">World</a></li><li><a href="/p">Politics</a></li><li><a href="/s">Sport</a></li></ul></div><article><header>\x02<h1 class="entry-header">A bridge for the town</h1><p>By a reporter</p></header><p>After nine years of talk the town has a bridge over the river, and it is open to all.</p>\x03<div class="advert">Cheap boats. Click here.</div>\x02<p>The first to cross it was a dog, the mayor said, and then came the band.</p><div class="post"><p>It cost less than was feared, as the stone was found on the spot.</p></div>\x03</article><div class="thread"><h3>12 responses</h3><div><b>ann</b><p>I have waited for this for so long, and now I live somewhere else.</p><a href="#">Reply</a></div><div><b>bob</b><p>The old ferry was nicer, and it had tea.</p><a href="#">Reply</a></div></div><div><p>Legal notice: the publisher is not liable for what others write. Privacy policy.</p></div></div></body>',
    '<body><table><tr><td><a href="/">Index</a> | <a href="/faq">Help</a> | <a href="/in">Log in</a></td></tr></table><div>\x02<h1>How to mend a pump</h1>Take the cover off and look at the seal. If it is worn, the pump draws air and not water.<br>Order a new seal of the same width.<p>Grease the seal before you press it in. Turn the wheel by hand until it runs.</p><ol><li>Close the valve.</li><li>Open the tap and wait until no water comes.</li></ol>\x03</div><div><h4>Related</h4><ul><li><a href="/x">How to mend a tap and a hose</a></li><li><a href="/y">Pumps of the year</a></li></ul></div><div><h4>Discussion</h4><p>Mine still leaks after that, does anyone know why it does?</p><p>Wrong seal, I think.</p></div><p>Copyright. All rights reserved. Terms of use.</p></body>',
    '<body class="single"><div id="page" class="site"><div class="bar"><form><p>Search</p><input></form></div><section><div class="story">\x02<h2>The owl</h2><p>Owls hunt by night. They hear a mouse under the snow from far away, and they fly without a sound.</p><section><h3>Where they live</h3><p>In barns, in old trees and in the towers of churches, where nobody minds them.</p></section><p>See <a href="/eyes">the eyes of birds</a> for more about how they see.</p>\x03</div></section><aside><p>Sign up for the letter of the bird club, it is free and comes every month.</p></aside><section><h2>Comments</h2><ul><li><p>We had one in the garden last year, it was so beautiful that we all stood still.</p></li><li><p>Lovely!</p></li></ul></section><div>Share this: <a href="#">mail</a> <a href="#">print</a></div></div></body>',
    '<body><div><a href="/"><img></a> Accept all cookies to go on. <a href="/more">More</a></div><div><div>\x02<h1>Tax forms are due</h1><div>The tax office wants all forms by the end of the month, or a fine is due. Nobody was asked whether they have the time.</div><div>Those who send them late pay ten for each day, and those who do not send them pay more.</div>\x03</div><div><a href="/1">Next: the new tram</a></div></div><footer><ul><li>About us</li><li>Jobs</li></ul><p>Printed in the old town since 1901.</p></footer></body>',
    '<body><div><a href="/">Front</a> <a href="/all">All</a></div><div><div>\x02<h1>A walk in the hills</h1><div>The path begins behind the mill and climbs through a wood of beech.</div><div>After an hour the wood ends and one sees the lake.</div>\x03<div class="advert">Boots for all. Click here.</div>\x02<div>On the way down there is an inn with good soup.</div>\x03</div></div><div><h3>What readers say</h3><div><p>We got lost there in the fog, but the soup was good, that is true.</p></div><div><p>The inn is closed now.</p></div></div><div>Terms. Contact.</div></body>',
    '<body><nav><ul><li><a href="/a">Start</a></li></ul></nav><div>\x02<h2>Ink from oak</h2><div>Gather the galls in autumn, before the wasps leave them, and dry them for a week.</div><div>Crush them and cover them with rain water.</div><ul><li>galls</li><li>iron</li><li>gum</li></ul>\x03</div><div class="ad">Pens at half price. Click here.</div><div class="talk"><h3>Readers</h3><p>Does it work with galls from the year before, as I have a bag of them?</p><p>It does, I say.</p></div><footer>Copyright.</footer></body>',
    '<body><div class="a1"><p>This paper lives on the help of its readers. If you like it, pay what you can, so that all may read it.</p></div><article>\x02<h2>Bees in town</h2><p>On the roof of the town hall stand nine hives. The bees fly to the limes along the canal and to the gardens of the old hospital, and nobody has been stung so far.</p><ul><li>lime</li><li>clover</li></ul><p>It is good honey, and the mayor gives it away.</p>\x03</article><div class="b2"><p>What stands here is the view of those who wrote it. We do not answer for it, nor for what is behind a link.</p></div></body>',
    '<body><main>\x02<h1>The weir</h1><p>The weir was built to feed three mills.</p><p>One of them still grinds.</p>\x03</main><div class="c3">Texts and pictures may be used by schools. Ask us before you print them, please, and name the source.</div></body>',
)


@dataclass
class Weights:
    """Log odds of a block's features, log odds of a tag to stand outside content, and the scale of these costs."""

    features: dict[str, float] = field(default_factory=dict)
    bias: float = 1.0
    tags: dict[str, float] = field(default_factory=dict)
    unknown_tag: float = 0.5
    scale: float = 1.0


@dataclass
class Block:
    """A run of text between two tags that break: its parts, the words in all and in links, the element it stands in, the heading over it, and the number of its inline tags."""

    parts: list[str]
    element: str
    under: tuple[str, ...]
    words: int = 0
    linked: int = 0
    inline: int = 0
    labelled: bool = False

    def text(self) -> str:
        return _SPACE.sub(" ", entities.unescape("".join(self.parts)).replace(BEGIN, " ").replace(END, " ")).strip()


@dataclass
class Page:
    """items: blocks, and tags that break, `<name` or `>name`; around: the features of an element, its first block and the one behind its last."""

    items: list[Block | str]
    blocks: list[Block]
    around: list[tuple[tuple[str, ...], int, int]]


def tag_features(name: str, attributes: str) -> tuple[str, ...]:
    names = [] if name in SILENT else [f"in:{name}"]
    if attributes and ("=" in attributes):
        for m in _NAMES.finditer(attributes):
            names += [f".{w}" for w in _SPLIT.split((m[1] or m[2] or m[3] or "").lower()) if w]
    return tuple(dict.fromkeys(names))


class Unclosed:
    """Where a tag cannot end: what was learned from those that did not.

    The search for a tag's end is outside quotes, in double or in single ones, and each quote changes these three states one into another, so two searches in different states never meet. A search that begins where one that failed was outside quotes fails as well; so no more than three searches of a page run to its end in vain.
    """

    def __init__(self) -> None:
        self._failed: list[tuple[int, list[int], list[int]]] = []

    def at(self, place: int) -> bool:
        for start, opens, closes in self._failed:
            i = bisect_left(opens, place) - 1
            if place >= start and (i < 0 or place > closes[i]):
                return True
        return False

    def add(self, page: str, place: int, end: int) -> None:
        """A search from a place outside quotes came to the page's end, or to a quote that does not close."""
        spans = [m.span() for m in _QUOTED.finditer(page, place, end)]
        self._failed.append((place, [a for a, _ in spans] + [end], [b - 1 for _, b in spans] + [len(page)]))


def parts(page: str) -> Iterator[tuple[int, int, str, str, str, str | None]]:
    """Start, end, slash, name, attributes and text of each piece of a page: a tag has a name, a text is no null, and comments, declarations and elements with no text of their own are neither. A tag that never ends is text. Time grows with the page."""
    at, n, unclosed = 0, len(page), Unclosed()
    while at < n:
        m = _PART.match(page, at)
        end, slash, name, text = m.end(), m[1] or "", m[2] or "", m[3]
        if name:
            close = n if unclosed.at(end) else _ATTRIBUTES.match(page, end).end()
            if close < n and page[close] == ">":
                attributes, end = page[end:close], close + 1
                if not slash and name.lower() in _RAW_END:
                    over = _RAW_END[name.lower()].search(page, end)
                    end, name = over.end() if over else n, ""
                yield at, end, slash, name, attributes, None
            else:
                if not unclosed.at(end):
                    unclosed.add(page, end, close)
                end = at + 1
                yield at, end, "", "", "", "<"
        else:
            yield at, end, "", "", "", text
        at = end


def read(page: str) -> Page:
    """A page's items, in one pass. The work grows with the page, however deep its elements are: each is opened and closed once, and whether one of a name is open is known by count."""
    items: list[Block | str] = []
    blocks: list[Block] = []
    around: list[tuple[tuple[str, ...], int, int]] = []
    stack: list[tuple[str, tuple[str, ...], int]] = []
    solid: list[str] = ["body"]  # open elements that break
    is_open: Counter[str] = Counter()
    here: Block | None = None
    under: tuple[str, ...] = ()
    inside = False

    def finish() -> None:
        nonlocal here, under
        if here is None:
            return
        if here.words:
            items.append(here)
            blocks.append(here)
            if here.element in HEADINGS:
                under = tuple(w for w in _SPLIT.split(here.text().lower()) if w)[:SAID]
        here = None

    def pop() -> str:
        name, features, first = stack.pop()
        is_open[name] -= 1
        if name not in INLINE:
            finish()
            solid.pop()
        around.append((features, first, len(blocks)))
        return name

    for _, _, slash, tag, attributes, text in parts(page):
        if text is not None:
            if here is None:
                here = Block([], solid[-1], under)
            if BEGIN in text or END in text:
                for c in text:
                    inside = True if c == BEGIN else False if c == END else inside
                    here.labelled |= inside and not c.isspace() and c != BEGIN
            else:
                here.labelled |= inside
            n = len(text.replace(BEGIN, " ").replace(END, " ").split())
            here.parts.append(text)
            here.words += n
            if is_open["a"]:
                here.linked += n
        elif tag:
            name = tag.lower()
            if slash:
                if is_open[name]:
                    while pop() != name:
                        pass
                if name in INLINE:
                    if here is not None:
                        here.inline += 1
                else:
                    finish()
                    items.append(f">{name}")
                continue
            if name in ENDS_PARAGRAPH and is_open["p"]:  # an open paragraph ends here
                while pop() != "p":
                    pass
            if name in INLINE:
                if here is None:
                    here = Block([], solid[-1], under)
                if name == "br":
                    here.parts.append(" ")
                here.inline += 1
            else:
                finish()
                items.append(f"<{name}")
            if name not in VOID:
                is_open[name] += 1
                if name not in INLINE:
                    solid.append(name)
                stack.append((name, tag_features(name, attributes), len(blocks)))
    while stack:
        pop()
    finish()
    return Page(items, blocks, around)


def own_features(block: Block) -> list[str]:
    """What a block shows by itself."""
    text = block.text()
    n = block.words
    out = [f"tag:{block.element}", f"long:{min(3, int(math.log2(n)) // 2)}", f"links:{round(2 * block.linked / n)}", f"sentences:{min(2, len(_SENTENCE.findall(text)))}"]
    if n <= SAID:
        out += {f"says:{w}" for w in _SPLIT.split(text.lower()) if len(w) > 1}
    if block.element not in HEADINGS:
        out += {f"under:{w}" for w in block.under if len(w) > 1}
    return out


def telling(page: Page) -> list[tuple[tuple[str, ...], int, int]]:
    """Elements with features that are not around nearly all of the page's words."""
    words = np.concatenate([[0], np.cumsum([b.words for b in page.blocks])]) if page.blocks else np.zeros(1)
    return [(f, a, b) for f, a, b in page.around if f and a < b and words[b] - words[a] < AROUND * words[-1]]


def log_odds(page: Page, weights: Weights) -> np.ndarray:
    """Of each block to be content."""
    get = weights.features.get
    change = np.zeros(len(page.blocks) + 1)
    for features, a, b in telling(page):
        w = sum(get(f, 0.0) for f in features)
        change[a] += w
        change[b] -= w
    return np.cumsum(change)[:-1] + np.array([weights.bias + sum(get(f, 0.0) for f in own_features(b)) for b in page.blocks])


def tag_cost(tag: str, weights: Weights) -> float:
    """What a tag costs: the cube of its log odds, so that one that hardly ever stands in content parts a page and a common one does not."""
    return -LEAST_COST - weights.scale * weights.tags.get(tag, weights.unknown_tag) ** 3


def scores(page: Page, odds: np.ndarray, weights: Weights) -> list[float]:
    """The score of each item: a block's words by its log odds and the least cost of each of its inline tags, as what links say is among its features; or the cost of a tag. Words that are left out of any region count nothing, so that an advert amid an article does not cut it in two."""
    each = iter(np.where(odds > LEFT_OUT, np.clip(odds / SURE, -1, 1), 0).tolist())
    cost = {i: tag_cost(i, weights) for i in page.items if isinstance(i, str)}
    return [cost[i] if isinstance(i, str) else i.words * next(each) - LEAST_COST * i.inline for i in page.items]


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous run with the greatest sum, the first of equal ones; empty if no sum is over zero."""
    best, start, end, total, at = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, at = 0.0, i
        total += s
        if total > best:
            best, start, end = total, at, i + 1
    return start, end


def content(page: Page, weights: Weights, odds: np.ndarray | None = None) -> list[Block]:
    """The blocks of the best region that are likely enough to be content."""
    odds = log_odds(page, weights) if odds is None else odds
    a, b = best_region(scores(page, odds, weights))
    before = sum(isinstance(i, Block) for i in page.items[:a])
    return [block for block, o in zip((i for i in page.items[a:b] if isinstance(i, Block)), odds[before:].tolist(), strict=False) if o > LEFT_OUT]


def main_text(page: str | None, weights: Weights) -> str:
    return "\n\n".join(t for b in content(read((page or "").replace(BEGIN, " ").replace(END, " ")), weights) if (t := b.text()))


def mark_article(page: str) -> str | None:
    """A page as a labelled one where it marks its content itself, with exactly one article element."""
    page = page.replace(BEGIN, " ").replace(END, " ")
    opened = [p for p in parts(page) if p[3].lower() == "article"]
    if len(opened) != 2 or opened[0][2] or not opened[1][2]:
        return None
    a, b = opened[0][1], opened[1][0]
    return f"{page[:a]}{BEGIN}{page[a:b]}{END}{page[b:]}"


def _labelled_tags(page: str) -> Iterator[tuple[str, bool]]:
    """Each tag, and whether it stands inside marked content."""
    inside = False
    for _, _, slash, name, _, text in parts(page):
        if text is not None:
            at = max(text.rfind(BEGIN), text.rfind(END))
            inside = text[at] == BEGIN if at >= 0 else inside
        elif name:
            yield ("<>"[bool(slash)] + name.lower()), inside


def _agreement(pages: list[tuple[Page, np.ndarray, float]], weights: Weights) -> float:
    """The sum over pages of the F1 of blocks, each by its words and some more, so that short ones count too."""
    total = 0.0
    for page, odds, weight in pages:
        got = {id(b) for b in content(page, weights, odds)}
        both = sum(b.words + SHORT for b in page.blocks if b.labelled and id(b) in got)
        either = sum((b.words + SHORT) * (b.labelled + (id(b) in got)) for b in page.blocks)
        total += weight * (2 * both / either if either else 1.0)
    return total


def fit_weights(pages: Iterable[str], shown: Iterable[str] = ()) -> Weights:
    """Weights from labelled pages; shown: more of them, together worth as much as all others, as they show what those may lack."""
    weighted: list[tuple[Page, str, float, float]] = []
    kinds = [list(pages), list(shown)]
    for kind in kinds:
        parsed = [(read(p), p) for p in kind]
        n = sum(len(page.blocks) for page, _ in parsed)
        weighted += [(page, text, WORTH / n, max(LEAST_PAGES, *map(len, kinds)) / len(kind)) for page, text in parsed if n]
    count: tuple[Counter[str], Counter[str], Counter[str]] = (Counter(), Counter(), Counter())  # outside, inside, blocks
    tags: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
    rows: list[tuple[list[str], int, float]] = []
    for page, text, weight, times in weighted:
        more: list[list[str]] = [[] for _ in page.blocks]
        for features, a, b in telling(page):
            for k in range(a, b):
                more[k] += features
        for block, outer in zip(page.blocks, more, strict=True):
            row = own_features(block) + outer
            for f in set(row):
                count[block.labelled][f] += weight
                count[2][f] += 1
            rows.append((row, int(block.labelled), weight))
        for tag, inside in set(_labelled_tags(text)):  # once a page, so that a long menu counts no more than a short one
            tags[inside][tag] += times
    if not rows:
        return Weights()
    total = [max(1e-9, sum(w for _, y, w in rows if y == side)) for side in (0, 1)]
    names = [f for f, n in count[2].most_common() if n >= SEEN and (f.split(":")[0] not in ("says", "under") or count[0][f] / total[0] > TELLS * count[1][f] / total[1])][:LEARNED]
    place = {f: k + 1 for k, f in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1))
    x[:, 0] = 1
    for k, (row, _, _) in enumerate(rows):
        for f in row:
            if f in place:
                x[k, place[f]] += 1
    w = fit_logistic(x, np.array([y for _, y, _ in rows], float), ridge=0.5, weights=np.array([v for _, _, v in rows]))
    odds = {t: math.log((tags[0][t] + 1) / (tags[1][t] + 1)) for t in tags[0].keys() | tags[1].keys()}
    weights = Weights({f: float(w[k]) for f, k in place.items()}, float(w[0]), {t: max(0.0, o) for t, o in odds.items()})
    judged = [(page, log_odds(page, weights), weight * len(page.blocks)) for page, _, weight, _ in weighted]
    good = {s: _agreement(judged, Weights(weights.features, weights.bias, weights.tags, weights.unknown_tag, s)) for s in SCALES}
    best = max(s for s in SCALES if good[s] >= (1 - SAME) * max(good.values()))
    return Weights(weights.features, weights.bias, weights.tags, weights.unknown_tag, best)


def fit(pages: DataFrame, html_col: str = "html", sample: int = 300, longest: int = 50_000) -> Weights:
    """Weights from the built-in labelled pages and from at most `sample` pages of the table that mark their content with one article element and have at most `longest` characters (documented bounds), those whose text hashes lowest."""
    rows = pages.select(F.col(f"`{html_col}`").cast("string").alias("html")).filter(F.col("html").contains("</article") & (F.length("html") <= longest))
    hashed = rows.withColumn("h", F.xxhash64("html"))
    # hashes alone are ranked; then those pages are read again, one of each hash
    lowest = [r["h"] for r in hashed.select("h").groupBy("h").agg(F.lit(1)).select("h").orderBy("h").limit(sample).collect()]
    picked = hashed.filter(F.col("h") <= lowest[-1]).groupBy("h").agg(F.first("html").alias("html")).orderBy("h").collect() if lowest else []
    return fit_weights([m for r in picked if (m := mark_article(r["html"]))], LABELLED)


def _extract(weights):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, weights.value) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=TEXTS.names)

    return extract


def extract_text(pages: DataFrame, weights: Weights, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of pages: page_id, url, text, n_chars.

    Blocks of the best region in page order, joined by an empty line. A line break (`br`) is white space inside a block. A page without words, an empty or a null one, has an empty text; text without any tag is one block. Unclosed and stray tags, comments, scripts and quotes with angle brackets inside are read as browsers read them, roughly. Ties go to the region that starts first. Repeated rows are kept; other columns are not read; an empty table gives an empty result.
    """
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    return rows.mapInArrow(tidy(_extract(pages.sparkSession.sparkContext.broadcast(weights))), TEXTS)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract_text(pages, fit(pages))
