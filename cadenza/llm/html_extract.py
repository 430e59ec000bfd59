"""Main text of web pages: the contiguous region of greatest score.

A page is a row of tokens: words, and tags. A word's score is the sum of the log odds, in labelled pages (`LABELLED`), of
what surrounds it: its nearest telling container, the element that holds it, and whether it is in a link, or how long its block is. A tag's score is
one negative weight, under which the regions found in the labelled pages agree best with their labels. One
linear scan finds the best contiguous region; blocks in it whose own words sum to zero or less are left out. What
isn't content inside an open article (an advert, reader comments) scores zero, so that it is left out but ends no region.
Items and cells in the region, and those that follow it in the same container without a heading between, are too short to
tell; they go with it, but for links. Text is joined block by block; blanks between inline elements stay blanks.

Class names of `html` and `body`, and names of a state (`has-sidebar`, `nav-open`), tell nothing, and an `article` or `main`
is one whatever its names, unless they say comments or an advert. A container that holds `main`, a form that holds an article
or `h1`, and one that is called what isn't content and yet holds nearly all running text of the page (or most of it, where its
names say content too) wraps the page's main part and tells nothing. The header of an article keeps its headings.

Defined results: a null, empty or text-free page gives an empty text; a page without any tag is one block; unclosed tags end with the page, their parent, or, as in
HTML, at the next item, term, row or cell; a closing tag finds its element at any depth;
unclosed scripts, styles and comments hide the rest of the page; equal scores give the first region; rows that repeat
give repeated results; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import ship

ship(__name__)

#: Raw text elements, and elements that can hold no text of a page.
HIDDEN = frozenset("script style noscript template textarea select iframe object svg math canvas title head".split())
RAW = frozenset("script style noscript template textarea iframe title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin a block.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Containers by which tokens are told apart.
CONTAINERS = frozenset("article main nav header footer aside form menu button label dialog section body".split())
#: Parts of class, id and role names that tell containers apart.
NAMED = re.compile(r"(?:^|[\s_-])(?:(ads?|advert\w*|banner|sponsor\w*|promo\w*)|(comments?|replies|reply|disqus|respond)|(nav\w*|menus?|breadcrumbs?|pagination)|(side-?bars?|related|widgets?|share|social)|(cookies?|notices?|consent|popup|modal|newsletter|subscribe|alert)|(foot\w*|copyright|legal)|(head(?:er)?|masthead|top-?bar)|(content|article|post|entry|story|main))(?=$|[\s_-])", re.IGNORECASE)
NAMES = ("ad", "comments", "nav", "aside", "notice", "footer", "header", "content")
#: Of a name: a state of the page, which says nothing of what the element holds.
STATE = re.compile(r"^(?:has|with|no|is|not|js)[-_]|[-_](?:open|opened|closed|active|enabled|disabled|visible|hidden|left|right)$", re.IGNORECASE)
#: Elements whose words are told apart.
HOLDERS = {"p": "p", "blockquote": "p", "pre": "p", "h1": "h", "h2": "h", "h3": "h", "h4": "h", "h5": "h", "h6": "h", "li": "li", "dt": "li", "dd": "li", "td": "cell", "th": "cell"}
#: Elements inside of which the words are still those of the holder.
HELD = frozenset(("address", "center", "div", "br"))
CLOSES_P = BLOCKS - {"br", "body", "html"}
#: Elements that end those of `ENDS` where one is the nearest open element but for these.
THROUGH = frozenset(("address", "div", "p"))
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
#: Parts of a table that end what is open of these in the same table.
CELLS = {"td": ("td", "th", "caption"), "th": ("td", "th", "caption"), "tr": ("tr", "td", "th", "caption")} | dict.fromkeys(("thead", "tbody", "tfoot"), ("thead", "tbody", "tfoot", "tr", "td", "th", "caption"))
#: Containers inside of which none is content.
OUTER = frozenset(("hidden", "ad", "comments", "nav", "aside", "notice", "footer", "header", "form", "menu", "button", "label", "dialog"))
#: Containers that what isn't content may interrupt, but not end.
INNER = frozenset(("article", "main", "content"))
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
ATTRIBUTE = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)

#: Labelled pages: what lies between <keep> and </keep> is main text.
LABELLED = (
    """<html><head><title>A walk</title><style>p{}</style></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/b">Walks</a></li></ul></nav><div class="ad">Boots at half price.</div><article><keep><h1>A walk by the river</h1><p>We set out early, when mist still lay over the meadows, and followed the towpath north.</p><p>By noon the sun had come through and the <b>water</b> shone like metal.</p></keep></article><footer>&copy; Walks &middot; All rights reserved.</footer></body></html>""",
    """<body><header><h2>Daily Paper</h2><a href="/x">Log in</a></header><main><keep><h1>Council votes on the bridge</h1><p>The town council decided on Tuesday evening to repair the old bridge rather than replace it.</p><blockquote>It has stood for a century, the mayor said.</blockquote></keep><div class="comments"><p>First!</p><p>I do not agree with this at all.</p></div></main><aside><h3>Most read</h3><a href="/1">Ten best soups</a></aside><footer>Contact Imprint Privacy</footer></body>""",
    """<body><div id="cookie-notice">We use cookies. <button>Accept</button></div><div class="menu"><a href="/a">Start</a> <a href="/b">News</a></div><div class="content"><keep><h1>How bread rises</h1><p>Yeast eats sugar and gives off gas, and the gas is held by the gluten of the dough.</p><ul><li>Knead it for ten minutes without flour.</li><li>Let it rest until it has doubled in size.</li></ul></keep></div><div class="sidebar"><p>Related recipes</p></div><form><label>Search</label><input type="text"></form><div class="footer">Copyright 2020</div></body>""",
    """<body><nav><a href="/en">English</a><a href="/de">Deutsch</a></nav><section><keep><h1>On clocks</h1><p>A clock is a thing that counts a motion which repeats itself evenly, and shows the count.</p><p>The best of them lose a second in the age of the world.</p></keep></section><div class="newsletter">Sign up for our letters</div><div class="related">More on time</div><footer><p>Written by the editors.</p></footer></body>""",
    """<body><header>Journal of small things</header><article><keep><p>Nothing is as quiet as a library at night, when the heating has gone off and only the books remain.</p></keep><div class="ad">Buy two and pay for one</div><keep><p>I used to stay there until the guard came round with his lamp, and he never told anyone.</p></keep></article><div class="comments"><p>Lovely, thank you for this.</p></div><footer>Imprint</footer></body>""",
    """<body><div><a href="/1">Front page</a> <a href="/2">Weather</a> <a href="/3">Sports results</a> <a href="/4">Letters</a></div><div><keep><h1>Rain ends the drought</h1><p>After eleven weeks without a drop, rain fell on the valley on Sunday and did not stop until Tuesday noon.</p><p>Farmers say that the wheat, which many had given up, may yet be saved.</p><h2>What comes next</h2><p>More rain is expected at the end of the month, with cooler nights.</p></keep></div><div><a href="/p">Previous</a> <a href="/n">Next</a></div><div>Printed on paper since 1931</div></body>""",
    """<body><table><tr><td><a href="/">Index</a><br><a href="/faq">Questions</a><br><a href="/links">Other sites</a></td><td><keep><h2>Care of old radios</h2><p>Never plug in a set that has stood for years before its capacitors have been looked at.</p><p>Dust the chassis with a dry brush, and write down the place of each valve before you pull it.</p><table><tr><td>Warm up</td><td>ten minutes at half voltage</td></tr></table></keep></td></tr></table><div class="copyright">Copyright 1998 by the club</div></body>""",
    """<body class="home nav-open"><div role="navigation"><ul><li><a href="/s">Science</a></li><li><a href="/c">Culture</a></li></ul></div><ul class="breadcrumb"><li><a href="/">Home</a></li><li>Science</li></ul><div id="main"><keep><h1>Snails sleep for years</h1><p>A desert snail on a museum card woke up after four years, when somebody washed the card in warm water.</p><ol><li>They close the shell with a lid of dry slime.</li><li>They burn almost nothing while they wait.</li></ol></keep><div class="share">Share this with your friends</div><div class="promo">Subscribe now and save a third</div></div><ol class="commentlist"><li class="comment"><p>My snail has slept since March, should I worry about it?</p></li><li class="comment"><p>Mine too.</p></li></ol><div class="widget"><h3>Tags</h3><a href="/t1">animals</a> <a href="/t2">deserts</a></div></body>""",
    """<body><form action="/search"><label>Search the archive</label><button>Go</button><p>Enter a word or a date to search all issues.</p></form><menu><li>Open</li><li>Save as</li></menu><dialog>Your session has ended. Sign in again.</dialog><keep><h1>Letter from the hills</h1><p>The road up here is washed out, so the mail comes by mule, and the news with it is always ten days old.</p><p>We do not mind. What is new in the hills is the colour of the sky, and that arrives on time.</p></keep><p class="legal">All prices include tax.</p><footer><a href="/imprint">Imprint</a></footer></body>""",
    """<body><header><h1>The Evening Lamp</h1><nav><a href="/">Today</a><a href="/arch">Archive</a></nav></header><main><section><keep><h2>A recipe for ink</h2><p>Crush the galls of oak, steep them in rain water for a week, and add a little iron and gum.</p><dl><dt>Oak galls</dt><dd>one part by weight, without holes</dd><dt>Iron salt</dt><dd>half a part</dd></dl><p>It goes on pale and turns black on the page within the hour, see <a href="/ink">our note on old inks</a>.</p></keep></section><aside><p>Also of interest: how to cut a quill without cutting your thumb.</p></aside></main><div class="alert">This site is moving to a new address on Monday.</div></body>""",
    """<body><div class="top-bar"><a href="/login">Log in</a></div><article><keep><div>The ferry was late again, and the people on the pier had begun to tell each other stories of other late ferries.<br><br>One of them, an old pilot, had waited three days in his youth for a boat that had sunk on the first.</div><div>He told it well, and nobody looked at the water while he spoke.</div></keep></article><div class="pagination"><a href="/2">2</a> <a href="/3">3</a></div></body>""",
    """<body><div><a href="/">Home</a><br><a href="/a">About</a></div><div><keep>Dear reader, this page has no style and no scripts, and it was written by hand in the year in which the web was new.<br>It lists the birds that I have seen from my window since the first of January, with the hour and the weather.<br>The rarest of them was a waxwing, which stayed for a minute and ate a single berry.</keep></div><div>Last change in May</div></body>""",
    """<body><div class="story"><keep>Nobody had told the new clerk that the clock in the hall ran backwards, and so he came to work at four in the afternoon.<pre>open at nine
close at five</pre>The sign on the door did not help him either.</keep></div><div class="modal">Do you want to receive messages from us?</div><section class="related"><div>Stories of other clerks and other clocks</div></section></body>""",
    """<body><div class="content"><keep><div>Two trains leave the city at noon, and nobody in either of them knows of the other until the bridge.</div><div>There they pass so close that one could shake hands from window to window.</div></keep></div><div class="comments"><div>I was in that train and it was not at noon at all, it was ten past, as it is every day.</div></div></body>""",
)


def tag_end(page: str, at: int, closed: dict[str, bool]) -> int:
    """Past the > that ends the tag: quotes count after = if they are closed."""
    i, n = at, len(page)
    while i < n:
        gt = page.find(">", i)
        if gt < 0:
            return n
        eq = page.find("=", i, gt)
        while eq >= 0:
            j = eq + 1
            while j < gt and page[j] in " \t\r\n\f":
                j += 1
            if j < gt and page[j] in "\"'" and closed.get(page[j], True):
                q = page.find(page[j], j + 1)
                if q < 0:
                    closed[page[j]] = False
                elif q > gt:
                    i = q + 1
                    break
                else:
                    eq = page.find("=", q + 1, gt)
                    continue
            eq = page.find("=", eq + 1, gt)
        else:
            return gt + 1
    return n


#: Of elements: those that are what their name says, whatever their class.
PLAIN = frozenset(("nav", "footer", "aside", "header", "menu", "button", "label", "dialog"))
#: Elements by which blocks are told to stand together.
SECTIONS = frozenset("article body center details div fieldset figure form main section td th".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Words of running text that a wrapper holds at least, and how many times those outside of it: by its names alone, or where they say content too.
LEAST_WRAPPED, MOST_OUTSIDE, MOST_OUTSIDE_NAMED = 20, 0.1, 1.0


def kind_of(name: str, attributes: str) -> tuple[str | None, bool]:
    """What a container tells of its tokens, if anything, and whether its names say content. Of compound names the part that isn't content counts."""
    content, other = False, None
    if attributes and name not in ("html", "body"):
        for m in ATTRIBUTE.finditer(attributes):
            for word in (m[1] or m[2] or m[3] or "").split():
                if STATE.search(word):
                    continue
                for found in NAMED.finditer(word):
                    if (kind := NAMES[found.lastindex - 1]) == "content":
                        content = True
                    elif name not in ("article", "main") or kind in ("comments", "ad"):
                        other = other or kind
        if other == "header" and content:
            return "header*", True
        if other:
            return other, content
        if content and name not in OUTER and name not in ("article", "main"):
            return "content", True
    return (name if name in CONTAINERS else None), content


class Tokens:
    """Of a page: kinds of tokens in order, and the words with their block and place among the tokens."""

    def __init__(self, page: str, marks: bool = False, wrappers: frozenset[int] = frozenset()):
        self.kinds: list[tuple[str, str, str]] = []  # link, or how long a block; or tag; context; holder
        self.counts: list[int] = []  # words
        self.wrappers: set[int] = set()  # places of containers that hold the page's main part
        self.words: list[tuple[int, int, str]] = []  # token, block, text of a run
        self.kept: list[bool] = []
        self.held: list[int] = []  # of words the section that holds them
        self.above: list[int] = []  # of sections the one around, or -1
        self.around: list[tuple] = []  # of open containers that aren't content: depth, place in the page, kind, whether its names or element may be wrong, first word
        self.spans: list[tuple] = []  # of closed ones: place, kind, names say content, first word, end
        keep, block, pos, n = False, 0, 0, len(page)
        stack: list[tuple[str, str, int, str]] = []  # name, context, place of the nearest that isn't in THROUGH, holder
        sections: list[tuple[int, int]] = []  # depth and number of open sections
        places: dict[str, list[int]] = defaultdict(list)  # in the stack, by name
        context, holder, links = "body", "block", 0
        closed: dict[str, bool] = {}
        while pos < n:
            lt = page.find("<", pos)
            text_to = n if lt < 0 else lt
            m = TAG.match(page, lt) if lt >= 0 else None
            while lt >= 0 and not m and not page.startswith(("<!", "<?"), lt):
                lt = page.find("<", lt + 1)
                text_to = n if lt < 0 else lt
                m = TAG.match(page, lt) if lt >= 0 else None
            if text_to > pos:
                self.held.append(sections[-1][1] if sections else -1)
                self.text(page[pos:text_to], (context, holder), links > 0, block, keep)
            if lt < 0:
                break
            if not m:
                if page.startswith("<!--", lt):
                    end = page.find("-->", lt + 4)
                    pos = n if end < 0 else end + 3
                else:
                    end = page.find(">", lt)
                    pos = n if end < 0 else end + 1
                continue
            name, closing = m[2].lower(), bool(m[1])
            end = tag_end(page, m.end(), closed)
            if marks and name == "keep":
                keep, pos = not closing, end
                continue
            if name in BLOCKS:
                block += 1
            if name in RAW and not closing:
                stop = re.compile(rf"</{name}\s*>?", re.IGNORECASE).search(page, end)
                pos = stop.end() if stop else n
                continue
            pos = end
            if name == "a":
                links = max(0, links + (-1 if closing else 1))
            if closing:
                if places[name]:
                    self.close(stack, places, places[name][-1], sections)
            elif name not in VOID:
                if name in CLOSES_P and stack and stack[-1][0] == "p":
                    self.close(stack, places, len(stack) - 1, sections)
                if name in ENDS and stack and (at := stack[-1][2]) >= 0 and stack[at][0] in ENDS[name]:
                    self.close(stack, places, at, sections)
                elif name in CELLS:
                    table = places["table"][-1] if places["table"] else -1
                    if open_ := [places[x][-1] for x in CELLS[name] if places[x] and places[x][-1] > table]:
                        self.close(stack, places, min(open_), sections)
                if name in BLOCKS or name in CONTAINERS or name in HIDDEN:
                    kind, named = ("hidden", False) if name in HIDDEN else (None, False) if lt in wrappers else kind_of(name, page[m.end() : end - 1])
                    if self.around and name in ("main", "article", "h1"):
                        self.wrappers.update(at for _, at, k, *_ in self.around if k != "hidden" and (name == "main" or k == "form"))
                    if kind in OUTER or kind == "header*":
                        self.around.append((len(stack), lt, kind if name not in PLAIN else "plain", named, len(self.words)))
                    if name in SECTIONS:
                        self.above.append(sections[-1][1] if sections else -1)
                        sections.append((len(stack), len(self.above) - 1))
                    places[name].append(len(stack))
                    up = stack[-1] if stack else ("", "body", -1, "block")
                    # a heading in an article's header is the article's
                    inner = "content" if name in HEADINGS and up[1] == "header*" and kind in (None, "content") else self.nearer(up[1], kind)
                    stack.append((name, inner, up[2] if name in THROUGH else len(stack), HOLDERS.get(name) or (up[3] if name in HELD else "block")))
            context, holder = (stack[-1][1], stack[-1][3]) if stack else ("body", "block")
            self.kinds.append(("tag", context, holder))
            self.counts.append(0)
            self.kept.append(keep)

        sizes: dict[int, int] = defaultdict(int)
        for at, block, _ in self.words:
            sizes[block] += self.counts[at]
        for at, block, _ in self.words:
            if self.kinds[at][0] == "word":
                self.kinds[at] = ("title" if self.kinds[at][2] == "h" else "few" if sizes[block] < 4 else "some" if sizes[block] < 10 else "many", *self.kinds[at][1:])
        self.find_wrappers()

    def find_wrappers(self) -> None:
        """Containers that are called what isn't content and hold the page's running text."""
        spans = [*self.spans, *((*x[1:], len(self.words)) for x in self.around)]
        before = [0]
        for at, _, _ in self.words:
            kind, context, _ = self.kinds[at]
            before.append(before[-1] + self.counts[at] * (kind == "many" and context.rstrip("*") != "hidden"))
        for place, kind, named, first, end in spans:
            inside = before[end] - before[first]
            if kind not in ("hidden", "comments", "plain") and inside >= LEAST_WRAPPED and before[-1] - inside <= inside * (MOST_OUTSIDE_NAMED if named else MOST_OUTSIDE):
                self.wrappers.add(place)

    def close(self, stack: list[tuple[str, str, int, str]], places: dict[str, list[int]], at: int, sections: list[tuple[int, int]]) -> None:
        while len(stack) > at:
            places[stack.pop()[0]].pop()
        while self.around and self.around[-1][0] >= at:
            self.spans.append((*self.around.pop()[1:], len(self.words)))
        while sections and sections[-1][0] >= at:
            sections.pop()

    @staticmethod
    def nearer(outer: str, kind: str | None) -> str:
        """Containers inside one that isn't content don't make it content. A star marks what isn't content inside of what is."""
        if kind is None or outer.rstrip("*") in OUTER:
            return outer
        return f"{kind}*" if kind in OUTER and outer in INNER else kind

    def text(self, run: str, where: tuple[str, str], link: bool, block: int, keep: bool) -> None:
        self.words.append((len(self.kinds), block, run))
        self.kinds.append(("link" if link else "word", *where))
        self.counts.append(len(run.split()))
        self.kept.append(keep)


def page_tokens(page: str, marks: bool = False) -> Tokens:
    """The tokens, read again without what turns out to wrap the page's main part."""
    t = Tokens(page, marks)
    return Tokens(page, marks, frozenset(t.wrappers)) if t.wrappers else t


Weights = dict[tuple[str, str], float]


def word_score(weights: Weights, kind: str, context: str, holder: str) -> float:
    return weights.get(("context", context), 0.0) + weights.get(("holder", holder), 0.0) + weights.get(("kind", kind), 0.0)


def trained(pages: tuple[str, ...] = LABELLED) -> Weights:
    """Log odds of each feature of words in labelled pages, by add-one smoothing, and the weight of a tag.

    The tag's weight is the middle of those of a grid under which the texts found agree best with the labels (F1 in words).
    """
    read = [page_tokens(page, marks=True) for page in pages]
    seen: dict[bool, Counter] = {True: Counter(), False: Counter()}
    for t in read:
        for (kind, context, holder), n, kept in zip(t.kinds, t.counts, t.kept, strict=True):
            if n:
                seen[kept].update({("context", context.rstrip("*")): n, ("holder", holder): n, ("kind", kind): n})
    out: Weights = {}
    for feature in ("context", "holder", "kind"):
        names = {x for s in seen.values() for x in s if x[0] == feature}
        total = {kept: sum(seen[kept][x] for x in names) + len(names) for kept in seen}
        for x in names:
            out[x] = math.log((seen[True][x] + 1) / total[True]) - math.log((seen[False][x] + 1) / total[False])
    # the labelled pages show no text of these, as there is none
    out["context", "hidden"] = min(out.values()) * 4

    def agreement(tag: float) -> float:
        hit = found = true = 0
        for t in read:
            taken = {at for at, _, _ in chosen(t, out | {("tag", ""): tag})}
            for at, _, _ in t.words:
                n = t.counts[at]
                hit, found, true = hit + n * (t.kept[at] and at in taken), found + n * (at in taken), true + n * t.kept[at]
        return 2 * hit / max(1, found + true)

    grid = [-0.05 * 1.3**k for k in range(16)]
    scores = [agreement(tag) for tag in grid]
    best = [tag for tag, score in zip(grid, scores, strict=True) if score == max(scores)]
    out["tag", ""] = best[len(best) // 2]
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and last + 1 of the contiguous region with the greatest sum above zero."""
    best, region, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, region = total, (start, i + 1)
    return region


def common(t: Tokens, words: list[int]) -> set[int]:
    """The sections inside the innermost one that holds all of these words; none if that is the page itself."""
    paths = []
    for section in {t.held[i] for i in words}:
        path = []
        while section >= 0:
            path.append(section)
            section = t.above[section]
        paths.append(path[::-1])
    n = 0
    while paths and all(len(p) > n for p in paths) and len({p[n] for p in paths}) == 1:
        n += 1
    if n < 2:  # the page, or its body
        return set()
    inside = {paths[0][n - 1]}
    for k in range(paths[0][n - 1] + 1, len(t.above)):
        if t.above[k] in inside:
            inside.add(k)
    return inside


def chosen(t: Tokens, weights: Weights) -> list[tuple[int, int, str]]:
    """The runs of the best region's blocks, each block as a whole."""
    if t.words and all(k[0] != "tag" for k in t.kinds):
        return t.words
    memo = {k: 0.0 if k[1].endswith("*") else weights["tag", ""] if k[0] == "tag" else word_score(weights, *k) for k in set(t.kinds)}
    scores = [memo[k] if k[0] == "tag" else n * memo[k] for k, n in zip(t.kinds, t.counts, strict=True)]
    a, b = best_region(scores)
    blocks = {block for at, block, _ in t.words if a <= at < b}
    sums: dict[int, float] = defaultdict(float)
    linked: dict[int, list[int]] = defaultdict(lambda: [0, 0])
    parts: dict[int, list[int]] = defaultdict(list)
    for i, (at, block, _) in enumerate(t.words):
        sums[block] += scores[at]
        linked[block][t.kinds[at][0] == "link"] += t.counts[at]
        if t.counts[at]:
            parts[block].append(i)
    visible = lambda i: t.kinds[t.words[i][0]][1].rstrip("*") != "hidden"
    taken = {block for block in blocks if sums[block] > 0}
    inside = common(t, [i for block in taken for i in parts[block] if visible(i)]) if taken else set()
    last = max(taken, default=0)
    for block in sorted(parts) if inside else ():
        if block not in taken and block >= min(taken):
            holders, contexts = {t.kinds[t.words[i][0]][2] for i in parts[block]}, {t.kinds[t.words[i][0]][1].rstrip("*") for i in parts[block]}
            if block > last and ("h" in holders or contexts & OUTER and "header" not in contexts or not all(t.held[i] in inside for i in parts[block])):
                break
            if holders <= {"li", "cell"} and not contexts & OUTER and linked[block][0] > linked[block][1] and all(t.held[i] in inside for i in parts[block]):
                taken.add(block)
    return [w for i, w in enumerate(t.words) if w[1] in taken and visible(i)]


def main_text(page: str | None, weights: Weights) -> str:
    blocks: dict[int, list[str]] = {}
    for _, block, run in chosen(page_tokens(page or ""), weights):
        blocks.setdefault(block, []).append(run)
    lines = (" ".join(entities.unescape("".join(runs)).split()) for runs in blocks.values())
    return "\n".join(x for x in lines if x)


def main_texts(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, url, text, n_chars of each page(page_id, url, html)."""
    weights = weights or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), weights) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
