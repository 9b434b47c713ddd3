"""Main text of web pages by minimum cut.

A page becomes blocks of text. A classifier on each block's tags, names, length and links gives the cost
of calling it content or boilerplate; these are the capacities to the two terminals. Neighbouring blocks
and blocks with a common parent are tied by smoothness edges. The minimum cut separates the two kinds, so
a short paragraph among long ones stays and a long menu entry among menus goes.

Tags and hidden elements (by `hidden`, `aria-hidden=true` or an inline style) are a verdict for all they hold.
So are names, unless they tell of something else: "no-sidebar" or "comment-open" is a hint about the element's
own text alone, as is any name of `main` or of what it is in. A name of an article, or of what an article is
in, counts in proportion to the main text beside it.

Defined results: a null or empty page, and one without content blocks, has an empty text. Broken markup
(unclosed tags, unknown references, an unfinished tag at the end) is read as far as it goes; only a script,
style, title or textarea without its end runs to the end of the page. Inside a block
every run of white space, line breaks included, is one space. Repeated rows get equal texts. Other columns
pass through; those named like the results are replaced.
"""

import re
from collections import deque
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^\"'>]|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s"'>][^\s>]*)))?""")
WORD = re.compile(r"[a-z]+")
#: What follows in a name is there or missing somewhere else; a name that ends so is a state.
ELSEWHERE = re.compile(r"(?:^|[-_])(?:no|has|with|without)[-_]")
STATE = re.compile(r"[-_](?:open|opened|closed|enabled|disabled|free)$")
CSS_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)

#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes template svg object annotation annotation-xml".split())
#: Of these, those that only their end tag ends; the others are ordinary markup when it is missing.
UNENDED = frozenset("script style title textarea".split())
RAW_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<hard>script|style|title|textarea)\b.*?(?:</(?P=hard)\b|\Z)"
    rf"|<(?P<end>/?)(?P<name>{'|'.join(sorted(RAW - UNENDED))})(?=[\s/>])(?P<attrs>(?:[^\"'>]|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)",
    re.S | re.I,
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr img br math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded "
    "mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section table ul".split()
)
#: Elements and names that hold no main text.
ASIDE_TAGS = frozenset("nav footer aside form menu button select option dialog head fieldset legend".split())
ASIDE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments contentinfo "
    "complementary consent cookie cookies copyright disclaimer disqus discussion feedback foot footer form gdpr head "
    "header legal login masthead menu modal nav navbar navigation newsletter notice notices pagination paywall popup "
    "promo promoted promotion recommended related replies reply respond search share sharing sidebar signup social "
    "sponsor sponsored subscribe subscription tags toolbar widget".split()
)
#: The same as beginnings of longer names.
ASIDE_STEMS = ("advert", "adsby", "breadcrumb", "comment", "cookie", "newsletter", "sidebar", "sponsor", "subscri")
#: Of these, what an article may be about or have a part called; inside one they are a hint.
TOPICS = frozenset("copyright disclaimer discussion feedback legal recommended related".split())
#: Names that are boilerplate of the page, but part of an article when inside one.
HEADS = frozenset("head header masthead".split())
MAIN_TAGS = frozenset(("article", "main"))
MAIN_NAMES = frozenset("article content entry main post story".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: The classifier: log odds that a block is content. A page without a main element is all that its reader gets.
BASE, PARAGRAPH, TITLE, HEADING, QUOTE, ITEM, NO_MAIN = -0.6, 0.8, 0.9, 0.4, 0.4, -0.2, 1.0
PER_WORD, MOST_WORDS = 0.025, 60
IN_MAIN, OUTSIDE_MAIN, IN_ASIDE, HINT, LINKS, LINKS_IN_MAIN, RIGHTS = 1.2, -2.5, -6.0, -0.5, -3.0, -0.3, -2.0
#: Words of main text beside an article that is named as boilerplate at which the name counts in full; with fewer
#: it counts in proportion.
BESIDE = 40
#: Smoothness: between neighbours, more with a common parent, and to the next block of the same parent.
NEXT, SIBLINGS, PARENT = 0.3, 0.5, 0.4


def attributes(attrs: str) -> dict[str, str]:
    """Values by lower-case name; of several the first, as in the HTML standard."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attrs):
        value = m[2] or m[3] or m[4] or ""
        found.setdefault(m[1].lower(), unescape(value) if "&" in value else value)
    return found


def hidden(given: dict[str, str]) -> bool:
    """Whether the attributes hide the element; one that opens when searched for is only folded."""
    if "hidden" in given and given["hidden"].strip().lower() != "until-found":
        return True
    if given.get("aria-hidden", "").strip().lower() == "true":
        return True
    if "style" not in given:
        return False
    style: dict[str, str] = {}
    for part in CSS_COMMENT.sub("", given["style"].lower()).split(";"):
        key, _, value = part.partition(":")
        style[key.strip()] = value.replace("!important", "").strip()
    return style.get("display") == "none" or style.get("visibility") == "hidden"


def name_words(given: dict[str, str]) -> tuple[set[str], set[str]]:
    """Words of the class, id and role: what the element is, and what its names only tell about."""
    own: set[str] = set()
    hints: set[str] = set()
    for key in ("class", "id", "role"):
        for token in given.get(key, "").lower().split():
            if STATE.search(token):
                hints.update(WORD.findall(token))
                continue
            m = ELSEWHERE.search(token)
            own.update(WORD.findall(token[: m.start()] if m else token))
            if m:
                hints.update(WORD.findall(token[m.end() :]))
    return own, hints


def aside_names(words: set[str], heads: bool) -> bool:
    """Whether a word names boilerplate; headers do if `heads`."""
    found = words & ASIDE_NAMES
    return bool(found if heads else found - HEADS) or any(w.startswith(ASIDE_STEMS) for w in words)


class Blocks:
    """The text blocks of a page in order, with what the classifier wants to know."""

    def __init__(self, html: str):
        self.texts: list[str] = []
        self.odds: list[float] = []
        self.parents: list[int] = []
        self.in_main: list[bool] = []
        # Open elements: name, number, inside main.
        self.open: list[tuple[str, int, bool]] = []
        # By number, 0 for the page: the element around, boilerplate by tag or hidden, by name, hints, and
        # whether it is or holds an article (1) or the main element (2), and whether it
        # is or lies in a part of the article named after a topic of its own.
        self.around, self.bad, self.named, self.hints, self.holds, self.topics = [0], [False], [False], [False], [0], [False]
        # By block: element, in a main element, a heading, number of words and of linked ones.
        self.blocks: list[tuple[int, bool, bool, int, int]] = []
        self.ends: dict[int, int] | None = None
        self.text: list[str] = []
        self.linked = 0
        self.links = 0
        at, n = 0, len(html)
        while at < n:
            lt = html.find("<", at)
            if lt < 0:
                self._add(html[at:])
                break
            if lt > at:
                self._add(html[at:lt])
            m = TAG.match(html, lt)
            if not m:
                self._add("<")
                at = lt + 1
                continue
            at = m.end()
            name = m["name"]
            if name is None:
                continue
            name = name.lower()
            if m["end"]:
                self._close(name)
            elif name in RAW:
                at = self._skip(html, name, lt, at, m["attrs"])
            else:
                self._open(name, m["attrs"])
        self._flush()
        self._settle()

    def _settle(self) -> None:
        """What names mean is known at the end of the page."""
        n = len(self.bad)
        aside, doubtful = list(self.bad), [False] * n  # doubtful: named, and is or holds an article
        for i in range(1, n):
            aside[i] = aside[i] or aside[self.around[i]] or (self.named[i] and not self.holds[i])
            doubtful[i] = doubtful[self.around[i]] or (self.named[i] and self.holds[i] == 1)
        main = [in_main and not aside[e] for e, in_main, _, _, _ in self.blocks]
        beside = sum(words for (e, _, heading, words, _), i in zip(self.blocks, main) if i and not heading and not doubtful[e])
        doubt = min(1.0, beside / BESIDE)
        any_main = any(main)
        for k, (e, in_main, _, words, linked) in enumerate(self.blocks):
            of_main = main[k] * (1.0 - doubt * doubtful[e])
            hint = not aside[e] and (self.named[e] or self.hints[e] or self.topics[e])
            odds = IN_MAIN * in_main + IN_ASIDE * max(float(aside[e]), doubt * doubtful[e]) + HINT * hint
            odds += (1.0 - of_main) * OUTSIDE_MAIN if any_main else NO_MAIN
            links = LINKS if hint else LINKS + of_main * (LINKS_IN_MAIN - LINKS)
            self.odds[k] += odds + links * min(1.0, linked / words)
        self.in_main = main

    def _skip(self, html: str, name: str, lt: int, at: int, attrs: str) -> int:
        """Where to read on: after the end of the element, or inside it if it has none."""
        if attrs.endswith("/") and name in ("svg", "math"):
            return at
        if name in UNENDED:
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            return end.end() if end else len(html)
        if self.ends is None:
            self.ends = {}
            starts: dict[str, list[int]] = {}
            for m in RAW_TAG.finditer(html):
                if m["name"] is None:
                    continue
                same = starts.setdefault(m["name"].lower(), [])
                if not m["end"]:
                    if not (m["attrs"].endswith("/") and m["name"].lower() in ("svg", "math")):
                        same.append(m.start())
                elif same:
                    self.ends[same.pop()] = m.end()
        return self.ends.get(lt, at)

    def _add(self, text: str) -> None:
        self.text.append(text)
        if self.links:
            self.linked += len(text.split())

    def _open(self, name: str, attrs: str) -> None:
        if name in INLINE:
            if name == "a":
                self.links += 1
            elif name == "br":
                self.text.append(" ")
            return
        self._flush()
        if name in CLOSES_P:
            self._pop("p", ("p",))
        elif name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            self._pop(name, (name, "p"))
        if name in VOID or attrs.endswith("/"):
            return
        _, above, main = self.open[-1] if self.open else ("", 0, False)
        given = attributes(attrs) if attrs else {}
        own, hints = name_words(given)
        page = name in ("html", "body")
        bad = name in ASIDE_TAGS or (name == "header" and not main) or (not page and hidden(given))
        heads = not main and not (own | hints) & MAIN_NAMES
        topics = own & TOPICS if main else set()
        named = not page and aside_names(own - topics, heads)
        good = name in MAIN_TAGS or (not bad and not named and not page and bool((own | hints) & MAIN_NAMES))
        number = len(self.around)
        self.around.append(above)
        self.bad.append(bad)
        self.named.append(named)
        self.hints.append(not page and (aside_names(hints, heads) or bool(topics)))
        self.topics.append(bool(topics) or self.topics[above])
        self.holds.append(0)
        self.open.append((name, number, main or good))
        if name == "main" or given.get("role", "").strip().lower() == "main":
            self._hold(number, 2)
        elif name == "article" and not any(x[0] == "article" for x in self.open[:-1]):  # an article's articles are replies
            self._hold(number, 1)
            if own & MAIN_NAMES:
                self.hints[number], self.named[number] = self.hints[number] or self.named[number], False

    def _hold(self, number: int, kind: int) -> None:
        while number and self.holds[number] < kind:
            self.holds[number] = kind
            number = self.around[number]

    def _pop(self, name: str, through: tuple[str, ...]) -> None:
        """Close the element if only those of `through` are open inside it."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == name:
                del self.open[i:]
                return
            if self.open[i][0] not in through:
                return

    def _close(self, name: str) -> None:
        if name in INLINE:
            if name == "a" and self.links:
                self.links -= 1
            return
        self._flush()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == name:
                del self.open[i:]
                return

    def _flush(self) -> None:
        if self.text:
            words = unescape("".join(self.text)).split()
            if words:
                self._block(words)
            self.text = []
        self.linked = self.links = 0

    def _block(self, words: list[str]) -> None:
        name, number, main = self.open[-1] if self.open else ("", 0, False)
        odds = BASE + PER_WORD * min(len(words), MOST_WORDS)
        if name == "p":
            odds += PARAGRAPH
        elif name in HEADINGS:
            odds += TITLE if name == "h1" else HEADING
        elif name in ("blockquote", "pre", "xmp"):
            odds += QUOTE
        elif name in ("li", "td", "th", "dt", "dd"):
            odds += ITEM
        if words[0][0] == "©":
            odds += RIGHTS
        self.texts.append(" ".join(words))
        self.odds.append(odds)
        self.parents.append(self.open[-2][1] if len(self.open) > 1 else 0)
        self.blocks.append((number, main, name in HEADINGS, len(words), self.linked))


def edges(parents: list[int]) -> list[tuple[int, int, float]]:
    """Smoothness between neighbours in the page and in the document tree."""
    out, last = [], {}
    for i, parent in enumerate(parents):
        if i:
            out.append((i - 1, i, SIBLINGS if parents[i - 1] == parent else NEXT))
        before = last.get(parent)
        if before is not None and before != i - 1:
            out.append((before, i, PARENT))
        last[parent] = i
    return out


def min_cut(odds: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """The labelling with the least sum of |odds| of nodes against their odds and of edges cut.

    Nodes whose odds outweigh all their edges are settled at once and hand their edges to their
    neighbours' terminals; maximum flow settles what is left. A node that the flow leaves undecided is
    not content.
    """
    n = len(odds)
    odds = list(odds)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in ties:
        near[a][b] = near[a].get(b, 0.0) + w
        near[b][a] = near[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(odds[i]) > sum(near[i].values()):
            label[i] = odds[i] > 0
            for j, w in near[i].items():
                odds[j] += w if label[i] else -w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    left = [i for i in range(n) if label[i] is None]
    if left:
        reached = _source_side(left, odds, near)
        for i in left:
            label[i] = i in reached
    return label


def _source_side(nodes: list[int], odds: list[float], near: list[dict[int, float]]) -> set[int]:
    """Nodes that the source still reaches after a maximum flow.

    Flow goes along all shortest paths at once: each phase numbers the nodes by their distance from the sources
    and fills the paths to the nearest drains, so the phases are no more than the lengths of paths.
    """
    tiny = 1e-9
    supply = {i: odds[i] for i in nodes if odds[i] > tiny}
    drain = {i: -odds[i] for i in nodes if odds[i] < -tiny}
    room = {i: dict(near[i]) for i in nodes}
    while True:
        level = {i: 0 for i, s in supply.items() if s > tiny}
        ring, depth, found = list(level), 0, False
        while ring and not found:
            found = any(drain.get(i, 0.0) > tiny for i in ring)
            if found:
                break
            depth += 1
            after = []
            for i in ring:
                for j, w in room[i].items():
                    if w > tiny and j not in level:
                        level[j] = depth
                        after.append(j)
            ring = after
        if not found:
            return set(level)
        left = {}  # per node, the neighbours not tried yet in this phase
        for root in [i for i, s in supply.items() if s > tiny]:
            path = [root]
            while path and supply[root] > tiny:
                i = path[-1]
                if level[i] == depth and drain.get(i, 0.0) > tiny:
                    flow = min(supply[root], drain[i], *(room[a][b] for a, b in zip(path, path[1:])))
                    supply[root] -= flow
                    drain[i] -= flow
                    cut = len(path)
                    for k in range(len(path) - 1, 0, -1):
                        a, b = path[k - 1], path[k]
                        room[a][b] -= flow
                        room[b][a] = room[b].get(a, 0.0) + flow
                        if room[a][b] <= tiny:
                            cut = k
                    del path[cut:]
                    continue
                on = left.get(i)
                if on is None:
                    on = left[i] = [j for j in room[i] if level.get(j) == level[i] + 1] if level[i] < depth else []
                while on and room[i][on[-1]] <= tiny:
                    on.pop()
                if on:
                    path.append(on[-1])
                else:
                    path.pop()
                    if path:
                        left[path[-1]].pop()


def main_text(html: str | None) -> str:
    if not html:
        return ""
    page = Blocks(html)
    keep = min_cut(page.odds, edges(page.parents))
    return "\n".join(t for t, k in zip(page.texts, keep) if k)


def extract(pages: DataFrame) -> DataFrame:
    """`pages` with `text`, the main text of `html`, and `n_chars`, its length."""
    names = [c for c in pages.columns if c not in ("text", "n_chars")]
    rows = pages.select(*[F.col(f"`{c}`") for c in names])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch["html"].to_pylist()]
            more = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), *more], names=[*names, "text", "n_chars"])

    return rows.mapInArrow(run, f"{fields}, text string, n_chars bigint")
