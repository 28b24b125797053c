"""Main text of web pages as a maximum-scoring subsequence (operator 5).

A page is a sequence of words and tags. Each word has the log-odds, by a logistic model, of standing in the
article, given the names around it (elements, and the words of their class, id and role), whether it is linked, and
the length and the linked share of its block; each tag costs what labelled pages give for its name. One linear
scan finds the contiguous region of the highest sum, in which stretches may be left out at the price of
``GAP`` each (an advert inside the article). What it takes is the main text; nothing else decides.

The weights are learned from labelled pages (``labelled_pages``): layouts drawn by a seeded rule from names that
public sites use for their parts, with undecorated, decorated and unknown names, wrappers, page-level class
words and adverts inside articles. Names around nearly all words of a page say nothing about them and have no weight.

Blocks are what block-level tags separate (a ``br`` is white space inside its block). Character references
are decoded, white space (Unicode's) becomes one space, blocks are trimmed and joined in page order by a
line feed; nothing else is dropped and nothing is capped. Parsing and scanning take time linear in the page.

Defined results: a null or empty page, or one without a positive region, has an empty text; markup that is
never closed ends with its parent, an unclosed script or style with the page, other elements without text of the page are
taken as tags if they are never closed; a ``<`` that starts no tag is text; repeated rows are extracted
each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm.hashing import bound_batches, lean, small_batches

#: Price of leaving out a stretch inside the region.
GAP = 2.0
#: Bounds of a word's weight.
LOW, HIGH = -4.0, 3.0
#: Share of a page's words from which the element around them says nothing.
WRAPPER = 0.9

# Names of HTML elements.
#: Elements whose content is not text of the page.
RAW = frozenset("script style noscript template textarea svg iframe object canvas title head select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose name is a name around their words.
NAMED = frozenset("a article aside blockquote button dd dialog figcaption figure footer form h1 h2 h3 h4 h5 h6 header label li main menu nav p pre section table td th ul ol dl".split())
#: Elements that end an open one of the same line when they begin.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}

# Elements and class words by which public sites name the parts of a page.
PARTS = {
    "nav": (("nav", "menu"), "nav navbar navigation menu topnav breadcrumb breadcrumbs pagination pager tabs links"),
    "header": (("header",), "header masthead banner topbar logo branding toolbar"),
    "footer": (("footer",), "footer bottom colophon copyright legal imprint credits"),
    "sidebar": (("aside",), "sidebar aside rail widget related popular trending recommended more archive tags"),
    "ad": ((), "ad ads advert advertisement adverts sponsor sponsored promo promotion outbrain taboola commercial"),
    "notice": (("dialog",), "cookie cookies consent gdpr notice popup modal alert paywall newsletter subscribe subscription signup overlay disclaimer warning"),
    "share": ((), "share sharing social follow buttons"),
    "form": (("form",), "search login form feedback contact register survey"),
    "comments": ((), "comments comment respond discussion replies reply reader disqus responses"),
}
CONTENT = "content article post entry story main body text page prose copy"
DECORATION = (("site", "page", "main", "top", "left", "right", "js", "block", "inner", "post", "global", "c", "l"), ("wrap", "box", "container", "area", "inner", "list", "item", "block", "section", "wrapper", "panel"))

_ATTRIBUTE = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_CLOSE = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}
_BODY = re.compile(r"<body\b", re.I)


class _Events:
    """The parts of a page in order: ("open" | "close" | "text" | "mark", name or text, attributes). Every search that fails is not made again."""

    def __init__(self, page: str) -> None:
        self.page, self.last = page, page.rfind(">")
        self.unclosed: set[str] = set()  # raw elements and quotes that nothing closes from here on

    def _tag_end(self, at: int) -> int:
        """Place after the ``>`` of a tag whose name ends at ``at``; quoted values may hold one."""
        page = self.page
        while True:
            end = page.find(">", at)
            if end < 0:
                return -1
            quote = next((q for q in re.finditer(r"=\s*([\"'])", page[at:end]) if q[1] not in self.unclosed), None)
            if quote is None:
                return end + 1
            close = page.find(quote[1], at + quote.end())
            if close < 0:
                self.unclosed.add(quote[1])
                continue
            if close > self.last:
                return page.find(">", at) + 1
            at = close + 1

    def __iter__(self) -> Iterator[tuple[str, str, str]]:
        page, at, begun = self.page, 0, 0
        while (at := page.find("<", at)) >= 0:
            kind, what, attributes, end = self._markup(at)
            if end < 0:
                at += 1
                continue
            if at > begun:
                yield "text", page[begun:at], ""
            if kind:
                yield kind, what, attributes
            at = begun = end
        if begun < len(page):
            yield "text", page[begun:], ""

    def _markup(self, at: int) -> tuple[str, str, str, int]:
        """(kind, name, attributes, end) of what begins at the ``<``; end is -1 where nothing does."""
        page = self.page
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            return ("mark", page[at + 4 : end].strip(), "", end + 3) if end >= 0 else ("", "", "", len(page))
        if at >= self.last:
            return "", "", "", -1
        if page.startswith(("<!", "<?"), at):
            return "", "", "", page.find(">", at) + 1
        closing = page.startswith("</", at)
        m = _NAME.match(page, at + 1 + closing)
        if m is None or (end := self._tag_end(m.end())) < 0:
            return "", "", "", -1
        name, attributes = m[0].lower(), page[m.end() : end - 1]
        if closing:
            return "close", name, "", end
        if name in RAW and not attributes.endswith("/") and name not in self.unclosed:
            close = _CLOSE[name].search(page, end)
            if close is None and name == "head":
                close = _BODY.search(page, end)  # an unclosed head ends where the body begins
                if close:
                    return "", "", "", close.start()
            if close:
                return "", "", "", close.end()
            if name in ("script", "style"):
                return "", "", "", len(page)
            self.unclosed.add(name)
        return "open", name, attributes, end


def _names(name: str, attributes: str, inside: bool) -> frozenset[str]:
    """Names that an element gives to what it holds; inside an article or main element each has a second one that says so."""
    names = {f"<{name}>"} if name in NAMED else set()
    for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
        names.update(w.lower() for w in _WORDS.findall(m[1] or m[2] or m[3] or ""))
    return frozenset(names.union(f"in:{x}" for x in names) if inside else names)


class Page:
    """Tags and texts of a page in order, with what is known around each text.

    ``items``: (kind, name or text, element number, block number).
    """

    def __init__(self, page: str) -> None:
        self.items: list[tuple[str, str, int, int]] = []
        self.names: list[frozenset[str]] = [frozenset()]
        self.parent = [0]
        stack, blocks, places = [("", 0, False)], [], {}  # (name, element number, inside an article); places of blocks and of names in it
        block = 0

        def pop(to: int) -> None:
            while len(stack) > to:
                name = stack.pop()[0]
                places[name].pop()
                if name in BLOCK:
                    blocks.pop()

        for kind, what, attributes in _Events(page):
            if kind == "open":
                if blocks and (stack[blocks[-1]][0] in SIBLINGS.get(what, ()) or (what in BLOCK and stack[blocks[-1]][0] == "p")):
                    pop(blocks[-1])
                inside = stack[-1][2]
                names = _names(what, attributes, inside)
                number = stack[-1][1]
                if names and what not in ("html", "body"):  # class words of a whole page say nothing
                    self.names.append(names)
                    self.parent.append(number)
                    number = len(self.names) - 1
                if what not in VOID:
                    places.setdefault(what, []).append(len(stack))
                    if what in BLOCK:
                        blocks.append(len(stack))
                    stack.append((what, number, inside or what in ("article", "main")))
            elif kind == "close" and places.get(what):
                to = places[what][-1]
                if what in BLOCK or not blocks or to > blocks[-1]:
                    pop(to)
            if kind in ("open", "close"):
                block += what in BLOCK
            self.items.append((kind, what, stack[-1][1], block))

    def texts(self) -> list[tuple[int, int, frozenset[str]]]:
        """(item, words, names) of each text; names of its surroundings, its block's length and linked share among them."""
        count = np.zeros(len(self.names), np.int64)
        of_block, linked = Counter(), Counter()
        found = []
        for k, (kind, what, element, block) in enumerate(self.items):
            if kind == "text" and (n := len(what.split())):
                count[element] += n
                of_block[block] += n
                found.append((k, n, element, block))
        for e in range(len(count) - 1, 0, -1):  # parents come before their children
            count[self.parent[e]] += count[e]
        around: list[frozenset[str]] = [frozenset()]
        for e in range(1, len(self.names)):
            # names around nearly all words of the page say nothing about them
            own = self.names[e] if count[e] < WRAPPER * count[0] or "<article>" in self.names[e] or "<main>" in self.names[e] else frozenset(n for n in self.names[e] if n == "<a>")
            around.append(around[self.parent[e]] | own if own - around[self.parent[e]] else around[self.parent[e]])
        for _, n, element, block in found:
            if "<a>" in around[element]:
                linked[block] += n
        out = []
        for k, n, element, block in found:
            length, share = of_block[block], linked[block] / of_block[block]
            shape = ("#short" if length <= 3 else "#line" if length <= 10 else "#lines" if length <= 25 else "#long", "#free" if not share else "#some" if share < 0.5 else "#linked")
            inside = "<article>" in around[element] or "<main>" in around[element]
            out.append((k, n, around[element].union(shape, (f"in:{x}" for x in shape if inside))))
        return out


def labelled_pages(n: int = 300, seed: int = 11) -> Iterator[str]:
    """Pages drawn by a seeded rule; what belongs to the main text stands between ``<!--main-->`` and ``<!--/main-->``."""
    rng = np.random.default_rng(seed)
    chance = lambda p: rng.random() < p
    one = lambda xs: xs[rng.integers(len(xs))]
    some = lambda lo, hi: int(rng.integers(lo, hi + 1))
    text = lambda lo, hi: " ".join(["word"] * some(lo, hi))
    link = lambda lo, hi: f'<a href="#">{text(lo, hi)}</a>'
    unknown = lambda: "".join(one("bcdfgklmnprst") + one("aeiou") for _ in range(3))

    def name(word: str) -> str:
        form = some(0, 5)
        return word if form < 3 else f"{one(DECORATION[0])}-{word}" if form == 3 else f"{word}-{one(DECORATION[1])}" if form == 4 else f"{one(DECORATION[0])}{word.title()}"

    def around(inner: str, words: str, tags: tuple[str, ...] = (), plain: tuple[str, ...] = ("div", "div", "section"), blind: float = 0.1) -> str:
        tag = one(tags) if tags and chance(0.4) else one(plain)
        if chance(blind) and tag not in tags:
            shown = f' class="{unknown()}"' if chance(0.5) else ""
        elif tag in tags and chance(0.5):
            shown = ""
        else:
            shown = f' {one(("class", "class", "class", "id"))}="{name(one(words.split()))}{f" {unknown()}" if chance(0.2) else ""}"'
        return f"<{tag}{shown}>{inner}</{tag}>"

    def part(kind: str, blind: float = 0.05) -> str:
        tags, words = PARTS[kind]
        links = lambda lo, hi: "".join(f"<li>{link(1, 3)}</li>" for _ in range(some(lo, hi)))
        inner = {
            "nav": lambda: f"<ul>{links(2, 8)}</ul>" if chance(0.7) else " ".join(link(1, 2) for _ in range(some(2, 6))),
            "header": lambda: one((f"<h1>{text(1, 4)}</h1>", f"<p>{text(1, 8)}</p>", link(1, 3), text(1, 5))),
            "footer": lambda: f"<p>{text(3, 20)}</p>" + (" ".join(link(1, 2) for _ in range(some(1, 5))) if chance(0.6) else "") if chance(0.6) else text(3, 15),
            "sidebar": lambda: f"<h3>{text(1, 2)}</h3>" + (f"<ul>{links(2, 6)}</ul>" if chance(0.7) else f"<p>{text(5, 40)}</p>"),
            "ad": lambda: one((text(3, 14), f"<p>{text(4, 25)}</p>", link(3, 9), f"{text(2, 8)} {link(1, 3)}")),
            "notice": lambda: f"<p>{text(4, 30)}</p>" + ("<button>word</button>" if chance(0.5) else "") if chance(0.7) else text(4, 20),
            "share": lambda: " ".join(link(1, 2) for _ in range(some(1, 4))) if chance(0.7) else text(1, 6),
            "form": lambda: f"<label>{text(1, 3)}</label><input><button>{text(1, 2)}</button>" + (f"<p>{text(3, 12)}</p>" if chance(0.3) else ""),
            "comments": lambda: f"<h3>{text(1, 2)}</h3>" + "".join(around(f"<p>{text(3, 70)}</p>", "comment reply user", ("article",), ("div", "li"), 0.3) for _ in range(some(1, 5))),
        }[kind]()
        return around(inner, words, tags, ("div", "div", "section", "p") if kind in ("ad", "notice") and "<" not in inner else ("div", "div", "section"), blind)

    def block() -> str:
        form = some(0, 13)
        if form < 7:
            return f"<p>{text(6, 80)}{f' {link(1, 4)} {text(1, 20)}' if chance(0.3) else ''}</p>"
        if form == 7:
            return f"<h{some(2, 4)}>{text(1, 7)}</h2>"
        if form == 8:
            linked = one((0, 0.2, 1))
            return "<ul>" + "".join(f"<li>{link(1, 5) if chance(linked) else text(1, 15)}</li>" for _ in range(some(2, 6))) + "</ul>"
        if form == 9:
            return f"<blockquote>{text(5, 40)}</blockquote>"
        if form == 10:
            return "<table>" + "".join(f"<tr><td>{text(1, 3)}</td><td>{text(1, 4)}</td></tr>" for _ in range(some(1, 4))) + "</table>"
        if form == 11:
            return f"<figure><img><figcaption>{text(3, 12)}</figcaption></figure>"
        return f"<p>{text(1, 8)}</p>" if form == 12 else f"{text(5, 40)}<br>{text(3, 30)}"

    for _ in range(n):
        bare = chance(0.15)
        head = f"<h1>{text(1, 8)}</h1>" if chance(0.8) else ""
        if head and chance(0.25):
            head = f"<header>{head}<p>{text(1, 12)}</p></header>"
        body = [block() for _ in range(some(1, 12))]
        if chance(0.08):  # an article that is a list of links
            body = [f"<ul>{''.join(f'<li>{link(1, 5)}</li>' for _ in range(some(3, 9)))}</ul>"]
        for at in sorted(rng.integers(0, len(body) + 1, some(0, 2)).tolist(), reverse=True) if not bare and chance(0.5) else ():
            body.insert(at, f"<!--/main-->{part(one(('ad', 'ad', 'share', 'sidebar', 'notice', 'form')), 0.0)}<!--main-->")
        if bare:  # a page of text alone
            yield f"<html><body><!--main-->{''.join(body)}<!--/main--></body></html>"
            continue
        main = around(f"<!--main-->{head}{''.join(body)}<!--/main-->" + "".join(part(one(("share", "sidebar", "ad"))) for _ in range(some(0, 1))), CONTENT, ("article", "article", "main"), blind=0.3)
        before = [part(k) for k in ("notice", "header", "nav", "ad", "sidebar", "form") if chance(0.4)] + [part("nav")] * chance(0.4)
        after = [part(k) for k in ("share", "comments", "sidebar", "ad", "form", "notice") if chance(0.35)]
        if chance(0.3):  # comments and the like beside the article
            main = around(main + "".join(after), CONTENT + " wrapper container row column", ("main",), blind=0.3)
            after = []
        page = "".join([*before, main, *after]) + (part("footer") if chance(0.8) else "")
        if chance(0.5):
            every = [w for _, words in PARTS.values() for w in words.split()]
            page = f'<div class="{one(("wrapper", "container", "site", unknown(), name(one(every))))}">{page}</div>'
        yield f"<html><head><title>{text(1, 6)}</title></head><body>{page}</body></html>"


@functools.cache
def weights() -> tuple[dict[str, float], float, dict[str, float]]:
    """(weight by name, offset, cost by tag) learned from the labelled pages."""
    rows, labels, sizes, tags = [], [], [], {}
    pages: Counter = Counter()
    for page in labelled_pages():
        parsed, seen = Page(page), set()
        inside = np.zeros(len(parsed.items), bool)
        now = False
        for k, (kind, what, _, _) in enumerate(parsed.items):
            if kind == "mark":
                now = what == "main"
            elif kind in ("open", "close"):
                tags.setdefault(what, [1, 1])[now] += 1
            inside[k] = now
        for k, n, names in parsed.texts():
            rows.append(names)
            seen |= names
            labels.append(inside[k])
            sizes.append(min(n, 10))
        pages.update(seen)
    known = sorted(n for n, c in pages.items() if c >= 4)
    place = {n: i for i, n in enumerate(known)}
    x = np.zeros((len(rows), len(known) + 1))
    x[:, -1] = 1
    for k, names in enumerate(rows):
        x[k, [place[n] for n in names if n in place]] = 1
    y, beta, size = np.array(labels, float), np.zeros(len(known) + 1), np.sqrt(np.array(sizes, float))
    for _ in range(8):  # Newton's steps of a penalised logistic regression
        p = 1 / (1 + np.exp(-x @ beta))
        gradient = x.T @ (size * (y - p)) - beta
        beta += np.linalg.solve((x * (size * (p * (1 - p) + 1e-6))[:, None]).T @ x + np.eye(len(beta)), gradient)
    cost = {t: -0.1 * out / (out + here) for t, (out, here) in tags.items()}  # how seldom it stands in an article
    return dict(zip(known, beta[:-1].tolist(), strict=True)), float(beta[-1]), cost


def best_region(scores: list[float], gap: float = GAP) -> list[tuple[int, int]]:
    """The stretches of the region of the highest sum: one scan keeps the best sum that ends inside the region and inside a gap."""
    inside, out = float("-inf"), float("-inf")
    begun, paused, best, at = [], [], 0.0, -1  # begun: stretch starts where it does; paused: the gap starts there
    for k, s in enumerate(scores):
        paused.append(inside - gap > out)
        out = max(out, inside - gap)
        begun.append(2 if max(inside, 0.0) < out else 1 if inside <= 0 else 0)
        inside = max(inside, 0.0, out) + s
        if inside > best:
            best, at = inside, k
    found = []
    while at >= 0:
        end = at
        while begun[at] == 0:
            at -= 1
        found.append((at, end + 1))
        if begun[at] == 1:
            break
        while not paused[at]:
            at -= 1
        at -= 1
    return found[::-1]


def main_text(page: str | None, model: tuple[dict[str, float], float, dict[str, float]] | None = None) -> str:
    if not page:
        return ""
    known, offset, cost = model or weights()
    parsed = Page(page)
    scores = [cost.get(what, -0.05) if kind in ("open", "close") else 0.0 for kind, what, _, _ in parsed.items]
    memo: dict[frozenset[str], float] = {}
    for k, n, names in parsed.texts():
        if names not in memo:
            memo[names] = min(HIGH, max(LOW, offset + sum(known.get(x, 0.0) for x in names)))
        scores[k] = n * memo[names]
    blocks: dict[int, list[str]] = {}
    for low, high in best_region(scores):
        for kind, what, _, block in parsed.items[low:high]:
            if kind == "text" or what == "br":
                blocks.setdefault(block, []).append(what if kind == "text" else " ")
    joined = (" ".join(html.unescape("".join(parts)).split()) for parts in blocks.values())
    return "\n".join(x for x in joined if x)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a page: id, url, text, n_chars (code points). One pass, no shuffle."""
    bound_batches(pages.sparkSession)
    model = weights()

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for whole in rows:
            for batch in small_batches(whole, "html"):
                texts = [main_text(x.as_py(), model) for x in batch.column("html")]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["id", "url", "text", "n_chars"])

    types = {c: pages.schema[n].dataType.simpleString() for c, n in (("id", id_col), ("url", url_col))}
    out = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return out.mapInArrow(batches, f"id {types['id']}, url {types['url']}, text string, n_chars long").withColumnRenamed("id", id_col)
