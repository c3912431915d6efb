"""Main text of web pages as the maximum-scoring run of words and tags.

A page becomes a sequence of blocks of words and of tags. A tag scores negative, a word of a
block what the block's features say: the elements it stands in (nav, aside, article, ...), the
class, id and role names of those elements, the share of its words in links, its length, its
own tag. Both weights come from labelled pages: tags by counts, words by a logistic regression.
One linear scan finds the run with the greatest sum. The blocks of that run whose own words
score positive are the text; no name and no element hides its content by itself, except what
a browser doesn't show as text (scripts, styles, form controls, hidden elements).

Names count as whole class tokens, and by their first and last part (``post-content``). Names
of elements around the outermost article are features of their own for what is in it.
``has-``, ``no-`` and the like speak of other elements and are left out.

The reader makes one pass over a page, whatever its faults: tags without an end, quotes without
an end, elements that are never closed, end tags of nothing. Labelled pages are made by
:func:`labelled_pages` from templates; anybody who has real ones passes those to :func:`fit`.

Character references are decoded, white space inside a block becomes one space, and blocks are
joined by one space.

Defined cases: a null, empty or tag-only page has an empty text; where no word scores positive, the
scan goes over sentences without links that stand in no telling element; pages of any length are read
whole; of runs with equal sums the first counts; equal rows give equal rows; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAINING_PAGES = 2000
MARK = ""

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose content holds no tags, and elements whose content a browser doesn't show as text.
_RAW = frozenset("script style xmp title textarea iframe noembed noframes".split())
_UNSEEN = frozenset("noscript template svg math canvas object audio video select datalist button".split())
#: Elements that say what their content is.
_TELLING = frozenset("nav aside header footer main article section form fieldset menu dialog address figure figcaption blockquote table li dl pre details summary".split())
#: Open elements that end when one of these begins.
_ENDS = {"li": ("li",), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tbody": ("td", "th", "tr", "thead", "tbody"), "tfoot": ("td", "th", "tr", "tbody")}
_CELLS = frozenset("td th caption".split())
_TABLE = frozenset("table thead tbody tfoot tr td th caption".split())

_TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"[\s/]*([^\s/>=]+|=)")
_SIGN = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_GAP = re.compile(r"[\s/]*")
_STATE = re.compile(r"(?:has|have|with|without|no|not|is|show|hide)[-_]")
_HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in _RAW}


def name_features(value: str) -> list[str]:
    """Features of a class, id or role value."""
    out = []
    for token in value.lower().split()[:16]:
        if _STATE.match(token):
            continue
        parts = [p for p in re.split(r"[-_:\d]+", token) if p]
        if parts:
            out.append(f"name:{token}")
            out.append(f"last:{parts[-1]}")
            if len(parts) > 1:
                out.append(f"first:{parts[0]}")
    return out


class Page:
    """``tokens`` of a page in order: the number of a block, or the name of a tag. ``blocks`` are
    (text, words, features)."""

    def __init__(self, source: str, known: dict | None = None):
        self.tokens: list[int | str] = []
        self.blocks: list[tuple[str, int, list[str]]] = []
        self._known = known
        self._text: list[str] = []
        self._linked: list[str] = []
        self._pending: list[str] = []
        #: Open block elements: [tag, features, names put aside, unseen, open links, article].
        self._stack: list[list] = [["", (), None, False, 0, False]]
        self._names: Counter = Counter()
        self._scopes = [Counter()]  # open block elements by tag, for each table cell around
        self._articles = self._unseen = 0
        self._links: list[list] = []  # the stack's entry of each open link
        self._source = source
        self._last = {q: source.rfind(q) for q in "\"'"}
        self._gone: set[str] = set()
        self._read()
        self._block()

    # ---- reading ------------------------------------------------------------------------

    def _read(self) -> None:
        source, at, end = self._source, 0, len(self._source)
        while at < end:
            lt = source.find("<", at)
            if lt < 0:
                self._add(source[at:])
                return
            if lt > at:
                self._add(source[at:lt])
            after = source[lt + 1 : lt + 2]
            if after == "!" and source.startswith("--", lt + 2):
                close = source.find("-->", lt + 4)
                at = close + 3 if close >= 0 else end
            elif after in ("!", "?"):
                at = source.find(">", lt) + 1 or end
            elif after == "/" and source[lt + 2 : lt + 3].isalpha():
                name = _TAG_NAME.match(source, lt + 2)
                at = source.find(">", name.end()) + 1 or end
                self._close(name.group().lower())
            elif after.isalpha() and after.isascii():
                at = self._start(lt)
            else:
                self._add("<")
                at = lt + 1

    def _start(self, lt: int) -> int:
        source, end = self._source, len(self._source)
        name = _TAG_NAME.match(source, lt + 1)
        tag, at = name.group().lower(), name.end()
        attrs: dict[str, str] = {}
        slash = False
        while True:
            gap = _GAP.match(source, at)
            at, slash = gap.end(), gap.group().endswith("/")
            if at >= end:
                return end
            if source[at] == ">":
                break
            m = _ATTR.match(source, at)
            key, at, value = m.group(1).lower(), m.end(), ""
            if sign := _SIGN.match(source, at):
                at = sign.end()
                quote = source[at : at + 1]
                if quote in ("'", '"') and self._last[quote] > at:
                    close = source.find(quote, at + 1)
                    value, at = source[at + 1 : close], close + 1
                else:
                    bare = _BARE.match(source, at)
                    value, at = bare.group(), bare.end()
            if len(attrs) < 64:
                attrs.setdefault(key, value)
        self._open(tag, attrs, slash)
        at += 1
        if tag in _RAW and not (slash and tag == "iframe") and tag not in self._gone:
            close = _RAW_END[tag].search(source, at)
            if close:
                return source.find(">", close.end() - 1) + 1 or end
            self._gone.add(tag)
            if tag in ("script", "style", "xmp"):
                return end
        return at

    # ---- elements -----------------------------------------------------------------------

    def _open(self, tag: str, attrs: dict[str, str], slash: bool) -> None:
        if tag == "br":
            self._text.append(" ")
            self._pending.append("br")
            return
        if tag in _RAW:
            if tag not in ("title", "textarea"):
                self._pending.append(tag)
            return
        hidden = "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "style" in attrs and bool(_HIDING.search(attrs["style"]))
        if tag in _INLINE and not (hidden and tag not in _VOID):
            self._pending.append(tag)
            if tag == "a":
                self._end_link()  # links don't nest
                self._links.append(self._stack[-1])
                self._stack[-1][4] += 1
            return
        self._block()
        self._tag(tag)
        while self._stack[-1][0] == "p" or self._stack[-1][0] in _ENDS.get(tag, ()):
            self._pop()
        if tag in _VOID or slash and self._unseen or slash and tag in _UNSEEN:
            return
        features, aside = [], None
        if tag in _TELLING:
            features.append(f"in:{'article ' if self._articles else ''}{tag}")
        role = attrs.get("role", "").strip().lower()
        article = tag in ("article", "main") or role in ("article", "main") or attrs.get("itemprop", "").lower() == "articlebody"
        if article and not self._articles:
            above = {k if k.startswith(("in:", "role:")) else f"above {k}": v for k, v in self._names.items()}
            aside, self._names = self._names, Counter({k: v for k, v in above.items() if self._known is None or k in self._known})
            features.append("in:article")
        elif tag not in ("html", "body"):
            if role:
                features.append(f"role:{role}")
            features += name_features(f"{attrs.get('class', '')} {attrs.get('id', '')}")
        if self._known is not None:
            features = [f for f in features if f in self._known]
        self._names.update(features)
        self._articles += article
        unseen = tag in _UNSEEN or hidden
        self._unseen += unseen
        self._stack.append([tag, features, aside, unseen, 0, article])
        self._scopes[-1][tag] += 1
        if tag in _CELLS:
            self._scopes.append(Counter())

    def _pop(self) -> str:
        tag, features, aside, unseen, links, article = self._stack.pop()
        del self._links[len(self._links) - links :]
        if tag in _CELLS:
            self._scopes.pop()
        self._scopes[-1][tag] -= 1
        for f in features:
            if self._names[f] > 1:
                self._names[f] -= 1
            else:
                del self._names[f]
        if aside is not None:
            self._names = aside
        self._articles -= article
        self._unseen -= unseen
        return tag

    def _close(self, tag: str) -> None:
        if tag in _INLINE:
            self._pending.append(tag)
            if tag == "a":
                self._end_link()
            return
        if tag == "br":
            self._text.append(" ")
            return
        self._block()
        self._tag(tag)
        depth = len(self._scopes)
        if tag in _TABLE:
            while depth and not self._scopes[depth - 1][tag]:
                depth -= 1
        elif not self._scopes[-1][tag]:
            depth = 0
        if depth:
            while self._pop() != tag:
                pass

    def _end_link(self) -> None:
        if self._links:
            self._links.pop()[4] -= 1

    # ---- blocks -------------------------------------------------------------------------

    def _add(self, text: str) -> None:
        if self._unseen:
            return
        text = entities.unescape(text) if "&" in text else text
        self._text.append(text)
        if self._links:
            self._linked.append(text)

    def _tag(self, name: str) -> None:
        self.tokens.append(name)

    def _block(self) -> None:
        words = "".join(self._text).split() if self._text else []
        self.tokens += self._pending
        if words:
            n, linked = len(words), sum(len(x.split()) for x in self._linked)
            features = [*self._names, f"tag:{self._stack[-1][0]}", f"long:{min(int(math.log2(n)), 7)}", f"links:{min(4, -(-4 * linked // n))}", f"end:{words[-1][-1] in '.!?:'}"]
            if not self._articles:
                features.append("no article")
            if "\xa9" in words[0] or any(w.lower() == "copyright" for w in words[:3]):
                features.append("copyright")
            self.tokens.append(len(self.blocks))
            self.blocks.append((" ".join(words), n, features))
        self._text, self._linked, self._pending = [], [], []


def best_run(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the run with the greatest positive sum; the first of equal ones."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, found = total, (start, i + 1)
    return found


#: What a word outside the text costs, as a share of what one inside gives: a little, so that
#: an advert doesn't part a heading from its text.
OUTSIDE = 0.1
#: What the log-odds of tags are divided by, so that a list of short items isn't cut off.
TAGS = 10


def word_score(features: list[str], weights: dict[str, float]) -> float:
    """The score of one word of a block, between -OUTSIDE and 1."""
    score = math.tanh(sum(weights.get(f, 0.0) for f in features) / 2)
    return score if score > 0 else OUTSIDE * score


#: Features of a block's own words; the others say where it stands.
OWN = ("long:", "links:", "end:")
FURNITURE = frozenset("in:nav in:footer in:aside in:menu in:dialog copyright".split())


def plain_score(features: list[str], weights: dict[str, float]) -> float:
    """The score of one word of a block on a page where nothing scores positive: sentences speak for
    the text, links and what furniture is called against it. Other elements don't count."""
    around = sum(min(0.0, weights.get(f, 0.0)) for f in features if f.startswith(("name:", "first:", "last:", "role:")) or f in FURNITURE)
    sentence = "links:0" in features and ("end:True" in features or any(f"long:{n}" in features for n in (3, 4, 5, 6, 7)))
    return 1.0 if sentence and around > -1 else -OUTSIDE


def chosen(page: Page, each: list[float], weights: dict[str, float]) -> list[int]:
    """The blocks of the best run whose own words score positive, and between or beside those the
    ones without links that stand in the same place, such as the short items of a list."""
    scores = [weights.get(f"<{t}", weights["<"]) if isinstance(t, str) else each[t] * page.blocks[t][1] for t in page.tokens]
    start, end = best_run(scores)
    run = [t for t in page.tokens[start:end] if not isinstance(t, str)]
    place = [tuple(f for f in page.blocks[t][2] if not f.startswith(OWN)) for t in run]
    good = [each[t] > 0 for t in run]
    like = lambda i, j: 0 <= j < len(run) and good[j] and place[i] == place[j]
    return [t for i, t in enumerate(run) if good[i] or "links:0" in page.blocks[t][2] and (like(i, i - 1) or like(i, i + 1))]


def extract(source: str | None, weights: dict[str, float]) -> str:
    page = Page(source or "", weights)
    found = chosen(page, [word_score(f, weights) for _, _, f in page.blocks], weights)
    found = found or chosen(page, [plain_score(f, weights) for _, _, f in page.blocks], weights)
    return " ".join(page.blocks[t][0] for t in found)


def fit(pages: Iterable[str], steps: int = 500, rate: float = 0.5, l2: float = 1e-5) -> dict[str, float]:
    """Weights from labelled pages, in which the words of the main text begin with MARK: those
    of features by gradient steps on the logistic loss of blocks, those of tags by counts
    within and outside the main text, below zero."""
    import numpy as np

    rows, truth, inside, outside = [], [], Counter(), Counter()
    for source in pages:
        page = Page(source)
        marked = [MARK in text for text, _, _ in page.blocks]
        at = [i for i, t in enumerate(page.tokens) if not isinstance(t, str) and marked[t]]
        first, last = (at[0], at[-1]) if at else (0, -1)
        for i, t in enumerate(page.tokens):
            if isinstance(t, str):
                (inside if first <= i <= last else outside)[t] += 1
        rows += [f for _, _, f in page.blocks]
        truth += marked
    seen = Counter(f for r in rows for f in r)
    index = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= 3))}
    of = np.array([k for k, r in enumerate(rows) for f in r if f in index])
    col = np.array([index[f] for r in rows for f in r if f in index])
    y, w, bias, sums = np.array(truth, float), np.zeros(len(index)), 0.0, np.full(len(index), 1e-6)
    for _ in range(steps):
        z = bias + np.bincount(of, w[col], len(rows))
        miss = (y - 1 / (1 + np.exp(-z))) / len(rows)
        grad = np.bincount(col, miss[of], len(index)) - l2 * w
        sums += grad**2
        w += rate * grad / np.sqrt(sums)
        bias += miss.sum()
    a, b = sum(inside.values()) + 1, sum(outside.values()) + 1
    tags = {f"<{t}": min(-0.05, math.log((inside[t] + 1) / a) - math.log((outside[t] + 1) / b)) / TAGS for t in {*inside, *outside}}
    # each block has one length, so the bias goes there
    return {f: float(w[i] + (bias if f.startswith("long:") else 0.0)) for f, i in index.items()} | tags | {"<": -0.1}


#: Names that sites give to what stands around a text, and to what holds it; for labelled pages.
AROUND = (
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side aside rail footer foot colophon masthead topbar toolbar ad ads advert advertisement adsense sponsor sponsored promo promotion "
    "banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login search form comment comments disqus discussion replies reply respond responses "
    "social share sharing related recommended recommendations trending popular widget widgets pagination pager copyright legal disclaimer skip tags toc teaser hero cta"
).split()
HOLDING = "content post entry article main story body text page wrapper container prose column inner primary single blog news document detail".split()


def labelled_pages(n: int = TRAINING_PAGES, seed: int = 7) -> Iterator[str]:
    """Pages of several layouts whose main text is marked."""
    rng = random.Random(seed)
    syllables = [a + b for a in "b d f k l m n p r s t v".split() for b in "a e i o u".split()]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    some = lambda k, mark="": " ".join(mark + word() for _ in range(k))
    dot = lambda: rng.choice([".", ".", ".", "", "!", ":"])
    says = lambda k: some(k) + dot()
    main = lambda k: some(k, MARK) + dot()
    links = lambda k: "".join(f'<li><a href="/{word()}">{some(rng.randint(1, 4))}</a></li>' for _ in range(k))
    chance = lambda p: rng.random() < p

    def around(*like: str) -> str:
        """A class or id attribute of something around the text."""
        base = rng.choice(like or AROUND)
        name = rng.choice([base, base, f"{rng.choice(['site', 'page', 'main', 'top', 'post', 'entry', 'js', 'c'])}-{base}", f"{base}-{rng.choice(['list', 'box', 'area', 'wrapper', 'inner', 'section', 'block', 'item', 'container', 'slot', 'bar', 'links', 'posts', 'form', 'widget'])}", f"{base}_{rng.randint(1, 9)}", f"{word()} {base}"])
        return f' {rng.choice(["class", "class", "id"])}="{name}"'

    def holding() -> str:
        base = rng.choice(HOLDING)
        name = rng.choice([base, f"{rng.choice(HOLDING)}-{base}", f"{base} {word()}", f"{word()}-{base}", f"{base} {rng.choice(['has', 'with', 'no'])}-{rng.choice(AROUND)}", f"{rng.choice(AROUND)}-{rng.choice(['page', 'layout', 'view', 'template', 'result-page'])}", word()])
        return f' {rng.choice(["class", "class", "id"])}="{name}"'

    def paragraph() -> str:
        text = main(rng.choice([rng.randint(2, 12), rng.randint(8, 90)]))
        if chance(0.3):
            text += f" <a href='/x'>{some(3, MARK)}</a> <b>{main(2)}</b>"
        if manner:
            return manner(text)
        kind = rng.random()
        if kind < 0.8:
            return f"<p{holding() if chance(0.05) else ''}>{text}</p>"
        if kind < 0.9:
            return f"<p><b>{text}<br>"
        return rng.choice([f"<blockquote><p>{text}</p></blockquote>", f"<pre>{text}</pre>", f"<figure><img src=x><figcaption>{text}</figcaption></figure>", f"<div>{text}</div>", f"<p><a href=/x>{some(4, MARK)}</a></p>"])

    def rich() -> str:
        return rng.choice([
            f"<h2>{main(3)}</h2>", f"<h3{holding() if chance(0.3) else ''}>{some(rng.randint(1, 6), MARK)}</h3>", "<ul>" + "".join(f"<li>{main(rng.randint(1, 14))}" for _ in range(3)) + "</ul>", "<ol>" + "".join(f"<li><a href=/r>{some(rng.randint(2, 6), MARK)}</a></li>" for _ in range(3)) + "</ol>",
            "<table>" + "".join(f"<tr><td>{some(1, MARK)}</td><td>{some(2, MARK)}</td></tr>" for _ in range(3)) + "</table>", f"<dl><dt>{some(1, MARK)}<dd>{main(6)}</dl>", f"<section><h2>{some(2, MARK)}</h2>{paragraph()}</section>",
        ])

    def intruder(named: bool) -> str:
        """Something that stands within the text without being of it."""
        body = rng.choice([says(rng.randint(1, 20)), f"<p>{says(rng.randint(3, 25))}</p>", f"<ul>{links(3)}</ul>", f"<a href=/s>{some(2)}</a>", f"<h3>{some(2)}</h3><ul>{links(rng.randint(2, 4))}</ul>", f"<p>{says(8)}</p><form><input name=m><button>{word()}</button></form>"])
        tag = rng.choice(["div", "div", "section"])
        return f"<{tag}{around(*(('ad', 'ads', 'advert', 'sponsored', 'promo', 'related', 'share', 'newsletter') if chance(0.5) else ()))}>{body}</{tag}>" if named and chance(0.75) else rng.choice([f"<aside>{body}</aside>", f"<nav>{body}</nav>", f"<form>{body}</form>", f"<footer>{body}</footer>"])

    def reader(tag: str) -> str:
        name = f' class="{rng.choice(["comment", "comment-body", "reply", word()])}"' if chance(0.6) else ""
        return f"<{tag}{name}><p>{says(rng.randint(2, 60))}</p></{tag}>"

    def comments() -> str:
        tag = rng.choice(["div", "article", "li", "p"])
        inner = f"<h3>{some(rng.randint(1, 3))}</h3>" + "".join(reader(tag) for _ in range(rng.randint(1, 6)))
        return f"<{rng.choice(['section', 'div'])}{around('comments', 'comment', 'disqus', 'discussion', 'replies', 'respond', 'responses')}>{inner}</section></div>"

    #: How a site without paragraphs writes its text.
    manners = [
        lambda t: f"<div>{t}</div>", lambda t: f"<div><span>{t}</span></div>", lambda t: f'<div class="{word()}">{t}</div>', lambda t: f"<div><div>{t}</div></div>", lambda t: f"{t}<br><br>", lambda t: f"<section>{t}</section>",
        lambda t: f"<tr><td>{t}</td></tr>", lambda t: f"<center>{t}</center>",
    ]
    manner = None
    for _ in range(n):
        layout = rng.randrange(5)
        named = layout != 4
        manner = rng.choice(manners) if chance(0.3) else None
        parts = [f"<h1>{some(rng.randint(1, 9), MARK)}</h1>"] + [paragraph() if chance(0.8) else rich() for _ in range(rng.randint(1, 14))]
        if layout < 4:
            for _ in range(rng.choice([0, 0, 1, 2])):
                parts.insert(rng.randint(1, len(parts)), intruder(named))
        body = "".join(parts)
        if layout == 0 and chance(0.4):
            body = f"<header>{main(4)}<p>{main(5)}</p></header>{body}"
        talk = comments() if named and chance(0.5) else ""
        inside = bool(talk) and chance(0.3)
        body += talk if inside else ""
        holder = (f"<article{holding() if chance(0.4) else ''}>{body}</article>", f"<div{holding()}>{body}</div>", f"<main{holding() if chance(0.3) else ''}>{body}</main>", f"<div{holding()}><article>{body}</article></div>", f"<div>{body}</div>")[layout]
        if manner is manners[6]:
            holder = f"<table>{holder}</table>" if chance(0.5) else f"<table><tr><td>{holder}</td></tr></table>"
        nav = rng.choice([f"<nav><ul>{links(6)}</ul></nav>", f"<div{around('nav', 'menu', 'navbar', 'navigation', 'menubar') if named else ''}><ul>{links(6)}</ul></div>"])
        extra = [
            f"<div{around('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'banner')}>{says(rng.randint(2, 30))}</div>", f"<aside><h3>{some(2)}</h3><ul>{links(4)}</ul><p>{says(12)}</p></aside>",
            f"<div{around('cookie', 'cookies', 'consent', 'notice', 'gdpr', 'popup', 'modal')}><p>{says(rng.randint(5, 40))}</p><button>{word()}</button></div>", f"<form><label>{some(2)}</label><input name=q><p>{says(6)}</p></form>", f"<div{around()}><p>{says(rng.randint(2, 40))}</p></div>",
            f'<div role="{rng.choice(["navigation", "banner", "complementary", "contentinfo", "search", "dialog", "alert", "form"])}">{says(9)}</div>',
        ] if named else [f"<div><ul>{links(5)}</ul></div>"]
        extra = rng.sample(extra, rng.randint(1, min(3, len(extra))))
        foot = rng.choice([f"<footer>&copy; {says(rng.randint(2, 20))}</footer>", f"<div{around('footer', 'foot', 'copyright', 'legal', 'colophon')}>{says(8)}<ul>{links(3)}</ul></div>" if named else f"<footer>{says(6)}</footer>", *[f"<{rng.choice(['div', 'p', 'center'])}>{rng.choice(['&copy;', 'Copyright', 'Copyright &copy;'])} {some(rng.randint(1, 5))}</div>"] * 2])
        cut = rng.randint(0, len(extra))
        head = f"<head><title>{some(5)}</title></head>" if chance(0.8) else f"<title>{some(5)}</title>"
        top = rng.choice(["", f"<header><p>{some(3)}</p></header>", f"<div{around('header', 'masthead', 'topbar')}>{some(2)}</div>" if named else ""])
        whole = f"{top}{nav}{''.join(extra[:cut])}{holder}{'' if inside else talk}{''.join(extra[cut:])}{foot}"
        if chance(0.12):  # sites that put the whole page into one form
            whole = f'<form{rng.choice(["", " id=form1", " method=post"])}>{whole}</form>'
        elif chance(0.05):  # old sites: a row of a table for each part
            whole = f"<table><tr><td colspan=2>{top}{nav}</td></tr><tr><td><a href=/a>{word()}</a> | <a href=/b>{word()}</a> | <a href=/c>{some(2)}</a></td><td>{holder}</td></tr><tr><td>{foot}</td></tr></table>"
        yield f"<html>{head}<body>{whole}</body></html>"


def main_text(pages: DataFrame, weights: dict[str, float] | None = None, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """(id, url, text) of every page. Without weights, those of :func:`labelled_pages` are fitted."""
    w = weights or fit(labelled_pages())

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            text = [extract(h, w) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], ["id", "url", "text"])

    given = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    kind = lambda c: given.schema[c].dataType.simpleString()
    return given.mapInArrow(run, f"id {kind('id')}, url {kind('url')}, text string")
