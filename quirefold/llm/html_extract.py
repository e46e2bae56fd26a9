"""Main text of web pages: boosted trees over DOM nodes, then a decoding that respects the tree.

A tolerant parser builds the node list of a page. Each node has features of itself (tag class, attribute tokens, depth),
its subtree (text, links, density, marks), its siblings and its ancestors. Gradient-boosted trees give the probability
that a node holds main text. The decoding maximises the sum of log probabilities over all nodes under the constraint
that nothing inside a dropped node is kept, by dynamic programming from the leaves up, so an ancestor's and a
descendant's choice cannot contradict each other. Text directly in kept nodes is put out in page order, one block a
line; nothing else is dropped or capped.

No table has labels for nodes, so the trees are fitted on generated pages of known truth (`training_pages`): many
layouts with menus, headers, footers, sidebars, notices, adverts, forms and reader comments around and inside articles.
Their number is a parameter; features are structural, no word of a page's text is one. The fit takes seconds on the
driver, and the trees are broadcast (their size is bounded by their number and depth).

Row-local: no shuffle; a worker holds one Arrow batch. The parser reads a page once: time and memory are in proportion
to its length, whatever is left open or nested in it.

Defined results: null or empty html gives an empty text; text outside any element counts as the body's; unclosed and
stray tags are tolerated (a head ends at what cannot stand in it; svg at a closing slash or, if left open, at the next
HTML element; an open select after its options; an open comment, iframe, noscript or template hides nothing but its own
tag; only script, style, title and textarea run to the end of the page); a `<` that begins no tag is text; formulas
(math) are text; very long pages are read whole; repeated rows are extracted alike; an empty table gives an empty result;
extra columns are not read, whatever their names.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm import boosting
from quirefold.llm.store import prepare

#: Generated pages that the trees are fitted on.
TRAINING_PAGES = 1200
NODES_PER_BATCH = 50_000

# Classes of HTML elements and of words in class, id and role attributes.
VOID = frozenset("area base basefont bgsound br col embed hr img input link meta param source track wbr".split())
TO_END = frozenset("script style textarea title".split())
PAIRED = frozenset("noscript template iframe svg select annotation annotation-xml".split())
INLINE = frozenset(
    (
        "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small strike strong sub sup time tt u var "
        "math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd mspace mpadded mphantom menclose merror mfenced maction semantics"
    ).split()
)
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
P_SCOPE = ("button", "td", "th", "caption", "object")
TAG_GROUPS = [
    "article main", "section", "div", "p", "h1", "h2 h3 h4 h5 h6", "ul ol menu dl", "li dt dd", "nav", "header", "footer", "aside",
    "form fieldset button input", "table tbody thead tr td th", "blockquote pre figure figcaption", "body html", "span",
]
TOKEN_GROUPS = [
    "nav menu navbar navigation breadcrumb breadcrumbs pagination pager tabs toc",
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner doubleclick adsense",
    "footer foot copyright colophon legal",
    "header masthead topbar logo brand",
    "sidebar aside side widget rail secondary complementary",
    "comment comments commentlist reply replies respond disqus discussion",
    "cookie cookies consent gdpr notice alert popup modal overlay banner notification message warning",
    "share sharing social follow related recommended recommendations trending popular tags more newsletter subscribe signup login search form",
    "content article post entry story main body text page maincontent prose hentry",
]
_TAG_GROUP = {t: i for i, g in enumerate(TAG_GROUPS) for t in g.split()}
_TOKEN_GROUP = {}
for _i, _g in enumerate(TOKEN_GROUPS):
    for _t in _g.split():
        _TOKEN_GROUP[_t] = _TOKEN_GROUP.get(_t, 0) | 1 << _i

#: A tag, tried only where a `<` stands: a quote counts right after an equals sign, and only if it is closed somewhere.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=[ \t\n\r\f]*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
#: For what follows a tag that never ends that way: up to the next `>`.
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_END = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*+>", re.I) for n in TO_END}
_EITHER = {n: re.compile(rf"<(/?){n}(?=[\s/>])", re.I) for n in PAIRED}
_AFTER_OPTIONS = re.compile(r"<(?!/?(?:option|optgroup|hr)[\s/>])[a-zA-Z/!]", re.I)
_TOKENS = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
#: A slash at a tag's end that belongs to an unquoted value and so closes nothing.
#: An attribute with its value, quoted or not, or another character.
_ATTRIBUTE = re.compile(r"""[^\s=/]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'][^\s]*))?|[^\s]""")
#: Elements of HTML that end an svg that was left open; what stands in a foreignObject or the like does not.
_BREAKS_OUT = "article|aside|b|big|blockquote|body|br|center|code|dd|div|dl|dt|em|embed|footer|form|h[1-6]|head|header|hr|i|img|li|main|menu|nav|ol|p|pre|ruby|s|section|small|span|strong|strike|sub|sup|table|tt|u|ul|var"
_SVG_END = re.compile(rf"<(foreignobject|annotation-xml|desc|title)(?=[\s/>])|<(?:{_BREAKS_OUT})(?=[\s/>])", re.I)
_MARKS = re.compile(r"[.,;:!?…。、]")
_HIDDEN = re.compile(r"\shidden(?:\s|=|/|$)|display\s*:\s*none", re.I)


def _read_mask(attributes: str) -> int:
    mask = 0
    for found in _TOKENS.findall(attributes):
        for word in _WORD.findall("".join(found).lower()):
            mask |= _TOKEN_GROUP.get(word, 0)
    return mask


_short_mask = lru_cache(maxsize=4096)(_read_mask)


def _attribute_mask(attributes: str) -> int:
    return _short_mask(attributes) if len(attributes) < 200 else _read_mask(attributes)


class _Tags:
    """Matches the tags of a page. Once a tag has no end outside quotes, quotes count no more: no scan runs twice to the
    page's end."""

    def __init__(self, html: str) -> None:
        self.html, self.pattern = html, _TAG

    def match(self, at: int) -> re.Match | None:
        m = self.pattern.match(self.html, at)
        if m is None and self.pattern is _TAG and self.html[at + 1 : at + 2].isalpha():
            self.pattern = _PLAIN_TAG
            m = _PLAIN_TAG.match(self.html, at)
        return m


class _Next:
    """Places of a string, asked for from growing positions: the page is searched once."""

    def __init__(self, find) -> None:
        self.find, self.last = find, -2

    def at(self, start: int) -> int:
        """The next place from start on, or -1."""
        if -1 != self.last < start:
            self.last = self.find(start)
        return self.last


class _Skips:
    """Where the skipped elements of a page end. Each name's tags are matched once, in one pass over the page."""

    def __init__(self, html: str) -> None:
        self.html, self.matched, self.absent, self.last = html, {}, set(), html.rfind(">") + 1
        self.breaks: dict[int, bool] = {}  # place -> whether html goes on there
        self.next_break = _Next(self._find_break)

    def _find_break(self, start: int) -> int:
        m = _SVG_END.search(self.html, start)
        if m:
            self.breaks[m.start()] = not m.group(1)
        return m.start() if m else -1

    def _pairs(self, name: str) -> dict[int, int]:
        """End of an element's start tag -> end of its end tag, for elements that have one."""
        if name not in self.matched:
            pairs, still_open, tags, last = self.matched.setdefault(name, {}), [], _Tags(self.html), 0
            for m in _EITHER[name].finditer(self.html, 0, self.last):
                if m.start() < last:
                    continue
                tag = tags.match(m.start())
                if tag is None:
                    break
                last = tag.end()
                if not m.group(1):
                    if name != "svg" or not _closes_itself(tag.group(3)):
                        still_open.append(last)
                elif still_open:
                    pairs[still_open.pop()] = last
        return self.matched[name]

    def after(self, name: str, at: int) -> int:
        """Where the page goes on after an element whose start tag ends at `at`."""
        if name in TO_END:
            m = None if name in self.absent else _END[name].search(self.html, at, self.last)
            if not m:
                self.absent.add(name)
            return m.end() if m else len(self.html)
        end = self._pairs(name).get(at)
        if name == "svg":
            place = self.next_break.at(at)
            if place >= 0 and self.breaks[place] and (end is None or place < end):
                return place
        if end is None and name == "select":
            m = _AFTER_OPTIONS.search(self.html, at)
            return m.start() if m else len(self.html)
        return at if end is None else end


def _closes_itself(attributes: str) -> bool:
    """Whether the last character is a slash that belongs to no unquoted value."""
    if not attributes.endswith("/"):
        return False
    last = None
    for last in _ATTRIBUTE.finditer(attributes):
        pass
    return last is not None and last.group() == "/"


class Page:
    """Node list of a page in document order; node 0 is the body."""

    #: Per node whether _TRUE is among its attributes, for pages of known truth.
    truth: list[bool] | None = None

    def __init__(self, html: str) -> None:
        self.tag, self.parent, self.mask, self.hidden = ["body"], [-1], [0], [False]
        self.pieces: list[tuple[int, int, str, bool]] = []  # node, block, text, in a link
        self._parse(html)

    def _parse(self, html: str) -> None:
        stack, tags, skips = [0], self.tag, _Skips(html)
        open_at: dict[str, list[int]] = {}  # places on the stack of the open elements of a name
        block = at = began = 0
        link, link_depth, match = False, 0, _Tags(html).match
        tag_end, comment_end = _Next(lambda start: html.find(">", start)), _Next(lambda start: html.find("-->", start))
        pieces = self.pieces

        def close(names: tuple[str, ...], within: tuple[str, ...] = ()) -> None:
            """Close the nearest open element of these names, and what is open in it, unless an element of `within` is nearer."""
            nonlocal block, link
            k = max((open_at[n][-1] for n in names if open_at.get(n)), default=0)
            if not k or any(open_at[n][-1] > k for n in within if open_at.get(n)):
                return
            for node in stack[k:]:
                open_at[tags[node]].pop()
            del stack[k:]
            link = link and link_depth <= k
            block += 1

        def put(end: int) -> None:
            if end > began:
                pieces.append((stack[-1], block, html[began:end], link))

        while True:
            at = html.find("<", at)
            if at < 0:
                put(len(html))
                return
            m = match(at)
            if m is None:
                end = -1
                if html.startswith(("!", "?", "/"), at + 1):
                    if html.startswith("<!--", at) and not html.startswith(("<!-->", "<!--->"), at):
                        end = comment_end.at(at + 4) + 2
                    if end < 2:  # no comment, or one that is left open
                        end = tag_end.at(at)
                if end >= 0:
                    put(at)
                    at = began = end + 1
                elif tag_end.at(at) < 0:  # no further tag at all
                    put(len(html))
                    return
                else:
                    at += 1
                continue
            put(at)
            at = began = m.end()
            end, name, attributes = m.groups()
            name = name.lower()
            if end:
                if name == "a":
                    link = False
                elif name not in INLINE and name not in VOID:
                    close((name,))
                continue
            if name == "a":
                link, link_depth = True, len(stack)
                continue
            if name == "br":
                pieces.append((stack[-1], block, " ", link))
                continue
            if name in TO_END or name in PAIRED:
                if name != "svg" or not _closes_itself(attributes):
                    at = began = skips.after(name, at)
                continue
            # a head needs no end tag: what may stand in it is skipped or void, all else belongs to the body
            if name in INLINE or name in VOID or name in ("html", "head", "body"):
                block += name == "hr"
                continue
            if name in CLOSES_P:
                close(("p",), P_SCOPE)
            if name in SELF_CLOSING:
                close(SELF_CLOSING[name], SCOPE[name])
            mask = _attribute_mask(attributes) if attributes else 0
            if name == "span" and not mask:
                continue
            if self.truth is not None:
                self.truth.append(_TRUE in attributes)
            tags.append(name)
            self.parent.append(stack[-1])
            self.mask.append(mask)
            self.hidden.append(bool(attributes) and bool(_HIDDEN.search(attributes)))
            if not attributes.endswith("/") or name in ("p", "div", "li"):
                open_at.setdefault(name, []).append(len(stack))
                stack.append(len(tags) - 1)
            if name != "span":
                block += 1

    def features(self) -> np.ndarray:
        return np.concatenate(list(self.feature_blocks(len(self.tag))))

    def feature_blocks(self, rows: int) -> Iterator[np.ndarray]:
        """Features of the nodes in document order, so many at once at most."""
        tag, parent, mask = self.tag, self.parent, self.mask
        n = len(tag)
        own, links, marks, words = [0] * n, [0] * n, [0] * n, [0] * n
        for node, _, text, link in self.pieces:
            size = len(text.strip())
            if size:
                own[node] += size
                words[node] += text.count(" ") + 1
                if link:
                    links[node] += size
                else:
                    marks[node] += len(_MARKS.findall(text))
        total, total_links, total_marks, below, paragraphs = own[:], links[:], marks[:], [0] * n, [t == "p" for t in tag]
        children = [0] * n
        for v in range(n - 1, 0, -1):
            p = parent[v]
            total[p] += total[v]
            total_links[p] += total_links[v]
            total_marks[p] += total_marks[v]
            below[p] += below[v] + 1
            paragraphs[p] += paragraphs[v]
            children[p] += 1
        depth, seen, index, above_mask, above_tags, same = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n, {}
        group = [_TAG_GROUP.get(t, len(TAG_GROUPS)) for t in tag]
        for v in range(1, n):
            p = parent[v]
            depth[v] = depth[p] + 1
            index[v] = seen[p]
            seen[p] += 1
            above_mask[v] = above_mask[p] | mask[p]
            above_tags[v] = above_tags[p] | 1 << group[p]
            same[p, tag[v]] = same.get((p, tag[v]), 0) + 1
        previous, following, last_child, since = [0] * n, [0] * n, [0] * n, [0] * n  # siblings; nodes since a heading among them
        for v in range(1, n):
            u = last_child[parent[v]]
            if u:
                previous[v], following[u] = u, v
                since[v] = 1 if tag[u] in HEADINGS else since[u] + 1 if since[u] else 0
            last_child[parent[v]] = v
        before, run = [0] * n, 0
        for v in range(n):
            before[v] = run
            run += own[v]
        par_all = np.maximum(np.array(parent), 0)
        f64 = lambda x: np.array(x, dtype=np.float64)
        whole = {k: f64(v) for k, v in {"total": total, "links": total_links, "children": children}.items()}
        previous, following = np.array(previous), np.array(following)
        plain = whole["total"] - whole["links"]
        groups, masks, aboves, tags_above = np.array(group, dtype=np.int8), np.array(mask, dtype=np.int16), np.array(above_mask, dtype=np.int16), np.array(above_tags, dtype=np.int64)
        for lo in range(0, n, rows):
            hi = min(lo + rows, n)
            a = lambda x: np.array(x[lo:hi], dtype=np.float64)  # noqa: B023, E731
            par = par_all[lo:hi]
            total_, links_, below_, children_, index_ = whole["total"][lo:hi], whole["links"][lo:hi], a(below), whole["children"][lo:hi], a(index)
            group_, mask_, above_, tags_ = groups[lo:hi], masks[lo:hi], aboves[lo:hi], tags_above[lo:hi]
            columns = [
                np.log1p(total_), np.log1p(a(own)), links_ / np.maximum(total_, 1), np.log1p(below_), total_ / (below_ + 1), 100 * a(total_marks) / np.maximum(total_, 1),
                np.log1p(a(paragraphs)), a(depth), children_, index_, index_ / np.maximum(whole["children"][par], 1), total_ / np.maximum(whole["total"][par], 1), total_ / max(run, 1),
                a(before) / max(run, 1), f64([same.get((parent[v], tag[v]), 0) for v in range(lo, hi)]), np.log1p(whole["total"][par]), whole["links"][par] / np.maximum(whole["total"][par], 1), a(self.hidden),
            ]
            for near in (previous[lo:hi], following[lo:hi]):  # 0, the body, where there is no such sibling
                there = near > 0
                columns += [there, there * np.log1p(whole["total"][near]), there * whole["links"][near] / np.maximum(whole["total"][near], 1), there & (groups[near] == group_)]
            columns += [a(since), np.log1p(plain[par]), plain[par] / max(float(plain[0]), 1.0)]
            columns += [group_ == g for g in range(len(TAG_GROUPS))]
            columns += [groups[par] == _TAG_GROUP[t] for t in ("article", "nav", "header", "footer", "aside", "li", "form")]
            columns += [(tags_ >> _TAG_GROUP[t]) & 1 for t in ("article", "nav", "header", "footer", "aside", "form", "ul")]
            columns += [(mask_ >> g) & 1 for g in range(len(TOKEN_GROUPS))] + [(above_ >> g) & 1 for g in range(len(TOKEN_GROUPS))]
            out = np.empty((hi - lo, len(columns)), dtype=np.float32)
            for j, c in enumerate(columns):
                out[:, j] = c
            yield out

    def decode(self, margin: np.ndarray) -> list[bool]:
        """Which nodes to keep: the most probable choice in which nothing in a dropped node is kept."""
        n = len(self.tag)
        keep = (-np.logaddexp(0, -margin)).tolist()
        drop = (-np.logaddexp(0, margin)).tolist()
        for v in range(n - 1, 0, -1):
            p = self.parent[v]
            keep[p] += max(keep[v], drop[v])
            drop[p] += drop[v]
        kept = [False] * n
        for v in range(n):
            kept[v] = (v == 0 or kept[self.parent[v]]) and keep[v] > drop[v]
        return kept

    def text(self, kept: list[bool]) -> str:
        blocks, last, parts = [], None, []

        def flush() -> None:
            line = " ".join("".join(parts).split())
            if line:
                blocks.append(line)

        for node, block, text, _ in self.pieces:
            if block != last:
                flush()
                parts, last = [], block
            if kept[node]:
                parts.append(unescape(text) if "&" in text else text)  # a reference ends where its text does
        flush()
        return "\n".join(blocks)


#: Tags of headings among siblings.
HEADINGS = frozenset(("h1", "h2", "h3"))


def _sentence(rnd: random.Random, words: int) -> str:
    out = ["".join(rnd.choice("bcdfghlmnprst") + rnd.choice("aeiouéä") for _ in range(rnd.randint(1, 4))) for _ in range(max(1, words))]
    return " ".join(out).capitalize() + rnd.choice([".", ".", ".", "!", "?", ""])


def _paragraph(rnd: random.Random) -> str:
    parts = [_sentence(rnd, rnd.choice([1, 2, 3, 6, 10, 15, 25])) for _ in range(rnd.choice([1, 1, 1, 2, 3, 5, 8]))]
    if rnd.random() < 0.15:
        parts[0] = f'<a href="/x">{parts[0]}</a>'
    if rnd.random() < 0.2:
        parts[-1] = f"<b>{parts[-1]}" + rnd.choice(["</b>", "<br>"])
    return " ".join(parts)


def _links(rnd: random.Random, n: int) -> str:
    return "".join(f'<li><a href="/{i}">{_sentence(rnd, rnd.randint(1, 4))}</a></li>' for i in range(n))


#: Marks nodes of main text in generated pages; read back by `training_rows`, never a feature.
_TRUE = ' data-truth="1"'


def training_page(rnd: random.Random) -> str:
    """A generated page. Elements with _TRUE hold main text."""
    pick, chance = rnd.choice, lambda p: rnd.random() < p

    def named(*names: str) -> str:
        return f' {pick(["class", "id"])}="{pick(names)}"' if names else ""

    def boilerplate() -> str:
        s = lambda n: _sentence(rnd, rnd.randint(1, n))
        return pick(
            [
                lambda: f"<nav><ul>{_links(rnd, rnd.randint(2, 9))}</ul></nav>",
                lambda: f"<div{named('menu', 'nav', 'navbar', 'breadcrumb')}><ul>{_links(rnd, rnd.randint(2, 9))}</ul></div>",
                lambda: f"<div{named('ad', 'ads', 'advert', 'sponsored', 'promo', 'ad-slot')}>{s(20)}</div>",
                lambda: f"<aside{named('sidebar', 'widget', 'related') if chance(0.6) else ''}><h3>{s(3)}</h3><p>{s(20)}</p></aside>",
                lambda: f"<div{named('sidebar', 'widget', 'side')}><h3>{s(3)}</h3><ul>{_links(rnd, 4)}</ul><p>{s(12)}</p></div>",
                lambda: f"<div{named('cookie-notice', 'notice', 'consent', 'alert', 'popup')}><p>{s(25)}</p><button>{s(1)}</button></div>",
                lambda: f"<form{named('newsletter', 'search', 'login') if chance(0.5) else ''}><label>{s(3)}</label><input><button>{s(1)}</button><p>{s(10)}</p></form>",
                lambda: f"<div{named('share', 'social', 'related', 'tags', 'trending')}><h4>{s(3)}</h4><ul>{_links(rnd, rnd.randint(2, 5))}</ul></div>",
            ]
        )()

    def comments() -> str:
        one = lambda: f"<{pick(['p', 'div'])}>{' '.join(_sentence(rnd, rnd.randint(2, 20)) for _ in range(rnd.randint(1, 4)))}"
        return pick(
            [
                lambda: f"<section{named('comments', 'discussion', 'respond')}><h2>{_sentence(rnd, 2)}</h2>{''.join(f'<div class=comment>{one()}</div>' for _ in range(rnd.randint(1, 6)))}</section>",
                lambda: f"<div{named('comments', 'commentlist', 'replies')}><ol>{''.join(f'<li>{one()}</li>' for _ in range(rnd.randint(1, 6)))}</ol></div>",
            ]
        )()

    def article() -> str:
        title = pick(["h1", "h1", "h2"])
        parts = [f"<{title}{_TRUE}>{_sentence(rnd, rnd.randint(1, 12))}</{title}>"] if chance(0.85) else []
        if parts and chance(0.15):
            parts = [f"<header{_TRUE}>{parts[0]}</header>"]
        for _ in range(pick([0, 1, 2, 3, 5, 8, 15, 30])):
            kind = rnd.random()
            if kind < 0.8:
                parts.append(f"<p{_TRUE}>{_paragraph(rnd)}" + ("</p>" if chance(0.9) else ""))
            elif kind < 0.86:
                parts.append(f"<h2{_TRUE}>{_sentence(rnd, rnd.randint(1, 6))}</h2>")
            elif kind < 0.9:
                parts.append(f"<ul{_TRUE}>" + "".join(f"<li{_TRUE}>{_paragraph(rnd)}</li>" for _ in range(rnd.randint(1, 6))) + "</ul>")
            elif kind < 0.93:
                parts.append(f"<blockquote{_TRUE}><p{_TRUE}>{_paragraph(rnd)}</p></blockquote>")
            elif kind < 0.935:
                parts.append(f"<div{_TRUE}>{_paragraph(rnd)}</div>")
            elif kind < 0.95:
                items = "".join(f'<li{_TRUE}><a href="/{i}">{_sentence(rnd, rnd.randint(1, 6))}</a></li>' for i in range(rnd.randint(1, 6)))
                parts.append(f"<ul{_TRUE}>{items}</ul>")
            elif kind < 0.957:
                parts.append(pick([f"<figure{_TRUE}><img src=x><figcaption{_TRUE}>{_sentence(rnd, 5)}</figcaption></figure>", f"<pre{_TRUE}>{_sentence(rnd, 9)}</pre>", f"<dl{_TRUE}><dt{_TRUE}>{_sentence(rnd, 1)}</dt><dd{_TRUE}>{_sentence(rnd, 6)}</dd></dl>"]))
            elif kind < 0.975:
                parts.append(f"<table{_TRUE}>" + "".join(f"<tr{_TRUE}><td{_TRUE}>{_sentence(rnd, 2)}</td><td{_TRUE}>{_sentence(rnd, 3)}</td></tr>" for _ in range(3)) + "</table>")
            else:
                parts.append(boilerplate())
        if chance(0.1):
            parts.append(comments())
        if chance(0.1):
            parts.append(f"<footer><p>{_sentence(rnd, 8)}</p></footer>")
        inner = "".join(parts) or f"<p{_TRUE}>{_paragraph(rnd)}</p>"
        if chance(0.18):
            return inner  # right in the body, or in what holds the page
        where = pick(["article", "article", "article", "main", "div", "div", "section"])
        name = named("content", "post", "entry", "article-body", "story", "main-text", "page") if where in ("div", "section") and chance(0.85) else ""
        out = f"<{where}{name}{_TRUE}>{inner}</{where}>"
        for _ in range(pick([0, 0, 0, 1, 2])):
            out = f"<{pick(['div', 'main', 'section'])}{named('wrapper', 'container', 'page', 'row') if chance(0.5) else ''}{_TRUE}>{''.join(boilerplate() for _ in range(pick([0, 0, 1])))}{out}{comments() if chance(0.1) else ''}"
        return out

    head = "".join(boilerplate() for _ in range(pick([0, 1, 1, 2, 3])))
    if chance(0.5):
        head = f"<header{named('header', 'masthead') if chance(0.5) else ''}><a href=/>{_sentence(rnd, 2)}</a>{head if chance(0.3) else ''}<p>{_sentence(rnd, rnd.randint(1, 8))}</p></header>" + head
    tail = "".join(boilerplate() for _ in range(pick([0, 0, 1, 2])))
    if chance(0.3):
        tail = comments() + tail
    foot = f"<footer{named('footer', 'foot') if chance(0.3) else ''}>&copy; {_sentence(rnd, rnd.randint(1, 20))}</footer>" if chance(0.7) else f"<div{named('footer', 'copyright', 'legal')}><p>{_sentence(rnd, 9)}</p></div>"
    if chance(0.15):  # a bare page
        head, tail, foot = "", pick(["", tail]), pick(["", foot])
    whole = f"{head}{article()}{tail}{foot}"
    if chance(0.12):  # cells for the menu and the text
        menu = pick([f"<ul>{_links(rnd, rnd.randint(2, 6))}</ul>", "<br>".join(f'<a href="/{i}">{_sentence(rnd, 2)}</a>' for i in range(rnd.randint(2, 6)))])
        whole = f"<table{_TRUE}><tr{_TRUE}><td>{menu}</td><td{_TRUE}>{article()}</td></tr></table>{foot}"
    return f"<!DOCTYPE html><html><head><title>{_sentence(rnd, 5)}</title></head><body>{whole}</body></html>"


def training_rows(pages: int = TRAINING_PAGES, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Features and truth of all nodes of generated pages."""
    rnd = random.Random(seed)
    x, y = [], []
    for _ in range(pages):
        html = training_page(rnd)
        page, plain = TruePage(html), Page(html.replace(_TRUE, ""))
        x.append(plain.features())
        y.append(np.array(page.truth, dtype=np.float64))
    return np.concatenate(x), np.concatenate(y)


class TruePage(Page):
    """A generated page with the truth of its nodes."""

    def __init__(self, html: str) -> None:
        self.truth = [True]
        super().__init__(html)


@lru_cache(maxsize=2)
def fit_trees(pages: int = TRAINING_PAGES, seed: int = 11) -> boosting.Trees:
    x, y = training_rows(pages, seed)
    return boosting.fit(x.astype(np.float64), y)


def extract_pages(htmls: list[str], trees: boosting.Trees) -> Iterator[str]:
    """The pages' texts. Trees see many small pages at once, a large one in parts."""
    held: list[Page] = []
    features: list[np.ndarray] = []

    def flush() -> Iterator[str]:
        if held:
            margin, a = trees.margin(np.concatenate(features)), 0
            for page, f in zip(held, features, strict=True):
                yield page.text(page.decode(margin[a : a + len(f)]))
                a += len(f)
            held.clear()
            features.clear()

    nodes = 0
    for html in htmls:
        page = Page(html)
        if len(page.tag) > NODES_PER_BATCH:
            yield from flush()
            nodes = 0
            yield page.text(page.decode(np.concatenate([trees.margin(f) for f in page.feature_blocks(NODES_PER_BATCH)])))
            continue
        held.append(page)
        features.append(page.features())
        nodes += len(page.tag)
        if nodes >= NODES_PER_BATCH:
            yield from flush()
            nodes = 0
    yield from flush()


def _extract_batches(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = model.value
        for batch in batches:
            texts = list(extract_pages([h or "" for h in batch.column("_html").to_pylist()], trees))
            keys = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "text"])

    return run


def extract(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", training_pages: int = TRAINING_PAGES) -> DataFrame:
    """(page_id, url, text) of every page."""
    spark = prepare(pages.sparkSession)
    model = spark.sparkContext.broadcast(fit_trees(training_pages))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("_html"))
    kind = ", ".join(f"{c} {t}" for c, t in rows.dtypes[:2])
    return rows.mapInArrow(_extract_batches(model), f"{kind}, text string")
