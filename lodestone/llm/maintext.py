"""Main text of web pages by tag-path ratios.

A page's text is cut into blocks, each with its path of block elements from the
root. For each path the text length and the punctuation of its blocks are
averaged; both ratios are smoothed along the page, fused by multiplication, and
paths whose score reaches the page's threshold are content. Where one element
holds nearly all content (the body, if none below it does), its other blocks
belong to it too: headlines, short lists, and lists of links between content or
in an ``article`` or ``main``.

Elements that are never shown and the controls of forms are left out. Other
elements are suspected by what they are: menus, footers, forms, page headers,
and outside of ``article`` and ``main`` side columns, roles, and containers
(never a paragraph, heading or inline element) whose whole class or id says so,
such as ``ad-slot``. A suspected element is left out only while it holds less
than ``SHARE`` of the page's score, or none of the text in ``article`` and
``main``: a form around the page, or an article in a division named ``login``,
stays. Within ``article`` and ``main``, what stands beside the text, or is named
so, stays if a sentence of it is content by its score. Reader comments, which often hold more text
than the article, are left out while there is a paragraph elsewhere that
compares with theirs. Names that may mean something else, such as ``related``,
only lower the score of their path, and only outside of ``article`` and
``main``; a name with any word of its own, such as ``social-policy``, means
nothing. A header within the content belongs to it unless a first-rank headline
follows. Time is linear in the page's length, however deep its elements are.

A page is handled by itself, from its whole HTML: nothing is shuffled. Defined
cases: null and empty HTML, and pages without text, give an empty text; markup
cut off at the end is dropped; unknown and unclosed tags are tolerated; of elements
that hold equally much the first is taken; repeated rows give equal results, a
null key is a key like others, and an empty table gives no rows. The columns of
``keep`` are carried along, whatever their names but ``text``, which is refused;
others are not looked at.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.patterns import spare
from lodestone.llm.textbytes import slices

#: Share of the content's score that an element must hold to be the article.
HOLDS = 0.75
#: Share of the page's score that a suspected element must hold to be the article's.
SHARE = 0.8
#: How far, as a share of the comments' longest paragraph, another one must go for them to be comments.
COMPARES = 0.5
#: Characters of a sentence, at least.
SENTENCE = 40
#: Threshold in units of the deviation of the page's scores.
DEVIATIONS = 0.5

_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea iframe svg canvas select noframes title".split())
_UNSEEN = frozenset("head button".split())
_OUT = frozenset("nav footer form menu".split())
#: Elements, and roles, that are no article text unless they stand in an article.
_BESIDE = frozenset("aside dialog".split())
_ROLES = frozenset("navigation contentinfo search form menu menubar toolbar".split())
_ROLES_BESIDE = frozenset("banner complementary dialog alert alertdialog".split())
#: Words of a class or id that name reader comments, ...
_COMMENTS = frozenset("comment comments commentlist respond disqus".split())
#: ... that name what is no article text, ...
_STRONG = frozenset("ad ads advert adverts advertisement advertisements advertising sponsored promo cookie cookies consent gdpr popup modal sidebar menu nav navbar navigation breadcrumb breadcrumbs masthead topbar toolbar share sharing newsletter subscribe subscription signup login pagination pager".split())
#: ... words that may do so, ...
_WEAK = frozenset("header footer banner notice notification alert overlay widget widgets sponsor promotion social related recommended recommendations search copyright skip aside top bottom".split())
#: ... words that say nothing beside these, and words of the article itself.
_NEUTRAL = frozenset("slot box list container wrapper wrap section block area bar form item items link links unit left right page site global primary secondary inner outer row col main".split())
_CONTENT = frozenset("article entry post story content text body".split())
_CONTAINERS = frozenset("article aside center dd details div dl fieldset figure footer form header li main menu nav ol section table tbody td th tr ul".split())
#: The share of links in a block from which it must lie between content, or in an article.
MOST_LINKS = 0.8
#: What the length of a block counts where its container's name may mean no article text.
_DOUBT = 0.25
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|aria-hidden|style)(?![^\s=/>])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")


#: What an element is by its tag, role, class and id.
_PLAIN, _WEAKLY, _ALONE, _SUSPECT, _READERS, _HEADER, _NEVER = range(7)


class Page(NamedTuple):
    """The blocks of a page in page order, and the elements that they stand in: an element's number is above its parent's."""

    texts: list[str]
    links: list[int]  # characters of each block that belong to links
    nodes: list[int]  # the element of each block
    parents: list[int]
    names: list[str]
    paths: list[int]  # one number for each path of element names
    kinds: list[int]
    within: list[bool]  # whether an element is, or stands in, an article


def _name_says(value: str) -> int:
    """What a class or id says its element is."""
    found = _PLAIN
    for name in value.split():
        words = [w for w in _SPLIT.split(name) if w]
        known = _COMMENTS, _STRONG, _WEAK
        if not words or words[-1] in _CONTENT or not all(any(w in k for k in known) or w in _NEUTRAL or w in _CONTENT for w in words):
            continue
        if any(w in _COMMENTS for w in words):
            return _READERS
        if any(w in _STRONG for w in words):
            found = _SUSPECT
        elif found == _PLAIN and any(w in _WEAK for w in words) and not any(w in _CONTENT for w in words):
            found = _WEAKLY
    return found


def _kind(name: str, attributes: str, in_article: bool) -> int:
    """What an element is; in an article names tell comments alone, and what stands beside other text must hold by itself."""
    if name in _UNSEEN:
        return _NEVER
    found = _SUSPECT if name in _OUT else _PLAIN
    if name in _BESIDE:
        found = _ALONE if in_article else _SUSPECT
    elif name == "header" and not in_article:
        found = _HEADER
    for key, a, b, c in _ATTRIBUTE.findall(attributes) if attributes else ():
        key, value = key.lower(), (a or b or c).lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return _NEVER
        if key == "role" and value in _ROLES:
            found = _SUSPECT
        elif key == "role" and value in _ROLES_BESIDE:
            found = max(found, _ALONE) if in_article else _SUSPECT
        elif key in ("class", "id") and name in _CONTAINERS:
            says = _name_says(value)
            if says == _READERS or says > found and not in_article and found != _HEADER:
                found = says
            elif says == _SUSPECT and found == _PLAIN:
                found = _ALONE
    return found


def blocks(page: str) -> Page:
    """The page's blocks with text, without those that are never shown."""
    out = Page([], [], [], [0], [""], [0], [_PLAIN], [False])
    stack: list[tuple[str, int, bool]] = []  # name, number, whether it or what holds it is never shown
    open_: dict[str, int] = defaultdict(int)  # how many elements of a name are open
    known: dict[tuple, int] = {}
    parts: list[str] = []
    links = depth = 0

    def flush() -> None:
        nonlocal links
        if parts and not (stack and stack[-1][2]):
            text = " ".join("".join(parts).split())
            if text:
                out.texts.append(text)
                out.links.append(links)
                out.nodes.append(stack[-1][1] if stack else 0)
        parts.clear()
        links = 0

    def push(name: str, kind: int) -> None:
        above = stack[-1][1] if stack else 0
        out.parents.append(above)
        out.names.append(name)
        out.kinds.append(kind)
        out.within.append(out.within[above] or name in ("article", "main"))
        out.paths.append(known.setdefault((out.paths[above], name, kind), len(known) + 1))
        stack.append((name, len(out.names) - 1, bool(stack and stack[-1][2]) or kind == _NEVER))
        open_[name] += 1

    def pop(name: str) -> None:
        """Ends the innermost open element of this name, and all in it."""
        while True:
            last = stack.pop()[0]
            open_[last] -= 1
            if last == name:
                return

    at, end = 0, len(page)
    while at < end:
        tag = page.find("<", at)
        text = page[at : tag if tag >= 0 else end]
        if text:
            text = entities.unescape(text)
            parts.append(text)
            links += len(text) if depth else 0
        if tag < 0:
            break
        if page.startswith("<!--", tag):
            close = page.find("-->", tag + 4)
            at = close + 3 if close >= 0 else end
            continue
        if page.startswith(("<!", "<?"), tag):
            close = page.find(">", tag)
            at = close + 1 if close >= 0 else end
            continue
        found = _TAG.match(page, tag)
        if not found:
            if not re.match("</?[a-zA-Z]", page[tag : tag + 3]):
                parts.append("<")
                at = tag + 1
                continue
            close = page.find(">", tag)  # a quote that doesn't end, or a tag that the page's end cuts off
            at = close + 1 if close >= 0 else end
            continue
        at = found.end()
        closing, name, attributes = found[1], found[2].lower(), found[3]
        in_article = bool(open_["article"] or open_["main"])
        if name in _RAW:
            if not closing and not attributes.endswith("/"):
                close = re.compile(f"</{name}[\\s>/]", re.I).search(page, at)
                at = page.find(">", close.start()) + 1 or end if close else end
            continue
        if name == "a":
            depth = 0 if closing else 1
        if name == "br":
            parts.append(" ")
        if name not in _BLOCK:
            if name in _VOID:
                continue
            if closing and open_[name]:
                flush()
                pop(name)
            elif not closing and (attributes or name in _UNSEEN) and not attributes.endswith("/") and _kind(name, attributes, in_article) == _NEVER:
                flush()
                push(name, _NEVER)
            continue
        flush()
        if closing:
            if open_[name]:
                pop(name)
            continue
        if open_["p"] and name not in ("html", "body", "head"):
            pop("p")
        while stack and stack[-1][0] in _CLOSES.get(name, ()):
            pop(stack[-1][0])
        if name in _VOID or attributes.endswith("/"):
            continue
        if name == "body":
            while stack and stack[-1][0] == "head":
                pop("head")
        push(name, _kind(name, attributes, in_article))
    flush()
    return out


def _smooth(x: np.ndarray) -> np.ndarray:
    wide = np.pad(x, 1, mode="edge")
    return 0.25 * wide[:-2] + 0.5 * wide[1:-1] + 0.25 * wide[2:]


def _by_path(paths: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each block the mean of the values on its path."""
    return (np.bincount(paths, values) / np.maximum(np.bincount(paths), 1))[paths]


class _Ratios:
    """Text and punctuation by path, for the blocks at ``at``."""

    def __init__(self, page: Page, at: np.ndarray, doubt: np.ndarray):
        nodes = np.array(page.nodes)[at]
        paths = np.array(page.paths)[nodes]
        texts = [page.texts[k] for k in at.tolist()]
        self.sizes, self.links = np.array([len(t) for t in texts], float), np.array(page.links, float)[at]
        self.lengths = (self.sizes - self.links).clip(0) * np.where(doubt[nodes], _DOUBT, 1.0)
        self.marks = np.array([len(_PUNCTUATION.findall(t)) for t in texts], float)
        self.score = _smooth(_by_path(paths, self.lengths)) * (1 + _smooth(_by_path(paths, self.marks)))
        means = _by_path(paths, self.score)
        self.chosen = means >= min(DEVIATIONS * float(np.std(self.score)), float(means.max()))
        self.mass = self.score * self.lengths * self.chosen


def _inherited(page: Page, kind: int) -> np.ndarray:
    """Which elements are, or stand in one, of this kind."""
    out = [k == kind for k in page.kinds]
    for k in range(1, len(out)):
        out[k] = out[k] or out[page.parents[k]]
    return np.array(out)


def _summed(page: Page, nodes: np.ndarray, values: np.ndarray) -> list[float]:
    """For each element what the blocks in it hold."""
    out = np.bincount(nodes, values, len(page.names)).tolist()
    for k in range(len(out) - 1, 0, -1):
        out[page.parents[k]] += out[k]
    return out


def _outside(page: Page, doubt: np.ndarray) -> np.ndarray:
    """Which elements are left out: suspected ones that hold less than their share, and all in them."""
    nodes = np.array(page.nodes)
    all_ = _Ratios(page, np.arange(len(nodes)), doubt)
    readers = _inherited(page, _READERS)
    suspect = _inherited(page, _SUSPECT)
    strength = all_.lengths * (1 + all_.marks)
    theirs, other = (float(strength[on].max(initial=0)) for on in (readers[nodes], ~readers[nodes] & ~suspect[nodes]))
    comments = other >= COMPARES * theirs or float(strength[~readers[nodes]].max(initial=0)) >= COMPARES * theirs
    held = _summed(page, nodes, all_.mass * ~(readers[nodes] & comments))
    marked = _summed(page, nodes, all_.sizes * (np.array(page.within)[nodes] & ~readers[nodes]))
    out = [False] * len(page.kinds)
    for k in range(1, len(out)):
        kind = page.kinds[k]
        out[k] = out[page.parents[k]] or kind == _READERS and comments or kind in (_SUSPECT, _HEADER) and (held[k] < SHARE * held[0] or not held[0] or marked[k] < marked[0] and not page.within[k])
    return np.array(out)


def main_text(page: str) -> str:
    """The article's blocks, joined by line ends."""
    found = blocks(page)
    if not found.texts:
        return ""
    nodes = np.array(found.nodes)
    doubt = _inherited(found, _WEAKLY)
    outside = _outside(found, doubt)
    at = np.flatnonzero(~outside[nodes])
    if not len(at):
        return ""
    own = _Ratios(found, at, doubt)
    # What must hold by itself is left out unless it has a sentence that is chosen.
    content, alone = _summed(found, nodes[at], (own.chosen & (own.lengths >= SENTENCE) & (own.marks > 0)).astype(float)), [False] * len(found.kinds)
    for k in range(1, len(alone)):
        alone[k] = alone[found.parents[k]] or found.kinds[k] == _ALONE and not content[k]
    alone = np.array(alone)
    weight, last = _summed(found, nodes[at], own.mass), list(range(len(found.names)))
    best = [0] * len(weight)  # the child that holds most
    for k in range(len(weight) - 1, 0, -1):
        above = found.parents[k]
        last[above] = max(last[above], last[k])
        if not best[above] or weight[k] >= weight[best[above]]:
            best[above] = k
    held, total = 0, weight[0]
    while total and best[held] and weight[best[held]] >= HOLDS * total and found.names[best[held]] not in ("p", "h1", "h2", "h3", "li", "td", "th", "tr", "pre", "blockquote"):
        held = best[held]
    chosen, owners = own.chosen, nodes[at]
    if total:
        ends = np.flatnonzero(chosen & (owners >= held) & (owners <= last[held]))
        place = np.arange(len(at))
        between = (place > ends[0]) & (place < ends[-1]) if len(ends) else np.zeros(len(at), bool)
        fits = (own.links < MOST_LINKS * own.sizes) | between | np.array(found.within)[owners]
        chosen = (owners >= held) & (owners <= last[held]) & ~alone[owners] & (chosen | ~doubt[owners] & fits)
    picked = set(at[chosen].tolist())
    if total and found.names[held] not in ("", "html", "body"):
        picked |= _headers(found, nodes, held, last[held], outside, picked)
    return "\n".join(found.texts[k] for k in sorted(picked))


def _headers(page: Page, nodes: np.ndarray, held: int, last: int, outside: np.ndarray, picked: set[int]) -> set[int]:
    """The blocks of headers within the content that nothing else leaves out, unless it has a headline of the first rank elsewhere."""
    if any(page.names[nodes[k]] == "h1" for k in picked):
        return set()
    kept = [False] * len(page.kinds)
    for k in range(held + 1, last + 1):
        above = page.parents[k]
        kept[k] = page.kinds[k] == _HEADER and not outside[above] or kept[above] and page.kinds[k] in (_PLAIN, _HEADER)
    return {k for k in np.flatnonzero((nodes > held) & (nodes <= last)).tolist() if kept[nodes[k]] and page.links[k] < MOST_LINKS * len(page.texts[k])}


def extract(pages: DataFrame, key: str = "page_id", html: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """``key``, the columns of ``keep``, and ``text`` of each page."""
    if "text" in (key, *keep):
        raise ValueError("text is the name of the result")
    body = spare("_html", [key, *keep])
    narrow = pages.select(key, *keep, F.col(html).alias(body))
    types = ", ".join(f"`{c}` {narrow.schema[c].dataType.simpleString()}" for c in (key, *keep))

    def run(batches):
        for rows, _, _ in slices(batches, body):
            texts = [main_text(page or "") for page in rows.column(body).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in (key, *keep)), pa.array(texts, pa.string())], [key, *keep, "text"])

    return narrow.mapInArrow(run, f"{types}, text string")
