"""Main text of web pages by tag-path ratios.

A page is read once into blocks of text; each has the path of tags from the root to it, interned as a
number per (path, tag).  Text length and punctuation are summed up per path and divided by the path's
blocks; both series, laid along the page, are smoothed, fused, and averaged per path: its score.  Names
of elements, roles and classes weigh the scores, relative to the best weight of the page.  Paths over a
threshold are the core.  From the root, the parts of the page that hold nearly all of the core are
followed down to the content's element; in it short items, captions and cells belong to the content
unless their weight or their links speak against them.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import task, unused

#: A tag's end; quotes hide it only as the values of attributes.
_TAG_END = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*')|>")
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_ATTR = re.compile(r"([a-zA-Z][a-zA-Z0-9:_-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PUNCTUATION = ".,;:!?…。，！？"
_HIDDEN = re.compile(r"display\s*:\s*none")

#: Elements whose content is no markup, and no text of the page.
_RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in "script style noscript template svg math iframe object textarea select title canvas audio video".split()}
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that hardly ever hold main text.
_NOISE = frozenset("nav footer aside form button input label fieldset dialog menu head optgroup option legend datalist".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar status toolbar".split())
#: Words of class names and ids that mark menus, adverts, notices, forms and comments.
_NOISE_WORDS = frozenset("nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead ad ads adv advert adverts advertisement adsense advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices popup modal newsletter subscribe subscription signup share sharing social related recommended recommendations comment comments disqus respond reply replies login pagination pager skip toolbar banner".split())
_MAIN_WORDS = frozenset("article content main post entry story body".split())
_COMMENT_WORDS = frozenset(("comment", "comments"))
#: Elements that an opening tag closes first, up to the nearest of the second set.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
_BOUNDS_P = frozenset("div section article td li body blockquote main".split())
#: Levels of elements kept apart; deeper ones count as their ancestor of this level.
_DEPTH = 512
#: Weights of a neighbour at distances 0, 1 and 2 along the page.
_SMOOTH = (0.5, 0.2, 0.05)
#: Weights by name: article, main, noise.
_ARTICLE, _MAIN, _WEAK = 3.0, 1.5, 0.02
#: Least score of a core path and of any block within the content, as shares of their means; the least a
#: score counts; the share of links that no content has; the share of the core that the content holds where
#: what is left has paths of the content, and where it has not.
_LEAST, _WITHIN, _FLOOR = 0.4, 0.03, 0.05
_LINKS, _SHARE, _SHARE_APART = 0.6, 0.95, 0.8


def _words(attrs: dict[str, str]) -> frozenset:
    names = (re.split(r"[-_]+", name) for name in (attrs.get("class", "") + " " + attrs.get("id", "")).lower().split())
    return frozenset(w for parts in names if parts[0] not in ("with", "no", "has", "is", "js") for w in parts)


class Page:
    """Elements and blocks of a page, in page order, as parallel lists.

    Elements: parent, tag, weight, mark (2: in an article, 1: in a main element).  Blocks: element, path,
    text, characters in links.  Paths: tag and parent path.
    """

    def __init__(self, source: str):
        self.parent, self.tag, self.weight, self.mark, self.path = [-1], [""], [1.0], [0], [0]
        self.element, self.block_path, self.texts, self.linked = [], [], [], []
        self.paths: dict[tuple[int, str], int] = {(-1, ""): 0}
        self._read(source)

    def _weight(self, tag: str, raw: str, parent: int) -> tuple[float, int]:
        attrs = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)} if raw.strip(" /\n") else {}
        role, words = attrs.get("role", "").lower(), _words(attrs) if attrs else frozenset()
        mark = 2 if tag == "article" or role == "article" or attrs.get("itemprop") == "articleBody" else 1 if tag == "main" or role == "main" else 0
        before, weight = self.mark[parent], 1.0
        if mark > before:
            weight *= (_ARTICLE if before == 0 else _ARTICLE / _MAIN) if mark == 2 else _MAIN
        if tag not in ("html", "body"):
            noise = bool(words & (_NOISE_WORDS - _COMMENT_WORDS)) and not words & _MAIN_WORDS
            noise |= tag in _NOISE or role in _NOISE_ROLES or (tag == "header" and not before) or bool(words & _COMMENT_WORDS)
            if noise:
                weight *= _WEAK
        if "hidden" in attrs or attrs.get("aria-hidden") == "true" or _HIDDEN.search(attrs.get("style", "")):
            weight *= _WEAK * _WEAK
        return weight, max(before, mark)

    def _read(self, source: str) -> None:
        stack, opened, buffer = [0], defaultdict(int), []
        links = in_link = over = at = 0
        last = source.rfind(">")

        def flush():
            nonlocal links
            text = " ".join("".join(buffer).split()) if buffer else ""
            if text:
                top = stack[-1]
                self.element.append(top)
                self.block_path.append(self.path[top])
                self.texts.append(text)
                self.linked.append(links)
            buffer.clear()
            links = 0

        def words(raw: str):
            nonlocal links
            if raw:
                raw = html.unescape(raw)
                buffer.append(raw)
                if in_link:
                    links += len(raw.strip())

        def close(index: int):
            nonlocal in_link
            flush()
            for x in stack[index:]:
                opened[self.tag[x]] -= 1
            del stack[index:]
            in_link = 0

        def nearest(tags, bounds=frozenset()) -> int:
            for i in range(len(stack) - 1, 0, -1):
                t = self.tag[stack[i]]
                if t in tags:
                    return i
                if t in bounds:
                    return 0
            return 0

        while True:
            i = source.find("<", at)
            if i < 0:
                words(source[at:])
                break
            follows = source[i + 1:i + 2]
            if follows in ("!", "?"):
                words(source[at:i])
                if source.startswith("<!--", i):
                    end, size = source.find("-->", i + 4), 3
                elif source.startswith("<![CDATA[", i):
                    end, size = source.find("]]>", i), 3
                    words(html.escape(source[i + 9:end if end >= 0 else None]))
                else:
                    end, size = source.find(">", i), 1
                if end < 0:
                    break
                at = end + size
                continue
            ends = follows == "/"
            m = _NAME.match(source, i + 1 + ends)
            if not m:
                words(source[at:i + 1])
                at = i + 1
                continue
            words(source[at:i])
            if i > last:  # a tag that the page's end cuts off
                break
            tag = m[0].lower()
            stop = source.find(">", m.end()) + 1
            if source.find("=", m.end(), stop) >= 0:
                stop = next((x.end() for x in _TAG_END.finditer(source, m.end()) if x[0] == ">"), 0)
            if not stop:
                break
            raw, at = source[m.end():stop - 1], stop
            if tag in _RAW and not ends:
                if raw.endswith("/") and tag in ("svg", "math"):
                    continue
                found = _RAW[tag].search(source, at)
                if not found:
                    break
                at = found.end()
                continue
            if tag in _INLINE:
                if tag == "a":
                    in_link = 0 if ends else 1
                elif tag == "br":
                    buffer.append(" ")
                continue
            if ends:
                if over:
                    flush()
                    over -= 1
                elif opened[tag] > 0 and (k := nearest({tag})):
                    close(k)
                else:
                    flush()
                continue
            flush()
            if tag in _VOID:
                continue
            in_link = 0
            if opened["p"] > 0 and (k := nearest({"p"}, _BOUNDS_P)):  # a block element ends an open paragraph
                close(k)
            if tag in _CLOSES:
                own, bounds = _CLOSES[tag]
                while any(opened[t] > 0 for t in own) and (k := nearest(own, bounds)):
                    close(k)
            if tag == "body" and opened["head"] > 0:
                close(nearest({"head"}))
            if raw.endswith("/") and tag not in ("p", "div"):
                continue
            if len(stack) > _DEPTH:
                over += 1
                continue
            top = stack[-1]
            weight, mark = self._weight(tag, raw, top)
            self.parent.append(top)
            self.tag.append(tag)
            self.weight.append(self.weight[top] * weight)
            self.mark.append(mark)
            self.path.append(self.paths.setdefault((self.path[top], tag), len(self.paths)))
            stack.append(len(self.tag) - 1)
            opened[tag] += 1
        flush()


def smoothed(x: np.ndarray) -> np.ndarray:
    w = np.array([*_SMOOTH[:0:-1], *_SMOOTH])
    return np.convolve(np.concatenate([x[:1], x[:1], x, x[-1:], x[-1:]]), w / w.sum(), "valid")


def path_scores(paths: np.ndarray, length: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Score of each path (0 where it has no block): ratios of text and of punctuation to blocks per path,
    smoothed along the page, fused, and averaged per path.

    paths, length, marks: path, characters and punctuation marks of each block, in page order.
    """
    n = np.maximum(np.bincount(paths), 1)
    text, punctuation = np.bincount(paths, length) / n, np.bincount(paths, marks) / n
    fused = smoothed(text[paths]) * (1 + smoothed(punctuation[paths]))
    return np.sqrt(np.bincount(paths, fused) / n)


def _own_mean(r: np.ndarray, length: np.ndarray) -> float:
    """Mean score of the text that has the scores: long and high blocks count most."""
    return float((r * r * length).sum() / max((r * length).sum(), 1e-300))


def chosen(page: Page) -> np.ndarray:
    """Which blocks of the page are its main content."""
    n = len(page.texts)
    paths, of = np.array(page.block_path), np.array(page.element)
    length = np.array([len(t) for t in page.texts], float)
    marks = np.array([sum(map(t.count, _PUNCTUATION)) for t in page.texts], float)
    linked = np.array(page.linked, float)
    score = path_scores(paths, length, marks)[paths]
    score = np.minimum(np.maximum(score * length.sum() / max((score * length).sum(), 1e-300), _FLOOR), 1.0)
    weight = np.array(page.weight)[of]
    r = score * weight / weight.max()
    many = np.bincount(paths, linked)[paths] > _LINKS * np.bincount(paths, length)[paths]
    core = (r >= _LEAST * _own_mean(np.where(many, 0, r), length)) & ~many
    if not core.any():
        return core
    # how much of the core each element holds, and its first and last block; children come after their parents
    size = len(page.tag)
    mass = np.bincount(of, np.where(core, r * length, 0), size).tolist()
    first, last, best, inner = [n] * size, [-1] * size, [0] * size, [False] * size
    for i, k in enumerate(page.element):
        last[k] = i
        if first[k] == n:
            first[k] = i
    for k in range(size - 1, 0, -1):
        if last[k] >= 0:
            p = page.parent[k]
            mass[p] += mass[k]
            inner[p] = True
            first[p], last[p] = min(first[p], first[k]), max(last[p], last[k])
            if not best[p] or mass[k] >= mass[best[p]]:
                best[p] = k  # the child that holds most
    kinds = [p if c else -1 for p, c in zip(page.block_path, core.tolist())]
    at = 0
    while page.mark[at] < 2 and (k := best[at]) and (inner[k] or page.mark[k] == 2):
        around = {*kinds[first[at]:first[k]], *kinds[last[k] + 1:last[at] + 1]} - {-1}
        if mass[k] < (_SHARE if around & {*kinds[first[k]:last[k] + 1]} else _SHARE_APART) * mass[0]:
            break
        at = k
    inside = np.zeros(n, bool)
    if page.tag[at] in ("", "html", "body"):  # the page itself: what stands around its core is no part of it
        whole = np.flatnonzero(core)
        inside[whole[0]:whole[-1] + 1] = True
        a = int(whole[0])
    else:
        inside[first[at]:last[at] + 1] = True
        a = first[at]
    least = weight[inside].max() / _ARTICLE
    while a > 0 and page.tag[page.element[a - 1]] in _HEADINGS and weight[a - 1] >= least:  # its headings
        a -= 1
        inside[a] = True
    return inside & ~many & (r >= _WITHIN * _own_mean(np.where(inside, r, 0), length))


def extract(source: str | None) -> str:
    """The main text of a page: its blocks joined by blank lines; empty where there is none."""
    if not source:
        return ""
    page = Page(source)
    if not page.texts:
        return ""
    return "\n\n".join(page.texts[i] for i in np.flatnonzero(chosen(page)))


def main_text(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """pages with ``text`` and ``n_chars`` in place of the html.

    Row by row, without a shuffle.  Null, empty or textless pages give an empty text.  Broken markup is
    read like a browser would roughly: unclosed comments and scripts run to the end, a tag that the page's
    end cuts off is dropped, unclosed elements end with their parents.  Time and memory grow in proportion
    to the page.  Repeated rows give equal texts; an empty table stays empty; columns named text or
    n_chars are replaced; all others stay as they are.
    """
    rest = [c for c in pages.columns if c not in (html_column, "text", "n_chars")]
    (own,) = unused(rest, "html_")

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                texts = [extract(x.as_py()) for x in part.column(own)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*rest, "text", "n_chars"])

    d = pages.select(*(F.col(f"`{c}`") for c in rest), F.col(f"`{html_column}`").alias(own))
    kind = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema.fields[:-1]), "text string", "n_chars long"])
    return d.mapInArrow(task(run), kind)
