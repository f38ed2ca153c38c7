"""HTML extraction: the main text of a page by its line-block distribution.

Markup is stripped into lines, one for each block element. A line weighs as much text as it holds outside links, or nothing in a
dropped part: navigation, headers, footers, side bars, notices, adverts, forms and comments. On pages that mark up an article (or
main part) its lines weigh a surge more, whatever is in links, and all others nothing. The weights of BLOCK lines in a row are
summed. Where this sum surges above SURGE the text begins, with the lines of some weight right before, and where it dives to
nothing it ends; all lines between that are not in a dropped part are kept, in every such stretch of the page.

A class or id drops an element only if it holds no article, no main part and not most of the page's text outside links, since
such names also say what a wrapper has beside the text; names of comments and of lists of other pages do unless a main part is
inside. A form with an article or main part stays. Inside an article a header by name stays, as the element does. Names that are
plain words too (`share`), and all names inside an article, count only if nothing but words of layout stand beside them: not in
`share-of-market`.

Tags are read in one pass: quotes matter only where a value begins, a `<` before anything but a name is text, and a quote that
never ends is part of an unquoted value. The time grows with the page, however broken it is.

Defined cases: a null or empty page, or one without text, gives an empty text. Unclosed and stray tags are
tolerated, an unclosed script, style or comment, or a tag without its end, ends the page; other unclosed elements whose text is
dropped are passed over. A page without a surge keeps all lines outside dropped parts. Repeated
pages each get their row. Character references are decoded once; white space inside a block becomes one space. Other columns are
not read.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK, SURGE = 3, 86

#: Element names of HTML, and the names that sites give to parts which are not the article.
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "object", "canvas", "textarea", "select", "title"}
ENDING = {"script", "style"}
ASIDE = {"nav", "aside", "footer", "form", "menu", "dialog", "button"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img",
          "input", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
          "tt", "u", "var", "wbr"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements whose end tag may be left out; a new block of the kinds beside them ends them.
LOOSE = {"p", "li", "dt", "dd", "tr", "td", "th", "option", "thead", "tbody", "tfoot"}
PARTS = re.compile(r"advert\w*|banners?|sponsor\w*|cookies?|popup|modal|newsletter|sidebar|nav(?:s|i|bar|igation|menu|links?|list)?|"
                   r"breadcrumbs?|header|masthead|footer|comments?|disqus|pagination|pager", re.A)
#: Names of parts that are plain words as well.
WORDS = re.compile(r"ads?|promo\w*|consent|notices?|subscribe|menu|replies|respond|share|social|related|recommend\w*|widget|login|signup|toolbar", re.A)
#: Names of parts that hold articles of their own, and names that an article's own parts have too.
OTHERS = re.compile(r"ads?|advert\w*|comments?|disqus|replies|respond|related|recommend\w*", re.A)
HEADERS = {"header", "masthead"}
#: Words of layout that stand beside the name of a part.
LAYOUT = {"area", "article", "articles", "aside", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "center", "col", "column",
          "container", "content", "entry", "fixed", "floating", "form", "global", "group", "holder", "icon", "icons", "inline", "inner",
          "item", "items", "left", "link", "links", "list", "main", "media", "mobile", "outer", "overlay", "page", "panel", "post", "posts",
          "primary", "right", "row", "secondary", "section", "site", "slot", "sticky", "story", "stories", "text", "title", "tools", "top",
          "unit", "user", "wrap", "wrapper", "zone"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert"}

OPEN = re.compile(r"[a-zA-Z][^\t\n\f\r />]*")
BETWEEN = re.compile(r"[\t\n\f\r /]*")
ATTRIBUTE = re.compile(r"=?[^\t\n\f\r />=]*")
EQUALS = re.compile(r"[\t\n\f\r ]*=[\t\n\f\r ]*")
UNQUOTED = re.compile(r"[^\t\n\f\r >]*")
COMMENT_END = re.compile(r"--!?>")
RAW_END = {name: re.compile(rf"</{name}(?=[\t\n\f\r />])", re.I) for name in sorted(RAW)}
DIGITS = re.compile(r"&#([0-9]{8,})")
SPLIT = re.compile(r"[_-]+")
WHITE = re.compile(r"[ \t\n\r\f\v\xa0]+")


#: Kinds of dropped parts: by element or role, by a name in OTHERS, a form, by another name.
ELEMENT, OTHER, FORM, NAME = 1, 2, 3, 4


class Tags:
    """The tags of a page in order, each with the text before it, in one pass."""

    def __init__(self, page: str):
        self.page, self.unended = page, set()

    def __iter__(self) -> Iterator[tuple[str, bool, str, dict[str, str], bool]]:
        """Text, whether it is an end tag, name, first value of each attribute, whether it closes itself. A name is empty where
        only text is passed on: before something dropped, and at the end of the page."""
        page, at, i = self.page, 0, 0
        while (i := page.find("<", i)) >= 0:
            closing = page.startswith("/", i + 1)
            name = OPEN.match(page, i + 1 + closing)
            if name:
                to, attributes, itself = self.attributes(name.end())
                kind = name[0].lower()
                raw = not closing and not (kind == "svg" and itself) and kind in RAW
                if raw and to < len(page):
                    to = self.after(kind, to)
                yield page[at:i], closing, "" if raw else kind, attributes, itself
            elif page.startswith("!--", i + 1):
                end = COMMENT_END.search(page, i + 2)
                to = end.end() if end else len(page)
                yield page[at:i], False, "", {}, False
            elif page.startswith(("!", "?", "/>"), i + 1):
                to = page.find(">", i + 1) + 1 or len(page)
                yield page[at:i], False, "", {}, False
            else:
                i += 1
                continue
            at = i = to
        yield page[at:], False, "", {}, False

    def attributes(self, at: int) -> tuple[int, dict[str, str], bool]:
        """The place after the tag, which is the end of the page if the tag has none."""
        page, found = self.page, {}
        while True:
            gap = BETWEEN.match(page, at)
            at = gap.end()
            if at >= len(page):
                return at, {}, False
            if page[at] == ">":
                return at + 1, found, gap[0].endswith("/")
            name = ATTRIBUTE.match(page, at)
            at, value = name.end(), ""
            equals = EQUALS.match(page, at)
            if equals:
                at = equals.end()
                quote = page[at:at + 1]
                end = -1
                if quote in ("'", '"') and quote not in self.unended:
                    end = page.find(quote, at + 1)
                    if end < 0:
                        self.unended.add(quote)
                if end >= 0:
                    at, value = end + 1, page[at + 1:end]
                else:
                    plain = UNQUOTED.match(page, at)
                    at, value = plain.end(), plain[0]
            found.setdefault(name[0].lower(), value)

    def after(self, name: str, at: int) -> int:
        """The place after the end tag of an element whose text is dropped."""
        if name in self.unended:
            return at
        end = RAW_END[name].search(self.page, at)
        if end:
            return self.page.find(">", end.end()) + 1 or len(self.page)
        self.unended.add(name)
        return len(self.page) if name in ENDING else at


def part_names(names: str, in_article: bool) -> list[str]:
    """The words of a class or id that name a part which is not the article."""
    found = []
    for name in names.lower().replace("side-bar", "sidebar").split():
        words = [w for w in SPLIT.split(name) if w]
        parts = [w for w in words if (PARTS.fullmatch(w) or WORDS.fullmatch(w)) and not (in_article and w in HEADERS)]
        alone = all(w in LAYOUT or w.isdigit() or w in HEADERS or PARTS.fullmatch(w) or WORDS.fullmatch(w) for w in words)
        found += [w for w in parts if alone or (not in_article and PARTS.fullmatch(w))]
    return found


def off_topic(name: str, attributes: dict[str, str], in_article: bool) -> int:
    """The kind of dropped part that an element may be, or 0."""
    if name == "form":
        return FORM
    if name in ASIDE or (name == "header" and not in_article):
        return ELEMENT
    if name in ("html", "body", "article", "main") or not attributes:
        return 0
    if attributes.get("role", "").strip().lower() in ROLES:
        return ELEMENT
    names = part_names(attributes.get("class", "") + " " + attributes.get("id", ""), in_article)
    if any(OTHERS.fullmatch(x) for x in names):
        return OTHER
    return NAME if names else 0


def dropped(parts: list[tuple[int, int]], main: list[int], article: list[int], weight: list[int]) -> list[bool]:
    """Whether the text of each part is dropped. `parts`: kind and the part around it, which comes before; the first is the page.
    `main`, `article`: how many are right in the part; `weight`: of its own lines."""
    main, article, weight = list(main), list(article), list(weight)
    for i in range(len(parts) - 1, 0, -1):
        kind, around = parts[i]
        if kind != ELEMENT:
            main[around] += main[i]
            article[around] += article[i] * (kind != OTHER)
            weight[around] += weight[i] * (kind == NAME)
    out = [False] * len(parts)
    for i in range(1, len(parts)):
        kind, around = parts[i]
        stays = kind != ELEMENT and (main[i] > 0 or (kind != OTHER and article[i] > 0) or (kind == NAME and 2 * weight[i] > weight[0]))
        out[i] = out[around] or not stays
    return out


def lines(page: str) -> list[tuple[str, int, bool, bool]]:
    """Text, weight, whether it is inside an article, and whether in a dropped part, of each block that has text."""
    out: list[tuple[str, int, bool, int]] = []
    stack: list[tuple[str, int, bool]] = []  # element, the part around it, article
    parts: list[str] = []
    tree, main, article, weights = [(0, 0)], [0], [0], [0]
    linked = links = articles = part = 0
    opened: Counter[str] = Counter()

    def end() -> None:
        nonlocal linked
        whole = DIGITS.sub(lambda m: "&#" + (m[1].lstrip("0")[:8] or "0"), "".join(parts))  # all such numbers are out of range
        text = WHITE.sub(" ", html.unescape(whole)).strip(" ")
        if text:
            weight = max(1, len(text) - linked) if len(text) > 1.25 * linked else 0
            weights[part] += weight
            out.append((text, weight, articles > 0, part))
        parts.clear()
        linked = 0

    def leave(n: int) -> None:
        nonlocal part, articles
        if n < len(stack):
            part = stack[n][1]
        for name, _, was_article in stack[n:]:
            articles -= was_article
            opened[name] -= 1
        del stack[n:]

    for text, closing, name, attributes, itself in Tags(page):
        if text:
            parts.append(text)
            if links:
                linked += len(WHITE.sub(" ", text))
        if not name:
            parts.append(" ")
            continue
        if name in INLINE:
            if name == "a":
                links = 0 if closing else 1
            elif name == "br":
                parts.append(" ")
            continue
        end()
        if closing:
            if opened[name]:
                leave(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
        elif name not in VOID and not itself:
            if stack and stack[-1][0] in LOOSE and (name == stack[-1][0] or stack[-1][0] == "p"):
                leave(len(stack) - 1)
            kind = off_topic(name, attributes, articles > 0)
            inside = name in ("article", "main")
            stack.append((name, part, inside))
            opened[name] += 1
            main[part] += name == "main"
            article[part] += name == "article"
            articles += inside
            if kind:
                tree.append((kind, part))
                part = len(tree) - 1
                for each in (main, article, weights):
                    each.append(0)
    end()
    off = dropped(tree, main, article, weights)
    return [(text, 0 if off[i] else weight, inside, off[i]) for text, weight, inside, i in out]


def main_text(page: str | None) -> str:
    """The article of one page."""
    found = lines(page or "")
    if not found:
        return ""
    weight = np.array([w for _, w, _, _ in found], np.int64)
    kept = np.array([not off for _, _, _, off in found], bool)
    inside = kept & np.array([a for _, _, a, _ in found], bool)
    if inside.any():
        weight = np.where(inside, weight + SURGE, 0)
    sums = np.convolve(weight, np.ones(BLOCK, np.int64))[BLOCK - 1:]  # of each line and the next ones
    between, at = np.zeros(len(found), bool), 0
    while at < len(found):
        surge = next((i for i in range(at, len(found)) if weight[i] and sums[i] >= SURGE), None)
        if surge is None:
            break
        dive = next((i for i in range(surge, len(found)) if not sums[i]), len(found))
        while surge > at and weight[surge - 1]:
            surge -= 1
        between[surge:dive] = True
        at = dive
    if between.any():
        kept &= between
    return "\n".join(text for (text, *_), keep in zip(found, kept, strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    kept = pages.select("page_id", "url", "html")
    kinds = ", ".join(f"{c} {kept.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return kept.mapInArrow(each, kinds + ", text string, n_chars long")
