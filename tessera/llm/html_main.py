"""Main text of HTML pages by tag-path ratios.

A page is cut into text blocks; every block has the path of block-level tags
from the root (a tag keeps its first class or id, inline tags are left out).
Per distinct path, over all its blocks:

* text ratio: characters outside links per block;
* punctuation ratio: sentence marks per block.

Both are smoothed over the paths in page order (a Gaussian window) and fused by
multiplication.  Tags and class words weigh in: paths inside elements that are
named as no part of an article (menus, page headers, footers, sidebars, notices,
adverts, reader comments) count for little, paths inside ``article`` or ``main``
for more.  The paths at or above the threshold (a share of the fused values'
standard deviation) are content; the article is the innermost element that holds
them all, and its siblings that hold blocks of the same kind.  The element's other blocks (headings, short paragraphs, lists)
belong to it unless an element of the named kinds holds them; blocks that are
mostly links belong to it inside ``article`` or ``main`` or between content.
Forms, scripts, styles and hidden elements are never read.

Defined results: null, empty and text-free pages give an empty text, and so do
pages of which all text is in elements of the named kinds; broken
markup is read to its end (an open comment or script runs to the end of the
page); null ids and urls are carried; repeated rows give equal rows; further
columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: HTML element names by role
RAW = frozenset("script style noscript template textarea title svg iframe object xmp noembed noframes annotation "
                "annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("html body address article aside blockquote center details dialog dd div dl dt fieldset "
                  "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup li main menu nav ol p pre "
                  "search section summary table caption thead tbody tfoot tr td th ul head hr".split())
NEVER = frozenset("head form button select option datalist audio video canvas map".split())
ASIDE = frozenset("nav footer aside dialog menu search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
HOLDERS = frozenset("# html body div section article main center td details form".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar "
                  "toolbar".split())
#: Words of a class or id that mark what is not the article.
NOT_ARTICLE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adbox|banner\d*|promo\w*|sponsor\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|"
    r"side|rail|widgets?|footer\w*|foot|copyright|masthead|topbar|toolbar|cookies?|consent|gdpr|notices?|alert\w*|"
    r"notification\w*|popup\w*|modal\w*|overlay|newsletter|subscribe|subscription|signup|login|search\w*|comments?|"
    r"commentlist|comment\w*|respond|replies|reply|disqus\w*|discussion|feedback|share\w*|sharing|social\w*|"
    r"related(?![\s_-]?works?\b)\w*|"
    r"recommend\w*|teasers?|pagination|pager|paginator|tags|tagcloud|toc|skip|print|hidden)(?:$|[\s_-])", re.IGNORECASE)
HEADER_WORD = re.compile(r"(?:^|\s)(?:(?:site|page|main|global)[_-]?)?(?:header|top)(?:$|\s)", re.IGNORECASE)

_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^"'<>]|"[^"]*"|'[^']*')*)>""")
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_MARKS = re.compile(r"[.,;:!?…。，、！？；：]")
SIGMA = 0.6
THRESHOLD = 0.5
MOST_LINKS = 0.6
#: Weights of paths inside elements that are named as no article, and inside an article.
NAMED_OTHER, NAMED_ARTICLE = 1e-6, 10.0


def _attrs(raw: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTR.finditer(raw)} if raw and not raw.isspace() else {}


def blocks(page: str) -> list[list]:
    """``[path, text, linked characters, named as no article, numbers of the
    path's elements]`` of the text blocks, in page order."""
    out = []
    stack: list[tuple[str, str, bool, bool, int]] = []  # tag, path element, never read, named as no article, number
    text, linked, link = [], [], 0
    dropped = other = 0
    at, n = 0, len(page)

    def flush():
        nonlocal text, linked
        if text:
            one = " ".join(html_lib.unescape("".join(text)).split())
            if one:
                links = len(" ".join(html_lib.unescape("".join(linked)).split()))
                out.append([("#", *(x[1] for x in stack if x[0] in BLOCK)), one, links, other > 0,
                            (-1, *(x[4] for x in stack if x[0] in BLOCK))])
        text, linked = [], []

    def pop(k: int):
        nonlocal dropped, other, link
        for t, _, d, o, _ in stack[k:]:
            dropped -= d
            other -= o
            link -= t == "a"
        del stack[k:]

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and not dropped:
            text.append(page[at:lt])
            if link:
                linked.append(page[at:lt])
        if lt == n:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        m = _TAG.match(page, lt)
        if not m:
            nxt = page[lt + 1:lt + 2]
            if nxt in ("!", "?", "/") or nxt.isalpha():
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:  # a plain "<"
                if not dropped:
                    text.append("<")
                at = lt + 1
            continue
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if tag == "br" and not dropped:
                text.append(" ")
                continue
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), -1)
            if k < 0:
                if tag in BLOCK and not dropped:
                    flush()
                continue
            if tag not in BLOCK and any(x[0] in BLOCK for x in stack[k + 1:]):
                pop_one = stack[k]  # an inline end tag closes only itself
                dropped -= pop_one[2]
                link -= tag == "a"
                del stack[k]
                continue
            if tag in BLOCK:
                flush()
            pop(k)
            continue
        if tag in VOID:
            if not dropped:
                if tag == "hr":
                    flush()
                elif tag == "br":
                    text.append(" ")
            continue
        attrs = _attrs(m[3])
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, at)
            at = n if end is None else end.end()
            continue
        if tag in BLOCK:
            flush()
            if tag not in ("html", "body"):
                k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in BLOCK), -1)
                if k >= 0 and (stack[k][0] == "p" or stack[k][0] in CLOSES.get(tag, ()) or stack[k][0] in HEADINGS and tag in HEADINGS):
                    keep = [x for x in stack[k + 1:] if x[0] not in BLOCK and x[0] != "a" and not x[2]]
                    pop(k)
                    stack.extend(keep)
        names = " ".join(attrs.get(a, "") for a in ("class", "id")).strip()

        def within(*tags):
            return any(x[0] in tags for x in stack)
        named = bool(names) and tag not in ("html", "body", "article", "main") and bool(NOT_ARTICLE.search(names))
        drop = tag not in ("html", "body") and (
            tag in NEVER or "hidden" in attrs or attrs.get("aria-hidden") == "true"
            or "display:none" in attrs.get("style", "").replace(" ", "").lower()
            or tag not in BLOCK and named and not within("pre", "code"))  # in code such words name its parts
        aside = tag in BLOCK and tag not in ("html", "body") and (
            named or tag in ASIDE or attrs.get("role", "").lower() in ROLES
            or tag == "article" and bool(re.search(r"comment|repl(?:y|ies)|teaser|related|promo|ad\b", names, re.IGNORECASE))
            or (tag == "header" or bool(names) and tag not in HEADINGS and tag not in ("main", "article")
                and bool(HEADER_WORD.search(names))) and not within("article", "main"))
        if m[3].endswith("/") and tag not in BLOCK:
            continue
        stack.append((tag, f"{tag}.{names.split()[0]}" if names else tag, drop, aside, lt))
        other += aside
        dropped += drop
        link += tag == "a"
    flush()
    return out


def smooth(values: list[float]) -> list[float]:
    reach = math.ceil(2 * SIGMA)
    kernel = [math.exp(-d * d / (2 * SIGMA * SIGMA)) for d in range(reach + 1)]
    out = []
    for i in range(len(values)):
        near = [(kernel[abs(d)], values[i + d]) for d in range(-reach, reach + 1) if 0 <= i + d < len(values)]
        out.append(sum(k * v for k, v in near) / sum(k for k, _ in near))
    return out


def is_article(element: str) -> bool:
    return element.split(".")[0] in ("article", "main")


def content_paths(found: list[list]) -> set:
    """Paths whose smoothed, fused and weighted ratios reach the threshold."""
    size: dict = {}
    for path, text, linked, other, _ in found:
        s = size.setdefault(path, [0, 0, 0, 1.0])
        s[0] += len(text) - linked
        s[1] += len(_MARKS.findall(text))
        s[2] += 1
        s[3] = NAMED_OTHER if other else NAMED_ARTICLE if any(map(is_article, path)) else 1.0
    paths = list(size)
    text_ratio = smooth([size[p][0] / size[p][2] for p in paths])
    mark_ratio = smooth([(size[p][1] + 1) / size[p][2] for p in paths])
    fused = [t * m * size[p][0] * size[p][3] for t, m, p in zip(text_ratio, mark_ratio, paths)]
    mean = sum(fused) / len(fused)
    spread = math.sqrt(sum((f - mean) ** 2 for f in fused) / len(fused))
    limit = min(THRESHOLD * max(spread, mean), max(fused))
    return {p for p, f in zip(paths, fused) if f >= limit}


def article_root(chosen: set, found: list[list]) -> tuple[tuple, tuple]:
    """Path and element numbers of the innermost element that holds all blocks
    of content paths, or of the parent that holds siblings of the same kind."""
    path = root = None
    for b in found:
        if b[0] in chosen:
            k = len(b[0]) - (b[0][-1].split(".")[0] not in HOLDERS)
            if root is None:
                path, root = b[0][:k], b[4][:k]
            k = next((i for i, (x, y) in enumerate(zip(root, b[4][:k])) if x != y), min(len(root), k))
            path, root = path[:k], root[:k]
    for k, e in enumerate(path):  # an article or main element holds its blocks, however deep the text is
        if is_article(e):
            return path[:k + 1], root[:k + 1]
    kinds = {p[-1].split(".")[0] for p in chosen} - HOLDERS
    while len(path) > 1 and path[-2].split(".")[0] not in ("#", "html", "body"):
        up = root[:-1]
        more = [b for b in found if not b[3] and b[4][:len(up)] == up and b[4][:len(root)] != root]
        if not all(k in HEADINGS or k in kinds and len(b[0]) > len(path) and b[2] < MOST_LINKS * len(b[1])
                   for b in more for k in [b[0][-1].split(".")[0]]):
            break
        path, root = path[:-1], up
    return path, root


def main_text(page: str | None) -> str:
    found = blocks(page) if page else []
    if all(b[3] for b in found):
        return ""
    chosen = content_paths(found)
    path, root = article_root(chosen, found)
    held = [b for b in found if b[4][:len(root)] == root and (b[0] in chosen or not b[3])]
    if not any(map(is_article, path)):  # links around the content are the page's
        at = [i for i, b in enumerate(held) if b[0] in chosen]
        held = [b for i, b in enumerate(held) if at[0] <= i <= at[-1] or b[2] < MOST_LINKS * len(b[1])]
    return "\n\n".join(b[1] for b in held)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, ``text`` and ``n_chars``."""
    def run(batches):
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[id_col, url_col, "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias(id_col), F.col(url_col).cast("string").alias(url_col),
                        F.col(html_col).alias("html")).mapInArrow(
        run, f"`{id_col}` long, `{url_col}` string, text string, n_chars long")
