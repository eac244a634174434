"""Main text of HTML pages by maximum-scoring subsequence.

A page is a sequence of tags and words. Words score positive and tags negative, with weights by kind of tag and by the
element a word stands in, learned from labelled pages; one linear scan finds the contiguous region with the largest
sum. Inside the region, elements that never are article text (scripts, forms, menus ...) are left out, and so are those whose
class or id is a word with a negative weight (adverts, comments ...). Such a word is a kind of its own: the list below gives
it a prior only, labelled pages can turn it. Words on an element around the article itself say nothing.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.frames import arrow_map

#: Labelled pages that a fit of the weights takes at most.
MAX_FIT_PAGES = 2000

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*+)>|<[!?][^>]*>|[^<]+|<""", re.DOTALL
)
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "xmp", "noembed", "object"}
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
BLOCK = {
    "p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot",
    "tr", "td", "th", "caption", "blockquote", "pre", "figure", "figcaption", "section", "article", "main", "header",
    "footer", "nav", "aside", "form", "fieldset", "address", "hr", "body", "html", "head", "details", "summary", "center",
}
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
CONTENT = {"article", "main"}
#: Elements whose words are no article text wherever they stand.
APART = {"nav", "aside", "footer", "form", "button", "select", "menu", "dialog", "head", "fieldset", "label", "option"}
ROLES = {"navigation", "banner", "complementary", "contentinfo", "search", "dialog", "alert", "menu", "menubar", "alertdialog"}
#: Words in class or id that get a weight of their own; each starts from the prior of names.
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "sidebar", "nav", "navbar", "navigation",
    "menu", "breadcrumb", "breadcrumbs", "footer", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal",
    "overlay", "newsletter", "subscribe", "subscription", "signup", "share", "sharing", "social", "related", "recommended",
    "recommendations", "promo", "promotion", "sponsored", "sponsor", "comment", "comments", "commentlist", "reply", "replies",
    "disqus", "respond", "widget", "toolbar", "pagination", "pager", "login", "search", "skip", "hidden", "alert", "masthead",
}
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
SPLIT = re.compile(r"[^a-z0-9]+")

#: Counts inside and outside the article that stand for pages no sample shows; they fade as labelled pages come in.
PRIOR = {
    "word:p": (40, 4), "word:heading": (12, 4), "word:item": (8, 8), "word:link": (2, 12), "word:apart": (1, 60), "word:other": (10, 6),
    "tag:p": (20, 2), "tag:heading": (6, 2), "tag:inline": (20, 4), "tag:item": (4, 8), "tag:link": (2, 10), "tag:block": (4, 8),
    "tag:apart": (1, 30), "tag:content": (2, 2), "word:name": (1, 20), "tag:name": (1, 10),
}

#: What a run of words in an element that is left out costs at most, and each of its tags.
APART_COST = 1.0
#: An element with more than this share of the page's words (a fraction) is a wrapper, whatever it is called.
WRAPPER = (4, 5)

Weights = dict[str, float]


def _apart(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is apart; ``inside``: it stands in an article, where a header may hold the title."""
    if tag in APART or tag == "header" and not inside:
        return True
    if not attributes or tag in ("html", "body") or tag in CONTENT:
        return False
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True
        if name == "role" and value in ROLES:
            return True
    return False


def _name(tag: str, attributes: str, inside: bool) -> str | None:
    """The first word of class or id that is a name; ``inside``: in an article a header may hold the title."""
    if not attributes or tag in ("html", "body") or tag in CONTENT:
        return None
    for name, value in ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id"):
            for word in SPLIT.split(value.strip("\"'").lower()):
                if word in NAMES or word == "header" and not inside:
                    return word
    return None


def parse(page: str) -> list[tuple[str, str, int, int]]:
    """The page as (kind, text, block, content) in order. Kinds are tag: and word: keys of the weights; ``text`` is the
    raw text of word runs; ``block`` counts the blocks; ``content`` numbers the article or main element around, or -1."""
    out: list[tuple[str, str, int, int]] = []
    stack: list[tuple[str, bool, int, tuple[int, ...]]] = []  # tag, apart, content number, named elements around
    names_of: list[tuple[int, ...]] = []  # per token
    called: list[str] = []  # the name of each named element
    around_content: set[int] = set()
    block = contents = 0
    named: tuple[int, ...] = ()
    scan = TOKEN.scanner(page)
    apart, content = False, -1
    while found := scan.match():
        tag = found[2]
        if tag is None:
            text = found[0]
            if text[0] == "<" and len(text) > 1:
                continue  # a comment or declaration
            if text.isspace():
                if out and out[-1][0].startswith("word:") and out[-1][2] == block:
                    out.append((out[-1][0], text, block, content))
                    names_of.append(names_of[-1])
                continue
            names = [x[0] for x in reversed(stack)]
            kind = "other"
            if apart:
                kind = "apart"
            elif "a" in names:
                kind = "link"
            else:
                for x in names:
                    if x in HEADING:
                        kind = "heading"
                    elif x in ("li", "dt", "dd", "td", "th"):
                        kind = "item"
                    elif x in ("p", "pre", "blockquote"):
                        kind = "p"
                    else:
                        continue
                    break
            out.append((f"word:{kind}", text, block, content))
            names_of.append(named)
            continue
        tag, closing = tag.lower(), bool(found[1])
        is_block = tag in BLOCK
        block += is_block
        if closing:
            if any(x[0] == tag for x in stack):
                while stack.pop()[0] != tag:
                    pass
        elif tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.IGNORECASE).search(page, found.end())
            scan = TOKEN.scanner(page, end.end() if end else len(page))
            continue
        elif tag not in VOID and not found[3].endswith("/"):
            ends = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}.get(tag)
            if is_block and ends is None:
                ends = {"p"}
            if ends:
                stop = {"table", "ul", "ol", "dl", "div", "section", "article", "main", "blockquote"} - ends
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in ends:
                        del stack[i:]
                        break
                    if stack[i][0] in stop:
                        break
            inside = bool(stack) and stack[-1][2] >= 0
            around = stack[-1] if stack else ("", False, -1, ())
            number, own = around[2], around[3]
            if tag in CONTENT:
                around_content.update(own)
                if number < 0:
                    number, contents = contents, contents + 1
            name = _name(tag, found[3], inside)
            if name:
                own += (len(called),)
                called.append(name)
            stack.append((tag, around[1] or _apart(tag, found[3], inside), number, own))
        apart, content, named = stack[-1][1:] if stack else (False, -1, ())
        if apart:
            kind = "apart"
        elif tag in CONTENT:
            kind = "content"
        elif tag in HEADING:
            kind = "heading"
        elif tag == "a":
            kind = "link"
        elif tag == "p":
            kind = "p"
        elif tag in ("li", "ul", "ol", "dl", "dt", "dd", "td", "th", "tr", "table"):
            kind = "item"
        else:
            kind = "block" if is_block else "inline"
        out.append((f"tag:{kind}", " " if tag == "br" else "", block, content))
        names_of.append(named)
    if not called:
        return out
    # words of each named element, and of the page
    words = [len(text.split()) if kind[0] == "w" and kind != "word:apart" else 0 for kind, text, *_ in out]
    held = [0] * len(called)
    for n, own in zip(words, names_of):
        for i in own:
            held[i] += n
    most = sum(words) * WRAPPER[0]
    counts = {i for i in range(len(called)) if i not in around_content and held[i] * WRAPPER[1] <= most}
    for at, own in enumerate(names_of):
        first = next((i for i in own if i in counts), None)
        if first is not None and not out[at][0].endswith("apart"):
            out[at] = (f"{out[at][0].split(':')[0]}:name.{called[first]}", *out[at][1:])
    return out


def _weight(weights: Weights, kind: str) -> float:
    """The weight of a kind; names that no labelled page has share one."""
    found = weights.get(kind)
    return found if found is not None else weights.get(kind.split(".")[0], 0.0)


def _left_out(weights: Weights, kind: str) -> bool:
    """Whether words of this kind (or of the element of this tag) are no text: apart, or in an element with a negative name."""
    place = kind.split(":")[1]
    return place == "apart" or place.startswith("name") and _weight(weights, f"word:{place}") < 0


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end (exclusive) of the contiguous part with the largest sum: the first such, as short as it can be;
    (0, 0) when no score is positive."""
    best = total = 0.0
    start, region = 0, (0, 0)
    for i, x in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += x
        if total > best:
            best, region = total, (start, i + 1)
    return region


def extract_text(page: str | None, weights: Weights) -> str:
    """The main text: blocks in page order, joined by two newlines; empty if there is none."""
    tokens = parse(page or "")
    scores = [_weight(weights, kind) * (len(text.split()) if kind[0] == "w" else 1) for kind, text, _, _ in tokens]
    gone = {kind: _left_out(weights, kind) for kind in {t[0] for t in tokens}}
    # such words never reach the text, so a run of them may cost a region no more than a gap
    scores = [max(x, -APART_COST) if gone[kind] else x for x, (kind, *_) in zip(scores, tokens)]
    first, end = best_region(scores)
    if first == end:
        return ""
    inside = {content for kind, text, _, content in tokens[first:end] if kind[0] == "w" and not gone[kind]}
    if len(inside) == 1 and -1 not in inside:
        # the whole region lies in one article element: its ends are the element's
        chosen = [t for t in tokens if t[3] in inside]
    else:
        blocks = {block for kind, _, block, _ in tokens[first:end] if kind[0] == "w"}
        chosen = [t for t in tokens if t[2] in blocks]
    parts: dict[int, list[str]] = {}
    for kind, text, block, _ in chosen:
        if kind[0] == "w" and not gone[kind]:
            parts.setdefault(block, []).append(entities.unescape(text))
        elif text == " " and block in parts:
            parts[block].append(text)  # a line break inside a block
    made = (" ".join("".join(x).split()) for x in parts.values())
    return "\n\n".join(x for x in made if x)


def weights_from(counts: dict[str, tuple[float, float]]) -> Weights:
    """Log-ratios of how often a kind stands inside and outside articles. Tags never score above -0.05."""
    prior = lambda k: PRIOR.get(k, PRIOR.get(k.split(".")[0], (1, 1)))
    total = {k: tuple(x + y for x, y in zip(prior(k), counts.get(k, (0, 0)))) for k in PRIOR | counts}
    out = {}
    for kind, (a, b) in total.items():
        ratio = max(-4.0, min(2.0, math.log(a / b)))
        out[kind] = min(ratio, -0.05) if kind.startswith("tag:") else ratio
    return out


def count_labelled(page: str | None) -> dict[str, list[int]]:
    """Inside and outside counts per kind of a page whose article is marked; none for other pages."""
    tokens = parse(page or "")
    if not any(content >= 0 for *_, content in tokens):
        return {}
    counts: dict[str, list[int]] = {}
    for kind, text, _, content in tokens:
        pair = counts.setdefault(kind, [0, 0])
        pair[0 if content >= 0 and not kind.endswith("apart") else 1] += len(text.split()) if kind[0] == "w" else 1
    return counts


def fit_weights(pages: DataFrame, id_column: str = "page_id", html: str = "html", max_pages: int = MAX_FIT_PAGES) -> Weights:
    """Weights from labelled pages: those that mark their article with an article or main element. At most
    ``max_pages`` pages take part, smallest hashes of the id first; without any, the prior counts alone decide."""
    marked = pages.where(F.col(id_column).isNotNull() & F.col(html).rlike("(?i)<(article|main)[\\s>]")).select(id_column).distinct()
    # ids first: the one task that merges the smallest hashes then reads no pages
    chosen = marked.orderBy(F.xxhash64(id_column), id_column).limit(max_pages)
    some = pages.join(F.broadcast(chosen), id_column, "left_semi")

    def each(batch: pa.RecordBatch):
        total: dict[str, list[int]] = {}
        for page in batch.column(0).to_pylist():
            for kind, pair in count_labelled(page).items():
                own = total.setdefault(kind, [0, 0])
                own[0] += pair[0]
                own[1] += pair[1]
        yield {"kind": pa.array(list(total), pa.string()), "inside": pa.array([x[0] for x in total.values()], pa.int64()), "outside": pa.array([x[1] for x in total.values()], pa.int64())}

    counts = arrow_map(some, [html], each, "kind string, inside long, outside long")
    rows = counts.groupBy("kind").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).collect()
    return weights_from({r["kind"]: (r["inside"], r["outside"]) for r in rows})


def extract(pages: DataFrame, weights: Weights, html: str = "html", text: str = "text") -> DataFrame:
    """All columns of ``pages`` but ``html``, with ``text`` (a column of that name is replaced) in its place. Null and
    empty pages have empty texts; repeated rows stay."""
    kept = [f for f in pages.schema if f.name not in (html, text)]

    def each(batch: pa.RecordBatch):
        made = [extract_text(x, weights) for x in batch.column(len(kept)).to_pylist()]
        yield {f.name: batch.column(i) for i, f in enumerate(kept)} | {text: pa.array(made, pa.string())}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + (", " if kept else "") + f"`{text}` string"
    return arrow_map(pages, [f.name for f in kept] + [html], each, schema)
