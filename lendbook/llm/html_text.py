"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive, tags negative, with weights learned
from labelled pages; one linear scan finds the contiguous stretch with the greatest sum. Inside
the stretch, menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
comments are left out, and what remains is joined block by block.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled pages that the weights are learned from, at most. Labels are the pages' own: words
#: and tags inside an ``article`` or ``main`` element against those outside.
MAX_LABELLED_PAGES = 2000
WORD_LIMITS = (0.2, 4.0)
TAG_LIMITS = (-4.0, -0.01)
EDGE = -10.0
UNSEEN_TAG = -0.5

# Element names by their role in the markup language.
RAW = frozenset("script style textarea title noscript template iframe xmp noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset(
    "head nav footer aside form button select option svg math canvas object dialog menu "
    "script style textarea title noscript template iframe xmp noframes".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
CONTENT = frozenset("article main".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend "
    "li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr "
    "ul".split())
#: A start tag of the key ends open elements of these names.
CLOSES_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"}
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
              "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Where such an implied end stops looking.
SCOPE = frozenset("ul ol dl table article main section div body html blockquote".split())

# Words in class, id or role that mark a part as not the article.
_WORDS = (
    r"ads?|advert(?:s|isement|ising)?|adsense|sponsor(?:ed|s)?|promo(?:s|tion)?|banner|"
    r"nav(?:bar|igation)?|menu|breadcrumbs?|side-?bar|widgets?|footer|foot|header|masthead|"
    r"cookies?|consent|gdpr|notice|notices|notification|alert|popup|modal|overlay|newsletter|"
    r"subscribe|signup|login|search|share|sharing|social|related|recommend(?:ed|ations)?|"
    r"comments?|commentlist|disqus|replies|respond|complementary|contentinfo|pagination|pager|"
    r"toolbar|skip|hidden")
#: A token is a mark if it is such a word or a compound of one: ``site-footer`` is a footer and
#: ``share-buttons`` belong to sharing, while ``sidebar-layout`` or ``header-fixed`` are neither.
NOT_CONTENT = re.compile(
    rf"(?:[a-z0-9]+[-_]+)*(?:{_WORDS})(?:[-_]+(?:areas?|bars?|blocks?|box(?:es)?|buttons?|container|"
    r"form|icons?|inner|items?|lists?|links?|posts?|section|slots?|units?|wrap(?:per)?|[0-9]+))*", re.I)
#: Tokens that tell how a part looks or what it has, not what it is.
_STATE = re.compile(r"(?:no|not|non|has|have|with|without|is|hide|show|overflow)[-_].*", re.I)
_NOTED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|"
                     r"style\s*=\s*[\"'][^\"']*display\s*:\s*none", re.I)
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_TAG_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")


def pieces_of(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): ``text`` with the characters, ``open`` and ``close`` with a tag name.

    Comments, declarations and what stands in script, style and other raw elements are skipped.
    Broken markup never raises: a tag whose quotes do not close ends at the next bracket, and an
    angle bracket that starts no tag is text.
    """
    at, size, quotes = 0, len(page), True
    folded = None
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", "", page[at:]
            return
        if lt > at:
            yield "text", "", page[at:lt]
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = size if end < 0 else end + 1
            continue
        tag = quotes and _TAG.match(page, lt)
        if not tag:
            if page[lt + 1:lt + 2].isalpha() or page.startswith("</", lt):
                # An unclosed quote runs to the end of the page; look for one only once.
                quotes = False
            tag = _TAG_LOOSE.match(page, lt)
        if not tag:
            yield "text", "", "<"
            at = lt + 1
            continue
        at = tag.end()
        name = tag[2].lower()
        if tag[1]:
            yield "close", name, ""
            continue
        yield "open", name, tag[3]
        if name in RAW and not tag[3].endswith("/"):
            folded = page.lower() if folded is None and len(page.lower()) == size else folded
            end = (folded or page).find(f"</{name}", at)
            at = size if end < 0 else end


def marked(attributes: str) -> bool:
    """Whether the attributes say that an element is not part of the article."""
    return bool(attributes) and (
        any(NOT_CONTENT.fullmatch(token) and not _STATE.fullmatch(token)
            for a, b, c in _NOTED.findall(attributes) for token in (a or b or c).split())
        or bool(_HIDDEN.search(attributes)))


@dataclass(slots=True)
class Item:
    """One step of the sequence: a tag, or the text between two tags."""

    kind: str               # "tag", "word", "link" or "other" (text outside the article's flow)
    name: str
    text: str
    n_words: int
    inside: bool            # inside an article or main element
    skipped: bool = False   # a tag of an element whose text is left out
    article: int = 0        # number of the outermost article it is in, and of the outermost main
    main: int = 0


def sequence(page: str) -> list[Item]:
    """The page as words and tags, with text that is not content marked ``other``."""
    items: list[Item] = []
    stack: list[tuple[str, str, bool, bool]] = []       # name, skipped, inside content, in link
    # ``open_names`` saves searching the stack for elements that are not open.
    open_names: Counter = Counter()

    def top() -> tuple[str, str, bool, bool]:
        return stack[-1] if stack else ("", "", False, False)

    numbers = Counter()
    article = main = 0

    def end(name: str, stops: frozenset | None = None) -> str | None:
        """Close an element; how it was skipped, or None where there is nothing to close."""
        nonlocal article, main
        if not open_names[name]:
            return None
        for place in range(len(stack) - 1, -1, -1):
            if stack[place][0] == name:
                how = stack[place][1]
                for closed in stack[place:]:
                    open_names[closed[0]] -= 1
                del stack[place:]
                article = article if open_names["article"] else 0
                main = main if open_names["main"] else 0
                return how
            if stops and stack[place][0] in stops:
                return None
        return None

    for kind, name, rest in pieces_of(page):
        if kind == "text":
            _, skipped, inside, link = top()
            text = html.unescape(rest) if "&" in rest else rest
            count = len(text.split())
            items.append(Item("other" if skipped else "link" if link else "word",
                              "", text, count, inside, False, article, main))
            continue
        item = Item("tag", name, "", 0, top()[2] and not (kind == "close" and name in CONTENT),
                    bool(top()[1]), article, main)
        items.append(item)
        if kind == "close":
            how = end(name)
            item.skipped = item.skipped if how is None else bool(how)
            continue
        if name in CLOSES_P:
            end("p", SCOPE)
        for other in SAME_LEVEL.get(name, ()):
            end(other, SCOPE)
        if name in VOID or rest.endswith("/") and name not in BLOCKS:
            continue
        _, skipped, inside, link = top()
        # The title of an article often stands in a header of its own.
        kept_heading = skipped and inside and name in HEADINGS and stack[-1][0] == "header" \
            and not next((e[1] for e in reversed(stack) if e[0] != "header"), "")
        # What only a mark skips comes back with an article or main element of its own.
        if skipped == "mark" and name in CONTENT and not inside:
            skipped = ""
        if name in SKIPPED or name == "header":
            skipped = "element"
        elif not skipped and rest and name not in CONTENT and name not in ("html", "body") \
                and marked(rest):
            skipped = "mark"
        item.skipped = bool(skipped) and not kept_heading
        if name in CONTENT and not skipped:
            numbers[name] += 1
            article = article or numbers[name] if name == "article" else article
            main = main or numbers[name] if name == "main" else main
        stack.append((name, "" if kept_heading else skipped,
                      inside or name in CONTENT, link or name == "a"))
        open_names[name] += 1
    return items


@dataclass(frozen=True)
class Weights:
    """Scores of words by kind and of tags by name."""

    words: dict[str, float]
    tags: dict[str, float]

    def of(self, item: Item) -> float:
        if item.kind == "tag":
            return self.tags.get(item.name, UNSEEN_TAG)
        return item.n_words * self.words.get(item.kind, 0.0)


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end (exclusive) of the contiguous stretch with the greatest positive sum.

    One pass; of equal sums the first stretch is taken, and the longest one starting there is
    not needed because tags at its end only lower the sum. Nothing positive: an empty stretch.
    """
    best, best_start, best_end = 0.0, 0, 0
    total, start = 0.0, 0
    for place, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, place
        total += score
        if total > best:
            best, best_start, best_end = total, start, place + 1
    return best_start, best_end


def scores_of(items: list[Item], weights: Weights) -> list[float]:
    """The scores of a page's items.

    Text that is left out scores nothing, and nor do the tags around it, so that it does not part
    what stands before it from what follows. Only before and after the article or main element of
    a page do such tags count: there they part the article from the rest.
    """
    framed = any(item.article or item.main for item in items)
    return [0.0 if item.skipped and (item.inside or not framed) else weights.of(item)
            for item in items]


def whole_content(items: list[Item], start: int, end: int) -> tuple[int, int]:
    """The stretch, with the articles at its ends whole; a main without articles counts as one."""
    with_articles = {item.main for item in items if item.article}

    def owner(item: Item) -> tuple[int, int]:
        return (item.article, 0) if item.article else (
            0, 0 if item.main in with_articles else item.main)

    first, last = owner(items[start]), owner(items[end - 1])
    while any(first) and start > 0 and owner(items[start - 1]) == first:
        start -= 1
    while any(last) and end < len(items) and owner(items[end]) == last:
        end += 1
    return start, end


def main_text(page: str | None, weights: Weights) -> str:
    """The article of a page; empty for null, empty and content-free pages.

    White space inside a block becomes one space; blocks are joined by one newline in page order.
    """
    if not page:
        return ""
    items = sequence(page)
    start, end = best_region(scores_of(items, weights))
    if start == end:
        return ""
    start, end = whole_content(items, start, end)
    # A block is taken whole: a link at its edge must not cut it.
    while start > 0 and not (items[start].kind == "tag" and items[start].name in BLOCKS):
        start -= 1
    while end < len(items) and not (items[end].kind == "tag" and items[end].name in BLOCKS):
        end += 1
    blocks, current = [], []
    for item in items[start:end]:
        if item.kind == "tag":
            if item.name in BLOCKS:
                blocks.append(current)
                current = []
            elif item.name == "br":
                current.append(" ")
        elif item.kind != "other":
            current.append(item.text)
    blocks.append(current)
    joined = (" ".join("".join(block).split()) for block in blocks)
    return "\n".join(block for block in joined if block)


def token_counts(page: str) -> Counter:
    """Words by kind and tags by name, inside and outside of content, of one labelled page."""
    counts: Counter = Counter()
    for item in sequence(page):
        name = f"tag:{item.name}" if item.kind == "tag" else f"words:{item.kind}"
        counts[name, item.inside] += 1 if item.kind == "tag" else item.n_words
    return counts


def weights_from(counts: dict[tuple[str, bool], int]) -> Weights:
    """Log odds of standing inside content; words are held positive and tags negative."""
    inside = sum(n for (_, is_in), n in counts.items() if is_in) + 1
    outside = sum(n for (_, is_in), n in counts.items() if not is_in) + 1
    words, tags = {"word": 1.0, "link": WORD_LIMITS[0], "other": 0.0}, {}
    for name in {name for name, _ in counts}:
        odds = math.log((counts.get((name, True), 0) + 0.5) / inside) \
            - math.log((counts.get((name, False), 0) + 0.5) / outside)
        kind, _, label = name.partition(":")
        if kind == "tag":
            tags[label] = min(TAG_LIMITS[1], max(TAG_LIMITS[0], odds))
        elif label != "other":
            words[label] = max(WORD_LIMITS[0], min(WORD_LIMITS[1], odds))
    for name in CONTENT:            # the edges of content themselves
        tags[name] = EDGE
    return Weights(words, tags)


def learn(pages: DataFrame, html_col: str = "html", id_col: str = "page_id",
          max_pages: int = MAX_LABELLED_PAGES) -> Weights:
    """Weights from at most ``max_pages`` pages with an article or main element.

    The pages with the lowest hash of their id are taken, so the sample does not depend on how
    the table is dealt out. Without labelled pages, plain weights are used.
    """
    labelled = pages.where(F.col(html_col).rlike(r"(?i)<(?:article|main)[\s>]")).select(
        F.col(id_col).alias("_id"))
    sample = labelled.orderBy(F.xxhash64("_id"), "_id").limit(max_pages).distinct()
    schema = "name string, inside boolean, n bigint"

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for page in batch.column(0):
                if page.is_valid:
                    counts.update(token_counts(page.as_py()))
        rows = [(name, inside, n) for (name, inside), n in counts.items()]
        columns = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.bool_()),
             pa.array(columns[2], pa.int64())], names=["name", "inside", "n"])

    chosen = pages.join(sample, F.col(id_col).eqNullSafe(F.col("_id")), "left_semi").select(
        html_col)
    totals = chosen.mapInArrow(counted, schema).groupBy("name", "inside").agg(
        F.sum("n").alias("n"))
    # One row per tag name of the sample; names beyond the standard ones share "other tags".
    known = totals.where(F.col("n") >= 2).collect()
    return weights_from({(row["name"], row["inside"]): row["n"] for row in known})


def extracted(page: Column, weights: Weights) -> Column:
    """The main text of an html column."""

    @F.arrow_udf("string")
    def texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield pa.array([main_text(page.as_py(), weights) for page in pages], pa.string())

    return texts(page)


def extract(pages: DataFrame, weights: Weights | None = None, html_col: str = "html",
            into: str = "text") -> DataFrame:
    """Add the main text of every page.

    Null and empty pages give an empty text. Rows pass through one by one: repeated rows, null
    ids and other columns stay, and ``into`` replaces a column of its name. Without ``weights``
    they are learned from the pages themselves; an empty table needs none.
    """
    return pages.withColumn(into, extracted(F.col(html_col), weights or learn(pages, html_col)))
