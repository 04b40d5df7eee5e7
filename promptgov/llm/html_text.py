"""Main text of web pages by maximum-scoring subsequence.

A page becomes a sequence of tokens: words and tags. Words score by where they stand (plain
text, links, headings, parts whose names speak of menus or adverts, ...), tags score negative
by kind. A linear scan finds the contiguous region with the best sum, which is where running
text is dense and mark-up thin. Weights are log-odds of a naive Bayes fit on labelled pages:
pages that mark their article themselves, a bounded sample of them. Priors stand in where a
feature was not seen, so that a corpus without labelled pages has weights as well.

Inside the region, parts that are not the article's text (menus, asides, forms, adverts,
comments, scripts) are left out again. Blocks are joined by an empty line.

Defined results: null and empty pages give an empty text; a tag cut off by the end of the page
ends it; unclosed elements end with the page or where HTML ends them; repeated rows give
repeated results; other columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptgov.llm.common import bottom_sample

# Element names of HTML by what they mean here.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre search section "
    "summary table tbody tfoot thead tr ul".split())
SPACED = frozenset("br td th wbr img input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset(
    "head nav footer aside form button select dialog menu svg canvas object audio video map datalist "
    "fieldset label input textarea search script style noscript iframe template title xmp noembed noframes".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
CLOSES_P = BLOCK - {"body", "html", "caption", "tbody", "tfoot", "thead", "tr", "option", "optgroup"}
SIBLINGS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"),
    "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tr", "td", "th", "tbody", "thead"),
}
SCOPE = frozenset("table article main section div ul ol dl body html aside nav footer header form td th".split())
#: Words in class, id or role that speak against the text of a part.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promos promotion "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar topbar masthead header footer "
    "contentinfo sidebar sidebars aside complementary widget widgets related recommended recommendations teaser "
    "teasers comment comments commentlist respond reply replies disqus notice notices alert cookie cookies consent "
    "gdpr banner popup modal overlay newsletter subscribe subscription signup login share sharing social follow "
    "form search skip legal copyright disclaimer tagcloud hidden".split())
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
TAG = re.compile(
    r"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    # A quote opens a value only after an equals sign; other values end at white space.
    r"|<(/?)([A-Za-z][^\s/>]*)((?>[^>=]+|=\s*(?>\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*|))*)(>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""(?:^|[\s"'/])(class|id|role|aria-label|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/"']|$)""", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
CLOSING = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
ARTICLE = re.compile(r"<(?:article|main)[\s>]", re.I)

#: Labelled pages on which weights are fitted.
SAMPLE_PAGES = 2000
#: Scores of one word or tag before anything is learned, and how many tokens they count for.
PRIOR = {
    "word": 1.0, "word:link": -1.0, "word:heading": 0.6, "word:dropped": -1.0, "word:outside": -3.0, "word:named": -1.0,
    "tag:text": -0.1, "tag:block": -0.4, "tag:link": -0.6, "tag:other": -0.8,
}
PRIOR_TOKENS, LARGEST = 200.0, 3.0
TEXT_TAGS = frozenset("p br b i em strong span u s sub sup code q cite small mark h1 h2 h3 h4 h5 h6 blockquote".split())


@dataclass
class Piece:
    """A run of words in one place, or a tag, with its feature."""

    feature: str
    words: int = 0
    text: str = ""
    block: int = 0
    inside: bool = False  # in an article or main element
    dropped: bool = False
    part: int = -1  # the innermost named part around
    named: float = 0.0  # how strongly names speak against it


@dataclass
class Page:
    pieces: list[Piece] = field(default_factory=list)
    marked: bool = False


@dataclass
class Part:
    """An element whose class, id or role has words of NAMES."""

    strength: float  # how much of a name such words are, 1 at most
    plain: bool  # no name has other words as well
    around: int  # the next such element around it, or -1
    words: int = 0  # of running text
    holds: bool = False  # an article that does not name itself so, or a main element


def hidden(attributes: str) -> bool:
    return bool(HIDDEN.search(attributes)) or any(
        n.lower() == "hidden" or n.lower() == "aria-hidden" and (a or b or c).lower() == "true"
        for n, a, b, c in ATTRIBUTE.findall(attributes))


def names_of(tag: str, attributes: str) -> list[tuple[str, list[str]]]:
    """(attribute, words) of each class, id and role. Ids of headings are made from their texts."""
    found = [(n.lower(), a or b or c) for n, a, b, c in ATTRIBUTE.findall(attributes)]
    return [(n, words) for n, value in found if n in ("class", "role", "id") and not (n == "id" and tag in HEADING)
            for v in value.split() if (words := WORD.findall(CAMEL.sub("-", v).lower()))]


def named_part(tag: str, attributes: str, around: int) -> Part | None:
    """What an element's names say against its text. A class or role of two words needs one, an id both."""
    strength, plain = 0.0, False
    for name, words in names_of(tag, attributes):
        share = sum(w in NAMES for w in words) / len(words)
        strength = max(strength, share if name == "id" else min(1.0, 2 * share))
        plain |= share == 1
    return Part(strength, plain, around) if strength else None


def names_itself(attributes: str) -> bool:
    """Whether an article has a class or role that begins with such a name: a comment, a teaser."""
    return any(words[0] in NAMES for name, words in names_of("article", attributes) if name != "id")


def tokens(source: str) -> Page:
    """Words and tags of a page, with where they stand."""
    page, stack, block, at = Page(), [], 0, 0
    parts, part, articles, article = [], -1, [], -1
    within: list[int] = []  # per piece, the innermost article
    pieces = page.pieces
    dropped = links = headings = 0
    limit = len(source)
    open_at: dict[str, list[int]] = defaultdict(list)  # where on the stack each name is
    highest = lambda names: max((open_at[n][-1] for n in names if open_at[n]), default=-1)

    def text(raw: str) -> None:
        nonlocal block
        words = len(raw.split())
        if not words and not raw:
            return
        kind = ("word:dropped" if dropped else "word:link" if links else "word:heading" if headings else "word")
        pieces.append(Piece(kind, words, raw, block, False, dropped > 0, part))
        within.append(article)

    def leave(upto: int) -> None:
        nonlocal dropped, links, headings, part, article, block
        while len(stack) > upto:
            name, drop, part, article = stack.pop()
            open_at[name].pop()
            dropped -= drop
            links -= name == "a"
            headings -= name in HEADING
            block += name in BLOCK

    def close(names, scope=SCOPE) -> None:
        """Leave the innermost element of these names, unless one of the scope is further in."""
        own = highest(names)
        if own >= 0 and own >= highest(scope):
            leave(own)

    while at < limit:
        found = TAG.search(source, at)
        if not found:
            text(html.unescape(source[at:]))
            break
        if found.start() > at:
            text(html.unescape(source[at:found.start()]))
        at, (slash, name, attributes, ended) = found.end(), found.groups()
        if not name:
            continue
        if not ended:
            break
        name = name.lower()
        group = "tag:text" if name in TEXT_TAGS else "tag:link" if name == "a" else (
            "tag:block" if name in BLOCK else "tag:other")
        pieces.append(Piece(group, dropped=dropped > 0 or name in DROPPED, block=block, part=part))
        within.append(article)
        if slash:
            if name == "p" and not open_at["p"]:
                block += 1
            close((name,), frozenset() if name in SCOPE else SCOPE)
            block += name in BLOCK
            continue
        if name in CLOSES_P:
            close(("p",))
        if name in SIBLINGS:
            close(SIBLINGS[name], frozenset(("table", "ul", "ol", "dl", "select")))
        if name == "a":
            close(("a",))
        block += name in BLOCK
        if name in SPACED:
            pieces.append(Piece("word", 0, " ", block, False, dropped > 0, part))
            within.append(article)
        if name in RAW:
            end = CLOSING[name].search(source, at)
            at = end.start() if end else limit
        if name in VOID or attributes.endswith("/") and name in ("svg", "math", "path"):
            continue
        drop = name in DROPPED or name == "header" and article < 0 or bool(attributes) and hidden(attributes)
        open_at[name].append(len(stack))
        stack.append((name, bool(drop), part, article))
        dropped += bool(drop)
        marking = name in ("article", "main")
        if attributes and (names_itself(attributes) if marking else name not in ("html", "body")) and (
                own := Part(1.0, True, part) if marking else named_part(name, attributes, part)):
            parts.append(own)
            part = len(parts) - 1
        elif marking and not dropped:
            i = part
            while i >= 0:
                parts[i].holds |= name == "main" or not parts[i].plain
                i = parts[i].around
        if marking and not dropped:
            articles.append((article, part))
            article = len(articles) - 1
        links += name == "a"
        headings += name in HEADING
    settle(page, within, parts, articles)
    return page


def settle(page: Page, within: list[int], parts: list[Part], articles: list[tuple[int, int]]) -> None:
    """Tell what names speak against, and which pieces are in an article, once the page is known.

    Names say nothing of a part that holds an article or most of the running text; of one whose
    name is all of NAMES, such as a list of comments, only the latter counts, or a main element.
    """
    total = 0
    for p in page.pieces:
        if p.feature == "word":
            total += p.words
            if p.part >= 0:
                parts[p.part].words += p.words
    for part in reversed(parts):  # inner ones come later
        if part.around >= 0:
            parts[part.around].words += part.words
    named = []
    for part in parts:
        own = 0.0 if part.holds or 2 * part.words > total else part.strength
        named.append(max(own, named[part.around] if part.around >= 0 else 0.0))
    marks = []
    for around, part in articles:
        # An article in what names speak against marks nothing.
        marks.append(around >= 0 and marks[around] or part < 0 or named[part] < 1)
    page.marked = any(marks)
    for p, i in zip(page.pieces, within, strict=True):
        p.inside = i >= 0 and marks[i]
        p.named = named[p.part] if p.part >= 0 else 0.0


def feature_counts(page: Page) -> dict[str, tuple[int, int]]:
    """Tokens of each feature inside and outside the page's own article."""
    out: dict[str, list[int]] = {}
    for p in page.pieces:
        if p.feature.startswith("word") and not p.words:
            continue
        pair = out.setdefault("word:named" if p.named == 1 and p.words and not p.dropped else p.feature, [0, 0])
        pair[0 if p.inside and not p.dropped else 1] += p.words if p.words else 1
        if page.marked and p.words and not p.inside and not p.dropped:
            out.setdefault("word:outside", [0, 0])[1] += p.words
    return {k: (a, b) for k, (a, b) in out.items()}


def fit(pages: DataFrame, html_col: str = "html", rows: int = SAMPLE_PAGES) -> dict[str, float]:
    """Weights from at most about `rows` labelled pages; only counts per feature are collected."""
    labelled = pages.select(F.col(html_col).alias("html")).filter(F.col("html").rlike(r"(?i)<(article|main)[\s>]"))
    schema = "feature string, inside long, outside long"

    def count(batches):
        for batch in batches:
            rows_ = []
            for source in batch.column("html").to_pylist():
                rows_ += [(k, a, b) for k, (a, b) in feature_counts(tokens(source)).items()]
            columns = list(zip(*rows_, strict=True)) if rows_ else [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())],
                names=["feature", "inside", "outside"])

    counts = bottom_sample(labelled, rows, "html").mapInArrow(count, schema).groupBy("feature").agg(
        F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).collect()
    return weights({r["feature"]: (r["inside"], r["outside"]) for r in counts})


def weights(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Log-odds per feature, drawn to the prior, words of running text positive and tags negative."""
    inside, outside = (sum(c[i] for c in counts.values()) + 1 for i in (0, 1))
    out = {}
    for feature, prior in PRIOR.items():
        a, b = counts.get(feature, (0, 0))
        odds = math.log((a + 0.5) / inside) - math.log((b + 0.5) / outside)
        n = a + b
        value = (n * odds + PRIOR_TOKENS * prior) / (n + PRIOR_TOKENS)
        value = max(-LARGEST, min(LARGEST, value))
        positive = feature in ("word", "word:heading")
        out[feature] = max(0.2, value) if positive else min(prior if feature == "tag:text" else -0.05, value)
    # Mark-up of running text must not outweigh a short paragraph, nor a link its sentence.
    out["tag:text"] = max(out["tag:text"], -out["word"] / 4)
    out["tag:block"] = max(out["tag:block"], -out["word"] / 2)
    out["tag:link"] = max(out["tag:link"], -out["word"] / 2)
    out["word:link"] = max(out["word:link"], -out["word"] / 4)
    # A name half of which speaks against its part must not outweigh the text.
    out["word:named"] = max(out["word:named"], -out["word"])
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous stretch with the largest positive sum; the first of equals."""
    best, start, end, total, begin = 0.0, 0, 0, 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += score
        if total > best:
            best, start, end = total, begin, i + 1
    return start, end


def left_out(p: Piece, weight: dict[str, float]) -> bool:
    """Whether a piece is no text of the article: dropped, or names speak more against it than words for it."""
    return p.dropped or p.named > 0 and (1 - p.named) * weight["word"] + p.named * weight["word:named"] < 0


def score(page: Page, weight: dict[str, float]) -> list[float]:
    """A page that marks its article is a label for itself: words elsewhere count against a region.

    Parts that are left out anyway weigh nothing inside a marked article, and elsewhere a
    fraction of a word, so that a long aside does not cut an article in two.
    """
    out = []
    for p in page.pieces:
        if left_out(p, weight):
            out.append(0.0 if p.inside else weight["word:dropped"] / 10 if p.words else -0.05)
        elif p.feature.startswith("word"):
            feature = p.feature if p.inside or not page.marked else "word:outside"
            # Inside a marked article a link is text.
            value = weight["word"] if p.inside and p.feature == "word:link" else weight[feature]
            out.append(((1 - p.named) * value + p.named * weight["word:named"]) * p.words)
        else:
            out.append(0.0 if p.inside else weight[p.feature])
    return out


def main_text(source: str | None, weight: dict[str, float]) -> str:
    """The article's text: blocks in page order, white space inside a block made one space."""
    page = tokens(source or "")
    start, end = best_region(score(page, weight))
    blocks: dict[int, list[str]] = {}
    for p in page.pieces[start:end]:
        if p.text and not left_out(p, weight):
            blocks.setdefault(p.block, []).append(p.text)
    return "\n\n".join(t for parts in blocks.values() if (t := " ".join("".join(parts).split())))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            weight: dict[str, float] | None = None) -> DataFrame:
    """Per page: id, url, text, n_chars."""
    weight = weight or fit(pages, html_col)
    source = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("__url"), F.col(html_col).alias("__html"))
    fields = source.schema.fields
    schema = T.StructType([
        T.StructField(id_col, fields[0].dataType), T.StructField(url_col, fields[1].dataType),
        T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in batches:
            column = batch.column("__html")
            texts = [main_text(s, weight) for i in range(0, len(column), 128) for s in column.slice(i, 128).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id"), batch.column("__url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return source.mapInArrow(run, schema)
