"""Main text of web pages: flat text blocks, classified by a decision tree on their own and their neighbours' features."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Elements that HTML defines as hidden, as boilerplate, as the article, and as part of a line.
HIDDEN = frozenset("script style noscript template svg math iframe object canvas head title select option datalist".split())
RAW = frozenset("script style textarea title".split())  # their content is not markup
ASIDE = frozenset("nav footer aside header form menu dialog button label fieldset".split())
ARTICLE = frozenset(("article", "main"))
INLINE = frozenset("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp
small span strike strong sub sup time tt u var wbr""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that can stand in a head; any other start tag, or text, ends a head whose end tag is left out.
IN_HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
# Words in class, id and role names that tell boilerplate from the article.
BOILERPLATE_NAMES = frozenset("""ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments
consent contentinfo cookie cookies copyright disqus footer gdpr header masthead menu modal nav navbar navigation newsletter
notice overlay pagination popup promo promotion related replies respond share sharing sidebar signup social sponsor
sponsored subscribe toolbar widget""".split())
ARTICLE_NAMES = frozenset("article body content entry free main post story text".split())

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|</?[a-zA-Z][^\s/>]*(?:[^>\"']|\"[^\"]*\"|'[^']*')*>?|<", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
PARTS = re.compile(r"[a-z]+")

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "in_article", "in_aside", "names")
# A small labelled table of blocks: the features, whether it is main text, and how often such a block was seen.
LABELLED = [
    # words links w_before l_before w_after l_after in_article in_aside names main n
    # in an article: text, headings, list items with and without links, tables, captions
    (60, 0.0, 55, 0.0, 70, 0.0, 1, 0, 0.0, 1, 9), (3, 0.0, 60, 0.0, 50, 0.0, 1, 0, 0.0, 1, 9), (1, 0.0, 1, 0.0, 1, 0.0, 1, 0, 0.0, 1, 9),
    (8, 0.0, 9, 0.0, 80, 0.0, 1, 0, 0.0, 1, 9), (12, 1.0, 40, 0.0, 35, 0.0, 1, 0, 0.0, 1, 6), (2, 0.0, 0, 0.0, 0, 0.0, 1, 0, 0.0, 1, 6),
    (20, 0.3, 0, 0.0, 3, 0.0, 1, 0, 0.0, 1, 5), (9, 0.0, 3, 1.0, 0, 0.0, 1, 0, 0.0, 1, 6), (300, 0.0, 4, 0.0, 6, 1.0, 1, 0, 0.0, 1, 6),
    (3, 1.0, 30, 0.0, 2, 0.0, 1, 0, 0.0, 1, 6), (2, 1.0, 3, 1.0, 4, 1.0, 1, 0, 0.0, 1, 6), (4, 0.5, 5, 1.0, 2, 1.0, 1, 0, 0.1, 1, 5),
    (35, 0.0, 20, 0.0, 60, 0.0, 1, 0, 0.3, 1, 6), (6, 0.0, 40, 0.0, 30, 0.0, 1, 0, 0.3, 1, 5), (5, 0.0, 2, 1.0, 45, 0.0, 1, 0, 0.3, 1, 4),
    # set apart inside an article: adverts, share bars, notes of readers, asides
    (5, 0.0, 40, 0.0, 4, 1.0, 1, 1, 0.0, 0, 9), (60, 0.0, 50, 0.0, 30, 0.0, 1, 1, 0.0, 0, 9), (1, 1.0, 1, 1.0, 1, 1.0, 1, 1, 0.0, 0, 6),
    (40, 0.0, 60, 0.0, 30, 0.0, 1, 0, 1.0, 0, 9), (7, 0.0, 50, 0.0, 60, 0.0, 1, 0, 1.0, 0, 9), (2, 1.0, 30, 0.0, 2, 1.0, 1, 0, 0.7, 0, 8),
    (25, 0.0, 30, 0.0, 40, 0.0, 1, 0, 0.6, 0, 6), (15, 0.1, 20, 0.0, 30, 0.0, 1, 0, 0.5, 0, 5),
    # boilerplate by element
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0.0, 0, 9), (6, 0.0, 90, 0.0, 0, 0.0, 0, 1, 0.0, 0, 9), (40, 0.0, 2, 1.0, 30, 0.0, 0, 1, 0.0, 0, 9),
    (15, 0.0, 1, 1.0, 60, 0.0, 0, 1, 0.0, 0, 9), (120, 0.0, 80, 0.0, 90, 0.0, 0, 1, 0.0, 0, 6), (3, 0.2, 4, 0.0, 4, 0.0, 0, 1, 0.0, 0, 6),
    (30, 0.0, 50, 0.0, 40, 0.0, 0, 1, 1.0, 0, 6), (4, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0.0, 0, 5),
    # boilerplate by name: banners, notices, adverts, related links, comments
    (8, 0.0, 1, 1.0, 12, 0.0, 0, 0, 1.0, 0, 9), (45, 0.0, 60, 0.0, 50, 0.0, 0, 0, 1.0, 0, 9), (3, 1.0, 40, 0.0, 3, 1.0, 0, 0, 0.7, 0, 9),
    (20, 0.0, 30, 0.0, 25, 0.0, 0, 0, 0.6, 0, 6), (30, 0.1, 3, 1.0, 40, 0.0, 0, 0, 0.5, 0, 6), (4, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1.0, 0, 5),
    # neither: running text
    (45, 0.02, 50, 0.0, 40, 0.0, 0, 0, 0.0, 1, 9), (30, 0.0, 5, 0.0, 60, 0.0, 0, 0, 0.0, 1, 8), (25, 0.1, 40, 0.1, 3, 1.0, 0, 0, 0.0, 1, 8),
    (90, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0.0, 1, 8), (11, 0.0, 50, 0.0, 60, 0.0, 0, 0, 0.0, 1, 6), (6, 0.0, 45, 0.0, 70, 0.0, 0, 0, 0.0, 1, 6),
    (18, 0.0, 30, 0.0, 25, 0.1, 0, 0, 0.0, 1, 6), (40, 0.0, 2, 1.0, 35, 0.0, 0, 0, 0.3, 1, 6), (30, 0.0, 25, 0.0, 2, 1.0, 0, 0, 0.3, 1, 5),
    (35, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0.0, 1, 6), (22, 0.0, 4, 0.9, 3, 0.0, 0, 0, 0.0, 1, 5),
    # neither: headings before text, short pages, tables, last lines of a text
    (5, 0.0, 3, 1.0, 50, 0.0, 0, 0, 0.0, 1, 6), (4, 0.0, 1, 1.0, 25, 0.0, 0, 0, 0.0, 1, 5), (4, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0.0, 1, 8),
    (9, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0.0, 1, 6), (2, 0.0, 3, 0.0, 2, 0.0, 0, 0, 0.0, 1, 8), (1, 0.0, 1, 0.0, 1, 0.0, 0, 0, 0.0, 1, 8),
    (5, 0.0, 4, 0.0, 3, 0.0, 0, 0, 0.0, 1, 5), (3, 0.0, 0, 0.0, 4, 0.0, 0, 0, 0.0, 1, 5), (7, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0.0, 1, 5),
    # neither: lists of links, labels between links
    (2, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0.0, 0, 9), (8, 0.9, 6, 0.8, 5, 1.0, 0, 0, 0.0, 0, 8), (4, 0.5, 1, 1.0, 3, 0.7, 0, 0, 0.0, 0, 8),
    (3, 0.0, 2, 1.0, 2, 1.0, 0, 0, 0.0, 0, 8), (6, 0.0, 4, 1.0, 3, 1.0, 0, 0, 0.0, 0, 6), (2, 0.0, 1, 1.0, 3, 0.9, 0, 0, 0.0, 0, 6),
    (25, 0.8, 20, 0.7, 25, 0.8, 0, 0, 0.0, 0, 6), (50, 0.7, 3, 1.0, 2, 1.0, 0, 0, 0.0, 0, 5), (12, 0.6, 45, 0.0, 8, 0.9, 0, 0, 0.0, 0, 5),
    (3, 1.0, 50, 0.0, 3, 1.0, 0, 0, 0.0, 0, 6), (4, 1.0, 0, 0.0, 4, 0.0, 0, 0, 0.0, 0, 4),
    (5, 0.0, 60, 0.0, 3, 1.0, 0, 0, 0.3, 0, 4), (4, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0.3, 0, 4),
]


def name_evidence(value: str) -> float:
    """How far a class, id or role speaks for boilerplate, 0 to 1: the share of its boilerplate words, of its boilerplate
    and article words and half the others."""
    parts = PARTS.findall(value.lower())
    bad, good = sum(p in BOILERPLATE_NAMES for p in parts), sum(p in ARTICLE_NAMES for p in parts)
    return bad / (bad + good + (len(parts) - bad - good) / 2) if bad else 0.0


class _Scope:
    """The open elements that matter: what is hidden, boilerplate or article, and what their names say."""

    def __init__(self):
        self.open: list[tuple[str, int, int, int, float]] = []  # name, hidden, aside, article, names
        self.hidden = self.aside = self.article = self.links = 0
        self.names: list[float] = [0.0]  # the strongest evidence so far, of every open element

    def push(self, name: str, tag: str) -> None:
        hidden, aside, article, names = int(name in HIDDEN), int(name in ASIDE), int(name in ARTICLE), 0.0
        if name == "header" and self.article:  # an article's own header holds its headline
            aside = 0
        for key, value in ATTRIBUTE.findall(tag, len(name) + 1):
            key, value = key.lower(), value.strip("\"'").lower()
            if key == "hidden" or (key == "aria-hidden" and value == "true") or (
                    key == "style" and re.search(r"display\s*:\s*none", value)):
                hidden = 1
            elif key in ("class", "id", "role") and name not in ("html", "body") and not article:
                names = max(names, name_evidence(value))
                if not names and set(PARTS.findall(value)) & ARTICLE_NAMES:
                    article = 1
        self.open.append((name, hidden, aside, article, names))
        self.names.append(max(names, self.names[-1]))
        self._count(1, name, hidden, aside, article)

    def _count(self, by: int, name: str, hidden: int, aside: int, article: int) -> None:
        self.hidden += by * hidden
        self.aside += by * aside
        self.article += by * article
        self.links += by * (name == "a")

    def pop(self, name: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == name:
                for entry in self.open[i:]:
                    self._count(-1, *entry[:4])
                del self.open[i:], self.names[i + 1:]
                return

    def leave_head(self) -> None:
        while self.open and self.open[-1][0] == "head":
            self.pop("head")


def blocks(page: str) -> list[tuple[str, int, float, int, int, float]]:
    """The visible text blocks of a page: text, words, share of words in links, in an article, in boilerplate, and how far
    the names around it speak for boilerplate.

    Block-level tags end a block; tags within a line, comments and hidden elements do not show. A head without end tag
    ends where HTML ends it. Character references
    are decoded and white space becomes single spaces.
    """
    found: list[tuple[str, int, float, int, int, float]] = []
    pieces: list[tuple[str, bool]] = []
    scope = _Scope()

    def close() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(p for p, _ in pieces)).split())
            if text:
                words = text.count(" ") + 1
                linked = sum(len(html.unescape(p).split()) for p, in_link in pieces if in_link)
                found.append((text, words, min(1.0, linked / words), int(scope.article > 0), int(scope.aside > 0), scope.names[-1]))
            pieces.clear()

    at = 0
    raw = None
    for match in TOKEN.finditer(page):
        if match.start() < at:  # inside an element whose content is not markup
            continue
        if match.start() > at and not page[at:match.start()].isspace():
            scope.leave_head()
        if match.start() > at and not scope.hidden:
            pieces.append((page[at:match.start()], scope.links > 0))
        tag = match.group()
        at = match.end()
        name = NAME.match(tag)
        if name is None:
            if tag == "<" and not scope.hidden:
                pieces.append(("<", scope.links > 0))
            continue
        name = name.group(1).lower()
        if tag[1] != "/" and name not in IN_HEAD:
            if name == "body":
                scope.pop("head")
            scope.leave_head()
        if name == "br":
            pieces.append((" ", False))
            continue
        if name not in INLINE and name not in HIDDEN:
            close()
        if tag[1] == "/":
            scope.pop(name)
        elif name not in VOID and not tag.endswith("/>"):
            if name in ("p", "li") and scope.open and scope.open[-1][0] == name:
                scope.pop(name)
            scope.push(name, tag)
            if name in RAW:
                raw = re.compile(rf"</{name}\b", re.I).search(page, at)
                end = raw.start() if raw else len(page)
                if not scope.hidden:
                    pieces.append((page[at:end], scope.links > 0))
                at = end
    if at < len(page) and not page[at:].isspace():
        scope.leave_head()
    if at < len(page) and not scope.hidden:
        pieces.append((page[at:], scope.links > 0))
    close()
    return found


BLOCK = ("text string, words double, links double, words_before double, links_before double, words_after double, "
         "links_after double, in_article double, in_aside double, names double")


def with_blocks(pages: DataFrame, page: str) -> DataFrame:
    """The columns of `pages` but its html, with `blocks`: all text blocks in page order, with their features."""
    kept = [c for c in pages.columns if c != page]
    kind = pa.struct([("text", pa.string()), *((f, pa.float64()) for f in FEATURES)])

    def described(text: str) -> list[dict]:
        own = blocks(text)
        around = [(0, 0.0), *((w, ln) for _, w, ln, *_ in own), (0, 0.0)]
        return [{"text": t, "words": w, "links": ln, "words_before": around[i][0], "links_before": around[i][1],
                 "words_after": around[i + 2][0], "links_after": around[i + 2][1], "in_article": art, "in_aside": aside, "names": names}
                for i, (t, w, ln, art, aside, names) in enumerate(own)]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [described(v.as_py() or "") for v in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, pa.list_(kind))], [*kept, "blocks"])

    fields = ", ".join(f"`{c}` {t}" for c, t in pages.dtypes if c != page)
    return pages.select(*kept, page).mapInArrow(split, f"{fields}, blocks array<struct<{BLOCK.replace(' ', ':').replace(',:', ', ')}>>")


def learned_tree(spark: SparkSession):
    """A decision tree on the labelled blocks."""
    rows = [tuple(map(float, r[:-1])) for r in LABELLED for _ in range(r[-1])]
    table = spark.createDataFrame(rows, [*FEATURES, "label"])
    assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table)
    return DecisionTreeClassifier(maxDepth=10, minInstancesPerNode=3, maxBins=128, seed=3).fit(assembled)


def tree_column(model, block: Column) -> Column:
    """The tree's decision on a block as a column expression, so that it runs inside the page's row."""
    def walk(node) -> Column:
        if node.numDescendants() == 0:
            return F.lit(node.prediction() > 0.5)
        split = node.split()
        feature = block.getField(FEATURES[split.featureIndex()])
        return F.when(feature <= split.threshold(), walk(node.leftChild())).otherwise(walk(node.rightChild()))

    return walk(model._java_obj.rootNode())


def main_texts(pages: DataFrame, model=None, page: str = "html", keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """One row per page: the key columns, text (the main blocks, one per line) and n_chars (its code points).

    The whole html is read; null is empty. A page without main text has an empty one. Neighbours of a block are the
    blocks before and after it on the page. Cut-off markup ends with the page. Repeated rows are treated alike, further
    columns are ignored, and no rows give no rows.
    """
    model = model or learned_tree(pages.sparkSession)
    found = with_blocks(pages.select(*keys, page), page)
    main = F.transform(F.filter("blocks", lambda b: tree_column(model, b)), lambda b: b.getField("text"))
    return found.select(*keys, F.array_join(main, "\n").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
