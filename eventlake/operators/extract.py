"""Article bodies from a page corpus: one pass tokenises pages to block rows; choosing and trimming are column work."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BLOCKS = {"h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "p": "paragraph", "li": "list", "blockquote": "blockquote", "pre": "code", "td": "table", "th": "table", "figcaption": "figure"}
SKIP = {"script", "style", "nav", "footer", "aside", "form", "noscript", "template", "header"}
REGIONS = {"article": 2, "main": 1}
CONTAINERS = {"article", "main", "div", "section"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SCHEMA = "page_id long, ord int, type string, level int, region int, text string, link_chars int, links array<string>, src string, alt string, width int, height int"
REGION_SCHEMA = "page_id long, region int, tag string, attrs string, depth int, chars int"
MARKERS = r"(?i)^(related|read more|more from|subscribe|share this|advertisement|recommended|comments)\b"
#: Pages whose rows a task holds at a time.
PAGES = 64


def _number(value: str | None) -> int:
    digits = (value or "").strip().removesuffix("px")
    return int(digits) if digits.isdigit() else 0


def best_source(attrs: dict) -> str:
    """The widest candidate of an image's srcset, else its src."""
    best, width = attrs.get("src") or attrs.get("data-src") or "", 0
    for part in (attrs.get("srcset") or "").split(","):
        url, _, size = part.strip().partition(" ")
        n = int(size[:-1]) if size[:-1].isdigit() else 0
        if url and n > width:
            best, width = url, n
    return best


class _Blocks(HTMLParser):
    """Rows (type, level, region, text, link characters, links, image) in document order; unclosed tags end at the next block."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple] = []
        self.skip = self.link_chars = 0
        self.anchors: list[str] = []
        self.region: list[str] = []
        self.kind, self.level, self.text, self.links = "", 0, [], []

    def _region(self) -> int:
        return max((REGIONS[r] for r in self.region), default=0)

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text and self.kind:
            self.rows.append((self.kind, self.level, self._region(), text, self.link_chars, self.links, None, None, None, None))
        self.kind, self.text, self.link_chars, self.links = "", [], 0, []

    def handle_starttag(self, tag, attrs):  # noqa: ANN001, ANN201
        if tag in SKIP:
            self.flush()
            self.skip += 1
        elif tag in REGIONS:
            self.region.append(tag)
        elif tag in BLOCKS:
            self.flush()
            self.kind, self.level = BLOCKS[tag], int(tag[1]) if tag[0] == "h" and tag[1:].isdigit() else 0
        elif tag == "a":
            self.anchors.append(dict(attrs).get("href") or "")
        elif tag == "img" and not self.skip:
            a = dict(attrs)
            if src := best_source(a):
                self.rows.append(("figure", 0, self._region(), "", 0, [], src, a.get("alt") or "", _number(a.get("width")), _number(a.get("height"))))

    def handle_endtag(self, tag):  # noqa: ANN001, ANN201
        if tag in SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag in REGIONS and tag in self.region:
            self.flush()
            self.region.remove(tag)
        elif tag in BLOCKS:
            self.flush()
        elif tag == "a" and self.anchors:
            self.anchors.pop()

    def handle_data(self, data):  # noqa: ANN001, ANN201
        if not self.skip and self.kind:
            self.text.append(data)
            if self.anchors and data.strip():
                self.link_chars += len(data.strip())
                if self.anchors[-1] and self.anchors[-1] not in self.links:
                    self.links.append(self.anchors[-1])


class _Regions(HTMLParser):
    """Rows (region, tag, attributes, depth, characters of text) of the containers, in order of their ends."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple] = []
        self.open: list[tuple] = []
        self.places: dict[str, list[int]] = {}
        self.count = self.seen = self.skips = 0

    def handle_starttag(self, tag, attrs):  # noqa: ANN001, ANN201
        if tag not in VOID:
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append((tag, attrs, self.count, self.seen))
            self.skips += tag in SKIP
            self.count += 1

    def handle_startendtag(self, tag, attrs):  # noqa: ANN001, ANN201
        pass

    def handle_endtag(self, tag):  # noqa: ANN001, ANN201
        if not self.places.get(tag):
            return
        at = self.places[tag][-1]
        name, attrs, number, seen = self.open[at]
        if name in CONTAINERS:
            self.rows.append((number, name, " ".join(f'{k}="{v or ""}"' for k, v in attrs), at, self.seen - seen))
        while len(self.open) > at:
            gone = self.open.pop()[0]
            self.places[gone].pop()
            self.skips -= gone in SKIP

    def handle_data(self, data):  # noqa: ANN001, ANN201
        # a container's text is what has been seen between its begin and its end
        if not self.skips:
            self.seen += len(" ".join(data.split()))


def _rows(parser: type, schema: str, numbered: bool):
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    types = [kinds[f.strip().split(" ")[1]] for f in schema.split(",")]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES):
                part, out = batch.slice(at, PAGES), []
                for page, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    p = parser()
                    p.feed(html or "")
                    p.close()
                    if hasattr(p, "flush"):
                        p.flush()
                    out += [(page, i, *r) if numbered else (page, *r) for i, r in enumerate(p.rows)]
                columns = list(zip(*out, strict=True)) if out else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return go


def page_blocks(pages: DataFrame) -> DataFrame:
    """Blocks of each page in document order, images among them. A row of a null page is none; a page without blocks gives none."""
    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(_rows(_Blocks, SCHEMA, True), SCHEMA)


def page_regions(pages: DataFrame) -> DataFrame:
    """Containers of each page: tag, attributes, depth and characters of text outside of navigation."""
    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(_rows(_Regions, REGION_SCHEMA, False), REGION_SCHEMA)


def before_chars(text: str = "text", doc: str = "page_id", order: str = "ord") -> Column:
    """Characters of the blocks before each block."""
    w = W.partitionBy(doc).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(F.length(text)).over(w), F.lit(0))


def body_blocks(blocks: DataFrame, least: int = 400) -> DataFrame:
    """Blocks of the best region of each page, without the tail from the first stop marker after `least` characters."""
    best = F.max("region").over(W.partitionBy("page_id"))
    inside = blocks.withColumn("_best", best).where(F.col("region") == F.col("_best")).drop("_best")
    marked = inside.withColumn("before", before_chars()).withColumn("_stop", F.col("text").rlike(MARKERS) & (F.col("before") >= least))
    cut = F.min(F.when(F.col("_stop"), F.col("ord"))).over(W.partitionBy("page_id"))
    return marked.withColumn("_cut", cut).where(F.col("_cut").isNull() | (F.col("ord") < F.col("_cut"))).drop("_cut", "_stop")


def body_quality(body: DataFrame) -> DataFrame:
    """Per page: characters, links and repeats, whether the body is meaningful and whether it looks right."""
    each = body.groupBy("page_id").agg(F.sum(F.length("text")).alias("chars"), F.sum("link_chars").alias("link_chars"), F.count("*").alias("blocks"), (F.count("*") - F.count_distinct("text")).alias("repeats"), F.bool_or(F.col("type").isin("table", "figure")).alias("structured"))
    suspect = (F.col("link_chars") > 0.42 * F.col("chars")) | ((F.col("repeats") >= 3) & (F.col("repeats") >= 0.12 * F.col("blocks")))
    return each.withColumn("integrity", F.when(suspect, "suspect").otherwise("pass")).withColumn("meaningful", (F.col("chars") >= 400) | ((F.col("chars") >= 120) & F.col("structured")))


def limit_chars(blocks: DataFrame, n: int, doc: str, order: str) -> DataFrame:
    """Blocks until n characters are reached; the one that crosses is cut."""
    seen = blocks.withColumn("before", before_chars("text", doc, order)).where(F.col("before") < n)
    return seen.withColumn("text", F.left("text", n - F.col("before"))).drop("before")


def limit_blocks(blocks: DataFrame, n: int, preserve: tuple[str, ...], doc: str = "page_id", order: str = "ord", kind: str = "type") -> DataFrame:
    """`limit_chars` with kinds of blocks that always stay and don't count."""
    kept = F.col(kind).isin(*preserve)
    size = F.when(kept, 0).otherwise(F.length(F.coalesce("text", F.lit(""))))
    before = F.coalesce(F.sum(size).over(W.partitionBy(doc).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    seen = blocks.withColumn("_before", before).where(kept | (F.col("_before") < n) | ((F.col("_before") == n) & (size == 0)))
    return seen.withColumn("text", F.when(kept, F.col("text")).otherwise(F.left("text", (n - F.col("_before")).cast("int")))).drop("_before")
