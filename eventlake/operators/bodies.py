"""Candidate bodies of pages: every block in each container that encloses it, trimmed and scored side by side.

One pass over a page gives containers as intervals of places and blocks as places within them, in time linear in the page:
the text of a container is the difference of two running counts. Which blocks a container holds is a containment join of
the two. A block stands in a container as it would if the container were the whole page: something skipped (navigation,
players, recommendations) hides a block from containers around it, not from those within it; a container that is skipped
itself holds nothing.

Pages without markup give no rows; unclosed containers are none, unclosed blocks end with their container.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from eventlake.operators import trim
from eventlake.operators.extract import BLOCKS, CONTAINERS, PAGES, SKIP, VOID, _number, best_source
from eventlake.operators.feeds import jsonld_bodies
from eventlake.plans.stage import keep

#: Left out wherever they stand; those beyond SKIP don't end the block around them.
INLINE_SKIP = {"iframe", "object", "button", "select", "textarea", "canvas", "svg", "head", "audio", "video"}
# What players and recommendations name themselves.
PLAYER_WIDGET = r"(?:^|\s)(?:article\s+)?(?:audio|podcast|media)\s+(?:player|controls?|widget)(?:\s|$)|(?:^|\s)(?:reading|bookmark)\s+list(?:\s|$)"
PAGE_WIDGET = r"(?:^|\s)(?:article|post)\s+(?:footer|navigation|recommendations?)(?:\s|$)|(?:^|\s)(?:related|recommended|recommendations?|recirculation)\s+(?:content|articles?|posts?|stories|cards?|list|section)(?:\s|$)|(?:^|\s)(?:next|previous)\s+(?:article|post|story)(?:\s|$)|(?:^|\s)(?:topic\s+hub|newsletter\s+(?:signup|form)|author\s+(?:bio|card)|product\s+recommendations?|social\s+share)(?:\s|$)"
WIDGET_ATTRS = ("class", "id", "role", "aria-label", "data-testid", "data-component")
#: Largest article-like containers, and largest others, that are looked at.
SEMANTIC, NESTED, LEAST = 16, 24, 400

SCHEMA = (
    "page_id long, kind string, start int, stop int, skip int, tag string, attrs string, depth int, chars int, type string, level int, text string, link_chars int, "
    "links array<string>, src string, alt string, width int, height int"
)


class _Slices(HTMLParser):
    """Rows of SCHEMA behind page_id: containers in order of their ends, blocks in order of their starts."""

    widget = re.compile(f"{PLAYER_WIDGET}|{PAGE_WIDGET}", re.IGNORECASE)

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple] = []
        self.at = self.seen = 0
        self.open: list[tuple] = []
        self.places: dict[str, list[int]] = {}
        self.skips: list[int] = []
        self.anchors: list[str] = []
        self.kind = ""

    def _skip(self) -> int | None:
        return self.skips[-1] if self.skips else None

    def _begin(self, kind: str, level: int) -> None:
        self.kind, self.level, self.start, self.hidden = kind, level, self.at, self._skip()
        self.text, self.links, self.link_chars = [], [], 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split()) if self.kind else ""
        if text:
            self.rows.append(("block", self.start, self.start, self.hidden, None, None, None, None, self.kind, self.level, text, self.link_chars, self.links, None, None, None, None))
        self.kind = ""

    def _is_widget(self, attrs: list) -> bool:
        named = [v for k, v in attrs if k in WIDGET_ATTRS and v]
        return bool(named) and bool(self.widget.search(re.sub(r"[^a-z0-9]+", " ", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", " ".join(named)).lower()).strip()))

    def handle_starttag(self, tag, attrs):  # noqa: ANN001, ANN201
        self.at += 1
        if tag == "img":
            a = dict(attrs)
            if src := best_source(a):
                self.rows.append(("block", self.at, self.at, self._skip(), None, None, None, None, "figure", 0, "", 0, [], src, a.get("alt") or "", _number(a.get("width")), _number(a.get("height"))))
        if tag in VOID:
            return
        if tag in CONTAINERS or tag in SKIP or tag in BLOCKS:
            self.flush()
        self.places.setdefault(tag, []).append(len(self.open))
        skips = tag in SKIP or tag in INLINE_SKIP or self._is_widget(attrs)
        self.open.append((tag, attrs, self.at, self.seen, skips))
        if skips:
            self.skips.append(self.at)
        if tag in BLOCKS:
            self._begin(BLOCKS[tag], int(tag[1]) if tag[0] == "h" and tag[1:].isdigit() else 0)
        elif tag == "a":
            self.anchors.append(dict(attrs).get("href") or "")

    def handle_startendtag(self, tag, attrs):  # noqa: ANN001, ANN201
        if tag in VOID:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):  # noqa: ANN001, ANN201
        self.at += 1
        if tag == "a" and self.anchors:
            self.anchors.pop()
        if not self.places.get(tag):
            return
        if tag in CONTAINERS or tag in SKIP or tag in BLOCKS:
            self.flush()
        index = self.places[tag][-1]
        name, attrs, start, seen, _ = self.open[index]
        if name in CONTAINERS:
            self.rows.append(("container", start, self.at, None, name, " ".join(f'{k}="{v or ""}"' for k, v in attrs), index, self.seen - seen, None, None, None, None, None, None, None, None, None))
        # each opened tag is closed once, so that all closing is linear
        while len(self.open) > index:
            tag_, _, at, _, skips = self.open.pop()
            self.places[tag_].pop()
            if skips:
                self.skips.pop()

    def handle_data(self, data):  # noqa: ANN001, ANN201
        self.at += 1
        if not self.skips:
            self.seen += len(" ".join(data.split()))
        if self.kind and self._skip() == self.hidden:
            self.text.append(data)
            if self.anchors and data.strip():
                self.link_chars += len(data.strip())
                if self.anchors[-1] and self.anchors[-1] not in self.links:
                    self.links.append(self.anchors[-1])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    types = [kinds[f.split()[1]] for f in SCHEMA.split(", ")]
    for batch in batches:
        for at in range(0, batch.num_rows, PAGES):
            part, out = batch.slice(at, PAGES), []
            for page, html in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                p = _Slices()
                p.feed(html or "")
                p.close()
                p.flush()
                out += [(page, *r) for r in p.rows]
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def page_slices(pages: DataFrame) -> DataFrame:
    """Containers and blocks of each page, see SCHEMA. A container holds places start to stop."""
    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(_slices, SCHEMA)


def candidate_regions(slices: DataFrame) -> DataFrame:
    """page_id, candidate (a container's start), stop, strategy, depth, region_chars: the containers that may hold the article."""
    c = slices.where("kind = 'container'").select("page_id", F.col("start").alias("candidate"), "stop", "tag", "depth", F.col("chars").alias("region_chars"), trim.classify_region(F.col("attrs")).alias("c"))
    box = F.col("tag").isin("div", "section")
    own = F.when(box & F.col("c.article") & ~F.col("c.noise"), "semantic_container").when(F.col("tag").isin("article", "main"), F.col("tag")).when(F.col("region_chars") >= LEAST, "nested_content")
    place = F.row_number().over(W.partitionBy("page_id", "strategy").orderBy(F.desc("region_chars"), "candidate"))
    ranked = c.withColumn("strategy", own).where("strategy is not null").withColumn("place", place)
    limit = F.when(F.col("strategy") == "semantic_container", SEMANTIC).when(F.col("strategy") == "nested_content", NESTED)
    rooted = F.max(F.col("strategy") != "nested_content").over(W.partitionBy("page_id"))
    named = F.when((F.col("strategy") == "nested_content") & ~rooted, "largest_content").otherwise(F.col("strategy"))
    return ranked.where(limit.isNull() | (F.col("place") <= limit)).withColumn("strategy", named).select("page_id", "candidate", "stop", "strategy", "depth", "region_chars")


def candidate_blocks(regions: DataFrame, slices: DataFrame) -> DataFrame:
    """One row per page, container and block that the container holds: page_id, candidate, ord and the block's columns."""
    b = slices.where("kind = 'block'").select(F.col("page_id").alias("b_page"), F.col("start").alias("ord"), "skip", "type", "level", "text", "link_chars", "links", "src", "alt", "width", "height")
    inside = (F.col("b_page") == F.col("page_id")) & (F.col("ord") > F.col("candidate")) & (F.col("ord") < F.col("stop")) & (F.col("skip").isNull() | (F.col("skip") < F.col("candidate")))
    return regions.join(b, inside).select("page_id", "candidate", "ord", "type", "level", "text", "link_chars", "links", "src", "alt", "width", "height")


def trimmed(blocks: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """blocks without what surrounds an article: tail, head, players, repeated and closing promotions, in this order."""
    body = trim.cut_tail(blocks, trim.tail_boundary(blocks, page=key, order=order), key, order)
    heads = trim.head_cut(body, page=key, order=order)
    place = F.row_number().over(W.partitionBy(key).orderBy(order))
    body = body.withColumn("_place", place).join(heads, key, "left").where(F.col("_place") > F.coalesce("cut", F.lit(0))).drop("_place", "cut")
    body = keep(trim.embedded_ui(body, page=key, order=order), "trimmed")
    body = body.join(trim.repeated_promos(body, page=key, order=order), [key, order], "left_anti")
    return trim.terminal_promos(body, page=key, order=order)


def plain_chars(size: Column, n: Column) -> Column:
    """Characters of blocks joined by blank lines."""
    return (F.coalesce(size, F.lit(0)) + 2 * F.greatest(n - 1, F.lit(0))).cast("long")


def measured(blocks: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """Per key: what `trim.integrity` says, plain_chars, and a signature of the blocks in order. A block that is itself the
    heading of a tail makes its body suspect."""
    t = trim.bare(F.col("text"))
    told = F.coalesce(F.trim("text"), F.lit("")) != ""
    rows = F.sort_array(F.collect_list(F.struct(order, "type", "text", "src")))
    more = blocks.groupBy(key).agg(
        plain_chars(F.sum(F.when(told, F.length("text"))), F.count_if(told)).alias("plain_chars"), F.coalesce(F.bool_or(trim.whole(t, trim.TAIL_HEADING)), F.lit(False)).alias("found"),
        F.sha2(F.to_json(F.transform(rows, lambda x: F.struct(x["type"].alias("y"), x["text"].alias("t"), x["src"].alias("s")))), 256).alias("signature"),
    )
    return trim.integrity(blocks, key, order).join(more, key).withColumn("quality", F.when(F.col("found"), "suspect").otherwise(F.col("quality"))).drop("found")


def page_bodies(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chosen, blocks): per page the best candidate (page_id, candidate, strategy, quality, score, chars, blocks,
    candidates), and its trimmed blocks. Article texts in a page's structured data compete as well; a page in which nothing
    has enough text gets all its blocks. Pages without any block don't appear."""
    slices = keep(page_slices(pages), "slices")
    regions = keep(candidate_regions(slices), "regions")
    own = candidate_blocks(regions, slices)
    told = pages.select(F.col("page_id").cast("long").alias("page_id"), F.posexplode(jsonld_bodies(F.col("html"))).alias("at", "body"))
    told = told.select("page_id", (-1 - F.col("at")).alias("candidate"), F.posexplode(trim.text_to_blocks(F.col("body"))).alias("ord", "text"))
    empty = F.array().cast("array<string>")
    nothing = {"level": "int", "src": "string", "alt": "string", "width": "int", "height": "int"}
    told = told.select("page_id", "candidate", "ord", F.lit("paragraph").alias("type"), "text", F.lit(0).alias("link_chars"), empty.alias("links"), *(F.lit(None).cast(t).alias(n) for n, t in nothing.items()))
    whole = slices.where("kind = 'block' and skip is null").select("page_id", F.lit(0).alias("candidate"), F.col("start").alias("ord"), "type", "level", "text", "link_chars", "links", "src", "alt", "width", "height")
    key = F.concat_ws(":", "page_id", "candidate")
    raw = keep(own.unionByName(told).unionByName(whole).withColumn("key", key), "candidate-blocks")
    body = keep(trimmed(raw, "key"), "candidate-bodies")
    told_raw = F.coalesce(F.trim("text"), F.lit("")) != ""
    before = raw.groupBy("key", "page_id", "candidate").agg(F.count("*").alias("raw_blocks"), plain_chars(F.sum(F.when(told_raw, F.length("text"))), F.count_if(told_raw)).alias("raw_chars"))
    # what a candidate's share is measured against: the broadest of main, else article, else article-like, else other containers
    rank = F.when(F.col("strategy") == "main", 0).when(F.col("strategy") == "article", 1).when(F.col("strategy") == "semantic_container", 2).otherwise(3)
    broad = regions.groupBy("page_id").agg(F.max(F.struct(-rank, F.col("region_chars").alias("c")))["c"].alias("broad"))
    whole_chars = before.where("candidate = 0").select("page_id", F.col("raw_chars").alias("page_chars"))
    all_ = before.join(measured(body, "key"), "key").join(regions.select("page_id", "candidate", "strategy", "depth"), ["page_id", "candidate"], "left").join(broad, "page_id", "left").join(whole_chars, "page_id", "left")
    strategy = F.coalesce("strategy", F.when(F.col("candidate") < 0, "jsonld_article_body").otherwise("document_fallback"))
    focus = F.when(F.col("candidate") == 0, 1.0).otherwise(F.least(F.lit(1.0), F.col("raw_chars") / F.greatest(F.coalesce("broad", "page_chars", F.lit(1)), F.lit(1))))
    score = trim.extraction_score(strategy, F.col("plain_chars"), F.col("headings"), F.col("tables"), F.col("figures"), F.col("link_ratio"), F.col("quality"), F.col("raw_blocks") - F.col("blocks"), F.col("raw_blocks"), F.coalesce("depth", F.lit(0)), focus)
    enough = (F.col("plain_chars") >= LEAST) | ((F.col("plain_chars") >= 120) & (F.col("figures") + F.col("tables") > 0))
    scored = keep(all_.withColumn("strategy", strategy).withColumn("score", score).where(enough | (F.col("candidate") == 0)), "scored-candidates")
    pool = scored.where("candidate <> 0")
    best = trim.choose_body(pool)
    count = pool.groupBy("page_id").agg(F.count_distinct("signature").alias("candidates"))
    cols = ("page_id", "key", "candidate", "strategy", "quality", "score", F.col("plain_chars").alias("chars"), "blocks")
    rest = scored.where("candidate = 0").join(pool.select("page_id").distinct(), "page_id", "left_anti")
    chosen = keep(best.select(*cols).unionByName(rest.select(*cols)).join(count, "page_id", "left").withColumn("candidates", F.coalesce("candidates", F.lit(0))), "chosen-bodies")
    return chosen.drop("key"), body.join(chosen.select("key"), "key", "left_semi").drop("key")


#: Passes over a stored catalog; each takes what the one before has laid bare.
MOST_PASSES = 12


def renormalize(events: DataFrame, key: str = "event_id", blocks: str = "blocks") -> DataFrame:
    """events with their stored blocks trimmed by today's rules until no rule removes any, and `removed`, how many went.

    blocks: array of structs with type, text, links and link_chars (and width, height, alt where known), in order. Only events
    of which a pass took something are looked at again. Events without blocks stay as they are.
    """
    # blocks are written once; passes write which of them are left
    stored = keep(events.select(key, F.posexplode(blocks).alias("ord", "block")), "stored-blocks")
    open_, done = stored, None
    before = stored.groupBy(key).agg(F.count("*").alias("n"))
    for _ in range(MOST_PASSES):
        left = keep(trimmed(open_.select(key, "ord", "block.*"), key).select(key, "ord"), "renormalized")
        after = left.groupBy(key).agg(F.count("*").alias("m"))
        took = keep(before.join(after, key, "left").where(F.col("n") > F.coalesce("m", F.lit(0))).select(key), "took")
        settled = left.join(took, key, "left_anti")
        done = settled if done is None else done.unionByName(settled)
        if took.isEmpty():
            break
        again = left.join(took, key, "left_semi")
        before = again.groupBy(key).agg(F.count("*").alias("n"))
        open_ = stored.join(took, key, "left_semi").join(again, [key, "ord"], "left_semi")
    else:
        raise RuntimeError(f"blocks still go after {MOST_PASSES} passes")
    built = done.groupBy(key).agg(F.sort_array(F.collect_list("ord")).alias("_left"))
    had = stored.groupBy(key).agg(F.count("*").alias("_had"))
    j = events.join(had, key, "left").join(built, key, "left")
    new = F.when(F.col("_had").isNull(), F.col(blocks)).otherwise(F.transform(F.coalesce("_left", F.array().cast("array<int>")), lambda i: F.get(F.col(blocks), i)))
    return j.withColumn(blocks, new).withColumn("removed", F.coalesce(F.col("_had") - F.size(blocks), F.lit(0)).cast("long")).drop("_had", "_left")


@F.udtf(returnType="ord int, type string, level int, text string, link_chars int, links array<string>, src string, alt string, width int, height int")
class BlocksOf:
    """Blocks of one page, for SQL: SELECT p.page_id, b.* FROM pages p, LATERAL blocks_of(p.html) b."""

    def eval(self, html: str):  # noqa: ANN201
        from eventlake.operators.extract import _Blocks

        p = _Blocks()
        p.feed(html or "")
        p.close()
        p.flush()
        for i, (kind, level, _, text, link_chars, links, *image) in enumerate(p.rows):
            yield i, kind, level, text, link_chars, links, *image


def register_table_functions(spark: SparkSession) -> None:
    """Makes `blocks_of(html)` known to SQL."""
    spark.udtf.register("blocks_of", BlocksOf)
