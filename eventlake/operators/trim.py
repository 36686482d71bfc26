"""Cutting what surrounds an article: stop markers at its end, heads before it, players within it, promotions, figures.

Blocks are rows: page_id, ord, type, text, links (array), link_chars; `page_id` and `ord` may go by other names. What a
phrase means is a pattern, so that other sites and languages bring their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from eventlake.plans.stage import keep

# The phrases of source sites, matched without regard to case.
ARTICLE_SIGNAL = r"\b(?:article|post|entry|story)(?:\s+(?:body|content|text))?\b|\b(?:body|content)\s+(?:article|post|story)\b|\b(?:articlebody|rich\s*text|markdown|prose)\b"
ARTICLE_NOISE = r"\b(?:archive|author|card|carousel|comment|footer|grid|header|hero|index|latest|list|nav|newsletter|popular|promo|recommended|related|share|sidebar|teaser)\b"
TAIL_HEADING = r"(?:previous|next)(?:\s+(?:article|post|story))?|related\s+(?:content|articles?|posts?|stories)|recommended(?:\s+(?:reading|articles?|posts?|stories))?|you\s+may\s+also\s+like|more\s+from|latest\s+(?:articles?|posts?|stories)|share\s+this\s+(?:article|post|story)|popular\s+(?:articles?|posts?)|topic\s+hub|about\s+the\s+authors?|上一篇(?:文章)?|下一篇(?:文章)?|相关内容|相关博客|相关主题文章|相关客户案例|相关解决方案|相关视频|相关产品推荐|产品推荐|主题中心|关于作者|作者简介|相关文章|最新文章|相关推荐|推荐阅读|更多文章|分享本文"
TAIL_UI = r"item\s+not\s+found\.?|未找到项目[。.]?|(?:previous|next)(?:\s+(?:article|post|story))?|上一页|下一页|上一篇(?:文章)?|下一篇(?:文章)?|\d+\s*/\s*\d+|e-?books?|电子书|faq|常见问题"
PROMO_HEADING = r"get\s+started(?:\s+(?:in|with)\s+.+)?|start\s+(?:using|building)\s+.+|install\s+.+|try\s+.+|join\s+.+|开始使用.+|在.+中开始|安装.+|试用.+|加入.+"
PROMO_BLOCK = r"(?:\bdownload\b.{0,80}\b(?:guide|report|ebook|whitepaper|roadmap)\b|\b(?:guide|report|ebook|whitepaper)\b.{0,80}\bdownload\b|\b(?:sign\s*up|register|book\s+a\s+demo|contact\s+sales)\b|下载.{0,40}(?:指南|报告|电子书|白皮书|路线图)|(?:指南|报告|电子书|白皮书).{0,40}下载|注册|预约演示|联系销售)"
TERMINAL_PROMO = r"(?:get\s+started\s+(?:with|using|on)\s+.+|try\s+.+(?:today|now)|start\s+(?:using|building)\s+.+(?:today|now)|(?:立即|现在)?开始使用.+|(?:立即|现在)?试用.+)[.!。！]?"
BYLINE = r"^(?:.{0,80}\b(?:last\s+(?:edited|updated)(?:\s+on)?|updated\s+(?:on|at)|published\s+(?:on|at))\b|by\s+[A-Z][\w.'’-]+|.{0,40}最后(?:编辑|更新)(?:于|时间)?|更新于|发布于|作者\s*[：:])"
DATE_META = r"\d{4}(?:[-/.]\d{1,2}(?:[-/.]\d{1,2})?|年\d{1,2}月(?:\d{1,2}日)?)(?:\s*[|·•]\s*[^|·•]{1,60})?"
HEAD_UI = r"share\s+this\s+(?:article|post|story)|分享本文|subscribe|follow|订阅|关注|copied\s+to\s+(?:the\s+)?clipboard|已复制到剪贴板"
META_LABELS = (r"\bcategory\b|类别\s*[：:]", r"\bproduct\b|产品\s*[：:]", r"\bdate\b|日期\s*[：:]", r"reading\s*time|阅读时间", r"copy\s*link|复制链接", r"\bshare\b|分享(?:\s*[：:]|复制链接)")
PLAYER = {
    "listen": r"(?:listen\s+to\s+(?:this\s+)?(?:article|post|story)|收听(?:本文|这篇文章|文章)|听(?:本文|这篇文章))(?:\s*[-–—:：]\s*\d{1,2}:\d{2})?",
    "status": r"audio\s+(?:is\s+)?ready(?:\s+to\s+play)?|音频(?:已)?准备(?:好播放|就绪|完成)|音频已准备好",
    "unsupported": r"your\s+browser\s+(?:does\s+not|doesn't)\s+support\s+(?:the\s+)?audio(?:\s+element)?|(?:您|你)的浏览器不支持音频(?:元素)?",
    "time": r"\d{1,3}:\d{2}(?:\s*/\s*\d{1,3}:\d{2})?",
    "list": r"reading\s+list|my\s+reading\s+list|bookmarks?|阅读列表|书签",
}
DECORATIVE = r"(?:logo|avatar|icon|favicon|emoji|badge|author|profile|portrait|sponsor|advert|tracking|pixel|spacer|sprite)"
EXPLANATORY = r"(?:chart|diagram|architecture|workflow|benchmark|figure|graph|flow|架构|流程|图表|示意|对比)"
#: What a way of finding a body counts for.
STRATEGY_BASE = {"semantic_container": 720, "article": 640, "jsonld_article_body": 520, "nested_content": 340, "main": 260, "largest_content": 120, "document_fallback": 0}


def has(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(f"(?iu){pattern}"), F.lit(False))


def whole(c: Column, pattern: str) -> Column:
    return F.coalesce(c.rlike(f"(?iu)^(?:{pattern})$"), F.lit(False))


def bare(c: Column) -> Column:
    """Without white space and colons at both ends."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), "^[ \t\r\n:：]+|[ \t\r\n:：]+$", "")


def title_key(c: Column) -> Column:
    """Letters and digits of a folded text, after marks that lead a breadcrumb."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"^[\s/\\|>›»·•:：-]+", "")), r"[^\p{L}\p{N}_]+", "")


def classify_region(attrs: Column) -> Column:
    """Whether a container's class, id, role or itemprop names an article, and whether they name something around one."""
    found = F.regexp_extract_all(F.coalesce(attrs, F.lit("")), F.lit(r"""(?is)\b(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)"""), F.lit(1))
    words = F.trim(F.regexp_replace(F.lower(F.array_join(found, " ")), "[^a-z0-9]+", " "))
    return F.struct(has(words, ARTICLE_SIGNAL).alias("article"), has(words, ARTICLE_NOISE).alias("noise"))


def region_limits(regions: DataFrame, semantic: int = 16, nested: int = 24, least: int = 400, page: str = "page_id") -> DataFrame:
    """The largest article-like containers of each page, and the largest others with enough text. regions: page, region, chars, article, noise."""
    kind = F.when(F.col("article") & ~F.col("noise"), "semantic").when(F.col("chars") >= least, "nested")
    place = F.row_number().over(W.partitionBy(page, "kind").orderBy(F.desc("chars"), "region"))
    ranked = regions.withColumn("kind", kind).where("kind is not null").withColumn("_place", place)
    return ranked.where(F.col("_place") <= F.when(F.col("kind") == "semantic", semantic).otherwise(nested)).drop("_place")


def _before(page: str, order: str, size: Column) -> Column:
    return F.coalesce(F.sum(size).over(W.partitionBy(page).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def tail_boundary(blocks: DataFrame, least: int = 400, heading: str = TAIL_HEADING, ui: str = TAIL_UI, promo: str = PROMO_HEADING, page: str = "page_id", order: str = "ord") -> DataFrame:
    """(page, boundary): the first block of each page's tail. That is the first stop marker after so many characters; behind
    a marker that is a heading, a promotion's heading up to eight blocks before it, with short blocks only in between,
    starts the tail earlier. Pages without a marker don't appear.
    """
    t = bare(F.col("text"))
    size = F.length(F.coalesce("text", F.lit("")))
    place = F.row_number().over(W.partitionBy(page).orderBy(order))
    b = blocks.select(page, order, "type", t.alias("t"), size.alias("size"), place.alias("i")).withColumn("before", _before(page, order, F.col("size")))
    b = b.withColumn("is_heading", whole(F.col("t"), heading)).withColumn("stop", (F.col("before") >= least) & (F.col("is_heading") | whole(F.col("t"), ui)))
    all_ = W.partitionBy(page)
    first = F.min(F.when(F.col("stop"), F.struct("i", "is_heading"))).over(all_)
    b = b.withColumn("first", first).where(F.col("first").isNotNull() & (F.col("i") <= F.col("first.i")))
    # the longest block from here to the one before the marker
    longest = F.max(F.when(F.col("i") < F.col("first.i"), F.col("size"))).over(all_.orderBy(order).rowsBetween(W.currentRow, W.unboundedFollowing))
    b = b.withColumn("longest", longest)
    early = F.col("first.is_heading") & (F.col("i") < F.col("first.i")) & (F.col("i") >= F.col("first.i") - 8) & (F.col("type") == "heading") & whole(F.col("t"), promo) & (F.col("before") >= least) & (F.col("longest") <= 320)
    return b.groupBy(page).agg(F.coalesce(F.min(F.when(early, F.col(order))), F.max(order)).alias("boundary"))


def cut_tail(blocks: DataFrame, boundary: DataFrame, page: str = "page_id", order: str = "ord") -> DataFrame:
    return blocks.join(boundary, page, "left").where(F.col("boundary").isNull() | (F.col(order) < F.col("boundary"))).drop("boundary")


def head_cut(blocks: DataFrame, labels: tuple[str, ...] = META_LABELS, ui: str = HEAD_UI, byline: str = BYLINE, date: str = DATE_META, page: str = "page_id", order: str = "ord") -> DataFrame:
    """(page, cut): how many blocks at each page's start are no prose.

    The longest of: a cluster of four labels among the first 24 blocks; the run of share controls that starts among the
    first 12; a breadcrumb that ends with the title among the first 7. Where none is found, a title before a byline. Then
    an author's portrait before a byline, and bylines, go as well. A portrait is a figure without words, nearly square and
    of known size, 900 pixels at most; blocks without columns for size, or with none known, hold no portrait.
    """
    t, c = bare(F.col("text")), F.col
    b = blocks.select(page, order, "type", t.alias("t"), F.coalesce("text", F.lit("")).alias("raw"), F.coalesce("links", F.array().cast("array<string>")).alias("links"), F.coalesce("link_chars", F.lit(0)).alias("link_chars"), F.row_number().over(W.partitionBy(page).orderBy(order)).alias("i"), *((c(x) if x in blocks.columns else F.lit(None).cast(t)).alias(f"_{x}") for x, t in (("width", "int"), ("height", "int"), ("alt", "string"), ("caption", "string"))))
    # no rule looks further than this, but a run of bylines may: it is followed on the whole page below
    b = b.withColumn("size", F.length("raw")).withColumn("before", _before(page, order, F.length("raw")))
    hits = F.lit(0)
    for label in labels:
        hits = hits + has(c("t"), f"(?:{label})").cast("int")
    b = b.withColumn("label", (c("i") <= 24) & c("type").isin("list", "paragraph") & (c("before") <= 1200) & (hits >= 4))
    b = b.withColumn("control", whole(c("t"), ui)).withColumn("share", (c("i") <= 12) & c("control") & (c("before") <= 800))
    crumb = c("type").isin("paragraph", "list") & (c("size") <= 180) & (c("raw").rlike(r"^[\s/\\|>›»·•:：-]") | (c("link_chars") >= 0.2 * F.greatest(c("size"), F.lit(1))) | (F.size("links") >= 2))
    w = W.partitionBy(page).orderBy(order)
    past = w.rowsBetween(W.unboundedPreceding, -1)
    b = b.withColumn("key", title_key(c("raw"))).withColumn("crumbs", F.min(crumb.cast("int")).over(past)).withColumn("keys", F.collect_list(F.when(c("i") <= 7, c("key"))).over(past))
    again = F.exists("keys", lambda k: k.endswith(c("key")))
    b = b.withColumn("title", (c("i") <= 7) & (c("i") > 1) & (c("type") == "heading") & (c("key") != "") & (F.coalesce(c("crumbs"), F.lit(0)) == 1) & again)
    b = b.withColumn("by", (F.length("t").between(1, 240)) & (has(c("t"), byline) | whole(c("t"), date)))
    shaped = (c("_width") > 0) & (c("_height") > 0) & (c("_width") / F.greatest(c("_height"), F.lit(1))).between(0.75, 1.33) & (F.greatest("_width", "_height") <= 900)
    silent = F.concat_ws("", "_alt", "_caption", "t") == ""
    named = F.coalesce(F.lead(has(c("t"), byline)).over(w), F.lit(False))
    b = b.withColumn("portrait", F.coalesce((c("type") == "figure") & shaped & silent & named, F.lit(False)))
    first = b.groupBy(page).agg(
        F.coalesce(F.min(F.when(c("label"), c("i"))), F.lit(0)).alias("a"), F.min(F.when(c("share"), c("i"))).alias("s"), F.coalesce(F.min(F.when(c("title"), c("i"))), F.lit(0)).alias("d"),
        F.max(F.when((c("i") == 1) & (c("type") == "heading"), 1).otherwise(0)).alias("headed"), F.max(F.when(c("i") == 2, F.when(c("by"), 1).when(c("portrait"), 1))).alias("second"), F.count("*").alias("n"),
    )
    j = b.join(first, page)
    # the end of the run of controls that begins at s, within the first 12
    past_run = F.min(F.when((c("i") > c("s")) & (~c("control") | (c("i") > 12)), c("i"))).over(W.partitionBy(page))
    run = F.when(c("s").isNull(), 0).otherwise(F.coalesce(past_run - 1, F.least(c("n"), F.lit(12))))
    cut = F.greatest("a", "d", "run")
    j = j.withColumn("run", run).withColumn("cut", F.when((cut == 0) & (c("headed") == 1) & (F.coalesce("second", F.lit(0)) == 1), 1).otherwise(cut))
    j = j.withColumn("skip", (c("i") == c("cut") + 1) & c("portrait")).withColumn("from", c("cut") + F.max(c("skip").cast("int")).over(W.partitionBy(page)))
    prose = F.min(F.when((c("i") > c("from")) & ~c("by"), c("i"))).over(W.partitionBy(page))
    return j.withColumn("prose", prose).groupBy(page).agg(F.max(F.coalesce(c("prose") - 1, c("n"))).cast("long").alias("cut"))


def player_role(c: Column, links: Column, roles: dict[str, str] = PLAYER) -> Column:
    out = F.lit("")
    for role, pattern in reversed(roles.items()):
        out = F.when(whole(bare(c), pattern), role).otherwise(out)
    book = F.coalesce(F.exists(links, lambda x: F.contains(F.lower(x), F.lit("/showbookmarks.action"))), F.lit(False))
    return F.when(bare(c) == "", "blank").when((out == "") & book, "list").otherwise(out)


def embedded_ui(blocks: DataFrame, roles: dict[str, str] = PLAYER, page: str = "page_id", order: str = "ord") -> DataFrame:
    """blocks without players. Around a label, status or fallback of one, from four blocks before to eight behind, there must
    be three blocks of players, two kinds of the three, and a time or list; then those blocks go. Single words never do.
    """
    w = W.partitionBy(page).orderBy(order)
    around = w.rowsBetween(-4, 8)
    role = F.col("_role")
    told = (role != "") & (role != "blank")
    b = blocks.withColumn("_role", player_role(F.col("text"), F.col("links"), roles))
    kinds = F.collect_set(F.when(told, role)).over(around)
    primary = F.array(*(F.lit(x) for x in ("listen", "status", "unsupported")))
    proven = role.isin("listen", "status", "unsupported") & (F.count_if(told).over(around) >= 3) & (F.size(F.array_intersect(kinds, primary)) >= 2) & F.arrays_overlap(kinds, F.array(F.lit("time"), F.lit("list")))
    b = b.withColumn("_proven", proven)
    near = F.coalesce(F.max(F.col("_proven").cast("int")).over(w.rowsBetween(-8, 4)), F.lit(0)) == 1
    return b.withColumn("_gone", told & near).where(~F.col("_gone")).drop("_role", "_proven", "_gone")


def repeated_promos(blocks: DataFrame, promo: str = PROMO_BLOCK, page: str = "page_id", order: str = "ord") -> DataFrame:
    """(page, ord) of short promotions that come again on their page, by a link or by their text."""
    t = bare(F.col("text"))
    p = blocks.select(page, order, t.alias("t"), F.coalesce("links", F.array().cast("array<string>")).alias("links")).where((F.col("t") != "") & (F.length("t") <= 240) & has(F.col("t"), promo))
    keyed = p.select(page, order, F.explode(F.array_append(F.transform("links", lambda x: F.concat(F.lit("l:"), x)), F.concat(F.lit("t:"), title_key(F.col("t"))))).alias("k"))
    twice = keyed.groupBy(page, "k").agg(F.count_distinct(order).alias("n")).where("n >= 2").select(page, "k")
    return keyed.join(twice, [page, "k"], "left_semi").select(page, order).distinct()


def terminal_promos(blocks: DataFrame, promo: str = TERMINAL_PROMO, page: str = "page_id", order: str = "ord") -> DataFrame:
    """blocks without the run of short linked calls to act at each page's end."""
    t, size = bare(F.col("text")), F.length(F.coalesce("text", F.lit("")))
    call = (F.col("type") == "paragraph") & F.length(t).between(1, 180) & (F.size(F.coalesce("links", F.array().cast("array<string>"))) > 0) & (F.coalesce("link_chars", F.lit(0)) >= 0.15 * F.greatest(size, F.lit(1))) & whole(t, promo)
    rest = W.partitionBy(page).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, W.currentRow)
    return blocks.withColumn("_call", F.coalesce(call, F.lit(False))).withColumn("_all", F.min(F.col("_call").cast("int")).over(rest)).where("_all = 0").drop("_call", "_all")


def select_figures(figures: DataFrame, maximum: int | None = None, page: str = "page_id", order: str = "ord") -> DataFrame:
    """figures with why each is left out, else null: duplicate, decorative, author, small, limit.

    Expects src, alt, caption, width, height (0 if unknown) and next_byline. A figure that another rule leaves out is no
    original of a duplicate. With a maximum, the best by caption, alt text, size and explanatory words stay.
    """
    c = F.col
    path = F.regexp_replace(F.regexp_extract("src", "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#;]*)", 1), "/+$", "")
    identity = F.lower(F.concat_ws("|", F.regexp_extract("src", "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.when(c("src").contains("://"), path).otherwise(F.regexp_replace(F.regexp_extract("src", "^([^?#;]*)", 1), "/+$", ""))))
    described = F.concat_ws(" ", "src", "alt", "caption")
    known = (c("width") > 0) & (c("height") > 0)
    portrait = F.coalesce("next_byline", F.lit(False)) & (F.coalesce("alt", F.lit("")) == "") & (F.coalesce("caption", F.lit("")) == "") & known & (c("width") / F.greatest(c("height"), F.lit(1))).between(0.75, 1.33) & (F.greatest("width", "height") <= 900)
    own = F.when(has(described, DECORATIVE), "decorative").when(portrait, "author").when(known & ((c("width") < 240) | (c("height") < 120)), "small")
    f = figures.withColumn("_id", identity).withColumn("_own", own)
    earlier = F.coalesce(F.max(c("_own").isNull().cast("int")).over(W.partitionBy(page, "_id").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) == 1
    f = f.withColumn("reason", F.when(earlier, "duplicate").otherwise(c("_own")))
    if maximum is not None:
        score = F.when(F.coalesce("caption", F.lit("")) != "", 5).otherwise(0) + F.when(F.coalesce("alt", F.lit("")) != "", 2).otherwise(0) + F.when((c("width") >= 640) & (c("height") >= 240), 3).otherwise(0) + F.when(has(described, EXPLANATORY), 6).otherwise(0)
        place = F.row_number().over(W.partitionBy(page, c("reason").isNull()).orderBy(F.desc(score), order))
        f = f.withColumn("reason", F.when(c("reason").isNull() & (place > maximum), "limit").otherwise(c("reason")))
    return f.drop("_id", "_own")


def plain_text(blocks: DataFrame, page: str = "page_id", order: str = "ord") -> DataFrame:
    """(page, text): blocks in order with blank lines between."""
    rows = F.sort_array(F.collect_list(F.struct(order, "text")))
    return blocks.where(F.coalesce(F.trim("text"), F.lit("")) != "").groupBy(page).agg(F.array_join(F.transform(rows, lambda x: x["text"]), "\n\n").alias("text"))


def text_to_blocks(c: Column, longest: int = 1600) -> Column:
    """Paragraphs of a text between blank lines; a single one that is too long is cut behind sentence marks."""
    clean = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"(?:\r?\n){2,}"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " "))), lambda p: p != "")
    one = F.get(clean, F.lit(0))
    return F.when((F.size(clean) == 1) & (F.length(one) > longest), F.filter(F.split(one, r"(?<=[。！？.!?])\s+"), lambda p: p != "")).otherwise(clean)


def integrity(blocks: DataFrame, page: str = "page_id", order: str = "ord") -> DataFrame:
    """Per page: characters, headings, tables, figures, share of link text, repeated blocks, and pass or suspect."""
    size, key = F.length(F.coalesce("text", F.lit(""))), title_key(F.col("text"))
    long_ = F.when(size >= 8, key)
    g = blocks.groupBy(page).agg(
        F.coalesce(F.sum(size), F.lit(0)).alias("chars"), F.sum(F.coalesce("link_chars", F.lit(0))).alias("linked"), F.count("*").alias("blocks"), F.count(long_).alias("n"), F.count_distinct(long_).alias("k"),
        F.count_if(F.col("type") == "heading").alias("headings"), F.count_if(F.col("type") == "table").alias("tables"), F.count_if(F.col("type") == "figure").alias("figures"),
    )
    ratio, again = F.col("linked") / F.greatest(F.col("chars"), F.lit(1)), F.col("n") - F.col("k")
    suspect = (ratio > 0.42) | ((again >= 3) & (again / F.greatest(F.col("n"), F.lit(1)) >= 0.12))
    return g.select(page, "chars", "blocks", "headings", "tables", "figures", F.bround(ratio, 4).alias("link_ratio"), again.alias("repeats"), F.when(suspect, "suspect").otherwise("pass").alias("quality"))


def extraction_score(strategy: Column, chars: Column, headings: Column, tables: Column, figures: Column, link_ratio: Column, quality: Column, removed: Column, raw: Column, depth: Column, focus: Column) -> Column:
    """What a candidate body counts for: how it was found, its text and structure, a focus on the article, less links, cuts and doubts."""
    base = F.coalesce(F.create_map(*(F.lit(x) for kv in STRATEGY_BASE.items() for x in kv))[strategy], F.lit(0))
    shape = F.least(F.lit(120), headings * 12 + tables * 40 + figures * 10)
    near = F.when(focus.between(0.45, 0.97), 180).when((focus >= 0.25) & (focus < 0.45), 40).when(focus < 0.25, -180).when(focus > 0.985, -40).otherwise(0)
    bonus = F.when(strategy == "nested_content", near + F.least(F.lit(80), F.greatest(depth, F.lit(0)) * 8)).otherwise(0)
    cuts = F.least(F.lit(320.0), removed / F.greatest(raw, F.lit(1)) * 480)
    return F.round(base + F.least(F.lit(360.0), chars / 12) + shape + bonus - F.least(F.lit(240.0), link_ratio * 480) - cuts - F.when(quality != "pass", 600).otherwise(0), 2)


def choose_body(candidates: DataFrame, page: str = "page_id") -> DataFrame:
    """The best candidate of each page: of equal bodies the best scored, then one that passes before one that is suspect,
    then by score. candidates: page, candidate, signature, quality, score."""
    one = F.row_number().over(W.partitionBy(page, "signature").orderBy(F.desc("score"), "candidate"))
    best = F.row_number().over(W.partitionBy(page).orderBy(F.desc(F.col("quality") == "pass"), F.desc("score"), "candidate"))
    return candidates.withColumn("_one", one).where("_one = 1").withColumn("_best", best).where("_best = 1").drop("_one", "_best")


def media_policy(figures: DataFrame, noindex: Column, allowed: list[str], limit: int = 12, event: str = "event_id") -> DataFrame:
    """figures with why each isn't fetched, else null: rights, no_url, cross_site, not_retryable, limit.

    Expects src_host, page_host, src, retryable and ord.
    """
    from eventlake.functions.text import same_site

    c = F.col
    own = F.when(F.coalesce(noindex, F.lit(False)), "rights").when(F.coalesce("src", F.lit("")) == "", "no_url").when(~F.coalesce(same_site(c("src_host"), c("page_host"), allowed), F.lit(False)), "cross_site").when(~F.coalesce("retryable", F.lit(True)), "not_retryable")
    f = figures.withColumn("reason", own)
    place = F.row_number().over(W.partitionBy(event, c("reason").isNull()).orderBy("ord"))
    return f.withColumn("reason", F.when(c("reason").isNull() & (place > limit), "limit").otherwise(c("reason")))


def apply_node_texts(blocks: DataFrame, texts: DataFrame, page: str = "page_id") -> tuple[DataFrame, DataFrame]:
    """(blocks with the texts of their nodes, counts per page: applied, ignored, missing). blocks: page, node, text; texts:
    page, node, place, text, of which the first for a node counts."""
    first = texts.groupBy(page, "node").agg(F.min_by("text", "place").alias("new"), F.count("*").alias("k"))
    j = blocks.select(page, "node", "text").join(first, [page, "node"], "full_outer")
    mine = blocks.select(page, "node").distinct().withColumn("mine", F.lit(True))
    told = j.join(mine, [page, "node"], "left")
    counts = told.groupBy(page).agg(F.count_if(F.col("mine") & F.col("new").isNotNull()).alias("applied"), F.coalesce(F.sum(F.when(F.col("mine").isNull(), F.col("k"))), F.lit(0)).alias("ignored"), F.count_if(F.col("mine") & F.col("k").isNull()).alias("missing"))
    return told.where("mine").select(page, "node", F.coalesce("new", "text").alias("text")), counts


def prefer_feed_body(page_body: DataFrame, feed_body: DataFrame, key: str = "norm", least: int = 400, share: float = 0.9) -> DataFrame:
    """(key, origin): the feed's body where it is long enough and scores nearly as well as the page's. Both: key, chars, score."""
    f = feed_body.select(key, F.col("chars").alias("_chars"), F.col("score").alias("_score"))
    j = page_body.join(f, key, "full_outer")
    better = (F.col("_chars") >= least) & (F.col("score").isNull() | (F.col("_score") >= share * F.col("score")))
    return j.select(key, F.when(F.coalesce(better, F.lit(False)), "feed").when(F.col("score").isNotNull(), "page").alias("origin"))


def narration(segments: DataFrame, limit: int = 350, most: int = 8, key: str = "event_id", order: str = "place") -> DataFrame:
    """(key, script): segments in order, without those that an earlier one equals or holds (24 characters or more), up to the
    limit of characters or segments."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("chars"), F.lit(False).alias("full"))

    def add(acc: Column, s: Column) -> Column:
        again = F.exists(acc["kept"], lambda k: (k == s) | ((F.length(s) >= 24) & F.contains(k, s)))
        over = (acc["chars"] + F.length(s) > limit) | (F.size(acc["kept"]) >= most)
        skip = acc["full"] | again | over
        return F.struct(F.when(skip, acc["kept"]).otherwise(F.array_append(acc["kept"], s)).alias("kept"), F.when(skip, acc["chars"]).otherwise(acc["chars"] + F.length(s)).alias("chars"), (acc["full"] | (over & ~again)).alias("full"))

    rows = F.transform(F.sort_array(F.collect_list(F.struct(order, "text"))), lambda x: x["text"])
    return segments.where(F.coalesce(F.trim("text"), F.lit("")) != "").groupBy(key).agg(F.array_join(F.aggregate(rows, start, add, lambda acc: acc["kept"]), " ").alias("script"))


def narration_queue(scripts: DataFrame, manifest: DataFrame, limit: int = 8, least: int = 80) -> DataFrame:
    """Newest events whose script is long enough and has changed since it was spoken. scripts: event_id, seen, script; manifest: event_id, hash.

    Scripts are read from the newest events on, as only the first ones that are due count: those of the newest few, then of
    more, and only where these don't hold enough, all.
    """

    def due(s: DataFrame, spoken: DataFrame) -> DataFrame:
        told = s.where(F.length("script") >= least).withColumn("hash", F.sha2("script", 256))
        return told.join(spoken.select("event_id", "hash"), ["event_id", "hash"], "left_anti").orderBy(F.desc("seen"), "event_id").limit(limit)

    for n in (8 * limit, 128 * limit):
        newest = scripts.select("event_id", "seen").orderBy(F.desc("seen"), "event_id").limit(n).withColumn("seen", F.col("seen").cast("string")).collect()  # keys only
        if len(newest) < n or newest[-1].seen is None:
            break
        ids = sorted({r.event_id for r in newest})
        last = F.lit(newest[-1].seen).cast(scripts.schema["seen"].dataType)
        head = scripts.where((F.col("seen") > last) | ((F.col("seen") == last) & (F.col("event_id") <= F.lit(newest[-1].event_id))))
        found = keep(due(head.where(F.col("event_id").isin(ids)), manifest.where(F.col("event_id").isin(ids))), "narration-due")
        if found.count() == limit:
            return found.orderBy(F.desc("seen"), "event_id")
    return due(scripts, manifest)
