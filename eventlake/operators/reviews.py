"""Reviewed batches, checks of rows and tags, and reports over catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from eventlake.functions import scores, text


def _codes(*rules: tuple[str, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), code) for code, bad in rules)))


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


REQUIRED = ("title", "summary", "reason", "body", "source_title", "source_url", "published")


def validate_batch(rows: DataFrame, categories: list[str], shelves: tuple[str, ...] = ("news", "evergreen")) -> DataFrame:
    """rows with errors: missing texts, unknown category or shelf, times that don't parse, half a discovery, URLs twice."""
    url, found = text.norm_url_strict(F.col("source_url")), text.norm_url_strict(F.nullif(F.trim("discovery_url"), F.lit("")))
    r = rows.withColumn("_u", url).withColumn("_d", found)
    twice = F.count("*").over(W.partitionBy("_u")) > 1
    again = F.col("_d").isNotNull() & (F.count("*").over(W.partitionBy("_d")) > 1)
    errors = _codes(
        *((f"missing_{c}", _blank(c)) for c in REQUIRED), ("category", ~F.coalesce(F.col("category").isin(*categories), F.lit(False))), ("shelf", ~F.coalesce("shelf", F.lit("news")).isin(*shelves)),
        ("published", ~_blank("published") & scores.parse_date_multi(F.col("published")).isNull()), ("discovery_pair", _blank("discovery_url") != _blank("discovery_account")), ("duplicate_url", ~_blank("source_url") & twice), ("duplicate_discovery", again),
    )
    return r.withColumn("errors", errors).drop("_u", "_d")


def match_batch(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows (place, source_url, discovery_url, ...) with event and outcome: added without an event of the URL, enriched where
    that event lacks the discovery's link, else unchanged. links: event, link."""
    known = links.select("event", text.norm_url_strict(F.col("link")).alias("norm")).groupBy("norm").agg(F.max("event").alias("event"))
    own = links.select(F.col("event").alias("_e"), text.norm_url_strict(F.col("link")).alias("_d")).distinct().withColumn("_has", F.lit(True))
    r = rows.withColumn("norm", text.norm_url_strict(F.col("source_url"))).withColumn("_dn", text.norm_url_strict(F.nullif(F.trim(F.coalesce("discovery_url", F.lit(""))), F.lit(""))))
    j = r.join(known, "norm", "left")
    j = j.join(own, (j["event"] == own["_e"]) & (j["_dn"] == own["_d"]), "left")
    outcome = F.when(F.col("event").isNull(), "added").when(F.col("_dn").isNotNull() & F.col("_has").isNull(), "enriched").otherwise("unchanged")
    return j.withColumn("outcome", outcome).drop("norm", "_dn", "_e", "_d", "_has")


def batch_report(matched: DataFrame) -> DataFrame:
    o = F.col("outcome")
    return matched.agg(F.count("*").alias("records"), *(F.count_if(o == x).alias(x) for x in ("added", "enriched", "unchanged")))


def schema_errors(schema: dict, c: Column, path: str = "$") -> Column:
    """Array of path:rule for what a value breaks of a JSON-Schema subset: type object, array, string or integer; required,
    enum, minLength, maxLength, pattern, minimum, maximum, minItems, maxItems, uniqueItems. The value is a typed column, so
    that a type is wrong only where it is null."""
    none = F.array().cast("array<string>")

    def told(*rules: tuple[str, Column]) -> Column:
        return F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), f"{path}:{rule}") for rule, bad in rules))) if rules else none

    kind = schema.get("type")
    if kind == "object":
        need = set(schema.get("required", ()))
        parts = [told(*((f"required.{k}", c[k].isNull()) for k in schema["properties"] if k in need))]
        parts += [schema_errors(sub, c[k], f"{path}.{k}") for k, sub in schema["properties"].items()]
        return F.concat(*parts)
    rules: list[tuple[str, Column]] = []
    if kind == "array":
        n = F.size(c)
        rules += [("minItems", n < schema["minItems"])] if "minItems" in schema else []
        rules += [("maxItems", n > schema["maxItems"])] if "maxItems" in schema else []
        rules += [("uniqueItems", F.size(F.array_distinct(c)) < n)] if schema.get("uniqueItems") else []
        inner = F.array_distinct(F.flatten(F.transform(c, lambda x: schema_errors(schema["items"], x, f"{path}[*]")))) if "items" in schema else none
        return F.concat(told(*rules), F.coalesce(inner, none))
    if kind == "string":
        n = F.length(c)
        rules += [("minLength", n < schema["minLength"])] if "minLength" in schema else []
        rules += [("maxLength", n > schema["maxLength"])] if "maxLength" in schema else []
        rules += [("pattern", ~c.rlike(schema["pattern"]))] if "pattern" in schema else []
    if kind == "integer":
        rules += [("minimum", c < schema["minimum"])] if "minimum" in schema else []
        rules += [("maximum", c > schema["maximum"])] if "maximum" in schema else []
    rules += [("enum", ~c.isin(*schema["enum"]))] if "enum" in schema else []
    return told(*rules)


def tag_errors(tags: Column, vocabulary: dict[str, list[str]], most: int = 2) -> Column:
    """What is wrong with a struct of tag lists: unknown or repeated values, too many, by dimension."""
    rules = []
    for name, words in vocabulary.items():
        c = tags[name]
        rules += [(f"{name}_unknown", F.size(F.array_except(c, F.array(*(F.lit(w) for w in words)))) > 0), (f"{name}_repeated", F.size(F.array_distinct(c)) < F.size(c)), (f"{name}_many", F.size(c) > most)]
    return F.when(tags.isNull(), F.array(F.lit("missing"))).otherwise(_codes(*rules))


def tag_audit(rows: DataFrame, dimensions: list[str], key: str = "event_id") -> DataFrame:
    """(dimension, value, rows, share): how many rows hold each tag of each dimension. The rows' total is one scalar."""
    total = rows.agg(F.count("*").alias("_n"))
    long_ = None
    for name in dimensions:
        part = rows.select(key, F.lit(name).alias("dimension"), F.explode(F.array_distinct(F.col(f"tags.{name}"))).alias("value"))
        long_ = part if long_ is None else long_.union(part)
    return long_.groupBy("dimension", "value").agg(F.count("*").alias("rows")).join(F.broadcast(total)).select("dimension", "value", "rows", scores.safe_ratio(F.col("rows"), F.col("_n")).alias("share"))


def extraction_metrics(reports: DataFrame) -> DataFrame:
    """Counts of extracted pages by strategy, by quality, by mode, by source, and of all; figures and tables added up.

    reports: strategy, quality, mode, source, ready, figures, tables.
    """
    names = ("strategy", "quality", "mode", "source")
    sums = [F.count("*").alias("attempted"), F.count_if("ready").alias("ready"), F.sum("figures").alias("figures"), F.sum("tables").alias("tables")]
    return reports.groupingSets([*([F.col(n)] for n in names), []], *(F.col(n) for n in names)).agg(*sums)


def catalog_metrics(bodies: DataFrame, least: int = 120, version: str = "v1") -> DataFrame:
    """One row: structured bodies, those that can be shown, suspect and trimmed ones, and those of an older version.

    bodies: blocks, chars, quality, removed, version.
    """
    c = F.col
    has = c("blocks") > 0
    return bodies.agg(
        F.count("*").alias("events"), F.count_if(has).alias("structured"), F.count_if(has & (c("chars") >= least)).alias("renderable"), F.count_if(has & (c("quality") == "suspect")).alias("suspect"),
        F.count_if(has & (c("removed") > 0)).alias("trimmed"), F.count_if(has & F.coalesce(c("version") != version, F.lit(True))).alias("debt"),
    )


def error_summary(validated: DataFrame, errors: str = "errors") -> DataFrame:
    """(error, rows) over an array of codes per row."""
    return validated.select(F.explode(errors).alias("error")).groupBy("error").agg(F.count("*").alias("rows"))


def reading_list(events: DataFrame, n: int = 3) -> DataFrame:
    """(topic, event_id, place): evergreen events of each topic, pinned first, then by importance and time. events: event_id, topics, evergreen, pinned, importance, published."""
    each = events.where("evergreen").select("event_id", F.explode("topics").alias("topic"), "pinned", "importance", "published")
    place = F.row_number().over(W.partitionBy("topic").orderBy(F.desc("pinned"), F.desc("importance"), F.desc("published"), "event_id"))
    return each.withColumn("place", place).where(F.col("place") <= n).select("topic", "event_id", "place")


def classics_by_topic(events: DataFrame, topics: DataFrame, other: str = "other") -> DataFrame:
    """(topic, event_id): evergreen events under each of their known topics, and under `other` where they have none."""
    each = events.where("evergreen").select("event_id", F.explode_outer("topics").alias("topic"))
    known = each.join(topics.select("topic").distinct(), "topic", "left_semi").select("topic", "event_id").distinct()
    rest = events.where("evergreen").select("event_id").join(known, "event_id", "left_anti").select(F.lit(other).alias("topic"), "event_id")
    return known.union(rest)


def priority_union(preferred: DataFrame, configured: DataFrame, key: str = "name") -> DataFrame:
    """(name, place): preferred names in their order, then the other configured ones in theirs. Both: name, rank; short lists."""
    p = preferred.join(configured.select(key), key, "left_semi").select(key, F.lit(0).alias("g"), "rank")
    rest = configured.join(preferred.select(key), key, "left_anti").select(key, F.lit(1).alias("g"), "rank")
    return p.union(rest).withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("g", "rank", key))).select(key, "place")


def no_image_index(html: Column) -> Column:
    """Whether a page's robots rules keep its images out of indexes."""
    found = F.regexp_extract_all(html, F.lit(r"""(?is)<meta\s[^>]*name=["']?(?:robots|googlebot)["']?[^>]*>"""), F.lit(0))
    return F.coalesce(F.exists(found, lambda x: F.contains(F.lower(x), F.lit("noimageindex"))), F.lit(False))


def star(importance: Column) -> Column:
    return F.coalesce(importance >= 75, F.lit(False))
