"""Which entries of sources go on: time, path and keyword rules per source, vocabulary rules, and what a source gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlake.functions.scores import safe_ratio
from eventlake.functions.text import clean_text
from eventlake.operators.events import first_reason, streaks

#: Tiers whose entries need an accepted verdict.
REVIEW_TIERS = ("low_precision", "community_targeted", "media_low")


def config_join(entries: DataFrame, sources: DataFrame, key: str = "source") -> DataFrame:
    """entries with their source's configuration; an unknown source has none. The smaller side is Spark's to broadcast."""
    return entries.join(sources, key, "left")


def keyword_in(word: Column, text: Column) -> Column:
    """Whether a folded text holds a folded word: letters and digits of up to three characters as a word, others anywhere."""
    short = word.rlike("^[a-z0-9]{1,3}$")
    return F.when(short, F.regexp_like(text, F.concat(F.lit("(^|[^a-z0-9])"), word, F.lit("($|[^a-z0-9])")))).otherwise(F.contains(text, word))


def _any(words: Column, test) -> Column:  # noqa: ANN001
    return F.coalesce(F.exists(words, test), F.lit(False))


def _some(words: Column) -> Column:
    return F.coalesce(F.size(words) > 0, F.lit(False))


def drop_reason(now: Column, default_days: int = 7) -> Column:
    """The first rule that an entry breaks, else null: missing_date, time, path, keyword, excluded.

    Expects the entry's published, link, title and summary, and its source's lookback_days, require_published, path_include,
    path_exclude, include_keywords and exclude_keywords.
    """
    c = F.col
    cutoff = F.unix_micros(now.cast("timestamp")) - F.coalesce(c("lookback_days"), F.lit(default_days)).cast("long") * 86_400_000_000
    hay = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")), F.coalesce("link", F.lit(""))))
    link = F.coalesce("link", F.lit(""))
    inside = _any(c("path_include"), lambda p: F.contains(link, p))
    outside = _any(c("path_exclude"), lambda p: F.contains(link, p))

    def match(k: Column) -> Column:
        return keyword_in(F.lower(k), hay)

    return first_reason(
        ("missing_date", F.coalesce("require_published", F.lit(False)) & c("published").isNull()),
        ("time", F.unix_micros(c("published").cast("timestamp")) < cutoff),
        ("path", (_some(c("path_include")) & ~inside) | outside),
        ("keyword", _some(c("include_keywords")) & ~_any(c("include_keywords"), match)),
        ("excluded", _any(c("exclude_keywords"), match)),
    )


def prefilter(entries: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """entries with drop_reason."""
    return config_join(entries, sources).withColumn("drop_reason", drop_reason(now))


def prefilter_stats(judged: DataFrame) -> DataFrame:
    """Per source: entries, kept ones, dropped ones, and the dropped by reason."""
    r = F.col("drop_reason")
    reasons = [F.count_if(r == x).alias(x) for x in ("missing_date", "time", "path", "keyword", "excluded")]
    return judged.groupBy("source").agg(F.count("*").alias("fetched"), F.count_if(r.isNull()).alias("eligible"), F.count(r).alias("prefiltered"), *reasons)


def rule_reason(text: Column, passes: Column, positive: list[str], negative: list[str]) -> Column:
    """Why a candidate is dropped by vocabulary: a negative term, or no positive one; accepted and vendors' own pass."""
    folded = F.lower(text)

    def has(terms: list[str]) -> Column:
        out = F.lit(False)
        for t in terms:
            out = out | F.contains(folded, F.lit(t.lower()))
        return out

    return F.when(F.coalesce(passes, F.lit(False)), None).when(has(negative), "negative").when(~has(positive), "no_signal")


def empty_release(source: Column, text: Column, of: str, markers: list[str]) -> Column:
    """Whether a release note of the source says that there is nothing to announce."""
    folded, out = F.lower(clean_text(text)), F.lit(False)
    for m in markers:
        out = out | F.contains(folded, F.lit(m))
    return F.coalesce(source == of, F.lit(False)) & out


def fail_closed(candidates: DataFrame, verdicts: DataFrame, key: str = "id") -> DataFrame:
    """Candidates of tiers under review stay only with an accepted verdict; others unless they are rejected.

    candidates: key, tier, ...; verdicts: key, status.
    """
    told = candidates.join(verdicts.groupBy(key).agg(F.max("status").alias("_status")), key, "left")
    review = F.coalesce(F.col("tier").isin(*REVIEW_TIERS), F.lit(False))
    ok = F.coalesce(F.col("_status") == "accepted", F.lit(False)) | (~review & ~F.coalesce(F.col("_status") == "rejected", F.lit(False)))
    return told.where(ok).drop("_status")


def scorecard(runs: DataFrame, low: int = 3) -> DataFrame:
    """Per source over its runs: totals, acceptance rate, runs in a row without an accepted one, and what to do about it.

    runs: source, run, candidates, accepted, failed. Failed runs and those without candidates leave the streak as it is.
    """
    totals = runs.groupBy("source").agg(F.sum("candidates").alias("candidates"), F.sum("accepted").alias("accepted"), F.count_if("failed").alias("failures"), safe_ratio(F.sum("accepted"), F.sum("candidates")).alias("rate"))
    neutral = F.col("failed") | (F.col("candidates") == 0)
    row = streaks(runs, "source", "run", F.col("accepted") == 0, neutral)
    advice = F.when(F.col("streak") >= low, "review").otherwise("keep")
    return totals.join(row, "source", "left").withColumn("streak", F.coalesce("streak", F.lit(0))).withColumn("advice", advice)


def accepted_by_category(items: DataFrame, accepted: DataFrame) -> DataFrame:
    """(source, category, n): accepted items by source and the category of the event that they ended in.

    items: item, source, category; accepted: item.
    """
    named = items.where(F.coalesce(F.col("source"), F.lit("")) != "").withColumn("category", F.coalesce("category", F.lit("platform")))
    return named.join(accepted.select("item").distinct(), "item", "left_semi").groupBy("source", "category").agg(F.count("*").alias("n"))


def source_type_groups(sources: DataFrame) -> DataFrame:
    """Per type: sources that are on, off, and on but failing. sources: type, enabled, fails."""
    on = F.coalesce("enabled", F.lit(False))
    failing = on & (F.coalesce("fails", F.lit(0)) > 0)
    return sources.groupBy("type").agg(F.count("*").alias("sources"), F.count_if(on).alias("enabled"), F.count_if(~on).alias("disabled"), F.count_if(failing).alias("failing"))


def source_due(sources: DataFrame, attempts: DataFrame, now: Column) -> DataFrame:
    """(source, due, why): sources by their last attempt. every_run without an interval, retry_after_failure, never_fetched,
    interval_elapsed, or frequency_gate with the minutes left. sources: source, interval_hours; attempts: source, at, failed.
    """
    last = attempts.groupBy("source").agg(F.max("at").alias("at"), F.max_by("failed", "at").alias("failed"))
    j = sources.join(last, "source", "left")
    left = F.col("interval_hours") * 60 - (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))) / 60_000_000
    why = (
        F.when(F.col("interval_hours") == 0, "every_run").when(F.col("failed"), "retry_after_failure").when(F.col("at").isNull(), "never_fetched")
        .when(left <= 0, "interval_elapsed").otherwise("frequency_gate")
    )
    minutes = F.when(why == "frequency_gate", F.greatest(F.lit(1), F.floor(left)).cast("long"))
    return j.select("source", (why != "frequency_gate").alias("due"), why.alias("why"), minutes.alias("minutes_left"))


def source_badge(name: Column, kind: Column, type_: Column, badges: dict[str, list[str]], default: str) -> Column:
    """The badge whose words the source's name, kind or type holds first, in order of the badges."""
    hay = F.lower(F.concat_ws(" ", name, kind, type_))
    out = F.lit(default)
    for badge, words in reversed(badges.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(hay, F.lit(w.lower()))
        out = F.when(hit, badge).otherwise(out)
    return out


def category_label(key: Column, old: Column, labels: dict[str, str]) -> Column:
    """The label of a category; one that isn't known keeps the label that it has, else its own name."""
    known = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))
    return F.coalesce(known[key], F.nullif(old, F.lit("")), key)


def relabel(records: DataFrame, labels: dict[str, str], key: str = "category", label: str = "category_label") -> DataFrame:
    """records with today's labels, and `relabelled`, whether the stored one was another; unknown categories keep theirs."""
    known = F.create_map(*(F.lit(x) for kv in labels.items() for x in kv))[F.col(key)]
    changed = known.isNotNull() & ~F.col(label).eqNullSafe(known)
    return records.withColumn("relabelled", changed).withColumn(label, F.coalesce(known, F.col(label)))
