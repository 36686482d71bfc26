"""Time and scoring expressions. `now` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_LIFE_H = 48.0
#: After zone names became offsets and fractions of seconds were cut off.
FORMATS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ssXXX", "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm", "yyyy-MM-dd", "yyyy/MM/dd", "d MMM yyyy HH:mm:ss", "d MMM yyyy", "MMM d, yyyy", "MMMM d, yyyy")
#: Zone names of mail dates, in hours from UTC.
ZONES = {"GMT": 0, "UTC": 0, "UT": 0, "Z": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7}


def parse_date_multi(c: Column) -> Column:
    """The first format that reads the text; without a zone it is UTC; else null."""
    # the day of the week says nothing that the date doesn't
    bare = F.regexp_replace(F.trim(c), "^(?i:mon|tue|wed|thu|fri|sat|sun)[a-z]*,? +", "")
    bare = F.regexp_replace(bare, r"(:\d{2})[.,]\d+", "$1")
    for name, hours in ZONES.items():
        bare = F.regexp_replace(bare, rf"(?i)(?<=\d) +{name}$", f" {'-' if hours < 0 else '+'}{abs(hours):02d}00")
    # an ISO time's offset may stand without a colon
    bare = F.regexp_replace(bare, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}) ?([+-]\d{2})(\d{2})$", "$1$2:$3")
    # bound once, or the text would be cleaned anew for every format
    return F.get(F.transform(F.array(bare), lambda b: F.coalesce(*(F.try_to_timestamp(b, F.lit(f)) for f in FORMATS))), F.lit(0))


#: Where pages say when they were published, in order of trust.
META_DATES = (
    r'property="article:published_time" content="([^"]+)',
    r'"datePublished"\s*:\s*"([^"]+)',
    r'name="date" content="([^"]+)',
    r'itemprop="datePublished"[^>]*content="([^"]+)',
    r'<time[^>]*datetime="([^"]+)"',
)


def meta_date(html: Column) -> Column:
    """The first of the page's dates that reads as one between 2005 and 2100, else null."""
    said = F.array(*(F.left(F.regexp_extract(html, p, 1), F.lit(30)) for p in META_DATES))
    return F.get(F.filter(F.transform(said, parse_date_multi), lambda d: F.year(d).between(2005, 2100)), F.lit(0))


def backfill_date(published: Column, page: Column, now: Column) -> Column:
    """A missing date from the page, unless that lies more than a day ahead."""
    return F.coalesce(published, F.when(page <= now + F.expr("INTERVAL 1 DAY"), page))


def clamp_future(ts: Column, now: Column, hours: int = 2) -> Column:
    return F.when(ts > now + F.expr(f"INTERVAL {hours} HOURS"), now).otherwise(ts)


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 3.6e9


def editorial_time(published: Column, first_seen: Column) -> Column:
    return F.coalesce(published, first_seen)


def discovery_time(published: Column, first_seen: Column) -> Column:
    return F.coalesce(first_seen, published)


def recency_time(published: Column, first_seen: Column) -> Column:
    return F.greatest(published, first_seen)


def age_bucket(ts: Column, now: Column) -> Column:
    h = hours_between(now, ts)
    return F.when(h < 1, "hour").when(h < 24, "day").when(h < 168, "week").otherwise("older")


def completed_week(now: Column, shift_hours: int = 8) -> Column:
    """Monday of the last full week, in local days."""
    monday = F.date_trunc("week", now + F.expr(f"INTERVAL {shift_hours} HOURS")).cast("date")
    return F.date_sub(monday, 7)


def is_classic(ts: Column, evergreen: Column, now: Column, days: int = 30) -> Column:
    return F.coalesce(evergreen & (hours_between(now, ts) > 24 * days), F.lit(False))


def entry_updated(published: Column, first_seen: Column, items: Column) -> Column:
    """The latest of an event's own dates and its items'."""
    return F.greatest(published, first_seen, F.array_max(items))


def week_id(ts: Column, shift_hours: int = 8) -> Column:
    """ISO week of the local day."""
    local = ts + F.expr(f"INTERVAL {shift_hours} HOURS")
    return F.concat(F.extract(F.lit("YEAROFWEEK"), local).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(local).cast("string"), 2, "0"))


def freshness(ts: Column, now: Column) -> Column:
    return F.coalesce(F.pow(F.lit(2.0), -F.greatest(F.lit(0.0), hours_between(now, ts)) / HALF_LIFE_H), F.lit(0.5))


def community_score(signal: Column) -> Column:
    s = F.greatest(F.coalesce(signal.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.least(F.lit(100.0), F.bround(F.log1p(s) / F.log(F.lit(1001.0)) * 100))


def heat(importance: Column, ts: Column, signal: Column, extra_sources: Column, now: Column) -> Column:
    raw = 0.45 * importance + 35 * freshness(ts, now) + F.least(F.lit(10.0), 0.1 * community_score(signal)) + F.least(F.lit(10.0), (4 * extra_sources).cast("double"))
    # rounded to six places first: sums that differ in their last bit then round alike
    return F.least(F.lit(100.0), F.bround(F.round(raw, 6)))


def personal_score(matches: Column, importance: Column, heat_: Column, age_days: Column, sources: Column, favourite: Column) -> Column:
    """100 for a match and 18 for each further one; importance, heat and freshness; a few points for sources, 10 for a favourite."""
    base = F.when(matches > 0, 100 + 18 * (matches - 1)).otherwise(0)
    extra = F.least(F.lit(12), 4 * F.greatest(sources - 1, F.lit(0)))
    return base + 0.35 * importance + 0.2 * heat_ + F.greatest(F.lit(0.0), 18 - 1.7 * age_days) + extra + F.when(favourite, 10).otherwise(0)


#: Score of a source's tier.
TIERS = {"structured_high": 100, "official_high": 80, "community_targeted": 45, "media_targeted": 40, "low_precision": 25, "media_low": 20}


def tier_score(tier: Column, tiers: dict[str, int] = TIERS, default: int = 30) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in tiers.items() for x in kv))[tier], F.lit(default))


def primary_source_score(tier: Column, weight: Column, vendor_default: Column, signal: Column, summary_chars: Column, tiers: dict[str, int] = TIERS) -> Column:
    """The tier, 5 for each weight, 15 for a vendor's own source, up to 20 for signal and up to 10 for the summary's length."""
    zero = F.lit(0)
    return (
        tier_score(tier, tiers) + 5 * F.coalesce(weight, zero) + F.when(vendor_default, 15).otherwise(0)
        + F.least(F.lit(20), F.floor(F.coalesce(signal, zero) / 10)) + F.least(F.lit(10), F.floor(F.coalesce(summary_chars, zero) / 100))
    )


def safe_ratio(n: Column, d: Column) -> Column:
    return F.coalesce(F.bround(n / F.nullif(d, F.lit(0)), 4), F.lit(0.0))


def ordered_union(a: Column, b: Column, n: int) -> Column:
    """First-seen distinct values of both, n at most."""
    return F.slice(F.array_distinct(F.concat(a, b)), 1, n)


def restrict(values: Column, vocabulary: Column, n: int) -> Column:
    """Trimmed, distinct values of a closed vocabulary, n at most."""
    return F.slice(F.array_distinct(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: F.array_contains(vocabulary, x))), 1, n)


def merge_tags(a: Column, b: Column, vocabulary: Column, n: int = 2) -> Column:
    empty = F.array().cast("array<string>")
    return F.when(a.isNull() & b.isNull(), None).otherwise(restrict(F.concat(F.coalesce(a, empty), F.coalesce(b, empty)), vocabulary, n))


def pack_chunks(parts: Column, n: int) -> Column:
    """Paragraphs packed greedily, in order, into chunks of up to n characters; a longer one stands alone."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc: Column, p: Column) -> Column:
        fits = (acc["open"] == "") | (F.length(acc["open"]) + F.length(p) + 2 <= n)
        joined = F.when(acc["open"] == "", p).otherwise(F.concat_ws("\n\n", acc["open"], p))
        return F.struct(F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))).alias("done"), F.when(fits, joined).otherwise(p).alias("open"))

    return F.aggregate(parts, start, add, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def paragraph_chunks(text: Column, n: int) -> Column:
    """Paragraphs between blank lines, cut into pieces of n characters where they are longer, and packed in order."""
    paragraphs = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n[ \t\n\f\r]*\n"), lambda p: F.regexp_replace(p, r"^[ \t\n\f\r]+|[ \t\n\f\r]+$", "")), lambda p: p != "")
    pieces = F.transform(paragraphs, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.length(p) - 1) / n).cast("int")), lambda i: F.substring(p, i * n + 1, F.lit(n))))
    return pack_chunks(F.flatten(pieces), n)


def sentence_chunks(text: Column, n: int, most: int | None = None) -> Column:
    """Sentences packed in order, with a space between, into chunks whose sentences hold n characters with what came before;
    a longer one stands alone; `most` chunks at most, the rest is left out."""
    sentences = F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=[。！？.!?])[ \t\n\f\r]+"), lambda s: s != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc: Column, s: Column) -> Column:
        full = (acc["open"] != "") & (F.length(acc["open"]) + F.length(s) > n)
        joined = F.when(acc["open"] == "", s).otherwise(F.concat_ws(" ", acc["open"], s))
        return F.struct(F.when(full, F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]).alias("done"), F.when(full, s).otherwise(joined).alias("open"))

    out = F.aggregate(sentences, start, add, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])))
    return out if most is None else F.slice(out, 1, most)


def batch_numbers(sizes: Column, n: int) -> Column:
    """For sizes in order, the number of the batch that each falls in: a batch ends before what would take it beyond n."""
    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).cast("long").alias("used"), F.lit(0).alias("batch"))

    def add(acc: Column, size: Column) -> Column:
        new = (F.size(acc["out"]) > 0) & (acc["used"] + size > n) & (acc["used"] > 0)
        batch = F.when(new, acc["batch"] + 1).otherwise(acc["batch"])
        return F.struct(F.array_append(acc["out"], batch).alias("out"), F.when(new, size).otherwise(acc["used"] + size).cast("long").alias("used"), batch.alias("batch"))

    return F.aggregate(F.transform(sizes, lambda s: s.cast("long")), start, add, lambda acc: acc["out"])
