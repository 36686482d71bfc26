"""Secret scans: credentials found by pattern, and weak parts reported only next to a complementary part.

Column expressions and joins only. A scan gives for each text its base spans (kinds assign, access, hex: leftmost,
non-overlapping per kind) and weak parts (ident: a named account; blob: a mixed run of 32 base-64 characters or more;
endpoint: a URL with a host). A weak part is reported if, within SCOPE code points in the same text, a part of another
role lies: an ident needs a secret, a blob needs an identifier or endpoint, an endpoint needs an identifier or secret.

Null text counts as empty. Texts without parts have zero counts and the hash of the empty string. Repeated rows and
repeated doc_ids each keep their own row; equal texts are scanned for links once. An empty table gives an empty result;
other columns of the input, whatever their names, pass through `secret_digest` unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from eventlake.llm.names import fresh
from eventlake.plans.stage import keep

#: Code points between two parts that still count as one scope.
SCOPE = 256

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
IDENT = r"""(?i:\b(?:user_?name|user|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9_.@-]{3,})"""
BLOB = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/]{32,}+(?![A-Za-z0-9+/_-])"
ENDPOINT = r"(?:https?|postgres|mysql|redis|mongodb|amqp)://[A-Za-z0-9.-]+(?::[0-9]+)?"
#: A text without a hit here has no base span and no blob, so only an ident and an endpoint can complete each other.
ANY = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|" + BLOB

#: (kind, pattern, group whose length counts, shortest that counts), in the order in which kinds are listed.
KINDS = (
    ("assign", ASSIGN, 2, 6),
    ("access", ACCESS, 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("ident", IDENT, 1, 3),
    ("blob", BLOB, 0, 32),
    ("endpoint", ENDPOINT, 0, 8),
)
BASE = 3
#: Which kinds complete a weak kind.
PARTNERS = {"ident": ("assign", "hex", "blob"), "blob": ("access", "ident", "endpoint"), "endpoint": ("assign", "access", "ident", "blob")}


def _parts(text: Column, order: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Array of (kind, place, code points before it since the last match, length, whether it counts)."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    value = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    both = F.arrays_zip(found.alias("m"), F.slice(gaps, 1, F.size(found)).alias("g"), value.alias("v"))

    def part(x: Column, i: Column) -> Column:
        ok = F.length(x["v"]) >= least
        if kind == "blob":
            ok = ok & x["v"].rlike("[0-9]") & x["v"].rlike("[a-z]") & x["v"].rlike("[A-Z]")
        return F.struct(F.lit(order).alias("ord"), i.alias("i"), F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("len"), ok.alias("ok"))

    return F.transform(both, part)


def _hit(text: Column) -> Column:
    """Whether a text can have a span."""
    return text.rlike(ANY) | (text.rlike(ENDPOINT) & text.rlike(IDENT))


def scan(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(carried columns..., secret_key, secret_parts): both null where nothing was found; the key stands for the text."""
    body = F.coalesce(F.col(text), F.lit(""))
    parts = F.concat(*(_parts(body, n, *k) for n, k in enumerate(KINDS)))
    hit = _hit(body)
    return docs.select(*carry, F.when(hit, F.md5(body)).alias("secret_key"), F.when(hit, parts).alias("secret_parts"))


def spans(scanned: DataFrame) -> DataFrame:
    """(secret_key, ord, kind, start, end): base spans and linked weak spans of each distinct scanned text."""
    one = scanned.where("secret_key is not null").select("secret_key", "secret_parts").dropDuplicates(["secret_key"])
    rows = one.select("secret_key", F.inline("secret_parts"))
    # where a match ends: everything between and in the matches of this kind so far
    before = W.partitionBy("secret_key", "ord").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    name = F.element_at(F.array(*(F.lit(k[0]) for k in KINDS)), F.col("ord") + 1)
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(before)).where("ok").select("secret_key", "ord", name.alias("kind"), (F.col("end") - F.col("len")).alias("start"), "end")
    placed = keep(placed, "secret-parts")
    base, weak = placed.where(F.col("ord") < BASE), placed.where(F.col("ord") >= BASE)
    # interval join: equal text and scope bucket first, then the distance between the two spans. A part that follows is
    # found by where it starts, one that precedes by where it ends, so that the length of neither matters
    def at(c: str, side: int, shift: int = 0) -> Column:
        return F.struct(F.lit(side).alias("side"), (F.floor(F.col(c) / SCOPE) + shift).alias("bucket"))

    left = weak.withColumn("at", F.explode(F.array(at("end", 1), at("end", 1, 1), at("start", 0, -1), at("start", 0))))
    right = placed.select(F.col("secret_key").alias("k2"), F.col("kind").alias("kind2"), F.col("start").alias("s2"), F.col("end").alias("e2"), F.explode(F.array(at("start", 1), at("end", 0))).alias("at2"))
    apart = F.greatest(F.col("s2") - F.col("end"), F.col("start") - F.col("e2"))
    fits = F.lit(False)
    for kind, others in PARTNERS.items():
        fits = fits | ((F.col("kind") == kind) & F.col("kind2").isin(*others))
    linked = left.join(right, (F.col("secret_key") == F.col("k2")) & (F.col("at") == F.col("at2")) & fits & (apart >= 0) & (apart <= SCOPE), "left_semi")
    linked = linked.drop("at").distinct()
    # a weak span inside or across a base span says nothing new
    covers = base.select(F.col("secret_key").alias("k2"), F.col("start").alias("s2"), F.col("end").alias("e2"), F.explode(F.sequence(F.floor(F.col("start") / SCOPE), F.floor((F.col("end") - 1) / SCOPE))).alias("b2"))
    on = (F.col("secret_key") == F.col("k2")) & (F.col("wb") == F.col("b2")) & (F.col("s2") < F.col("end")) & (F.col("start") < F.col("e2"))
    spread = linked.withColumn("wb", F.explode(F.sequence(F.floor(F.col("start") / SCOPE), F.floor((F.col("end") - 1) / SCOPE))))
    covered = spread.join(covers, on, "left_semi").select("secret_key", "ord", "kind", "start", "end").distinct()
    return base.union(linked.select(*base.columns).join(covered, base.columns, "left_anti"))


def _listed(pick: Column) -> Column:
    """kind:start:end in order of start, then kind as listed."""
    rows = F.sort_array(F.collect_list(F.when(pick, F.struct("start", "ord", "end", "kind"))))
    return F.array_join(F.transform(rows, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def summaries(found: DataFrame) -> DataFrame:
    """One row per scanned text: counts by base kind, the hash of its base spans, and all spans as text."""
    counts = [F.sum((F.col("kind") == k).cast("long")).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.groupBy("secret_key").agg(*counts, F.sha2(_listed(F.col("ord") < BASE), 256).alias("base_sha256"), _listed(F.lit(True)).alias("spans"))


def secret_digest(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns of every row with n_assign, n_access, n_hex, base_sha256 and spans."""
    scanned = keep(scan(docs, text, carry), "secret-scan")
    each = summaries(spans(scanned))
    zero = [F.lit(0).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    none = [*zero, F.sha2(F.lit(""), 256).alias("base_sha256"), F.lit("").alias("spans")]
    clean = scanned.where("secret_key is null").select(*carry, *none)
    dirty = scanned.where("secret_key is not null").select(*carry, "secret_key").join(each, "secret_key", "left")
    filled = [F.coalesce(c, v).alias(c) for c, v in zip(("n_assign", "n_access", "n_hex", "base_sha256", "spans"), none, strict=True)]
    return clean.union(dirty.select(*carry, *filled))


#: What a text shows instead of a secret.
MASK = "[secret]"


def mask_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of every row, with each reported span of the text replaced by MASK; overlapping spans become one.

    Null texts stay null, columns of any other name stay as they are. Rows without a hit are passed on as they are; only
    rows with one are joined to their spans.
    """
    scanned = keep(scan(docs.where(_hit(F.col(text))).select(F.col(text).alias("text")), "text", ()), "secret-scan")
    order = W.partitionBy("secret_key").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    merged = spans(scanned).withColumn("past", F.coalesce(F.max("end").over(order), F.lit(0))).where(F.col("end") > F.col("past"))
    key, found = fresh(docs, "secret_key"), fresh(docs, "secret_spans")
    each = merged.groupBy(F.col("secret_key").alias(key)).agg(F.sort_array(F.collect_list(F.struct(F.greatest("start", "past").alias("start"), "end"))).alias(found))
    hit = F.coalesce(_hit(F.col(text)), F.lit(False))
    dirty = docs.where(hit).withColumn(key, F.md5(text)).join(each, key, "left")
    at, body = F.col(found), F.col(text)
    # what stands before each span, each followed by the mask, then the rest
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(at, lambda x: x["end"]))
    before = F.zip_with(at, F.slice(ends, 1, F.size(at)), lambda x, e: F.concat(F.substring(body, (e + 1).cast("int"), (x["start"] - e).cast("int")), F.lit(MASK)))
    masked = F.concat(F.array_join(before, ""), F.substring(body, (F.element_at(ends, -1) + 1).cast("int"), F.length(body)))
    return docs.where(~hit).union(dirty.withColumn(text, F.when(at.isNull(), body).otherwise(masked)).select(*docs.columns))
