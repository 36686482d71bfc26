"""Text, hash and URL expressions. All take and give columns; null in gives null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = "[㐀-鿿]"


def clean_text(c: Column, n: int | None = None) -> Column:
    """White space collapsed and trimmed; cut to n characters. Null gives empty."""
    out = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"[ \t\n\r\f\x0B]+", " "))
    return out if n is None else F.left(out, F.lit(n))


#: Named entities and their characters; the ampersand comes last, so that nothing is decoded twice.
ENTITIES = {"nbsp": " ", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "mdash": "—", "ndash": "–", "hellip": "…", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "middot": "·", "copy": "©", "reg": "®", "trade": "™", "amp": "&"}


def unescape(c: Column) -> Column:
    """Numeric entities below 65,536, then the named ones, become characters."""
    out = c
    for pattern, base in ((r"&#(\d{1,5});", 10), (r"&#[xX]([0-9A-Fa-f]{1,4});", 16)):
        pieces, codes = F.split(out, pattern, -1), F.regexp_extract_all(out, F.lit(pattern), F.lit(1))
        # the code point's two bytes, read as UTF-16
        chars = F.transform(codes, lambda x: F.decode(F.unhex(F.lpad(F.conv(x, base, 16), 4, "0")), "UTF-16BE"))
        mixed = F.zip_with(pieces, chars, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
        out = F.when(c.contains("&#"), F.array_join(mixed, "")).otherwise(out)
    for name, char in ENTITIES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return out


def strip_html(c: Column) -> Column:
    """Tags become spaces, entities characters."""
    return clean_text(unescape(F.regexp_replace(c, r"(?s)<[^>]*>", " ")))


def repair_markup(c: Column) -> Column:
    """Entities that XML doesn't declare become characters, bare ampersands are escaped, so that the text parses as XML."""
    out = c
    for name, char in ENTITIES.items():
        if name not in ("lt", "gt", "quot", "apos", "amp"):
            out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return F.regexp_replace(out, r"&(?!(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9A-Fa-f]+);)", "&amp;")


def url_host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def url_path(c: Column) -> Column:
    return F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#;]*)", 1)


def without_dots(path: Column) -> Column:
    """A path that begins with a slash, with `.` and `..` steps taken; none leads above the root."""
    steps = F.split(path, "/")

    def step(taken: Column, s: Column) -> Column:
        return F.when(s == ".", taken).when(s == "..", F.slice(taken, F.lit(1), F.greatest(F.size(taken) - 1, F.lit(1)))).otherwise(F.array_append(taken, s))

    taken = F.aggregate(steps, F.array().cast("array<string>"), step)
    return F.array_join(F.when(F.element_at(steps, -1).isin(".", ".."), F.array_append(taken, F.lit(""))).otherwise(taken), "/")


def resolve_reference(base: Column, ref: Column) -> Column:
    """The address that a reference on a page means, without its fragment: absolute, //host, /path, relative, ?query, #fragment
    or empty (the page itself). Null where the page's own address is null or has no host."""
    r = F.regexp_replace(F.trim(F.coalesce(ref, F.lit(""))), r"(?s)#.*$", "")
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    path = F.when(path == "", "/").otherwise(path)
    own_path, own_query = F.regexp_extract(r, r"^([^?]*)", 1), F.regexp_extract(r, r"(?s)(\?.*)$", 1)
    meant = (
        F.when(r == "", F.regexp_replace(base, r"(?s)#.*$", "")).when(r.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), r)
        .when(r.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), r)).when(r.startswith("?"), F.concat(origin, path, r))
        .when(r.startswith("/"), F.concat(origin, without_dots(own_path), own_query))
        .otherwise(F.concat(origin, without_dots(F.concat(F.regexp_extract(path, r"^(.*/)", 1), own_path)), own_query))
    )
    return F.when(origin != "", meant)


def page_key(url: Column) -> Column:
    """Host and path of a page, whatever its scheme, query or fragment; an index page is its folder."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    return F.concat(url_host(url), F.regexp_replace(F.regexp_replace(path, r"/index\.html$", "/"), r"/+$", ""))


def _query(c: Column) -> Column:
    return F.split(F.regexp_extract(c, r"^[^?#]*\?([^#]*)", 1), "&")


def _scheme(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def norm_url(c: Column) -> Column:
    """Lower-case scheme and host, no fragment, no trailing slash, no tracking or blank parameters."""
    kept = F.array_join(F.filter(_query(c), lambda x: x.rlike("=.") & ~F.lower(x).rlike("^(utm_|ref|fbclid|gclid)")), "&")
    return F.concat(_scheme(c), F.lit("://"), url_host(c), F.regexp_replace(url_path(c), "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


#: Parameters that only track.
TRACKING = ("fbclid", "gclid", "igshid", "mc_cid", "mc_eid", "ref", "source")


def norm_url_strict(c: Column) -> Column:
    """As norm_url, but only utm_* and the exact tracking keys go, blank values stay and an empty path is a slash."""
    kept = F.array_join(F.filter(_query(c), lambda x: (x != "") & ~F.lower(x).rlike(f"^(utm_[^=]*|{'|'.join(TRACKING)})(=|$)")), "&")
    path = F.regexp_replace(url_path(c), "/+$", "")
    return F.concat(_scheme(c), F.lit("://"), url_host(c), F.when(path == "", "/").otherwise(path), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def safe_url(c: Column) -> Column:
    """The URL if it is http(s) with a host and without credentials or backslashes, else empty."""
    ok = c.rlike(r"^(?i:https?)://[^/?#@\\]+(?:[/?#]|$)") & ~c.contains("\\")
    return F.when(F.coalesce(ok, F.lit(False)), c).otherwise("")


def site_key(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def same_site(a: Column, b: Column, allowed: list[str] | None = None) -> Column:
    known = F.coalesce(b.isin(*(allowed or [""])), F.lit(False))
    return (site_key(a) == site_key(b)) | a.endswith(F.concat(F.lit("."), b)) | known


def stable_id(c: Column) -> Column:
    return F.substring(F.md5(c), 1, 12)


def content_hash(title: Column, summary: Column) -> Column:
    return F.sha2(F.concat_ws("\n", clean_text(title), clean_text(summary)), 256)


def pair_key(a: Column, b: Column) -> Column:
    """The same for (a, b) and (b, a)."""
    x, y = F.lower(clean_text(a)), F.lower(clean_text(b))
    return F.sha2(F.concat_ws("\n", F.least(x, y), F.greatest(x, y)), 256)


def title_bigrams(c: Column) -> Column:
    """Distinct two-character pieces of the lower-case letters and digits; one character stands for itself."""
    t = F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", "")
    # the text is cleaned and cut into characters once, not for each piece
    pairs = F.transform(F.array(F.split(t, "")), lambda c: F.when(F.size(c) < 2, c).otherwise(F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda x, y: F.concat(x, y))))
    return F.filter(F.array_distinct(F.get(pairs, F.lit(0))), lambda x: x != "")


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def detect_script(c: Column) -> Column:
    """zh, other or unknown by the scripts of the letters."""
    han, kana, hangul, latin = (F.regexp_count(c, F.lit(r)) for r in (HAN, "[぀-ヿ]", "[가-힣]", "[A-Za-z]"))
    return F.when((kana > 0) | (hangul > 0), "other").when(han == 0, F.when(latin > 0, "other").otherwise("unknown")).when(han * 2 >= latin, "zh").otherwise("other")


def contains_han(c: Column) -> Column:
    return c.rlike(HAN)


def slug_title(url: Column) -> Column:
    return F.initcap(F.regexp_replace(F.element_at(F.split(F.regexp_replace(url_path(url), "/+$", ""), "/"), -1), "[-_]+", " "))


def clean_page_title(c: Column) -> Column:
    return F.regexp_replace(clean_text(c), r" [|–—-] [^|–—-]*$", "")


def source_family(c: Column) -> Column:
    """Names of one publisher's outlets fold to one key: without brackets, words of outlets and their endings."""
    out = F.regexp_replace(F.lower(c), r"[(（][^)）]*[)）]", " ")
    out = F.regexp_replace(out, r"\b(?:official|engineering|blog|blogs|news|medium|rss)\b", " ")
    out = F.regexp_replace(out, "(?:官方网站|官方博客|官网|官方|博客|动态|中文|英文)$", "")
    return F.regexp_replace(out, r"[^0-9a-z\u4e00-\u9fff]+", "")


#: Words in a source's name that tell what it is.
VENDOR_WORDS = ("官方", "博客", "动态", "engineering", "blog")
MEDIA_WORDS = ("techcrunch", "infoq", "极客公园", "产品经理")


def source_type(c: Column) -> Column:
    vendor, media = (F.lower(c).rlike("|".join(words)) for words in (VENDOR_WORDS, MEDIA_WORDS))
    return F.when(vendor, "vendor_claim").when(media, "media_report").otherwise("other")


def clip_sentence(c: Column, n: int) -> Column:
    """Cut after the last sentence mark in the second half of n characters, else after a clause mark, else empty."""
    head = F.left(c, F.lit(n))
    full, part = F.regexp_extract(head, r"(?s)^(.*[.!?。！？])", 1), F.regexp_extract(head, r"(?s)^(.*[,;:，；：])", 1)
    return F.when(F.length(c) <= n, c).when(F.length(full) * 2 >= n, full).when(F.length(part) * 2 >= n, part).otherwise("")


def clean_narration(c: Column) -> Column:
    out = F.regexp_replace(c, r"(?s)```.*?```", " ")
    out = F.regexp_replace(out, r"\[([^\]]*)\]\([^)]*\)", "$1")
    return clean_text(F.regexp_replace(F.regexp_replace(out, r"https?://[^ \t\n]+", " "), r"<[^>]*>", " "))


def token_estimate(chars: Column, most: int) -> Column:
    return F.greatest(F.lit(512), F.floor(chars / 3) + most)


def query_bucket(length: Column) -> Column:
    return F.when(length <= 0, "0").when(length <= 3, "1-3").when(length <= 8, "4-8").otherwise("9+")


def viewport_bucket(width: Column) -> Column:
    return F.when(width < 640, "s").when(width < 1024, "m").otherwise("l")


def page_from_path(path: Column, pages: dict[str, str], default: str = "other") -> Column:
    """The page whose pattern the path matches first."""
    out = F.lit(default)
    for name, pattern in reversed(pages.items()):
        out = F.when(path.rlike(pattern), name).otherwise(out)
    return out


def referrer_bucket(host: Column, own: Column, classes: dict[str, str]) -> Column:
    """direct without a host, internal from the own site, else the class whose pattern the host matches, else other."""
    out = F.lit("other")
    for name, pattern in reversed(classes.items()):
        out = F.when(F.lower(host).rlike(pattern), name).otherwise(out)
    return F.when(F.coalesce(host, F.lit("")) == "", "direct").when(F.lower(host) == F.lower(own), "internal").otherwise(out)


def clean_reason(c: Column, labels: tuple[str, ...]) -> Column:
    """Without its own label, however often that stands before it."""
    return F.regexp_replace(clean_text(c), f"^(?:(?:{'|'.join(labels)}) *[:：] *)+", "")


def doc_fingerprint(*columns: str) -> Column:
    """sha256 of the columns as JSON, by name; nulls and missing ones are alike."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)


def group_fingerprint(key: str, value: Column) -> Column:
    """Aggregate: sha256 of the rows' values in order of their key."""
    rows = F.transform(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), value.alias("v")))), lambda x: x["v"])
    return F.sha2(F.array_join(rows, "\n"), 256)


def body_hash(order: str, text: Column) -> Column:
    """Aggregate: the first 24 digits of the sha256 of a body's blocks in order."""
    return F.left(group_fingerprint(order, text), F.lit(24))
