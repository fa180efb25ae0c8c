"""Scalar functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: names of countries that stand for another
COUNTRY_ALIASES = {
    "uae": "united arab emirates", "abu dhabi": "united arab emirates", "dubai": "united arab emirates",
    "ksa": "saudi arabia", "kingdom of saudi arabia": "saudi arabia", "riyadh": "saudi arabia",
    "islamic emirate of afghanistan": "afghanistan", "kabul": "afghanistan",
    "usa": "united states", "us": "united states", "u.s.": "united states", "uk": "united kingdom", "britain": "united kingdom",
}
TIMESTAMP_FORMATS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyyMMdd'T'HHmmssX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyyMMddHHmmss", "yyyy-MM-dd")
EARTH_KM = 6371.0


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def alias_of(c: Column, aliases: dict[str, str]) -> Column:
    return F.coalesce(reduce(lambda e, kv: e.when(c == kv[0], kv[1]), aliases.items(), F.when(F.lit(False), F.lit(None).cast("string"))), c)


def country(c: Column | str) -> Column:
    """lower case, cut at the first ``( - :``, without a leading 'the', alias resolved."""
    plain = F.regexp_replace(F.lower(F.trim(F.regexp_extract(col(c), r"^([^(\-:]*)", 1))), r"^the ", "")
    return alias_of(F.when(F.length(plain) > 0, plain), COUNTRY_ALIASES)


def canonical_url(c: Column | str) -> Column:
    """lower-case scheme and host, no query, fragment or trailing slash."""
    u = F.trim(col(c))
    head = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1))
    path = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.regexp_replace(F.concat(head, path), "/+$", "")


def domain(c: Column | str) -> Column:
    """host without ``www.``, lower case."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.trim(col(c)), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]*)", 1)), r"^www\.", "")


def stable_hash(*parts: Column | str) -> Column:
    """SHA-256 of the trimmed parts, null as empty, joined by a bar."""
    return F.sha2(F.concat_ws("|", *[F.trim(F.coalesce(col(p).cast("string"), F.lit(""))) for p in parts]), 256)


def timestamp(c: Column | str) -> Column:
    """ISO, compact and offset forms; null where none fits (session zone UTC)."""
    t = F.trim(col(c))
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in TIMESTAMP_FORMATS])


def fragment(c: Column | str) -> Column:
    """markup to spaces, common references decoded, white space folded."""
    t = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"<[^>]*>", " ")
    for name, value in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(value))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def without_leading_title(description: Column | str, title: Column | str) -> Column:
    """the description without the title that it starts with."""
    d, t = fragment(description), fragment(title)
    rest = F.ltrim(F.substr(d, F.length(t) + 1), F.lit(" -:|"))
    return F.when((F.length(t) > 0) & F.startswith(F.lower(d), F.lower(t)), rest).otherwise(d)


def trimmed(c: Column | str, limit: int) -> Column:
    """a text no longer than the limit as it is, else cut after its last sentence mark (the first
    kind that has one in the last 40 characters), else at its last space, with an ellipsis."""
    t = col(c)
    head, short = F.substring(t, 1, limit + 1), F.substring(t, 1, limit - 1)
    last = lambda mark, part: F.length(part) - F.locate(mark[::-1], F.reverse(part)) - (len(mark) - 1)  # noqa: E731  place before the mark
    ends = [F.when((F.locate(m[::-1], F.reverse(head)) > 0) & (last(m, head) >= max(120, limit - 40)), F.trim(F.left(t, last(m, head) + 1))) for m in (". ", "! ", "? ", "; ")]
    space = F.when(F.locate(" ", F.reverse(short)) > 0, last(" ", short)).otherwise(0)
    word = F.left(t, F.when(space > 0, space).otherwise(limit - 1))
    return F.when(F.length(t) <= limit, t).otherwise(F.coalesce(*ends, F.concat(F.regexp_replace(word, "[ ,;:]+$", ""), F.lit("\u2026"))))


def is_english(c: Column | str) -> Column:
    """blank counts as English."""
    return F.lower(F.trim(F.coalesce(col(c), F.lit("")))).isin("", "en", "eng", "english")


def words(c: Column | str, least: int = 4) -> Column:
    """distinct lower-case words of at least ``least`` letters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit(rf"([a-z]{{{least},}})"), F.lit(1)))


def keywords(c: Column | str, stopwords: list[str], least: int = 4) -> Column:
    return F.array_except(words(c, least), F.array(*[F.lit(w) for w in stopwords]))


def temporal_weight(hours: Column) -> Column:
    """decay by steps; null counts 0.85."""
    return F.when(hours.isNull(), 0.85).when(hours <= 12, 1.0).when(hours <= 36, 0.92).when(hours <= 72, 0.82).when(hours <= 120, 0.7).otherwise(0.52)


def jaccard(a: Column | str, b: Column | str) -> Column:
    """0 if either is empty."""
    a, b = col(a), col(b)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def numbers(c: Column | str) -> Column:
    """number tokens without thousands separators, in order."""
    found = F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"\b(\d[\d,]*(?:\.\d+)?)\b"), F.lit(1))
    return F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")))


def snippet(c: Column | str, size: int = 18) -> Column:
    """the first ``size`` words."""
    return F.array_join(F.slice(F.split(F.trim(F.coalesce(col(c), F.lit(""))), r"\s+"), 1, size), " ")


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """great-circle distance in kilometres."""
    a, b, c, d = (F.radians(col(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def world_region(lat: Column | str, lon: Column | str) -> Column:
    """coarse region of a point."""
    la, lo = col(lat), col(lon)
    return (
        F.when(la.isNull() | lo.isNull(), "global").when((lo < -30) & (la > 12), "north_america").when(lo < -30, "south_america")
        .when((la > 35) & (lo < 60), "europe").when((la > 12) & (lo >= 25) & (lo < 63), "middle_east").when((la <= 35) & (lo < 52), "africa")
        .when((la < -10) & (lo > 110), "oceania").otherwise("asia")
    )


def week_floor(c: Column | str) -> Column:
    """the Monday of the week."""
    return F.date_trunc("week", col(c)).cast("date")


def week_label(c: Column | str) -> Column:
    """ISO year and week, such as 2024-W05."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), col(c)).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(col(c)).cast("string"), 2, "0"))


def cosine(a: Column | str, b: Column | str) -> Column:
    """0 for a zero vector or unequal lengths."""
    a, b = col(a), col(b)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))


def place_key(c: Column | str) -> Column:
    """lower-case letters and digits with single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"[^a-z0-9]+", " "))


def distinct_parts(c: Column | str) -> Column:
    """comma parts of a place, trimmed, each once, in order."""
    parts = F.transform(F.split(F.coalesce(col(c), F.lit("")), ","), lambda p: F.trim(p))
    return F.array_join(F.array_distinct(F.filter(parts, lambda p: F.length(p) > 0)), ", ")


def clean_urls(c: Column | str, limit: int | None = None) -> Column:
    """U8: trimmed http(s) URLs, distinct, in order, at most ``limit``."""
    found = F.array_distinct(F.filter(F.transform(col(c), lambda u: F.trim(u)), lambda u: u.rlike("^https?://")))
    return found if limit is None else F.slice(found, 1, limit)
