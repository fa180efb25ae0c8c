"""Text rules: framing, claims, numbers, dates, quality, labels."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions import scalars as S

# fixed values: word lists of the framing and claim rules
FRAMES = {
    "terrorism": ["terrorist", "terrorists", "terror group", "terror groups", "extremist", "extremists", "jihadist", "jihadists", "designated terrorist", "foreign terrorist organization"],
    "militancy": ["militant", "militants", "armed group", "armed groups", "fighters", "gunmen", "operatives", "paramilitary", "militia", "militias"],
    "rebellion": ["rebel", "rebels", "insurgent", "insurgents", "uprising", "opposition fighter", "opposition fighters", "anti-government", "anti government"],
    "governance": ["government", "administration", "authorities", "state media", "officials", "regime", "junta", "state security", "security forces", "interior ministry"],
    "resistance": ["resistance", "freedom fighter", "freedom fighters", "liberation", "movement"],
    "criminality": ["criminal", "criminals", "gang", "gangs", "cartel", "cartels", "smuggler", "smugglers"],
    "separatism": ["separatist", "separatists", "breakaway region", "self-proclaimed republic", "self declared republic"],
    "proxy": ["proxy", "proxy force", "proxy forces", "proxy militia", "proxy militias", "proxy war", "iran-backed", "iran backed", "russia-backed", "russia backed", "turkey-backed", "turkey backed", "us-backed", "u.s.-backed", "western-backed", "western backed"],
    "occupation": ["occupation", "occupying force", "occupying forces", "occupier", "occupiers", "annexed", "annexation"],
    "legitimacy": ["recognized government", "internationally recognized", "de facto authority", "de facto authorities", "self-styled", "self styled", "self-proclaimed", "self proclaimed", "interim government"],
    "diplomacy": ["ceasefire", "truce", "talks", "negotiations", "peace talks", "mediated", "backchannel", "envoy"],
    "humanitarian": ["aid convoy", "humanitarian", "displaced", "refugees", "civilians", "relief effort", "famine", "starvation"],
}
CLAIM_STOPWORDS = ["the", "and", "that", "with", "from", "this", "into", "after", "over", "under", "amid", "against", "about", "their", "there", "which", "would", "could", "should", "while", "where", "when", "what", "than", "been", "have", "has", "were", "will", "says", "said", "say", "report", "reports", "reported", "according"]
CLAIM_VERBS = ["says", "said", "warns", "warned", "claims", "claimed", "announces", "announced", "vows", "vowed", "confirms", "confirmed", "denies", "denied", "approves", "approved", "rejects", "rejected", "threatens", "threatened", "expects", "expected", "targets", "targeted", "strikes", "struck", "imposes", "imposed", "halts", "halted", "resumes", "resumed", "cuts", "cut", "raises", "raised", "launches", "launched"]
CLAIM_TYPES = {
    "timeline": ["today", "tomorrow", "weeks", "days", "deadline", "by monday", "by friday", "soon", "delayed"],
    "scale": ["dozens", "hundreds", "thousands", "surge", "record", "largest", "smallest", "major", "minor"],
    "causality": ["because", "after", "following", "in response", "prompting", "leading to", "caused by"],
    "intent": ["aims", "seeks", "plans", "intends", "goal", "objective", "strategy", "wants to"],
    "sanctions": ["sanction", "blacklist", "designation", "asset freeze", "penalty", "ofac"],
    "markets": ["stocks", "shares", "oil", "prices", "market", "yield", "inflation", "rates", "gdp"],
    "military": ["strike", "missile", "troops", "drone", "airstrike", "attack", "ceasefire", "offensive"],
    "diplomacy": ["talks", "negotiation", "envoy", "mediation", "summit", "meeting", "agreement"],
}
LOW_SIGNAL = [r"\bhow to\b", r"\bwhat is\b", r"\bwhat are\b", r"\bwhen asked\b", r"\btalking about\b", r"\btop \d+\b", r"\bquiz\b", r"\bbest \w+ to\b", r"\bopinion:\b", r"\breview:\b"]
DOMINANT_DOMAINS = ["www.aljazeera.com", "aljazeera.com", "bbc.co.uk", "www.bbc.co.uk", "apnews.com", "reuters.com"]
NUMBER_WORDS = {"dozen": 12, "dozens": 24, "hundred": 100, "hundreds": 200, "thousand": 1000, "thousands": 2000}
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]


def any_of(text: Column, terms: list[str]) -> Column:
    """Whether a lower-case text contains one of the terms, inside words too."""
    return text.rlike("|".join(re.escape(t) for t in terms))


def matched_terms(c: Column | str, lexicon: dict[str, list[str]] = FRAMES) -> Column:
    """the terms of each group that a text contains, as a map without empty groups."""
    t = F.lower(F.coalesce(S.col(c), F.lit("")))
    found = [F.struct(F.lit(k).alias("key"), F.array_compact(F.array(*[F.when(F.contains(t, F.lit(w)), F.lit(w)) for w in sorted(v)])).alias("value")) for k, v in lexicon.items()]
    return F.map_from_entries(F.filter(F.array(*found), lambda e: F.size(e["value"]) > 0))


def frame_counts(matched: Column) -> Column:
    return F.transform_values(matched, lambda k, v: F.size(v))


def dominant(counts: Column) -> Column:
    """the group with most terms, the first by name of equal ones."""
    order = F.array_sort(F.transform(F.map_entries(counts), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("k"))))
    return F.try_element_at(order, F.lit(1))["k"]


def content_tokens(c: Column | str) -> Column:
    """distinct words of three letters or more that carry content."""
    found = F.regexp_extract_all(F.lower(F.coalesce(S.col(c), F.lit(""))), F.lit(r"([a-z][a-z\-]{2,})"), F.lit(1))
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in CLAIM_STOPWORDS]))


def claim_signature(c: Column | str) -> Column:
    return F.array_join(F.slice(F.sort_array(content_tokens(c)), 1, 12), " ")


def claim_type(c: Column | str, fallback: str = "fact") -> Column:
    """the first type one of whose keywords the text contains."""
    t = F.lower(F.coalesce(S.col(c), F.lit("")))
    return reduce(lambda e, kv: e.when(any_of(t, kv[1]), kv[0]), CLAIM_TYPES.items(), F.when(F.lit(False), fallback)).otherwise(fallback)


def claims(title: Column | str, text: Column | str) -> Column:
    """up to four claim sentences, the title first, one for each signature."""
    norm = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    head = norm(F.coalesce(S.col(title), F.lit("")))
    parts = F.transform(F.split(F.coalesce(S.col(text), F.lit("")), r"(?<=[.!?])\s+|(?<=:)\s+"), norm)
    good = F.filter(parts, lambda s: (F.length(s) >= 35) & (F.size(content_tokens(s)) >= 4) & (any_of(F.lower(s), CLAIM_VERBS) | (head == "") | (s == head)))
    first = F.when((head != "") & (F.size(content_tokens(head)) >= 4) & ~F.array_contains(good, head), F.array(head)).otherwise(F.array().cast("array<string>"))
    four = F.slice(F.concat(first, good), 1, 4)
    marks = F.transform(four, claim_signature)
    kept = F.filter(F.transform(four, lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda e: (F.array_position(marks, claim_signature(e["s"])) == e["i"] + 1) & (claim_signature(e["s"]) != ""))
    return F.transform(kept, lambda e: e["s"])


def similar(a: Column | str, b: Column | str) -> Column:
    """four shared content words, or 60 % of the smaller set."""
    x, y = content_tokens(a), content_tokens(b)
    n = F.size(F.array_intersect(x, y))
    return (F.size(x) > 0) & (F.size(y) > 0) & ((n >= 4) | (n >= F.least(F.size(x), F.size(y)) * 0.6))


def number(c: Column | str) -> Column:
    """the first number in a text, else the value of the first number word."""
    t = F.lower(F.coalesce(S.col(c), F.lit("")))
    digits = F.regexp_replace(F.regexp_extract(t, r"(\d[\d,]*(?:\.\d+)?)", 1), ",", "")
    word = F.regexp_extract(t, r"\b(" + "|".join(NUMBER_WORDS) + r")\b", 1)
    named = reduce(lambda e, kv: e.when(word == kv[0], F.lit(float(kv[1]))), NUMBER_WORDS.items(), F.when(F.lit(False), F.lit(0.0)))
    return F.when(digits != "", digits.try_cast("double")).otherwise(named)


def date(c: Column | str) -> Column:
    """an ISO date, else day-month-year or month-day-year by name; null if impossible."""
    t = F.lower(F.coalesce(S.col(c), F.lit("")))
    names = "|".join(MONTHS)
    iso = F.regexp_extract(t, r"(\d{4}-\d{2}-\d{2})", 1)
    pad = lambda x: F.lpad(x, 2, "0")
    month = lambda x: pad((F.array_position(F.array(*[F.lit(m) for m in MONTHS]), x)).cast("string"))
    dmy = [F.regexp_extract(t, rf"(\d{{1,2}}) ({names}),? (\d{{4}})", k) for k in (1, 2, 3)]
    mdy = [F.regexp_extract(t, rf"({names}) (\d{{1,2}}),? (\d{{4}})", k) for k in (1, 2, 3)]
    a, b = F.concat_ws("-", dmy[2], month(dmy[1]), pad(dmy[0])), F.concat_ws("-", mdy[2], month(mdy[0]), pad(mdy[1]))
    return F.coalesce(F.when(iso != "", iso), F.when(dmy[2] != "", a), F.when(mdy[2] != "", b)).try_cast("date")


def quality_score(title: Column, description: Column, published_at: Column, language: Column, domain: Column, registered: Column, region: Column, tier: Column, topic_hits: Column, low_signal: list[str] = LOW_SIGNAL) -> Column:
    """F16: points for source, shape and language, minus points for low signal (patterns ``low_signal``)."""
    t, d = F.trim(F.coalesce(title, F.lit(""))), F.trim(F.coalesce(description, F.lit("")))
    add = lambda cond, v: F.when(cond, v).otherwise(0)
    low = reduce(lambda a, b: a + b, [add(F.lower(t).rlike(p), 4) for p in low_signal], F.lit(0))
    words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    return (
        add(registered, 3) + add(region.isNotNull() & ~region.isin("global", "united-states", "europe"), 2) + add(tier == "tier_2", 1)
        + add(F.length(t).between(24, 180), 2) + add((d != "") & (d != t) & (F.length(d) >= 48), 2) + add(published_at.isNotNull(), 1) + add(S.is_english(language) | language.isNotNull(), 1)
        - low - add(words < 5, 2) - add((d == t) & (F.length(d) < 80), 2) + topic_hits - add(domain.isin(*DOMINANT_DOMAINS), 1)
    )


def entity_name(c: Column | str, blocked: list[str], aliases: dict[str, str]) -> Column:
    """alias, else title case; null for blocked, short, long or numeric names."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(S.col(c), F.lit("")), r"(?i)^the\s+|['’]s$", ""), r"\s+", " "))
    low = F.lower(t)
    bad = (F.length(t) < 3) | (F.size(F.split(t, " ")) > 5) | t.rlike(r"^[\d\W]+$") | low.isin(*(blocked or [""]))
    return F.when(~bad, F.coalesce(*[F.when(low == k, F.lit(v)) for k, v in aliases.items()], F.initcap(low)))


def event_rank(articles: Column, sources: Column, age_hours: Column) -> Column:
    """size, distinct sources and a freshness band."""
    fresh = F.when(age_hours <= 6, 12).when(age_hours <= 24, 8).when(age_hours <= 72, 4).otherwise(0)
    return F.least(articles, F.lit(10)) * 2 + F.least(sources, F.lit(8)) * 3 + fresh


def importance(fatalities: Column, tier1: Column, sources: Column, contradictions: Column, growth: Column) -> Column:
    """five capped parts; the fatality part is 3.5 ln(1 + f), at most 25."""
    part = lambda c, cap: F.least(F.greatest(c, F.lit(0.0)), F.lit(float(cap)))
    return part(F.log1p(fatalities.cast("double")) * 3.5, 25) + part(tier1 * 5.0, 25) + part(sources * 2.0, 20) + part(contradictions * 3.0, 15) + part(growth * 1.5, 15)


def hotspot_weight(fatalities: Column, sources: Column, recency: Column) -> Column:
    """F30."""
    return (F.lit(1.0) + F.log1p(fatalities.cast("double")) * 0.9 + F.least(sources, F.lit(5)) * 0.2) * (F.lit(0.35) + recency * 0.65)
