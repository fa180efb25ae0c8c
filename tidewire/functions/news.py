"""Rules over news texts: anchors, labels, topics, types, consensus, predictions, places."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions import scalars as S

# fixed values: word lists and weights of the rules
STOPWORDS = ["the", "and", "that", "with", "from", "this", "into", "after", "over", "under", "amid", "against", "about", "their", "there", "which", "would", "could", "should", "while", "where", "when", "what", "than", "been", "have", "has", "were", "will"]
FRAMING_LABELS = {
    "terrorist": ["terrorist", "terrorists"], "rebel": ["rebel", "rebels"], "militant": ["militant", "militants"], "insurgent": ["insurgent", "insurgents"],
    "resistance": ["resistance", "fighters", "resistance fighters"], "separatist": ["separatist", "separatists"],
}
EVENT_ANCHORS = {
    "strike": ["strike", "airstrike", "attack", "raid", "bombing", "drone", "missile", "shelling", "offensive", "assault"],
    "ceasefire": ["ceasefire", "truce", "pause", "de-escalation", "armistice"],
    "sanctions": ["sanction", "sanctions", "blacklist", "designate", "designation", "tariff", "embargo", "penalty"],
    "meeting": ["meeting", "talks", "summit", "negotiation", "negotiations", "dialogue", "consultation"],
    "filing": ["filing", "petition", "indictment", "warrant", "complaint", "case", "lawsuit", "submission"],
    "vote": ["vote", "ballot", "election", "referendum", "resolution"],
    "detention": ["arrest", "detained", "detention", "custody", "jailed", "sentence"],
    "aid": ["aid", "relief", "humanitarian", "shipment", "delivery", "assistance"],
    "market": ["stocks", "shares", "market", "inflation", "gdp", "rates", "yield", "currency", "trade", "exports", "imports"],
    "policy": ["policy", "bill", "law", "decree", "reform", "budget", "package"],
}
ANCHOR_CONFLICTS = [
    ("strike", "meeting"), ("strike", "ceasefire"), ("strike", "aid"), ("sanctions", "meeting"), ("sanctions", "aid"), ("filing", "strike"), ("filing", "market"), ("vote", "strike"), ("vote", "meeting"), ("market", "strike"),
]
SENSATIONAL = ["blasts", "blast", "slams", "slam", "explodes", "explode", "shocking", "shock", "dramatic", "chaos", "chaotic", "furious", "stuns", "stun", "panic", "warpath"]
STATUS = {
    "closure": (["open", "reopened", "reopen", "operating", "active", "accessible"], ["closed", "closure", "shut", "blocked", "suspended", "halted"]),
    "ceasefire": (["agreed", "agreement", "accept", "accepted", "holding", "observed"], ["reject", "rejected", "collapse", "collapsed", "violated", "resumed"]),
    "control": (["captured", "secured", "retook", "controls", "seized"], ["lost", "withdrawal", "withdrew", "abandoned", "evacuated"]),
    "detention": (["released", "freed", "acquitted"], ["arrested", "detained", "jailed", "charged", "indicted"]),
    "sanctions": (["lifted", "waived", "eased"], ["imposed", "tightened", "expanded", "blacklisted", "designated"]),
}
TOPIC_KEYWORDS = {
    "geopolitics": [
        "war", "conflict", "military", "ceasefire", "airstrike", "air strike", "missile", "strike", "bombing", "explosion", "attack", "assault", "invasion", "occupation", "offensive", "counteroffensive", "shelling",
        "artillery", "drone strike", "naval", "warship", "fighter jet", "special forces", "troops", "soldiers", "casualties", "killed", "wounded", "fatalities", "civilian", "displacement", "refugee", "evacuation",
        "sanctions", "diplomacy", "treaty", "agreement", "summit", "talks", "peace deal", "nato", "un security council", "united nations", "elections", "election", "coup", "overthrow", "junta", "referendum",
        "parliament", "president", "prime minister", "government", "regime", "opposition", "protest", "uprising", "crackdown", "arrest", "detained", "extradition", "asylum", "expelled", "ambassador", "diplomat",
        "foreign minister", "secretary of state", "state department", "midterms", "election interference", "ballot", "iran", "israel", "ukraine", "russia", "china", "taiwan", "north korea", "gaza", "west bank",
        "hamas", "hezbollah", "isis", "al-qaeda", "putin", "zelensky", "netanyahu", "xi jinping", "sudan", "myanmar", "ethiopia", "sahel", "mali", "niger", "burkina faso", "somalia", "yemen", "syria", "iraq",
        "afghanistan", "pakistan", "venezuela", "haiti", "colombia", "mexico cartel", "intelligence", "espionage", "spy", "cyber attack", "cyberattack", "hack", "disinformation", "propaganda", "nuclear", "weapons",
        "ballistic", "hypersonic", "chemical weapons",
    ],
    "economics": [
        "inflation", "recession", "gdp", "growth", "economy", "economic", "market", "markets", "unemployment", "jobs", "labor market", "wage", "wages", "interest rate", "rates", "federal reserve", "fed", "central bank",
        "monetary policy", "quantitative easing", "tightening", "rate hike", "rate cut", "yield", "yields", "bond", "treasury", "tariffs", "tariff", "trade war", "trade deal", "trade deficit", "sanctions", "embargo",
        "export", "import", "supply chain", "supply crunch", "shortage", "futures", "options", "hedge fund", "stocks", "equities", "index", "rally", "selloff", "volatility", "oil", "crude", "opec", "gas", "energy",
        "commodity", "commodities", "gold", "copper", "wheat", "food prices", "gasoline", "fuel", "buyout", "merger", "acquisition", "ipo", "bankruptcy", "default", "debt", "credit", "loan", "bailout", "austerity",
        "imf", "world bank", "rupee", "yuan", "ruble", "currency", "exchange rate", "devaluation", "semiconductor", "chip", "reshoring", "nearshoring",
    ],
}
QUERY_TOPICS = {
    "geopolitics": ["iran", "israel", "ukraine", "russia", "china", "taiwan", "war", "military", "sanctions", "diplomacy", "missile", "nato", "conflict", "ceasefire", "strike"],
    "economics": ["inflation", "tariffs", "rates", "markets", "economy", "economic", "fed", "reserve", "jobs", "gdp", "oil", "trade", "currency", "bonds", "yields"],
}
QUERY_STOPWORDS = [
    "about", "across", "actually", "analysis", "analytical", "analyst", "and", "are", "article", "articles", "background", "beyond", "be", "brief", "briefing", "coming", "comprehensive", "conflict", "cover", "current",
    "currently", "deep", "dive", "direct", "events", "expect", "from", "give", "happening", "historical", "implications", "intelligence", "into", "key", "mainstream", "media", "missing", "motivations", "news", "of",
    "on", "or", "playing", "probability", "probabilitys", "precise", "role", "surface", "specific", "story", "talks", "that", "the", "their", "them", "they", "this", "underreporting", "what", "weeks", "who", "why",
    "with", "world", "would",
]
COUNTRY_ALIASES = {
    "usa": "united states", "us": "united states", "u.s.": "united states", "u.s.a.": "united states", "united states of america": "united states", "uk": "united kingdom", "u.k.": "united kingdom",
    "great britain": "united kingdom", "britain": "united kingdom", "england": "united kingdom", "london": "united kingdom", "russian federation": "russia", "moscow": "russia", "iran": "iran", "tehran": "iran",
    "china": "china", "people's republic of china": "china", "prc": "china", "beijing": "china", "syrian arab republic": "syria", "damascus": "syria", "kyiv": "ukraine", "kiev": "ukraine", "ankara": "turkey",
    "uae": "united arab emirates", "ivory coast": "cote d'ivoire", "côte d'ivoire": "cote d'ivoire", "drc": "dr congo", "zaire": "dr congo", "kinshasa": "dr congo", "republic of the congo": "congo",
    "brazzaville": "congo", "south korea": "south korea", "republic of korea": "south korea", "rok": "south korea", "north korea": "north korea", "pyongyang": "north korea",
}
STORY_TYPES = {
    "conflict": (["strike", "ceasefire"], ["war", "attack", "conflict", "military", "troops", "missile"]),
    "economic": (["sanctions", "market"], ["trade", "tariff", "economy", "inflation", "rates", "gdp"]),
    "diplomatic": (["meeting", "vote"], ["election", "summit", "diplomacy", "treaty", "talks"]),
    "humanitarian": (["aid"], ["humanitarian", "relief", "refugee"]),
    "legal": (["filing", "detention"], ["legal", "court", "indictment", "arrest"]),
}
STRONG_CONFLICT = [
    "killed", "airstrike", "air strike", "shelling", "missile strike", "rocket attack", "suicide bombing", "car bomb", "roadside bomb", "ied ", "fatalities", "death toll", "civilians killed", "soldiers killed",
    "troops killed", "fighters killed", "ceasefire", "offensive", "counteroffensive", "siege", "invasion", "incursion", "bombardment", "artillery fire", "clashes erupted", "fighting broke", "combat", "ambush",
    "gunfight", "firefight", "drone strike", "bombing campaign", "armed clashes", "armed attack", "mass killings", "war crimes",
]
WEAK_CONFLICT = ["military operation", "armed forces clashed", "rebel group", "militant group", "insurgent", "troop deployment", "guerrilla", "military offensive", "security forces fired", "weapons seized", "troops deployed"]
HOTSPOT_ASPECTS = {
    "conflict": ["conflict", "battle", "violence", "explosion", "attack", "airstrike", "strike", "missile", "drone", "war", "military", "clash"],
    "political": ["politic", "riot", "protest", "government"],
    "economic": ["econom", "market", "sanction", "trade"],
}
CONTINENTS = {
    "Asia": ["china", "india", "japan", "korea", "pakistan", "iran", "iraq", "saudi", "turkey", "israel", "bangladesh", "indonesia", "vietnam", "thailand", "philippines", "malaysia"],
    "Europe": ["france", "germany", "spain", "italy", "united kingdom", "uk", "russia", "poland", "ukraine", "sweden", "norway"],
    "Africa": ["egypt", "nigeria", "south africa", "kenya", "ethiopia", "algeria", "morocco", "sudan", "libya"],
    "North America": ["united states", "usa", "canada", "mexico"],
    "South America": ["brazil", "argentina", "chile", "colombia", "peru", "venezuela"],
    "Oceania": ["australia", "new zealand", "fiji", "samoa", "papua"],
    "Antarctica": ["antarctic"],
}
ACTIONS = [
    ("Strike", ["air", "aerial", "missile", "drone", "strike", "bombing", "car bombing"]), ("Attack", ["armed attack", "assault", "raid"]), ("Armed clash", ["battle", "fight", "guerrilla", "clash"]),
    ("Explosion", ["explosion", "remote violence"]), ("Protest", ["protest", "demonstrat", "hunger strike", "boycott"]), ("Riot", ["riot"]), ("Arrest or detention", ["arrest", "detain"]),
    ("Abduction", ["kidnap", "abduct"]), ("Security operation", ["expel", "deport"]), ("Sanctions action", ["sanction", "embargo"]), ("Threat", ["threat", "coerc"]), ("Territory occupation", ["occupy"]),
    ("Civilian violence", ["violence against civilians", "mass violence", "mass killings", "ethnic cleansing"]), ("Election-related development", ["election", "ballot", "vote", "referendum"]),
    ("Sanctions or trade action", ["tariff", "trade"]), ("Diplomatic development", ["diplomati", "agreement", "deal", "treaty", "ceasefire", "truce", "negotiat", "peace talk"]),
    ("Military movement", ["military operation", "deployment", "mobiliz", "troop movement", "military buildup"]), ("Political development", ["political", "government", "parliament", "legislation", "policy"]),
]
NARRATIVE = [
    "reported", "involving", "attack", "strike", "killed", "injured", "protest", "clash", "fighting", "bomb", "explosion", "arrest", "ceasefire", "sanction", "election", "diplomat", "military", "troops", "forces",
    "violence", "offensive", "defensive", "siege", "raid", "detain", "fatalities", "incident", "development", "escalat", "de-escalat", "tension",
]
PREDICTION_TYPES = {
    "military": ["strike", "offensive", "escalation", "incursion", "retaliation", "ceasefire", "missile"], "diplomacy": ["talks", "negotiation", "summit", "ceasefire", "deal", "agreement", "mediation"],
    "sanctions": ["sanction", "tariff", "restriction", "blacklist", "embargo"], "markets": ["rate", "inflation", "market", "recession", "oil", "currency", "yield"],
    "political": ["election", "cabinet", "parliament", "coalition", "protest", "leadership"],
}
CONFIDENCE = {"high": ["very likely", "high confidence", "highly likely", "almost certain"], "medium": ["likely", "probable", "expected", "should"], "low": ["possible", "may", "could", "watch for", "monitor"]}
GENERIC_SUBJECTS = ["monitor", "expect", "articles", "signals", "reporting", "briefing", "sources", "events"]
SECTIONS = ["SITUATION REPORT", "KEY DEVELOPMENTS", "CRITICAL ACTORS", "SIGNAL vs NOISE", "PREDICTIONS", "DEEPER CONTEXT", "WHAT TO WATCH", "SOURCE CONTRADICTIONS"]
QUERY_FILLER = ["likely", "within", "monitor", "expect", "watch", "current", "signals"]
TIER_WEIGHT, TYPE_WEIGHT = {"tier_1": 1.45, "tier_2": 1.1, "tier_3": 0.45}, {"official_update": 1.4, "structured_event": 1.25, "article": 1.0, "monitored_channel": 0.35}
ASSIGNMENT_STOPWORDS = ["the", "and", "for", "from", "with", "this", "that", "have", "has", "had", "into", "over", "under", "after", "before", "about", "amid", "amidst", "says", "said", "will", "were", "been", "their", "they", "them", "would", "could", "should", "also", "more"]
CAUSAL_PHRASES = ["in response to", "in retaliation for", "in retaliation", "after", "following", "because of", "due to", "amid", "over", "sparking"]
CAPITAL = ["washington dc", "white house", "state department", "pentagon", "capitol hill", "federal government"]
STATE = ["washington state", "seattle", "spokane", "olympia"]

lower = lambda c: F.lower(F.coalesce(S.col(c), F.lit("")))
strings = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<string>")


def has_any(text: Column, terms: list[str]) -> Column:
    """Whether a lower-case text contains one of the terms, inside words too."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in terms])


def hits(text: Column, terms: list[str]) -> Column:
    """How many of the terms a lower-case text contains."""
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(t)).cast("int") for t in terms])


def groups_in(c: Column | str, groups: dict[str, list[str]]) -> Column:
    """Names of the groups of which the text contains a term, in the order of the groups."""
    t = lower(c)
    return F.array_compact(F.array(*[F.when(has_any(t, v), F.lit(k)) for k, v in groups.items()]))


def first_group(c: Column | str, groups: dict[str, list[str]], other: str | None = None) -> Column:
    t = lower(c)
    return reduce(lambda e, kv: e.when(has_any(t, kv[1]), kv[0]), groups.items(), F.when(F.lit(False), F.lit(other))).otherwise(F.lit(other))


def keywords(c: Column | str) -> Column:
    """distinct words of four letters or more, hyphens inside, that are no stopwords."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(lower(c), F.lit(r"([a-z][a-z\-]{3,})"), F.lit(1))), strings(STOPWORDS))


def anchors(c: Column | str) -> Column:
    """F7."""
    return groups_in(c, EVENT_ANCHORS)


def anchor_conflict(a: Column, b: Column) -> Column:
    """F8: whether one side has an anchor that excludes one of the other side."""
    return reduce(lambda x, y: x | y, [(F.array_contains(a, p) & F.array_contains(b, q)) | (F.array_contains(a, q) & F.array_contains(b, p)) for p, q in ANCHOR_CONFLICTS])


def framing_labels(c: Column | str) -> Column:
    """F11."""
    return groups_in(c, FRAMING_LABELS)


def status_markers(c: Column | str) -> Column:
    """the pole of each dimension of which only one pole is in the text."""
    t = lower(c)
    poles = [F.when(has_any(t, p) & ~has_any(t, n), F.struct(F.lit(k).alias("key"), F.lit("positive").alias("value"))).when(has_any(t, n) & ~has_any(t, p), F.struct(F.lit(k).alias("key"), F.lit("negative").alias("value"))) for k, (p, n) in STATUS.items()]
    return F.map_from_entries(F.array_compact(F.array(*poles)))


def snippet(c: Column | str, limit: int = 18) -> Column:
    """the first ``limit`` tokens of a text that are no stopwords."""
    words = F.regexp_extract_all(lower(c), F.lit(r"([a-z0-9][a-z0-9\-']*)"), F.lit(1))
    return F.array_join(F.slice(F.filter(words, lambda w: ~w.isin(*STOPWORDS)), 1, limit), " ")


def countries(c: Column | str) -> Column:
    """canonical countries named in a text, in order, distinct."""
    names = sorted({*COUNTRY_ALIASES, *COUNTRY_ALIASES.values()}, key=lambda n: (-len(n), n))
    return countries_found(F.regexp_extract_all(lower(c), F.lit(r"\b(" + "|".join(map(re.escape, names)) + r")\b"), F.lit(1)))


def countries_found(found: Column) -> Column:
    """F14 from the names that were found in a text, in order."""
    table = F.create_map(*[F.lit(x) for kv in COUNTRY_ALIASES.items() for x in kv])
    return F.array_distinct(F.transform(found, lambda n: F.coalesce(F.try_element_at(table, n), n)))


def topics(c: Column | str, groups: dict[str, list[str]] = TOPIC_KEYWORDS) -> Column:
    """the topic with most keywords and those within one of it that have three or more."""
    t = lower(c)
    return _best_topics([(k, hits(t, v)) for k, v in groups.items()])


def topics_found(names: Column, groups: dict[str, list[str]] = TOPIC_KEYWORDS) -> Column:
    """F15 from the keywords that were found in a text."""
    return _best_topics([(k, F.size(F.array_intersect(names, strings(v)))) for k, v in groups.items()])


def _best_topics(counted: list[tuple[str, Column]]) -> Column:
    scored = F.array(*[F.struct((-n).alias("n"), F.lit(i).alias("i"), F.lit(k).alias("topic")) for i, (k, n) in enumerate(counted)])
    order = F.filter(F.array_sort(scored), lambda e: e["n"] < 0)
    best = F.try_element_at(order, F.lit(1))
    return F.transform(F.filter(order, lambda e: (e["i"] == best["i"]) | ((e["n"] <= best["n"] + 1) & (e["n"] <= -3))), lambda e: e["topic"])


def topic_or_nearest(found: Column, vector: Column, centroids: dict[str, list[float]], least: float = 0.30) -> Column:
    """topics by keyword, else those whose centroid is near the vector, nearest first."""
    near = F.array(*[F.struct((-S.cosine(vector, F.array(*[F.lit(float(x)) for x in v]))).alias("n"), F.lit(k).alias("topic")) for k, v in centroids.items()])
    close = F.transform(F.filter(F.array_sort(near), lambda e: e["n"] <= -least), lambda e: e["topic"])
    return F.when(F.size(found) > 0, found).otherwise(close)


def story_type(label: Column | str, own: Column) -> Column:
    """type of a story from its anchors or the words of its label."""
    t = lower(label)
    rules = [(k, F.arrays_overlap(own, strings(a)) | has_any(t, w)) for k, (a, w) in STORY_TYPES.items()]
    return reduce(lambda e, r: e.when(r[1], r[0]), rules, F.when(F.lit(False), "political")).otherwise("political")


def conflict_strength(c: Column | str) -> Column:
    """2 for a strong sign of conflict, 1 for a weak one."""
    t = lower(c)
    return F.when(has_any(t, STRONG_CONFLICT), 2).when(has_any(t, WEAK_CONFLICT), 1).otherwise(0)


def quality_weight(tier: Column, kind: Column, multiplier: Column) -> Column:
    """weight of a source by tier, type and measured reliability."""
    pick = lambda c, table: reduce(lambda e, kv: e.when(c == kv[0], kv[1]), table.items(), F.when(F.lit(False), 1.0)).otherwise(1.0)
    known = F.round(pick(tier, TIER_WEIGHT) * pick(kind, TYPE_WEIGHT) * F.coalesce(multiplier, F.lit(1.0)), 2)
    return F.when(tier.isNotNull(), known).otherwise(F.round(F.lit(0.95) * F.coalesce(multiplier, F.lit(1.0)), 2))


def bias_penalty(c: Column | str) -> Column:
    """framing labels, sensational words and excited punctuation."""
    t, raw = lower(c), F.coalesce(S.col(c), F.lit(""))
    loud = reduce(lambda a, b: a + b, [t.rlike(rf"\b{w}\b").cast("int") for w in SENSATIONAL])
    quotes = lambda q: F.length(raw) - F.length(F.replace(raw, F.lit(q), F.lit("")))
    return F.size(framing_labels(c)) * 2.8 + loud * 1.2 + F.when(raw.rlike("[?!]"), 1.5).otherwise(0.0) + F.when((quotes('"') >= 2) | (quotes("'") >= 2), 0.8).otherwise(0.0)


def title_score(c: Column | str, weight: Column, shared_keywords: Column, shared_anchors: Column) -> Column:
    """how well a title stands for its group: source, shared terms, length, less bias."""
    n = F.length(S.col(c))
    size = F.when(n.between(28, 110), 3.0).when(n < 18, -3.0).when(n > 130, -F.least((n - 130) / 10.0, F.lit(6.0))).otherwise(0.0)
    return F.round(weight * 4.0 + shared_keywords * 0.32 + shared_anchors * 1.25 + size - bias_penalty(c), 3)


def summary_score(summary: Column, headline: Column) -> Column:
    """length up to 220, less for short, long or repeated summaries, more for whole sentences."""
    n = F.length(summary)
    return (
        F.least(n, F.lit(220)) - F.when(n < 28, 120).otherwise(0) - F.when(F.lower(summary) == F.lower(headline), 400).otherwise(0) - F.greatest(n - 210, F.lit(0))
        + F.when(summary.rlike(r"[.!?;] "), 16).otherwise(0)
    )


def assignment_tokens(c: Column | str) -> Column:
    words = F.regexp_extract_all(lower(c), F.lit(r"([a-z0-9][a-z0-9_-]+)"), F.lit(1))
    return F.array_except(F.array_distinct(F.filter(words, lambda w: F.length(w) > 2)), strings(ASSIGNMENT_STOPWORDS))


def assignment_score(entities: Column, anchor: Column, words: Column, gap_hours: Column) -> Column:
    """weighted overlaps and a recency part that ends after 84 hours."""
    fresh = F.when(gap_hours.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.lit(2.8) - gap_hours / 30.0))
    return F.round(entities * 1.9 + anchor * 2.1 + words * 0.7 + fresh, 3)


def assignment_rule(entities: Column, anchor: Column, words: Column, gap_hours: Column, score: Column) -> Column:
    """the first rule that holds for an article of a group."""
    within = lambda h: gap_hours.isNull() | (gap_hours <= h)
    return (
        F.when((anchor >= 1) & (entities >= 1) & within(120), "anchor_entity_temporal").when((entities >= 2) & (words >= 2) & within(120), "entity_keyword_temporal")
        .when((anchor >= 1) & (words >= 3) & within(72), "anchor_keyword_compact").when(score >= 4.1, "score_threshold").otherwise("fallback_in_cluster")
    )


def section(c: Column | str, name: str) -> Column:
    """the text of a named section of a briefing."""
    ends = "|".join(re.escape(n) for n in SECTIONS)
    return F.trim(F.regexp_extract(S.col(c), rf"(?is)(?:^|\n){re.escape(name)}:\s*(.*?)(?=\n(?:{ends}):|\z)", 1))


def prediction_lines(text: Column) -> Column:
    """lines of a section without bullets and numbers; short lines and headings go."""
    clean = F.transform(F.split(text, r"\n"), lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(x), r"^[-*]\s*", ""), r"^\d+\.\s*", ""), r"^[ .]+|[ .]+$", ""))
    return F.filter(clean, lambda x: (F.length(x) >= 12) & ~F.endswith(x, F.lit(":")) & ~F.lower(x).rlike("^(articles included|event clusters analyzed)"))


def horizon_days(c: Column | str, default: Column) -> Column:
    t = lower(c)
    days, weeks = F.regexp_extract(t, r"within\s+(\d+)\s+day", 1), F.regexp_extract(t, r"within\s+(\d+)\s+week", 1)
    bound = lambda x, least: F.greatest(F.lit(least), F.least(F.lit(365), x))
    said = F.when(days != "", bound(days.try_cast("int"), 1)).when(weeks != "", bound(weeks.try_cast("int") * 7, 7))
    for phrase, n in (("next 48 hours", 2), ("next 72 hours", 3), ("next week", 7), ("coming weeks", 21), ("coming days", 7), ("next month", 30)):
        said = said.when(F.contains(t, F.lit(phrase)), n)
    return said.otherwise(default)


def prediction_subjects(c: Column) -> Column:
    """up to six capitalised names of a line, the first spelling of each, no generic words."""
    names = F.filter(F.regexp_extract_all(c, F.lit(r"(\b(?:[A-Z][a-z]+\s){0,3}[A-Z][a-z]+\b)"), F.lit(1)), lambda x: (F.length(x) >= 4) & ~F.lower(x).isin(*GENERIC_SUBJECTS))
    low = F.transform(names, F.lower)
    return F.slice(F.filter(names, lambda x, i: F.array_position(low, F.lower(x)) == i + 1), 1, 6)


def prediction_query(subjects: Column, text: Column, kind: Column) -> Column:
    """up to three subjects, else six content words, and two sorted words of the type."""
    words = F.filter(F.regexp_extract_all(text, F.lit(r"([A-Za-z][A-Za-z-]{3,})"), F.lit(1)), lambda w: ~F.lower(w).isin(*QUERY_FILLER))
    base = F.when(F.size(subjects) > 0, F.array_join(F.slice(subjects, 1, 3), " ")).otherwise(F.array_join(F.slice(words, 1, 6), " "))
    more = reduce(lambda e, kv: e.when(kind == kv[0], " ".join(sorted(kv[1])[:2])), PREDICTION_TYPES.items(), F.when(F.lit(False), "")).otherwise("")
    return F.trim(F.concat_ws(" ", base, more))


def search_focus(c: Column | str) -> Column:
    """the first quoted phrase, else the first eight words that carry meaning, else the question."""
    q = F.coalesce(S.col(c), F.lit(""))
    words = F.filter(F.split(F.regexp_replace(q, r"[^A-Za-z0-9\s-]", " "), r"\s+"), lambda w: (F.length(w) >= 3) & ~F.lower(w).isin(*QUERY_STOPWORDS))
    quoted = F.trim(F.regexp_extract(q, '"([^"]{4,})"', 1))
    return F.when(quoted != "", quoted).when(F.size(words) > 0, F.array_join(F.slice(words, 1, 8), " ")).otherwise(F.trim(q))


def query_topic(c: Column | str) -> Column:
    """the topic with most words in a question, the first of equal ones; null for none."""
    t = lower(c)
    a, b = hits(t, QUERY_TOPICS["geopolitics"]), hits(t, QUERY_TOPICS["economics"])
    return F.when(b > a, "economics").when(a > 0, "geopolitics")


def action_label(kind: Column, sub: Column, summary: Column) -> Column:
    """what happened, by the first rule of which the type, subtype or summary has a word."""
    t = F.lower(F.concat_ws(" ", kind, sub, summary))
    rules = [(k, has_any(t, v)) for k, v in ACTIONS]
    bare = (F.lower(kind) == "battles") & (F.coalesce(sub, F.lit("")).isin("") | (F.lower(sub) == F.lower(kind))) & ~has_any(t, ["fight", "assault", "attack", "raid", "guerrilla", "artillery", "air"])
    rules.insert(2, ("Conflict incident", bare))
    other = F.when(F.lower(kind).isin("strategic developments", "reported development"), "Strategic development").otherwise(F.coalesce(F.nullif(sub, F.lit("")), F.nullif(kind, F.lit("")), F.lit("Incident")))
    return reduce(lambda e, r: e.when(r[1], r[0]), rules, F.when(F.lit(False), "")).otherwise(other)


def clean_summary(c: Column) -> Column:
    """a summary without codes, intensity notes and mention counts."""
    for pattern in (
        r"\s*\(CAMEO\s+\d+,?\s*root\s+\d+\)", r"\s*\[?\d{3}\]?\s*$", r"\s*\(general\)", r"(?i)[\s.]*\(?(high|medium|low)[- ]intensity\s+(conflict|escalatory|cooperative)\s+event\)?\.?",
        r"(?i)[\s.]*\(?escalatory\s+event\)?\.?", r"(?i)[\s.]*\(?cooperative\s+development\)?\.?", r"(?i)[\s.]*covered by \d+\s+sources? with \d+\s+mentions?\.?", r"(?i)[\s.]*reported by \d+\s+sources?\.?",
    ):
        c = F.trim(F.regexp_replace(c, pattern, ""))
    return F.regexp_replace(c, r"[,. ]+$", "")


def is_template(c: Column) -> Column:
    return c.rlike(r"^[\w/ ]+\s+reported\s+in\s+[\w,.\s-]+\s+on\s+\d{4}-\d{2}-\d{2}\.?\s*$")


def is_narrative(c: Column) -> Column:
    return (F.length(c) > 30) & has_any(F.lower(c), NARRATIVE)


def place_key(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.trim(F.coalesce(S.col(c), F.lit("")))), "[^a-z0-9]+", " "))


def washington(key: Column, text: Column) -> Column:
    """F32: which Washington a text means; null where it names neither the capital nor the state."""
    t = F.lower(text)
    return F.when(key != "washington", key).when(has_any(t, CAPITAL), "washington dc").when(has_any(t, STATE), "washington state")
