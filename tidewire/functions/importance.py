"""F37 in full: the importance of a story from its sources, entities, severity and growth."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: weights of tiers, signs of escalation, caps of the parts
TIER_WEIGHTS = {"tier_1": 1.0, "tier_2": 0.72, "tier_3": 0.45}
ESCALATION = ("strike", "attack", "missile", "detention", "sanctions", "ceasefire", "filing", "vote")
CREDIBILITY_CAP, DIVERSITY_CAP, ENTITY_CAP, SEVERITY_CAP, GROWTH_CAP = 70.0, 15.0, 10.0, 25.0, 15.0


def tier(c: Column) -> Column:
    """A source's tier; unknown ones count as the third."""
    low = F.lower(F.trim(c))
    return F.when(low.isin(*TIER_WEIGHTS), low).otherwise("tier_3")


def credibility(tier_of: Column, measured: Column) -> Column:
    """Measured reliability (0.5 where none is known) times the weight of the tier."""
    weight = F.when(tier_of == "tier_1", TIER_WEIGHTS["tier_1"]).when(tier_of == "tier_2", TIER_WEIGHTS["tier_2"]).otherwise(TIER_WEIGHTS["tier_3"])
    return F.coalesce(measured, F.lit(0.5)) * weight


def _cap(c: Column, most: float) -> Column:
    return F.least(c, F.lit(most))


def parts(sources, tier1, mean_credibility, regions, languages, entities, escalations, contradictions, linked, fatalities, articles, last_articles, last_sources, last_contradictions, age_hours) -> dict[str, Column]:
    """The five parts and the fatality share of a story.  ``escalations`` is the number of its anchors in
    ESCALATION, ``last_*`` stand in its latest observation (``last_articles`` null: it is new)."""
    zero = F.lit(0.0)
    deaths = F.when(fatalities > 0, _cap(F.log1p(fatalities.cast("double")) * 3.5, 40.0)).otherwise(zero)
    more = lambda now, then: F.greatest(now - F.coalesce(then, F.lit(0)), F.lit(0))
    grown = _cap(more(articles, last_articles) * 1.8 + more(sources, last_sources) * 2.5 + more(contradictions, last_contradictions) * 1.2, 12.0)
    fresh = F.when(age_hours <= 6, 3.0).when(age_hours <= 24, 2.0).when(age_hours <= 48, 1.0).otherwise(0.0)
    return {
        "source_credibility": _cap(sources * 3.2 + tier1 * 8.0 + F.coalesce(mean_credibility, zero) * 18.0, CREDIBILITY_CAP),
        "source_diversity": _cap(F.greatest(regions - 1, F.lit(0)) * 3.5 + F.greatest(languages - 1, F.lit(0)) * 1.7 + F.least(sources, F.lit(3)), DIVERSITY_CAP),
        "entity_prominence": _cap(entities * 1.4, ENTITY_CAP),
        "severity_escalation": _cap(deaths + _cap(escalations * 2.0, 8.0) + _cap(contradictions * 1.8, 6.0) + _cap(linked * 1.25, 5.0), SEVERITY_CAP),
        "growth_novelty": _cap(F.when(last_articles.isNull(), 6.0).otherwise(grown) + fresh, GROWTH_CAP),
        "fatality_part": deaths,
    }


def score(found: dict[str, Column]) -> Column:
    total = sum((c for name, c in found.items() if name != "fatality_part"), F.lit(0.0))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), total)), 2)


def reasons(found: dict[str, Column], sources, tier1, regions, languages, hits, contradictions, fatalities, new, article_delta, source_delta) -> Column:
    """Up to five reasons, the heaviest part first, parts of equal weight in their usual order."""
    text = lambda *xs: F.concat(*[x.cast("string") if isinstance(x, Column) else F.lit(x) for x in xs])
    grown = F.when(new, "newly observed canonical event").when((article_delta > 0) | (source_delta > 0), text("coverage growth (+", article_delta, " articles, +", source_delta, " sources)")).otherwise("recent activity in the last 48h")
    signs = F.when(F.size(hits) > 0, F.concat(F.lit("escalation signals: "), F.array_join(F.slice(hits, 1, 3), ", "))).otherwise("escalation/severity context from linked signals")
    rows = [
        (found["source_credibility"], text(sources, " distinct sources (", tier1, " tier-1)")), (found["source_diversity"], text("source diversity across ", regions, " regions and ", languages, " languages")),
        (found["severity_escalation"], signs), (found["growth_novelty"], grown), (F.when(fatalities > 0, found["fatality_part"]).otherwise(0.0), text(fatalities, " linked fatalities")),
        (_cap(contradictions * 1.8, 6.0), text(contradictions, " cross-source contradictions")),
    ]
    listed = F.array(*[F.struct((-c.cast("double")).alias("w"), F.lit(i).alias("i"), t.alias("t")) for i, (c, t) in enumerate(rows)])
    return F.slice(F.transform(F.filter(F.array_sort(listed), lambda r: r["w"] < 0), lambda r: r["t"]), 1, 5)
