"""Risk signals in news about suppliers as column expressions.

An item has a title and a snippet; a supplier has a name, a canonical name and an array of aliases.
Keyword tests look anywhere in the text, also within words: "warning" has "war".
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from supplymesh.functions.levels import ordinal
from supplymesh.functions.names import let
from supplymesh.functions.text import contains_phrase, has_any, matched, phrase_count

# Least relevance; days that an item counts; terms by what they tell.
LEAST_RELEVANCE, NEWS_DAYS, FINANCIAL_DAYS = 10, 90, 180
FACILITY = ["factory", "plant", "fab", "facility", "site", "production line"]
WORKFORCE = ["worker", "workforce", "employee", "union", "labor"]
REGION = ["taiwan", "china", "ukraine", "russia", "middle east", "red sea", "south china sea"]
DIRECT = ["manufacturing", "production", "operations", "delivery", "deliveries", "shipment", "shipments", "orders", "output"]
INDUSTRY = ["semiconductor", "chip", "memory", "foundry", "electronics", "industry", "market", "brands", "chipmakers"]
WAR_INDUSTRY = ["semiconductor", "chip", "foundry", "electronics", "industry"]
IMPACT = ["disrupt", "disruption", "shortage", "delay", "production"]
WAR = ["war", "conflict", "invasion", "military attack", "escalation"]
CRITICAL = ["shutdown", "sanction", "explosion", "natural disaster", "catastrophe"]
STRIKE = ["strike", "labor strike", "work stoppage"]
HIGH = ["export restriction", "severe disruption", "shortage", "disruption", "fire", "flood", "earthquake"]
MEDIUM = ["investigation", "lawsuit", "fine", "litigation"]
LOW = ["warning", "rumor", "protest", "dispute"]
BANKRUPTCY = ["bankruptcy", "insolvency", "liquidation", "default"]
BANKRUPTCY_OWN = ["files for", "filed for", "seeks bankruptcy", "enters bankruptcy", "declares bankruptcy", "insolvent", "liquidation", "defaulted"]
BANKRUPTCY_CUSTOMER = ["customer", "client", "buyer", "major customer"]
FINANCE_HIGH = ["debt crisis", "plant closure", "factory closure", "revenue collapse", "severe losses"]
LAYOFF = ["layoff", "layoffs", "workforce reduction", "job cuts", "major layoffs"]
LAYOFF_OWN = ["supplier", "company", "workforce", "employees"]
FINANCE_MEDIUM = ["earnings miss", "declining revenue", "profit warning", "cost cutting", "restructuring"]
FINANCE_LOW = ["slowdown", "weak demand", "reduced guidance"]
DATA_QUALITY = ["failed verification", "no verification data", "low verification confidence", "legitimacy cannot be confirmed", "relationship verification"]
EXTERNAL_TYPES = ["geopolitical", "news", "financial", "environmental"]
EXTERNAL = ["bankruptcy", "capacity shortage", "conflict", "debt", "default", "disruption", "earthquake", "export restriction", "financial distress", "fire", "flood", "geopolitical", "insolvency", "labor strike", "natural disaster", "plant closure", "revenue collapse", "sanction", "shortage", "shutdown", "strike", "trade restriction", "war"]
#: Regions in the order in which a location is searched for them: severity, confidence, summary, reason.
ZONES = {
    "Taiwan": ("High", 0.9, "Taiwan geopolitical exposure", "a high-tension geopolitical region"),
    "Ukraine": ("Critical", 0.9, "active conflict-zone exposure", "an active conflict zone"),
    "South China Sea": ("Medium", 0.9, "South China Sea shipping exposure", "a disputed maritime trade region"),
    "China": ("Medium", 0.7, None, None),
    "Russia": ("Medium", 0.7, None, None),
    "Middle East": ("Medium", 0.7, None, None),
}


def _say(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts))


def relevance(name: Column, canonical: Column, aliases: Column, title: Column, snippet: Column) -> Column:
    """How much an item is about a supplier: names 5 each, aliases 3, in the title 5, in the snippet 3, mentioned once only 1."""
    text = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(snippet, F.lit("")))
    known = F.filter(F.array_except(F.coalesce(aliases, F.array().cast("array<string>")), F.array(name, canonical)), lambda a: contains_phrase(text, a))
    return let(known, lambda found: _relevance(name, canonical, found, title, snippet, text))


def _relevance(name: Column, canonical: Column, found: Column, title: Column, snippet: Column, text: Column) -> Column:
    terms = F.array_distinct(F.filter(F.concat(F.array(name, canonical), found), lambda t: t.isNotNull() & (t != "")))
    count = F.aggregate(F.transform(terms, lambda t: phrase_count(text, t).cast("int")), F.lit(0), lambda s, x: s + x)
    points = lambda yes, n: F.when(yes, n).otherwise(0)
    any_in = lambda where: F.exists(terms, lambda t: contains_phrase(F.coalesce(where, F.lit("")), t))
    return points(contains_phrase(text, name), 5) + points((canonical != name) & contains_phrase(text, canonical), 5) + points(F.size(found) > 0, 3) + points(any_in(title), 5) + points(any_in(snippet), 3) + points(count == 1, 1)


def scope(terms: Column, title: Column, text: Column, keywords: list[str], target: Column | None = None) -> Column:
    """What an item is about: the target, a facility, the supplier, a region, the industry. ``text``: title and snippet in lower case."""
    in_title = F.exists(terms, lambda t: contains_phrase(F.coalesce(title, F.lit("")), t))
    out = F.when(F.lit(False), "")
    if target is not None:
        out = out.when((F.coalesce(target, F.lit("")) != "") & contains_phrase(text, target) & has_any(text, IMPACT), "target_impact")
    return (
        out.when(has_any(text, FACILITY), "direct_facility").when(has_any(text, WORKFORCE), "direct_supplier").when(has_any(text, REGION), "regional")
        .when(in_title & has_any(title, keywords), "direct_supplier").when(in_title & has_any(text, DIRECT), "direct_supplier").when(has_any(text, INDUSTRY), "general_industry").otherwise("unscoped")
    )


def _risk(severity: Column | str | None, confidence: Column | float | None, reasoning: Column, mitigation: str, keywords: Column) -> Column:
    lit = lambda x, kind: F.lit(x).cast(kind) if not isinstance(x, Column) else x.cast(kind)
    return F.struct(lit(severity, "string").alias("severity"), lit(confidence, "double").alias("confidence"), reasoning.alias("reasoning"), F.lit(mitigation).alias("mitigation"), keywords.alias("keywords"))


_ALTERNATIVES = "Assess total exposure and identify immediate alternatives."
_BUFFER = "Notify production teams and prepare buffer stock or secondary routes."


def news_risk(name: Column, terms: Column, title: Column, snippet: Column, target: Column | None = None, strict_labor: bool = False) -> Column:
    """The risk in a relevant news item: struct(severity, confidence, reasoning, mitigation, keywords). The first group of keywords that
    the text has decides, also where it then gives no risk (null severity). ``strict_labor``: "strike" about deals doesn't count, "union strike" does."""
    whole = F.concat(F.lower(F.coalesce(title, F.lit(""))), F.lit(" "), F.lower(F.coalesce(snippet, F.lit(""))))
    return let(whole, lambda text: _news_risk(name, terms, title, text, target, strict_labor))


def _news_risk(name: Column, terms: Column, title: Column, text: Column, target: Column | None, strict_labor: bool) -> Column:
    sc = lambda keywords: scope(terms, title, text, keywords, target)
    none = F.lit(None)
    war = (
        F.when(has_any(text, FACILITY), _risk("Critical", 0.85, _say("War risk may affect supplier facilities: ", title, "."), _ALTERNATIVES, matched(text, WAR)))
        .when(has_any(text, REGION), _risk("High", 0.75, _say("War risk may affect supplier region: ", title, "."), _ALTERNATIVES, matched(text, WAR)))
        .when((sc(WAR) == "general_industry") | has_any(text, WAR_INDUSTRY), _risk("Medium", 0.65, _say("Industry-level war risk mention involving ", name, ": ", title, "."), _ALTERNATIVES, matched(text, WAR)))
        .otherwise(_risk(none, none, F.lit(None).cast("string"), _ALTERNATIVES, matched(text, WAR)))
    )
    c = sc(CRITICAL)
    critical = (
        F.when(c == "general_industry", _risk("Medium", 0.65, _say("Industry-level risk mention involving ", name, ": ", title, "."), _ALTERNATIVES, matched(text, CRITICAL)))
        .when(c == "regional", _risk("High", 0.72, _say("Regional risk may affect ", name, "'s supply path: ", title, "."), _ALTERNATIVES, matched(text, CRITICAL)))
        .otherwise(_risk("Critical", 0.8, _say("Critical supplier-specific event detected for ", name, ": ", title, "."), _ALTERNATIVES, matched(text, CRITICAL)))
    )
    strike_words = ["union strike", *STRIKE] if strict_labor else STRIKE
    s = sc(strike_words).isin("direct_facility", "direct_supplier", "target_impact") | has_any(text, WORKFORCE + FACILITY)
    strike = _risk(F.when(s, "High").otherwise("Low"), F.when(s, 0.75).otherwise(0.55), _say("Supplier labor disruption signal for ", name, ": ", title, "."), _BUFFER, matched(text, strike_words))
    h = sc(HIGH)
    high = (
        F.when(h == "general_industry", _risk("Medium", 0.6, _say("General industry risk mention involving ", name, ": ", title, "."), _BUFFER, matched(text, HIGH)))
        .when(h == "unscoped", _risk("Low", 0.55, _say("Unconfirmed supplier risk mention involving ", name, ": ", title, "."), _BUFFER, matched(text, HIGH)))
        .otherwise(_risk("High", 0.75, _say("Significant supplier-path risk detected for ", name, ": ", title, ". High probability of delivery delays."), _BUFFER, matched(text, HIGH)))
    )
    medium = _risk("Medium", 0.65, _say("Moderate supplier-specific operational/regulatory issue: ", title, "."), "Conduct detailed risk review and monitor for further escalation.", matched(text, MEDIUM))
    low = _risk("Low", 0.55, _say("Potential supplier-specific early warning signal: ", title, "."), "Track news cycle for 7-14 days for resolution or escalation.", matched(text, LOW))
    labor = has_any(text, strike_words)
    if strict_labor:
        labor = labor & ~text.rlike(r"strike[sd]?\s+(?:a\s+)?(?:\w+\s+)?(?:deal|agreement|partnership)")
    return F.when(has_any(text, WAR), war).when(has_any(text, CRITICAL), critical).when(labor, strike).when(has_any(text, HIGH), high).when(has_any(text, MEDIUM), medium).when(has_any(text, LOW), low)


def financial_risk(name: Column, title: Column, snippet: Column) -> Column:
    """The risk in a relevant financial item, as ``news_risk`` gives it."""
    text = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(snippet, F.lit(""))))
    none = F.lit(None)
    first = "Evaluate immediate alternate suppliers and assess total exposure."
    bankrupt = (
        F.when(has_any(text, BANKRUPTCY_OWN), _risk("Critical", 0.85, _say("Supplier itself appears financially distressed: ", title, "."), first, matched(text, BANKRUPTCY)))
        .when(has_any(text, BANKRUPTCY_CUSTOMER), _risk("High", 0.75, _say("Major customer financial distress may affect supplier demand: ", title, "."), first, matched(text, BANKRUPTCY)))
        .otherwise(_risk(none, none, F.lit(None).cast("string"), first, matched(text, BANKRUPTCY)))
    )
    own = has_any(text, LAYOFF_OWN) | F.contains(text, F.lower(name))
    layoff = _risk(F.when(own, "Medium"), F.when(own, 0.7), F.when(own, _say("Supplier layoffs detected: ", title, ".")), "Monitor operational continuity and supplier financial disclosures.", matched(text, LAYOFF))
    return (
        F.when(has_any(text, BANKRUPTCY), bankrupt)
        .when(has_any(text, FINANCE_HIGH), _risk("High", 0.8, _say("High supplier-specific financial risk detected: ", title, "."), "Evaluate alternate suppliers and monitor financial disclosures.", matched(text, FINANCE_HIGH)))
        .when(has_any(text, LAYOFF), layoff)
        .when(has_any(text, FINANCE_MEDIUM), _risk("Medium", 0.7, _say("Moderate supplier-specific financial signal: ", title, "."), "Request financial health disclosure and monitor quarterly performance.", matched(text, FINANCE_MEDIUM)))
        .when(has_any(text, FINANCE_LOW), _risk("Low", 0.6, _say("Minor supplier-specific financial warning: ", title, "."), "Track performance for next 2 quarters for stabilization.", matched(text, FINANCE_LOW)))
    )


def region(location: Column) -> Column:
    low = F.lower(F.coalesce(location, F.lit("")))
    out = F.when(F.lit(False), "")
    for name in ZONES:
        out = out.when(F.contains(low, F.lit(name.lower())), name)
    return out


def geopolitical_risk(name: Column, location: Column, path: Column) -> Column:
    """The risk of a location, as ``news_risk`` gives it; null for other locations."""
    r, out = region(location), F.when(F.lit(False), _risk(None, None, F.lit(""), "", F.array().cast("array<string>")))
    for zone, (severity, confidence, summary, reason) in ZONES.items():
        words = (f"{summary} through ", name, ". Affected path: ", path, ". Reason: ", name, " is located in ", location, f", {reason}.") if summary else ("Geographic tension exposure through ", name, ". Affected path: ", path, ". Reason: ", name, " is located in ", location, ", creating trade or political exposure for this supply path.")
        how = "Identify and qualify alternative suppliers in diverse geographic regions." if summary else "Monitor trade policy changes and explore friend-shoring options."
        out = out.when(r == zone, _risk(severity, confidence, _say(*words), how, F.array(F.lit(zone))))
    return out


_DATE = r"\b(\d{1,2})[ -]+([A-Za-z]{3})[A-Za-z]*[ -]+(\d{4}|\d{2})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?(?!\d)"


def published(raw: Column) -> Column:
    """The wall-clock time of an RFC 2822 date, its zone left out; null for anything else. Seconds may be missing; years of two digits are
    those from 1969 to 2068."""
    # the date is looked for once, and its parts are cut out of what was found
    return let(F.split(F.regexp_replace(F.regexp_substr(raw, F.lit(_DATE)), "[ :-]+", " "), r"\s+"), _published)


def _published(part: Column) -> Column:
    at = lambda i: F.get(part, F.lit(i))
    year = F.when(F.length(at(2)) == 4, at(2)).when(at(2) > "68", F.concat(F.lit("19"), at(2))).otherwise(F.concat(F.lit("20"), at(2)))
    whole = F.concat(at(0), F.lit(" "), F.initcap(F.left(at(1), F.lit(3))), F.lit(" "), year, F.lit(" "), F.lpad(at(3), 2, "0"), F.lit(":"), at(4), F.lit(":"), F.coalesce(at(5), F.lit("00")))
    return F.try_to_timestamp(whole, F.lit("d MMM yyyy HH:mm:ss")).cast("timestamp_ntz")


def recent(raw: Column, as_of: Column, days: int) -> Column:
    return recently(published(raw), as_of, days)


def recently(when: Column, as_of: Column, days: int) -> Column:
    """Whether a time that published() gave is one of the last days."""
    return F.coalesce(when >= as_of.cast("timestamp_ntz") - F.make_dt_interval(F.lit(days)), F.lit(False))


def is_external(risk_type: Column, reasoning: Column) -> Column:
    """Whether a risk lies outside the data: not one about verification, and of an external type or with an external word."""
    text = F.lower(F.concat_ws(" ", risk_type, reasoning))
    return ~has_any(text, DATA_QUALITY) & (F.lower(risk_type).isin(EXTERNAL_TYPES) | has_any(text, EXTERNAL))


def worst_severity(severities: Column) -> Column:
    """The most severe of an array of severities; null for none."""
    return F.array_max(F.transform(severities, lambda s: F.struct(ordinal(s).alias("o"), s.alias("s"))))["s"]
