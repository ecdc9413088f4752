"""The concept graph and the query profiles."""

from __future__ import annotations

#: Other names of concepts.
ALIASES = {
    "stock market": ["stock exchange", "equity market", "equities exchange", "securities market"],
    "malaysian stock market": ["malaysia equities", "malaysian equities", "bursa malaysia", "malaysia exchange"],
    "capital market": ["capital markets"],
    "foreign investment": ["foreign inflows", "capital inflows"],
    "commodity pricing": ["commodity prices", "commodity cycle"],
    "regulatory policy": ["market regulation", "regulation"],
    "market liquidity": ["liquidity conditions"],
    "valuation multiples": ["market valuation", "earnings multiples"],
    "dividend yields": ["dividend yield"],
    "listed companies": ["public companies", "listed firms"],
    "artificial intelligence": ["ai", "machine intelligence", "intelligent systems"],
    "machine learning": ["ml"],
    "frontier models": ["foundation models", "large models"],
    "compute infrastructure": ["compute capacity", "accelerator infrastructure"],
    "application domains": ["high-value application domains", "use cases"],
    "model governance": ["ai governance", "governance"],
    "risk mitigation": ["risk controls", "safety controls"],
    "capability building": ["organizational capability", "institutional capacity"],
    "investment flows": ["capital allocation", "funding flows"],
    "grid resilience": ["grid resilience planning", "resilience planning"],
    "emergency response": ["incident response"],
    "asset hardening": ["infrastructure hardening"],
    "restoration priorities": ["recovery priorities"],
    "continuity metrics": ["resilience metrics"],
    "reactor supply chain": ["advanced reactor supply chains", "nuclear supply chain"],
    "manufacturing capacity": ["industrial capacity"],
    "component qualification": ["supplier qualification"],
    "fuel services": ["fuel supply"],
    "nuclear deployment": ["reactor deployment"],
    "biography": ["biographical background", "background and identity"],
    "career milestones": ["career", "professional trajectory"],
    "leadership": ["leadership and governance"],
    "legacy": ["historical legacy"],
    "public office": ["state office", "government office"],
    "policy reform": ["reform agenda", "public policy"],
    "economy": ["economic outlook"],
    "domestic demand": ["household demand"],
    "exports": ["export growth"],
    "currency stability": ["exchange-rate stability"],
}
#: Undirected relations between concepts, by the first.
RELATIONS = {
    "malaysian stock market": ["stock market", "bursa malaysia"],
    "stock market": ["capital market", "listed companies", "market liquidity", "valuation multiples", "dividend yields", "foreign investment", "commodity pricing", "regulatory policy"],
    "foreign investment": ["capital market"],
    "commodity pricing": ["exports"],
    "regulatory policy": ["capital market"],
    "market liquidity": ["valuation multiples"],
    "artificial intelligence": ["machine learning", "frontier models", "compute infrastructure", "application domains", "model governance", "risk mitigation", "capability building", "investment flows"],
    "frontier models": ["compute infrastructure", "application domains"],
    "model governance": ["risk mitigation"],
    "capability building": ["model governance"],
    "investment flows": ["compute infrastructure"],
    "grid resilience": ["emergency response", "asset hardening", "restoration priorities", "continuity metrics"],
    "reactor supply chain": ["manufacturing capacity", "component qualification", "fuel services", "nuclear deployment"],
    "biography": ["career milestones", "leadership", "legacy"],
    "leadership": ["public office", "policy reform"],
    "economy": ["domestic demand", "exports", "currency stability", "foreign investment"],
}
#: Profiles: terms for a second query, words that a query on the topic has (all, any) and lacks (without), its phrases, and terms
#: that a text on the topic has and must not have.
PROFILES = {
    "thomas_cup": {
        "terms": ["badminton", "bwf", "men's team championship"],
        "phrases": ["thomas cup"], "all": ["thomas", "cup"], "any": [], "without": [],
        "groups": [["thomas cup", "bwf thomas cup"]],
        "positive": ["badminton", "bwf", "thomas cup", "shuttle", "shuttler", "men's team", "team championship"],
        "negative": ["fifa", "soccer", "football", "icc", "t20", "cricket", "fa cup", "efl", "league cup", "uefa"],
    },
    "fifa_world_cup_2026": {
        "terms": ["fifa", "soccer", "national teams", "usa", "mexico", "canada"],
        "phrases": ["world cup 2026", "2026 world cup", "us world cup"], "all": ["world", "cup", "2026"],
        "any": ["us", "usa", "united", "states", "america", "fifa", "soccer", "football"], "without": ["icc", "t20", "cricket"],
        "groups": [["world cup", "fifa world cup", "2026 fifa world cup"], ["fifa", "soccer", "football", "national team", "national teams"]],
        "positive": ["fifa", "soccer", "football", "national team", "national teams", "world cup", "usa", "united states", "mexico", "canada", "host nations"],
        "negative": ["icc", "t20", "cricket", "efl", "league cup", "fa cup", "arsenal", "manchester city"],
    },
    "iran_war_impact": {
        "terms": ["regional security", "oil", "sanctions", "geopolitics", "middle east"],
        "phrases": ["iran war", "2026 iran war"], "all": ["iran", "war"], "any": [], "without": [],
        "groups": [["iran", "iranian"], ["war", "conflict", "strikes", "military"]],
        "positive": ["iran", "iranian", "middle east", "regional security", "oil", "energy", "strait of hormuz", "sanctions", "geopolitics", "escalation", "global trade", "security architecture"],
        "negative": [],
    },
}
