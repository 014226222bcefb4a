"""Vocabularies of briefs, as data."""

# The surfaces, account shapes, edge cases and source mixes that generation draws from.
SURFACES = ("meeting_prep", "qbr", "handoff", "renewal_alert", "onboarding", "escalation")
ACCOUNT_SHAPES = (
    "enterprise_steady", "enterprise_expanding", "mid_market_active", "mid_market_quiet",
    "small_strategic", "stalled_at_risk", "fresh_handoff", "incident_acute",
)
SOURCE_MIXES = ("sf_only", "with_news", "with_teams", "with_prior_prep", "rich", "minimal")

# Edge cases in table order, each with the substrings that tell it in a description.
EDGE_CASE_HINTS = {
    "subsidiary_explosion": ("subsidiar", "multiple sf row"),
    "null_industry": ("null industry", "industry comes back null", "industry is null"),
    "mis_categorized_industry": ("mis-categori", "industry tagged incorrectly", "wrong industry"),
    "multi_currency_amount": ("multi_currency", "multi-currency", "raw amount"),
    "sparse_activity": ("sparse activity", "activity logged >30", "last activity"),
    "activity_overlogged": ("overlogged", "50+ activities", "null who"),
    "bot_filed_case_noise": ("bot-filed", "bot filed", "rbl", "abuse-bot"),
    "p1_open_long": ("p1 case", "p1 open", "p1_open"),
    "closed_lost_recent": ("closed lost", "closed_lost"),
    "champion_churn": ("champion churn", "champion departed", "primary contact depart"),
    "non_latin_contact": ("non-latin", "non latin", "japanese", "chinese character", "kanji"),
    "duplicate_contacts": ("duplicate contact", "duplicate sf contact", "duplicate row"),
    "dc_code_gap": ("dc code", "dc_code"),
    "null_priority_cases": ("null priority", "priority is null", "priority field null"),
    "audit_cycle": ("audit cycle", "soc2", "ffiec", "hitrust", "infosec audit"),
    "public_announcement_anchor": ("public announcement", "press release", "earnings call"),
    "utilization_drop": ("utilization drop", "utilization below", "utilization_drop"),
    "opp_name_typo": ("opp name typo", "data-entry error", "typo"),
    "vp_newly_visible": ("vp newly visible", "senior executive appears", "vp_newly_visible"),
}
EDGE_CASES = tuple(EDGE_CASE_HINTS)

# Section keys in contract order, and the sections that each surface should consider.
SECTIONS = (
    "must_address", "pipeline", "support_health", "relationship_map", "recent_activity", "external_signal", "knowledge_context",
    "pricing_history", "renewal", "timeline", "asks_and_next_steps", "landmines", "talking_points", "carryover", "meeting_opener",
)
SURFACE_SECTIONS = {
    "meeting_prep": (
        "must_address", "pipeline", "relationship_map", "recent_activity", "external_signal", "knowledge_context", "pricing_history",
        "asks_and_next_steps", "landmines", "talking_points", "carryover", "meeting_opener",
    ),
    "qbr": (
        "must_address", "pipeline", "support_health", "relationship_map", "recent_activity", "external_signal", "knowledge_context",
        "pricing_history", "renewal", "asks_and_next_steps", "talking_points",
    ),
    "handoff": ("pipeline", "support_health", "relationship_map", "recent_activity", "timeline", "asks_and_next_steps", "landmines"),
    "renewal_alert": (
        "must_address", "pipeline", "support_health", "relationship_map", "external_signal", "pricing_history", "renewal",
        "asks_and_next_steps", "landmines",
    ),
    "onboarding": ("relationship_map", "recent_activity", "knowledge_context", "timeline", "asks_and_next_steps"),
    "escalation": ("must_address", "support_health", "recent_activity", "asks_and_next_steps"),
}

# Where claims stand: section, and the list inside it (None: the section is the list).
CLAIM_PATHS = (
    ("must_address", None), ("pipeline", "items"), ("recent_activity", None), ("asks_and_next_steps", None), ("landmines", None), ("timeline", None),
    ("relationship_map", "contacts"), ("relationship_map", "champions"), ("relationship_map", "decision_makers"), ("relationship_map", "detractors"),
    ("external_signal", "news"), ("external_signal", "internal_chatter"), ("renewal", "risk_signals"), ("support_health", "items"),
)
#: Claim paths whose items the contract lets carry sources.
SATISFIABLE_PATHS = tuple(p for p in CLAIM_PATHS if p[0] not in ("external_signal", "support_health") and p[1] not in ("contacts", "detractors"))
#: Claim paths of the written specification: every list of renewal and of contacts that can carry sources.
SPEC_PATHS = (*SATISFIABLE_PATHS, ("relationship_map", "blockers"), ("relationship_map", "neutral"), ("relationship_map", "new_contacts"), ("renewal", "expansion_signals"))

# Source types of inline sources and of sources_used.
SOURCE_TYPES = (
    "sf_account", "sf_opp", "sf_contact", "sf_activity", "sf_case", "teams", "sharepoint",
    "knowledge", "news", "pricing_history", "prior_prep", "calendar", "email", "internal_note",
)

# Sections that a surface populates heavily, and those it typically leaves empty.
HEAVY = {
    "meeting_prep": ("must_address", "recent_activity", "talking_points", "meeting_opener"),
    "qbr": ("renewal", "pricing_history", "must_address"),
    "handoff": ("timeline", "relationship_map", "landmines"),
    "renewal_alert": ("renewal", "must_address", "support_health", "pricing_history"),
    "onboarding": ("timeline", "relationship_map", "knowledge_context", "asks_and_next_steps"),
    "escalation": ("must_address", "support_health", "asks_and_next_steps"),
}
TYPICALLY_EMPTY = {
    "meeting_prep": ("timeline", "renewal", "carryover"),
    "qbr": ("timeline", "landmines", "carryover"),
    "handoff": ("must_address", "external_signal", "renewal", "talking_points", "meeting_opener", "carryover"),
    "renewal_alert": ("timeline", "knowledge_context", "talking_points", "carryover"),
    "onboarding": ("must_address", "external_signal", "renewal", "landmines", "talking_points", "meeting_opener", "carryover"),
    "escalation": ("pipeline", "external_signal", "knowledge_context", "pricing_history", "renewal", "timeline", "landmines", "talking_points", "meeting_opener", "carryover"),
}
FORBIDDEN_PHRASES = (
    "robust", "comprehensive", "industry-leading", "cutting-edge", "synergy", "alignment opportunity",
    "as we discussed", "circling back", "touch base",
)

#: Quality gates: metric, stage, relation, bound in percent.
THRESHOLDS = (
    ("m1", "v0.1", ">=", 95.0), ("m1", "v0.5", ">=", 99.0), ("m1", "v1.0", ">=", 99.9),
    ("m2", "v0.1", "<=", 5.0), ("m2", "v0.5", "<=", 2.0), ("m2", "v1.0", "<=", 0.5),
    ("m3", "v0.1", ">=", 90.0), ("m3", "v1.0", ">=", 99.0), ("m4", "v0.1", ">=", 90.0), ("m4", "v1.0", ">=", 98.0),
    ("m5", "v0.1", ">=", 80.0), ("m5", "v1.0", ">=", 95.0),
)
