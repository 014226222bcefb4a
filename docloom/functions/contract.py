"""The closed document contract of a brief, in a small notation that is compiled to columns.

A field is written ``name`` or ``name!`` (required) with a kind: ``str``, ``int``, ``num``, ``obj`` (open), with ``?`` if
null is allowed, a tuple of strings for an enumeration (None among them allows null), a dict for a closed object, or a
List. Kinds that occur twice are named.
"""

from __future__ import annotations

from dataclasses import dataclass

from docloom.functions.vocab import SECTIONS, SOURCE_TYPES, SURFACES


@dataclass(frozen=True)
class List:
    of: object
    most: int | None = None
    unique: bool = False


@dataclass(frozen=True)
class Map:
    of: object


LEVELS = ("critical", "high", "medium", "low")
TIERS = ("high", "medium", "low")
SOURCES = List({"type!": SOURCE_TYPES, "ref": "str?", "snippet": "str?"})
CONTACTS = List({
    "name!": "str", "title": "str?", "email": "str?", "engagement": ("active", "passive", "unknown", None),
    "note": "str?", "sf_contact_id": "str?", "sources": SOURCES,
})

# Field names, enumerations and caps of the contract.
BRIEF = {
    "_meta": "obj",
    "account!": {"name!": "str", "type": "str?", "industry": "str?", "cid": "str?", "sf_account_id": "str?"},
    "surface!": SURFACES,
    "generated_at!": "str",
    "executive_summary!": "str",
    "confidence!": {"overall!": TIERS, "rationale": "str", "per_section": Map(TIERS)},
    "empty_sections!": List(SECTIONS, unique=True),
    "sources_used!": List(SOURCE_TYPES, unique=True),
    "must_address": List({
        "topic!": "str", "urgency!": LEVELS, "what_happened!": "str", "open_in_meeting!": "str", "watch_for": "str?", "sources": SOURCES,
    }, most=8),
    "pipeline": {
        "total_active_mrr": "str?",
        "items": List({
            "name!": "str", "amount": "str?", "stage!": "str", "close_date": "str?", "probability": "num?", "sf_opp_id": "str?",
            "next_step": "str?", "sources": SOURCES,
        }),
    },
    "support_health": {
        "open_cases_count": "int>=0", "open_p1_count": "int>=0",
        "items": List({
            "case_number!": "str", "subject!": "str", "priority!": ("P1", "P2", "P3", "P4", None), "status!": "str", "opened_at": "str?",
            "last_updated_at": "str?", "sf_case_id": "str?",
        }),
        "trend": ("improving", "stable", "degrading", None),
    },
    "relationship_map": {k: CONTACTS for k in ("champions", "blockers", "neutral", "decision_makers", "new_contacts")},
    "recent_activity": List({
        "date!": "str",
        "type!": ("meeting", "call", "email", "support", "quote", "note", "teams_message", "opportunity_event", "case_event", "internal_note"),
        "summary!": "str", "sources": SOURCES,
    }, most=20),
    "external_signal": {
        "news": List({"headline!": "str", "source": "str?", "url": "str?", "published_at": "str?", "relevance!": "str"}, most=5),
        "internal_chatter": List({"source!": ("teams", "sharepoint", "email"), "headline!": "str", "context": "str?", "implication!": "str"}, most=5),
    },
    "knowledge_context": List({"title!": "str", "url": "str?", "relevance!": "str"}, most=5),
    "pricing_history": {
        "summary": "str",
        "recent_quotes": List({"display_id!": "str", "created_at!": "str", "summary!": "str", "amount": "str?"}, most=5),
        "period_breakdown": List({
            "period!": "str", "product_line!": "str", "dc_code": "str?", "mrc_usd!": "num?", "nrc_usd": "num?", "note": "str?",
        }, most=30),
    },
    "renewal": {
        "next_renewal_date": "str?", "contract_value": "str?", "days_to_renewal": "int?",
        "expansion_signals": List({"signal!": "str", "sources": SOURCES}),
        "risk_signals": List({"signal!": "str", "severity!": LEVELS, "sources": SOURCES}),
        "sentiment": ("positive", "neutral", "at_risk", "churn_likely", None),
    },
    "timeline": List({
        "date!": "str", "event!": "str",
        "category": ("acquisition", "expansion", "incident", "leadership_change", "milestone", "renewal", None), "sources": SOURCES,
    }, most=15),
    "asks_and_next_steps": List({
        "action!": "str", "owner!": "str", "due_by": "str?", "status": ("open", "in_progress", "blocked", "done", None), "sources": SOURCES,
    }, most=10),
    "landmines": List({"landmine!": "str", "why!": "str", "severity": (*LEVELS, None), "sources": SOURCES}, most=5),
    "talking_points": List("str", most=5),
    "carryover": "str?",
    "meeting_opener": "str?",
}


def spark_type(kind: object = None) -> str:
    """The typed projection of a kind as DDL; closed objects are structs, open ones VARIANT."""
    kind = BRIEF if kind is None else kind
    if isinstance(kind, dict):
        return "struct<" + ", ".join(f"`{k.rstrip('!')}`: {spark_type(v)}" for k, v in kind.items()) + ">"
    if isinstance(kind, List):
        return f"array<{spark_type(kind.of)}>"
    if isinstance(kind, Map):
        return f"map<string, {spark_type(kind.of)}>"
    if isinstance(kind, tuple):
        return "string"
    return {"str": "string", "num": "double", "int": "bigint", "obj": "variant"}[kind[:3]]
