"""Static dimensions: the field registry, signatures, milestones and assumptions.

Every operator takes these as DataFrame or tuple arguments, so a caller can
bring others; the values here are the defaults.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# fixed values: layers, regions, statuses and orders of presentation
EXTRACTABLE_LAYERS = ("filing-summary", "agreement", "credit-agreement")
LAYER_CATEGORIES = {"credit-agreement": ("Financing",)}
CATEGORY_ORDER = ("Transaction identity", "Timing", "Conditions", "Termination and fiduciary provisions", "Financing", "Equity treatment")
CLASS_ORDER = ("conflict", "agreement_only", "summary_only", "unresolved", "normalized_match", "match", "not_applicable")
SECTION_ORDER = ("Signing", "Approvals and conditions", "Closing", "Termination", "Financing")
RISKS = ("benchmark_rate", "swap_spread", "issuer_credit_spread", "fx", "timing", "transaction_completion", "hedge_unwind")
STRATEGIES = ("Unhedged", "Forward-starting IRS", "Deal-contingent hedge")
LAYER_LABELS = {
    "filing-summary": "Filing summary",
    "agreement": "Operative agreement",
    "credit-agreement": "Financing agreement",
    "press-release": "Press release",
    "governing-documents": "Constitutional documents",
    "exhibit": "Exhibit",
    "unknown": "Unclassified",
}

_MERGER, _TENDER, _TAKEOVER, _SCHEME = "merger", "tender_offer", "takeover_offer", "scheme_of_arrangement"

# fixed values: (name, category, type, critical, structures or None, enum values)
FIELDS: tuple[tuple, ...] = (
    ("target", "Transaction identity", "text", True, None, None),
    ("acquirer", "Transaction identity", "text", True, None, None),
    ("merger_subsidiary", "Transaction identity", "text", False, (_MERGER, _TENDER, _SCHEME), None),
    ("guarantors", "Transaction identity", "text", False, None, None),
    ("agreement_date", "Transaction identity", "date", True, None, None),
    ("transaction_type", "Transaction identity", "enum", True, None, (_MERGER, _TENDER, _TAKEOVER, _SCHEME, "other")),
    ("consideration_type", "Transaction identity", "enum", False, None, ("cash", "stock", "mixed", "other")),
    ("consideration_per_share", "Transaction identity", "money", True, None, None),
    ("consideration_currency", "Transaction identity", "text", True, None, None),
    ("total_transaction_value", "Transaction identity", "money", False, None, None),
    ("expected_closing_timing", "Timing", "text", False, None, None),
    ("outside_date", "Timing", "date", True, None, None),
    ("extension_conditions", "Timing", "text", False, None, None),
    ("offer_or_acceptance_period", "Timing", "text", False, (_TENDER, _TAKEOVER), None),
    ("cure_periods", "Timing", "text", False, None, None),
    ("shareholder_approval_threshold", "Conditions", "text", True, (_MERGER, _SCHEME), None),
    ("tender_acceptance_threshold", "Conditions", "text", True, (_TENDER, _TAKEOVER), None),
    ("antitrust_approvals", "Conditions", "text", False, None, None),
    ("foreign_investment_approvals", "Conditions", "text", False, None, None),
    ("other_regulatory_approvals", "Conditions", "text", False, None, None),
    ("no_injunction_condition", "Conditions", "text", False, None, None),
    ("material_adverse_effect_condition", "Conditions", "text", False, None, None),
    ("burdensome_condition_limitation", "Conditions", "text", False, None, None),
    ("financing_condition", "Conditions", "enum", True, None, ("yes", "no")),
    ("company_termination_fee", "Termination and fiduciary provisions", "money", True, None, None),
    ("parent_termination_fee", "Termination and fiduciary provisions", "money", True, None, None),
    ("fee_triggers", "Termination and fiduciary provisions", "text", False, None, None),
    ("fee_tail", "Termination and fiduciary provisions", "text", False, None, None),
    ("superior_proposal_provisions", "Termination and fiduciary provisions", "text", False, None, None),
    ("change_in_board_recommendation", "Termination and fiduciary provisions", "text", False, None, None),
    ("matching_rights", "Termination and fiduciary provisions", "text", False, None, None),
    ("termination_rights", "Termination and fiduciary provisions", "text", False, None, None),
    ("funding_sources", "Financing", "text", False, None, None),
    ("committed_financing", "Financing", "text", False, None, None),
    ("bridge_amount", "Financing", "money", False, None, None),
    ("bridge_currency", "Financing", "text", False, None, None),
    ("bridge_maturity", "Financing", "text", False, None, None),
    ("interest_basis", "Financing", "text", False, None, None),
    ("financing_fees", "Financing", "text", False, None, None),
    ("duration_fees_and_step_ups", "Financing", "text", False, None, None),
    ("refinancing_requirements", "Financing", "text", False, None, None),
    ("financing_conditions", "Financing", "text", False, None, None),
    ("common_shares_treatment", "Equity treatment", "text", False, None, None),
    ("vested_options_treatment", "Equity treatment", "text", False, None, None),
    ("unvested_options_treatment", "Equity treatment", "text", False, None, None),
    ("rsu_treatment", "Equity treatment", "text", False, None, None),
    ("psu_treatment", "Equity treatment", "text", False, None, None),
    ("restricted_stock_treatment", "Equity treatment", "text", False, None, None),
    ("espp_treatment", "Equity treatment", "text", False, None, None),
    ("equity_grant_date_distinctions", "Equity treatment", "text", False, None, None),
)

# fixed values: (structure, pattern, weight, note)
STRUCTURE_SIGNATURES: tuple[tuple[str, str, int, str], ...] = (
    ("merger", r"AGREEMENT\s+AND\s+PLAN\s+OF\s+MERGER", 10, "Operative instrument is a merger agreement"),
    ("merger", r"\bMerger\s+Sub\b", 4, "Merger subsidiary present"),
    ("merger", r"\bEffective\s+Time\b", 2, "Merger effective-time construct"),
    ("merger", r"\bSurviving\s+Corporation\b", 3, "Surviving corporation construct"),
    ("merger", r"\bCompany\s+(?:Shareholder|Stockholder)\s+(?:Approval|Meeting)\b", 3, "Shareholder vote mechanic"),
    ("tender_offer", r"\bOffer\s+to\s+Purchase\b", 8, "Offer to purchase"),
    ("tender_offer", r"\bSchedule\s+TO\b", 8, "Schedule TO filing"),
    ("tender_offer", r"\bMinimum\s+(?:Tender\s+)?Condition\b", 6, "Minimum tender condition"),
    ("tender_offer", r"Section\s+251\(h\)", 7, "DGCL 251(h) back-end merger"),
    ("tender_offer", r"\bvalidly\s+tendered\b", 4, "Tender mechanics"),
    ("takeover_offer", r"voluntary\s+public\s+(?:takeover\s+)?offer", 10, "Voluntary public takeover offer"),
    ("takeover_offer", r"\bWpÜG\b|Wertpapiererwerbs", 10, "German Takeover Act (WpÜG)"),
    ("takeover_offer", r"\bBusiness\s+Combination\s+Agreement\b", 7, "Business combination agreement"),
    ("takeover_offer", r"\bacceptance\s+period\b", 6, "Acceptance period"),
    ("takeover_offer", r"\bBaFin\b", 6, "German regulator BaFin"),
    ("takeover_offer", r"\bminimum\s+acceptance\s+(?:threshold|condition)\b", 6, "Minimum acceptance threshold"),
    ("scheme_of_arrangement", r"\bscheme\s+of\s+arrangement\b", 10, "Scheme of arrangement"),
    ("scheme_of_arrangement", r"\bCourt\s+Meeting\b", 6, "Court meeting"),
    ("scheme_of_arrangement", r"\bTakeover\s+Code\b|\bRule\s+2\.7\b", 7, "UK Takeover Code"),
)
MIN_SCORE, MIN_RATIO = 10, 1.5

# fixed values: ordered instrument patterns on an exhibit's head
INSTRUMENTS: tuple[tuple[str, str, str], ...] = (
    ("agreement", r"AGREEMENT\s+AND\s+PLAN\s+OF\s+MERGER|BUSINESS\s+COMBINATION\s+AGREEMENT|TRANSACTION\s+AGREEMENT|SCHEME\s+IMPLEMENTATION\s+(?:AGREEMENT|DEED)|ARRANGEMENT\s+AGREEMENT|OFFER\s+DOCUMENT", "Operative agreement"),
    ("credit-agreement", r"BRIDGE\s+CREDIT\s+AGREEMENT|BRIDGE\s+(?:TERM\s+)?(?:LOAN\s+)?(?:FACILITY\s+)?AGREEMENT|CREDIT\s+AGREEMENT|(?:SENIOR\s+)?FACILIT(?:Y|IES)\s+AGREEMENT|COMMITMENT\s+LETTER|INTERIM\s+FACILIT(?:Y|IES)\s+AGREEMENT", "Financing agreement"),
    ("press-release", r"PRESS\s+RELEASE|FOR\s+IMMEDIATE\s+RELEASE", "Press release"),
    ("governing-documents", r"(?:AMENDED\s+AND\s+RESTATED\s+)?(?:ARTICLES\s+OF\s+INCORPORATION|CERTIFICATE\s+OF\s+INCORPORATION|BY-?LAWS)", "Constitutional documents"),
)
SEC_COVER = r"UNITED\s+STATES\s+SECURITIES\s+AND\s+EXCHANGE\s+COMMISSION|\bFORM\s+(?:8-K|6-K|20-F|S-4)\b.{0,80}\bCURRENT\s+REPORT\b"
EXHIBIT_COVER = r"EXHIBIT\s+([0-9]+\.[0-9]+|[A-Z](?![A-Za-z]))"

# fixed values: ordered region patterns on a page's head
REGIONS: tuple[tuple[str, str, str], ...] = (
    ("index-of-defined-terms", r"^(?:ANNEX\s+[IVX0-9]+\s+)?INDEX\s+OF\s+DEFINED\s+TERMS", "Index of defined terms"),
    ("defined-terms", r"^ANNEX\s+[IVX0-9]+\s+DEFINED\s+TERMS", "Annex of defined terms"),
    ("table-of-contents", r"^TABLE\s+OF\s+CONTENTS", "Table of contents"),
    ("signature", r"^IN\s+WITNESS\s+WHEREOF", "Signature page"),
)

# fixed values: (field, event, default kind, section)
MILESTONES: tuple[tuple[str, str, str, str], ...] = (
    ("agreement_date", "Agreement signed", "fixed", "Signing"),
    ("shareholder_approval_threshold", "Shareholder approval", "conditional", "Approvals and conditions"),
    ("tender_acceptance_threshold", "Tender / acceptance threshold", "conditional", "Approvals and conditions"),
    ("offer_or_acceptance_period", "Offer / acceptance period", "relative", "Approvals and conditions"),
    ("antitrust_approvals", "Antitrust clearance", "conditional", "Approvals and conditions"),
    ("foreign_investment_approvals", "Foreign investment approval", "conditional", "Approvals and conditions"),
    ("other_regulatory_approvals", "Other regulatory approvals", "conditional", "Approvals and conditions"),
    ("no_injunction_condition", "No-injunction condition", "conditional", "Approvals and conditions"),
    ("expected_closing_timing", "Expected closing", "non_binding_estimate", "Closing"),
    ("outside_date", "Initial outside date", "fixed", "Closing"),
    ("extension_conditions", "Outside date extension", "party_election", "Closing"),
    ("cure_periods", "Cure period", "relative", "Termination"),
    ("termination_rights", "Termination rights", "conditional", "Termination"),
    ("fee_tail", "Termination fee tail", "relative", "Termination"),
    ("committed_financing", "Committed financing", "conditional", "Financing"),
    ("bridge_maturity", "Bridge facility maturity", "relative", "Financing"),
    ("financing_conditions", "Financing conditions", "conditional", "Financing"),
)

# fixed values: pricing assumptions; synthetic, never facts of a filing
ASSUMPTIONS = {
    "notional": 4_000_000_000.0,
    "tenor_years": 7.0,
    "issue_date": "2027-03-15",
    "currency": "USD",
    "rate_basis": "swap rate",
    "treasury_rate": 0.0425,
    "swap_rate": 0.0440,
    "issuer_credit_spread": 0.0100,
    "dv01_per_100mm": 65_000.0,
    "base_probability": 0.85,
    "delay_probability": 0.10,
    "failure_probability": 0.05,
    "parallel_move_bps": 25.0,
    "credit_move_bps": 20.0,
    "premium_bps": 15.0,
    "bid_offer_bps": 2.0,
    "credit_dv01_ratio": 1.0,
    "swap_spread_dv01_ratio": 1.0,
}

# fixed values: (model profile, USD per million input tokens, output tokens)
MODEL_PRICES = (("standard", 5.00, 25.00), ("economy", 2.00, 10.00))


def field_registry(spark: SparkSession) -> DataFrame:
    """The registry as a dimension; ``ordinal`` is its order."""
    order = {c: i for i, c in enumerate(CATEGORY_ORDER)}
    rows = [(i, n, c, order[c], t, k, 0.75 if k else 0.60, list(s) if s else None, list(e) if e else None) for i, (n, c, t, k, s, e) in enumerate(FIELDS)]
    return spark.createDataFrame(rows, "ordinal int, field_name string, category string, category_rank int, value_kind string, is_critical boolean, threshold double, applies_to array<string>, enum_values array<string>")


def structure_signatures(spark: SparkSession) -> DataFrame:
    rows = [(i, *r) for i, r in enumerate(STRUCTURE_SIGNATURES)]
    return spark.createDataFrame(rows, "ordinal int, structure string, pattern string, weight int, note string")


def milestones(spark: SparkSession) -> DataFrame:
    rank = {s: i for i, s in enumerate(SECTION_ORDER)}
    return spark.createDataFrame([(i, f, e, k, s, rank[s]) for i, (f, e, k, s) in enumerate(MILESTONES)], "ordinal int, field_name string, event string, default_kind string, timeline_section string, section_rank int")


def layer_scope(spark: SparkSession) -> DataFrame:
    """(layer, category) pairs that extraction reads."""
    return spark.createDataFrame([(layer, c) for layer in EXTRACTABLE_LAYERS for c in LAYER_CATEGORIES.get(layer, CATEGORY_ORDER)], "layer_id string, category string")


def model_prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MODEL_PRICES), "model_id string, usd_in double, usd_out double")
