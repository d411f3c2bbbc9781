"""Fixed values of the funnel analysis: stages, pain points, signal words and texts."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Stage:
    name: str
    priority: int
    include: tuple[str, ...]
    exclude: tuple[str, ...] = ()


@dataclass(frozen=True)
class Pain:
    code: str
    name: str
    severity: int
    stages: tuple[str, ...]
    keywords: tuple[str, ...]
    response: str


UNCLEAR = "Unclear / Cross-Stage"
UNCLEAR_REASON = "No strong keyword evidence; topic appears broad or mixed"

# Stages by priority, with the words that speak for them.
STAGES = (
    Stage("Awareness", 1, ("what car", "which car", "new car", "used car", "guide", "research", "beginner", "best", "recommend", "need a car", "first car", "buying guide", "worth it", "should i buy")),
    Stage("Consideration", 2, ("compare", "comparison", "versus", "vs", "hybrid", "electric", "ev", "suv", "sedan", "reliability", "features", "resale", "warranty", "maintenance", "driving experience")),
    Stage("Evaluation", 3, ("total cost", "ownership", "credit", "loan", "finance", "payment", "apr", "maintenance cost", "fuel efficiency", "safety", "test drive", "long term", "battery", "tax credit", "incentive")),
    Stage("Purchase", 4, ("dealer", "dealership", "markup", "msrp", "market adjustment", "doc fee", "allocation", "wait list", "deposit", "negotiat", "purchase", "bought", "on the lot", "inventory", "delivery", "out the door")),
    Stage("Ownership", 5, ("owned", "ownership experience", "service", "repair", "problem", "issue", "warranty claim", "after buying", "over time", "long-term", "maintenance", "battery replacement")),
)

# Pain points with severity, stages that hint at them, words, and the suggested response.
PAINS = (
    Pain("price_markup", "Price Markup / Overpricing", 5, ("Purchase", "Evaluation"), ("markup", "market adjustment", "over msrp", "adm", "overpriced", "msrp", "doc fee"), "Add transparent pricing, MSRP guidance, and anti-markup education"),
    Pain("dealer_friction", "Dealer Friction / Trust Issues", 4, ("Purchase",), ("dealer", "dealership", "salesperson", "lied", "pressure", "bait", "finance office", "upsell"), "Create dealer-playbook content and negotiation guidance"),
    Pain("inventory_wait", "Inventory / Wait-Time Constraints", 4, ("Purchase", "Evaluation"), ("inventory", "allocation", "wait list", "deposit", "backorder", "delivery", "on the lot", "availability"), "Improve availability visibility, order tracking, and substitute recommendations"),
    Pain("financing_affordability", "Financing / Affordability", 4, ("Evaluation", "Purchase"), ("loan", "apr", "payment", "monthly payment", "credit", "finance", "lease", "afford"), "Add payment calculators, APR explainers, and lease-vs-buy tools"),
    Pain("tco_uncertainty", "Total Cost / Incentive Uncertainty", 3, ("Evaluation",), ("tax credit", "incentive", "total cost", "ownership cost", "fuel savings", "insurance", "depreciation"), "Provide incentive explainers and cost-of-ownership calculators"),
    Pain("charging_access", "Charging Access / Infrastructure", 4, ("Evaluation", "Ownership"), ("charger", "charging", "supercharger", "range", "apartment", "garage", "240v", "fast charging"), "Offer charging eligibility guidance, apartment/home charging education, and range-fit tools"),
    Pain("reliability_risk", "Reliability / Maintenance Risk", 4, ("Consideration", "Ownership", "Evaluation"), ("reliability", "reliable", "maintenance", "repair", "issue", "problem", "warranty", "battery replacement"), "Strengthen long-term reliability proof, warranty clarity, and maintenance education"),
    Pain("feature_fit", "Feature / Fit Tradeoff", 3, ("Consideration",), ("interior", "comfort", "safety", "cargo", "space", "awd", "feature", "trim", "visibility"), "Create trim-level comparison and use-case-based fit guidance"),
    Pain("model_confusion", "Comparison Overload / Decision Complexity", 3, ("Awareness", "Consideration"), ("compare", "versus", "vs", "narrowed down", "which should i buy", "decide", "between"), "Build guided comparison flows and shortlist recommendation tools"),
)
GENERAL = Pain("general_complexity", "General Decision Complexity", 2, (), (), "Review manually and consider adding a more specific pain-point rule")

# Words of the two signals, of the tokenizer's stop list and of the signal snippets.
NEGATIVE = (
    "problem", "issue", "concern", "worry", "worried", "bad", "hard", "difficult", "friction", "expensive", "overpriced", "markup", "delay",
    "limited", "confusing", "uncertain", "lied", "pressure", "regret", "risk", "stuck", "cannot", "can't", "worse", "unavailable",
)
QUESTION = ("should", "which", "what", "worth", "how", "can i", "do i", "is it", "would", "recommend")
STOP = tuple(
    "the and for with that this from they have will their about into just like what your when which were them than then would there also more really "
    "because while could should over most some much very only such does been being through after before where topic users discussion explores including "
    "focus vehicle vehicles cars car".split()
)
SNIPPETS = r"\b(?:msrp|markup|dealer|dealership|loan|credit|reliability|maintenance|hybrid|ev|tax credit|wait list|inventory)\b"

# Texts by stage.
ROLES = {
    "Awareness": "Top-of-funnel demand formation",
    "Consideration": "Mid-funnel option narrowing",
    "Evaluation": "Decision-quality and economics validation",
    "Purchase": "Conversion friction and transaction execution",
    "Ownership": "Post-purchase retention and advocacy risk",
    UNCLEAR: "Mixed signal bucket",
}
ACTIONS = {
    "Awareness": "Create top-of-funnel explainers, buyer guides, and category entry content",
    "Consideration": "Build comparison pages and feature/value differentiation messaging",
    "Evaluation": "Add TCO calculators, financing FAQs, and incentive estimators",
    "Purchase": "Improve price transparency, inventory visibility, and negotiation support",
    "Ownership": "Use after-sales service messaging and lifecycle support content",
}
ACTION_OTHER = "Review manually and refine stage taxonomy"
IMPLICATIONS = {
    "Awareness": "Invest in educational content and entry-level segmentation; strongest cues: ",
    "Consideration": "Provide side-by-side comparison tools and clearer differentiation; strongest cues: ",
    "Evaluation": "Support calculators, financing guidance, and incentive explainers; strongest cues: ",
    "Purchase": "Reduce conversion leakage by addressing price transparency and dealer friction; strongest cues: ",
    "Ownership": "Strengthen retention through service communication and cost-of-ownership education; strongest cues: ",
}
FOCUS = {
    "Purchase": "Reduce conversion leakage by addressing ",
    "Evaluation": "Improve economic proof and decision support around ",
    "Consideration": "Clarify comparison and fit tradeoffs around ",
    "Ownership": "Strengthen retention messaging and support around ",
}
FOCUS_OTHER = "Improve top-of-funnel education around "

# Texts by words, first match wins: (words, text).
FRICTION = {
    "Awareness": ((), "Users need category education, trusted starting points, and simpler option framing"),
    "Consideration": (
        ("reliability", "maintenance"),
        "Shortlist decisions are constrained by perceived reliability and ownership tradeoffs",
        "Users struggle to compare alternatives across too many overlapping attributes",
    ),
    "Evaluation": (("loan", "payment", "credit"), "Economic feasibility and financing readiness are key blockers", "Users need proof on total cost, incentives, and long-term fit"),
    "Purchase": ((), "Dealer friction, markups, low inventory, and negotiation complexity block conversion"),
    "Ownership": ((), "Post-purchase satisfaction depends on service, maintenance, and long-run cost clarity"),
}
FRICTION_OTHER = "Topic spans multiple stages and likely needs manual interpretation"
NEEDS = (
    (("compare", "vs", "versus"), "Customer needs comparative clarity across options"),
    (("loan", "payment", "credit", "apr"), "Customer needs affordability and financing clarity"),
    (("dealer", "markup", "msrp", "inventory"), "Customer needs transparent transaction conditions"),
    (("reliability", "maintenance", "service", "repair"), "Customer needs confidence in long-term ownership outcomes"),
)
NEED_OTHER = "Customer needs clearer decision support"
BARRIERS = (
    (("markup", "market adjustment"), "Excess dealer markup"),
    (("wait list", "allocation", "inventory"), "Limited supply / availability"),
    (("loan", "credit", "payment"), "Financing uncertainty"),
    (("reliability", "maintenance"), "Performance or ownership risk concerns"),
)
BARRIER_OTHER = "General decision complexity"
PRIORITIES = ((500, "Critical intervention opportunity"), (150, "High-priority friction"), (50, "Meaningful improvement area"))
PRIORITY_OTHER = "Secondary issue"
