"""Fixed word lists, phrase scales and topic families, and the proxy lists that fit generated text."""

from __future__ import annotations

# They define the scores, so they are stated as they must be.
CRITICISM_HARD = (
    "failed", "failure", "failing", "has not been implemented", "have not been implemented", "not implemented",
    "non-implementation", "backsliding", "backslide", "deterioration", "deteriorated", "regressed",
    "regression", "stagnation", "stagnated", "standstill", "violation", "violations", "breach", "breached",
    "impunity", "obstruction", "obstructed", "interference", "inadequate", "insufficient", "insufficiently",
    "absence of", "lack of", "deficiencies", "deficiency", "shortcomings", "shortcoming", "incomplete",
    "incompleteness", "politicisation", "politicization", "state capture", "systemic", "selective",
)

CRITICISM_SOFT = (
    "concern", "concerns", "concerning", "worrying", "serious concern", "challenge", "challenges",
    "challenging", "difficult", "difficulty", "delayed", "delay", "delays", "slow", "stalled", "limited",
    "limiting", "limited progress", "limited results", "persisting", "persistent", "outstanding", "remain",
    "remains", "problem", "problems", "problematic", "issue", "issues", "risk", "risks", "need", "needs",
    "needed", "require", "required", "requires", "must be", "needs to be", "has yet to", "have yet to",
)

REFORM_HARD = (
    "adopted", "adopting", "enacted", "enacted into law", "ratified", "transposed", "approved",
    "entered into force", "implemented", "implementing", "completed", "completion", "finalised", "finalized",
    "operationalised", "operationalized", "established", "establishing", "set up", "created", "launched",
    "achieved", "achievement", "achieves", "accelerated", "delivered", "consolidated", "sustained progress",
    "tangible results", "track record",
)

REFORM_SOFT = (
    "progress", "progressed", "advanced", "advances", "some progress", "good progress", "further progress",
    "improved", "improving", "improvement", "strengthened", "strengthening", "enhanced", "enhance",
    "effective", "effectively", "efficient", "efficiency", "functional", "functioning", "positive",
    "positively", "steps taken", "efforts", "initiated", "underway", "ongoing", "in progress",
    "working towards", "moving towards", "seeking to", "success", "successful", "successfully", "well", "good",
    "better",
)

TOPICS_FIVE = {
    "judiciary_rule_of_law": (
        "judicial", "judiciary", "court", "courts", "judge", "judges", "prosecution", "prosecutor",
        "rule of law", "case backlog", "independence", "legal certainty", "enforcement of decisions",
    ),
    "corruption_anti_corruption": (
        "corruption", "corrupt", "fraud", "bribery", "anti-corruption", "integrity", "transparency",
        "asset declaration", "conflict of interest",
    ),
    "public_administration_governance": (
        "public administration", "administration", "civil service", "governance", "institutional capacity",
        "coordination", "implementation capacity", "policy implementation",
    ),
    "political_functioning": (
        "political", "parliament", "assembly", "government", "opposition", "polarisation", "cooperation",
        "dialogue", "legislative", "elections",
    ),
    "economy_market": (
        "economic", "economy", "market", "growth", "inflation", "employment", "investment",
        "business environment", "competitiveness",
    ),
}

TOPICS_FOUR = {
    "judiciary": (
        "court", "courts", "judicial", "judge", "judges", "judgment", "judgement", "prosecution", "prosecutor",
        "prosecutors", "trial", "trials", "justice", "tribunal", "verdict", "appeal", "appeals", "conviction",
        "acquittal", "magistrate", "indictment", "vetting", "supreme court", "constitutional court",
        "rule of law",
    ),
    "corruption": (
        "corruption", "corrupt", "fraud", "fraudulent", "bribery", "bribe", "transparency", "integrity",
        "embezzlement", "money laundering", "conflict of interest", "anticorruption", "anti-corruption",
        "illicit", "misconduct", "nepotism", "patronage", "accountability", "asset declaration",
        "public procurement",
    ),
    "governance": (
        "administration", "governance", "public sector", "civil service", "institution", "institutional",
        "parliament", "parliamentary", "executive", "legislation", "legislative", "regulation", "regulatory",
        "ministry", "ministries", "capacity", "decentralisation", "decentralization", "local government",
        "public administration", "ombudsman",
    ),
    "economy": (
        "economic", "economy", "market", "growth", "inflation", "employment", "trade", "fiscal", "budget",
        "investment", "gdp", "revenue", "privatisation", "privatization", "competition", "financial",
        "banking", "tax", "taxation", "unemployment", "poverty", "social",
    ),
}
TOKEN_REFORM = ("progress", "implemented", "improved", "adopted", "alignment", "positive", "strengthened", "established", "functional", "advanced")
TOKEN_CRITICISM = ("concern", "weak", "lack", "limited", "backsliding", "insufficient", "delay", "outstanding", "pressure", "interference")

PROGRESS_SCALE = {"backsliding": -3, "no progress": -2, "limited progress": -1, "some progress": 1, "good progress": 2, "very good progress": 3}

KEYWORD_GROUPS = {
    "rule_of_law": ("rule of law", "judiciary", "anti-corruption", "corruption", "organised crime", "fundamental rights"),
    "democracy": ("democracy", "parliament", "elections", "political parties", "civil society", "freedom of expression"),
    "economy": ("economic", "growth", "investment", "competitiveness", "fiscal", "budget", "privatisation"),
    "serbia_kosovo": ("serbia", "normalisation", "dialogue", "relations"),
    "ukraine_russia": ("ukraine", "russia", "war", "sanctions", "aggression"),
}
DRIVERS = {
    "dialogue_normalisation": ("normalisation", "dialogue", "relations", "agreement", "roadmap"),
    "sanctions_cfsp": ("sanctions", "restrictive measures", "foreign policy", "cfsp", "russia", "ukraine"),
    "rule_of_law": ("rule of law", "judiciary", "corruption", "anti-corruption", "organised crime"),
    "democracy_governance": ("elections", "parliament", "democracy", "public administration", "civil society"),
    "economy": ("economic", "fiscal", "investment", "market", "competitiveness"),
}

ACTION_PHRASES = ("remains limited", "has been established", "is in place", "has adopted", "no progress", "some progress", "well advanced", "moderately prepared", "early stage", "is operational")
INTENTION_PHRASES = ("should ensure", "is encouraged to", "needs to", "should be", "is invited to", "must prioritize", "plans to", "aims at")
ANCHORS = {
    "fundamentals": (r"2\.1\.?\s*Functioning", r"2\.2\.?\s*Rule of law", r"Cluster 1", r"Chapter 23", r"Chapter 24"),
    "economy": (r"3\.?\s*Economic Development", r"2\.3\.?\s*Economic Development"),
    "internal_market": (r"Cluster 2", r"Chapter 1\s", r"Chapter 3\s"),
}
ABBREVIATIONS = ("no", "viz", "i.e", "e.g", "jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec", "art", "vol")
MOJIBAKE = (("â€™", "'"), ("â€œ", '"'), ("â€\u009d", '"'), ("â€“", "-"), ("\xad", ""))

# Proxy lists of the same shape (nested entries, phrases) whose terms occur in the generated documents.
PROXY_HARD = ("that", "then", "the", "of the")
PROXY_SOFT = ("with", "with the", "ing", "tion", "is")
PROXY_REFORM_HARD = ("for", "by the", "and")
PROXY_REFORM_SOFT = ("was", "in the", "on")
PROXY_TOPICS = {
    "law": ("thst", "ofthe", "with the"),
    "market": ("tionble", "of the", "erre"),
    "admin": ("ingre", "haaner", "on the"),
    "politics": ("esten", "andthe", "inor"),
    "economy": ("oned", "ouer", "ndre"),
}
PROXY_SCALE = {"that": -3, "with the": -2, "the": -1, "of the": 1, "in": 2, "on the": 3}
PROXY_GROUPS = {"law": ("the", "of the"), "democracy": ("and", "ing"), "economy": ("tion", "er")}
PROXY_TOKENS = ("the", "of", "that", "and", "with")
PROXY_ACTIONS = ("that the", "of the", "on the")
PROXY_INTENTIONS = ("with", "and")


def criticism_words() -> tuple[str, ...]:
    """Both criticism lists as one set, in order."""
    return tuple(sorted({*CRITICISM_HARD, *CRITICISM_SOFT}))


def reform_words() -> tuple[str, ...]:
    """Both reform lists as one set, in order."""
    return tuple(sorted({*REFORM_HARD, *REFORM_SOFT}))
