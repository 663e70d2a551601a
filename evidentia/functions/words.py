"""Fixed word lists, patterns and tables of the text operators."""

from __future__ import annotations

# Words that terms leave out.
STOPWORDS = frozenset("a an and are because by for from how in is it of on or says that the this to with what why".split())
SEMANTIC_STOPWORDS = frozenset(
    "able become becomes became do does did doing get gets got give gives given make makes made provide provides provided show shows showing use uses used using".split()
)
ALL_STOPWORDS = STOPWORDS | SEMANTIC_STOPWORDS

# Causal words by direction.
POSITIVE_CAUSAL = frozenset("cause causes caused create creates created drive drives fuel fuels increase increases lead leads result results worsen worsens".split())
NEGATIVE_CAUSAL = frozenset(
    "avoid avoids decrease decreases defuse defuses lower lowers mitigate mitigates prevent prevents reduce reduces stabilize stabilizes stop stops".split()
)

# Cues of the claim and card relationship.
NEGATION_CUES = frozenset("cannot doesn doesn't fail fails failed false no not prevent prevents reduce reduces wrong".split())
POSITIVE_DIRECTION = frozenset("causes creates encourage encourages guarantee guarantees grow grows increase increases solve solves strengthen strengthens".split())
NEGATIVE_DIRECTION = frozenset("delete deletes destroy destroys lower lowers prevent prevents reduce reduces undermine undermines".split())
NON_UNIQUE_CUES = ("already", "currently", "existing", "multi-billion", "non-unique", "nonunique", "status quo", "squo", "today")
MITIGATION_CUES = ("ban", "bans", "check", "checks", "limit", "limits", "lower", "lowers", "mitigate", "mitigates", "prevent", "prevents", "prohibit", "prohibits", "reduce", "reduces")
INDICT_CUES = ("assumes", "bad evidence", "flawed", "indict", "methodology", "no evidence", "overstates", "underfunded", "wrong")
TURN_CUES = ("backfire", "backfires", "helps our side", "impact turn", "link turn", "turns the argument")
CIRCUMVENTION_CUES = ("bypass", "bypasses", "circumvent", "circumvents", "despite", "evade", "evades", "loophole", "loopholes", "unchecked")

# Equivalences between concepts.
GENERIC_EQUIVALENCES = {
    "approval": "authorization", "authorization": "approval", "baseline": "standard", "baselines": "standard", "congressional": "congress", "diplomatic": "diplomacy",
    "enforcement": "regulation", "escalates": "escalation", "escalat": "escalation", "executive": "president", "fragmented": "vary", "legislature": "congress",
    "lawmakers": "congress", "oversight": "approval", "presidential": "president", "rules": "regulation", "settlement": "diplomacy", "uniformity": "standard",
}
RELATION_EQUIVALENCES = {
    "PREVENTS": "block check constrain prevent restrain restrict slow stop", "CAUSES": "cause create drive fuel lead produce", "INCREASES": "escalation expand increase worsen",
    "DECREASES": "decrease lower mitigate reduce", "ENABLES": "allow enable empower", "UNDERMINES": "delete destroy harm undermine", "SOLVES": "fix resolve solve",
    "PROTECTS": "preserve protect safeguard", "DETERS": "deter discourage",
}
RELATION_CONTEXTUAL = {
    "PREVENTS": "buffer buffers circumvent circumvents unchecked", "CAUSES": "incentive trigger", "INCREASES": "embolden emboldens", "DECREASES": "slow",
    "ENABLES": "loophole loopholes", "UNDERMINES": "erode erodes",
}
SLOT_EQUIVALENCES = {
    "approval": "authorization consent permission", "authorization": "approval consent permission", "congress": "congressional legislature lawmakers",
    "congressional": "congress legislature lawmakers", "conflict": "exchange war", "diplomacy": "diplomatic negotiation negotiations talks",
    "escalate": "escalates escalating escalation escalatory", "nuclear": "atomic nuc", "president": "presidential", "trump": "trump",
}
SLOT_CONTEXTUAL = {
    "approval": "check checks oversight review", "authorization": "check checks oversight review", "congress": "senate", "conflict": "crisis",
    "diplomacy": "cooperation leverage settlement", "escalate": "attack attacks launch strike strikes", "nuclear": "deterrence strategic",
    "president": "commander executive leader", "trump": "commander executive president presidential",
}
SLOT_ALIASES = {
    "approval": "approval", "authorization": "authorization", "congress": "congress", "congressional": "congress", "conflict": "conflict", "diplomatic": "diplomacy",
    "diplomacy": "diplomacy", "escalate": "escalate", "escalates": "escalate", "escalating": "escalate", "escalation": "escalate", "nuclear": "nuclear", "nuc": "nuclear",
    "president": "president", "presidential": "president", "restrains": "restrain", "restraining": "restrain", "restricts": "restrict", "restricting": "restrict",
    "stops": "stop", "stopping": "stop", "prevents": "prevent", "preventing": "prevent",
}
SOURCE_WEIGHTS = {"tag": 0.95, "highlights": 1.0, "body": 0.9, "text": 1.0, "metadata": 0.85, "section": 0.65, "card_name": 0.65, "citation": 0.2}

# Claim relations with the verbs that name them, in order of precedence.
RELATION_PATTERNS = (
    ("PREVENTS", r"prevents?|stops?|blocks?|constrains?|restricts?"), ("CAUSES", r"causes?|creates?|drives?|fuels?|leads?\s+to|results?\s+in|guarantees?"),
    ("INCREASES", r"increases?|escalates?|expands?|worsens?"), ("DECREASES", r"decreases?|reduces?|lowers?|mitigates?"), ("ENABLES", r"enables?|allows?|empowers?"),
    ("UNDERMINES", r"undermines?|deletes?|destroys?|harms?|hurts?"), ("SOLVES", r"solves?|fixes?|resolves?"), ("PROTECTS", r"protects?|preserves?|safeguards?"),
    ("DETERS", r"deters?|discourages?"),
)
CAUSE_VERBS = r"causes?|creates?|drives?|fuels?|leads?\s+to|results?\s+in|increases?|reduces?|lowers?|prevents?|stops?|defuses?|mitigates?|stabilizes?|worsens?"
CLAUSE_WORDS = r"causes?|creates?|drives?|fuels?|leads?|results?|increases?|reduces?|lowers?|prevents?|stops?|defuses?|mitigates?|stabilizes?|worsens?|because"
PROBE_VERBS = r"causes?|creates?|deletes?|destroys?|drives?|fuels?|guarantees?|harms?|hurts?|increases?|leads?\s+to|lowers?|prevents?|reduces?|solves?|strengthens?|undermines?|worsens?"
OPPOSITES = (
    ("causes?", "does not cause"), ("creates?", "does not create"), ("deletes?", "preserves improves"), ("destroys?", "preserves improves"), ("escalates?", "de-escalates stabilizes"),
    ("guarantees?", "does not guarantee"), ("harms?", "helps protects"), ("hurts?", "helps protects"), ("increases?", "decreases reduces"), ("lowers?", "raises increases"),
    ("prevents?", "allows enables"), ("reduces?", "increases restores"), ("solves?", "fails to solve"), ("strengthens?", "weakens undermines"), ("undermines?", "strengthens protects"),
    ("worsens?", "improves mitigates"),
)
