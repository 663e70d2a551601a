"""Claims, commands, probes, claim and card relationships, slot coverage, and the two lanes."""

from __future__ import annotations

from evidentia.functions import text as T
from evidentia.functions import words as W
from evidentia.functions.dialect import Dialect, Pipe

from evidentia.sources.adapters import cards

# ---- structured claims ----

ACTOR = r"[A-Z][A-Za-z0-9'’-]*(?:\s+[A-Z][A-Za-z0-9'’-]*)?|presidents?|executives?|congress|courts?|military|leaders?"
FROM_ACTION = rf"(?i)^({ACTOR})\s+from\s+([A-Za-z'’-]+)\s+(.+)$"
ACTOR_ACTION = rf"(?i)^({ACTOR})\s+([A-Za-z'’-]+(?:ing|e|es|s)?)\s+(.+)$"
RELATION = r"(?is)^(.*?)\b(" + "|".join(x for _, x in W.RELATION_PATTERNS) + r")\b(.*)$"
IRREGULAR = {"escalating": "escalate", "deescalating": "de-escalate", "using": "use", "striking": "strike", "launching": "launch", "checking": "check"}


def normal_action(d: Dialect, x: str) -> str:
    u = d.trim(f"lower({x})", " .")
    irregular = " ".join(f"when {u} = '{k}' then '{v}'" for k, v in IRREGULAR.items())
    cut = lambda s, n: f"when {d.ends(u, d.lit(s))} and length({u}) > {n} then left({u}, length({u}) - {len(s)})"
    return f"(case {irregular} {cut('ing', 5)} {cut('es', 4)} {cut('s', 3)} else {u} end)"


def gerund(d: Dialect, x: str) -> str:
    return f"(case when {x} = '' then '' when {d.ends(x, d.lit('e'))} then left({x}, length({x}) - 1) || 'ing' else {x} || 'ing' end)"


def structured_claim(p: Pipe, name: str, source: str, x: str = "text") -> str:
    """``source`` with raw, subject, relation, relation_text, effect, target_actor, target_action, target_object, slot_confidence, claim_confidence, has_structure, display_effect."""
    d = p.d
    p.columns(f"{name}_1", source, raw=d.trim(d.squeeze(x), " ."))
    found = d.matches("raw", RELATION)
    p.columns(
        f"{name}_2",
        f"{name}_1",
        subject=f"case when {found} then {d.trim(d.extract('raw', RELATION, 1), ' ,.;:')} else raw end",
        relation_text=f"case when {found} then {d.extract('raw', RELATION, 2)} else '' end",
        effect=f"case when {found} then {d.trim(d.extract('raw', RELATION, 3), ' ,.;:')} else '' end",
    )
    kinds = " ".join(f"when {d.matches('lower(relation_text)', f'^(?:{x})$')} then '{r}'" for r, x in W.RELATION_PATTERNS)
    p.columns(f"{name}_3", f"{name}_2", relation=f"case {kinds} else 'UNKNOWN' end", eff=d.trim("effect", " ."))
    f1, f2 = d.matches("eff", FROM_ACTION), d.matches("eff", ACTOR_ACTION)
    pick = lambda g, other: f"case when {f1} then {d.extract('eff', FROM_ACTION, g)} when {f2} then {d.extract('eff', ACTOR_ACTION, g)} else {other} end"
    p.columns(f"{name}_4", f"{name}_3", target_actor=pick(1, "''"), act=pick(2, "''"), obj=pick(3, "eff"), slot_confidence=f"case when {f1} then 0.92e0 when {f2} then 0.72e0 when eff <> '' then 0.42e0 else 0e0 end")
    p.columns(
        f"{name}_5",
        f"{name}_4",
        target_action=normal_action(d, "act"),
        target_object=d.trim("obj", " ."),
        claim_confidence=f"case when relation = 'UNKNOWN' then case when raw <> '' then 0.2e0 else 0e0 end else {d.round('least(1e0, 0.35e0 + case when subject <> ' + chr(39) * 2 + ' then 0.2e0 else 0e0 end + case when effect <> ' + chr(39) * 2 + ' then 0.2e0 else 0e0 end + least(0.25e0, slot_confidence * 0.25e0))')} end",
    )
    return p.columns(
        name,
        f"{name}_5",
        has_structure="relation <> 'UNKNOWN' and claim_confidence >= 0.55e0",
        display_effect=f"case when target_actor <> '' and target_action <> '' and target_object <> '' then target_actor || ' ' || {gerund(d, 'target_action')} || ' ' || target_object else effect end",
    )


# ---- commands ----

COMMAND = r"(?i)^\s*([a-z-]+)>\s*(.+)$"
SAYS = r"(?i)^\s*(?:opponent|opponents|they|other team)\s+(?:says?|argues?|claims?|contends?)\s+"
INTENTS = {"answer": "answer", "their": "their_evidence", "compare": "compare", "turn": "turn", "indict": "indict", "search": "search"}


def debate_query(p: Pipe, name: str, source: str, x: str = "text") -> str:
    """``source`` with command, debate_claim (null without an opponent), semantic_query, debate_intent, perspective."""
    d = p.d
    p.columns(f"{name}_1", source, dq=d.squeeze(x))
    p.columns(f"{name}_2", f"{name}_1", command=f"case when {d.matches('dq', COMMAND)} then lower({d.extract('dq', COMMAND, 1)}) else '' end", body_q=f"case when {d.matches('dq', COMMAND)} then trim({d.extract('dq', COMMAND, 2)}) else dq end")
    p.columns(f"{name}_3", f"{name}_2", debate_claim=f"case when {d.matches('body_q', SAYS)} then {d.trim(d.replace('body_q', SAYS, ''), ' .')} end")
    intents = " ".join(f"when '{k}' then '{v}'" for k, v in INTENTS.items())
    p.columns(f"{name}_4", f"{name}_3", debate_intent=f"case command {intents} else case when coalesce(debate_claim, '') <> '' then 'answer' else 'search' end end", semantic_query="case when coalesce(debate_claim, '') <> '' then debate_claim else body_q end")
    return p.columns(name, f"{name}_4", perspective="case when debate_intent in ('answer', 'turn', 'indict', 'their_evidence') then 'opponent' when debate_intent = 'compare' then 'both' when coalesce(debate_claim, '') <> '' then 'opponent' else 'neutral' end")


# ---- probes ----


def _unique_terms(d: Dialect, x: str) -> str:
    return d.let(T.terms(d, x), "tt", d.filter(d.distinct_in_order(d.find_all(f"lower({x})", T.TOKEN.replace("A-Z", ""))), "t", d.has("tt", "t")))


def _words(d: Dialect, xs: str, n: int) -> str:
    return d.slice(xs, "1", str(n))


def counterclaim(d: Dialect, x: str) -> str:
    out = x
    for verb, by in W.OPPOSITES:
        out = d.replace(out, rf"(?i)\b{verb}\b", by)
    return f"(case when {d.matches(x, '(?i)' + chr(92) + 'b(?:' + '|'.join(v for v, _ in W.OPPOSITES) + ')' + chr(92) + 'b')} then {d.squeeze(out)} else 'not ' || {x} end)"


def probes(p: Pipe, name: str, source: str) -> str:
    """(query_id, ord, kind, probe, channel): retrieval probes of ``source`` (query_id, text, debate_intent), first of equal texts kept."""
    d = p.d
    structured_claim(p, f"{name}_c", source)
    verb = rf"(?is)^(.*?)\b(?:{W.PROBE_VERBS})\b(.*)$"
    has = d.matches("raw", verb)
    p.columns(f"{name}_w", f"{name}_c", w=_unique_terms(d, "raw"))
    half = f"cast(greatest(1, floor({d.size('w')} / 2.0)) as int)"
    p.columns(
        f"{name}_x",
        f"{name}_w",
        sub=f"coalesce(nullif(case when {has} then {d.trim(d.extract('raw', verb, 1), ' ,.;:')} else {d.join(d.slice('w', '1', half), ' ')} end, ''), raw)",
        outc=f"coalesce(nullif(case when {has} then {d.trim(d.extract('raw', verb, 2), ' ,.;:')} else {d.join(d.slice('w', f'{half} + 1', f'greatest(0, {d.size(chr(119))} - {half})'), ' ')} end, ''), raw)",
    )
    p.columns(f"{name}_y", f"{name}_x", st=_unique_terms(d, "sub"), ot=_unique_terms(d, "outc"))
    congress = rf"(case when {d.contains('lower(subject)', d.lit('congress'))} and not {d.contains('lower(subject)', d.lit('congressional'))} then {d.replace('subject', '(?i)' + chr(92) + 'bCongress' + chr(92) + 'b', 'Congressional')} else subject end)"
    possessive = f"(case when target_actor = '' then 'their' when {d.ends('lower(target_actor)', d.lit('s'))} then target_actor || {d.lit(chr(39))} else target_actor || {d.lit(chr(39) + 's')} end)"
    p.columns(f"{name}_z", f"{name}_y", cs=congress, ap=possessive, ger=gerund(d, "target_action"), pe="coalesce(nullif(effect, ''), display_effect)", ge="coalesce(nullif(display_effect, ''), effect)", rt="coalesce(nullif(relation_text, ''), 'causes')", counter=counterclaim(d, "text"))
    say = lambda *xs: " || ".join(x if x.isidentifier() else d.lit(x) for x in xs)
    families = {
        "PREVENTS": (
            ("denial", say("cs", " does not prevent ", "pe")), ("turn", say("cs", " increases or enables ", "display_effect")), ("circumvention", say("target_actor", " can ", "target_action", " ", "target_object", " despite ", "cs")),
            ("no_link", say("cs", " does not meaningfully constrain ", "ap", " ability to ", "target_action", " ", "target_object")), ("non_unique", say("target_actor", " is already constrained from ", "ger", " ", "target_object", " independently of ", "cs")),
            ("alt_cause", say("other institutional or strategic constraints determine ", "ap", " ability to ", "target_action", " ", "target_object", " rather than ", "cs")),
            ("mitigation", say("cs", " only partially reduces ", "ap", " ability to ", "target_action", " ", "target_object")),
            ("indict", say("claims that ", "cs", " restrains presidential ", "target_object", " overstate Congress's ability to constrain presidential action")),
            ("empirical_denial", say("congressional authorization or oversight has failed to prevent presidential military escalation")),
        ),
        "CAUSES": (
            ("denial", say("subject", " does not cause ", "display_effect")), ("turn", say("subject", " reduces or prevents ", "display_effect")), ("alt_cause", say("other causes produce ", "display_effect", " rather than ", "subject")),
            ("non_unique", say("display_effect", " already occurs independently of ", "subject")), ("mitigation", say("subject", " has only a small effect on ", "display_effect")),
            ("indict", say("claims that ", "subject", " causes ", "display_effect", " lack evidence and overstate the causal relationship")),
        ),
        "UNDERMINES": (
            ("denial", say("subject", " does not undermine ", "display_effect")), ("turn", say("subject", " protects or strengthens ", "display_effect")), ("no_link", say("subject", " does not determine ", "display_effect")),
            ("alt_cause", say("other factors undermine ", "display_effect", " rather than ", "subject")), ("mitigation", say("subject", " only partially affects ", "display_effect")),
            ("indict", say("claims that ", "subject", " undermines ", "display_effect", " lack evidence and overstate the causal relationship")),
        ),
        "OTHER": (
            ("denial", say("subject", " does not ", "rt", " ", "ge")), ("no_link", say("subject", " does not determine ", "ge")), ("alt_cause", say("other factors determine ", "ge", " rather than ", "subject")),
            ("mitigation", say("subject", " only partially affects ", "ge")), ("indict", say("claims about ", "subject", " and ", "ge", " lack evidence and overstate the relationship")),
        ),
        "PLAIN": (
            ("counterclaim", "counter"), ("turn", say("sub", " improves ", "outc", " and creates reasons the claimed harm is reversed")), ("no_link", say("sub", " does not determine ", "outc", " and the claimed causal link is weak")),
            ("non_unique", say("outc", " already exists independently of ", "sub")), ("mitigation", say("sub", " mitigates reduces or prevents the claimed harm to ", "outc")),
            ("indict", say("claims that ", "sub", " causes ", "outc", " lack evidence and overstate the causal relationship")),
        ),
    }
    family = "case when not has_structure then 'PLAIN' when relation = 'PREVENTS' then 'PREVENTS' when relation in ('CAUSES', 'INCREASES', 'ENABLES') then 'CAUSES' when relation in ('UNDERMINES', 'DECREASES') then 'UNDERMINES' else 'OTHER' end"
    lexical = [d.join(_words(d, "w", 8), " "), d.join(d.concat(_words(d, "st", 4), _words(d, "ot", 4)), " "), d.join(d.concat(d.tail("st", 3), _words(d, "ot", 4)), " ")]
    mechanism = d.join(_words(d, d.concat("st", d.filter("ot", "t", f"not {d.has('st', 't')}")), 10), " ")
    other = lambda x: f"case when lower({x}) <> lower(text) then {x} else '' end"
    base = d.array("text", *(other(x) for x in lexical), other(mechanism))
    pick = lambda f: f"case when debate_intent not in ('answer', 'turn', 'indict') then {d.none()} {' '.join(f'when family = {d.lit(k)} then {f(v)}' for k, v in families.items())} else {d.none()} end"
    p.columns(f"{name}_f", f"{name}_z", family=family)
    p.columns(f"{name}_g", f"{name}_f", keep="query_id", texts=d.concat(base, pick(lambda v: d.array(*(t for _, t in v)))), kinds=d.concat(d.strings(["original", "lexical", "lexical", "lexical", "mechanism"]), pick(lambda v: d.strings([k for k, _ in v]))))
    p.add(f"{name}_i", d.explode(f"{name}_g", d.seq("1", d.size("texts")), "ord", "query_id, texts, kinds"))
    p.columns(f"{name}_r", f"{name}_i", keep="query_id, cast(ord as int) as ord", kind=d.at("kinds", "cast(ord as int)"), probe=d.squeeze(d.at("texts", "cast(ord as int)")))
    p.add(f"{name}_d", f"select *, row_number() over (partition by query_id, lower(probe) order by ord) as copy from {name}_r where probe <> ''")
    return p.add(name, f"select query_id, ord, kind, probe, case when kind in ('original', 'mechanism') then 'both' when kind = 'lexical' then 'lexical' else 'semantic' end as channel from {name}_d where copy = 1")


# ---- relationships ----


def _lookup(d: Dialect, x: str, table: dict[str, str]) -> str:
    return f"(case {x} {' '.join(f'when {d.lit(k)} then {d.lit(v)}' for k, v in table.items())} else {x} end)"


def simple_stem(d: Dialect, x: str) -> str:
    cut = lambda s, n, k: f"when {d.ends(x, d.lit(s))} and length({x}) > {n} then left({x}, length({x}) - {k})"
    return f"(case {cut('ing', 5, 3)} {cut('ion', 6, 3)} {cut('al', 6, 2)} {cut('s', 4, 1)} else {x} end)"


def slot_term(d: Dialect, x: str) -> str:
    """Canonical slot term of a lower-case word or phrase."""
    return f"(case {x} {' '.join(f'when {d.lit(k)} then {d.lit(v)}' for k, v in W.SLOT_ALIASES.items())} else {simple_stem(d, x)} end)"


def slot_term_py(x: str) -> str:
    x = x.lower().strip().replace("_", " ")
    if x in W.SLOT_ALIASES:
        return W.SLOT_ALIASES[x]
    for s, n, k in (("ing", 5, 3), ("ion", 6, 3), ("al", 6, 2), ("s", 4, 1)):
        if x.endswith(s) and len(x) > n:
            return x[:-k]
    return x


def add_concepts(p: Pipe, name: str, source: str, **prefixes: str) -> str:
    """``source`` with <k>_con: terms and phrases of prefix k (columns <v>_terms, <v>_phrases), with equivalents and stems."""
    d = p.d
    p.columns(f"{name}_0", source, **{f"{k}_con0": d.union(f"{v}_terms", f"{v}_phrases") for k, v in prefixes.items()})
    return p.columns(name, f"{name}_0", **{f"{k}_con": d.union(f"{k}_con0", d.map(f"{k}_con0", "t", _lookup(d, "t", W.GENERIC_EQUIVALENCES)), d.map(f"{k}_con0", "t", simple_stem(d, "t"))) for k in prefixes})


def cue(d: Dialect, x: str, phrases) -> str:
    """Whether any phrase stands in a lower-case text, at word boundaries."""
    return d.matches(x, r"\b(?:" + "|".join(r"\s+".join(w.split()) for w in sorted(phrases)) + r")\b")


def relation_cards(p: Pipe, name: str, only: str) -> str:
    """Cards of ``only`` with what relationships need: concepts and mechanism of the whole (c) and of the front (f), cues, slot occurrences by source."""
    d = p.d
    p.add(f"{name}_only", f"select c.* from {cards(p)} c join (select distinct card_id from {only}) o on c.card_id = o.card_id")
    part = lambda *xs: "concat_ws(chr(10), " + ", ".join(f"nullif({x}, '')" for x in xs) + ")"
    p.columns(f"{name}_t", f"{name}_only", whole=part("section", "tag", "card_name", "citation", "highlight", "body"), front=part("section", "tag", "highlight"))
    return relation_texts(p, name, f"{name}_t")


def relation_texts(p: Pipe, name: str, source: str, single: bool = False) -> str:
    """The same for rows with ``whole`` and ``front``; ``single``: plain texts without fields."""
    d = p.d
    keep = "card_id, whole, front" if single else "card_id, whole, front, section, tag, card_name, citation, highlight, body"
    p.columns(f"{name}_b", source, keep=keep)
    T.add_mechanism(p, f"{name}_c", f"{name}_b", "c", "whole")
    T.add_mechanism(p, f"{name}_d", f"{name}_c", "f", "front")
    fields = {"text": "whole"} if single else {"section": "section", "tag": "tag", "card_name": "card_name", "citation": "citation", "highlights": "highlight", "body": "body"}
    T.add_phrases(p, f"{name}_e", f"{name}_d", **{f"o{k}": f"coalesce({v}, '')" for k, v in fields.items()})
    slots = {f"slot_{k}": d.filter(d.map(d.concat(T.terms(d, f"coalesce({v}, '')"), d.map(f"o{k}_phrases", "t", "replace(t, '_', ' ')")), "t", slot_term(d, "t")), "t", "t <> ''") for k, v in fields.items()}
    add_concepts(p, f"{name}_g", f"{name}_e", c="c", f="f")
    low = "lower(whole)"
    cues = {
        "cue_indict": cue(d, low, W.INDICT_CUES),
        "cue_mitigate": f"({cue(d, low, W.MITIGATION_CUES)} or {d.overlap('c_terms', d.strings(W.MITIGATION_CUES))})",
        "cue_unique": cue(d, low, W.NON_UNIQUE_CUES),
        "cue_quo": cue(d, low, ("non-unique", "nonunique", "status quo", "squo")),
        "cue_turn": f"({cue(d, low, W.TURN_CUES)} or {d.overlap('c_terms', d.strings(W.TURN_CUES))})",
        "cue_bypass": cue(d, low, W.CIRCUMVENTION_CUES),
        "negated": f"({d.overlap('c_terms', d.strings(sorted(W.NEGATION_CUES)))} or {d.matches(low, chr(92) + 'b(?:no|not|cannot|doesn' + chr(91) + chr(39) + '’]?t)' + chr(92) + 'b')})",
    }
    kept = ", ".join(f"{k}_{x}" for k in "cf" for x in ("terms", *T.MECHANISM, "polarity", "con"))
    return p.keep(p.columns(name, f"{name}_g", keep=f"card_id, front, {kept}", **slots, **cues))


def relation_claims(p: Pipe, name: str, source: str, x: str = "text") -> str:
    """Claims with their mechanism and concepts (q) and slots."""
    d = p.d
    structured_claim(p, f"{name}_s", source, x)
    T.add_mechanism(p, f"{name}_m", f"{name}_s", "q", x)
    add_concepts(p, f"{name}_c", f"{name}_m", q="q")
    slot = lambda v: d.sort(d.filter(d.map(T.terms(d, v), "t", slot_term(d, "t")), "t", "t <> ''"))
    return p.keep(p.columns(name, f"{name}_c", **{f"z_{k}": slot(k) for k in ("subject", "target_actor", "target_action", "target_object", "effect", "relation_text")}))


def relationships(p: Pipe, name: str, pairs: str, claim: str, card: str, single: bool = False) -> str:
    """Pairs with coverage of the claim's slots, attack alignment, and the ten-way relationship."""
    d = p.d
    p.add(f"{name}_j", f"select q.*, c.*, pr.retrieval_score from {pairs} pr join {claim} q on q.query_id = pr.query_id join {card} c on c.card_id = pr.card_id")
    sources = ("text",) if single else ("section", "tag", "card_name", "citation", "highlights", "body")
    every = d.distinct(d.concat(*(f"slot_{s}" for s in sources))) if len(sources) > 1 else d.distinct("slot_text")
    p.keep(p.columns(f"{name}_k", f"{name}_j", slot_all=every))
    number = lambda x: f"{x}e0"
    weights = d.concat(*(d.map(d.filter(f"slot_{s}", "o", "o = m"), "o", number(W.SOURCE_WEIGHTS[s])) for s in sources)) if len(sources) > 1 else d.map(d.filter("slot_text", "o", "o = m"), "o", "1.0e0")
    most = (lambda xs: f"coalesce(array_max({xs}), 0e0)") if d.name == "spark" else (lambda xs: f"coalesce(list_max({xs}), 0e0)")
    quality = most(d.slice(weights, "1", "3"))  # of a matched term m: its first three occurrences
    table = lambda t: {slot_term_py(k): sorted({slot_term_py(a) for a in v.split()}) for k, v in t.items()}
    first = lambda t, x: f"case {x} {' '.join(f'when {d.lit(k)} then {d.at(d.filter(d.strings(v), chr(97), d.has(chr(115) + chr(108) + chr(111) + chr(116) + chr(95) + chr(97) + chr(108) + chr(108), chr(97))), chr(49))}' for k, v in table(t).items())} end"
    # each slot term: what it matches in the card, and how
    match = {}
    slots = ("subject", "target_actor", "target_action", "target_object", "effect")
    for s in slots:
        hit = f"case when {d.has('slot_all', 't')} then '1' || t else coalesce('2' || ({first(_slot_table(W.SLOT_EQUIVALENCES), 't')}), '3' || ({first(_slot_table(W.SLOT_CONTEXTUAL), 't')}), '0') end"
        match[f"h_{s}"] = d.map(f"z_{s}", "t", hit)
    p.columns(f"{name}_l", f"{name}_k", **match)
    base = "case left(h, 1) when '1' then 1e0 when '2' then 0.72e0 when '3' then 0.42e0 else 0e0 end"
    matched_quality = d.map(d.map("{h}", "h", "substring(h, 2)"), "m", f"case when m = '' then 0e0 else {quality} end")
    p.columns(f"{name}_m", f"{name}_l", **{f"q_{s}_w": matched_quality.replace("{h}", f"h_{s}") for s in slots}, **{f"b_{s}": d.map(f"h_{s}", "h", base) for s in slots})
    total = lambda xs: d.fold(xs, "0e0" if d.name == "duckdb" else "0D", "s", "v", "s + v")
    product = lambda a, b: d.dot(a, b)
    score = {f"k_{s}": f"case when {d.size(f'z_{s}')} = 0 then 0e0 else {d.round(product(f'b_{s}', f'q_{s}_w') + f' / {d.size(chr(122) + chr(95) + s)}')} end" for s in slots}
    grade = {f"g_{s}": most(f"q_{s}_w") for s in slots}
    sets = lambda t: f"case relation {' '.join(f'when {d.lit(k)} then {d.strings(sorted({slot_term_py(a) for a in v.split()}))}' for k, v in t.items())} else {d.none()} end"
    p.columns(
        f"{name}_n",
        f"{name}_m",
        **score,
        **grade,
        r1=d.sort(d.inter("z_relation_text", "slot_all")),
        r2=d.sort(d.inter(sets(W.RELATION_EQUIVALENCES), "slot_all")),
        r3=d.sort(d.inter(sets(W.RELATION_CONTEXTUAL), "slot_all")),
    )
    p.columns(f"{name}_o", f"{name}_n", r_terms=f"case when relation = 'UNKNOWN' then {d.none()} when {d.size('r1')} > 0 then r1 when {d.size('r2')} > 0 then r2 else r3 end", r_base=f"case when relation = 'UNKNOWN' then 0e0 when {d.size('r1')} > 0 then 1e0 when {d.size('r2')} > 0 then 0.72e0 when {d.size('r3')} > 0 then 0.42e0 else 0e0 end")
    p.columns(f"{name}_p", f"{name}_o", g_relation=most(d.map(d.slice("r_terms", "1", "2"), "m", quality)))
    p.columns(f"{name}_q", f"{name}_p", k_relation=d.round("r_base * g_relation"))
    parts = ("subject", "target_actor", "target_action", "target_object")
    filled = " + ".join(["1", *(f"case when {s} <> '' then 1 else 0 end" for s in parts)])
    summed = " + ".join(["k_relation", *(f"case when {s} <> '' then k_{s} else 0e0 end" for s in parts)])
    both = ("relation", *parts)
    p.columns(
        f"{name}_s",
        f"{name}_q",
        coverage_0=f"(({summed}) / ({filled}))",
        source_quality=f"case when {' + '.join(f'k_{s}' for s in both)} <= 0 then 0e0 else {d.round('(' + ' + '.join(f'k_{s} * g_{s}' for s in both) + ') / (' + ' + '.join(f'k_{s}' for s in both) + ')')} end",
        attack=f"case when relation = 'PREVENTS' and cue_bypass then {d.round('least(1e0, 0.48e0 + k_relation * 0.25e0 + k_target_actor * 0.1e0 + k_target_action * 0.08e0 + k_target_object * 0.09e0)')} else 0e0 end",
    )
    low = lambda s: f"case when {'true' if s == 'relation' else s + ' <> ' + chr(39) * 2} and k_{s} < 0.2e0 then 'missing {s}' end"
    warnings = ["case when k_target_object >= 0.35e0 and greatest(k_subject, k_target_actor) < 0.2e0 then 'impact-heavy match' end", "case when k_target_action >= 0.55e0 and k_target_object >= 0.35e0 and k_subject < 0.2e0 then 'effect-only match' end", *(low(s) for s in ("subject", "relation", "target_actor", "target_action", "target_object")), "case when coverage_0 >= 0.25e0 and source_quality < 0.45e0 then 'low source quality' end"]
    p.keep(f"{name}_s")
    p.columns(f"{name}_t", f"{name}_s", coverage=d.round("coverage_0"), warnings=d.not_null(d.array(*warnings)), overlap=d.ratio(d.size(d.inter("q_con", "c_con")), d.size("q_con")), front_overlap=d.ratio(d.size(d.inter("q_con", "f_con")), d.size("q_con")))
    T.add_match(p, f"{name}_u", f"{name}_t")
    p.columns(f"{name}_v0", f"{name}_u", keep="* exclude (m_actor, m_cause, m_effect, m_object, m_phrases, m_specific, m_common, mech), mech as mech_c" if d.name == "duckdb" else "* except (m_actor, m_cause, m_effect, m_object, m_phrases, m_specific, m_common, mech), mech as mech_c")
    T.add_match(p, f"{name}_v", f"{name}_v0", "q", "f")
    pos, neg = d.strings(sorted(W.POSITIVE_DIRECTION)), d.strings(sorted(W.NEGATIVE_DIRECTION))
    way = lambda a, b: f"case when {d.overlap(f'{a}_con', pos)} and {d.overlap(f'{b}_con', pos)} then 'supports' when {d.overlap(f'{a}_con', neg)} and {d.overlap(f'{b}_con', neg)} then 'supports' when {d.overlap(f'{a}_con', pos)} and {d.overlap(f'{b}_con', neg)} then 'opposes' when {d.overlap(f'{a}_con', neg)} and {d.overlap(f'{b}_con', pos)} then 'opposes' else 'unknown' end"
    less = lambda xs: d.minus(xs, d.union("q_actor", "q_cause", "q_generic"))
    p.columns(f"{name}_w", f"{name}_v", mech_f="mech", direction=way("q", "c"), direction_f=way("q", "f"), targets=f"case when {d.size(less('q_effect'))} > 0 then {less('q_effect')} else {less('q_object')} end")
    p.columns(f"{name}_x", f"{name}_w", hits_effect=d.overlap(d.union("targets", d.map("targets", "t", _lookup(d, "t", W.GENERIC_EQUIVALENCES))), "c_con"), opposed="(q_polarity <> 0 and c_polarity <> 0 and q_polarity <> c_polarity and mech_c >= 0.2e0)")
    against = "(opposed or direction = 'opposes' or (negated and overlap >= 0.22e0))"
    rules = (
        (f"{d.size('q_con')} = 0", 0), ("overlap < 0.08e0 and mech_c < 0.08e0 and attack >= 0.55e0", 1), ("overlap < 0.08e0 and mech_c < 0.08e0", 2),
        (f"cue_unique and (cue_quo or {d.overlap('q_con', d.strings(['unique', 'uniquely', 'new']))}) and (overlap >= 0.16e0 or mech_c >= 0.18e0)", 3),
        (f"front <> '' and {d.size('f_con')} > 0 and direction_f <> 'opposes' and (front_overlap >= 0.55e0 or (front_overlap >= 0.35e0 and mech_f >= 0.12e0))", 4),
        ("cue_indict and (overlap >= 0.04e0 or mech_c >= 0.08e0)", 5), ("cue_turn and (overlap >= 0.12e0 or mech_c >= 0.12e0)", 6), (f"{against} and cue_mitigate and not hits_effect", 7), (against, 8),
        ("cue_mitigate and direction <> 'supports' and hits_effect", 9), ("cue_mitigate and direction <> 'supports' and (overlap >= 0.08e0 or mech_c >= 0.12e0)", 10),
        ("direction = 'supports' and (overlap >= 0.1e0 or mech_c >= 0.12e0)", 11), ("overlap >= 0.55e0 or (overlap >= 0.35e0 and mech_c >= 0.12e0)", 12), ("overlap >= 0.2e0 or mech_c >= 0.18e0", 13),
    )
    p.columns(f"{name}_y", f"{name}_x", rule="case " + " ".join(f"when {c} then {i}" for c, i in rules) + " else 14 end")
    # relationship and base confidence of each rule
    table2 = (("UNKNOWN", 0), ("CONTRADICTS", 0), ("IRRELEVANT", 0), ("NON_UNIQUE", 0.78), ("SUPPORTS", 0.88), ("INDICTS", 0.82), ("TURNS", 0.82), ("MITIGATES", 0.78), ("CONTRADICTS", 0.82), ("CONTRADICTS", 0.78), ("MITIGATES", 0.72), ("SUPPORTS", 0.8), ("SUPPORTS", 0.86), ("QUALIFIES", 0.55), ("BACKGROUND", 0.35))
    by_rule = lambda f: "case rule " + " ".join(f"when {i} then {f(x)}" for i, x in enumerate(table2)) + " end"
    p.columns(
        f"{name}_z",
        f"{name}_y",
        claim_relationship=by_rule(lambda x: d.lit(x[0])),
        base_confidence=by_rule(lambda x: f"{float(x[1])}e0"),
        used_overlap="case when rule = 0 then 0e0 when rule = 4 then front_overlap else overlap end",
        used_mech="case when rule = 0 then 0e0 when rule = 1 then greatest(mech_c, attack * 0.62e0) when rule = 4 then mech_f else mech_c end",
    )
    direct = "greatest(used_overlap * 0.65e0, used_mech) + case when claim_relationship in ('SUPPORTS', 'CONTRADICTS', 'TURNS', 'NON_UNIQUE') then 0.12e0 when claim_relationship in ('BACKGROUND', 'QUALIFIES') then -0.08e0 else 0e0 end + case when rule in (4, 9) then 0.18e0 else 0e0 end"
    return p.columns(
        name,
        f"{name}_z",
        claim_conf=f"case rule when 0 then 0e0 when 1 then 0.56e0 when 2 then 0.9e0 else {d.round('greatest(0e0, least(1e0, base_confidence * 0.45e0 + used_overlap * 0.35e0 + used_mech * 0.2e0))')} end",
        claim_overlap=d.round("used_overlap"),
        claim_mech=d.round("used_mech"),
        claim_direct=f"case when rule = 2 then 0e0 else {d.round(f'greatest(0e0, least(1e0, {direct}))')} end",
    )


def _slot_table(t: dict[str, str]) -> dict[str, str]:
    return t


# ---- lanes ----

OUR_ANSWERS = ("CONTRADICTS", "TURNS", "NON_UNIQUE", "MITIGATES", "INDICTS")
THEIR_SUPPORT = ("SUPPORTS", "QUALIFIES", "BACKGROUND")
# Utility of an owner and of a relationship, by lane and intent.
OWNER_UTILITY = {"opponent": (1.0, 0.75, 0.45, 0.1), "answer": (0.15, 0.85, 0.45, 1.0), "their_evidence": (1.0, 0.75, 0.45, 0.1), "compare": (0.8, 0.7, 0.45, 0.8), "other": (0.7, 0.7, 0.55, 0.7)}
OWNERS = ("opponent", "shared", "unknown", "us")
RELATIONS = ("SUPPORTS", "QUALIFIES", "BACKGROUND", "CONTRADICTS", "MITIGATES", "INDICTS", "NON_UNIQUE", "TURNS", "IRRELEVANT", "UNKNOWN")
RELATION_UTILITY = {
    "opponent": (1.0, 0.8, 0.45, 0.0, 0.0, 0.0, 0.0, -0.5, -1.0, 0.0),
    "their_evidence": (1.0, 0.8, 0.55, 0.0, 0.0, 0.0, 0.0, -0.5, -1.0, 0.0),
    "answer": (-1.0, 0.25, 0.0, 0.95, 0.7, 0.8, 0.85, 1.0, -1.0, -0.5),
    "turn": (0.55, 0.55, 0.55, 0.9, 0.55, 0.55, 0.55, 0.9, 0.55, 0.55),
    "indict": (0.55, 0.55, 0.55, 0.75, 0.55, 0.75, 0.55, 0.55, 0.55, 0.55),
}


def _utility(d: Dialect, names: tuple, values: tuple, x: str) -> str:
    return f"(case {x} {' '.join(f'when {d.lit(n)} then {v}e0' for n, v in zip(names, values))} end)"


def final_score(d: Dialect, owner: str, relation: str, side: str = "0.5e0") -> str:
    base = f"greatest(0.05e0, retrieval_score) * greatest(0.05e0, s_confidence) * greatest(0.05e0, greatest(0e0, {relation})) * greatest(0.2e0, {owner})"
    return d.round(
        f"greatest(0e0, least(1e0, {base} * 0.72e0 + (s_topic * 0.04e0 + s_mech * 0.08e0 + s_warrant * 0.05e0 + s_direct * 0.065e0 + coverage * 0.07e0 + attack * 0.085e0 + source_quality * 0.03e0 + evidence_strength * 0.015e0 + {side} * 0.005e0)))"
    )


def owners(p: Pipe, name: str = "owners") -> str:
    """(card_id, owner) of labelled documents."""
    return p.add(name, "select doc_id as card_id, max(case when toxic = 1 then 'shared' when quality = 1 then 'us' else 'opponent' end) as owner from labels group by doc_id")


def lanes(p: Pipe, name: str, related: str, assessed: str, k: int = 5) -> str:
    """(query_id, card_id, lane, lane_score, reason, lane_rank): decisions for both lanes; lane_rank is null where a card is not among the lane's k."""
    d = p.d
    keep = "r.query_id, r.card_id, r.retrieval_score, r.coverage, r.attack, r.source_quality, r.claim_relationship, r.debate_intent, coalesce(o.owner, 'unknown') as owner, a.evidence_strength"
    p.add(
        f"{name}_j",
        f"select {keep}, greatest(r.claim_overlap, a.topic_match * 0.5e0) as s_topic, greatest(r.claim_mech, a.mech * 0.5e0, r.attack * 0.62e0) as s_mech, "
        "greatest(greatest(r.claim_overlap * 0.6e0, r.claim_mech), a.warrant_match * 0.5e0, r.attack * 0.55e0) as s_warrant, greatest(r.claim_conf, a.confidence * 0.6e0) as s_confidence, "
        f"{d.round('r.claim_direct * 0.42e0 + r.coverage * 0.32e0 + r.attack * 0.2e0 + r.source_quality * 0.06e0')} as s_direct "
        f"from {related} r join {assessed} a on a.query_id = r.query_id and a.card_id = r.card_id left join {owners(p)} o on o.card_id = r.card_id",
    )
    answers, support = (", ".join(d.lit(x) for x in xs) for xs in (OUR_ANSWERS, THEIR_SUPPORT))
    useful = {
        "our": f"case when debate_intent in ('answer', 'turn', 'indict') then claim_relationship in ({answers}) else claim_relationship not in ('IRRELEVANT', 'UNKNOWN') end",
        "opponent": f"case when debate_intent in ('answer', 'their_evidence', 'compare') then claim_relationship in ({support}) else claim_relationship not in ('IRRELEVANT', 'UNKNOWN') end",
    }
    rel = lambda k: _utility(d, RELATIONS, RELATION_UTILITY[k], "claim_relationship")
    own = lambda k: _utility(d, OWNERS, OWNER_UTILITY[k], "owner")
    ours_o = f"case when debate_intent in ('answer', 'turn', 'indict') then {own('answer')} when debate_intent = 'their_evidence' then {own('their_evidence')} when debate_intent = 'compare' then {own('compare')} else {own('other')} end"
    ours_r = f"case debate_intent when 'turn' then {rel('turn')} when 'indict' then {rel('indict')} when 'answer' then {rel('answer')} when 'their_evidence' then {rel('their_evidence')} else 0.55e0 end"
    for lane in ("our", "opponent"):
        p.columns(f"{name}_{lane}", f"{name}_j", keep=f"*, '{lane}' as lane", useful=useful[lane], u_owner=ours_o if lane == "our" else own("opponent"), u_relation=ours_r if lane == "our" else rel("opponent"), belongs="owner in ('us', 'shared')" if lane == "our" else "owner in ('opponent', 'shared')")
    p.add(f"{name}_u", f"select * from {name}_our union all select * from {name}_opponent")
    p.add(f"{name}_o", f"select *, max(case when belongs and useful then 1 else 0 end) over (partition by query_id, lane) as owned from {name}_u")
    gate = (
        "case when claim_relationship in ('IRRELEVANT', 'UNKNOWN') then claim_relationship || ' relationship' when u_relation <= 0 then 'relationship utility <= 0' when s_confidence < 0.32e0 then 'relationship confidence < 0.32' "
        "when lane = 'our' and s_confidence < 0.5e0 then 'our-answer relationship confidence < 0.50' when lane = 'our' and s_direct < 0.25e0 then 'our-answer directness < 0.25' "
        "when lane = 'our' and claim_relationship in ('SUPPORTS', 'BACKGROUND') then claim_relationship || ' opponent claim' "
        f"when lane = 'opponent' and claim_relationship not in ({support}) then claim_relationship || ' is not opponent evidence' when lane = 'opponent' and claim_relationship = 'SUPPORTS' and s_confidence < 0.5e0 then 'opponent-support confidence < 0.50' "
        "when lane = 'opponent' and claim_relationship = 'SUPPORTS' and s_topic < 0.2e0 then 'opponent-support topic < 0.20' when lane = 'opponent' and claim_relationship = 'SUPPORTS' and s_direct < 0.2e0 then 'opponent-support directness < 0.20' "
        "when s_topic < 0.08e0 and s_mech < 0.08e0 then 'topic and mechanism below floor' end"
    )
    p.columns(f"{name}_g", f"{name}_o", eligible="useful and case when owned = 1 then belongs else owner = 'unknown' end", gated=gate, score_0=final_score(d, "u_owner", "u_relation"))
    wrong = "case when lane = 'our' and owner = 'opponent' then 'wrong owner for our lane' when lane = 'opponent' and owner = 'us' then 'wrong owner for opponent lane' else 'relationship not useful for lane' end"
    p.columns(f"{name}_s", f"{name}_g", reason=f"case when not eligible then {wrong} when gated is not null then gated else 'accepted' end", accepted="eligible and gated is null and score_0 > 0")
    p.columns(f"{name}_r", f"{name}_s", lane_score="case when accepted then score_0 else 0e0 end", pos="row_number() over (partition by query_id, lane, accepted order by score_0 desc, card_id)")
    return p.columns(name, f"{name}_r", lane_rank=f"case when accepted and pos <= {k} then cast(pos as int) end")


