"""Query understanding, lexical and mechanism reranking, gates."""

from __future__ import annotations

from evidentia.functions import text as T
from evidentia.functions.dialect import Pipe
from evidentia.operators import retrieval as R
from evidentia.sources.adapters import cards, claims


# ---- query understanding ----

FILTERS = (r"(?i)\bauthor:[A-Za-z][\w'’-]*", r"(?i)\byear:\d{4}(?:-\d{4})?", r'(?i)\bsection:(?:"[^"]+"|[^\s]+)', r"(?i)\bcategory:[A-Za-z][\w-]*", r"(?i)\btopical:(?:true|false|yes|no|1|0)", r"(?i)\bcount:\d{1,2}")
OPPONENT = r"(?i)^\s*(?:opponent|they|other team)\s+(?:says?|argues?|claims?)\s+"
CITATION = r"^\s*([A-Za-z][A-Za-z'’-]{1,})\s+(\d{4}|[‘'’]\d{2}|\d{2})\s*$"
SECTION = r"(?i)^\s*(?:AT:|OV\b|Overview\b).+"
AUTHOR = r"^\s*[A-Za-z][A-Za-z'’-]{2,}\s*$"


def intent(p: Pipe, name: str, source: str, x: str = "text") -> str:
    """``source`` with search_text, opponent_claim, the filters, search_mode, retrieval_text, citation_text."""
    d = p.d
    none = lambda e: f"nullif({e}, '')"
    strip = x
    for f in FILTERS:
        strip = d.replace(strip, f, "")
    number = lambda e: f"cast({none(e)} as int)"
    p.columns(
        f"{name}_1",
        source,
        search_text=d.squeeze(strip),
        f_author=none(d.extract(x, r"(?i)\bauthor:([A-Za-z][\w'’-]*)", 1)),
        y1=number(d.extract(x, r"(?i)\byear:(\d{4})(?:-(\d{4}))?", 1)),
        y2=number(d.extract(x, r"(?i)\byear:(\d{4})(?:-(\d{4}))?", 2)),
        f_section=f"coalesce({none(d.extract(x, r'(?i)\bsection:\"([^\"]+)\"', 1))}, {none(d.extract(x, r'(?i)\bsection:([^\s]+)', 1))})",
        category_filter=none(d.extract(x, r"(?i)\bcategory:([A-Za-z][\w-]*)", 1)),
        f_topical=none(f"lower({d.extract(x, r'(?i)\btopical:(true|false|yes|no|1|0)', 1)})"),
        f_count=number(d.extract(x, r"(?i)\bcount:(\d{1,2})", 1)),
    )
    p.columns(f"{name}_2", f"{name}_1", claim_0=d.trim(d.replace("search_text", OPPONENT, ""), " ."), cite_author=none(d.extract("search_text", CITATION, 1)), cite_year=none(f"translate({d.extract('search_text', CITATION, 2)}, {d.lit('‘’' + chr(39))}, '')"))
    year = "(case when length(cite_year) = 4 then cast(cite_year as int) when cast(cite_year as int) < 70 then 2000 + cast(cite_year as int) else 1900 + cast(cite_year as int) end)"
    cited = "(cite_author is not null and f_author is null)"
    p.columns(
        f"{name}_3",
        f"{name}_2",
        opponent_claim=f"case when claim_0 <> {d.trim('search_text', ' .')} and claim_0 <> '' then claim_0 end",
        author_filter=f"case when {cited} then cite_author when f_author is null and {d.matches('search_text', AUTHOR)} then search_text else f_author end",
        year_min=f"case when {cited} then {year} else y1 end",
        year_max=f"case when {cited} then {year} else coalesce(y2, y1) end",
        section_filter=f"case when f_section is null and {d.matches('search_text', SECTION)} then search_text else f_section end",
        topical_filter="case when f_topical is not null then f_topical in ('true', 'yes', '1') end",
        requested_count="case when f_count is not null then greatest(1, least(f_count, 50)) end",
    )
    mode = (
        f"case when opponent_claim is not null then 'argument' when section_filter is not null and {d.matches('section_filter', SECTION)} then 'section' "
        "when author_filter is not null and year_min is not null then 'citation' when author_filter is not null then 'author' when cite_author is not null then 'citation' else 'general' end"
    )
    p.columns(f"{name}_4", f"{name}_3", search_mode=mode, retrieval_text=f"coalesce(opponent_claim, nullif(search_text, ''), {x})")
    digits = d.matches(x, "[0-9]")
    return p.columns(
        name,
        f"{name}_4",
        citation_text=f"case when author_filter is not null and year_min is not null then author_filter || ' ' || cast(year_min as varchar(4)) when author_filter is not null then author_filter when {d.matches(x, CITATION)} then {x} when {d.size(d.split(d.squeeze(x), ' '))} <= 4 and {digits} then {x} else '' end",
    )


# ---- fields ----


def card_features(p: Pipe, name: str = "card_features", only: str | None = None) -> str:
    """Per card: term-and-phrase sets of its fields, its mechanism (prefix c) and the strength of its evidence.

    ``only``: a relation of card_id that bounds the work to candidates.
    """
    d = p.d
    source = cards(p)
    if only:
        source = p.add(f"{name}_only", f"select c.* from {source} c join (select distinct card_id from {only}) o on c.card_id = o.card_id")
    part = lambda *xs: "concat_ws(chr(10), " + ", ".join(f"nullif({x}, '')" for x in xs) + ")"
    p.columns(f"{name}_t", source, mech_text=part("section", "tag", "highlight", "body"), cite_text="concat_ws(' ', card_name, author, cast(year as varchar(4)), citation)")
    T.add_phrases(p, f"{name}_f", f"{name}_t", ts="section", tt="tag", th="highlight", tb="body")
    p.columns(f"{name}_g", f"{name}_f", **{f"s_{k}": d.union(T.terms(d, x), f"{v}_phrases") for k, v, x in (("section", "ts", "section"), ("tag", "tt", "tag"), ("highlight", "th", "highlight"), ("body", "tb", "body"))}, s_citation=T.terms(d, "cite_text"))
    keep = "card_id, section, tag, card_name, author, year, citation, document, highlight, s_section, s_tag, s_highlight, s_body, s_citation, mech_text"
    strength = "(case when highlight <> '' then 0.45e0 else 0e0 end + case when coalesce(citation, '') <> '' then 0.2e0 else 0e0 end + case when coalesce(card_name, '') <> '' then 0.15e0 else 0e0 end + case when coalesce(author, '') <> '' then 0.1e0 else 0e0 end + case when coalesce(year, 0) <> 0 then 0.1e0 else 0e0 end)"
    p.columns(f"{name}_h", f"{name}_g", keep=keep, evidence_strength=d.round(f"least({strength}, 1e0)"))
    return p.keep(T.add_mechanism(p, name, f"{name}_h", "c", "mech_text"))


def claim_features(p: Pipe, name: str = "claim_features", source: str | None = None, x: str = "text") -> str:
    """Per claim: its mechanism (prefix q) and q_all, the terms that candidates are measured by."""
    d = p.d
    T.add_mechanism(p, f"{name}_m", source or claims(p), "q", x)
    return p.keep(p.columns(name, f"{name}_m", q_all=d.minus(d.union("q_terms", "q_phrases", "q_object"), "q_generic")))


def term_weight(p: Pipe, xs: str) -> str:
    """Sum of the terms' weights: phrases 2.5, short words and numbers .35, others 1."""
    d = p.d
    w = f"case when {d.contains('t', d.lit('_'))} then 2.5e0 when length(t) <= 2 or translate(t, '0123456789', '') = '' then 0.35e0 else 1e0 end"
    return d.round(d.fold(d.map(xs, "t", w), "0e0" if d.name == "duckdb" else "0D", "s", "v", "s + v"))


def full_context(p: Pipe, name: str, candidates: str, features: str, claim: str) -> str:
    """Rerank candidates (query_id, card_id, retrieval_score): every score, the relationship, confidence and rejection reason."""
    d = p.d
    p.add(f"{name}_j", f"select q.*, f.*, c.retrieval_score from {candidates} c join {claim} q on q.query_id = c.query_id join {features} f on f.card_id = c.card_id")
    fields = ("tag", "highlight", "body", "citation", "section")
    p.columns(f"{name}_k", f"{name}_j", **{f"h_{k}": d.inter("q_all", f"s_{k}") for k in fields}, q_weight=term_weight(p, "q_all"))
    T.add_match(p, f"{name}_m", f"{name}_k")
    over = lambda xs: d.round(d.ratio(d.size(xs), d.size("q_all")))
    p.columns(
        f"{name}_n",
        f"{name}_m",
        **{f"w_{k}": d.round(f"case when q_weight = 0 then 0e0 else least({term_weight(p, f'h_{k}')} / q_weight, 1e0) end") for k in fields[:4]},
        topic_match=over(d.union("h_tag", "h_highlight")),
        warrant_match=over(d.union("h_highlight", "h_body")),
        n_useful=d.size(d.union("h_tag", "h_highlight", "h_body", "h_citation")),
        n_section=d.size("h_section"),
    )
    core = lambda k: d.minus(d.union(f"{k}_cause", f"{k}_effect", f"{k}_object"), f"{k}_generic")
    has = lambda q, *cs: d.overlap(f"q_{q}", d.union(*(f"c_{c}" for c in cs)))
    empty = lambda q: f"{d.size(f'q_{q}')} = 0"
    score = "(w_tag * 4e0 + w_highlight * 3e0 + w_body * 1.25e0 + w_citation * 0.75e0 + n_section * 0.15e0 + mech * 10e0 + evidence_strength * 2e0 + retrieval_score * 5e0)"
    score += " * (case when n_section > 0 and n_useful = 0 then 0.2e0 else 1e0 end) * (case when mech < 0.12e0 then 0.45e0 else 1e0 end)"
    score += f" * (case when {d.size('h_tag')} + {d.size('h_highlight')} + {d.size('h_body')} = 0 then 0.4e0 else 1e0 end)"
    p.columns(
        f"{name}_o",
        f"{name}_n",
        raw=score,
        section_only="n_section > 0 and n_useful = 0",
        same_core=d.overlap(core("q"), core("c")),
        opposes="q_polarity <> 0 and c_polarity <> 0 and q_polarity <> c_polarity",
        agrees="q_polarity <> 0 and q_polarity = c_polarity",
        direct=f"mech >= 0.25e0 and ({empty('actor')} or {has('actor', 'actor')}) and ({empty('effect')} or {has('effect', 'effect', 'object')}) and ({empty('cause')} or {has('cause', 'cause', 'object')} or mech >= 0.45e0)",
        partly=f"mech >= 0.12e0 and ({has('cause', 'cause', 'object')} or {has('effect', 'effect', 'object')})",
    )
    usable = "warrant_match >= 0.15e0 or mech >= 0.45e0"
    relation = (
        f"case when {d.size('q_all')} = 0 then 'IRRELEVANT' when mech < 0.08e0 and topic_match < 0.15e0 then 'IRRELEVANT' when same_core and opposes then 'CONTRADICTS' when same_core and agrees then 'SUPPORTS' "
        f"when not direct and not partly then case when mech >= 0.08e0 or topic_match >= 0.18e0 then 'BACKGROUND' else 'IRRELEVANT' end when not direct then case when {usable} then 'QUALIFIES' else 'BACKGROUND' end "
        f"when opposes then 'CONTRADICTS' when agrees then 'SUPPORTS' when {usable} then 'QUALIFIES' else 'BACKGROUND' end"
    )
    p.columns(f"{name}_p", f"{name}_o", relevance_score=f"case when {d.size('q_all')} = 0 or raw <= 0 then 0e0 else {d.round('least(raw / (raw + 5e0), 0.98e0)')} end", relationship=relation)
    conf = "relevance_score * 0.35e0 + mech * 0.3e0 + warrant_match * 0.2e0 + evidence_strength * 0.15e0"
    capped = f"greatest(0e0, least(1e0, case relationship when 'IRRELEVANT' then least({conf}, 0.2e0) when 'BACKGROUND' then least({conf}, 0.55e0) else {conf} end))"
    reason = f"case when {d.size('q_all')} = 0 then 'empty query' when section_only then 'matches section but not card mechanism' when relationship = 'IRRELEVANT' then 'topic and mechanism mismatch' when relationship = 'BACKGROUND' then 'background topic overlap without usable mechanism match' when relevance_score < 0.18e0 then 'low relevance score' end"
    p.columns(f"{name}_r", f"{name}_p", confidence=f"case when {d.size('q_all')} = 0 then 0e0 else {d.round(capped)} end", rejection_reason=reason)
    keep = "query_id, card_id, retrieval_score, h_tag, h_highlight, h_body, h_citation, h_section, relevance_score, topic_match, mech, warrant_match, evidence_strength, confidence, relationship, rejection_reason"
    return p.add(name, f"select {keep}, cast(row_number() over (partition by query_id order by relevance_score desc, retrieval_score desc, card_id) as int) as rerank from {name}_r")


def gate(p: Pipe, name: str, source: str) -> str:
    """``source`` with gate_reason: null where a candidate passes its query's minima."""
    p.add(f"{name}_top", f"select *, max(relevance_score) over (partition by query_id) as top_r, max(confidence) over (partition by query_id) as top_c from {source}")
    low = "case when top_r >= 0.75e0 then greatest(0.22e0, top_r * 0.35e0) when top_r >= 0.45e0 then greatest(0.22e0, top_r * 0.45e0) else greatest(0.16e0, least(0.22e0, top_r * 0.65e0)) end"
    sure = "case when top_c >= 0.7e0 then greatest(0.2e0, top_c * 0.35e0) else greatest(0.16e0, least(0.2e0, top_c * 0.55e0)) end"
    reason = f"case when rejection_reason is not null then rejection_reason when relationship = 'IRRELEVANT' then 'topic and mechanism mismatch' when relationship = 'BACKGROUND' then 'background evidence excluded by gate' when relevance_score < {low} then 'low relevance score' when confidence < {sure} then 'low confidence' end"
    return p.columns(name, f"{name}_top", gate_reason=reason)


def simple_rerank(p: Pipe, name: str, candidates: str, k: int = 3, threshold: float = 2.0) -> str:
    """Hits in tag, highlight and section, weighted 3, 1.5 and .5; one card for each (section, tag)."""
    d = p.d
    p.columns(f"{name}_q", claims(p), keep="query_id", q=T.terms(d, "text"))
    p.columns(f"{name}_c", p.add(f"{name}_only", f"select c.* from {cards(p)} c join (select distinct card_id from {candidates}) o on c.card_id = o.card_id"), keep="card_id, section, tag", **{k: T.terms(d, x) for k, x in (("a", "tag"), ("b", "highlight"), ("e", "section"))})
    hits = lambda x: d.size(d.inter("q.q", f"c.{x}"))
    p.add(f"{name}_s", f"select o.query_id, o.card_id, c.section, c.tag, o.retrieval_score, {hits('a')} * 3e0 + {hits('b')} * 1.5e0 + {hits('e')} * 0.5e0 as relevance_score from {candidates} o join {name}_q q on q.query_id = o.query_id join {name}_c c on c.card_id = o.card_id")
    p.add(f"{name}_d", f"select *, row_number() over (partition by query_id, section, tag order by relevance_score desc, retrieval_score desc, card_id) as copy from {name}_s where relevance_score >= {float(threshold)}e0")
    p.add(f"{name}_one", f"select query_id, card_id, relevance_score, retrieval_score from {name}_d where copy = 1")
    return R.top(p, name, f"{name}_one", "relevance_score desc, retrieval_score desc, card_id", k)
