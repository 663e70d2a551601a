"""Registered queries as relational texts, the same for Spark and for the oracle."""

from __future__ import annotations

from evidentia.functions import text as T
from evidentia.functions.dialect import Dialect, Pipe
from evidentia.operators import boolean as O
from evidentia.operators import debate as B
from evidentia.operators import ranking as K
from evidentia.operators import retrieval as R
from evidentia.operators import store as S
from evidentia.sources.adapters import cards, claims

QUERIES: dict = {}


def query(f):
    """Register f(Pipe) -> final SELECT under its name."""

    def build(d: Dialect) -> tuple[Pipe, str]:
        p = Pipe(d)
        return p, f(p)

    QUERIES[f.__name__] = build
    return f


def sorted_words(p: Pipe, *names: str) -> str:
    return ", ".join(f"{p.d.join(p.d.sort(n), ' ')} as {n}" for n in names)


# ---- terms, phrases, mechanisms ----


@query
def term_sets(p):
    p.columns("x", cards(p), keep="card_id", terms=T.terms(p.d, "body"))
    return f"select card_id, {sorted_words(p, 'terms')}, cast({p.d.size('terms')} as int) as n_terms from x"


@query
def canonical_terms(p):
    d = p.d
    p.columns("x", cards(p), keep="card_id", terms=T.terms(d, "body"))
    p.add("y", d.explode("x", "terms", "term", "card_id"))
    return f"select term, {T.canonical(d, 'term')} as canonical, {T.generic(d, 'term')} as is_generic, count(*) as n from y group by term"


@query
def phrase_concepts(p):
    T.add_phrases(p, "x", cards(p), t="body")
    return f"select card_id, {sorted_words(p, 't_phrases')} from x"


@query
def mechanism_parse(p):
    T.add_mechanism(p, "x", claims(p), "q", "text")
    return f"select query_id, {sorted_words(p, 'q_actor', 'q_cause', 'q_effect', 'q_object', 'q_phrases', 'q_generic')}, q_polarity from x"


@query
def mechanism_match(p):
    R.bm25(p, k=10)
    K.claim_features(p)
    K.card_features(p, only="fts")
    p.add("j", "select q.*, c.* from fts o join claim_features q on q.query_id = o.query_id join card_features c on c.card_id = o.card_id")
    T.add_match(p, "m", "j")
    d = p.d
    concepts = d.union("q_actor", "q_cause", "q_effect", "q_phrases")
    every = d.union("c_actor", "c_cause", "c_effect", "c_object", "c_phrases")
    p.columns("n", "m", keep="query_id, card_id, mech", matched=d.inter(concepts, every), missing=d.minus(concepts, every))
    return f"select query_id, card_id, mech, {sorted_words(p, 'matched', 'missing')} from n"


@query
def porter_stems(p):
    return f"select word, folded, stem from {R.vocabulary(p)}"


# ---- query understanding ----

PREFIXES = ("", "author:Adler ", "year:2001-2010 ", 'section:"src 3" ', "category:impact topical:yes ", "opponent says ", "count:75 ", "they argue ")


def inputs(p: Pipe) -> str:
    """Claims with inline filters and control language."""
    d = p.d
    special = d.strings(["Tucker 2020", "Adler", "AT: Topicality", "Brook '98", "overview climate", "Cole 05", "search> economy", "indict> they claim x"])
    prefix = d.at(d.strings(PREFIXES), "cast(query_id % 8 as int) + 1")
    return p.columns("inputs", claims(p), keep="query_id", text=f"case when query_id % 5 = 4 then {d.at(special, 'cast(query_id % 8 as int) + 1')} else {prefix} || text end")


@query
def query_intent(p):
    K.intent(p, "x", inputs(p))
    return "select query_id, search_text, opponent_claim, author_filter, year_min, year_max, section_filter, category_filter, topical_filter, requested_count, search_mode, retrieval_text, citation_text from x"


@query
def ignored_stopwords(p):
    from evidentia.functions.words import STOPWORDS

    d = p.d
    p.columns("x", inputs(p), keep="query_id", words=d.distinct(d.filter(d.find_all("lower(text)", "[a-z0-9']+"), "t", d.one_of("t", STOPWORDS))))
    return f"select query_id, {sorted_words(p, 'words')} from x"


@query
def debate_command(p):
    d = p.d
    p.columns("x0", inputs(p), keep="query_id", text=f"{d.at(d.strings(['answer> ', 'their> ', 'compare> ', 'turn> ', 'indict> ', 'search> ', 'unknown> ', '']), 'cast(query_id % 8 as int) + 1')} || text")
    B.debate_query(p, "x", "x0")
    return "select query_id, command, debate_claim, debate_intent, perspective, semantic_query from x"


@query
def structured_claim(p):
    B.structured_claim(p, "x", claims(p))
    return "select query_id, subject, relation, relation_text, effect, target_actor, target_action, target_object, slot_confidence, claim_confidence, has_structure, display_effect from x"


# ---- retrieval ----


@query
def fts_query_kind(p):
    d = p.d
    p.columns("x", claims(p), keep="query_id", text="case when query_id % 4 = 0 then text || ' AND ' || plain else text end")
    return f"select query_id, {R.advanced(p, 'text')} as is_advanced, {d.join(R.plain_terms(p, 'text'), ' ')} as terms from x".replace(d.join(R.plain_terms(p, "text"), " "), d.join(d.sort(R.plain_terms(p, "text")), " "))


@query
def fts_bm25(p):
    R.bm25(p)
    return "select query_id, card_id, bm25, n_matched, n_terms, rank from fts"


@query
def fts_rank_score(p):
    R.bm25(p, k=20)
    return f"select query_id, card_id, rank, {R.rank_score(p, '(0e0 - bm25)')} as score from fts"


@query
def fts_prefix_or(p):
    """Every term as the beginning of a word, any of them; the score falls as relevance grows, as the desktop search has it."""
    R.prefix_hits(p, "r", every=False)
    return "select query_id, card_id, n_terms, score, rank from r"


@query
def fts_prefix_and(p):
    """The native search: every term as the beginning of a word, all of them, over the claims' first words."""
    claims(p)
    p.add("claims_whole", p.parts.pop("claims"))
    p.columns("claims", "claims_whole", keep="query_id, plain", text=p.d.join(p.d.slice(p.d.split("plain", " "), "1", "cast(1 + query_id % 3 as int)"), " "))
    R.prefix_hits(p, "r", every=True)
    return "select query_id, card_id, n_terms, score, rank from r"


BOOLEAN = ('"the and" OR "de la"', "license AND version NOT gnu", "th* NOT (the OR der)", "NEAR(the and, 3)", "(die OR das) und", '"all rights reserved" OR gnu')


@query
def fts_boolean(p):
    O.search(p, BOOLEAN)
    return "select query_no, card_id, bm25, rank from boolean"


@query
def like_fallback(p):
    d = p.d
    p.columns("q", claims(p), keep="query_id", needle=d.at(d.split("text", " "), "2"))
    found = " or ".join(d.ilike(f"c.{x}", "'%' || q.needle || '%'") for x in ("tag", "card_name", "body", "citation"))
    p.add("h", f"select q.query_id, c.card_id, 0.25e0 as score, c.order_index, c.para from q join {cards(p)} c on {found}")
    R.top(p, "r", "h", "order_index, para, card_id", 20)
    return "select query_id, card_id, score, rank from r"


@query
def author_citation_source(p):
    d = p.d
    from evidentia.sources.adapters import NAMES

    claims(p)
    p.add("claims_plain", p.parts.pop("claims"))
    p.columns("claims", "claims_plain", keep="query_id, plain", text=f"{d.at(d.strings(NAMES), 'cast(query_id % 10 as int) + 1')} || ' 2020'")
    R.author_source(p)
    return "select query_id, card_id, rank from author_source"


@query
def author_lookup(p):
    R.author_lookup(p)
    return "select query_id, card_id, tier, rank from author_lookup"


@query
def citation_lookup(p):
    R.citation_lookup(p)
    return "select query_id, card_id, tier, rank from citation_lookup"


@query
def section_lookup(p):
    R.section_lookup(p)
    return "select query_id, card_id, tier, rank from section_lookup"


@query
def lookup_scores(p):
    R.author_lookup(p)
    return f"select query_id, card_id, rank, {p.d.round('1e0 / rank', 6)} as score, 'EXACT_LOOKUP' as relationship, 1e0 as confidence from author_lookup"


@query
def vector_cosine(p):
    R.cosine(p)
    return "select query_id, card_id, score, rank from cosine"


@query
def vector_ann_scores(p):
    R.cosine(p, k=10, drop_zero=False)
    return "select query_id, card_id, score, rank from cosine"


@query
def vector_availability(p):
    return f"select c.card_id, case when e.vec_id is null then false else true end as has_vector from {cards(p)} c left join (select distinct vec_id from embeddings) e on e.vec_id = c.card_id"


def fused(p: Pipe) -> str:
    R.bm25(p)
    R.cosine(p)
    R.author_source(p)
    return R.fuse(p, "fused", {"deep_vector": "cosine", "sqlite_fts": "fts", "author_citation": "author_source"})


@query
def reciprocal_rank_fusion(p):
    fused(p)
    return "select query_id, card_id, retrieval_score, best_rank, source_ranks, rank from fused"


@query
def hydrate(p):
    fused(p)
    return f"select f.query_id, f.rank, f.card_id, c.section, c.tag, c.card_name, c.citation, c.author, c.year, c.document, substring(c.body, 1, 500) as body_preview from fused f join {cards(p)} c on c.card_id = f.card_id"


@query
def intent_filters(p):
    K.intent(p, "it", inputs(p))
    fused(p)
    p.add("h", f"select f.query_id, f.card_id, f.rank, c.author, c.card_name, c.year, c.section, c.category, c.topical from fused f join {cards(p)} c on c.card_id = f.card_id")
    return f"select c.query_id, c.card_id, c.rank from h c join it f on f.query_id = c.query_id where {R.matches_filters(p)}"


# ---- reranking ----


def reranked(p: Pipe) -> str:
    fused(p)
    K.claim_features(p)
    K.card_features(p, only="fused")
    return K.full_context(p, "ranked", "fused", "card_features", "claim_features")


SCORES = "relevance_score, topic_match, mech, warrant_match, evidence_strength, confidence, relationship"


@query
def full_context_rerank(p):
    reranked(p)
    return f"select query_id, card_id, {SCORES}, rejection_reason, rerank from ranked"


@query
def match_locations(p):
    reranked(p)
    return f"select query_id, card_id, {sorted_words(p, 'h_tag', 'h_highlight', 'h_body', 'h_citation', 'h_section')} from ranked where rerank <= 10"


@query
def assessment_reasons(p):
    """Why a candidate was scored as it was, in words."""
    reranked(p)
    d = p.d
    said = [f"case when {d.size(f'h_{k}')} > 0 then '{n} matched: ' || {d.join(d.sort(f'h_{k}'), ', ')} end" for k, n in (("tag", "tag"), ("highlight", "highlights"), ("body", "body"), ("citation", "citation"), ("section", "section"))]
    digits = "cast(cast(floor(mech * 1000 + 0.5e0) as int) as varchar(6))"
    said += [f"'mechanism match: ' || case when mech >= 1 then '1.000' else '0.' || lpad({digits}, 3, '0') end", "'relationship: ' || relationship", "case when rejection_reason is not null then 'rejected: ' || rejection_reason end"]
    p.add("why", "select * from ranked where rerank <= 10")
    return f"select query_id, card_id, {d.join(d.not_null(d.array(*said)), '; ')} as reasons from why"


@query
def merge_candidates(p):
    """Cards of one id from several sources: the first source that has a field gives it; zero is not missing."""
    d = p.d
    fused(p)
    of = lambda i, r, keep: f"select s.query_id, s.card_id, {i} as src, {keep} from {r} s join {cards(p)} c on c.card_id = s.card_id"
    p.add("mr", " union all ".join((of(1, "cosine", "'' as tag, c.author as author, case when c.card_id % 4 = 0 then 0 end as year"), of(2, "fts", "c.tag as tag, '' as author, c.year as year"), of(3, "author_source", "'late ' || c.tag as tag, c.author as author, c.year as year"))))
    first = lambda x, there: f"{d.first_by(x, 'src')} filter (where {there})"
    return f"select query_id, card_id, {first('tag', 'tag is not null and tag <> ' + chr(39) * 2)} as tag, {first('author', 'author is not null and author <> ' + chr(39) * 2)} as author, {first('year', 'year is not null')} as year, count(*) as n_sources from mr group by query_id, card_id"


@query
def relevance_gate(p):
    reranked(p)
    K.gate(p, "gated", "ranked")
    return "select query_id, card_id, relevance_score, confidence, gate_reason, gate_reason is null as accepted from gated"


@query
def general_gate(p):
    reranked(p)
    p.add("t", "select *, max(relevance_score) over (partition by query_id) as top from ranked")
    return f"select query_id, card_id, relevance_score, relevance_score >= {R.general_minimum('top')} as accepted from t"


@query
def hybrid_search(p):
    """Flagship: full text, vectors and citations fused, reranked, gated, hydrated."""
    reranked(p)
    K.gate(p, "gated", "ranked")
    p.add("kept", "select query_id, card_id, relevance_score, relationship, confidence, retrieval_score from gated where gate_reason is null")
    R.top(p, "best", "kept", "relevance_score desc, retrieval_score desc, card_id", 10)
    return f"select b.query_id, b.rank, b.card_id, c.tag, c.citation, b.relevance_score, b.relationship, b.confidence, b.retrieval_score from best b join {cards(p)} c on c.card_id = b.card_id"


@query
def simple_rerank(p):
    fused(p)
    K.simple_rerank(p, "simple", "fused")
    return "select query_id, card_id, relevance_score, rank from simple"


@query
def evidence_strength(p):
    p.kept.discard(K.card_features(p))  # read once, and of its columns this one alone: not to be written
    return "select card_id, evidence_strength from card_features"


@query
def reranker_input(p):
    fused(p)
    d = p.d
    nl = d.char(10)
    v = lambda x: f"coalesce({x}, '')"
    cite = "concat_ws(' ', c.card_name, c.author, cast(c.year as varchar(4)), c.citation)"
    text = f" || {nl} || ".join(["'Query:'", "q.text", "''", "'Card:'", "'Section:'", v("c.section"), "''", "'Tag:'", v("c.tag"), "''", "'Citation:'", cite, "''", "'Highlights:'", v("c.highlight"), "''", "'Body:'", v("c.body")])
    return f"select f.query_id, f.card_id, {d.sha256(text)} as input_sha256, cast(length({text}) as int) as input_chars from fused f join {cards(p)} c on c.card_id = f.card_id join {claims(p)} q on q.query_id = f.query_id where f.rank <= 10"


# ---- debate ----


@query
def retrieval_probes(p):
    d = p.d
    p.columns("pq", claims(p), keep="query_id, text", debate_intent=d.at(d.strings(["answer", "turn", "search", "indict"]), "cast(query_id % 4 as int) + 1"))
    B.probes(p, "probes", "pq")
    return "select query_id, ord, kind, probe, channel from probes"


@query
def counterclaims(p):
    return f"select query_id, {B.counterclaim(p.d, 'text')} as counterclaim from {claims(p)}"


@query
def probe_contribution(p):
    d = p.d
    p.columns("pq", claims(p), keep="query_id, text", debate_intent="'answer'")
    B.probes(p, "probes", "pq")
    p.add("lex", "select query_id * 100 + ord as query_id, probe as text from probes where channel in ('both', 'lexical')")
    R.bm25(p, "pf", "lex", k=20)
    p.add("hits", "select cast(floor(query_id / 100) as bigint) as query_id, cast(query_id % 100 as int) as ord, card_id, rank from pf")
    p.add("novel", "select *, row_number() over (partition by query_id, card_id order by ord, rank) as seen from hits")
    return f"select h.query_id, h.ord, q.kind, count(*) as raw_hits, {d.count_if('h.seen = 1')} as new_to_pool from novel h join probes q on q.query_id = h.query_id and q.ord = h.ord group by h.query_id, h.ord, q.kind"


@query
def probe_union(p):
    p.columns("pq", claims(p), keep="query_id, text", debate_intent="'answer'")
    B.probes(p, "probes", "pq")
    p.add("lex", "select query_id * 100 + ord as query_id, probe as text from probes where channel in ('both', 'lexical')")
    R.bm25(p, "pf", "lex", k=20)
    p.add("hits", "select cast(floor(query_id / 100) as bigint) as query_id, cast(query_id % 100 as int) as ord, card_id, rank, bm25 from pf")
    d = p.d
    return f"select query_id, card_id, max(bm25) as best_score, min(ord) as added_by, count(*) as n_probes, {d.join(d.collect('cast(ord as varchar(3))', 'ord'), ',')} as probe_hits from hits group by query_id, card_id"


GOLDEN = (
    ("Congress prevents escalation", "Approval checks slow conflict, but presidents bypass and circumvent it"), ("Aid increases growth", "Aid increases growth and strengthens trade"),
    ("Tariffs cause inflation", "Tariffs do not cause inflation; that claim is wrong"), ("The plan uniquely solves warming", "Warming is solved in the status quo already"),
    ("Deterrence prevents war", "The study's methodology is flawed and assumes deterrence"), ("Sanctions reduce conflict", "Sanctions backfire and conflict increases"),
    ("Trade causes war", "Limits reduce trade frictions and mitigate war"), ("Nuclear power lowers emissions", "Gardens bloom in spring"), ("Courts protect privacy", "Courts review privacy cases in many states"),
    ("", "Anything at all"), ("Subsidies destroy markets", "Subsidies encourage markets"), ("Oversight prevents Trump from escalating nuclear war", "Presidential authorization restricts atomic conflict despite loopholes"),
)


@query
def claim_relationships_golden(p):
    d = p.d
    rows = " union all ".join(f"select {i} as query_id, {d.lit(a)} as text, {i} as card_id, {d.lit(b)} as whole, {d.lit(b)} as front, 0e0 as retrieval_score" for i, (a, b) in enumerate(GOLDEN))
    p.add("golden", rows)
    B.relation_claims(p, "rq", p.add("gq", "select query_id, text from golden"))
    B.relation_texts(p, "rc", p.add("gc", "select card_id, whole, front from golden"), single=True)
    B.relationships(p, "rel", p.add("gp", "select query_id, card_id, retrieval_score from golden"), "rq", "rc", single=True)
    return "select query_id, claim_relationship, claim_conf, claim_overlap, claim_mech, claim_direct, coverage, attack, source_quality, rule from rel"


def related(p: Pipe, k: int = 10) -> str:
    R.bm25(p, k=k)
    d = p.d
    p.add("pairs", f"select query_id, card_id, {d.round('bm25 / (1e0 + bm25)')} as retrieval_score from fts")
    p.columns("cq", claims(p), keep="query_id, text", debate_intent=d.at(d.strings(["answer", "their_evidence", "compare", "turn", "indict", "search"]), "cast(query_id % 6 as int) + 1"))
    B.relation_claims(p, "rq", "cq")
    B.relation_cards(p, "rc", "pairs")
    return B.relationships(p, "rel", "pairs", "rq", "rc")


@query
def claim_relationships(p):
    related(p)
    return "select query_id, card_id, claim_relationship, claim_conf, claim_overlap, claim_mech, claim_direct from rel"


@query
def slot_coverage(p):
    related(p)
    return f"select query_id, card_id, k_subject, k_relation, k_target_actor, k_target_action, k_target_object, k_effect, coverage, source_quality, attack, {p.d.join('warnings', '; ')} as warnings from rel"


def laned(p: Pipe) -> str:
    related(p)
    K.claim_features(p, source="cq")
    K.card_features(p, only="pairs")
    K.full_context(p, "ranked", "pairs", "card_features", "claim_features")
    return B.lanes(p, "lanes", "rel", "ranked")


@query
def side_lanes(p):
    laned(p)
    return "select query_id, lane, lane_rank, card_id, owner, claim_relationship, lane_score from lanes where lane_rank is not null"


@query
def lane_audit(p):
    laned(p)
    return "select query_id, card_id, lane, owner, eligible, accepted, reason, u_owner, u_relation, lane_score from lanes"


@query
def lane_funnel(p):
    laned(p)
    d = p.d
    return f"select lane, reason, count(*) as n, {d.count_if('eligible')} as n_eligible, {d.count_if('accepted')} as n_accepted from lanes group by lane, reason"


# ---- store, bundle, evaluation: see operators.store ----

for _name, _f in S.QUERIES.items():
    _f.__name__ = _name
    query(_f)
