"""Retrieval: full-text, direct lookups, vectors, fusion, filters. Each function adds relations to a Pipe.

Relations are batches: ``claims(query_id, text)`` against ``cards``. Ranks are per query, ties go to the
smaller card_id. Ids and ranks travel narrow; card text is joined last.
"""

from __future__ import annotations

from evidentia.functions.dialect import Pipe
from evidentia.functions.stem import add_stems
from evidentia.operators import scoring
from evidentia.sources.adapters import cards, claims

WORD = r"[\p{L}\p{N}][\p{L}\p{N}\x{300}-\x{331}]*"
FIELDS = ("tag", "card_name", "citation", "body")
RRF_K = 60


def top(p: Pipe, name: str, source: str, order: str, k: int, by: str = "query_id", rank: str = "rank", keep: str = "*") -> str:
    """The first k rows of each group, numbered from 1."""
    p.add(f"{name}_all", f"select {keep}, cast(row_number() over (partition by {by} order by {order}) as int) as {rank} from {source}")
    return p.add(name, f"select * from {name}_all where {rank} <= {k}")


# ---- full text ----


def advanced(p: Pipe, x: str) -> str:
    """Whether a query is in the full-text query language (else it is plain words)."""
    d = p.d
    return "(" + " or ".join(d.contains(x, d.lit(s)) for s in ('"', " OR ", " AND ", " NOT ", "NEAR")) + ")"


def plain_terms(p: Pipe, x: str) -> str:
    """Words of a plain query, repeats kept; an apostrophe separates, as in the index."""
    return p.d.find_all(f"lower({x})", "[a-z0-9]+")


def index_terms(p: Pipe, name: str = "doc_terms") -> str:
    """Words of each card over tag, card_name, citation and body, with its length."""
    d = p.d
    text = f"concat_ws(' ', {', '.join(FIELDS)})"
    p.columns(f"{name}_0", cards(p), keep="card_id", words=d.find_all(f"lower({text})", WORD))
    return p.keep(p.columns(name, f"{name}_0", dl=d.size("words")))


def vocabulary(p: Pipe) -> str:
    """(word, folded, stem) of every distinct word of the cards."""
    if "vocabulary" not in p.parts:
        docs = index_terms(p)
        p.add("vocabulary_each", p.d.explode(docs, p.d.distinct("words"), "word", "card_id"))
        p.add("vocabulary_words", "select distinct word from vocabulary_each")
        p.keep(add_stems(p, "vocabulary", "vocabulary_words"))
    return "vocabulary"


def query_stems(p: Pipe, name: str, source: str, text: str = "text") -> str:
    """(query_id, stem, m): the stems of each plain query's words and how often they stand in it."""
    p.columns(f"{name}_0", source, keep="query_id", terms=plain_terms(p, text))
    p.add(f"{name}_1", p.d.explode(f"{name}_0", "terms", "word", "query_id"))
    p.add(f"{name}_2", f"select distinct word from {name}_1")
    add_stems(p, f"{name}_3", f"{name}_2")
    return p.keep(p.add(name, f"select q.query_id, s.stem, count(*) as m from {name}_1 q join {name}_3 s on s.word = q.word group by q.query_id, s.stem"))


def term_weight(tf: str, df: str, dl: str = "o.dl", stats: str = "s") -> str:
    """A term's share of a card's rank: inverse document frequency times saturated frequency."""
    idf = f"ln(({stats}.n - {df} + 0.5e0) / ({df} + 0.5e0))"
    return f"(case when {idf} <= 0 then 1e-6 else {idf} end) * {tf} * 2.2e0 / ({tf} + 1.2e0 * (0.25e0 + 0.75e0 * {dl} / {stats}.avgdl))"


def bm25(p: Pipe, name: str = "fts", source: str | None = None, k: int = 50, text: str = "text") -> str:
    """(query_id, card_id, bm25, n_matched, n_terms, rank): AND hits if a query has any, else OR hits. Terms are stems; a repeated word counts as often."""
    d = p.d
    docs, source = index_terms(p), source or claims(p)
    query_stems(p, f"{name}_q", source, text)
    p.add(f"{name}_n", f"select query_id, count(*) as n_terms from {name}_q group by query_id")
    # the vocabulary's words that share a stem with a query's, so that postings are cut to them before anything is counted
    p.add(f"{name}_wanted", f"select v.word, v.stem from {vocabulary(p)} v join (select distinct stem from {name}_q) q on v.stem = q.stem")
    if d.name == "spark":  # the same relations would hold each query's row of each card; of these only the best are made
        p.keep(p.make(f"{name}_hits", lambda of: scoring.best_hits(of(docs), of(f"{name}_q").withColumnRenamed("stem", "term"), of(f"{name}_wanted").withColumnRenamed("stem", "term"), k)))
    else:
        p.add(f"{name}_stats", f"select count(*) as n, avg(dl) as avgdl from {docs}")
        p.add(f"{name}_words", d.explode(docs, "words", "word", "card_id, dl"))
        p.keep(p.add(f"{name}_post", f"select w.card_id, q.stem, count(*) as tf, max(w.dl) as dl from {name}_words w join {name}_wanted q on w.word = q.word group by w.card_id, q.stem"))
        p.add(f"{name}_df", f"select stem, count(*) as df from {name}_post group by stem")
        weight = term_weight("o.tf", "f.df")
        p.keep(
            p.add(
                f"{name}_hits",
                f"select q.query_id, o.card_id, {d.round(f'sum(q.m * ({weight}))', 6)} as bm25, count(*) as n_matched, max(n.n_terms) as n_terms "
                f"from {name}_q q join {name}_n n on n.query_id = q.query_id join {name}_post o on q.stem = o.stem join {name}_df f on f.stem = o.stem cross join {name}_stats s group by q.query_id, o.card_id",
            )
        )
    p.add(f"{name}_mode", f"select query_id, max(case when n_matched = n_terms then 1 else 0 end) as has_and from {name}_hits group by query_id")
    p.add(f"{name}_kept", f"select h.query_id, h.card_id, h.bm25, cast(h.n_matched as int) as n_matched, cast(h.n_terms as int) as n_terms from {name}_hits h join {name}_mode x on x.query_id = h.query_id where x.has_and = 0 or h.n_matched = h.n_terms")
    return p.keep(top(p, name, f"{name}_kept", "bm25 desc, card_id", k))


def prefix_hits(p: Pipe, name: str, every: bool, k: int = 20) -> str:
    """(query_id, card_id, n_terms, score, rank): cards by how many query terms begin one of their stems; ``every``: all of the query's, and ranked by full-text weight."""
    d = p.d
    p.columns(f"{name}_q0", claims(p), keep="query_id", terms=d.filter(plain_terms(p, "text"), "t", "length(t) >= 2"))
    p.add(f"{name}_q1", d.explode(f"{name}_q0", "terms", "word", "query_id"))
    p.add(f"{name}_q2", f"select distinct word from {name}_q1")
    add_stems(p, f"{name}_q3", f"{name}_q2")
    # kept: a filter on the term would otherwise be pushed through all steps of its stem, whose expression doubles at each
    p.keep(p.add(f"{name}_q", f"select distinct q.query_id, s.stem as term from {name}_q1 q join {name}_q3 s on s.word = q.word"))
    # a stem's beginnings of the lengths that occur meet the terms by equality
    p.add(f"{name}_lengths", f"select distinct length(term) as n from {name}_q")
    p.add(f"{name}_starts", f"select v.word, left(v.stem, l.n) as start from {vocabulary(p)} v join {name}_lengths l on length(v.stem) >= l.n")
    p.add(f"{name}_m", f"select t.term, s.word from {name}_starts s join (select distinct term from {name}_q) t on s.start = t.term")
    if d.name == "spark":  # as in bm25
        want = "all" if every else "any"
        p.make(f"{name}_best", lambda of: scoring.best_hits(of("doc_terms"), of(f"{name}_q").selectExpr("query_id", "term", "1 as m"), of(f"{name}_m"), k, want))
        p.add(f"{name}_h", f"select query_id, card_id, cast(n_matched as int) as n_terms, n_terms as n_all, bm25 from {name}_best")
    else:
        p.add(f"{name}_w", d.explode(index_terms(p), "words", "word", "card_id, dl"))
        p.keep(p.add(f"{name}_post", f"select m.term, w.card_id, count(*) as tf, max(w.dl) as dl from {name}_w w join {name}_m m on w.word = m.word group by m.term, w.card_id"))
        p.add(f"{name}_df", f"select term, count(*) as df from {name}_post group by term")
        p.add(f"{name}_stats", "select count(*) as n, avg(dl) as avgdl from doc_terms")
        p.add(f"{name}_n", f"select query_id, count(*) as n_all from {name}_q group by query_id")
        weight = term_weight("o.tf", "f.df")
        p.add(f"{name}_h", f"select q.query_id, o.card_id, cast(count(*) as int) as n_terms, max(n.n_all) as n_all, {d.round(f'sum({weight})', 6)} as bm25 from {name}_q q join {name}_n n on n.query_id = q.query_id join {name}_post o on o.term = q.term join {name}_df f on f.term = o.term cross join {name}_stats s group by q.query_id, o.card_id")
    p.add(f"{name}_s", f"select query_id, card_id, n_terms, bm25, {d.round('1e0 / (1e0 + bm25)', 6)} as score from {name}_h{' where n_terms = n_all' if every else ''}")
    return top(p, name, f"{name}_s", "bm25 desc, card_id", k)


def rank_score(p: Pipe, x: str) -> str:
    """The score of a full-text rank: better ranks are more negative."""
    d = p.d
    return f"(case when {x} = 0 then 1e0 when {x} < 0 then greatest({d.round(f'abs({x}) / (1e0 + abs({x}))')}, 0.001e0) else greatest({d.round(f'1e0 / (1e0 + {x})')}, 0.001e0) end)"


# ---- direct lookups ----


def author_source(p: Pipe, name: str = "author_source", k: int = 20) -> str:
    """Cards where any word of the query stands in author, card_name or citation, in document order."""
    d = p.d
    p.columns(f"{name}_q0", claims(p), keep="query_id", terms=d.find_all("text", "[A-Za-z0-9']+"))
    p.add(f"{name}_q", "select distinct query_id, lower(term) as term from (" + d.explode(f"{name}_q0", "terms", "term", "query_id") + ") x")
    p.columns(f"{name}_bib", cards(p), keep="card_id, order_index, para", bib="lower(concat_ws(' | ', author, card_name, citation))")
    if d.name == "spark":
        return _author_source_by_words(p, name, k)
    # words are matched once per distinct bibliographic text, which repeats over cards
    p.add(f"{name}_texts", f"select distinct bib from {name}_bib where bib <> ''")
    p.add(f"{name}_hit", f"select distinct q.query_id, t.bib from {name}_q q join {name}_texts t on {d.contains('t.bib', 'q.term')}")
    p.add(f"{name}_rows", f"select h.query_id, b.card_id, b.order_index, b.para from {name}_hit h join {name}_bib b on h.bib = b.bib")
    return top(p, name, f"{name}_rows", "order_index, para, card_id", k)


def _author_source_by_words(p: Pipe, name: str, k: int) -> str:
    """The same rows: a term stands in a text where it stands in one of its words, and the first k cards of a query are among the first k of a term's, and these among the first k of a word's."""
    d, card, order = p.d, "bib, card_id, order_index, para, copies", "order_index, para, card_id"
    p.add(f"{name}_cards", f"select bib, card_id, order_index, para, count(*) as copies from {name}_bib where bib <> '' group by bib, card_id, order_index, para")
    p.add(f"{name}_w", d.explode(f"{name}_cards", d.distinct(d.find_all("bib", "[a-z0-9']+")), "word", card))
    p.keep(top(p, f"{name}_word", f"{name}_w", order, k, by="word"))
    p.add(f"{name}_m", f"select t.term, w.word from (select distinct term from {name}_q) t join (select distinct word from {name}_word) w on {d.contains('w.word', 't.term')}")
    p.add(f"{name}_t", f"select distinct m.term, {', '.join('w.' + c for c in card.split(', '))} from {name}_m m join {name}_word w on w.word = m.word")
    top(p, f"{name}_term", f"{name}_t", order, k, by="term")
    p.add(f"{name}_once", f"select distinct q.query_id, {', '.join('t.' + c for c in card.split(', '))} from {name}_q q join {name}_term t on t.term = q.term")
    p.add(f"{name}_rows", d.explode(f"{name}_once", "sequence(1L, copies)", "copy", "query_id, card_id, order_index, para"))
    return top(p, name, f"{name}_rows", order, k, keep="query_id, card_id, order_index, para")


def lookup_requests(p: Pipe, name: str = "requests") -> str:
    """(query_id, want_author, want_year, want_section): direct lookups drawn from the claims' ids."""
    d = p.d
    from evidentia.sources.adapters import NAMES

    names = d.strings(NAMES)
    return p.columns(
        name, claims(p), keep="query_id", want_author=f"{d.at(names, 'cast(query_id % 10 as int) + 1')}", want_year="cast(1980 + query_id % 45 as int)", want_section="'SRC' || cast(query_id % 20 as varchar(4))"
    )


def author_lookup(p: Pipe, name: str = "author_lookup", k: int = 20) -> str:
    d = p.d
    hay = "lower(concat_ws(' | ', c.author, c.card_name, c.citation))"
    tier = f"case when lower(c.author) = lower(r.want_author) then 0 when {d.starts('lower(c.card_name)', 'lower(r.want_author)')} then 1 else 2 end"
    p.add(f"{name}_rows", f"select r.query_id, c.card_id, {tier} as tier, c.order_index, c.para from {lookup_requests(p)} r join {cards(p)} c on {d.contains(hay, 'lower(r.want_author)')}")
    return top(p, name, f"{name}_rows", "tier, order_index, para, card_id", k)


def citation_lookup(p: Pipe, name: str = "citation_lookup", k: int = 20) -> str:
    """Exact labels or (author, year) first; similar ones only for queries without any exact hit."""
    d = p.d
    short = "lpad(cast(r.want_year % 100 as varchar(4)), 2, '0')"
    a = "lower(r.want_author)"
    labels = ", ".join(f"{a} || {x}" for x in (f"' ' || {short}", "' ' || cast(r.want_year as varchar(4))", f"{d.lit(' ' + chr(39))} || {short}", f"' ’' || {short}"))
    exact = f"(lower(c.card_name) in ({labels}) or (lower(c.author) = {a} and c.year = r.want_year))"
    name_like = d.ilike("c.card_name", f"'%' || r.want_author || '%' || {short} || '%'")
    loose = f"(({d.contains(chr(40) + 'lower(concat_ws(' + chr(39) + ' | ' + chr(39) + ', c.author, c.card_name, c.citation))' + chr(41), a)} and c.year = r.want_year) or {name_like})"
    tier = f"case when {exact} then 0 when lower(c.author) = {a} and c.year = r.want_year then 1 when {name_like} then 2 else 3 end"
    p.add(f"{name}_rows", f"select r.query_id, c.card_id, {tier} as tier, {exact} as is_exact, c.order_index, c.para from {lookup_requests(p)} r join {cards(p)} c on {exact} or {loose}")
    p.keep(f"{name}_rows")
    p.add(f"{name}_best", f"select query_id, max(case when is_exact then 1 else 0 end) as any_exact from {name}_rows group by query_id")
    p.add(f"{name}_kept", f"select r.query_id, r.card_id, r.tier, r.order_index, r.para from {name}_rows r join {name}_best b on b.query_id = r.query_id where b.any_exact = 0 or r.is_exact")
    return top(p, name, f"{name}_kept", "tier, order_index, para, card_id", k)


def section_lookup(p: Pipe, name: str = "section_lookup", k: int = 50) -> str:
    d = p.d
    pattern = "'%' || r.want_section || '%'"
    p.add(
        f"{name}_rows",
        f"select r.query_id, c.card_id, case when lower(c.section) = lower(r.want_section) then 0 else 1 end as tier, c.para from {lookup_requests(p)} r join {cards(p)} c on {d.ilike('c.section', pattern)}",
    )
    return top(p, name, f"{name}_rows", "tier, para, card_id", k)


# ---- vectors ----


def cosine(p: Pipe, name: str = "cosine", k: int = 50, drop_zero: bool = True) -> str:
    """(query_id, card_id, score, rank): exact cosine, negative ones as 0; a length mismatch or a zero vector scores 0.

    Query vectors are those whose id is a claim's; candidates are all vectors.
    """
    d = p.d
    p.columns(f"{name}_v", "embeddings", keep="vec_id", v=d.doubles("embedding"))
    p.columns(f"{name}_n", f"{name}_v", norm=f"sqrt({d.dot('v', 'v')})")
    p.add(f"{name}_q", f"select n.vec_id as query_id, n.v, n.norm from {name}_n n join (select query_id from {claims(p)}) c on c.query_id = n.vec_id")
    fits = f"{d.size('q.v')} = {d.size('n.v')} and q.norm > 0 and n.norm > 0"
    score = d.round(f"case when {fits} then greatest(0e0, {d.dot('q.v', 'n.v')} / (q.norm * n.norm)) else 0e0 end")
    if d.name == "spark":  # all pairs too, of which only the best are made rows
        p.make(f"{name}_rows", lambda of: scoring.nearest(of(f"{name}_n"), of(f"{name}_q"), k, drop_zero))
    else:
        p.add(f"{name}_rows", f"select q.query_id, n.vec_id as card_id, {score} as score from {name}_q q cross join {name}_n n")
    source = p.add(f"{name}_pos", f"select * from {name}_rows where score > 0") if drop_zero else f"{name}_rows"
    return top(p, name, source, "score desc, card_id", k)


# ---- fusion ----


def fuse(p: Pipe, name: str, sources: dict[str, str], k: int = RRF_K, limit: int = 50) -> str:
    """Reciprocal rank fusion of ranked relations (query_id, card_id, rank), in the given source order."""
    d = p.d
    rows = " union all ".join(f"select query_id, card_id, rank, {i} as src, {d.lit(s)} as source from {r}" for i, (s, r) in enumerate(sources.items()))
    p.add(f"{name}_rows", rows)
    p.add(f"{name}_best", f"select query_id, card_id, src, source, min(rank) as rank from {name}_rows group by query_id, card_id, src, source")
    p.add(
        f"{name}_sum",
        f"select query_id, card_id, {d.round(f'sum(1e0 / ({k} + rank))', 6)} as retrieval_score, min(rank) as best_rank, min(src * 1000000 + rank) as seen, {d.join(d.collect(chr(40) + 'source || ' + d.lit(':') + ' || cast(rank as varchar(9))' + chr(41), 'source'), ',')} as source_ranks from {name}_best group by query_id, card_id",
    )
    return p.keep(top(p, name, f"{name}_sum", "retrieval_score desc, best_rank, seen, card_id", limit))


# ---- filters ----


def matches_filters(p: Pipe, c: str = "c", f: str = "f") -> str:
    """A card against an intent's filters; a null filter lets everything through."""
    d = p.d
    return " and ".join(
        (
            f"({f}.author_filter is null or {d.contains(f'lower(coalesce({c}.author, {d.lit(str())}))', f'lower({f}.author_filter)')} or {d.contains(f'lower(coalesce({c}.card_name, {d.lit(str())}))', f'lower({f}.author_filter)')})",
            f"({f}.year_min is null or coalesce({c}.year >= {f}.year_min, false))",
            f"({f}.year_max is null or coalesce({c}.year <= {f}.year_max, false))",
            f"({f}.section_filter is null or {d.contains(f'lower({c}.section)', f'lower({f}.section_filter)')})",
            f"({f}.category_filter is null or lower(coalesce({c}.category, '')) = lower({f}.category_filter))",
            f"({f}.topical_filter is null or coalesce({c}.topical = {f}.topical_filter, false))",
        )
    )


def general_minimum(x: str) -> str:
    """The least score that is accepted beside a top score x."""
    return f"greatest(0.18e0, case when {x} >= 0.75e0 then {x} * 0.35e0 when {x} >= 0.45e0 then {x} * 0.45e0 else {x} * 0.7e0 end)"
