"""Store, index maintenance, bundles and evaluation as relations over the adapters' cards."""

from __future__ import annotations

from evidentia.functions import text as T
from evidentia.functions.dialect import Pipe
from evidentia.operators import retrieval as R
from evidentia.operators import scoring
from evidentia.sources.adapters import cards, claims

QUERIES: dict = {}


def _register(f):
    QUERIES[f.__name__] = f
    return f


def spans(p: Pipe) -> str:
    """Highlight runs of a card: its lines, with formatting that repeats on neighbours."""
    d = p.d
    p.columns("sp0", cards(p), keep="card_id", lines=d.split("body", "\n"))
    p.add("sp1", d.explode("sp0", d.seq("1", d.size("lines")), "order_index", "card_id, lines"))
    return p.columns(
        "spans",
        "sp1",
        keep="card_id, cast(order_index as int) as order_index",
        text=d.at("lines", "cast(order_index as int)"),
        color="case cast(floor((order_index - 1) / 2.0) as int) % 3 when 0 then 'yellow' when 1 then 'green' else 'cyan' end",
        paragraph_index="cast(floor((order_index - 1) / 3.0) as int)",
        bold="(order_index % 5) = 0",
        font_size="case when order_index % 7 = 0 then 11e0 else 12e0 end",
    )


def merged_spans(p: Pipe, name: str = "merged") -> str:
    """Adjacent runs of the same colour, paragraph, size and weight joined by a space; blank runs skipped."""
    d = p.d
    p.columns(f"{name}_0", spans(p), keep="card_id, order_index, color, paragraph_index, bold, font_size", text=d.squeeze("text"))
    p.add(f"{name}_1", f"select * from {name}_0 where text <> ''")
    same = " and ".join(f"lag({c}) over w is not distinct from {c}" for c in ("color", "paragraph_index", "bold", "font_size"))
    p.add(f"{name}_2", f"select *, case when {same} then 0 else 1 end as starts from {name}_1 window w as (partition by card_id order by order_index)")
    p.add(f"{name}_3", f"select *, sum(starts) over (partition by card_id order by order_index rows between unbounded preceding and current row) as island from {name}_2")
    return p.add(name, f"select card_id, cast(island as int) as island, min(order_index) as order_index, min(color) as color, min(paragraph_index) as paragraph_index, {d.join(d.collect('text', 'order_index'), ' ')} as text from {name}_3 group by card_id, island")


@_register
def highlight_merge(p):
    merged_spans(p)
    return "select card_id, island, order_index, color, paragraph_index, text from merged"


@_register
def highlight_group_concat(p):
    d = p.d
    spans(p)
    return f"select c.card_id, coalesce(h.n, 0) as n_spans, {d.sha256('coalesce(h.text, ' + chr(39) * 2 + ')')} as text_sha256 from {cards(p)} c left join (select card_id, count(*) as n, {d.join(d.collect('text', 'order_index'), ' ')} as text from spans group by card_id) h on h.card_id = c.card_id"


def sections(p: Pipe) -> str:
    """(section, argument_type, order_index): distinct sections."""
    d = p.d
    kind = f"case when {d.starts('lower(section)', d.lit('at:'))} then 'answer_to' when {d.starts('lower(section)', d.lit('ov'))} or {d.contains('lower(section)', d.lit('overview'))} then 'overview' else 'argument' end"
    return p.add("sections", f"select section, min(order_index) as order_index, count(*) as n_cards, {kind} as argument_type from {cards(p)} group by section")


@_register
def card_join(p):
    sections(p)
    return "select c.card_id, s.section, s.argument_type, s.order_index, c.document, c.tag, c.author, c.year, substring(c.body, 1, 500) as body_preview from cards c join sections s on s.section = c.section"


@_register
def argument_types(p):
    d = p.d
    p.columns("t", cards(p), keep="card_id", title=f"{d.at(d.strings(['AT: ', 'OV ', 'The overview of ', 'Case ']), 'cast(card_id % 4 as int) + 1')} || section")
    return f"select card_id, case when {d.starts('lower(title)', d.lit('at:'))} then 'answer_to' when {d.starts('lower(title)', d.lit('ov'))} or {d.contains('lower(title)', d.lit('overview'))} then 'overview' else 'argument' end as argument_type from t"


@_register
def row_counts(p):
    sections(p)
    return "select 'cards' as tbl, count(*) as n from cards union all select 'sections', count(*) from sections union all select 'documents', count(distinct document) from cards union all select 'citations', count(citation) from cards union all select 'highlights', count(*) from (select card_id from cards where highlight <> '') h"


@_register
def round_cards(p):
    d = p.d
    needle = "'%the%'"
    hit = " or ".join(d.ilike(f"coalesce({x}, '')", needle) for x in ("tag", "card_name", "body", "citation"))
    scope = "case when side = 'ours' then 'ours' when side = 'opponent' then 'opponent' end"
    p.add("rc", f"select card_id, {scope} as scope, order_index, para from {cards(p)} where ({hit})")
    p.add("rs", "select * from rc where scope is not null")
    R.top(p, "rt", "rs", "order_index, para, card_id", 25, by="scope")
    return "select scope, card_id, rank from rt"


@_register
def round_labels(p):
    R.author_lookup(p)
    return f"select a.query_id, a.card_id, case when a.tier = 0 then 'EXACT' when c.side = 'opponent' then 'OPPONENT' else 'ANSWER' end as label, greatest({p.d.round('1e0 / a.rank')}, 0.45e0) as score from author_lookup a join {cards(p)} c on c.card_id = a.card_id"


@_register
def recent_cards(p):
    d = p.d
    p.add("x", f"select 1 as one, card_id, order_index, para from {cards(p)}")
    R.top(p, "y", "x", "order_index, para, card_id", 100, by="one")
    return "select card_id, rank from y"


@_register
def demo_topk(p):
    R.bm25(p)
    p.add("x", f"select f.query_id, f.card_id, f.bm25, row_number() over (partition by f.query_id, c.section, c.tag order by f.bm25 desc, f.card_id) as copy from fts f join {cards(p)} c on c.card_id = f.card_id")
    p.add("y", "select query_id, card_id, bm25 from x where copy = 1")
    R.top(p, "z", "y", "bm25 desc, card_id", 5)
    return "select query_id, card_id, bm25, rank from z"


# ---- embedding texts and index state ----


def embedding_texts(p: Pipe) -> str:
    """(card_id, kind, text): non-empty parts joined by a blank line."""
    nl = f"{p.d.char(10)} || {p.d.char(10)}"
    part = lambda *xs: f"concat_ws({nl}, " + ", ".join(f"nullif({x}, '')" for x in xs) + ")"
    c = cards(p)
    return p.add("emb", f"select card_id, 'fast' as kind, {part('section', 'tag', 'highlight')} as text from {c} union all select card_id, 'deep', {part('section', 'tag', 'citation', 'highlight', 'body')} from {c}")


@_register
def embedding_text(p):
    embedding_texts(p)
    return f"select card_id, kind, cast(length(text) as int) as n_chars, {p.d.sha256('text')} as source_text_hash from emb"


@_register
def clip_text(p):
    """Cut at a paragraph break, else a sentence break, if that keeps half; else a hard cut."""
    d, n = p.d, 1000
    embedding_texts(p)
    nl = f"{d.char(10)} || {d.char(10)}"
    head = f"substring(text, 1, {n})"
    p.columns("cl0", "emb", keep="card_id, kind, length(text) as n", head=head, back=f"reverse({head})")
    pos = lambda sep: f"(case when {d.contains('back', sep)} then length(head) - {'locate(' + sep + ', back)' if d.name == 'spark' else 'strpos(back, ' + sep + ')'} - 1 else -1 end)"
    p.columns("cl1", "cl0", para=pos(nl), sent=pos("' .'"))
    cut = f"case when n <= {n} then n when para >= {n // 2} then para when sent >= {n // 2} then sent + 1 else {n} end"
    return f"select card_id, kind, cast({cut} as int) as kept_chars, {d.sha256(f'substring(head, 1, cast({cut} as int))')} as clipped_sha256 from cl1"


def index_state(p: Pipe) -> str:
    """(card_id, kind, stored_hash): an index that lags behind: some cards changed, some are new, some are gone."""
    embedding_texts(p)
    h = p.d.sha256("text")
    return p.add(
        "state",
        f"select card_id, kind, case when card_id % 13 = 4 then {p.d.sha256('text || ' + chr(39) + 'old' + chr(39))} else {h} end as stored_hash from emb where card_id % 17 <> 6 union all select card_id + 100000000, kind, {h} from emb where card_id % 19 = 2",
    )


@_register
def changed_records(p):
    index_state(p)
    return f"select e.card_id, e.kind, case when s.card_id is null then 'new' else 'changed' end as change from emb e left join state s on s.card_id = e.card_id and s.kind = e.kind where s.stored_hash is distinct from {p.d.sha256('e.text')}"


@_register
def stale_ids(p):
    index_state(p)
    return "select s.card_id, s.kind from state s left anti join emb e on e.card_id = s.card_id and e.kind = s.kind" if p.d.name == "spark" else "select s.card_id, s.kind from state s anti join emb e on e.card_id = s.card_id and e.kind = s.kind"


@_register
def state_upsert(p):
    index_state(p)
    p.add("both_states", f"select card_id, kind, {p.d.sha256('text')} as hash, 1 as gen from emb union all select card_id, kind, stored_hash, 0 from state")
    p.add("latest", "select *, row_number() over (partition by card_id, kind order by gen desc) as age from both_states")
    return "select card_id, kind, hash, gen from latest where age = 1"


@_register
def index_run_log(p):
    index_state(p)
    h = p.d.sha256("e.text")
    return (
        f"select e.kind, count(*) as live, {p.d.count_if('s.card_id is null')} as added, {p.d.count_if(f's.card_id is not null and s.stored_hash <> {h}')} as updated, {p.d.count_if(f's.stored_hash = {h}')} as skipped "
        "from emb e left join state s on s.card_id = e.card_id and s.kind = e.kind group by e.kind"
    )


@_register
def content_hash(p):
    v = lambda x: f"coalesce(cast({x} as {'string' if p.d.name == 'spark' else 'varchar'}), '')"
    joined = f" || {p.d.char(10)} || ".join(v(x) for x in ("section", "tag", "card_name", "argument_name", "body", "citation", "author", "year", "highlight"))
    return f"select card_id, {p.d.sha256(joined)} as content_hash from {cards(p)}"


@_register
def document_upsert(p):
    """Cards after one document is replaced: its old rows go, the new ones come."""
    p.add("incoming", f"select card_id, section, document, 'new ' || tag as tag from {cards(p)} where document = 'src1' and card_id % 2 = 0")
    anti = "left anti join" if p.d.name == "spark" else "anti join"
    p.add("stay", f"select c.card_id, c.section, c.document, c.tag from {cards(p)} c {anti} (select distinct document from incoming) i on i.document = c.document")
    return "select card_id, section, document, tag from stay union all select card_id, section, document, tag from incoming"


@_register
def two_packets(p):
    c = cards(p)
    return f"select card_id, 'us' as owner, 'ours' as packet from {c} where card_id % 2 = 0 union all select card_id, 'opponent', 'theirs' from {c} where card_id % 2 = 1"


@_register
def json_metadata(p):
    d = p.d
    doc = "case when card_id % 6 = 5 then '{broken' else '{\"section\": \"' || section || '\", \"n\": ' || cast(card_id as varchar(12)) || '}' end"
    p.columns("m", cards(p), keep="card_id", j=doc)
    ok = "case when json_valid(j) then j else '{}' end" if d.name == "duckdb" else "coalesce(case when j like '{%}' then j end, '{}')"
    p.columns("m2", "m", k=ok)
    return f"select card_id, {d.json_text('k', 'section')} as section, {d.json_text('k', 'n')} as n from m2"


@_register
def json_vectors(p):
    d = p.d
    text = f"'[' || {d.join(d.map('embedding', 'x', 'cast(cast(floor(x * 1000) as int) as varchar(12))'), ',')} || ']'"
    p.columns("jv", "embeddings", keep="vec_id", j=f"case when vec_id % 9 = 0 then '[1, 2,' else {text} end")
    back = "coalesce(from_json(j, 'array<double>'), cast(array() as array<double>))" if d.name == "spark" else "case when json_valid(j) then cast(cast(j as json) as double[]) else [] end"
    p.columns("jw", "jv", v=back if d.name == "duckdb" else f"case when vec_id % 9 = 0 and not j like '%]' then cast(array() as array<double>) else {back} end")
    return f"select vec_id, cast({d.size('v')} as int) as dim, {d.round(d.dot('v', 'v'), 3)} as square from jw"


# ---- citations and titles ----


@_register
def citation_parse(p):
    """Author (last word of the first chunk), year, label and first address of a raw citation."""
    d = p.d
    raw = "case card_id % 4 when 0 then 'Jane ' || coalesce(author, 'Doe') || ', ' || cast(coalesce(year, 1999) as varchar(4)) || ', https://site.example/a' when 1 then coalesce(author, 'Roe') || ' 07, Review' when 2 then 'No year here' else '' end"
    p.columns("cp0", cards(p), keep="card_id", raw=raw)
    p.columns("cp1", "cp0", head=f"trim({d.at(d.split('raw', ','), '1')})", url=f"nullif({d.extract('raw', r'https?://[^\s,]+', 0)}, '')", y4=f"nullif({d.extract('raw', r'\b(1[6-9][0-9]{2}|2[0-2][0-9]{2})\b', 1)}, '')", y2=f"nullif({d.extract('raw', r'\b([0-9]{2})\b', 1)}, '')")
    p.columns("cp2", "cp1", name_words=d.find_all("head", "[A-Za-z][A-Za-z-]*"), yr="case when y4 is not null then cast(y4 as int) when y2 is not null and cast(y2 as int) < 70 then 2000 + cast(y2 as int) when y2 is not null then 1900 + cast(y2 as int) end")
    p.columns("cp3", "cp2", who=d.at("name_words", f"cast(nullif({d.size('name_words')}, 0) as int)"))
    return "select card_id, who as author, yr as year, url, case when who is not null and yr is not null then who || ' ' || lpad(cast(yr % 100 as varchar(4)), 2, '0') end as label from cp3"


@_register
def spacing_repair(p):
    d = p.d
    messy = "'  ( ' || section || ' )  , ' || tag || '  !'"
    p.columns("sr", cards(p), keep="card_id", t=messy)
    fixed = d.swap(d.swap(d.squeeze("t"), r" ([,.;:!?\)])", "$1"), r"([\(]) ", "$1")
    return f"select card_id, {fixed} as fixed from sr"


@_register
def card_titles(p):
    d = p.d
    y = "cast(year as varchar(4))"
    return f"select card_id, case when author is not null and year is not null then case when {d.contains('author', y)} then author else author || ' ' || {y} end when author is not null then author else substring(coalesce(citation, 'Untitled'), 1, 80) end as title from {cards(p)}"


@_register
def evidence_keys(p):
    return f"select case when citation is not null then 'content:' || coalesce(card_name, '') || '|' || citation || '|' || tag else 'id:' || cast(card_id as varchar(12)) end as evidence_key, count(*) as n_cards, min(card_id) as first_card from {cards(p)} group by 1"


@_register
def enum_normalise(p):
    p.add("raw_enums", f"select card_id, lower(trim(coalesce(side, ''))) as s from {cards(p)}")
    return "select card_id, case s when 'ours' then 'us' when 'we' then 'us' when 'them' then 'opponent' when 'their' then 'opponent' when 'opponent' then 'opponent' when 'aff' then 'unknown' else 'unknown' end as owner, case s when 'aff' then 'affirmative' when 'pro' then 'affirmative' when 'neg' then 'negative' when 'con' then 'negative' else 'unknown' end as formal_side from raw_enums"


# ---- coverage and similarity ----


@_register
def concept_coverage(p):
    d = p.d
    R.bm25(p, k=20)
    p.columns("qt", claims(p), keep="query_id", q=T.terms(d, "text"))
    p.columns("ct", cards(p), keep="card_id", c=T.terms(d, "concat_ws(' ', section, tag, highlight)"))
    return f"select f.query_id, f.card_id, {d.overlap('qt.q', 'ct.c')} as covers from fts f join qt on qt.query_id = f.query_id join ct on ct.card_id = f.card_id"


@_register
def pair_similarity(p):
    """Similarity of the candidates of one query to one another: a bounded set (k per query)."""
    d = p.d
    R.bm25(p, k=8)
    p.add("candidates", "select distinct card_id from fts")
    p.columns("ps0", p.add("psc", f"select c.* from {cards(p)} c join candidates o on o.card_id = c.card_id"), keep="card_id, section, author, card_name, document", t="concat_ws(' ', section, tag, highlight, substring(body, 1, 2000))")
    T.add_phrases(p, "ps1", "ps0", t="t")
    p.columns("ps2", "ps1", terms=d.union(T.terms(d, "t"), T.normalised(d, T.terms(d, "t")), "t_phrases"))
    p.add("ps3", "select f.query_id, c.* from fts f join ps2 c on c.card_id = f.card_id")
    v = lambda a: f"coalesce({a}.author, {a}.card_name, '')"
    shared = f"{d.size(d.inter('a.t_phrases', 'b.t_phrases'))} > 0"
    lex = d.ratio(d.size(d.inter("a.terms", "b.terms")), d.size(d.union("a.terms", "b.terms")))
    total = f"least(1e0, {lex} + case when {v('a')} = {v('b')} then 0.15e0 else 0e0 end + case when a.document = b.document then 0.1e0 else 0e0 end + case when a.section = b.section and {shared} then 0.18e0 else 0e0 end)"
    return f"select a.query_id, a.card_id as left_id, b.card_id as right_id, {d.round(total, 6)} as similarity from ps3 a join ps3 b on a.query_id = b.query_id and a.card_id < b.card_id"


@_register
def source_validation(p):
    """Citation-like spans of an answer, and whether a card carries them."""
    d = p.d
    names = "'As Adler 2005 shows. Brook 98 disagrees! See Nobody 2011? Done.'"
    p.columns("an0", claims(p), keep="query_id", answer=f"{names} || ' ' || text")
    p.columns("an1", "an0", spans=d.distinct(d.find_all("answer", r"\b[A-Z][A-Za-z'’-]{2,}\s+(?:[0-9]{4}|[’'][0-9]{2}|[0-9]{2})\b")))
    p.add("an2", d.explode("an1", "spans", "span", "query_id"))
    p.add("labels_known", f"select distinct card_name as label from {cards(p)} where card_name is not null")
    return "select a.query_id, a.span, l.label is not null as valid from an2 a left join labels_known l on l.label = a.span"


@_register
def grounded_summary(p):
    d = p.d
    R.bm25(p, k=3)
    p.add("gs", f"select f.query_id, f.rank, coalesce(c.card_name, substring(c.tag, 1, 40)) as title from fts f join {cards(p)} c on c.card_id = f.card_id")
    return f"select query_id, 'Top evidence: ' || {d.join(d.collect('title', 'rank'), '; ')} as summary, count(*) as n_cards from gs group by query_id"


@_register
def prompt_build(p):
    d = p.d
    R.bm25(p, k=3)
    nl = d.char(10)
    p.add("pb", f"select f.query_id, f.rank, '[' || cast(f.rank as varchar(3)) || '] ' || coalesce(c.card_name, 'Unknown') || ': ' || substring(c.body, 1, 300) as line from fts f join {cards(p)} c on c.card_id = f.card_id")
    p.add("pl", f"select query_id, {d.collect('line', 'rank')} as lines from pb group by query_id")
    return f"select q.query_id, {d.sha256('q.text || ' + nl + ' || ' + d.join('l.lines', ' | '))} as prompt_sha256 from {claims(p)} q join pl l on l.query_id = q.query_id"


# ---- evaluation ----


@_register
def ir_metrics(p):
    """Recall@20, precision@5, reciprocal rank@5, nDCG@10 and duplicate rate; relevant cards hold the claim's whole passage."""
    d = p.d
    R.bm25(p, k=20)
    if d.name == "spark":  # each body is read once, whatever the number of passages
        p.columns("rel_passages", "benchmark", keep="item_id as query_id, text")
        p.keep(p.make("rel_cards", lambda of: scoring.holding(of("cards").select("card_id", "body"), of("rel_passages"))))
    else:
        p.add("rel_cards", f"select q.item_id as query_id, c.card_id from benchmark q join {cards(p)} c on {d.contains('c.body', 'q.text')}")
    p.add("ev", f"select f.query_id, f.rank, case when r.card_id is not null then 1 else 0 end as hit, row_number() over (partition by f.query_id, c.tag order by f.rank) as copy from fts f join {cards(p)} c on c.card_id = f.card_id left join rel_cards r on r.query_id = f.query_id and r.card_id = f.card_id")
    p.add("n_rel", "select query_id, count(*) as n from rel_cards group by query_id")
    ideal = d.fold(d.map(d.seq("1", "cast(least(10, max(n.n)) as int)"), "i", "1e0 / log2(i + 1)"), "0e0" if d.name == "duckdb" else "0D", "s", "v", "s + v")
    return (
        f"select e.query_id, max(n.n) as n_relevant, {d.round('sum(e.hit) * 1e0 / max(n.n)', 6)} as recall_20, {d.round('sum(case when e.rank <= 5 then e.hit else 0 end) / 5e0', 6)} as precision_5, "
        f"{d.round('coalesce(max(case when e.rank <= 5 and e.hit = 1 then 1e0 / e.rank end), 0e0)', 6)} as mrr_5, {d.round(f'sum(case when e.rank <= 10 then e.hit / log2(e.rank + 1) else 0e0 end) / {ideal}', 6)} as ndcg_10, "
        f"{d.round('sum(case when e.copy > 1 then 1 else 0 end) * 1e0 / count(*)', 6)} as duplicate_rate from ev e join n_rel n on n.query_id = e.query_id group by e.query_id"
    )


@_register
def lookup_accuracy(p):
    R.citation_lookup(p)
    d = p.d
    return f"select {d.round(d.count_if('c.author = r.want_author') + ' * 1e0 / count(*)', 6)} as author_accuracy, count(*) as n from citation_lookup l join {cards(p)} c on c.card_id = l.card_id join {R.lookup_requests(p)} r on r.query_id = l.query_id where l.rank = 1"
