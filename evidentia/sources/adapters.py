"""Cards, claims and vectors from the driver's tables."""

from __future__ import annotations

from evidentia.functions.dialect import Pipe

NAMES = ("Adler", "Brook", "Cole", "Dunn", "Eames", "Frost", "Grant", "Hale", "Irwin", "Jonas")


def cards(p: Pipe) -> str:
    """Each document as a card; bibliographic columns follow from its id."""
    if "cards" in p.parts:
        return "cards"
    d = p.d
    names = d.strings(NAMES)
    line = d.split("text", "\n")
    p.columns(
        "cards_0",
        "documents",
        keep="doc_id as card_id, source as section, source as document, lang as argument_name, text as body",
        tag=f"substring({d.at(line, '1')}, 1, 200)",
        author=f"case when doc_id % 7 = 3 then null else {d.at(names, 'cast(doc_id % 10 as int) + 1')} end",
        year="case when doc_id % 11 = 5 then null else cast(1980 + doc_id % 45 as int) end",
        para="cast(doc_id % 97 as int)",
        order_index=f"cast({d.replace('source', '[^0-9]', '')} as int)",
        side="case doc_id % 4 when 0 then 'ours' when 1 then 'opponent' when 2 then 'aff' end",
        category="case doc_id % 3 when 0 then 'impact' when 1 then 'link' else '' end",
        topical="case doc_id % 5 when 0 then true when 1 then false end",
    )
    p.columns(
        "cards",
        "cards_0",
        card_name="case when author is null then null else author || ' ' || lpad(cast(coalesce(year, 2000) % 100 as varchar(4)), 2, '0') end",
        citation="case when author is null then null else author || ', ' || coalesce(cast(year as varchar(4)), 'n.d.') || ', Journal ' || section end",
        highlight="case when card_id % 6 = 1 then '' else substring(body, 1, 160) end",
    )
    return "cards"


def claims(p: Pipe) -> str:
    """Each benchmark passage as a claim, whole, with control language after its third word."""
    if "claims" in p.parts:
        return "claims"
    d = p.d
    p.columns("claims_0", "benchmark", keep="item_id as query_id", words=d.split("text", r"[ \n]+"))
    p.columns(
        "claims_1",
        "claims_0",
        keep="query_id",
        head=d.join(d.slice("words", "1", "3"), " "),
        plain=d.join("words", " "),
        tail=d.join(d.slice("words", "4", d.size("words")), " "),
    )
    verb = d.at(d.strings(["prevents", "causes", "increases", "undermines", "reduces", "because of", "and", "protects"]), "cast(query_id % 8 as int) + 1")
    p.columns("claims", "claims_1", keep="query_id", text=f"head || ' ' || {verb} || ' ' || tail", plain="plain")
    return "claims"
