"""Ranked full-text queries of the index's own language: words, "phrases", prefix*, AND, OR, NOT, parentheses and NEAR(...).

A query is parsed on the driver, once per query text, into phrases and a condition over how often each
stands in a card; words side by side mean AND. Operators stand in capitals; NOT binds tighter than AND,
and AND tighter than OR. A missing operand or parenthesis raises ValueError. Words are folded and
stemmed like the index's; phrases and NEAR stay within one field. A card's rank sums the weight of
every phrase that isn't behind a NOT, by the cards that hold the phrase at all and, under NEAR, by the
occurrences that are near.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from evidentia.functions.dialect import Dialect, Pipe
from evidentia.functions.stem import fold, stem
from evidentia.operators.retrieval import FIELDS, WORD, index_terms, term_weight, top, vocabulary
from evidentia.sources.adapters import cards

_TOKEN = re.compile(r'\s*("(?:[^"]|"")*"\*?|[()]|,|[^\s()",]+)')
NEAR = 10
FIELD = 100_000_000  # between the places of one field's words and the next one's


def _words(text: str) -> list[str]:
    return [stem(fold(w)) for w in re.findall(r"[^\W_][^\W_̀-̱]*", text.lower())]


@dataclass
class Phrase:
    words: tuple[str, ...]
    prefix: bool = False
    near: int | None = None  # with ``beside``: counts only where that phrase is within so many words
    beside: tuple[str, ...] = ()
    counts: bool = True  # for the rank


@dataclass
class Parser:
    query: str
    phrases: list[Phrase] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.tokens, self.at = _TOKEN.findall(self.query), 0
        self.condition = self.any_of()
        if self.peek() is not None:
            raise ValueError("a full-text query has a stray parenthesis")

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self, want: str | None = None) -> str:
        t = self.peek()
        if t is None or want not in (None, t):
            raise ValueError(f"expected {want or 'a term'} in a full-text query")
        self.at += 1
        return t

    def any_of(self) -> str:
        parts = [self.all_of()]
        while self.peek() == "OR":
            self.take()
            parts.append(self.all_of())
        return "(" + " or ".join(parts) + ")"

    def all_of(self) -> str:
        parts = [self.minus()]
        while self.peek() not in (None, ")", "OR", ","):
            if self.peek() == "AND":
                self.take()
            parts.append(self.minus())
        return "(" + " and ".join(parts) + ")"

    def minus(self) -> str:
        left = self.term()
        while self.peek() == "NOT":
            self.take()
            known = len(self.phrases)
            right = self.term()
            for x in self.phrases[known:]:
                x.counts = False
            left = f"({left} and not {right})"
        return left

    def term(self) -> str:
        t = self.take()
        if t == "(":
            inner = self.any_of()
            self.take(")")
            return inner
        if t in (")", ",", "AND", "OR", "NOT"):
            raise ValueError("a full-text query lacks a term")
        if t == "NEAR" and self.peek() == "(":
            return self.near()
        return self.phrase(t)

    def found(self, x: Phrase) -> str:
        self.phrases.append(x)
        return f"{{f{len(self.phrases) - 1}}} > 0"

    def phrase(self, t: str) -> str:
        own = _words(t)
        return self.found(Phrase(tuple(own), t.endswith("*"))) if own else "true"

    def near(self) -> str:
        """Two phrases within n words of one another."""
        self.take("(")
        own, n = [], NEAR
        while self.peek() not in (None, ")", ","):
            own.append(tuple(_words(self.take())))
        if self.peek() == ",":
            self.take()
            n = int(self.take())
        self.take(")")
        own = [x for x in own if x]
        if len(own) > 2:
            raise ValueError("NEAR takes two phrases")
        if len(own) < 2:
            return self.found(Phrase(own[0])) if own else "true"
        parts = [self.found(Phrase(a, near=n, beside=b)) for a, b in (own, own[::-1])]
        return f"({' and '.join(parts)})"


def _at(words: list, w: str, prefix: bool) -> str:
    return f"p{words.index((w, prefix))}"


def _places(d: Dialect, words: list, x: tuple[str, ...], prefix: bool) -> str:
    """Places of a phrase's first word, an array."""
    first, *rest = (_at(words, w, prefix and i == len(x) - 1) for i, w in enumerate(x))
    return d.filter(first, "pa", " and ".join(d.has(r, f"pa + {i}") for i, r in enumerate(rest, 1))) if rest else first


def search(p: Pipe, queries: tuple[str, ...], name: str = "boolean", k: int = 50) -> str:
    """(query_no, card_id, bm25, rank) of each query's best cards."""
    d = p.d
    parsed = [Parser(q) for q in queries]
    words = sorted({(w, x.prefix and i == len(x.words) - 1) for q in parsed for x in q.phrases for i, w in enumerate(x.words)})
    is_ = lambda w, prefix: d.starts("stem", d.lit(w)) if prefix else f"stem = {d.lit(w)}"
    p.add(f"{name}_wanted", f"select word, stem from {vocabulary(p)} where {' or '.join(is_(w, prefix) for w, prefix in words)}")
    docs = index_terms(p)
    each = []
    for i, f in enumerate(FIELDS):
        p.columns(f"{name}_w{i}", cards(p), keep="card_id", words=d.find_all(f"lower(coalesce({f}, ''))", WORD))
        each.append(f"select card_id, word, word_at + {i * FIELD} as place from ({d.explode_at(f'{name}_w{i}', 'words', 'word', 'card_id')}) x")
    p.add(f"{name}_each", " union all ".join(each))
    p.add(f"{name}_post", f"select e.card_id, e.place, w.stem from {name}_each e join {name}_wanted w on w.word = e.word")
    found = {f"p{i}": d.collect(f"case when {is_(w, prefix)} then place end", "place") for i, (w, prefix) in enumerate(words)}
    p.add(f"{name}_cards", f"select card_id, {', '.join(f'{x} as {k}' for k, x in found.items())} from {name}_post group by card_id")
    held, use = {}, {}
    for i, q in enumerate(parsed):
        for j, x in enumerate(q.phrases):
            own = _places(d, words, x.words, x.prefix)
            held[f"h{i}_{j}"] = d.size(own)
            if x.near is None:
                use[f"f{i}_{j}"] = f"h{i}_{j}"
            else:
                after, before = f"pb >= pc + {len(x.words)} and pb <= pc + {len(x.words) + x.near}", f"pb + {len(x.beside)} <= pc and pb + {len(x.beside) + x.near} >= pc"
                use[f"f{i}_{j}"] = d.size(d.filter(own, "pc", d.any(_places(d, words, x.beside, False), "pb", f"({after}) or ({before})")))
    p.columns(f"{name}_held", f"{name}_cards", **held)
    p.keep(p.columns(f"{name}_use", f"{name}_held", keep=f"card_id, {', '.join((*(f'p{i}' for i in range(len(words))), *held))}", **use))
    p.add(f"{name}_stats", f"select count(*) as n, avg(dl) as avgdl from {docs}")
    p.add(f"{name}_df", f"select {', '.join(f'{d.count_if(h + chr(32) + chr(62) + chr(32) + chr(48))} as {chr(100)}{h[1:]}' for h in held)} from {name}_use")
    # the condition may hold without any phrase (a query of signs alone matches nothing)
    parts = []
    for i, q in enumerate(parsed):
        weights = [f"({term_weight(f'u.f{i}_{j}', f't.d{i}_{j}')})" for j, x in enumerate(q.phrases) if x.counts]
        condition = q.condition.format(**{f"f{j}": f"u.f{i}_{j}" for j in range(len(q.phrases))})
        parts.append(f"select {i} as query_no, u.card_id, {d.round(' + '.join(weights) or '0e0', 6)} as bm25 from {name}_use u join {docs} o on o.card_id = u.card_id cross join {name}_df t cross join {name}_stats s where {condition}")
    p.add(f"{name}_rows", " union all ".join(parts))
    return top(p, name, f"{name}_rows", "bm25 desc, card_id", k, by="query_no")
