"""Full-text search against an index of its own kind: SQLite's, with the same tokenizer, over the same cards."""

from __future__ import annotations

import random
import re
import sqlite3

import pytest

from evidentia.functions import stem as S
from evidentia.functions.dialect import SPARK, Pipe
from evidentia.operators import boolean as O
from evidentia.operators import retrieval as R
from evidentia.plans import registry
from evidentia.sources.adapters import cards

SF = "/root/testdata/sf0.001"
EXTRA = (
    "Policies prevent escalation.\nThe policy prevented an escalating conflict; café owners agreed.",
    "Preventing escalations: a policy of CAFÉS",
    "resume résumé naïve überlegen el niño",
    "near the river and the old mill, the market and the town near the river",
    "running runs ran runner; y yes sky skies",
)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder of tables, and the index over its cards."""
    path = str(tmp_path_factory.mktemp("fts"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(100_000 + i, t, "en", "src 1", len(t)) for i, t in enumerate(EXTRA)], docs.schema)
    docs.unionByName(more).write.parquet(f"{path}/documents.parquet")
    p = Pipe(SPARK)
    rows = registry.run_pipe(spark, path, p, f"select card_id, tag, card_name, citation, body from {cards(p)}").collect()
    db = sqlite3.connect(":memory:")
    try:
        db.execute("create virtual table f using fts5(card_id unindexed, tag, card_name, citation, body, tokenize='porter unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("this SQLite has no full-text index")
    db.executemany("insert into f values (?, ?, ?, ?, ?)", [tuple(r) for r in rows])
    return path, db


def ranked(db, match):
    return {c: round(-r, 5) for c, r in db.execute("select card_id, rank from f where f match ?", (match,))}


def plain(db, text):
    words = re.findall("[a-z0-9]+", text.lower())
    quoted = [f'"{w}"' for w in words]
    return (ranked(db, " ".join(quoted)) or ranked(db, " OR ".join(quoted))) if words else {}


QUERIES = ("preventing policy escalation", "policies", "cafe", "resume", "the and the", "xyzzy the", "don't agree", "skies run", "", "!?", "niño", "the river near the market")


def test_plain_queries_rank_as_the_index_does(spark, corpus):
    path, db = corpus
    r = random.Random(3)
    body = [t for (t,) in db.execute("select body from f") if t]
    asked = [*QUERIES, *(" ".join(r.choices(re.findall(r"\w+", r.choice(body)) or ["the"], k=r.randint(1, 6))) for _ in range(25))]
    spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "query_id long, text string").createOrReplaceTempView("fulltext_asked")
    p = Pipe(SPARK)
    R.bm25(p, source="fulltext_asked", k=10**6)
    found = {}
    for x in registry.run_pipe(spark, path, p, "select query_id, card_id, bm25, rank from fts").collect():
        found.setdefault(x.query_id, {})[x.card_id] = (x.bm25, x.rank)
    for i, q in enumerate(asked):
        want, got = plain(db, q), found.get(i, {})
        assert set(got) == set(want), q
        assert all(abs(got[c][0] - want[c]) < 2e-5 for c in want), q
        assert [s for s, _ in sorted(got.values(), key=lambda x: x[1])] == sorted((s for s, _ in got.values()), reverse=True)


ADVANCED = (
    "policy AND escalation", '"the and"', '"policy prevented"', "prevent* NOT café", "NEAR(river market, 3)", "NEAR(near river, 1)", "(cafe OR resume) AND policy", '"old mill" OR "the town"', "run* OR yes", "the NOT (and OR der)",
    '"all rights reserved" OR license', "sk*", "naive AND niño", "NEAR(the and, 2)", '"the river" NOT "old mill"',
)


def test_advanced_queries_rank_as_the_index_does(spark, corpus):
    path, db = corpus
    p = Pipe(SPARK)
    O.search(p, ADVANCED, k=10**6)
    found = [{} for _ in ADVANCED]
    for x in registry.run_pipe(spark, path, p, "select query_no, card_id, bm25 from boolean").collect():
        found[x.query_no][x.card_id] = x.bm25
    for q, got in zip(ADVANCED, found):
        want = ranked(db, q.replace("niño", '"niño"').replace(" café", ' "café"'))
        assert set(got) == set(want), q
        assert all(abs(got[c] - want[c]) < 2e-5 for c in want), (q, [(got[c], want[c]) for c in list(want)[:5]])


def test_advanced_queries_that_lack_something():
    for bad in ("a OR", "(a b", "a )", "AND a", "NEAR(a b c, 2)", "NOT a"):
        with pytest.raises(ValueError):
            O.Parser(bad)


def test_stems_are_the_indexs(spark, corpus):
    _, db = corpus
    words = sorted({w for (t,) in db.execute("select body from f") for w in re.findall(r"[^\W_]+", (t or "").lower())})[::7]
    words += "eed eeds yes syzygy agreed feed hopping falling abc1s relational vietnamization adjustment controlling".split()
    one = sqlite3.connect(":memory:")
    one.execute("create virtual table f using fts5(a, tokenize='porter unicode61')")
    one.execute("create virtual table v using fts5vocab('f', 'instance')")
    words = sorted(set(words))
    one.executemany("insert into f(rowid, a) values (?, ?)", list(enumerate(words)))
    want = {words[i]: t for t, i in one.execute("select term, doc from v")}
    spark.createDataFrame([(w,) for w in words], "word string").createOrReplaceTempView("stem_words")
    p = Pipe(SPARK)
    S.add_stems(p, "st", "stem_words")
    got = {r.word: r.stem for r in spark.sql(p.sql("select word, stem from st")).collect()}
    assert got == want and all(S.stem(S.fold(w)) == x for w, x in want.items())
