"""The best full-text hits: as SQL has them, and no more rows than a task's best of each query."""

from __future__ import annotations

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from evidentia.functions.dialect import DUCK, SPARK, Pipe
from evidentia.operators import retrieval as R
from evidentia.operators import scoring
from evidentia.plans import registry

CLAIMS = ["common words stand everywhere today", "common common words", "rare stone and river", "xyzzy plugh", "", "rivers and stones and words", "stone"]


def tables(path, cards, claims=CLAIMS):
    """cards: (doc_id, text)."""
    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    c.executemany("insert into documents values (?, ?, 'en', 'src 1', 1)", cards)
    c.execute("create table benchmark (item_id bigint, text varchar)")
    c.executemany("insert into benchmark values (?, ?)", list(enumerate(claims)))
    for t in ("documents", "benchmark"):
        c.execute(f"copy {t} to '{path}/{t}.parquet' (format parquet)")
    return str(path), c


def both(spark, path, c, build, final):
    p = Pipe(SPARK)
    build(p)
    got = [tuple(r) for r in registry.run_pipe(spark, path, p, final).collect()]
    q = Pipe(DUCK)
    build(q)
    return sorted(got, key=repr), sorted(c.execute(q.sql(final)).fetchall(), key=repr)


def test_hits_do_not_grow_with_the_cards(spark, tmp_path):
    path, _ = tables(tmp_path, [(i, f"common words of card {i}") for i in range(2000)], [f"common words {i}" for i in range(20)])
    p = Pipe(SPARK)
    R.bm25(p, k=2)
    rows = registry.run_pipe(spark, path, p, "select * from fts_hits").count()
    assert rows <= 20 * 2 * 2 * spark.sparkContext.defaultParallelism < 20 * 2000
    p = Pipe(SPARK)
    R.prefix_hits(p, "r", every=False, k=2)
    assert registry.run_pipe(spark, path, p, "select * from r_h").count() <= 20 * 2 * 2 * spark.sparkContext.defaultParallelism


ODD = [(i, f"common words {'stone ' * (i % 4)}everywhere {i % 3}") for i in range(40)] + [(7, "stone river and rare"), (7, "rivers"), (50, None), (51, ""), (52, "rare stones and a river, and words"), (53, "rare stones and a river, and words"), (54, "common words stand everywhere today")]


@pytest.mark.parametrize("few", [False, True])
def test_odd_tables_as_in_sql(spark, tmp_path, monkeypatch, few):
    """Repeated ids, texts that tie, empty texts, claims without words, claims that a card has whole; ``few``: in many parts."""
    if few:
        monkeypatch.setattr(scoring, "ASKED", 3)
        monkeypatch.setattr(scoring, "LOOKED_UP", 5)
    path, c = tables(tmp_path, ODD)
    got, want = both(spark, path, c, lambda p: R.bm25(p, k=3), "select query_id, card_id, bm25, n_matched, n_terms, rank from fts")
    assert got == want and len(got) > 9
    for every in (False, True):
        got, want = both(spark, path, c, lambda p: R.prefix_hits(p, "r", every=every, k=3), "select query_id, card_id, n_terms, score, rank from r")
        assert got == want and got


@pytest.mark.parametrize("want", ["either", "any", "all"])
def test_blocks_together_give_the_best(monkeypatch, want):
    monkeypatch.setattr(scoring, "BLOCK", 7)
    monkeypatch.setattr(scoring, "CELLS", 40)
    r = np.random.default_rng(5)
    n, total, k = 300, 12, 4
    has = r.random((n, total)) < r.choice([0.1, 0.5, 0.9], total)
    tf, dl = r.integers(1, 4, (n, total)), r.integers(5, 30, n).astype(np.int32)
    ids = r.permutation(n).astype(np.int64) * 3
    terms = [np.flatnonzero(x).astype(np.int32) for x in has]
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[s]), *(pa.array([f(i).tolist() for i in range(n)[s]], pa.list_(pa.int32())) for f in (lambda i: terms[i], lambda i: tf[i][terms[i]], lambda i: np.full(len(terms[i]), dl[i])))], ["card_id", "terms", "tfs", "dls"]) for s in (slice(0, 150), slice(150, n))]
    asked = [r.choice(total, size, replace=False) for size in (1, 3, 5, 12, 2, 7)]
    m = [r.integers(1, 3, len(a)) for a in asked]
    idf, average = r.random(total) + 1e-6, 11.5
    start = np.concatenate([[0], np.cumsum([len(a) for a in asked])])
    query = np.array([2, 3, 5, 7, 11, 13])
    out = [b.to_pylist() for b in scoring._score(iter(batches), query, start, np.concatenate(asked), np.concatenate(m).astype(float), idf, average, k, want)]
    got = {q: [] for q in query.tolist()}
    for x in sum(out, []):
        got[x["query_id"]].append((-x["bm25"], x["card_id"], x["n_matched"], x["n_terms"]))
    for q, a, times in zip(query.tolist(), asked, m):
        hits = []
        for i in range(n):
            own = [(t, w) for t, w in zip(a, times) if has[i, t]]
            if own:
                score = sum(w * idf[t] * tf[i, t] * 2.2 / (tf[i, t] + 1.2 * (0.25 + 0.75 * dl[i] / average)) for t, w in own)
                hits.append((-np.floor(score * 1e6 + 0.5) / 1e6, int(ids[i]), len(own), len(a)))
        whole = [h for h in hits if h[2] == h[3]]
        assert sorted(got[q]) == sorted(hits if want == "any" or want == "either" and not whole else whole)[:k]


@pytest.mark.parametrize("positive", [True, False])
def test_nearest_vectors_as_in_sql(spark, tmp_path, monkeypatch, positive):
    """Null, zero and shorter vectors, ties and opposite ones; queries in several parts."""
    monkeypatch.setattr(scoring, "NUMBERS", 12)
    path, c = tables(tmp_path, [(0, "x")], ["a", "b", "c", "d", "e"])
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=4).astype(np.float32).tolist()) for i in range(60)] + [(60 + i, v) for i, v in enumerate(([0.0] * 4, None, [1.0, 2.0], [], [1.0, None, 0.0, 0.0], [-1.0, -2.0, -3.0, -4.0]))] + [(70 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(8)]
    rows[3] = (3, [1.0, 0.0, 0.0, 0.0])
    rows[4] = (4, [0.0, 0.0, 0.0, 0.0])
    c.execute("create table embeddings (vec_id bigint, embedding float[])")
    c.executemany("insert into embeddings values (?, ?)", rows)
    c.execute(f"copy embeddings to '{path}/embeddings.parquet' (format parquet)")
    got, want = both(spark, path, c, lambda p: R.cosine(p, k=6, drop_zero=positive), "select query_id, card_id, score, rank from cosine")
    assert got == want and len(got) >= (24 if positive else 30)
    p = Pipe(SPARK)
    R.cosine(p, k=6, drop_zero=positive)
    assert registry.run_pipe(spark, path, p, "select * from cosine_rows").count() < 5 * len(rows)


def test_author_source_rows_do_not_grow_with_the_cards(spark, tmp_path):
    """Also repeated ids, and a term that stands in nearly every text."""
    cards = [(i, f"text {i}") for i in range(900)] + [(5, "again"), (5, "and again"), (None, "no id")]
    path, c = tables(tmp_path, cards, ["a journal of Adler 2004", "o", "brook's 1985 src", "'", "xyz", "", "r"])
    got, want = both(spark, path, c, R.author_source, "select query_id, card_id, rank from author_source where card_id is not null")
    assert got == want and got
    p = Pipe(SPARK)
    R.author_source(p)
    assert registry.run_pipe(spark, path, p, "select * from author_source_rows").count() < 7 * 8 * 22 < 3 * 900


def test_passages_are_found_wherever_they_stand():
    r = np.random.default_rng(4)
    bodies = ["".join(r.choice(list("abé \n"), r.integers(0, 60))) for _ in range(3000)] + [None, "", "abcdefgh", "abcdefghabcdefgh"]
    passages = [b[i : i + n] for b, i, n in zip(bodies[:200], r.integers(0, 20, 200), r.integers(1, 30, 200))] + ["abcdefgh", "", "not there at all"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(bodies)), pa.int64()), pa.array(bodies)], ["card_id", "body"])
    out = [(x["query_id"], x["card_id"]) for b in scoring._holding(iter([batch]), pa.array(range(len(passages)), pa.int64()), [p.encode() for p in passages]) for x in b.to_pylist()]
    want = [(i, j) for i, p in enumerate(passages) for j, b in enumerate(bodies) if b is not None and p in b]
    assert sorted(out) == want and len(want) > 200


def test_evidence_strength_writes_nothing(spark, tmp_path, monkeypatch):
    path, _ = tables(tmp_path, [(1, "some text")])
    monkeypatch.setattr(registry, "materialise", lambda df, name: pytest.fail(f"{name} is written"))
    assert [r.card_id for r in registry.run(spark, path, "evidence_strength").collect()] == [1]
