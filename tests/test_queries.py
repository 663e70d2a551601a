"""Every SQL query gives the same rows in Spark and DuckDB, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from evidentia.plans import registry, sql_queries

SF = "/root/testdata/sf0.001"
HEAVY = {"claim_relationships", "slot_coverage", "side_lanes", "lane_audit", "lane_funnel", "match_locations", "relevance_gate", "general_gate", "full_context_rerank"}


def norm(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in registry.TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(set(sql_queries.QUERIES) - HEAVY))
def test_same_rows(spark, con, name):
    df = registry.run(spark, SF, name)
    got = sorted(repr(tuple(norm(r[c]) for c in sorted(df.columns))) for r in df.collect())
    r = con.execute(registry.oracle_sql()[name])
    cols = [c[0] for c in r.description]
    at = [cols.index(c) for c in sorted(cols)]
    assert sorted(cols) == sorted(df.columns)
    assert got == sorted(repr(tuple(norm(x[i]) for i in at)) for x in r.fetchall())


def small(tmp_path, **tables):
    c = duckdb.connect()
    for name, sql in tables.items():
        c.execute(f"copy ({sql}) to '{tmp_path}/{name}.parquet' (format parquet)")
    return str(tmp_path)


def cards_sql(*texts):
    return " union all ".join(f"select {i}::bigint as doc_id, '{t}' as text, 'en' as lang, 'src 1' as source, {len(t)}::bigint as n_chars" for i, t in enumerate(texts))


def test_claims_are_whole(spark, tmp_path):
    passage = " ".join(f"w{i}" for i in range(1, 31))
    sf = small(tmp_path, benchmark=f"select 0::bigint as item_id, '{passage}' as text", documents=cards_sql("w29 w30 alone", f"before {passage} after", passage[:60] + " other end"))
    p = registry.Pipe(registry.SPARK)
    claim = registry.run_pipe(spark, sf, p, "select * from " + sql_queries.claims(p)).collect()
    assert [(r.plain, r.text) for r in claim] == [(passage, passage.replace("w3 ", "w3 prevents "))]
    assert [r.card_id for r in registry.run(spark, sf, "fts_prefix_or").orderBy("card_id").collect()] == [0, 1, 2]
    assert [r.n_relevant for r in registry.run(spark, sf, "ir_metrics").collect()] == [1]


def test_searches_reach_past_the_first_line(spark, tmp_path):
    texts = ["first line here\nthe needle economy grows; nuclear deterrence works", "x" * 250 + " needle", "no such word"]
    sf = small(tmp_path, benchmark="select 0::bigint as item_id, 'the needle in a stack of hay' as text union all select 1, 'the Adler, of all names'", documents=cards_sql(*texts))
    hits = {(r.query_id, r.card_id) for r in registry.run(spark, sf, "like_fallback").collect()}
    assert hits == {(0, 0), (0, 1), (1, 0)}
    terms = {r.term for r in registry.run(spark, sf, "canonical_terms").collect()}
    assert {"economy", "deterrence", "needle"} <= terms
    phrases = {r.card_id: r.t_phrases for r in registry.run(spark, sf, "phrase_concepts").collect()}
    assert "nuclear" in phrases[0]


def test_rest_stands_without_training_data_operators():
    import ast
    from pathlib import Path

    import __spark_entry__

    assert set(sql_queries.QUERIES) <= set(__spark_entry__.queries())
    root = Path(registry.__file__).parents[1]
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            for node in ast.walk(ast.parse(f.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any(n.startswith("evidentia.llm") or n == "corpus_pipeline" for n in names), f
