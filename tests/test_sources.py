"""Grammars, Word files, bundles, streams."""

from __future__ import annotations

import pandas as pd

from evidentia.operators import bundle
from evidentia.sources import docx, grammar
from evidentia.streaming import index

SOURCE = r"""# sections, alternatives, an escape, an optional address
@defaults {
owner: "theirs"
}
=== [section] ===
-- [card] -- [author] | Card [card]: [author] | -- [card] \| [school] \| [author]~0.6
[link:url]?
Meta: [_]?
[content]+
"""

TEXT = """=== First Part ===
-- Growth works -- Adler
https://site.example/a
Meta: ignored
Body one.
Body two.
Card Trade helps: Brook
Body three.
— War is bad | North | Cole
Body four.
"""


def test_grammar():
    cards, notes = grammar.parse_text(TEXT, SOURCE)
    assert [c["fields"]["author"] for c in cards] == ["Adler", "Brook", "Cole"]
    first = cards[0]
    assert first["fields"] == {"owner": "theirs", "section": "First Part", "card": "Growth works", "author": "Adler", "link": "https://site.example/a", "content": "Body one.\n\nBody two."}
    assert first["confidence"]["link"] == 1.0 and first["overall_confidence"] == 0.98
    assert [n["code"] for n in cards[1]["diagnostics"]] == ["SA-PARSE-001"]
    assert grammar.summary(cards)["detected_cards"] == 3
    assert [n["code"] for n in grammar.compile_grammar("[text:odd]").notes] == ["SA-GRAMMAR-001", "SA-GRAMMAR-002"]
    assert "SA-GRAMMAR-004" in [n["code"] for n in grammar.compile_grammar("[card]\n[a]+\n[content]+").notes]
    assert "SA-GRAMMAR-005" in [n["code"] for n in grammar.compile_grammar("-- [card] | ** [b]").notes]
    assert grammar.parse_text("x", "[content]+")[0] == []


def test_grammar_on_frames(spark):
    d = spark.createDataFrame([(1, TEXT), (2, None), (3, "nothing here")], "doc_id long, text string")
    assert [(r.document_id, r.card_index) for r in grammar.parse(d, SOURCE).orderBy("document_id", "card_index").collect()] == [(1, 0), (1, 1), (1, 2)]


def test_docx(spark, tmp_path):
    parts = [("Heading2", [("AT: Growth", None)]), ("Heading4", [("Growth works", None)]), (None, [("Jane Adler, 2019, http://x.example/p", None)]), (None, [("plain ", None), ("hot", "yellow"), (" topic", "yellow"), (" end .", None)]), ("Heading4", [("No body", None)]), (None, [("Cite only", None)])]
    (tmp_path / "a.docx").write_bytes(docx.write_bytes(parts))
    (tmp_path / "b.docx").write_bytes(b"broken")
    rows = docx.read(spark, str(tmp_path)).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.section, r.tag, r.author, r.year, r.card_name, r.url, r.body, r.n_highlights) == ("AT: Growth", "Growth works", "Adler", 2019, "Adler 19", "http://x.example/p", "plain hot topic end.", 1)
    spans = docx.highlights(docx.paragraphs(docx.write_bytes(parts))[3:4])
    assert spans == [{"text": "hot topic", "colour": "yellow", "paragraph": 3, "run": 1, "start": 6, "end": 15, "bold": False}]


def test_separator():
    p = lambda *ts: docx.paragraphs(docx.write_bytes([(None, [(t, None)]) for t in ts]))
    cards = docx.by_look(p("1. Growth works", "Jane Adler ’19, Journal [accessed 1/2/2020]", "https://site.example/more", "Body text.", "2. Empty", "Brook 2001, http://y.example/z"))
    assert [(c["title"], c["citation"], c["body"]) for c in cards] == [("Growth works", "Jane Adler ’19.", ["Body text."])]
    assert cards[0]["full_citation"].endswith("https://site.example/more")


def test_bundle(spark):
    row = lambda i, score, author, terms: (1, i, i, score, author, "d", "s", f"tag {i}", terms, ["growth"])
    data = [row(1, 0.9, "A", ["growth", "trade", "growth_trade"]), row(2, 0.8, "A", ["growth", "trade", "growth_trade"]), row(3, 0.7, "B", ["war"]), row(4, 0.1, None, [])]
    df = spark.createDataFrame(data, "query_id long, card_id long, rank int, score double, author string, document string, section string, tag string, terms array<string>, q_terms array<string>")
    found = {r.card_id: r for r in bundle.clusters(df).collect()}
    assert found[1].cluster == found[2].cluster == 0 and found[3].cluster != 0 and found[1].thesis == "tag 1"
    assert [r.card_id for r in bundle.select_diverse(df, 3).orderBy("pick").collect()] == [1, 3, 2]
    a = {"terms": {"x", "y_z"}, "author": None, "document": "", "section": "s"}
    assert bundle.similarity(a, a) == 1.0 and bundle.similarity(a, {**a, "terms": set()}) == 0.0
    assert isinstance(bundle._clusters(pd.DataFrame(df.toPandas())), pd.DataFrame)


def test_streamed_index(spark, tmp_path):
    path, schema = f"file://{tmp_path}", "card_id long, kind string, text string"
    for batch in ([(1, "fast", "a"), (2, "fast", "b")], [(1, "fast", "a"), (2, "fast", "c"), (3, "deep", "d")], [(3, "deep", None)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        index.maintain(spark.readStream.schema(schema).parquet(f"{path}/in"), path).awaitTermination()
    assert sorted((r.card_id, r.batch) for r in index.current(spark, path).collect()) == [(1, 0), (2, 1)]


def test_schedule():
    from evidentia.operators.schedule import Probe, replay

    hits = lambda a, n: [(f"{a}{i}", i) for i in range(1, n + 1)]
    done = replay([Probe(1, "both", hits("a", 20)), Probe(2, "semantic", hits("a", 5)), Probe(3, "semantic", []), Probe(4, "semantic", hits("z", 5)), Probe(5, "lexical", hits("b", 3))], depth=4, target=12, most=16, active=1)
    assert [p.stopped for p in done] == ["target reached", "no marginal novel evidence", "no marginal novel evidence", "global pool saturation", "not expanded by scheduler budget"]
    assert [(p.rounds, p.depth, p.novel) for p in done] == [(3, 16, 16), (1, 4, 0), (1, 4, 0), (0, 0, 0), (1, 4, 3)]


def test_boolean(spark, tmp_path):
    import pytest

    from evidentia.functions.dialect import SPARK, Pipe
    from evidentia.operators.boolean import Parser, search
    from evidentia.plans import registry

    rows = [(1, "free trade helps growth"), (2, "trade wars harm free growth"), (3, "nothing")]
    spark.createDataFrame([(i, t, "en", "src", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    asked = ("free trade", '"free trade"', "trade NOT wars OR nothing", "(wars OR helps) AND grow*", "NEAR(trade free, 1)", "NEAR(free trade, 2)")
    p = Pipe(SPARK)
    search(p, asked)
    found = [[] for _ in asked]
    for r in registry.run_pipe(spark, str(tmp_path), p, "select query_no, card_id from boolean order by card_id").collect():
        found[r.query_no].append(r.card_id)
    assert found == [[1, 2], [1], [1, 3], [1, 2], [1], [1, 2]]
    for bad in ("AND x", "(a", "a)", "NOT"):
        with pytest.raises(ValueError):
            Parser(bad)


def test_word_files_hold_whole_lines(spark, tmp_path):
    from hashlib import sha256

    from evidentia.plans import python_queries

    line = " ".join(f"word{i}" for i in range(900))
    spark.createDataFrame([(1, f"{line}\nshort second line\n{line} end")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = sha256(f"{line}\n\nshort second line\n\n{line} end".encode()).hexdigest()
    (a,), (b,) = python_queries.docx_cards(spark, str(tmp_path)).collect(), python_queries.separated_cards(spark, str(tmp_path)).collect()
    assert (a.section, a.tag, a.body, b.title, b.body) == (line, line, want, line, want)
